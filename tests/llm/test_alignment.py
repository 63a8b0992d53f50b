"""Token alignment against a plain merge of both tokenizers' own output."""

from __future__ import annotations

import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from samples import SCHEMA, documents, prose

from spanlake.llm import alignment
from spanlake.llm.queries import QUERIES


def plain_tokens(text, one, two, bytes_b):
    """Ids and spelt bytes of both tokenizers for one text."""
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    table = alignment.byte_of()
    spelt_a = [bytes(table[c] for c in one.id_to_token(i)) for i in a]
    spelt_b = [bytes_b(i) for i in b]
    raw = (" " + text).encode()
    return (a, b, spelt_a, spelt_b) if text and b"".join(spelt_a) == raw == b"".join(spelt_b) else ([], [], [], [])


def brute(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def bytes_b(i):
        piece = two.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()

    done, pairs = [], Counter()
    for doc_id, text in rows:
        a, b, spelt_a, spelt_b = plain_tokens(text or "", one, two, bytes_b)
        ends_a, ends_b = np.cumsum([len(x) for x in spelt_a]).tolist(), np.cumsum([len(x) for x in spelt_b]).tolist()
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(a[ends_a.index(c)], b[ends_b.index(c)]) for c in cuts]
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(
                ",".join(str(i) for i, e in zip(ids, ends) if low < e <= c) for ids, ends in ((a, ends_a), (b, ends_b))
            ))
            low = c
        pairs.update(links)
        done.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    highest = Counter()
    for (_, b), n in pairs.items():
        highest[b] = max(highest[b], n)
    return sorted((
        (d, n_a, n_b, n_g, len(ls), sum(pairs[x] == highest[x[1]] for x in ls), sum(pairs[x] for x in ls),
         hashlib.sha256(g.encode()).hexdigest() if g else "")
        for d, n_a, n_b, n_g, ls, g in done
    ), key=repr)


@pytest.mark.parametrize("lane,block", [(1 << 10, 1 << 22), (16, 2000), (1, 1)])
def test_alignment_of_samples(spark, monkeypatch, lane, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rows = [(d, t) for d, t, *_ in documents()] + [(70, "▁ kept? ▁"), (71, "a\x00b <s> </s> <unk> <0x41>"), (72, " lead"), (73, "ﬀ½ é")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, lane=lane).collect()), key=repr)
    assert got == brute(rows)
    assert {r[0]: r[1] for r in got}[70] == 0  # a piece's own mark for a space is not given back


def test_merge_of_random_cuts():
    rng = random.Random(4)
    for lane in (1, 3, 50, 10_000):
        sizes = [rng.choice((0, 1, 2, 40, 900)) for _ in range(30)]
        bounds = np.cumsum([0, *sizes])
        one, two = ([], [])
        for low, high in zip(bounds, bounds[1:]):
            for ends in (one, two):
                inner = [x for x in range(low + 1, high) if rng.random() < 0.3]
                ends.extend([*inner, high] if high > low else [])
        a, b = alignment.merged(np.array(one, np.int64), np.array(two, np.int64), bounds, lane)
        assert [one[i] for i in a] == [two[i] for i in b] == sorted(set(one) & set(two))


def test_long_text_takes_lanes():
    """One document of two million tokens: merged step by step it would take minutes."""
    ends = np.arange(1, 2_000_001)
    start = time.time()
    a, _ = alignment.merged(ends, ends[1::2].copy(), np.array([0, 2_000_000]))
    assert len(a) == 1_000_000 and time.time() - start < 10


def test_empty_table_and_clashing_columns(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
    df = spark.createDataFrame(documents(), SCHEMA).selectExpr("*", "1 AS block", "2 AS pair", "3 AS n", "4 AS links", "5 AS counts")
    assert alignment.align(df).count() == len(documents())


def test_query(spark, tmp_path):
    rows = [(i, prose(i % 7, 30 + i), "en", "s", 0) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_alignment"](spark, str(tmp_path))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([r[:2] for r in rows])
