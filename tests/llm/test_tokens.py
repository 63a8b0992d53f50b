"""Token ids, byte-pair encoding and token counts against the libraries themselves."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pytest
from samples import SCHEMA, documents, prose

from spanlake.llm import bpe, pieces, token_counts, token_ids
from spanlake.sources.workspace import new_folder

DOCS = documents()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("plane,block", [("bit", 64), ("byte", 64), ("bit", 1 << 16)])
def test_ids_come_back(spark, docs, plane, block):
    folder = new_folder(spark, "ids")
    token_ids.write_ids(docs, folder, plane=plane, block=block)
    rows = sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected, at = [], 0
    for (doc_id, *_), ids in zip(rows, library_ids([r[1] or "" for r in rows])):
        raw = np.array([*ids, 2], "<u4").tobytes()
        expected.append((doc_id, at, raw))
        at += len(ids) + 1
    got = sorted(token_ids.read_documents(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in got] == expected
    got = sorted(token_ids.read_digests(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.crc) for r in got] == [
        (d, a, len(raw) // 4, zlib.crc32(raw)) for d, a, raw in expected
    ]


def test_query_is_the_unmodified_library(spark):
    """Special tokens' strings have their own ids in the query, whatever white space is around."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from spanlake.llm.queries import QUERIES

    texts = [
        "a <|endoftext|> b", "x\n <|endoftext|>\n y", "one<|endoftext|>two  <|endoftext|>", "plain words here",
        "<|endoftext|>", "\t <|endoftext|><|endoftext|> z a\n <|endoft", None, prose(1, 50),
    ]
    folder = new_folder(spark, "special")
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    got = sorted(QUERIES["op1_token_ids"](spark, folder).collect(), key=lambda r: r.doc_id)
    assert [(r.n_tokens, r.ids_crc32) for r in got] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in expected]
    assert 50256 in expected[0]


def test_planes():
    ids = np.array([0, 1, 50256, 2**32 - 1, 7], np.uint32)
    for plane, n in (("bit", 32), ("byte", 4)):
        planes = token_ids.to_planes(ids, plane)
        assert len(planes) == n
        assert token_ids.from_planes(planes, len(ids)).tolist() == ids.tolist()


def test_no_documents(spark, docs):
    folder = new_folder(spark, "ids")
    token_ids.write_ids(docs.limit(0), folder)
    assert token_ids.read_documents(spark, folder).count() == 0
    assert token_ids.read_digests(spark, folder).count() == 0


@pytest.mark.parametrize("long", [1 << 16, 50])
def test_tree_is_the_library(docs, long):
    name = "byte_bpe_multi_50k.tiktoken"
    encoding = pieces.rank_encoding(name)
    # A column that the operator adds itself is replaced, others stay.
    got = bpe.encode(docs.withColumnRenamed("n_chars", "ids"), long=long).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert len(got) == len(DOCS)
    for row, mine in zip(sorted(DOCS, key=key), sorted(got, key=key)):
        text = row[1] or ""
        assert (mine.doc_id, mine.text, mine.lang) == row[:3]
        assert list(mine.ids) == encoding.encode_ordinary(text)
        assert bytes(mine.decoded) == text.encode()


@pytest.mark.parametrize("leaf,window", [(1, 1), (3, 2), (40, 5)])
def test_joins_at_every_place(leaf, window):
    tree = bpe.Tree("byte_bpe_multi_50k.tiktoken", leaf, window)
    encoding = pieces.rank_encoding("byte_bpe_multi_50k.tiktoken")
    texts = [r[1][:400] for r in DOCS if r[1]] + ["it's we're I'll x'd", "'re 's", "12ab 3.14é", "a\n\n\n b", "   x  y"]
    for text in texts:
        expected = np.array(encoding.encode_ordinary(text), "<u4").tobytes()
        assert tree.encode(text) == expected, text
        assert tree.decode(np.frombuffer(expected, "<u4")) == text.encode()


def test_long_empty(docs):
    assert bpe.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_by_hand(spark, rule):
    text = prose(9, 60)
    sections = [(0, 0, 17), (1, 17, 18), (2, 18, 90), (3, 40, 300), (4, 200, 10**6), (5, 5, 5), (6, None, 4)]
    encoding = pieces.rank_encoding("byte_bpe_50k.tiktoken")
    spans, at, data = [], 0, text.encode()
    for i in encoding.encode_ordinary(text):
        size = len(encoding.decode_single_token_bytes(i))
        first = sum((b & 0xC0) != 0x80 for b in data[: at + 1]) - 1
        last = sum((b & 0xC0) != 0x80 for b in data[: at + size]) - 1
        spans.append((first, last))
        at += size
    expected = {}
    for k, a, b in sections:
        a, b = (0, 0) if a is None else (a, min(b, len(text)))
        n = 0
        for first, last in spans:
            inside = min(last + 1, b) - max(first, a)
            whole = last + 1 - first
            n += {
                "first": a <= first < b, "last": a <= last < b,
                "most": inside > 0 and (2 * inside > whole or (2 * inside == whole and first >= a)),
            }[rule]
        expected[k] = n
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")
    given = spark.createDataFrame([(d, *s) for d in (1, 2) for s in sections], "doc_id bigint, section int, start int, end int")
    got = {(r.doc_id, r.section): r.n_tokens for r in token_counts.count_tokens(docs, given, rule).collect()}
    assert got == {(1, k): n for k, n in expected.items()} | {(2, k): 0 for k in expected}


def test_documents_without_sections_stay(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e"), (3, None), (None, "x")], "doc_id bigint, text string")
    given = spark.createDataFrame([(1, 0, 0, 3), (9, 0, 0, 3)], "doc_id bigint, section int, start int, end int")
    rows = {r.doc_id: tuple(r)[1:] for r in token_counts.count_tokens(docs, given).collect()}
    assert rows == {1: (0, 0, 3, 2, 0, 3), 2: (None, None, None, 0, 0, 2), 3: (None, None, None, 0, 0, 0), None: (None, None, None, 0, 0, 1)}


def plain_sentences(text):
    """Ranges that end with a newline, or with a space after a full stop, question or exclamation mark."""
    out, low = [], 0
    for i, c in enumerate(text):
        if c == "\n" or (c == " " and i and text[i - 1] in ".!?") or i == len(text) - 1:
            out.append((low, i + 1))
            low = i + 1
    return out


def test_sentences_by_brute_force(docs):
    """The query's own sections: places, tokens by the rule ``most``, and tokens over a border."""
    encoding = pieces.rank_encoding("byte_bpe_50k.tiktoken")
    expected = []
    for doc_id, text, *_ in DOCS:
        spans, at, data = [], 0, (text or "").encode()
        lead = [0, *itertools.accumulate(int((b & 0xC0) != 0x80) for b in data)]
        for i in encoding.encode_ordinary(text or ""):
            size = len(encoding.decode_single_token_bytes(i))
            spans.append((lead[at + 1] - 1, lead[at + size]))
            at += size
        for k, (a, b) in enumerate(plain_sentences(text or "")):
            near = [(x, y) for x, y in spans if x < b and y > a]
            crossing = sum(x < a or y > b for x, y in near)
            inside = [2 * (min(y, b) - max(x, a)) - (y - x) for x, y in near]
            n = sum(m > 0 or (m == 0 and x >= a) for m, (x, _) in zip(inside, near))
            expected.append((doc_id, k, a, b, n, crossing, len(spans)))
    rows = [tuple(r) for r in token_counts.count_tokens(docs, rule="most").collect()]
    assert sorted(rows, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sentences_hold_every_token_once(docs, rule):
    encoding = pieces.rank_encoding("byte_bpe_50k.tiktoken")
    rows = token_counts.count_tokens(docs, rule=rule).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(encoding.encode_ordinary(r[1] or "")) for r in DOCS)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_digest_of_pipeline_stage(docs):
    from spanlake.llm.queries import bpe_digests

    row = bpe_digests(bpe.encode(docs.where("text = 'two words'"))).first()
    ids = pieces.rank_encoding("byte_bpe_multi_50k.tiktoken").encode_ordinary("two words")
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"two words").hexdigest()


def test_column_of_texts_looks_up_each_stretch_once():
    """Bytes of a column are those of its texts one by one; new stretches go to the library in one call."""
    import pyarrow as pa

    memory = token_ids.library_memory("byte_bpe_50k.json")
    texts = [
        "", " ", "a", " a", "a  b", "a b ", "one two, two. one's two\nthree", "x\u00a0y \u2009z", "né né. né'll né9 né\u0301s",
        "caf\u00e9\nTe. \u0394\u03b5 \u00b2a a\u00b2 a\u03b5, <|endoftext|> b", prose(3, 200), prose(4, 200),
    ]
    fresh = pieces.Memory(memory.encode)
    column = pa.array(["skipped", *texts, "skipped"]).slice(1, len(texts))
    expected = [np.array(ids, "<u4").tobytes() for ids in library_ids(texts)]
    assert fresh.column(column) == expected and fresh.column(column) == expected
    calls = []
    counting = pieces.Memory(lambda new: calls.append(list(new)) or memory.encode(new))
    counting.column(pa.array(["p q q r", "p q s"] * 50))
    assert sorted(calls[0]) == [" q", " r", " s"] and len(calls) == 2


def test_words_are_remembered_whatever_follows_them():
    """A word that an earlier column had goes to the library's model no more, with another sign behind it."""
    import pyarrow as pa

    memory = token_ids.library_memory("byte_bpe_50k.json")
    calls = []
    counting = token_ids.WordMemory(memory.encode, lambda new: calls.append(sorted(new)) or memory.words.encode(new), memory.ends_of)
    columns = [["p one, two. né!", "q (x) 7 9"], ["r two one? né\n one, ªz", "s", "", "t  two "], ["u"]]
    for texts in columns:
        expected = [np.array(ids, "<u4").tobytes() for ids in library_ids(texts)]
        assert counting.column(pa.array(texts)) == expected
    assert calls == [[" né", " one", " two"]]


def test_a_task_needs_one_python_worker(spark, docs):
    """Executors keep the workers that their tasks took at once, so no step stands on another without an exchange."""
    encoded = bpe.encode(docs, long=50)
    plan = encoded._jdf.queryExecution().executedPlan().toString().splitlines()
    above = []  # for each open node its depth, and whether Python runs in the task above it
    for line in plan:
        node = line.lstrip(" :+-")
        depth, name = len(line) - len(node), node.split()[0]
        while above and above[-1][0] >= depth:
            above.pop()
        python, inside = name.endswith(("InArrow", "EvalPython")), bool(above) and above[-1][1]
        assert not (python and inside), "\n".join(plan)
        above.append((depth, "Exchange" not in name and (python or inside)))
    assert any("InArrow" in x for x in plan)
