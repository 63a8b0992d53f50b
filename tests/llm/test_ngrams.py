"""Scores of whole n-gram models against the definition."""

from __future__ import annotations

import math
from collections import Counter

import pytest
from samples import FOLD, SCHEMA, WORD, documents

from spanlake.llm import ngram_scores

DOCS = documents()


def brute_scores(rows, order):
    """The definition, word by word: counts of all other documents, 0.4 for each step back."""
    texts = [WORD.findall((r[1] or "").translate(FOLD)) for r in rows]

    def counts(texts):
        return Counter(tuple(t[i : i + n]) for t in texts for n in range(1, order + 1) for i in range(len(t) - n + 1))

    every = counts(texts)
    out = []
    for row, t in zip(rows, texts):
        own, others = counts([t]), max(1, sum(map(len, texts)) - len(t))
        left = lambda gram: every[gram] - own[gram]

        def s(gram):
            if not gram:
                return 1 / others
            if left(gram):
                return left(gram) / (left(gram[:-1]) if gram[:-1] else others)
            return 0.4 * s(gram[1:])

        out.append((str(row[0]), len(t), round(sum(math.log(s(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(len(t))), 5) + 0.0))
    return sorted(out)


def found(df, *more):
    got = ngram_scores.score(df, *more).collect()
    assert all((r.mean_log_score is None) == (r.n_words == 0) for r in got)
    return sorted((str(r.doc_id), r.n_words, round(r.log_score, 5) + 0.0) for r in got)


@pytest.mark.parametrize("order,buckets,block", [(ngram_scores.ORDER, 256, 1 << 24), (2, 3, 500), (3, 5, 1), (4, 1, 2000), (1, 4, 500)])
def test_scores_by_the_definition(spark, monkeypatch, order, buckets, block):
    monkeypatch.setattr(ngram_scores, "BLOCK", block)
    df = spark.createDataFrame(DOCS, SCHEMA).repartition(3)
    assert found(df, order, buckets) == brute_scores(DOCS, order)
    assert ngram_scores.score(df.limit(0)).count() == 0


def test_many_rare_words(spark):
    """A million words that no other document has, beside one frequent word."""
    junk = [(i, " ".join(f"{i}x{j}" for j in range(220_000))) for i in range(5)]
    rows = [*junk, (5, "7x7 8x8"), (6, "the " * 50), (7, "the the 7x8")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    total = 1_100_000 + 2 + 50 + 3
    got = {r.doc_id: r for r in ngram_scores.score(df).collect()}
    step, others = math.log(0.4), math.log(total - 220_000)
    assert [round(got[i].log_score / (220_000 * (3 * step - others) - 3 * step), 9) for i in range(5)] == [1.0] * 5
    assert got[5].log_score == pytest.approx(3 * step - 2 * math.log(total - 2))


def test_unknown_junk_scores_below_common_text(spark):
    common = [(i, "the cat sat on the mat and the dog lay by the door") for i in range(20)]
    rows = [*common, (50, "the cat the cat the cat the dog"), (51, "qxv zzkw pfft grbl nnqo wvut"), (52, "mat the on sat cat the")]
    got = {r.doc_id: r.mean_log_score for r in ngram_scores.score(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[0] > got[50] > got[52] > got[51]


def test_one_document_and_clashing_columns(spark):
    one = spark.createDataFrame([(1, "a b a")], "doc_id bigint, text string").selectExpr("*", "1 AS block", "2 AS part", "3 AS total")
    assert found(one) == brute_scores([(1, "a b a")], 3)


def test_memory_of_a_block():
    """Counts elsewhere take less than 48 bytes a word beside what they are given."""
    import tracemalloc

    import numpy as np

    n = 1 << 20
    key = np.random.default_rng(1).integers(0, n, n).astype(np.uint64)
    row = np.repeat(np.arange(n // 64, dtype=np.int32), 64)
    counts = np.unique(key, return_counts=True)[1]
    tracemalloc.start()
    got = ngram_scores.elsewhere(key, row, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 * n and got.min() >= 0
