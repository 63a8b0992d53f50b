"""Substring removal against all windows of all documents."""

from __future__ import annotations

import random

import pytest
from samples import SCHEMA, WORD, documents, prose

from checks.compare import database, difference
from spanlake.llm import substrings
from spanlake.llm.oracles import ORACLES
from spanlake.llm.queries import QUERIES


def brute(rows, length=50):
    rank = lambda d: substrings.NO_ID if d is None else d
    texts = [(d, WORD.findall(t or "")) for d, t in rows]
    least = {}
    for d, ws in texts:
        for i in range(len(ws) - length + 1):
            key = tuple(ws[i : i + length])
            least[key] = min(least.get(key, rank(d)), rank(d))
    out = []
    for d, ws in texts:
        gone = set()
        for i in range(len(ws) - length + 1):
            if least[tuple(ws[i : i + length])] < rank(d):
                gone.update(range(i, i + length))
        edges = [(i, i in gone) for i in range(len(ws) + 1)]
        spans = [i for i, g in edges if g != (i - 1 in gone)]
        out.append((d, len(ws), len(gone), list(zip(spans[::2], spans[1::2])), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=repr)


def removed(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = substrings.remove_substrings(df, **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, [(s.start, s.end) for s in r.spans], r.kept) for r in got), key=repr)


@pytest.mark.parametrize("length,hot", [(50, substrings.HOT), (50, 1), (12, 2), (3, substrings.HOT), (1, substrings.HOT)])
def test_removal_of_samples(spark, length, hot):
    rows = [r[:2] for r in documents()]
    assert removed(spark, rows, length=length, hot=hot) == brute(rows, length)


def test_passages_at_the_threshold(spark):
    """49 to 52 shared words at every edge; ids fall and rise; a chain over three texts."""
    rng = random.Random(3)
    word = lambda of: "".join(rng.choices(of, k=6))
    noise = lambda n, of: [word(of) for _ in range(n)]
    rows = []
    for size in (49, 50, 51, 52):
        part = noise(size, "abcdef")
        rows += [
            (100 - len(rows), " ".join(noise(9, "KL") + part + noise(30, "MN"))), (200 + len(rows), " ".join(part + noise(7, "OP"))),
            (300 + len(rows), " ".join(noise(40, "QR") + part)), (400 - len(rows), " ".join(noise(90, "ST") + part + part[::-1] + part)),
        ]
    long = noise(300, "abcdef")
    rows += [(1, " ".join(long[:180])), (2, " ".join(long[100:])), (3, " ".join(long[60:260])), (4, " ".join(long[::-1]))]
    expected = brute(rows)
    assert removed(spark, rows) == expected and sum(r[2] for r in expected) > 600


@pytest.mark.parametrize("hot", [substrings.HOT, 7])
def test_matches_that_the_reference_lacks(spark, hot):
    """Copies of one passage that go on in a few ways: most windows at its ends are not in the smallest id."""
    rng = random.Random(9)
    core = prose(50, 60).split()
    tails = [prose(60 + k, 45).split() for k in range(5)]
    heads = [prose(70 + k, 45).split() for k in range(4)]
    rows = [(0, " ".join(core))]
    for i in range(1, 60):
        head, tail = rng.choice(heads)[rng.randint(0, 40):], rng.choice(tails)[: rng.randint(0, 45)]
        rows.append((rng.randint(0, 40), " ".join(head + core + tail)))
    assert removed(spark, rows, hot=hot) == brute(rows)


def test_runs_of_one_word(spark):
    rows = [(1, "a " * 900), (2, "b " * 60 + "a " * 70), (3, "a " * 49), (3, "a " * 50 + "c"), (0, "b " * 55)]
    assert removed(spark, rows) == brute(rows)


def test_one_passage_in_many_documents(spark):
    """No rows of a group's square: each anchor of the passage is sent a bounded number of times."""
    passage = prose(80, 120)
    rows = [(i, f"{prose(1000 + i, 20)} {passage} {prose(5000 + i, 20)}") for i in range(400)]
    got = removed(spark, rows, hot=50)
    assert got == brute(rows) and sum(r[2] for r in got) >= 399 * 120


def test_empty_table_and_clashing_columns(spark):
    assert removed(spark, []) == []
    df = spark.createDataFrame(documents(), SCHEMA).selectExpr("*", "1 AS one", "2 AS id", "3 AS marks", "4 AS seed", "5 AS more")
    assert substrings.remove_substrings(df).count() == len(documents())


def test_query_and_sql(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None]  # pandas has no null among integers
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/d")
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    got = QUERIES["op13_substrings"](spark, str(tmp_path)).toPandas()
    assert difference(got, database(str(tmp_path)).execute(ORACLES["op13_substrings"]).df()) is None
