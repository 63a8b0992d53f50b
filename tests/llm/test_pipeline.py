"""The pipeline stage by stage against plain versions, and the queries against their SQL."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest
from samples import SCHEMA, documents, prose
from test_dups import brute_components
from test_texts import ITEMS, brute_hits, metrics

import corpus_pipeline
from checks.compare import database, difference
from spanlake.llm import pieces, quality
from spanlake.llm.oracles import ORACLES
from spanlake.llm.queries import QUERIES
from spanlake.sources.workspace import new_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sf_dir(spark):
    folder = new_folder(spark, "tables")
    secret = prose(40, 300) + " password: hunter22 é " + "ab12" * 10
    rows = documents() + [(500, secret, "en", "s", 9), (501, prose(41, 90), "en", "s", None)]
    rows += [(600 + i, prose(600 + i, 60), "en", "s", 5) for i in range(20)]
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    noise = " ".join(f"{chr(66 + i % 24)}{i}#{chr(98 + i * 7 % 24)}x" for i in range(90))  # takes the limit's place
    rows.append((502, noise, "en", "s", 3))
    labels = [(r[0], 1, 0) for r in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check_groups(before, after):
    """Exactly one row of each group of near copies, with the smallest id; rows without words all stay."""
    group = {i: c for i, _, c in brute_components([(i, r[1]) for i, r in enumerate(before)])}
    left = list(after)
    for c in set(group.values()):
        rows = [r for i, r in enumerate(before) if group[i] == c]
        stay = [r for r in rows if r in left]
        least = min((r[0] for r in rows if r[0] is not None), default=None)
        found = next(r for r in stay if r[0] == least)
        left.remove(found)
    assert left == []


def test_repeated_rows_and_ids_in_near_dedup(spark):
    base = prose(77, 80)
    near = base.replace(base.split()[40], "changed")
    rows = [(1, base), (1, base), (2, base), (1, near), (3, prose(78, 60)), (3, prose(79, 60)), (5, prose(80, 50)), (None, prose(80, 50)),
            (6, ""), (6, ""), (None, None), (7, prose(81, 40)), (7, prose(81, 40))]
    rows = [(*r, "en", "s", i) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = rows_of(corpus_pipeline.near_dedup(spark, docs, ""))
    check_groups(rows, got)
    assert len(got) == 8 and rows[11] in got and rows[12] not in got


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        before, docs = rows_of(docs), spark.read.parquet(folder)
        kept.append(docs.count())
        if name != "byte-level BPE":
            assert docs.columns == names
        if name == "quality rules":
            assert set(rows_of(docs)) <= {r for r in before if (m := metrics(r[1] or ""))[0] >= 20 and 10 * m[4] <= 3 * m[0]}
            labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
            judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
            inside = "score BETWEEN lower AND upper AND word_score BETWEEN word_lower AND word_upper AND NOT base_failed"
            assert rows_of(judged.where(inside).select(names)) == rows_of(docs)
        if name == "near-dedup":
            check_groups(before, rows_of(docs))
        if name == "decontamination":
            clean = lambda r: (h := brute_hits(r[1], ITEMS))[1] == 0 or 20 * h[1] < h[0]
            assert rows_of(docs) == [r for r in before if clean(r)]
        if name == "secret scans":
            assert [r[0] for r in rows_of(docs)] == [r[0] for r in before]
            text = {r[0]: r for r in rows_of(docs)}[500]
            assert text[1] == prose(40, 300) + " [SECRET] é [SECRET]" and text[4] == len(text[1])
            assert [r for r in rows_of(docs) if r[0] != 500] == [r for r in before if r[0] != 500]
        if name == "byte-level BPE":
            encoding = pieces.rank_encoding("byte_bpe_multi_50k.tiktoken")
            expected = []
            for r in before:
                ids = encoding.encode_ordinary(r[1])
                digest = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), r[1].encode())]
                expected.append((r[0], ids, len(ids), *digest))
            assert rows_of(docs) == sorted(expected, key=repr)
    assert kept[0] < len(documents()) + 23 and kept == sorted(kept, reverse=True)


def test_run_is_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(docs)


def test_stages_on_nothing_and_odd_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        more = docs.selectExpr("*", "1 AS kept", "2 AS spans", "3 AS n_words", "4 AS ids")
        assert stage(spark, more, sf_dir).count() > 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert difference(got, database(SF).execute(ORACLES[name]).df()) is None
    assert len(got)


