from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import scoring
from tests import sequential

ALPHABETS = {
    "iob": ["O", "O", "O", "B-a", "I-a", "B-b", "I-b"],
    "with_end": ["O", "B-a", "I-a", "E-a", "I-b", "E-b"],
    "brackets": ["O", "[-a", "]-a", "I-a", "B-b", "[", "]"],
    "dots": ["O", ".", ".-a", "B-a", "I-a", "I-b"],
    "untyped": ["O", "B", "I", "E", "[", "]"],
    "single": ["O", "S-a", "S-b", "B-a", "I-a", "X-0", "B-0"],
}
SCHEMA = "doc_id bigint, sent_id bigint, tok_id bigint, gold string, guess string"


def random_sentences(tags, n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        gold = [rng.choice(tags) for _ in range(rng.randint(1, 14))]
        out.append([(g, g if rng.random() < 0.7 else rng.choice(tags)) for g in gold])
    return out


def pairs_of(spark, sentences):
    rows = [
        (i // 7, i, j + 1, gold, guess)
        for i, s in enumerate(sentences)
        for j, (gold, guess) in enumerate(s)
    ]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def table(df):
    return {r["type"]: (r["gold"], r["guessed"], r["correct"]) for r in df.collect()}


@pytest.mark.parametrize("block", [2, 3, 5, 1 << 16])
@pytest.mark.parametrize("name", ALPHABETS)
def test_counts_equal_the_sequential_scorer(spark, name, block):
    sentences = random_sentences(ALPHABETS[name], 1500, name)
    got = table(scoring.score(pairs_of(spark, sentences), block=block))
    assert got == sequential.count(sentences)


@pytest.mark.parametrize("block", [2, 4, 1 << 16])
def test_match_state_hits(spark, block):
    sentences = random_sentences(ALPHABETS["iob"] + ALPHABETS["brackets"], 1000, 5)
    df = pairs_of(spark, sentences)
    hits = scoring.match_state(df, block=block).where("hit").count()
    assert hits == sequential.count(sentences)["(overall)"][2]


@pytest.mark.parametrize("block", [2, 5, 1 << 16])
@pytest.mark.parametrize("name", ["iob", "with_end", "brackets", "dots", "single"])
def test_spans(spark, name, block):
    sentences = random_sentences(ALPHABETS[name], 800, name)
    df = pairs_of(spark, sentences).withColumn("iob", F.col("gold"))
    got = {}
    for r in scoring.chunk_spans(df, block=block).collect():
        got.setdefault(r.sent_id, []).append((r.start, r.end, r.type))
    want = {i: sequential.spans([g for g, _ in s]) for i, s in enumerate(sentences)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("block", [2, 3, 1 << 16])
def test_flags(spark, block):
    sentences = random_sentences(ALPHABETS["with_end"] + ALPHABETS["brackets"], 500, 3)
    rows = scoring.chunk_flags(pairs_of(spark, sentences), block=block).collect()
    assert len(rows) == sum(map(len, sentences))
    for r in rows:
        s = sentences[r.sent_id]
        gold, guess = s[r.tok_id - 1]
        last = s[r.tok_id - 2] if r.tok_id > 1 else ("O", "O")
        assert (r.gold_start, r.gold_end) == (sequential.starts(last[0], gold), sequential.ends(last[0], gold))
        assert (r.guess_start, r.guess_end) == (sequential.starts(last[1], guess), sequential.ends(last[1], guess))


def test_one_huge_sentence_is_split_up(spark):
    """A sentence of many blocks scores like one of a single block."""
    rng = random.Random(9)
    tags = ALPHABETS["iob"]
    sentence = [(rng.choice(tags), rng.choice(tags)) for _ in range(3000)]
    long_chunk = [("B-a", "B-a")] + [("I-a", "I-a")] * 500
    sentences = [sentence + long_chunk + sentence, [("B-a", "B-a")]]
    got = table(scoring.score(pairs_of(spark, sentences), block=16))
    assert got == sequential.count(sentences)


def test_report_separately_by_run(spark):
    one, two = (random_sentences(ALPHABETS["iob"], 50, i) for i in (1, 2))
    both = pairs_of(spark, one).withColumn("run", F.lit("one")).unionByName(
        pairs_of(spark, two).withColumn("run", F.lit("two"))
    )
    rows = scoring.score(both, by=["run"])
    assert table(rows.where("run = 'one'")) == sequential.count(one)
    assert table(rows.where("run = 'two'")) == sequential.count(two)


def test_zero_denominators(spark):
    rows = scoring.score(pairs_of(spark, [[("O", "O"), ("B-a", "O"), ("O", "B-b")]]))
    got = {r["type"]: (r.precision, r.recall, r.f1) for r in rows.collect()}
    assert got == {"(overall)": (0, 0, 0), "a": (0, 0, 0), "b": (0, 0, 0)}


def test_nothing_to_score(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert table(scoring.score(empty)) == {}
    assert scoring.token_accuracy(empty).collect()[0].accuracy == 0
    lines = scoring.report_lines(scoring.score(empty), scoring.token_accuracy(empty)).collect()
    assert [r.line for r in lines] == ["processed 0 tokens with 0 phrases; found: 0 phrases; correct: 0."]


def test_a_corpus_without_chunks_keeps_its_row(spark):
    df = pairs_of(spark, [[("O", "O")] * 3, [("O", "O")]])
    assert table(scoring.score(df)) == {"(overall)": (0, 0, 0)}


def test_raw_tags(spark):
    df = pairs_of(spark, [[("NP", "NP"), ("NONE", "VP"), ("O", "NONE"), ("NP", "NP")]])
    raw = scoring.raw_tags(df, outside="NONE")
    tags = {r.tok_id: (r.gold, r.guess) for r in raw.collect()}
    assert tags == {1: ("B-NP", "B-NP"), 2: ("O", "B-VP"), 3: ("O", "O"), 4: ("B-NP", "B-NP")}
    assert table(scoring.score(raw))["NP"] == (2, 2, 2)


def test_split_tags(spark):
    df = pairs_of(spark, [[("B-a-b", "O"), ("I-0", ".")]])
    got = [(r.gold_prefix, r.gold_type, r.guess_prefix, r.guess_type) for r in scoring.split_tags(df).orderBy("tok_id").collect()]
    assert got == [("B", "a-b", "O", ""), ("I", "", ".", "")]


def test_align_reports_what_does_not_match(spark):
    gold = spark.createDataFrame([(1, 0, 1, "O"), (1, 0, 2, "B-a")], "doc_id bigint, sent_id bigint, tok_id bigint, iob string")
    pred = spark.createDataFrame([(1, 0, 2, "O"), (1, 0, 3, "B-a")], gold.schema)
    got = {r.tok_id: (r.gold, r.guess, r.status) for r in scoring.align(gold, pred).collect()}
    assert got == {1: ("O", None, "gold_only"), 2: ("B-a", "O", "matched"), 3: (None, "B-a", "guess_only")}


def test_whole_sentences(spark):
    rows = [(1, 0, 1, "O"), (1, 0, 2, "B-a"), (1, 1, 1, "B-a"), (1, 1, 2, "I-a"), (None, 0, 1, "O")]
    gold = spark.createDataFrame(rows, "doc_id bigint, sent_id bigint, tok_id bigint, iob string")
    whole, others = scoring.whole_sentences(scoring.align(gold, gold.where("NOT (sent_id = 0 AND tok_id = 2)")))
    assert sorted((r.sent_id, r.tok_id, r.gold, r.guess) for r in whole.collect()) == [(1, 1, "B-a", "B-a"), (1, 2, "I-a", "I-a")]
    assert others.count() == 4 and whole.columns == ["doc_id", "sent_id", "tok_id", "gold", "guess"]
    assert table(scoring.score(whole))["a"] == (1, 1, 1)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_text_report(spark):
    sentences = [[("B-a", "B-a"), ("I-a", "I-a"), ("O", "B-b")], [("B-b", "B-b"), ("O", "O")]]
    df = pairs_of(spark, sentences)
    lines = [r.line for r in scoring.report_lines(scoring.score(df), scoring.token_accuracy(df)).collect()]
    assert lines == [
        "processed 5 tokens with 2 phrases; found: 3 phrases; correct: 2.",
        "accuracy:  80.00%; precision:  66.67%; recall: 100.00%; FB1:  80.00",
        "                a: precision: 100.00%; recall: 100.00%; FB1: 100.00  1",
        "                b: precision:  50.00%; recall: 100.00%; FB1:  66.67  2",
    ]


def test_latex_report(spark):
    df = pairs_of(spark, [[("B-a", "B-a"), ("O", "B-long_type")]])
    lines = [r.line for r in scoring.report_lines(scoring.score(df), style="latex").collect()]
    assert lines == [
        r"        & Precision &  Recall  & F$_{\beta=1} \\\hline",
        r"a       &  100.00\% & 100.00\% & 100.00 \\",
        r"long_type &    0.00\% &   0.00\% &   0.00 \\\hline",
        r"Overall &   50.00\% & 100.00\% &  66.67 \\\hline",
    ]


def test_unknown_report_style(spark):
    with pytest.raises(ValueError):
        scoring.report_lines(spark.range(1), style="html")


def test_same_result_for_any_partitioning(spark):
    sentences = random_sentences(ALPHABETS["iob"], 300, 11)
    df = pairs_of(spark, sentences)
    want = sequential.count(sentences)
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert table(scoring.score(df.repartition(n))) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_whole_sentences_read_one_exchange(spark):
    """The rows that match and the sentences left out come from the same join, tags and all."""
    gold = spark.createDataFrame([(1, 0, 1, "O"), (1, 0, 2, "B-a")], "doc_id bigint, sent_id bigint, tok_id bigint, iob string")
    whole, _ = scoring.whole_sentences(scoring.align(gold, gold.where("tok_id < 9")))
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join FullOuter") == 2 and "Join Inner" not in plan


def test_aligned_rows_are_as_those_of_a_join(spark):
    """Repeated rows meet each other, null keys meet nothing, far and negative positions stay apart."""
    rng = random.Random(4)

    def some():
        key = lambda: rng.choice([None, 1, 1, 1, 2])
        tok = lambda: rng.choice([None, -33, -1, 0, 1, 2, 2, 31, 32, 33, 64, 1 << 40])
        return [(key(), key(), tok(), rng.choice([None, "O", "B-a"])) for _ in range(150)]

    schema = "doc_id bigint, sent_id bigint, tok_id bigint, iob string"
    gold, pred = some(), some()
    want = [(*g[:3], g[3], p[3], "matched") for g in gold for p in pred if None not in g[:3] and g[:3] == p[:3]]
    want += [(*g[:3], g[3], None, "gold_only") for g in gold if None in g[:3] or g[:3] not in {p[:3] for p in pred}]
    want += [(*p[:3], None, p[3], "guess_only") for p in pred if None in p[:3] or p[:3] not in {g[:3] for g in gold}]
    aligned = scoring.align(spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema))
    assert sorted(map(tuple, aligned.collect()), key=repr) == sorted(want, key=repr)
    whole, others = scoring.whole_sentences(aligned)
    bad = {r[:2] for r in want if r[-1] != "matched"}
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted((r[:-1] for r in want if r[:2] not in bad), key=repr)
    assert others.count() == sum(r[:2] in bad for r in want)


def test_rows_beside_unmatched_ones_are_not_exchanged(spark):
    """Of incomplete sentences only the keys meet the rows of the others."""
    gold = spark.range(20000).selectExpr("id div 40 as doc_id", "0L as sent_id", "id % 40 + 1 as tok_id", "'B-a' as iob")
    whole, _ = scoring.whole_sentences(scoring.align(gold, gold.where("NOT (doc_id % 10 > 0 AND tok_id % 8 = 3)")))
    assert whole.count() == 50 * 40
    aligned = scoring.align(gold, gold.where("tok_id % 8 <> 3")).coalesce(1)
    code = F.shiftleft(F.xxhash64("doc_id", "sent_id"), 1).bitwiseOR((F.col("status") != "matched").cast("bigint"))
    beside = F.arrow_udf(scoring._beside_unmatched, "boolean")
    assert aligned.select(beside(code).alias("x")).where("x").count() > 15000


def test_parts_of_aligned_rows(spark, tmp_path, monkeypatch):
    """By the size of what is read, within bounds; where it is not known, as many as shuffles have."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.range(1000).selectExpr("id as doc_id", "0L as sent_id", "1L as tok_id", "'O' as iob").write.parquet(str(tmp_path / "t"))
    gold = spark.read.parquet(str(tmp_path / "t"))
    assert scoring._parts(gold) == least
    monkeypatch.setattr(scoring, "PART", 64)
    assert scoring._parts(gold) == 8 * least
    assert scoring.align(gold, gold).where("status = 'matched'").count() == 1000
    monkeypatch.setattr(scoring, "UNKNOWN", 1)
    assert scoring._parts(gold) == least
