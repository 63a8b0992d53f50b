"""Derived inputs: their rows, and that they are made without exchanging tokens."""

from __future__ import annotations

import io
import re

from pyspark.sql import Row, functions as F

from checks import fixtures as X, queries as Q
from spanlake.operators import scoring
from spanlake.sources import pairs

DOCUMENTS = [
    (1, "a b c d e f g h i j k l\n\n  m <n> & o  p\nq"), (2, "u v w x y z " * 9), (-5, "neg ative id"), (None, "no id\nat all"),
    (2, "u twice\nand more of it"), (2, None), (3, None), (4, " \n "), (1000003, "ein zwei drei vier fünf\n" * 3),
]


def folder_of(spark, path):
    rows = [(*r, "s") for r in DOCUMENTS]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_annotated_documents(spark, tmp_path):
    sf = folder_of(spark, tmp_path)
    made = X.annotated(spark, sf)
    got = {r.doc_id: r.text for r in made.collect()}
    # Without tags the tokens of all rows of an id are there, in the order of line and place.
    words = {}
    for r in X.words(spark, sf).collect():
        body = r.token.replace("&", "&amp;").replace("<", "&lt;")
        words.setdefault(r.doc_id, []).append((r.sent_id, r.tok_id, body))
    assert sorted(got, key=repr) == sorted(words, key=repr)
    for doc, tokens in words.items():
        plain = [x for line in got[doc].split("\n") for x in re.sub("<[^>]*>", "", line).split(" ")]
        assert sorted(plain) == sorted(x[2] for x in tokens)
        assert doc is not None or "<" not in got[doc]
    # The chunks of document 1 as its gold tags have them.
    gold = {(r.sent_id, r.tok_id): r.gold for r in X.pairs(spark, sf).where("doc_id = 1").collect()}
    opened = sum(t != "O" and (t[0] == "B" or gold.get((s, k - 1), "O")[2:] != t[2:]) for (s, k), t in gold.items())
    outer = re.sub("</?name.last>", "", got[1])
    assert outer.count("</") == opened == len(re.findall("<[a-z]", outer))
    # Only the texts are exchanged: tokens are not rows.
    assert "Generate" not in plan_of(made)


def exchanges(df):
    return [line for line in plan_of(df).splitlines() if "Exchange" in line and "Reused" not in line]


def test_tokens_stay_with_their_document(spark, tmp_path):
    """Scores, taggers and pair lines group by sentence without exchanging tokens."""
    sf = folder_of(spark, tmp_path)
    for name in ("annotate_hook", "chunk_flags", "plain_sentences"):
        assert not [x for x in exchanges(Q.QUERIES[name](spark, sf)) if "sent_id" in x], name
    lines = Q._pair_lines(spark, sf)
    assert len(exchanges(lines)) == 1 and "sent_id" not in exchanges(lines)[0]
    assert not [x for x in exchanges(scoring.match_state(X.pairs(spark, sf))) if "tok_id" in x]


def test_lines_of_pairs(spark):
    """Each sentence's last token is followed by a blank line, in whichever order the rows come."""
    rows = [(1, 0, 2, "b"), (1, 0, 1, "a"), (1, 1, 1, None), (None, 3, 1, "n"), (None, 3, 2, "m"), (2, None, 5, "x")]
    made = spark.createDataFrame([(*r, "O", "B-y") for r in rows], "doc_id bigint, sent_id bigint, tok_id bigint, token string, gold string, guess string")
    got = sorted([tuple(r) for r in pairs.format_pairs(made.repartition(3)).collect()], key=repr)
    expected = [(d, s, k, f"{t or '_'} O B-y") for d, s, k, t in rows] + [(1, 0, 3, ""), (1, 1, 2, ""), (None, 3, 3, ""), (2, None, 6, "")]
    assert got == sorted(expected, key=repr)
    assert "Union" not in plan_of(pairs.format_pairs(made))


def test_sentences_of_stretches(spark):
    """Sentences cut anywhere, with nulls, are those of plain grouping; neighbours are joined before it."""
    rows = [(f"f{k % 3}", s, t, None if (k + s + t) % 5 == 0 else f"w{t}", None if s == 2 else "p") for k in range(3) for s in range(4) for t in range(1, 9)]
    made = spark.createDataFrame(rows[::-1] + [(None, None, 1, "x", "y")], "file string, sent_id bigint, tok_id bigint, token string, pos string").repartition(5)
    made = made.unionByName(spark.createDataFrame([("g", 0, t, f"t{t}", None) for t in range(1, 50)], made.schema).coalesce(1))
    got = Q._by_sentence(made, ("file", "sent_id"), {"token": " ", "pos": ""})
    items = F.array_sort(F.collect_list(F.struct("tok_id", "token", "pos")))
    plain = made.groupBy("file", "sent_id").agg(items.alias("i"), F.count("*").alias("n"), F.max("tok_id").alias("last")).select(
        "file", "sent_id", F.array_join("i.token", " ").alias("token"), F.array_join("i.pos", "").alias("pos"), "n", "last")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    one = made.where("file = 'g'").coalesce(1)
    assert Q._stretches(one, ("file", "sent_id"), {"token": " "}).count() <= 4 < one.count()


def test_skipped_files_are_written_once_a_task(monkeypatch):
    opened = []

    class Files:
        def create_dir(self, path, recursive):
            pass

        def open_output_stream(self, path):
            opened.append(path)
            return io.BytesIO()

    class Documents:
        def select(self, *names):
            return self

        def foreachPartition(self, write):
            write([Row(doc_id=i, text="x") for i in range(30)])

    import pyarrow.fs

    monkeypatch.setattr(pyarrow.fs, "FileSystem", type("Stub", (), {"from_uri": staticmethod(lambda uri: (Files(), uri))}))
    X.write_documents(Documents(), "folder")
    assert sum(x.endswith(".norm.ne") for x in opened) == 30
    assert sum(x.endswith(".log") for x in opened) == 7
