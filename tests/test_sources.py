from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import splits
from spanlake.sources import annotated, columns, lines, pairs
from spanlake.sources.workspace import new_folder


@pytest.fixture
def tiny_splits(spark):
    """Files cut into splits of a few dozen bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "40b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def column_sentences(data):
    """Sentences of a column file, by the format's rules."""
    out, sentence = [], []
    for line in data.replace("\r\n", "\n").split("\n"):
        fields = line.strip().split("\t")
        if fields == [""]:
            out.append(sentence)
            sentence = []
        elif len(fields) > 1:
            sentence.append(tuple(fields[1:4]))
    return [s for s in [*out, sentence] if s]


def read_back(rows, names):
    got = {}
    for r in rows.orderBy("file", "sent_id", "tok_id").collect():
        sentence = got.setdefault((r.file, r.sent_id), [])
        sentence.append(tuple(r[n] for n in names))
        assert r.tok_id == len(sentence)
    for file in {f for f, _ in got}:
        ids = [i for f, i in got if f == file]
        assert ids == list(range(len(ids)))
    return sorted(got.values())


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_read_columns(spark, tmp_path, tiny_splits, newline):
    rng = random.Random(3)
    kinds = ["1\ta\tX\tO", "2\tbb\tY\tB-x", "", "", "  ", "# FILE: q", "7\tc\tZ\tI-x\t\t"]
    want = []
    for i in range(6):
        lines = [rng.choice(kinds) for _ in range(rng.choice([0, 3, 60]))]
        lines += ["3\tlong\tX\tO"] * rng.choice([0, 40]) + ["", "4\tz\tX\tO"]
        data = newline.join(lines) + newline * rng.randint(0, 2)
        (tmp_path / f"corpus_{i}.tsv").write_text(data, newline="")
        want += column_sentences(data)
    rows = columns.read_columns(spark, str(tmp_path))
    assert read_back(rows, ("token", "pos", "iob")) == sorted(want)
    assert {r.data_set for r in rows.select("data_set").distinct().collect()} == {"corpus"}


def numbered_file(tmp_path):
    text = "".join(f"1\tw{i}\tN\tO\n" + "\n" * (i % 4 == 3) for i in range(4000))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tsv").write_text(text)
    return str(tmp_path / "in")


@pytest.fixture
def split_size(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def test_reading_is_lazy_and_splits_may_change(spark, tmp_path, split_size, monkeypatch):
    """Both scans of a plan are cut alike, whatever was set when the DataFrame was made."""
    folder = numbered_file(tmp_path)
    monkeypatch.setattr("spanlake.sources.workspace.new_folder", None)  # nothing is written
    for bound in (lines.BROADCAST_ROWS, 0):
        monkeypatch.setattr(lines, "BROADCAST_ROWS", bound)
        split_size("900")
        rows = columns.read_columns(spark, folder)
        assert ("strategy=broadcast" in rows._jdf.queryExecution().analyzed().toString()) == (bound > 0)
        split_size("70000")
        assert rows.select("sent_id").distinct().count() == 1000
        assert rows.where("tok_id NOT BETWEEN 1 AND 4").count() == 0


def test_stored_index_saves_a_scan(spark, tmp_path, split_size):
    folder, index = numbered_file(tmp_path), str(tmp_path / "index")
    split_size("900")
    columns.index_columns(spark, folder, index)
    assert spark.read.parquet(index).count() == len({r.start for r in lines.read_lines(spark, folder).collect()}) > 20
    rows = columns.read_columns(spark, folder, index=index)
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan text") == 1
    assert sorted(rows.collect()) == sorted(columns.read_columns(spark, folder).collect())
    split_size("700")
    with pytest.raises(Exception, match="the index does not know this part"):
        columns.read_columns(spark, folder, index=index).collect()


def test_split_bound(spark, tmp_path, tiny_splits):
    for i in range(5):
        (tmp_path / f"{i}.tsv").write_text("a\tb\n" * 40 * i)
    read = lines.read_lines(spark, str(tmp_path))
    assert read.select("file", "start").distinct().count() <= lines.split_bound(read) < 200


def test_missing_fields_do_not_move_others(spark, tmp_path):
    rows = [("a:b é", "x", 0, 1, "tok", None, "B-x"), ("a:b é", "x", 0, 2, None, "N", "O")]
    df = spark.createDataFrame(rows, "data_set string, doc_id string, sent_id bigint, tok_id bigint, token string, pos string, iob string")
    columns.write_columns(df, str(tmp_path / "out"))
    back = columns.read_columns(spark, str(tmp_path / "out")).orderBy("tok_id").collect()
    assert [(r.token, r.pos, r.iob) for r in back] == [("tok", "", "B-x"), ("", "N", "O")]
    assert {r.data_set for r in back} == {"a:b é"}


def test_read_columns_by_other_positions(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("tok\tB-x\tNN\n")
    row = columns.read_columns(spark, str(tmp_path), cols=(0, 2, 1)).collect()[0]
    assert (row.token, row.pos, row.iob) == ("tok", "NN", "B-x")


def test_write_then_read_columns(spark, tmp_path):
    rng = random.Random(5)
    rows = [
        (f"set{d % 3}", d, s, t + 1, rng.choice("abc"), "X", rng.choice(["O", "B-x"]))
        for d in range(20)
        for s in range(rng.randint(1, 5))
        for t in range(rng.randint(1, 9))
    ]
    df = spark.createDataFrame(rows, "data_set string, doc_id bigint, sent_id bigint, tok_id bigint, token string, pos string, iob string")
    folder = str(tmp_path / "out")
    columns.write_columns(df, folder)
    back = columns.read_columns(spark, folder)
    sentences = {}
    for r in rows:
        sentences.setdefault(r[:3], []).append(r[4:])
    assert read_back(back, ("token", "pos", "iob")) == sorted(sentences.values())
    assert {r.data_set for r in back.select("data_set").distinct().collect()} == {"set0", "set1", "set2"}
    headers = spark.read.text(folder).where(F.col("value").startswith("# FILE: "))
    assert headers.count() == 20


def test_format_columns(spark):
    rows = [("d", "f1", 0, 1, "a", "X", "O"), ("d", "f1", 1, 1, "b", "Y", "B-x"), ("d", "f2", 0, 1, "c", "Z", "O")]
    df = spark.createDataFrame(rows, "data_set string, doc_id string, sent_id bigint, tok_id bigint, token string, pos string, iob string")
    lines = columns.format_columns(df).orderBy("doc_id", "sent_id", "line_id").collect()
    assert "\n".join(r.line for r in lines) == (
        "# FILE: f1\n\n1\ta\tX\tO\n\n1\tb\tY\tB-x\n\n# FILE: f2\n\n1\tc\tZ\tO\n"
    )


@pytest.mark.parametrize("delimiter", [" ", "\t", "|", "::"])
def test_read_pairs(spark, tmp_path, tiny_splits, delimiter):
    rng = random.Random(7)
    want, lines, sentence = [], [], []
    for _ in range(300):
        kind = rng.random()
        if kind < 0.75 or not sentence:
            fields = [rng.choice("abc"), "pos", rng.choice(["O", "B-x"]), rng.choice(["O", "I-x"])]
            lines.append(delimiter.join(fields) + delimiter * rng.choice([0, 0, 2]))
            sentence.append((fields[0], fields[2], fields[3]))
        else:
            lines.append(rng.choice(["", delimiter, delimiter.join(["-X-", "-X-", "O", "O"])]))
            want.append(sentence)
            sentence = []
    (tmp_path / "run.txt").write_text("\r\n".join(lines) + "\r\n", newline="")
    rows = pairs.read_pairs(spark, str(tmp_path), delimiter)
    assert read_back(rows, ("token", "gold", "guess")) == sorted(want + ([sentence] if sentence else []))


def test_pairs_need_two_fields(spark, tmp_path):
    (tmp_path / "a.txt").write_text("O B-x\n")
    row = pairs.read_pairs(spark, str(tmp_path)).collect()[0]
    assert (row.token, row.gold, row.guess) == (None, "O", "B-x")
    (tmp_path / "a.txt").write_text("lonely\n")
    with pytest.raises(Exception, match="lonely"):
        pairs.read_pairs(spark, str(tmp_path)).collect()


def test_pairs_of_several_widths(spark, tmp_path, tiny_splits):
    """The first line that is not blank sets the width, over all splits of its file only."""
    (tmp_path / "a.txt").write_text("\n\n" + "a O O\n" * 30)
    (tmp_path / "b.txt").write_text("a x O O\n" * 30 + "-X- x O O\n  \n")
    assert pairs.read_pairs(spark, str(tmp_path)).count() == 60
    for odd in ("a x O O\n", "-X- O\n"):
        (tmp_path / "a.txt").write_text("\n\n" + "a O O\n" * 30 + odd + "a O O\n")
        with pytest.raises(Exception, match="unexpected number of fields: [24] .3. in .*a.txt"):
            pairs.read_pairs(spark, str(tmp_path)).collect()
        assert pairs.read_pairs(spark, str(tmp_path), strict=False).count() == 61 + (odd[0] == "a")
    index = str(tmp_path.parent / "widths")
    pairs.index_pairs(spark, str(tmp_path), index)
    with pytest.raises(Exception, match="unexpected number of fields"):
        pairs.read_pairs(spark, str(tmp_path), index=index).collect()
    assert pairs.read_pairs(spark, str(tmp_path), strict=False, index=index).count() == 61


def test_check_width(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a O O\n\nb O O  \nc x O O\n")
    got = {(r.width, r.lines, r.ok) for r in pairs.check_width(spark, str(tmp_path)).collect()}
    assert got == {(3, 2, True), (4, 1, False)}
    with pytest.raises(Exception, match="unexpected number of fields: 4"):
        pairs.check_width(spark, str(tmp_path), strict=True).collect()


def test_read_annotated(spark, tmp_path):
    folder = tmp_path / "data" / "press" / "trn"
    folder.mkdir(parents=True)
    (folder / "a.norm.ne").write_text("Un <name>X</name>\n\n<b>gras</b> image.png\n", encoding="utf-8")
    (folder / "b.txt").write_text("skipped")
    rows = annotated.read_annotated(spark, str(folder))
    assert [(r.corpus, r.doc_id) for r in rows.collect()] == [("press_trn", "a.norm.ne")]
    assert [r.text for r in annotated.prepare(rows).collect()] == ["Un <name>X</name>"]


def test_write_splits(spark, tmp_path):
    df = spark.range(500).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("sent_id"), F.concat(F.lit("s"), "id").alias("text")
    )
    rows = splits.shard(splits.split(df))
    folder = str(tmp_path / "plain")
    columns.write_splits(rows, folder)
    back = spark.read.text(folder)
    assert {(r.split, r.shard, r.value) for r in back.collect()} == {(r.split, r.shard, r.text) for r in rows.collect()}
    assert back.where("split = 'train'").select("shard").distinct().count() == 100


def test_scratch_folders_are_new_and_shared(spark):
    a, b = new_folder(spark, "x"), new_folder(spark, "x")
    assert a != b
    shared = spark.conf.get("spark.checkpoint.dir", None)
    assert shared is None or a.startswith(shared)


def test_documents_are_written_whole_and_unsampled(spark, tmp_path, monkeypatch):
    """Each document has its lines in one file, those of ``format_columns``; repeated and null rows too."""
    rows = [("a", d, s, t, f"w{t}", "X", "O") for d in range(12) for s in range(3) for t in range(1, 5)]
    rows += [r for r in rows if r[1] == 3] + [("a", None, 0, 1, "n", None, "O"), (None, 20, 0, 1, "z", "X", "B-x")]
    df = spark.createDataFrame(rows, "data_set string, doc_id bigint, sent_id bigint, tok_id bigint, token string, pos string, iob string")
    monkeypatch.setattr(type(df), "repartitionByRange", None)
    folder = tmp_path / "out"
    columns.write_columns(df.repartition(5), str(folder))
    text = "".join(f.read_text() for f in sorted(folder.rglob("*.txt")))
    for d in (0, 11):
        lines = ["# FILE: " + str(d), *(x for _ in range(3) for x in ["", *(f"{t}\tw{t}\tX\tO" for t in range(1, 5))]), "", ""]
        assert "\n".join(lines) in text
    found = columns.read_columns(spark, str(folder)).groupBy("file", "sent_id").count()
    assert sorted(r["count"] for r in found.collect()) == [1, 1] + [4] * 33 + [8] * 3


def test_shards_of_files_have_no_branch_for_null_keys(spark, tmp_path):
    folder = tmp_path / "data_set=a%25b é"
    folder.mkdir()
    (folder / "x%41 é.txt").write_text("1\ta\tX\tO\n\n2\tb\tX\tO\n")
    rows = columns.read_columns(spark, str(tmp_path))
    assert {(r.data_set, r.file.rsplit("/", 1)[1]) for r in rows.collect()} == {("a%b é", "x%41 é.txt")}
    shuffled = splits.shuffle(splits.plain_text(rows, ("data_set", "file", "sent_id")), keys=("data_set", "file", "sent_id"))
    assert "Union" not in shuffled._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.text for r in shuffled.collect()) == ["a", "b"]


def test_lines_are_handed_over_as_one_number(spark, tmp_path):
    """What a line costs in Python grows with its columns; texts and paths wait in the JVM."""
    (tmp_path / "a.txt").write_text("a O O\n\nb O B-x\n")
    for rows in (pairs.read_pairs(spark, str(tmp_path)), columns.read_columns(spark, str(tmp_path))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "MapIn" not in plan
        assert plan.count("ArrowEvalPython [_counts((shiftleft(") == 2


@pytest.mark.parametrize("delimiter", [" ", "\t", "|", "::", "é"])
def test_parts_of_a_line(spark, delimiter):
    """Cut out where they stand, a line's fields are those of a split."""
    rng = random.Random(2)
    values = ["", *("".join(rng.choices(["a", "B-x", "é", delimiter, delimiter], k=rng.randint(1, 9))) for _ in range(300))]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    parts = [x.alias(n) for n, x in zip(("size", "first", "gold", "guess"), pairs._parts(F.col("value"), delimiter))]
    for r in df.select("value", *parts).collect():
        fields = r.value.split(delimiter)
        while fields and not fields[-1]:
            fields.pop()
        assert r["size"] == len(fields)
        if len(fields) > 1:
            assert (r["first"], r["gold"], r["guess"]) == (fields[0], *fields[-2:])
