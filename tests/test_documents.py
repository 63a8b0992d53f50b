"""Fragments, sentences, labels, mentions and statistics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import chars, corpora, fragments, labels, mentions, splits, stats
from tests import sequential


def docs_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def frags_of(spark, text, mode="n"):
    rows = fragments.fragments(docs_of(spark, text), mode).orderBy("frag_id").collect()
    assert [r.frag_id for r in rows] == list(range(1, len(rows) + 1))
    return [(r.text, r.label) for r in rows]


@pytest.mark.parametrize(
    "text, want",
    [
        ("a  b\nc", [("a b", None), ("c", None)]),
        ("le <pers.ind>Roi <name>X</name></pers.ind> dit\nnon", [("le", None), ("Roi X", "pers.ind"), ("dit", None), ("non", None)]),
        ("<pers.ind>a\nb</pers.ind>", [("a b", "pers.ind")]),
        ("x <noisy-entities>a <name>b</name>\nc</noisy-entities> y", [("x", None), ("a b c", None), ("y", None)]),
        ("<org.ent>a <noisy-entities>b</noisy-entities></org.ent>", [("a b", "org.ent")]),
        ("<name> \n </name>rest", [("rest", None)]),
        ("a <name/> b", [("a", None), ("b", None)]),
        ("<name>a</name><day>b</day>", [("a", "name"), ("b", "day")]),
        ("a &amp; <name>R&amp;D &lt;x&gt;</name>", [("a &", None), ("R&D <x>", "name")]),
        ("5 < 6 <name", [("5 < 6 <name", None)]),
        ('<name a="x>y" b=\'"\'>z</name>', [("z", "name")]),
        ("", []),
    ],
)
def test_fragments(spark, text, want):
    assert frags_of(spark, text) == want


def test_corrections(spark):
    text = (
        '<pers.ind correction="Jean &amp; Co">Jcan</pers.ind> et <org.ent>la <name correction="Gare">Gaie</name> X</org.ent>'
        ' <loc.fac correction="A">b <name correction="c">d</name></loc.fac>'
    )
    assert frags_of(spark, text, "c") == [
        ("Jean & Co", "pers.ind"), ("et", None), ("la Gare X", "org.ent"), ("A", "loc.fac"),
    ]
    assert frags_of(spark, text)[0] == ("Jcan", "pers.ind")
    with pytest.raises(ValueError):
        fragments.fragments(docs_of(spark, text), "x")


def test_unsound_documents_are_reported_and_kept(spark):
    texts = ["<name>ok</name>", "<name>open", "close</name>", "<day><year>x</day></year>", "</name><name>"]
    docs = docs_of(spark, *texts)
    assert {r.doc_id for r in fragments.markup_errors(docs).collect()} == {1, 2, 3, 4}
    got = {(r.doc_id, r.text, r.label) for r in fragments.fragments(docs).collect()}
    assert got == {(0, "ok", "name"), (1, "open", "name"), (2, "close", None), (3, "x", "day")}


def sentences_of(spark, frags):
    rows = [(1, i + 1, t, l) for i, (t, l) in enumerate(frags)]
    df = spark.createDataFrame(rows, "doc_id bigint, frag_id bigint, text string, label string")
    return [r.sent_id for r in fragments.assemble_sentences(df).orderBy("frag_id").collect()]


@pytest.mark.parametrize(
    "frags, want",
    [
        ([("Le", None), ("Pacha", "func.ind"), ("dit", None), (", non", None)], [0, 0, 0, 1]),
        ([("Fin.", None), ("suite", None)], [0, 1]),
        ([("Fin.", None), ("Paris", "loc.adm.town")], [0, 1]),
        ([("GRAND TITRE", None), ("AUTRE TITRE", None), ("Texte", None)], [0, 0, 1]),
        ([("mot", None), ("Majuscule", None)], [0, 1]),
        ([("mot", None), ("été", None), ("9 fois", None)], [0, 0, 1]),
        ([("sigle SNCF", None), ("suite", None)], [0, 1]),
    ],
)
def test_sentence_assembly(spark, frags, want):
    assert sentences_of(spark, frags) == want


def trimmed(tokens):
    """The edge rules, one step at a time; positions that do not exist are skipped."""
    lead, trail = ("l'", "L'", "(", "{", '"', "«"), (")", "}", '"', "»", ";", ",", ".", "?", "!")
    tags = ["B"] + ["I"] * (len(tokens) - 1)
    n = len(tokens)
    if tokens[0] in lead:
        tags[0] = "O"
        if n > 1 and tokens[1] in lead:
            tags[1] = "O"
            if n > 2:
                tags[2] = "B"
        elif n > 1:
            tags[1] = "B"
    if tokens[-1] in trail:
        tags[-1] = "O"
        if n > 1 and tokens[-2] in trail:
            tags[-2] = "O"
    return tags


def test_trim_edges(spark):
    rng = random.Random(2)
    alphabet = ["l'", "(", "«", "X", "Y", "»", ".", ",", '"']
    lists = [[rng.choice(alphabet) for _ in range(rng.randint(1, 6))] for _ in range(1500)]
    rows = [(i, 1, 0, "x", t) for i, t in enumerate(lists)]
    df = spark.createDataFrame(
        rows, "doc_id bigint, frag_id bigint, sent_id bigint, label string, tokens array<string>"
    )
    got = {}
    for r in labels.label_tokens(labels.trim_edges(df)).orderBy("doc_id", "tok_id").collect():
        got.setdefault(r.doc_id, []).append(r.iob[0])
    assert got == {i: trimmed(t) for i, t in enumerate(lists)}


def test_documents_to_numbered_tokens(spark):
    docs = docs_of(spark, "Le <pers.ind>l' Ami Paul .</pers.ind> dit\nNon.")
    frags = fragments.assemble_sentences(fragments.fragments(docs))
    rows = labels.label_tokens(labels.number_tokens(labels.trim_edges(labels.tokenize(frags))))
    got = [(r.sent_id, r.tok_id, r.token, r.iob) for r in rows.orderBy("sent_id", "tok_id").collect()]
    assert got == [
        (0, 1, "Le", "O"), (0, 2, "l'", "O"), (0, 3, "Ami", "B-pers.ind"), (0, 4, "Paul", "I-pers.ind"),
        (0, 5, ".", "O"), (1, 1, "dit", "O"), (2, 1, "Non", "O"), (2, 2, ".", "O"),
    ]


def test_own_tokenizer_and_tagger(spark):
    df = spark.createDataFrame([(1, 0, 1, "a b", None), (1, 1, 1, " ", None)], "doc_id bigint, sent_id bigint, frag_id bigint, text string, label string")
    cut = labels.tokenize(df, tokenizer=lambda texts: texts.str.split(" "))
    words = labels.label_tokens(cut)
    tagged = labels.annotate(words, lambda sentences: [[w.upper() for w in s] for s in sentences])
    got = [(r.sent_id, r.tok_id, r.token, r.iob, r.pos) for r in tagged.orderBy("tok_id").collect()]
    assert got == [(0, 1, "a", "O", "A"), (0, 2, "b", "O", "B")]
    with pytest.raises(Exception, match="one label per token"):
        labels.annotate(words, lambda sentences: [["x"] for _ in sentences]).collect()


TOKENS = "data_set string, doc_id bigint, sent_id bigint, tok_id bigint, token string, pos string, iob string"


def tokens_of(spark, sentences):
    rows = [("d", 0, i, j + 1, *t) for i, s in enumerate(sentences) for j, t in enumerate(s)]
    return spark.createDataFrame(rows, TOKENS)


@pytest.mark.parametrize("block", [2, 3, 7, 1 << 16])
def test_mentions_equal_a_sequential_walk(spark, block):
    rng = random.Random(6)
    tags = ["O", "B-pers.ind", "I-pers.ind", "I-loc.fac", "B-name", "I-name", "B-amount", "E-x", "I-time.date.abs"]
    sentences = [
        [(rng.choice("abcd") * rng.randint(1, 3), rng.choice("XY"), rng.choice(tags)) for _ in range(rng.randint(1, 15))]
        for _ in range(800)
    ]
    sentences.append([("a", "X", "B-amount")] + [("b", "Y", "I-amount")] * 50)
    got = {}
    for r in mentions.mentions(tokens_of(spark, sentences), block=block).collect():
        got.setdefault(r.sent_id, []).append((r.first_tok, r.type, r.subtype, r.tokens, r.pos, r.n_tokens, r.n_characters))
    want = {i: sequential.mentions(s) for i, s in enumerate(sentences)}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_faulty_labels_and_counts(spark):
    df = tokens_of(spark, [[("a", "x", "B-name"), ("b", "x", "I-name"), ("c", "x", "B-name.first")], [("d", "x", "B-pers.ind")]])
    assert {(r.label, r.n) for r in mentions.faulty(df).collect()} == {("name", 2)}
    assert [(r.data_set, r.n_tokens) for r in mentions.token_counts(df).collect()] == [("d", 4)]


MENTIONS = "type string, n_tokens bigint, n_characters bigint"


def test_crosstab(spark):
    found = spark.createDataFrame([("pers", 1, 3), ("pers", 9, 40), ("loc", 2, 5), ("loc", 0, 0)], MENTIONS)
    rows = stats.length_crosstab(found, "token", 3).collect()
    assert [tuple(r) for r in rows] == [
        ("loc", 1.0, 0.0, 1.0, 0.0, 2.0, 50.0),
        ("pers", 0.0, 1.0, 0.0, 1.0, 2.0, 50.0),
        ("(total)", 1.0, 1.0, 1.0, 1.0, 4.0, 100.0),
        ("(percent)", 25.0, 25.0, 25.0, 25.0, None, None),
    ]


def test_histogram(spark):
    found = spark.createDataFrame([("pers", 1, 0), ("pers", 2, 4), ("pers", 3, 29), ("loc", 12, 99)], MENTIONS)
    rows = {(r.type, r.label): r.n for r in stats.length_histogram(found, "character", 0, 35, 5).collect()}
    assert len(rows) == 7 * 6
    assert {k: v for k, v in rows.items() if v} == {("pers", "0-4"): 2, ("pers", "25+"): 1, ("loc", "25+"): 1}
    rows = {(r.type, r.label): r.n for r in stats.length_histogram(found, "token", 0, 12, 2).collect()}
    assert {k: v for k, v in rows.items() if v} == {("pers", "0-1"): 1, ("pers", "2-3"): 2, ("loc", "8+"): 1}


def test_tag_dictionary_and_summary(spark):
    df = tokens_of(spark, [[("a", "x", "O"), ("b", "x", "B-a")], [("c", "x", "O")]])
    assert [(r.tag, r.id) for r in stats.tag_dictionary(df).orderBy("id").collect()] == [("B-a", 0), ("O", 1)]
    assert [tuple(r) for r in stats.corpus_summary(df).collect()] == [("d", 2, 3, 2)]


@pytest.mark.parametrize("n", [0, 1, 5, 99, 100, 101, 124, 125, 248, 1000])
def test_split_and_shards_have_exact_sizes(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("bigint").alias("sent_id"), F.lit("x").alias("text"))
    rows = splits.split(df)
    got = {r.split: r["count"] for r in rows.groupBy("split").count().collect()}
    train = int(0.8 * n)
    valid = int(0.5 * (n - train))
    want = {"train": train, "valid": valid, "test": n - train - valid}
    assert got == {k: v for k, v in want.items() if v}
    assert sorted(r["rank"] for r in rows.collect()) == list(range(n))
    equal = splits.shard(rows, equal=True).where("split = 'train'")
    sizes = {r.shard: r["count"] for r in equal.groupBy("shard").count().collect()}
    size = int(0.01 * train)
    assert sizes == ({i: size for i in range(1, 101)} if size else {})
    kept = splits.shard(rows)
    assert kept.count() == n
    sizes = [r["count"] for r in kept.where("split = 'train'").groupBy("shard").count().collect()]
    assert sum(sizes) == train and len(sizes) == min(train, 100)
    assert not sizes or max(sizes) - min(sizes) <= 1
    assert kept.where("split = 'train' AND NOT shard BETWEEN 1 AND 100").count() == 0


def test_shuffle_depends_on_the_seed_only(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(0).alias("sent_id"))
    def order(seed, parts):
        rows = splits.shuffle(df.repartition(parts), seed).orderBy("rank").collect()
        return [r.doc_id for r in rows]

    assert order(42, 1) == order(42, 7) != order(43, 1)
    assert order(42, 1) != list(range(300))


def test_plain_text(spark):
    df = tokens_of(spark, [[("b", "x", "O"), ("a", "x", "O")], [("", "x", "O")]])
    assert [(r.sent_id, r.text) for r in splits.plain_text(df).collect()] == [(0, "b a")]
    assert splits.plain_text(df, keep_empty=True).count() == 2


def test_union_corpora(spark):
    df = tokens_of(spark, [[("a", "x", "O")]]).drop("data_set")
    got = corpora.union_corpora({"one": df, "two": df}).collect()
    assert sorted(r.data_set for r in got) == ["one", "two"]
    with pytest.raises(ValueError):
        corpora.union_corpora({})


def test_characters(spark):
    df = spark.createDataFrame([("aé👍\na",), ("",)], "text string")
    assert [(r.char, r.n, r.id) for r in chars.char_inventory(df).orderBy("id").collect()] == [
        ("a", 2, 0), ("\n", 1, 1), ("é", 1, 2), ("👍", 1, 3),
    ]
    vocab = spark.createDataFrame([("a",), ("a",), ("z",)], "char string")
    assert tuple(chars.char_coverage(df, vocab).collect()[0]) == (5, 2, 40.0)
    assert tuple(chars.char_coverage(df.limit(0), vocab).collect()[0]) == (0, 0, 0.0)


def test_char_sequences(spark):
    df = spark.createDataFrame([(1, "abcdé👍g"), (2, "")], "id int, text string")
    got = [(r.id, r.piece, r.chars) for r in chars.char_sequences(df, 3).orderBy("piece").collect()]
    assert got == [(1, 0, "abc"), (1, 1, "dé👍"), (1, 2, "g")]
    got = [r.chars for r in chars.char_sequences(df, 3, backward=True).orderBy("piece").collect()]
    assert got == ["g👍é", "dcb", "a"]


def test_tag_dictionary(spark):
    tags = ["O", "B-pers.ind", "B-pers", "B-", "", "I-é", "B-pers.ind.x", "O", "I-loc", "B-loc"]
    rows = stats.tag_dictionary(spark.createDataFrame([(t,) for t in [*tags, None]], "iob string")).collect()
    assert {r.tag: r.id for r in rows} == {t: i for i, t in enumerate([None, *sorted(set(tags))])}


def test_char_ids(spark):
    docs = docs_of(spark, "aab é😀", "", None, "\x00b")
    vocab = chars.char_inventory(docs_of(spark, "aaa bb é"))
    ids = {r.char: r.id for r in vocab.collect()}
    got = {r.doc_id: r.ids for r in chars.char_ids(docs.withColumn("ids_of", F.lit(1)), vocab).collect()}
    assert got == {0: [ids["a"], ids["a"], ids["b"], ids[" "], ids["é"], 4], 1: [], 2: None, 3: [4, ids["b"]]}
    assert chars.char_ids(docs, vocab, unknown=99).where("doc_id = 3").first().ids[0] == 99
    assert chars.char_ids(docs, vocab.limit(0)).where("doc_id = 0").first().ids == [0] * 6


def test_tagger_sees_long_sentences_in_blocks(spark, monkeypatch):
    """Labels that need two neighbours are right at every border, in calls of bounded size."""
    monkeypatch.setattr(labels, "CALL", 12)
    rows = [(s, i + 1, f"{s}.{i}", i) for s, n in enumerate([1, 4, 8, 9, 23, 40]) for i in range(n)]
    df = spark.createDataFrame(rows, "sent_id int, tok_id bigint, token string, other int").repartition(3)

    def near(sentences):
        assert sum(map(len, sentences)) <= 12 or len(sentences) == 1
        assert max(map(len, sentences)) <= 8 + 2 * 2
        return [["|".join(x[max(0, i - 2) : i + 3]) for i in range(len(x))] for x in sentences]

    whole = {}
    for r in labels.annotate(df, lambda s: [["|".join(x[max(0, i - 2) : i + 3]) for i in range(len(x))] for x in s], ("sent_id",)).collect():
        whole[r.sent_id, r.tok_id] = (r.token, r.other, r.pos)
    got = labels.annotate(df, near, ("sent_id",), block=8, context=2).collect()
    assert len(got) == len(rows) and {(r.sent_id, r.tok_id): (r.token, r.other, r.pos) for r in got} == whole
    assert got[0].asDict().keys() == {"sent_id", "tok_id", "token", "other", "pos"}


def test_ranks_of_keys_with_nulls(spark):
    df = spark.createDataFrame([(d, s, "t") for d in (1, 2, None) for s in (0, 1, None)], "doc_id bigint, sent_id bigint, text string")
    rows = splits.split(df).collect()
    assert sorted(r["rank"] for r in rows) == list(range(9)) and {r.n for r in rows} == {9}


def test_mentions_move_once(spark):
    """Tokens are exchanged once; what touches no border of a block stays where it is."""
    rows = [(1, 1, i + 1, f"w{i}", "N", "B-pers" if i % 3 == 0 else "I-pers") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, sent_id bigint, tok_id bigint, token string, pos string, iob string")
    found = mentions.mentions(df, ("doc_id", "sent_id"))
    assert found.count() == 10
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
    assert mentions.mentions(df, ("doc_id", "sent_id"), block=2).count() == 10
