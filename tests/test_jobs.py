"""The whole jobs, the first against a sequential walk over a parsed document."""

from __future__ import annotations

import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

import characters
from spanlake.functions.inventory import LEADING_EDGE, TRAILING_EDGE
from spanlake.functions import markup
from spanlake.functions.markup import balanced
from spanlake.operators.fragments import fragments
from spanlake.plans import jobs
from spanlake.sources import annotated, columns

TOKEN = re.compile(r"[^\W\d_]+['’]|[^\W_]+(?:-[^\W_]+)*|\S")


class Outermost(HTMLParser):
    """Top-level text and annotations of a well-formed document, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        if self.depth == 0:
            self.parts.append([tag, ""])
        self.depth += 1

    def handle_endtag(self, tag):
        self.depth -= 1
        if self.depth == 0:
            self.parts.append([None, ""])

    def handle_data(self, data):
        if not self.parts:
            self.parts.append([None, ""])
        self.parts[-1][1] += data


def sequential_tokens(text):
    lines = [x.strip() for x in text.split("\n")]
    text = "\n".join(x for x in lines if x and not x.endswith(".png"))

    text = characters.escape_once(characters.escape_once(text))
    text = characters.join_halves(characters.break_sentences(characters.unwrap(text)))
    parser = Outermost()
    parser.feed(text)
    parser.close()
    frags = []
    for label, body in parser.parts:
        plain = label in (None, "noisy-entities")
        for piece in body.split("\n") if label is None else [body]:
            piece = " ".join(piece.split())
            if piece:
                frags.append((piece, None if plain else label))

    def terminal(s):
        return s[-1] in ".!?" or re.match("[A-Z]", s[-1])

    def headline(s):
        return sum(c.isupper() for c in s) > sum(c.islower() for c in s)

    sentences = []
    for i, (piece, label) in enumerate(frags):
        prev = frags[i - 1][0] if i else None
        goes_on = i and (
            ((piece[0].islower() or label) and not terminal(prev)) or (headline(piece) and headline(prev))
        )
        if not goes_on:
            sentences.append([])
        tokens = TOKEN.findall(piece)
        tags = ["O"] * len(tokens)
        if label:
            lo, hi = 0, len(tokens)
            while lo < min(2, len(tokens)) and tokens[lo] in LEADING_EDGE:
                lo += 1
            cut = 0
            while cut < min(2, len(tokens)) and tokens[hi - 1] in TRAILING_EDGE:
                hi, cut = hi - 1, cut + 1
            for k in range(lo, hi):
                tags[k] = ("B-" if k == lo else "I-") + label
        sentences[-1] += zip(tokens, tags)
    return [(s, t + 1, *x) for s, sent in enumerate(sentences) for t, x in enumerate(sent)]


def random_document(rng):
    words = ["mot", "Paris", "l'", "«", "»", ".", "dit-", "mai-", "son", "il", "TITRE", "été", "R&amp;D", "<b>", "9", ",", "!"]

    def some(depth):
        out = []
        for _ in range(rng.randint(1, 6)):
            if depth < 3 and rng.random() < 0.25:
                name = rng.choice(["pers.ind", "loc.fac", "name", "noisy-entities", "amount"])
                out.append(f"<{name}>{some(depth + 1)}</{name}>")
            else:
                out.append(rng.choice(words))
        return rng.choice([" ", "\n", "  "]).join(out)

    # An image line takes the markup on it along, so it stands alone here.
    return rng.choice(["\n", "\n a.png \n"]).join(some(0) for _ in range(rng.randint(1, 6)))


def test_documents_to_tokens(spark):
    rng = random.Random(12)
    texts = [random_document(rng) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert jobs.repaired_documents(docs).count() == 0
    got = {}
    for r in jobs.documents_to_tokens(docs).orderBy("doc_id", "sent_id", "tok_id").collect():
        got.setdefault(r.doc_id, []).append((r.sent_id, r.tok_id, r.token, r.iob))
    want = {i: sequential_tokens(t) for i, t in enumerate(texts)}
    assert got == {k: v for k, v in want.items() if v}


def test_tagger_hook(spark):
    docs = spark.createDataFrame([(1, "Un <name>Mot</name> ici.")], "doc_id bigint, text string")
    rows = jobs.documents_to_tokens(docs, tagger=lambda ss: [[f"{len(s)}" for _ in s] for s in ss])
    assert [(r.token, r.pos) for r in rows.orderBy("tok_id").collect()] == [("Un", "4"), ("Mot", "4"), ("ici", "4"), (".", "4")]


def test_files_to_statistics_and_shards(spark, tmp_path):
    """The way of the README: annotated files, tokens, column files, tables and shards."""
    for corpus in ("one", "two"):
        folder = tmp_path / "data" / corpus
        folder.mkdir(parents=True)
        for i in range(20):
            (folder / f"{i} é+%41.norm.ne").write_text(f"Le <amount>{i} francs</amount> dit.\nNon.")
    docs = annotated.read_annotated(spark, str(tmp_path / "data" / "one")).unionByName(
        annotated.read_annotated(spark, str(tmp_path / "data" / "two"))
    )
    assert {r.corpus for r in docs.collect()} == {"one", "two"}
    assert {r.doc_id for r in docs.collect()} == {f"{i} é+%41.norm.ne" for i in range(20)}
    tokens = jobs.documents_to_tokens(docs)
    columns.write_columns(tokens, str(tmp_path / "columns"))
    for rows in (tokens, columns.read_columns(spark, str(tmp_path / "columns"))):
        tables = jobs.tokens_to_statistics(rows)
        assert tables["mentions"].count() == 40
        assert tables["length_crosstab_tokens"].collect()[0].len_2 == 40
        assert {r.data_set: r.sentences for r in tables["corpus_summary"].collect()} == {"one": 40, "two": 40}
        shards = jobs.tokens_to_shards(rows, shards=10)
        sizes = {r.shard: r["count"] for r in shards.groupBy("shard").count().collect()}
        assert sizes == {0: 16} | {k: (64 * k - 1) // 10 - (64 * (k - 1) - 1) // 10 for k in range(1, 11)}


UNSOUND = {
    "ok <pers.ind>Luc</pers.ind> fin <day>lundi": [("ok", None), ("Luc", "pers.ind"), ("fin", None), ("lundi", "day")],
    "x</name> <name>y</name>": [("x", None), ("y", "name")],
    "<day>a<year>b</day>c</year>": [("ab", "day"), ("c", None)],
    "<day>a<day>b</day>c</day></day>d": [("abc", "day"), ("d", None)],
    "<name>a<year/>b</year>c": [("abc", "name")],
}


def test_markup_that_does_not_nest(spark):
    docs = spark.createDataFrame([(t, t) for t in UNSOUND], "doc_id string, text string")
    got = {}
    for r in fragments(docs).orderBy("doc_id", "frag_id").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.label))
    assert got == UNSOUND
    sound = 'a <name correction="<b>">x<year>y</year></name> < z <day/>'
    assert repaired(spark, [sound]) == [sound]


def repaired(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.text for r in df.select("i", balanced(F.col("text")).alias("text")).orderBy("i").collect()]


def closed_in_order(text):
    """Every annotation closed once: a walk over the tags with a list of what is open."""
    out, opened = [], []
    for part in re.split(r"(<[^<>]*>)", text):
        name = part.strip("</> ").split(" ")[0]
        if part[:2] == "</" and part[-1:] == ">":
            if name in opened:
                after = opened[len(opened) - opened[::-1].index(name) :]
                out += [f"</{x}>" for x in reversed(after)] + [part]
                del opened[len(opened) - len(after) - 1 :]
            continue
        if part[:1] == "<" and part[-1:] == ">" and part[-2:] != "/>":
            opened.append(name)
        out.append(part)
    return "".join(out + [f"</{x}>" for x in reversed(opened)])


@pytest.mark.parametrize("longest", [6, 400])
def test_random_markup(spark, longest):
    rng = random.Random(longest)
    tags = ["<a>", "</a>", "<b>", "</b>", "<ab>", "</ab>", "<c/>", '<a n="1">', "</>", "<>", "x", " ", "é\n", "5 > 4", "&lt;"]
    texts = ["".join(rng.choices(tags, k=rng.randint(0, longest))) for _ in range(2500 // longest + 200)]
    got = repaired(spark, [*texts, None])
    assert got == [*map(closed_in_order, texts), None]
    assert repaired(spark, got) == got


def test_sound_and_unsound_documents_stay_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    plan = fragments(docs)._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan and "MapIn" not in plan


def test_equal_ids_in_two_corpora(spark):
    docs = spark.createDataFrame([("x", "1", "Un <name>Mot</name>"), ("y", "1", "Deux.</name>")], "corpus string, doc_id string, text string")
    rows = jobs.documents_to_tokens(docs).orderBy("data_set", "tok_id").collect()
    assert [(r.data_set, r.token, r.iob) for r in rows] == [("x", "Un", "O"), ("x", "Mot", "B-name"), ("y", "Deux", "O"), ("y", ".", "O")]
    assert [r.corpus for r in jobs.repaired_documents(docs).collect()] == ["y"]


def test_report_of_raw_tags(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "N", "N"), (1, 1, 2, "_", "V")], "doc_id bigint, sent_id bigint, tok_id bigint, gold string, guess string")
    lines = [r.line for r in jobs.pairs_to_report(pairs, raw=True, outside="_").collect()]
    assert lines[0] == "processed 2 tokens with 1 phrases; found: 2 phrases; correct: 1."
    assert jobs.pairs_to_report(pairs, style="latex", raw=True, outside="_").count() == 4


def test_extreme_documents(spark):
    """Long runs of anything take linear time and no deep recursion."""
    texts = {
        "spaces": ("<name> x </name>" + " " * 300000 + "y.\n", 3),
        "hyphens": ("a-b-" * 100000 + "c", 1),
        "quotes": ("a <name " + '"a" ' * 20000 + ">x</name>", 2),
        "depth": ("<name>" * 5000 + "x" + "</name>" * 5000, 1),
        "faults": ("<name>x</day></name> " * 30000, 30000),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts.values())], "doc_id bigint, text string")
    counts = {r.doc_id: r["count"] for r in jobs.documents_to_tokens(docs).groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, (_, n) in enumerate(texts.values())}


def test_shards_read_their_files_twice(spark, tmp_path):
    """Once for the index of their splits, once for the sentences; the ranks read the exchange of the texts."""
    rows = [(f"d{i % 7}", i, "a" * (i % 5), "X", "O") for i in range(1, 40)]
    tokens = spark.createDataFrame(rows, "doc_id string, tok_id bigint, token string, pos string, iob string")
    columns.write_columns(tokens.selectExpr("'c' as data_set", "*", "0L as sent_id"), str(tmp_path / "columns"))
    shards = jobs.tokens_to_shards(columns.read_columns(spark, str(tmp_path / "columns")), shards=3)
    assert sorted(r["rank"] for r in shards.collect()) == list(range(7))
    plan = shards._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan text") == 2


def test_documents_are_dealt_out_whole(spark):
    """Their texts are exchanged once; tags and pieces of text are not."""
    docs = spark.createDataFrame([(1, "Un <name>Mot</name>")], "doc_id bigint, text string")
    plan = jobs.documents_to_tokens(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id" in plan
    assert plan.index("Generate posexplode(regexp_extract_all") < plan.index("Exchange hashpartitioning")


def test_only_tags_left_by_pairs_are_folded(spark):
    """Pairs within pairs are taken out by pattern, attributes and brackets between them or not."""
    text = '<a n="<b>">x<b>y</b> < z<c/></a></b> <d \'"\'>q' + "<e>" * 9 + "</e>" * 9
    right = text.replace("</b> <d", " <d") + "</d>"
    assert closed_in_order('<a>x<b>y</b></a></b>') == "<a>x<b>y</b></a>"
    assert repaired(spark, [text, right]) == [right, right]
    heads = spark.range(1).select(markup._without_pairs(F.lit("a>b>/b>c>/c>/a>/b>d>e>/e>"))).first()[0]
    assert heads == "/b>d>"
