from __future__ import annotations

import random

import characters
import re

import pytest
from pyspark.sql import functions as F

from spanlake.functions import inventory, numbers, tags, text


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_inventory_sizes():
    assert len(inventory.ENTITY_TYPES) == 43 and len(inventory.COMPONENTS) == 29
    assert len(set(inventory.LABELS)) == 72


def test_label_table(spark):
    kinds = {r.kind: r["count"] for r in inventory.label_table(spark).groupBy("kind").count().collect()}
    assert kinds == {"type": 43, "component": 29}


def test_clean_lines(spark):
    got = apply(spark, text.clean_lines, [" a \r\n\r\n\tb.png \rc \n  \nd.png e\x1c", "", "\n \n"])
    assert got == ["a\nc\nd.png e", "", ""]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("a<b<name>", "a<b<name>"),
        ("a<b <name>", "a*b <name>"),
        ("<x<y>", "*x*y>"),
        ("</unknown>", "*/unknown>"),
        ("<>", "*>"),
        ("trailing <name", "trailing <name"),
        ("trailing <nam", "trailing *nam"),
        ("<pers.ind correction=\"x\">A</pers.ind>", "<pers.ind correction=\"x\">A</pers.ind>"),
        ("<persXind>", "*persXind>"),
        ("a < b", "a * b"),
        ("</name >", "</name >"),
        ("<names>", "*names>"),
    ],
)
def test_escape_unknown_tags(spark, raw, want):
    assert apply(spark, text.escape_unknown_tags, [raw]) == [want]


def test_repair_equals_walks_over_characters(spark):
    rng = random.Random(5)
    parts = [".", "!", "»", " ", " ", "\n", "\n", "A", "b", "<", "-", "il", "é", "\t", "\u00a0"]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    assert apply(spark, text.unwrap_lines, raw) == [characters.unwrap(x) for x in raw]
    assert apply(spark, text.break_after_punct, raw) == [characters.break_sentences(x) for x in raw]
    assert apply(spark, text.dehyphenate, raw) == [characters.join_halves(x) for x in raw]


def test_references(spark):
    raw = ["caf&eacute; &#233;&#xE9; &amp;lt; &lt;b&gt; &quot;&apos;", "&nosuch; & &; &#0; &#xD800; &#x1F600;", "&yuml;&nbsp;x", "none", ""]
    want = ["café éé &lt; <b> \"'", "&nosuch; & &; &#0; &#xD800; 😀", "ÿ\u00a0x", "none", ""]
    assert apply(spark, text.decode_references, raw) == want


def test_escape_equals_two_passes_of_replacement(spark):
    rng = random.Random(4)
    parts = ["<", ">", "/", " ", "name", "loc.fac", "x", "</", "\n", "day>"]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert apply(spark, text.escape_unknown_tags, raw) == [characters.escape_once(characters.escape_once(x)) for x in raw]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("M.\nDupont", "M.\nDupont"),
        ("est\ngrande", "est grande"),
        ("fin. »\nsuite", "fin. »\nsuite"),
        ("fin.»\nsuite", "fin.»\nsuite"),
        ("mot »\nsuite", "mot » suite"),
        ("TITRE\nsuite", "TITRE\nsuite"),
        ("suite\nTitre", "suite\nTitre"),
        ("suite\nÉté", "suite Été"),
        ("quoi ?\nrien", "quoi ?\nrien"),
    ],
)
def test_unwrap_lines(spark, raw, want):
    assert apply(spark, text.unwrap_lines, [raw]) == [want]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("non. Oui", "non.\nOui"),
        ("non. oui", "non. oui"),
        ("non.  oui", "non.\n oui"),
        ("non! <name>", "non! <name>"),
        ("non? É", "non?\nÉ"),
        ("a.b C", "a.b C"),
    ],
)
def test_break_after_punct(spark, raw, want):
    assert apply(spark, text.break_after_punct, [raw]) == [want]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("mai- son", "maison"),
        ("dit- il", "dit-il"),
        ("dit- ilot", "ditilot"),
        ("été- elle.", "été-elle."),
        ("a- b- c", "abc"),
        ("« - il", "« - il"),
        ("fin - suite", "fin - suite"),
        ("x- il- y", "x-ily"),
    ],
)
def test_dehyphenate(spark, raw, want):
    assert apply(spark, text.dehyphenate, [raw]) == [want]


def test_repairs_equal_the_plain_patterns(spark):
    """Against the same rules written for Python's regex engine."""
    newline = re.compile(r"(?<![.!?])(?<!\.\s»)(?<!\.»)(?<![A-Z])\n(?![A-Z])")
    space = re.compile(r"(?<=[.!?])\s+(?![a-z<])")

    def plain(s):
        s = space.sub("\n", newline.sub(" ", s))
        def join(m):
            return ("-" if m.group(1) in inventory.HYPHEN_PRONOUNS else "") + m.group(1)

        return re.sub(r"(?<=\w)- (\w+)", join, s)

    rng = random.Random(8)
    parts = ["mot", "il", "É", "é", "A", ".", "!", "»", "\n", " ", "- ", "-\n", "<", "9", "_", " "]
    raw = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    assert apply(spark, text.repair, raw) == [plain(x) for x in raw]


def test_squash(spark):
    assert apply(spark, text.squash, [" a \n b\x1f", "\t"]) == ["a b", ""]


def test_upper_majority(spark):
    assert apply(spark, text.upper_majority, ["ABc", "Ab", "12", "ÉÀé", "ªA"]) == [True, False, False, True, False]


def test_decode_references(spark):
    assert apply(spark, text.decode_references, ["a &amp;lt; &lt;b&gt; &quot;&apos;&eacute;"]) == ["a &lt; <b> \"'é"]


def test_tokens(spark):
    got = apply(spark, text.tokens_of, ["L'État-major d’Or, 12 fois (né)!"])
    assert got == [["L'", "État-major", "d’", "Or", ",", "12", "fois", "(", "né", ")", "!"]]


def test_tag_parts(spark):
    values = ["B-a-b", "I-0", "O", "-x", "B-"]
    assert apply(spark, tags.tag_prefix, values) == ["B", "I", "O", "", "B"]
    assert apply(spark, tags.tag_type, values) == ["a-b", "", "", "x", ""]


def test_coarse_types(spark):
    got = apply(spark, lambda c: tags.coarse_type(tags.mention_type(c)), ["B-loc.adm.town", "B-amount", "B-name"])
    assert got == ["loc", "amount", "name"]


def test_two_decimals_as_c_prints_them(spark):
    rng = random.Random(1)
    values = [0.0, 100.0, 3.125, 9.375, 0.125, 0.375, 0.005, 0.015, 1.005, 2.675, 99.995, 50.625, 0.004999]
    values += [100 * rng.randint(0, d) / d for d in (rng.randint(1, 4000) for _ in range(4000))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.v for r in numbers.with_fixed2(df, ["v"]).orderBy("i").collect()]
    assert got == ["%6.2f" % v for v in values]


def test_clip(spark):
    got = spark.createDataFrame([(-1,), (3,), (9,), (None,)], "v int").select(numbers.clip(F.col("v"), 0, 8).alias("v"))
    assert [r.v for r in got.collect()] == [0, 3, 8, None]
