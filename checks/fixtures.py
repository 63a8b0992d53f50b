"""Inputs derived from the given tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.functions.text import token_shape
from spanlake.sources.workspace import new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Types dealt out to the tokens; the last is a component.
TYPES = ("pers.ind", "func.ind", "loc.adm.town", "amount", "time.date.abs", "org.ent", "prod.media", "name")
PREFIX = {0: "B", 5: "B", 1: "I", 2: "I", 6: "I"}


PART = 4 << 20

# Characters and how they are written as references, in the order of replacement; the name of
# the last one stands for nothing.
REFERENCES = {"&": "&amp;", "z": "&#x7A;", "q": "&#113;", "k": "&uuml;", "j": "&nosuch;"}


# Folders that hold a fixture already, by (sf, name); see ``prepare``.
PREPARED: dict[tuple[str, str], str] = {}


def fixture(make):
    """Read a prepared copy of the fixture where there is one."""

    @functools.wraps(make)
    def get(spark: SparkSession, sf: str, **how) -> DataFrame:
        folder = PREPARED.get((sf, make.__name__))
        return spark.read.parquet(folder) if folder else make(spark, sf, **how)

    return get


def prepare(spark: SparkSession, sf: str) -> None:
    """Write the inputs once, so that timings are of the operators.

    Given tables are copied to as many files as there are cores twice over, since one file
    with one row group is one task; derived tables and files are written as they are made.
    """
    folder = new_folder(spark, "fixtures")
    cores = spark.sparkContext.defaultParallelism
    for name in ("documents", "pages", "benchmark"):
        path = f"{folder}/{name}"
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(2 * cores).write.parquet(path)
        PREPARED[sf, name] = path
    for make in (words, lines, pairs, tokens, annotated):
        path = f"{folder}/{make.__name__}"
        make(spark, sf).write.parquet(path)
        PREPARED[sf, make.__name__] = path


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table, or its prepared copy."""
    return spark.read.parquet(PREPARED.get((sf, name), f"{sf}/{name}.parquet"))


def files(spark: SparkSession, sf: str, name: str, write) -> str:
    """The folder of a set of files that queries read; written once if inputs are prepared."""
    folder = PREPARED.get((sf, name))
    if folder is None:
        folder = new_folder(spark, name)
        write(folder)
        if PREPARED:
            PREPARED[sf, name] = folder
    return folder


def dealt(docs: DataFrame) -> DataFrame:
    """Documents dealt out by id in parts of about ``PART`` bytes of their files.

    Whatever is grouped or ordered by document and sentence afterwards stays where it is: the
    texts are exchanged instead of their tokens, and a part's tokens are sorted in memory.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    return docs.repartition(parts, "doc_id")


@fixture
def words(spark: SparkSession, sf: str, deal: bool = True) -> DataFrame:
    """Tokens of every non-blank line of every document; ``n`` is the line's count. Without ``deal``
    they stay where they are read, for what exchanges each token in any case."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    docs = dealt(docs) if deal else docs
    return (
        docs.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
        .where(F.trim("line") != "")
        .withColumn("toks", F.split(F.trim("line"), " +"))
        .select("doc_id", "source", F.col("sent_id").cast("bigint").alias("sent_id"),
                F.size("toks").alias("n"), F.posexplode("toks").alias("i", "token"))
        .select("doc_id", "source", "sent_id", "n", (F.col("i") + 1).cast("bigint").alias("tok_id"), "token")
    )


def _type_at(doc: str, tok: str) -> str:
    names = ", ".join(f"'{x}'" for x in TYPES)
    return f"element_at(array({names}), cast(({doc} + {tok} div 4) % 8 as int) + 1)"


def _prefix_at(doc: str, sent: str, tok: str) -> str:
    a = f"(({doc} * 31 + {sent} * 17 + {tok} * 7) % 11)"
    return f"(case when {a} in (0, 5) then 'B' when {a} in (1, 2, 6) then 'I' else 'O' end)"


@fixture
def pairs(spark: SparkSession, sf: str, deal: bool = True) -> DataFrame:
    """Gold and guessed tags by arithmetic on the token's position."""
    rows = words(spark, sf, deal=deal).withColumns(
        {
            "p": F.expr(_prefix_at("doc_id", "sent_id", "tok_id")),
            "ty": F.expr(_type_at("doc_id", "tok_id")),
            "b": F.expr("(doc_id * 13 + sent_id * 5 + tok_id * 3) % 7"),
        }
    )
    gold = F.expr("case when p = 'O' then 'O' else concat(p, '-', ty) end")
    guess = F.expr(
        "case when b = 0 then 'O' when b = 1 and p = 'B' then concat('I-', ty)"
        " when b = 2 and p = 'O' then concat('B-', ty)"
        " when p = 'O' then 'O' else concat(p, '-', ty) end"
    )
    return rows.select(
        "doc_id", "source", "sent_id", "tok_id", "token", gold.alias("gold"), guess.alias("guess")
    )


@fixture
def tokens(spark: SparkSession, sf: str, deal: bool = True) -> DataFrame:
    """Labelled tokens: gold tags, token shape as POS, source as data set."""
    return pairs(spark, sf, deal=deal).select(
        F.col("source").alias("data_set"), "doc_id", "sent_id", "tok_id", "token",
        token_shape(F.col("token")).alias("pos"), F.col("gold").alias("iob"),
    )


def raw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the type alone as tag; ``NONE`` is outside."""
    bare = {c: F.expr(f"case when {c} = 'O' then 'NONE' else substring_index({c}, '-', -1) end") for c in ("gold", "guess")}
    return pairs(spark, sf).withColumns(bare)


def predictions(spark: SparkSession, sf: str, deal: bool = True) -> DataFrame:
    """Guessed tags with one token in eleven missing and a few unknown positions."""
    rows = pairs(spark, sf, deal=deal).withColumn("c", F.expr("(doc_id + sent_id + tok_id) % 11"))
    at = F.expr("case when c = 1 then tok_id + 1000000 else tok_id end")
    return rows.where("c <> 0").select("doc_id", "sent_id", at.alias("tok_id"), F.col("guess").alias("iob"))


def _marks(doc: int | None, text: str) -> Iterator[tuple[int, int, str]]:
    """Line, place and marked-up form of each token of a text, the tags those of ``pairs``."""

    def rest(value: int, by: int) -> int:  # with the sign of the value, as in SQL
        return value % by if value >= 0 else -(-value % by)

    def type_at(tok: int) -> str:
        at = rest(doc + tok // 4, len(TYPES)) + 1
        if not at:
            raise ValueError("no type at 0")
        return TYPES[at - 1 if at > 0 else at]

    for sent, line in enumerate(text.split("\n")):
        toks = [t for t in line.split(" ") if t]
        if doc is None:
            tags = ["O"] * len(toks)
        else:
            tags = [PREFIX.get(rest(doc * 31 + sent * 17 + t * 7, 11), "O") for t in range(1, len(toks) + 1)]
        types = ["" if p == "O" else type_at(t) for t, p in enumerate(tags, 1)]
        n, last, last_type = len(toks), "O", ""
        for i, (tok, p, ty) in enumerate(zip(toks, tags, types)):
            if "&" in tok or "<" in tok:
                tok = tok.replace("&", "&amp;").replace("<", "&lt;")
            if p != "O":
                if i % 5 == 4:
                    tok = f"<name.last>{tok}</name.last>"
                label = "noisy-entities" if ty == "name" and doc % 2 == 0 else ty
                if p == "B" or last == "O" or last_type != ty:
                    fix = f' correction="fix {i + 1}"' if i % 4 == 0 else ""
                    tok = f"<{label}{fix}>{tok}"
                if i + 1 == n or tags[i + 1] != "I" or types[i + 1] != ty:
                    tok = f"{tok}</{label}>"
            yield sent, i, (" " if i else "\n") + tok
            last, last_type = p, ty


@fixture
def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the gold chunks as markup.

    Some chunks carry a correction, some tokens a nested component, and ``name``
    chunks of even documents are noise. Made within one row per id, so only the given
    texts are exchanged, not their tokens; rows of one id are one document, its tokens in the
    order of place and form.
    """
    texts = table(spark, sf, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc, several in zip(batch.column(0).to_pylist(), batch.column(1)):
                marks = [m for text in several for m in _marks(doc, text.as_py())]
                if len(several) > 1:
                    marks.sort()
                made.append("".join([m for _, _, m in marks])[1:] if marks else None)
            batch = pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["doc_id", "text"])
            yield batch.filter(batch.column(1).is_valid())

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text string")


def broken(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated documents, two in three with a markup error at the end."""
    tail = F.expr(
        "case doc_id % 4 when 0 then ' x</name>' when 1 then ' <title>x' when 2 then ' <day>a<year>b</day>c</year>' else '' end"
    )
    return annotated(spark, sf).withColumn("text", F.concat("text", tail))


def hyphenated(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines with some words split at a hyphen or followed by a pronoun."""
    word = (
        "case when length(t) >= 6 and i % 4 = 0 then concat(left(t, 3), '- ', substr(t, 4))"
        " when i % 7 = 0 then concat(t, '- il') else t end"
    )
    text = F.expr(f"array_join(transform(split(trim(line), ' +'), (t, i) -> {word}), ' ')")
    return lines(spark, sf).select("doc_id", "sent_id", text.alias("text"))


@fixture
def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Non-blank lines of the documents."""
    docs = table(spark, sf, "documents")
    return (
        docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent_id", "line"))
        .where(F.trim("line") != "")
        .withColumn("sent_id", F.col("sent_id").cast("bigint"))
    )


def write_documents(docs: DataFrame, folder: str) -> None:
    """One ``.norm.ne`` file per document, and a few files to be skipped."""

    def write(rows) -> None:
        from pyarrow import fs

        target, path = fs.FileSystem.from_uri(folder)
        target.create_dir(path, recursive=True)
        skipped = set()
        for row in rows:
            with target.open_output_stream(f"{path}/doc_{row.doc_id}.norm.ne") as out:
                out.write(row.text.encode())
            if row.doc_id % 7 not in skipped:  # once a task, not once a document
                skipped.add(row.doc_id % 7)
                with target.open_output_stream(f"{path}/doc_{row.doc_id % 7}.log") as out:
                    out.write(b"skipped")

    docs.select("doc_id", "text").foreachPartition(write)


# The same inputs in DuckDB SQL. Each value is a list of CTEs.

_TYPE_LIST = "[" + ", ".join(f"'{x}'" for x in TYPES) + "]"

WORDS = [
    """lines AS (
  SELECT doc_id, source, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS sent_id
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents))""",
    """words AS (
  SELECT doc_id, source, sent_id, unnest(t) AS token, generate_subscripts(t, 1) AS tok_id
  FROM (SELECT doc_id, source, sent_id, string_split_regex(trim(line), ' +') AS t
        FROM lines WHERE trim(line) <> ''))""",
]

PAIRS = WORDS + [
    f"""tagged AS (
  SELECT *, CASE WHEN a IN (0, 5) THEN 'B' WHEN a IN (1, 2, 6) THEN 'I' ELSE 'O' END AS p
  FROM (SELECT *, (doc_id * 31 + sent_id * 17 + tok_id * 7) % 11 AS a,
               (doc_id * 13 + sent_id * 5 + tok_id * 3) % 7 AS b,
               {_TYPE_LIST}[(doc_id + tok_id // 4) % 8 + 1] AS ty FROM words))""",
    """pairs AS (
  SELECT doc_id, source, sent_id::BIGINT AS sent_id, tok_id::BIGINT AS tok_id, token,
         CASE WHEN p = 'O' THEN 'O' ELSE p || '-' || ty END AS gold,
         CASE WHEN b = 0 THEN 'O' WHEN b = 1 AND p = 'B' THEN 'I-' || ty
              WHEN b = 2 AND p = 'O' THEN 'B-' || ty
              WHEN p = 'O' THEN 'O' ELSE p || '-' || ty END AS guess
  FROM tagged)""",
]

SHAPE = """CASE WHEN regexp_matches({0}, '^\\p{{Lu}}') THEN 'X' WHEN regexp_matches({0}, '^\\p{{Ll}}') THEN 'x'
  WHEN regexp_matches({0}, '^\\p{{N}}') THEN 'd' ELSE 'p' END"""

TOKENS = PAIRS + [
    f"""tokens AS (
  SELECT source AS data_set, doc_id, sent_id, tok_id, token, {SHAPE.format('token')} AS pos, gold AS iob
  FROM pairs)"""
]


def sql(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# Whitespace as a class RE2 understands, for use inside brackets.
WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Outermost annotations and the plain text between them, straight from the pairs.
CHUNKS = PAIRS + [
    """near AS (
  SELECT doc_id, sent_id, tok_id, token, p, ty,
         lag(p) OVER w AS lp, lag(ty) OVER w AS lty, lead(p) OVER w AS np, lead(ty) OVER w AS nty
  FROM tagged WINDOW w AS (PARTITION BY doc_id, sent_id ORDER BY tok_id))""",
    """ends AS (
  SELECT *, p = 'B' OR (p = 'I' AND (lp IS NULL OR lp = 'O' OR lty <> ty)) AS st,
         p <> 'O' AND (np IS NULL OR np IN ('O', 'B') OR nty <> ty) AS en,
         CASE WHEN ty = 'name' AND doc_id % 2 = 0 THEN 'noisy-entities' ELSE ty END AS label
  FROM near)""",
    """segs AS (
  SELECT *, sum(CASE WHEN st OR (p = 'O' AND (lp IS NULL OR lp <> 'O')) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id, sent_id ORDER BY tok_id) AS seg
  FROM ends)""",
]

ANNOTATED = CHUNKS + [
    """marked AS (
  SELECT doc_id, sent_id, tok_id,
         CASE WHEN st THEN '<' || label || CASE WHEN tok_id % 4 = 1 THEN ' correction="fix ' || tok_id || '"' ELSE '' END || '>' ELSE '' END
         || CASE WHEN p <> 'O' AND tok_id % 5 = 0 THEN '<name.last>' || body || '</name.last>' ELSE body END
         || CASE WHEN en THEN '</' || label || '>' ELSE '' END AS m
  FROM (SELECT *, replace(replace(token, '&', '&amp;'), '<', '&lt;') AS body FROM ends))""",
    """annotated AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY sent_id) AS text
  FROM (SELECT doc_id, sent_id, string_agg(m, ' ' ORDER BY tok_id) AS line FROM marked GROUP BY ALL)
  GROUP BY doc_id)""",
]


def fragments_sql(corrected: bool) -> list[str]:
    fixed = "CASE WHEN any_value(p) <> 'O' AND min(tok_id) % 4 = 1 THEN 'fix ' || min(tok_id) ELSE string_agg(token, ' ' ORDER BY tok_id) END"
    plain = "string_agg(token, ' ' ORDER BY tok_id)"
    return CHUNKS + [
        f"""frags AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id, seg) AS frag_id, text, label
  FROM (SELECT doc_id, sent_id, seg, {fixed if corrected else plain} AS text,
               CASE WHEN any_value(p) <> 'O' THEN nullif(any_value(label), 'noisy-entities') END AS label
        FROM segs GROUP BY doc_id, sent_id, seg))"""
    ]


FRAGMENTS = fragments_sql(False)

SENTENCES = FRAGMENTS + [
    f"""lagged AS (
  SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY frag_id) AS prev FROM frags)""",
    r"""joined AS (
  SELECT *, CASE WHEN prev IS NULL THEN 1
    WHEN regexp_matches(text, '^\p{Ll}') AND NOT regexp_matches(prev, '[.!?A-Z]$') THEN 0
    WHEN label IS NOT NULL AND NOT regexp_matches(prev, '[.!?A-Z]$') THEN 0
    WHEN len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{Ll}'))
     AND len(regexp_extract_all(prev, '\p{Lu}')) > len(regexp_extract_all(prev, '\p{Ll}')) THEN 0
    ELSE 1 END AS new FROM lagged)""",
    """sents AS (
  SELECT doc_id, frag_id, text, label,
         (sum(new) OVER (PARTITION BY doc_id ORDER BY frag_id) - 1)::BIGINT AS sent_id FROM joined)""",
]

TOKEN_RE = r"\p{L}+[''’]|[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|[^" + WS + "]"

FRAG_TOKENS = SENTENCES + [
    f"""toks AS (
  SELECT doc_id, sent_id, frag_id, label, ts, len(ts) AS n, unnest(ts) AS token, generate_subscripts(ts, 1) AS i
  FROM (SELECT *, regexp_extract_all(text, '{TOKEN_RE}') AS ts FROM sents))""",
]
