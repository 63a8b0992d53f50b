"""Files of scored pairs: the last two fields are gold tag and guessed tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from spanlake.sources.annotated import decoded
from spanlake.sources.lines import INDEX, number_sentences, read_lines, split_index

BOUNDARY = "-X-"


def _fields(value: Column, delimiter: str) -> Column:
    """Fields of a line; empty ones at its end do not count."""
    quoted = "".join("\\" + x if not x.isalnum() and x != "_" else x for x in delimiter)
    body = F.regexp_replace(value, rf"(?<!{quoted})(?:{quoted})++\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, quoted))


def _parts(value: Column, delimiter: str) -> tuple[Column, Column, Column, Column]:
    """Of a line's ``_fields`` the number, the first one and the last two.

    With a delimiter of one ASCII character they are cut out where they stand, without a pattern
    or an array. Of less than two fields the last but one means nothing.
    """
    if len(delimiter) > 1 or not delimiter.isascii():
        fields = _fields(value, delimiter)
        size = F.size(fields)
        return size, F.get(fields, F.lit(0)), F.get(fields, size - 2), F.get(fields, size - 1)
    body = F.rtrim(value, F.lit(delimiter)) if delimiter != " " else F.rtrim(value)
    between = F.octet_length(body) - F.octet_length(F.replace(body, F.lit(delimiter), F.lit("")))
    first, last, two = (F.substring_index(body, delimiter, n) for n in (1, -1, -2))
    return F.when(body == "", 0).otherwise(between + 1), first, F.substring_index(two, delimiter, 1), last


def _lines(spark: SparkSession, path: str, delimiter: str, boundary: str) -> tuple[DataFrame, Column, Column, Column]:
    """The lines of pair files, which of them end a sentence, which hold a token, and their fields' number."""
    size, first, _, _ = _parts(F.col("value"), delimiter)
    breaks = (size == 0) | (first == boundary)
    return read_lines(spark, path), breaks, F.lit(True), size


def index_pairs(spark: SparkSession, path: str, folder: str, delimiter: str = " ", boundary: str = BOUNDARY) -> None:
    """Count the splits of pair files once, for ``read_pairs(index=folder)``.

    The counts hold for these files and the settings that cut them, such as
    ``spark.sql.files.maxPartitionBytes``.
    """
    split_index(*_lines(spark, path, delimiter, boundary)).write.parquet(folder)


def read_pairs(
    spark: SparkSession, path: str, delimiter: str = " ", boundary: str = BOUNDARY, strict: bool = True,
    index: str | None = None,
) -> DataFrame:
    """``pairs(file, sent_id, tok_id, token, gold, guess)``.

    A blank line, or one whose first field is ``boundary``, ends the sentence. A
    line with a single field is an error, and so is, unless ``strict`` is off, a line that
    is not blank and has not as many fields as the file's first one. ``token`` is the first
    field, NULL if the line has only the tags. ``index`` is a folder of ``index_pairs``; without
    it the files are scanned twice.
    """
    known = spark.read.schema(INDEX).parquet(index) if index else None
    if known is not None and not strict:
        known = known.withColumns({name: F.lit(None).cast("bigint") for name in ("first_width", "least_width", "most_width")})
    lines, breaks, is_token, width = _lines(spark, path, delimiter, boundary)
    rows = number_sentences(lines, breaks, is_token, width if strict else None, known)
    size, first, gold, guess = _parts(F.col("value"), delimiter)
    checked = F.when(
        size < 2,
        F.raise_error(F.concat(F.lit("unexpected number of fields in line: "), "value")).cast("string"),
    ).otherwise(gold)
    return rows.select(
        "file",
        "sent_id",
        "tok_id",
        F.when(size > 2, first).alias("token"),
        checked.alias("gold"),
        guess.alias("guess"),
    )


def check_width(
    spark: SparkSession, path: str, delimiter: str = " ", strict: bool = False
) -> DataFrame:
    """Lines per file and field count, ``ok`` where it is that of the first line.

    Blank lines do not count. ``strict`` fails on a line that is not ``ok``.
    """
    c = F.col
    lines = (
        read_lines(spark, path)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("width", F.size(_fields(c("value"), delimiter)))
        .where("width > 0")
    )
    # At most one row per file and width is left after the first step.
    counts = lines.groupBy("file", "width").agg(
        F.count("*").alias("lines"), F.min(F.struct("start", "at")).alias("first")
    ).withColumn("file", decoded(c("file")))
    first = counts.groupBy("file").agg(F.min_by("width", "first").alias("expected"))
    ok = c("width") == c("expected")
    if strict:
        message = F.concat(
            F.lit("unexpected number of fields: "), c("width").cast("string"), F.lit(" ("),
            c("expected").cast("string"), F.lit(") in "), c("file"),
        )
        ok = F.when(ok, True).otherwise(F.raise_error(message).cast("boolean"))
    return counts.join(first, "file").select(
        "file", c("width").cast("bigint").alias("width"), "lines", ok.alias("ok")
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Lines ``token gold guess`` with a boundary line after each sentence.

    Sentences come together for it: those that already are by document or sentence stay there.
    """
    c = F.col
    line = F.concat_ws(" ", F.coalesce("token", F.lit("_")), "gold", "guess")
    own = F.struct(c("tok_id").cast("bigint").alias("tok_id"), line.alias("line"))
    end = F.struct((c("tok_id") + 1).cast("bigint").alias("tok_id"), F.lit("").alias("line"))
    after = F.lead(F.lit(1)).over(Window.partitionBy("doc_id", "sent_id").orderBy("tok_id"))
    rows = pairs.select("doc_id", "sent_id", "tok_id", "token", "gold", "guess", after.alias("after"))
    lines = F.when(c("after").isNull(), F.array(own, end)).otherwise(F.array(own))
    return rows.select("doc_id", "sent_id", F.inline(lines))
