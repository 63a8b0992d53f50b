"""Text as characters."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CODE_POINTS = 0x110000

def _counts(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.explode(F.split(col, "")).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def char_inventory(df: DataFrame, col: str = "text") -> DataFrame:
    """Characters with their frequency and an id by falling frequency."""
    # At most one row per code point reaches this window.
    order = Window.orderBy(F.desc("n"), "char")
    counts = _counts(df, col).where(F.col("char") != "")
    return counts.withColumn("id", (F.row_number().over(order) - 1).cast("bigint"))


def char_coverage(df: DataFrame, vocab: DataFrame, col: str = "text") -> DataFrame:
    """Characters, those in ``vocab(char)``, and their share in percent."""
    counts = _counts(df, col).where(F.col("char") != "")
    known = vocab.select("char").distinct().withColumn("known", F.lit(True))
    return (
        counts.join(known, "char", "left")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("chars"),
            F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("covered"),
        )
        .withColumn(
            "share", F.when(F.col("chars") > 0, F.col("covered") * 100.0 / F.col("chars")).otherwise(0.0)
        )
    )


def char_sequences(
    df: DataFrame, length: int = 250, backward: bool = False, col: str = "text"
) -> DataFrame:
    """Cut each text into pieces of ``length`` characters, optionally reversed."""
    text = F.reverse(F.col(col)) if backward else F.col(col)
    cut = F.regexp_extract_all(text, F.lit(rf"(?s)(.{{1,{length}}})"), F.lit(1))
    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.posexplode(cut).alias("i", "chars")).select(
        *rest, F.col("i").cast("bigint").alias("piece"), "chars"
    )


def char_ids(df: DataFrame, vocab: DataFrame, unknown: int | None = None, col: str = "text") -> DataFrame:
    """Replace each text by ``ids``, an array with the id of every character.

    ``vocab(char, id)`` comes from ``char_inventory``; characters that it lacks get ``unknown``,
    by default the next free id. The vocabulary goes to every task as one table of the code
    points, so its size is bounded whatever the texts are. A null text stays null.
    """
    known = vocab.where(F.length("char") == 1).groupBy("char").agg(F.min("id").alias("id")).collect()
    if unknown is None:
        unknown = max((r.id for r in known), default=-1) + 1
    table = np.full(CODE_POINTS, unknown, np.int32)
    table[[ord(r.char) for r in known]] = [r.id for r in known]
    sent = df.sparkSession.sparkContext.broadcast(table)

    def encode(texts: pd.Series) -> pd.Series:
        table = sent.value
        return pd.Series([None if t is None else table[np.frombuffer(t.encode("utf-32-le"), "<u4")] for t in texts], dtype=object)

    rest = [c for c in df.columns if c != col]
    return df.select(*rest, F.pandas_udf(encode, "array<int>")(F.col(col)).alias("ids"))
