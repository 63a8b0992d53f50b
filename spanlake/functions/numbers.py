"""Clipping, percentages and fixed-point formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def clip(col: Column, lo, hi) -> Column:
    return F.when(col < lo, F.lit(lo)).when(col > hi, F.lit(hi)).otherwise(col)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, 0 when the whole is 0."""
    return F.when(whole > 0, 100 * part.cast("double") / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    both = precision + recall
    return F.when(both > 0, 2 * precision * recall / both).otherwise(F.lit(0.0))


def round2(col: Column) -> Column:
    """Two decimals, halves to even."""
    return F.rint(col * 100) / 100


def with_fixed2(df: DataFrame, names: Sequence[str], width: int = 6) -> DataFrame:
    """Replace values in 0..100 by their text with two decimals, right-aligned.

    Rounds the exact binary value, as C's ``%.2f`` does; ``format_string``
    rounds the shortest decimal spelling and differs on halves. A double in
    this range times a power of two is an exact bigint, and decimal(38,0)
    arithmetic on it is exact too.
    """

    def long(value: int) -> Column:
        return F.lit(value).cast("decimal(19,0)")

    def each(make) -> dict[str, Column]:
        return {n: make(F.col(n)) for n in names}

    def per_value(make) -> dict[str, Column]:
        return {f"{n}_{part}": col for n in names for part, col in make(n).items()}

    fine = {n: F.col(n) < 0.125 for n in names}
    df = df.withColumns(
        per_value(
            lambda n: {
                "scaled": (F.col(n) * F.when(fine[n], float(2**62)).otherwise(float(2**55)))
                .cast("bigint").cast("decimal(19,0)") * 100,
                "unit": F.when(fine[n], long(2**62)).otherwise(long(2**55)),
            }
        )
    ).withColumns(
        per_value(
            lambda n: {
                "whole": F.floor(F.col(f"{n}_scaled") / F.col(f"{n}_unit")).cast("bigint"),
                "twice": F.col(f"{n}_scaled") % F.col(f"{n}_unit") * 2,
            }
        )
    )
    cents = {
        n: F.col(f"{n}_whole")
        + (
            (F.col(f"{n}_twice") > F.col(f"{n}_unit"))
            | ((F.col(f"{n}_twice") == F.col(f"{n}_unit")) & (F.col(f"{n}_whole") % 2 == 1))
        ).cast("bigint")
        for n in names
    }
    text = each(
        lambda c: F.lpad(
            F.concat((c.cast("bigint") / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")),
            width,
            " ",
        )
    )
    extra = [f"{n}_{part}" for n in names for part in ("scaled", "unit", "whole", "twice")]
    return df.withColumns(cents).withColumns(text).drop(*extra)
