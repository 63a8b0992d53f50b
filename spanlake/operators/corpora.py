"""Several corpora as one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def union_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """Concatenate token tables, naming each in ``data_set``."""
    if not corpora:
        raise ValueError("no corpora given")
    named = [df.withColumn("data_set", F.lit(name)) for name, df in corpora.items()]
    return reduce(DataFrame.unionByName, named)
