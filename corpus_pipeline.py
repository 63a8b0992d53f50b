"""The corpus pipeline: quality rules, near-dedup, decontamination, secrets, token ids.

Each stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and
returns the columns of ``documents``; the last returns the documents' token ids.

Nulls and empty texts fail the quality rules and go there. Should a later stage be given
them: near-dedup keeps texts without words, decontamination and the secret scan find
nothing in them, and the last stage gives them no ids. Rows with equal ids are documents
of their own; of repeated rows and of near copies that share an id one stays as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanlake.llm import bpe, decontam, near_dups, quality, secret_scan
from spanlake.llm.queries import bpe_digests
from spanlake.sources.workspace import new_folder, stored

MASK = "[SECRET]"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judge(docs, labels).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (null: the largest).

    Documents are told apart by id and text; of rows that are equal in both, the one with the
    smallest other columns stays. Texts without words belong to no group and all stay.
    """
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), F.xxhash64("text"), F.xxhash64("text", F.lit(1))]
    names = ["__none", "__id", "__one", "__two"]
    key = F.struct(*(part.alias(name) for part, name in zip(parts, names)))
    found = near_dups.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    rows = F.when(F.max("n_shingles") == 0, 1).otherwise(F.count("*"))
    # Written, so that its size is known and decides how it is joined; few documents come twice.
    kept = stored(found.where("kept").groupBy("doc_id").agg(rows.alias("__rows")).select("doc_id.*", "__rows"), "kept")
    same = F.lit(True)
    for part, name in zip(parts, names):
        same = same & part.eqNullSafe(F.col(name))
    once = docs.join(stored(kept.where("__rows = 1"), "once"), same, "left_semi")
    twice = docs.join(stored(kept.where("__rows > 1"), "twice"), same, "inner")
    least = twice.groupBy(*names).agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return once.unionByName(least)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in windows of benchmark items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.match(docs, benchmark).where(~decontam.contaminated()).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked and ``n_chars`` counted again."""
    found = secret_scan.scan(docs)
    masked = secret_scan.masked(F.col("text"), F.col("spans"), MASK)
    some = F.size("spans") > 0
    text = F.when(some, masked).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn(
        "n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the digests of the ids and of the bytes they stand for."""
    encoded = bpe.encode(docs.select("doc_id", "text"))
    return bpe_digests(encoded.select("doc_id", "text", "ids", "decoded"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", token_ids),
]

# Minima of hashes, a language model and byte pair merges are beyond SQL; the tests hold
# the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
