"""The registered queries of the operators; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanlake.llm import (
    alignment, bpe, chat, decontam, near_dups, ngram_scores, quality, repeats, secret_scan, substrings, token_counts, token_ids,
    whitening,
)
from spanlake.llm.shared import documents
from spanlake.sources.workspace import new_folder

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query
def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "token-ids")
    token_ids.write_ids(documents(spark, sf_dir), folder, ordinary=False)  # as the library's own call
    return token_ids.read_digests(spark, folder).withColumnRenamed("crc", "ids_crc32")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(bpe.encode(documents(spark, sf_dir).select("doc_id", "text")))


def bpe_digests(encoded: DataFrame, *more: str) -> DataFrame:
    return encoded.select(
        "doc_id", *more,
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), rule="most")


@query
def op2_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(documents(spark, sf_dir))


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = tuple(r.kind for r in secret_scan.BASE)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(joined(F.col("spans"), base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores.score(documents(spark, sf_dir))


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    chats = chat.format_chats(turns.unionByName(extra))
    digest = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat.loss_text(F.col("segments"))
    return chats.withColumn("turns", chat.read_turns(F.col("formatted"))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(digest, ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.match(documents(spark, sf_dir).select("doc_id", "text"), benchmark).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.judge(documents(spark, sf_dir).select("doc_id", "lang", "text"), labels, keep=("doc_id", "lang"))
    return judged.select("doc_id", *quality.METRICS, "base_failed", "kept", "score", "word_score", *quality.LIMITS)


@query
def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may part a character
    return repeats.remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed",
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.length(text).cast("bigint").alias("n_kept"),  # code points, as documents.n_chars
        text.alias("text"),
    )


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whitening.whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir))


@query
def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").alias("text")
    )
