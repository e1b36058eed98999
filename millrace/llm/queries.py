"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, divergence, embeddings, jaccard, language, ordinal, pii, repeats, sharding, token_counts, warc
from .common import scratch_path, table
from .sql import ORACLES

ENCODING = "byte_bpe_multi_50k.tiktoken"
COUNTING = "byte_bpe_50k.json"
ALIGNED_A, ALIGNED_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Toxic documents, others of low quality, others of high quality.
GRADES = 3
#: A document is toxic below this probability of a better grade, and kept from that of the best grade.
NOT_TOXIC, KEPT = 0.6, 0.6


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out("doc_id")))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.benchmark_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), drop=["text"])
    return hits.select(
        "doc_id", "n_words", decontaminate.hit_words().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    rated = docs.join(ordinal.sampled(labels).select("doc_id", grade.alias("grade")), "doc_id")
    model = ordinal.fit(rated, GRADES)
    tails = F.col("tail_probs")
    return ordinal.graded(docs, model).select(
        "doc_id", "expected_grade", tails[0].alias("prob_above_0"), tails[1].alias("prob_above_1"), (tails[1] >= KEPT).alias("kept"), (tails[0] < NOT_TOXIC).alias("toxic")
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(ENCODING)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.bpe_round_trip(docs, path, public_tokenizers.PATTERN, drop=["text"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def ids_digest() -> F.Column:
    return F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(table(spark, sf_dir, "documents"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hash_tree_shards(table(spark, sf_dir, "documents"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs, public_tokenizers.path(COUNTING), public_tokenizers.PATTERN)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), drop=["text"])
    counts = [F.size(pii.of_kind("base_spans", kind)).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.joined_spans("base_spans").cast("binary"), 256).alias("base_sha256"), pii.joined_spans("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("personal"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents").select("doc_id", "text"), map(public_tokenizers.path, (ALIGNED_A, ALIGNED_B))
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups.cast("binary"), 256))
    out = alignment.align_tokenizers(docs, *paths, public_tokenizers.PATTERN, drop=["text"], told=digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs.withColumn("n_bytes", n_bytes), min_bytes=400, drop=["text"]).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def queries() -> dict:
    own = (op1_language, op2_decontamination, op3_warc, op4_quality, op5_bpe, op6_jaccard, op7_shards, op8_embeddings, op9_token_counts, op10_pii, op11_alignment, op12_divergence, op13_suffix_dedup)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return ORACLES
