"""A corpus pipeline of five stages, each of which calls one operator of millrace.llm."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, jaccard, language, pii
from millrace.llm.common import remove_path, scratch_path, table, tidied
from millrace.llm.queries import ENCODING, ids_digest

#: Rows of an Arrow batch where the session has Spark's own number (10,000): whole texts, of which tasks, sockets and workers hold several batches.
BATCH_ROWS = 1_000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A document whose best language has a smaller share than this is rejected.
LEAST_LANGUAGE_SCORE = 0.3


class _Apart:
    """The documents with only the columns that an operator reads by their names, the others renamed
    so that none that the operator makes can clash with them."""

    def __init__(self, docs: DataFrame, *read: str):
        own = uuid.uuid4().hex
        self.names = {c: c if c in read else f"kept{i}_{own}" for i, c in enumerate(docs.columns)}
        self.docs = docs.toDF(*self.names.values())

    def back(self, df: DataFrame) -> DataFrame:
        """The documents' columns of ``df`` under their names, with n_chars as the text now is."""
        return df.select(*((F.length("text").cast("long") if c == "n_chars" else F.col(n)).alias(c) for c, n in self.names.items()))


def _small_batches(spark: SparkSession) -> None:
    """Each stage begins with it, as its tasks run after it has returned; a number that the session was given stays."""
    if spark.conf.get(_ROWS) == "10000":
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of which some language is recognised.

    Null and empty texts, and those without a letter, go; long texts are judged whole; ties
    between languages are recognised; repeated rows and rows with null ids are judged alike,
    but a null id is never learned from. Without any labelled row no language is recognised.
    """
    _small_batches(spark)
    model = language.fit(docs.where(~language.held_out("doc_id")))
    apart = _Apart(docs, "text")
    judged = language.identify(apart.docs, model)
    return apart.back(judged.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the least id.

    Null ids count as the greatest; of different texts under one id only near duplicates of
    others go; rows that agree in id and text are one document. Texts without words are near
    duplicates of nothing. Long texts are compared whole; an empty table stays empty.
    """
    _small_batches(spark)
    return jaccard.first_of_groups(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents and cuts what is left of benchmark windows out of the others.

    Null and empty texts stay as they are, long ones are matched whole, and repeated rows are
    treated alike; items that tie for a window count once. An empty table stays empty.
    """
    _small_batches(spark)
    apart = _Apart(docs, "text")
    return apart.back(decontaminate.decontaminated(apart.docs, table(spark, sf_dir, "benchmark")))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets, and keeps all documents.

    Null and empty texts stay as they are, long ones are read whole, and repeated rows are
    treated alike; where spans tie for a place the longest is replaced. An empty table stays
    empty.
    """
    _small_batches(spark)
    apart = _Apart(docs, "text")
    return apart.back(pii.without_personal_data(apart.docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, their number and digest, and whether they decode to its text.

    A null or empty text has no ids; long ones are encoded whole; repeated rows are encoded
    alike, and no two encodings tie. An empty table gives an empty one.
    """
    _small_batches(spark)
    path = public_tokenizers.path(ENCODING)
    encoded = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", ids_digest().alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("byte-level BPE", token_ids),
]

#: Learned language models and token ids are not for SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again.

    What a stage stored on its way is removed when its result is written, and that when the
    next one's is.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = scratch_path(spark, "stage")
        with tidied(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
