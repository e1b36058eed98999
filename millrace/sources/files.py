"""Files as tables: directory scans, JSON lines, question lists; and sinks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..scratch import written

#: Extensions that are taken in (fixed values).
EXTENSIONS = (".txt", ".md", ".docx", ".pdf", ".xlsx", ".html", ".htm")
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("filename", T.StringType()), T.StructField("modified", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def scan_directory(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files of a folder (not below it) with known extensions; a missing folder gives no rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], LISTING)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    rows = found.select("path", tx.extension(F.col("path")).alias("file_type"), tx.base_name(F.col("path")).alias("filename"), F.col("modificationTime").alias("modified"), "length", "content")
    return rows.where(F.col("file_type").isin(list(extensions)))


def latest_file(spark: SparkSession, pattern: str) -> DataFrame:
    """The newest file that a pattern names; ties go to the greater path."""
    found = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    return found.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).where("path is not null")


#: The sheet that is read where a query names none (fixed value).
DEFAULT_SHEET = "Sheet1"


def read_excel(spark: SparkSession, path: str, sheet: str | int = DEFAULT_SHEET) -> DataFrame:
    """One sheet of an Excel file as a table: the first row names the columns, blank cells are null.

    ``sheet`` is a name or a place from 0. A column whose cells are all numbers, texts of digits among them, is double (or
    long, where all are whole), one of dates a timestamp without zone, one of truth values
    boolean, any other text. An executor reads the file and writes its cells to the shared folder; the
    driver gets the header and the columns' kinds only.
    """
    from . import parsers

    files = spark.read.format("binaryFile").load(path).select("content")

    def cells(batches):
        for batch in batches:
            for content in batch.column(0):
                number, texts, kinds = 0, [], []
                for row in parsers.sheet_cells(content.as_py(), sheet):
                    texts.append([text or None for text, _ in row])
                    kinds.append([("n" if kind == "s" and parsers.number_or_none(text) is not None else kind) if text else None for text, kind in row])
                    if len(texts) == SHEET_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.string()))], names=["number", "cells", "kinds"])
                        number, texts, kinds = number + len(texts), [], []
                yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string())), pa.array(kinds, pa.list_(pa.string()))], names=["number", "cells", "kinds"])

    try:
        rows = written(files.mapInArrow(cells, "number long, cells array<string>, kinds array<string>"), "sheet")
    except Exception as why:  # an executor's own error comes in Spark's
        if "no sheet" in str(why):
            raise ValueError(f"no sheet {sheet!r}") from None
        if "PATH_NOT_FOUND" in str(why):
            raise FileNotFoundError(path) from None
        raise
    width = rows.agg(F.max(F.size("cells"))).first()[0] or 0
    head = rows.where("number = 0").first()
    names = parsers.column_names([*(head.cells if head else []), *[None] * (width - len(head.cells if head else []))])
    body = rows.where("number > 0")
    at = lambda i, of="cells": F.get(F.col(of), F.lit(i))
    whole = [F.bool_and(F.coalesce(at(i).rlike(r"^[+-]?\d{1,18}$"), F.lit(True))).alias(f"w{i}") for i in range(width)]
    found = body.agg(*(F.collect_set(at(i, "kinds")).alias(f"k{i}") for i in range(width)), *whole).first() if width else None
    kinds = {"n": lambda i: "long" if found[f"w{i}"] else "double", "d": lambda i: "timestamp_ntz", "b": lambda i: "boolean"}
    casts = [kinds.get(found[f"k{i}"][0], lambda i: "string")(i) if len(found[f"k{i}"]) == 1 else "string" for i in range(width)]
    return body.select(*(at(i).cast(kind).alias(name) for i, (name, kind) in enumerate(zip(names, casts, strict=True))))


#: Rows of a sheet that are handed on at once.
SHEET_ROWS = 1_000


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a schema; blank and malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Text lines as rows of a schema; blank and malformed ones are left out."""
    read = lines.where(F.length(F.trim(column)) > 0).where(F.expr(f"try_parse_json({column}) is not null"))
    return read.withColumn("_row", F.from_json(column, schema)).where("_row is not null").select(*(c for c in lines.columns if c != column), "_row.*")


def question_list(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither blank nor comments, stripped."""
    stripped = tx.stripped(F.col(column))
    return lines.withColumn(column, stripped).where((F.length(column) > 0) & ~F.col(column).startswith("#"))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header, as one file for each partition, each with the mark that tells spreadsheets its encoding (utf-8-sig)."""
    first, rest = df.columns[0], [F.col(f"`{c}`") for c in df.columns[1:]]
    df.select(F.col(f"`{first}`").alias(f"\ufeff{first}"), *rest).write.mode("overwrite").option("header", "true").csv(folder)


def write_json_lines(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Rows as JSON lines, nulls included, as one file for each partition."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(folder)


def append_log(df: DataFrame, folder: str, stamp: Column) -> None:
    """Append records as JSON lines in one folder for each UTC day."""
    df.withColumn("date", F.date_format(stamp, "yyyyMMdd")).write.mode("append").partitionBy("date").json(folder)


def write_log_batch(df: DataFrame, folder: str, stamp: Column, epoch: int) -> None:
    """Records as JSON lines in one folder for each UTC day within the batch's own; a batch that comes again replaces itself."""
    df.withColumn("date", F.date_format(stamp, "yyyyMMdd")).write.mode("overwrite").partitionBy("date").json(f"{folder}/epoch={epoch}")


def write_vectors(df: DataFrame, folder: str, partition: str | None = None) -> None:
    """Append vectors with flat metadata as Parquet."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(folder)
