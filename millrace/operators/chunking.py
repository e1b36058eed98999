"""Elements of documents, their titles' hierarchy, and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

#: Only longer elements are split into sentences; rows of a table in one chunk (fixed values).
SPLIT_CHARS, TABLE_ROWS = 1_200, 2


def element_text(text: Column, markdown: Column, code: Column) -> Column:
    """What an element says: its text, else its Markdown table, else its code; null if it has none."""
    pick = lambda c: F.nullif(tx.stripped(c), F.lit(""))
    return F.coalesce(pick(text), pick(markdown), pick(code))


def linearized(elements: Column) -> Column:
    """Markdown of an array of elements (element_type, text, level, language); at most one blank line in a row."""
    kind, body = "element_type", "text"
    line = lambda e: (
        F.when(e[kind] == "title", F.concat(F.repeat(F.lit("#"), F.coalesce(e["level"], F.lit(1))), F.lit(" "), e[body], F.lit("\n")))
        .when(e[kind] == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce(e["level"], F.lit(0))), F.lit("- "), e[body]))
        .when(e[kind] == "code_block", F.concat(F.lit("```"), F.coalesce(e["language"], F.lit("")), F.lit("\n"), e[body], F.lit("\n```\n")))
        .when(e[kind] == "page_break", F.lit("\n---\n"))
        .otherwise(F.concat(e[body], F.lit("\n")))
    )
    joined = F.array_join(F.transform(elements, line), "\n")
    return tx.stripped(F.regexp_replace(joined, "\\n{3,}", "\n\n"))


def title_hierarchy(elements: DataFrame, levels: int = 3, doc: str = "doc_id", order: str = "idx", level: str = "level", text: str = "text") -> DataFrame:
    """``elements`` with title_1 ... title_n: the titles above each element.

    A title of level L ends all titles of level L and deeper and is then the one of level L;
    ``level`` is null for elements that are no titles. A window is one document.
    """
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = elements
    for n in range(1, levels + 1):
        latest = F.last(F.when(F.col(level) <= n, F.struct(F.col(level).alias("l"), F.col(text).alias("t"))), ignorenulls=True).over(w)
        out = out.withColumn(f"title_{n}", F.when(latest["l"] == n, latest["t"]))
    return out


def table_row_chunks(table: Column, rows: int = TABLE_ROWS) -> Column:
    """(start, end, chunk) parts of a Markdown table: ``rows`` rows each, under the repeated header."""
    lines = F.split(tx.stripped(table), "\n")
    head, body = F.slice(lines, F.lit(1), F.lit(2)), F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0)))
    n = F.size(body)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(rows))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.least(s + rows, n).alias("end"), F.array_join(F.concat(head, F.slice(body, s + 1, F.lit(rows))), "\n").alias("chunk")),
    )


def chunks(elements: DataFrame, doc: str = "doc_id", order: str = "idx", prefix: Column | None = None, split_chars: int = SPLIT_CHARS) -> DataFrame:
    """Chunks of elements (element_type, text): tables by rows, long texts by sentences, others whole.

    Adds sub (place in the element), chunk_text, chunk_number (from 1 in each document) and
    chunk_id, which is a hash of document and number, so that it is the same in every run.
    """
    body = F.col("text")
    rows = F.transform(table_row_chunks(body), lambda c: c["chunk"])
    parts = F.when(F.col("element_type") == "table", F.when(F.size(rows) > 0, rows).otherwise(F.array(body)))
    parts = parts.when(F.length(body) > split_chars, tx.sentences(body)).otherwise(F.array(body))
    kept = elements.where(F.length(tx.stripped(body)) > 0)
    split = kept.select(*kept.columns, F.posexplode(parts).alias("sub", "chunk_text"))
    if prefix is not None:
        split = split.withColumn("chunk_text", F.concat(prefix, F.col("chunk_text")))
    number = F.row_number().over(Window.partitionBy(doc).orderBy(order, "sub"))
    return split.withColumn("chunk_number", number.cast("long")).withColumn("chunk_id", F.md5(F.concat_ws("_", F.col(doc).cast("string"), F.col("chunk_number").cast("string"))))


def source_prefix(filename: Column, author: Column) -> Column:
    """[Source Document: f] and, if known, [Author: a], each followed by a space."""
    return F.concat(F.lit("[Source Document: "), filename, F.lit("] "), F.when(F.length(author) > 0, F.concat(F.lit("[Author: "), author, F.lit("] "))).otherwise(F.lit("")))


def markdown_row(columns: list[Column]) -> Column:
    """A row of a pipe table; nulls are empty cells."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), F.lit(" |"))


def to_markdown(df: DataFrame, columns: list[str], by: list[str], order: str, out: str = "markdown") -> DataFrame:
    """One pipe table for each group of rows, header and separator first."""
    head = "| " + " | ".join(columns) + " |\n|" + "|".join(["---"] * len(columns)) + "|\n"
    rows = F.sort_array(F.collect_list(F.struct(order, markdown_row([F.col(c) for c in columns]).alias("line"))))
    return df.groupBy(*by).agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias(out))


def row_blocks(rows: DataFrame, blank: Column, by: list[str], order: str) -> DataFrame:
    """Rows of a sheet that aren't blank, with the number of their block (from 0) and their place in it (0: the header)."""
    before = F.sum(blank.cast("int")).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_gap", before).where(~blank)
    block = F.dense_rank().over(Window.partitionBy(*by).orderBy("_gap")) - 1
    place = F.row_number().over(Window.partitionBy(*by, "_gap").orderBy(order)) - 1
    return kept.withColumn("block", block.cast("long")).withColumn("place", place.cast("long")).drop("_gap")


def flat_metadata(df: DataFrame) -> DataFrame:
    """Columns as a vector store keeps them: nested values as JSON text, nulls as empty texts."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = f.dataType.typeName() in ("array", "map", "struct")
        out.append((F.coalesce(F.to_json(c), F.lit("")) if nested else F.coalesce(c.cast("string"), F.lit(""))).alias(f.name))
    return df.select(*out)
