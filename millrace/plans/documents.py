"""Elements, chunks and parsed pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import chunking
from ..session import table
from ..sources import parsers
from . import Catalogue

catalogue = Catalogue()
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SENTENCES = "list_filter([" + _STRIP.format("s") + " for s in regexp_extract_all({}, '[^。？！.!?]*[。？！.!?]|[^。？！.!?]+')], lambda s: length(s) > 0)"


@catalogue.add("normalize_text")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.normalized_text(F.col("text"))).alias("text_md5"))


@catalogue.add("normalize_text_ascii", "SELECT c_custkey, regexp_replace(lower(trim(c_name || '  ' || c_mktsegment)), '\\s+', ' ', 'g') AS name FROM customer")
def normalize_text_ascii(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", tx.normalized_text(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("name"))


@catalogue.add("sentence_split", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, chr(10))) AS sentences_md5 FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents)")
def sentence_split(spark, sf_dir):
    s = tx.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\n")).alias("sentences_md5"))


@catalogue.add("code_block_split", f"SELECT conv_id, turn, CAST(CASE WHEN len(p) > 1 THEN len(p) ELSE 1 END AS BIGINT) AS n, md5(CASE WHEN len(p) > 1 THEN array_to_string(p, '|') ELSE t END) AS blocks_md5 FROM (SELECT conv_id, turn, t, list_filter([{_STRIP.format('x')} for x in regexp_split_to_array(t, '\\n\\s*\\n')], lambda x: length(x) > 0) AS p FROM (SELECT conv_id, turn, replace(text, '. ', '.' || chr(10) || ' ' || chr(10)) AS t FROM conversations))")
def code_block_split(spark, sf_dir):
    t = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    blocks = tx.code_blocks(F.col("t"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", F.size(blocks).cast("long").alias("n"), F.md5(F.array_join(blocks, "|")).alias("blocks_md5"))


def _elements(spark, sf_dir):
    """Lines of documents; short ones are titles of level 1, 2 or 3."""
    lines = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    n = F.length("text")
    level = F.when(n < 60, 1).when(n < 100, 2).when(n < 140, 3)
    return lines.withColumn("level", level).withColumn("element_type", F.when(level.isNotNull(), "title").otherwise("narrative_text"))


_LINES = """lines AS (SELECT doc_id, source, lang, i - 1 AS idx, t[i] AS text FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
el AS (SELECT *, CASE WHEN length(text) < 60 THEN 1 WHEN length(text) < 100 THEN 2 WHEN length(text) < 140 THEN 3 END AS level FROM lines)"""


def _carried(n: int) -> str:
    last = f"last_value(CASE WHEN level <= {n} THEN {{'l': level, 't': text}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
    return f"CASE WHEN ({last}).l = {n} THEN ({last}).t END AS title_{n}"


@catalogue.add("title_hierarchy", f"WITH {_LINES}, h AS (SELECT doc_id, idx, {', '.join(map(_carried, (1, 2, 3)))} FROM el) SELECT doc_id, CAST(idx AS BIGINT) AS idx, md5(coalesce(title_1, '-') || '/' || coalesce(title_2, '-') || '/' || coalesce(title_3, '-')) AS titles_md5 FROM h")
def title_hierarchy(spark, sf_dir):
    out = chunking.title_hierarchy(_elements(spark, sf_dir))
    titles = F.concat_ws("/", *(F.coalesce(f"title_{n}", F.lit("-")) for n in (1, 2, 3)))
    return out.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5(titles).alias("titles_md5"))


_CHUNKS = f"""{_LINES}, parts AS (
  SELECT doc_id, source, lang, idx, unnest(range(len(p))) AS sub, unnest(p) AS chunk_text
  FROM (SELECT *, CASE WHEN length(text) > 1200 THEN {_SENTENCES.format('text')} ELSE [text] END AS p FROM el WHERE length({_STRIP.format('text')}) > 0)
), numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, sub) AS chunk_number FROM parts)"""


@catalogue.add("chunk_number", f"WITH {_CHUNKS} SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(sub AS BIGINT) AS sub, chunk_number FROM numbered")
def chunk_number(spark, sf_dir):
    return chunking.chunks(_elements(spark, sf_dir)).select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("sub").cast("long").alias("sub"), "chunk_number")


@catalogue.add("chunk_documents", f"WITH {_CHUNKS} SELECT doc_id, chunk_number, md5(doc_id || '_' || chunk_number) AS chunk_id, md5('[Source Document: ' || source || '] [Author: ' || lang || '] ' || chunk_text) AS text_md5 FROM numbered")
def chunk_documents(spark, sf_dir):
    out = chunking.chunks(_elements(spark, sf_dir), prefix=chunking.source_prefix(F.col("source"), F.col("lang")))
    return out.select("doc_id", "chunk_number", "chunk_id", F.md5("chunk_text").alias("text_md5"))


@catalogue.add("element_text", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN role = 'assistant' THEN '| ' || text || ' |' ELSE text || ';' END AS said FROM conversations")
def element_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    said = chunking.element_text(
        F.when(F.col("role") == "user", F.col("text")).otherwise(F.lit("  ")),
        F.when(F.col("role") == "assistant", F.concat(F.lit("| "), "text", F.lit(" |"))),
        F.concat("text", F.lit(";")),
    )
    return rows.select("conv_id", "turn", said.alias("said"))


@catalogue.add("linearize_elements", f"""WITH {_LINES} SELECT doc_id, md5({_STRIP.format("regexp_replace(string_agg(CASE WHEN level IS NULL THEN text || chr(10) ELSE repeat('#', level) || ' ' || text || chr(10) END, chr(10) ORDER BY idx), '\\n{3,}', chr(10) || chr(10), 'g')")}) AS text_md5 FROM el GROUP BY doc_id""")
def linearize_elements(spark, sf_dir):
    fields = F.struct("idx", "element_type", "text", "level", F.lit(None).cast("string").alias("language"))
    grouped = _elements(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(fields)).alias("elements"))
    return grouped.select("doc_id", F.md5(chunking.linearized(F.col("elements"))).alias("text_md5"))


_ROWS_MD = "SELECT p_partkey // 25 AS table_id, '| p_partkey | p_brand | p_size |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || p_partkey || ' | ' || p_brand || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY 1"


def _tables(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("table_id", F.floor(F.col("p_partkey") / 25).cast("long"))
    return chunking.to_markdown(parts, ["p_partkey", "p_brand", "p_size"], ["table_id"], "p_partkey")


@catalogue.add("rows_to_markdown", f"SELECT table_id, md5(markdown) AS markdown_md5 FROM ({_ROWS_MD})")
def rows_to_markdown(spark, sf_dir):
    return _tables(spark, sf_dir).select("table_id", F.md5("markdown").alias("markdown_md5"))


@catalogue.add("table_row_chunks", f"""WITH t AS (SELECT table_id, string_split(markdown, chr(10)) AS l FROM ({_ROWS_MD})),
s AS (SELECT table_id, l, unnest(range(0, len(l) - 2, 2)) AS start FROM t)
SELECT table_id, CAST(start AS BIGINT) AS start, CAST(least(start + 2, len(l) - 2) AS BIGINT) AS stop, l[1] || chr(10) || l[2] || chr(10) || array_to_string(l[start + 3:start + 4], chr(10)) AS chunk FROM s""")
def table_row_chunks(spark, sf_dir):
    out = _tables(spark, sf_dir).select("table_id", F.inline(chunking.table_row_chunks(F.col("markdown"))))
    return out.select("table_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "chunk")


@catalogue.add("xlsx_block_split", """WITH r AS (SELECT p_partkey // 100 AS sheet, p_partkey AS row, p_brand, p_size % 7 = 0 AS blank FROM part),
g AS (SELECT *, sum(blank::INT) OVER (PARTITION BY sheet ORDER BY row) AS gap FROM r)
SELECT sheet, row, p_brand, dense_rank() OVER (PARTITION BY sheet ORDER BY gap) - 1 AS block, row_number() OVER (PARTITION BY sheet, gap ORDER BY row) - 1 AS place FROM g WHERE NOT blank""")
def xlsx_block_split(spark, sf_dir):
    sheet = F.floor(F.col("p_partkey") / 100).cast("long")
    rows = table(spark, sf_dir, "part").select(sheet.alias("sheet"), F.col("p_partkey").alias("row"), "p_brand", "p_size")
    return chunking.row_blocks(rows, F.col("p_size") % 7 == 0, ["sheet"], "row").select("sheet", "row", "p_brand", "block", "place")


@catalogue.add("corpus_counts", "SELECT lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (length(text) > 1200) AS long_documents FROM documents GROUP BY lang")
def corpus_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.length("text") > 1200).alias("long_documents")
    )


@catalogue.add("metadata_flatten", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, '{\"kind\":\"' || event_type || '\"}' AS about, CASE WHEN user_id % 2 = 0 THEN event_type ELSE '' END AS even FROM events")
def metadata_flatten(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct(F.col("event_type").alias("kind")).alias("about"), F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("even"))
    return chunking.flat_metadata(rows).withColumn("event_id", F.col("event_id").cast("long"))


def _html(spark, sf_dir):
    """Pages, each with a table of its own values, code and a quotation more than it had."""
    table_html = F.concat(
        F.lit("<table><caption> page "), "page_id", F.lit("</caption><thead><tr><th>name</th><th> value </th></tr></thead><tbody><tr><td>id</td><td><b>"), "page_id",
        F.lit("</b></td></tr><tr><td>url</td><td>"), "url", F.lit("</td></tr></tbody></table><pre><code class='language-py'>x = 1</code></pre><blockquote>q</blockquote><hr></article>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</article>"), table_html).alias("content"))


@catalogue.add("html_elements")
def html_elements(spark, sf_dir):
    rows = parsers.parsed(_html(spark, sf_dir).withColumn("file_type", F.lit(".html")), "page_id", "content", "file_type")
    return rows.groupBy("page_id", "element_type").agg(F.count(F.lit(1)).alias("n"))


@catalogue.add("parse_files", "SELECT CAST(page_id AS VARCHAR) AS key, '| name | value |' || chr(10) || '| --- | --- |' || chr(10) || '| id | ' || page_id || ' |' || chr(10) || '| url | ' || url || ' |' AS markdown, 'page ' || page_id AS caption FROM pages WHERE html LIKE '%</article>%'")
def parse_files(spark, sf_dir):
    """The parsers as a table function, called from SQL."""
    parsers.register_function(spark)
    pages = _html(spark, sf_dir).select("page_id", "content")
    return spark.sql("SELECT key, markdown_representation AS markdown, caption FROM parse_files(TABLE(SELECT page_id, content, '.html' FROM {pages})) WHERE element_type = 'table'", pages=pages)


@catalogue.add("html_tables", "SELECT page_id, '| name | value |' || chr(10) || '| --- | --- |' || chr(10) || '| id | ' || page_id || ' |' || chr(10) || '| url | ' || url || ' |' AS markdown, 'page ' || page_id AS caption FROM pages WHERE html LIKE '%</article>%'")
def html_tables(spark, sf_dir):
    rows = parsers.parsed(_html(spark, sf_dir).withColumn("file_type", F.lit(".html")), "page_id", "content", "file_type")
    return rows.where("element_type = 'table'").select("page_id", F.col("markdown_representation").alias("markdown"), "caption")


@catalogue.add("markdown_elements", f"""WITH {_LINES}, t AS (SELECT doc_id, idx, level, regexp_replace({_STRIP.format('text')}, '\\s*#*$', '') AS said FROM el WHERE level IS NOT NULL AND length({_STRIP.format('text')}) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place, level, md5(said) AS text_md5 FROM t""")
def markdown_elements(spark, sf_dir):
    """Documents whose titles are written as Markdown headings: each title, in order, as the Markdown scan reads it back."""
    text = F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(0))), F.when(F.col("level").isNotNull(), F.lit(" ")).otherwise(F.lit("")), "text")
    rows = _elements(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", text.alias("t")))), lambda x: x["t"]), "\n\n").alias("content"))
    found = parsers.parsed(rows.withColumn("file_type", F.lit(".md")), "doc_id", "content", "file_type").where("element_type = 'title'")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return found.select("doc_id", place.cast("long").alias("place"), "level", F.md5("text").alias("text_md5"))


@catalogue.add("text_elements", f"SELECT doc_id, md5({_STRIP.format('text')}) AS text_md5 FROM documents")
def text_elements(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), F.lit(".txt").alias("file_type"))
    return parsers.parsed(rows, "doc_id", "content", "file_type").select("doc_id", F.md5("text").alias("text_md5"))
