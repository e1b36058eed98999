"""Retrieval over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import models, vectors
from ..operators import keywords
from ..operators import retrieval as r
from ..operators import segmentation
from ..operators import vector_index
from ..scratch import scratch_folder
from ..session import table
from . import Catalogue

catalogue = Catalogue()
#: Vectors whose dot product with themselves isn't exactly 1 are scaled in both engines.
_UNIT = "[x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) for x in CAST(embedding AS DOUBLE[])]"
_SQL_VECTORS = f"u AS (SELECT vec_id, label, {_UNIT} AS u FROM embeddings), q AS (SELECT vec_id AS query_id, u AS v FROM u WHERE vec_id % 100 = 0)"
_D2 = "list_sum([power(p[1] - p[2], 2) for p in list_zip(u, v)])"
_TOK = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"


def _probe(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").first().embedding


@catalogue.add("vector_topk", f"WITH {_SQL_VECTORS} SELECT vec_id, round({_D2}, 6) AS distance, round(1 - {_D2} / 2, 6) AS score FROM u, (SELECT v FROM q WHERE query_id = 0) ORDER BY {_D2}, vec_id LIMIT 5")
def vector_topk(spark, sf_dir):
    found = r.vector_topk(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir))
    return found.select("vec_id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@catalogue.add("vector_topk_filtered", f"WITH {_SQL_VECTORS} SELECT vec_id, round({_D2}, 6) AS distance FROM u, (SELECT v FROM q WHERE query_id = 0) WHERE label IN (1, 2) AND vec_id >= 10 ORDER BY {_D2}, vec_id LIMIT 8")
def vector_topk_filtered(spark, sf_dir):
    where = r.merged_filter({"must": [{"key": "nothing"}]}, {"$and": [{"label": {"$in": [1, 2]}}, {"vec_id": {"$gte": 10}}]})
    return r.vector_topk(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 8, where).select("vec_id", F.round("distance", 6).alias("distance"))


@catalogue.add("vector_topk_batch", f"WITH {_SQL_VECTORS} SELECT query_id, vec_id, round({_D2}, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {_D2}, vec_id) AS place FROM u, q QUALIFY place <= 5")
def vector_topk_batch(spark, sf_dir):
    corpus = table(spark, sf_dir, "embeddings")
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = r.vector_topk_batch(corpus.select("vec_id", "embedding"), queries, 5)
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"))


def _vector_index(spark, sf_dir):
    """A written index of the embeddings, and a hundredth of them as queries."""
    corpus, folder = table(spark, sf_dir, "embeddings"), scratch_folder(spark, "vector-index")
    vector_index.VectorIndex.build(corpus, keep=["label"]).write(folder)
    queries = corpus.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector_index.VectorIndex.read(spark, folder), corpus, queries


@catalogue.add("vector_index_search")
def vector_index_search(spark, sf_dir):
    """Near rows by the index, and whether the scan of all rows has them among its ten, too."""
    index, corpus, queries = _vector_index(spark, sf_dir)
    true = r.vector_topk_batch(corpus.select("vec_id", "embedding"), queries, 10).select("query_id", "vec_id", F.lit(True).alias("true"))
    found = index.search(queries, 10).join(true, ["query_id", "vec_id"], "left")
    return found.select("query_id", "vec_id", F.round("distance", 6).alias("distance"), F.col("place").cast("long").alias("place"), F.coalesce("true", F.lit(False)).alias("among_ten"))


@catalogue.add("l2_normalize", f"WITH {_SQL_VECTORS} SELECT vec_id, unnest(range(64)) AS place, round(unnest(u), 6) AS value FROM u")
def l2_normalize(spark, sf_dir):
    u = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.normalized(F.col("embedding"))).alias("place", "value"))
    return u.select("vec_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@catalogue.add("vector_stats", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, NOT list_bool_or([x <> 0 for x in embedding]) AS is_zero, list_bool_or([isnan(x) for x in embedding]) AS has_nan FROM embeddings")
def vector_stats(spark, sf_dir):
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.size(v).cast("long").alias("n"), F.round(vectors.norm(v), 6).alias("norm"),
        F.forall(v, lambda x: x == 0).alias("is_zero"), F.exists(v, F.isnan).alias("has_nan"),
    )


@catalogue.add("score_from_distance", f"WITH {_SQL_VECTORS} SELECT vec_id, round(CASE WHEN {_D2} > 2 THEN 0 ELSE 1 - {_D2} / 2 END, 6) AS cosine_score, round(1 / (1 + sqrt({_D2})), 6) AS inverse_score FROM u, (SELECT v FROM q WHERE query_id = 0)")
def score_from_distance(spark, sf_dir):
    q = F.lit([float(x) for x in _probe(spark, sf_dir)]).cast("array<double>")
    d = vectors.squared_l2(vectors.normalized(F.col("embedding")), vectors.normalized(q))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", d.alias("d"))
    return rows.select("vec_id", F.round(vectors.score_from_squared(F.col("d")), 6).alias("cosine_score"), F.round(vectors.score_from_distance(F.sqrt("d")), 6).alias("inverse_score"))


_BM25 = f"""
t AS (SELECT doc_id, {_TOK} AS w FROM documents WHERE length(trim(text)) > 0),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM t),
p AS (SELECT doc_id, len(w) AS dl, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS term FROM benchmark),
s AS (
  SELECT query_id, doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM q JOIN p USING (term) JOIN f USING (term), stats GROUP BY ALL
), b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM s)
"""


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _keyword_hits(spark, sf_dir, k):
    return keywords.block_search(table(spark, sf_dir, "documents"), _queries(spark, sf_dir), k)


@catalogue.add("bm25_index", f"WITH {_BM25} SELECT term, doc_id AS id, tf, CAST(dl AS BIGINT) AS dl, df FROM p JOIN f USING (term)")
def bm25_index(spark, sf_dir):
    """Every posting, with its document's length and its term's number of documents."""
    return r.Bm25Index.build(table(spark, sf_dir, "documents")).with_df().select("term", "id", "tf", "dl", "df")


@catalogue.add("bm25_index_search", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score FROM b WHERE place <= 5")
def bm25_index_search(spark, sf_dir):
    """The same hits as the scan's, from a written index."""
    folder = scratch_folder(spark, "bm25-index")
    keywords.BlockIndex.build(table(spark, sf_dir, "documents")).write(folder)
    hits = keywords.BlockIndex.read(spark, folder).search(_queries(spark, sf_dir), 5)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"))


@catalogue.add("bm25_topk", f"WITH {_BM25} SELECT id, round(score, 6) AS score, place FROM b WHERE query_id = 0 AND place <= 10")
def bm25_topk(spark, sf_dir):
    one = _queries(spark, sf_dir).where("query_id = 0")
    return keywords.block_search(table(spark, sf_dir, "documents"), one, 10).select("id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@catalogue.add("bm25_topk_batch", f"WITH {_BM25} SELECT query_id, id, round(score, 6) AS score, place FROM b WHERE place <= 5")
def bm25_topk_batch(spark, sf_dir):
    return _keyword_hits(spark, sf_dir, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@catalogue.add("bm25_filtered", f"WITH {_BM25} SELECT query_id, id, round(round(score, 9), 6) AS score, place FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM s JOIN documents ON doc_id = id WHERE lang = 'de' AND n_chars >= 200) WHERE place <= 5")
def bm25_filtered(spark, sf_dir):
    """The best documents of those that a metadata filter leaves, by the whole corpus's statistics."""
    docs = table(spark, sf_dir, "documents")
    allowed = docs.where(r.where_column({"$and": [{"lang": "de"}, {"n_chars": {"$gte": 200}}]})).select(F.col("doc_id").alias("id"))
    hits = keywords.block_search(docs, _queries(spark, sf_dir), 5, allowed=allowed)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@catalogue.add("bm25_padded", rf"""WITH {_BM25}, x AS (SELECT item_id AS query_id, '7' || item_id || 'q ' || coalesce(regexp_extract(text, '^\S+'), '') AS text FROM benchmark),
xq AS (SELECT DISTINCT query_id, unnest({_TOK}) AS term FROM x),
xs AS (SELECT query_id, doc_id AS id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM xq JOIN p USING (term) JOIN f USING (term), stats GROUP BY ALL),
spare AS (SELECT doc_id AS id FROM t ORDER BY 1 LIMIT 600),
xa AS (SELECT query_id, id, score FROM xs UNION ALL SELECT query_id, spare.id, 0 FROM x, spare WHERE NOT EXISTS (FROM xs WHERE xs.query_id = x.query_id AND xs.id = spare.id))
SELECT query_id, id, round(round(score, 9), 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM xa) WHERE place <= 300""")
def bm25_padded(spark, sf_dir):
    """Questions of one word, filled up to 300 hits with documents of score 0."""
    asked = _queries(spark, sf_dir).select("query_id", F.concat(F.lit("7"), "query_id", F.lit("q "), F.regexp_extract("text", r"^\S+", 0)).alias("text"))
    hits = keywords.block_search(table(spark, sf_dir, "documents"), asked, 300, pad=True)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@catalogue.add("segment_words")
def segment_words(spark, sf_dir):
    """Benchmark items without their spaces, cut by the words of all documents, and how many words are found again."""
    counts = table(spark, sf_dir, "documents").select(F.explode(r.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    cut = segmentation.segmenter(spark, segmentation.from_words(counts), search=False, runs=segmentation.SPACED)
    true = r.tokens(F.col("text"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", true.alias("words"), cut(F.array_join(true, "")).alias("found"))

    def ends(words):  # where words end, in characters
        sizes = F.transform(words, F.length)
        return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, b: a + b))

    some = rows.where(F.size("words") > 0)
    right = F.size(F.array_intersect(ends(F.col("words")), ends(F.col("found")))).cast("long")
    return some.select("item_id", F.size("words").cast("long").alias("n_words"), F.size("found").cast("long").alias("n_found"), right.alias("n_right"), F.md5(F.array_join("found", " ")).alias("found_md5"))


# A query's vector is that of the embedding with its id.
_FUSED = f"""
{_BM25}, u AS (SELECT vec_id, {_UNIT} AS u FROM embeddings),
v AS (
  SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round({_D2}, 9), vec_id) AS place
  FROM u, (SELECT vec_id AS query_id, u AS v FROM u WHERE vec_id IN (SELECT item_id FROM benchmark)) QUALIFY place <= 10
),
h AS (SELECT query_id, id, place, 'keyword_bm25s' AS source_type FROM b WHERE place <= 10 UNION ALL SELECT query_id, id, place, 'vector_chromadb' FROM v),
fused AS (SELECT query_id, id, sum(1.0::DOUBLE / (60 + place)) AS score FROM h GROUP BY ALL)
"""


def _all_hits(spark, sf_dir):
    """Keyword and vector hits of every benchmark item, ten each."""
    corpus = table(spark, sf_dir, "embeddings")
    keys = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    queries = corpus.select(F.col("vec_id").alias("query_id"), "embedding").join(keys, "query_id", "left_semi")
    near = r.vector_topk_batch(corpus.select("vec_id", "embedding"), queries, 10)
    near = near.select("query_id", F.col("vec_id").alias("id"), "place")
    words = _keyword_hits(spark, sf_dir, 10).select("query_id", "id", "place")
    return r.union_sources(vector_chromadb=near, keyword_bm25s=words)


def _fused(spark, sf_dir):
    return r.rrf(_all_hits(spark, sf_dir), by=["query_id"])


@catalogue.add("union_sources", f"WITH {_FUSED} SELECT source_type, query_id, id, CAST(place AS BIGINT) AS place FROM h")
def union_sources(spark, sf_dir):
    return _all_hits(spark, sf_dir).select("source_type", "query_id", "id", F.col("place").cast("long").alias("place"))


@catalogue.add("rrf_fusion", f"WITH {_FUSED} SELECT query_id, id, round(score, 9) AS score FROM fused")
def rrf_fusion(spark, sf_dir):
    return _fused(spark, sf_dir).select("query_id", "id", F.round("score", 9).alias("score"))


@catalogue.add("rrf_by_content_hash", """
WITH h AS (SELECT 'a' AS source_type, text AS content, CAST(n_chars AS DOUBLE) AS score FROM documents WHERE source <> 'src0' UNION ALL SELECT 'b', text, CAST(-doc_id AS DOUBLE) FROM documents WHERE lang = 'en'),
p AS (SELECT md5(content) AS content_hash, row_number() OVER (PARTITION BY source_type ORDER BY score DESC NULLS LAST, md5(content)) AS place FROM h)
SELECT content_hash, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM p GROUP BY content_hash""")
def rrf_by_content_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a = docs.where("source <> 'src0'").select(F.col("text").alias("content"), F.col("n_chars").cast("double").alias("score"))
    b = docs.where("lang = 'en'").select(F.col("text").alias("content"), (-F.col("doc_id")).cast("double").alias("score"))
    return r.rrf_by_content(r.union_sources(a=a, b=b), contents=False).select("content_hash", F.round("score", 9).alias("score"))


def _store(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")


@catalogue.add("hydrate_join", f"WITH {_FUSED} SELECT query_id, id, round(score, 9) AS score, md5(text) AS content_md5, source FROM fused LEFT JOIN documents ON doc_id = id")
def hydrate_join(spark, sf_dir):
    out = r.hydrated(_fused(spark, sf_dir), _store(spark, sf_dir))
    return out.select("query_id", "id", F.round("score", 9).alias("score"), F.md5("content").alias("content_md5"), "source")


@catalogue.add("get_texts_by_ids", "SELECT CAST(i AS BIGINT) AS id, md5(coalesce(text, 'text not found')) AS content_md5 FROM (SELECT unnest([3, 5, 100000000]) AS i) LEFT JOIN documents ON doc_id = i")
def get_texts_by_ids(spark, sf_dir):
    wanted = spark.createDataFrame([(3,), (5,), (100_000_000,)], "id long")
    return r.hydrated(wanted, _store(spark, sf_dir), missing="text not found").select("id", F.md5("content").alias("content_md5"))


def _parents(spark, sf_dir):
    """Documents as chunks, twenty to a parent."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 20).cast("long").alias("parent_id"), F.md5("text").alias("chunk_text"), F.col("doc_id").alias("chunk_number"), "lang")
    return chunks, r.parents(chunks, meta=["lang"])


_PARENTS = "SELECT doc_id // 20 AS parent_id, string_agg(md5(text), chr(10) || chr(10) ORDER BY md5(text)) AS parent_text, arg_min(lang, doc_id) AS lang FROM documents GROUP BY 1"


@catalogue.add("parent_assembly", f"SELECT parent_id, md5(parent_text) AS text_md5, lang FROM ({_PARENTS})")
def parent_assembly(spark, sf_dir):
    return _parents(spark, sf_dir)[1].select("parent_id", F.md5("parent_text").alias("text_md5"), "lang")


@catalogue.add("small_to_big", f"""WITH {_FUSED}, best AS (SELECT doc_id // 20 AS parent_id, max(round(score, 9)) AS score FROM fused JOIN documents ON doc_id = id WHERE query_id = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
SELECT parent_id, score, md5(parent_text) AS text_md5 FROM best JOIN ({_PARENTS}) USING (parent_id)""")
def small_to_big(spark, sf_dir):
    chunks, docs = _parents(spark, sf_dir)
    hits = _fused(spark, sf_dir).where("query_id = 0").select("id", F.round("score", 9).alias("score"))
    return r.small_to_big(hits, chunks, docs).select("parent_id", "score", F.md5("parent_text").alias("text_md5"))


@catalogue.add("rerank_topn", "SELECT doc_id AS id, CAST(quality AS DOUBLE) AS score FROM labels ORDER BY CASE WHEN quality = 0 THEN -1 ELSE quality END DESC, doc_id LIMIT 5")
def rerank_topn(spark, sf_dir):
    docs = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("score"))
    return r.rerank_topn(docs, "score")


@catalogue.add("context_assembly", f"""WITH {_FUSED}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM fused QUALIFY place <= 3)
SELECT query_id, md5(string_agg('Source Type: fused, Score: ' || printf('%.4f', score) || chr(10) || 'Content: ' || coalesce(text, 'none'), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place)) AS context_md5
FROM best LEFT JOIN documents ON doc_id = id GROUP BY query_id""")
def context_assembly(spark, sf_dir):
    best = r.ranked(_fused(spark, sf_dir).withColumn("score", F.round("score", 9)), 3, ["query_id"])
    hits = r.hydrated(best, _store(spark, sf_dir).drop("source"), missing="none").withColumn("source_type", F.lit("fused"))
    return r.context_text(hits, ["query_id"], ["place"]).select("query_id", F.md5("context").alias("context_md5"))


@catalogue.add("summary_context", f"""WITH {_FUSED}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM fused QUALIFY place <= 3)
SELECT query_id, md5(string_agg('《' || lang || '》: ' || trim(substr(text, 1, 500)), chr(10) || chr(10) ORDER BY place)) AS context_md5 FROM best JOIN documents ON doc_id = id GROUP BY query_id""")
def summary_context(spark, sf_dir):
    """The summaries of each question's three best documents."""
    best = r.ranked(_fused(spark, sf_dir).withColumn("score", F.round("score", 9)), 3, ["query_id"])
    docs = best.join(table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id"), "id").withColumn("summary", F.lit(None).cast("string"))
    return r.summary_context(docs, ["query_id"], "place", name="lang", text="text").select("query_id", F.md5("context").alias("context_md5"))


@catalogue.add("request_cache_key", "SELECT item_id, md5('{\"item_id\":' || item_id || ',\"text\":' || to_json(text) || '}') AS cache_key FROM benchmark")
def request_cache_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.to_json(F.struct("item_id", "text"))).alias("cache_key"))


@catalogue.add("embed_reattach", """WITH known AS (SELECT text, arg_min(embedding, vec_id) AS e FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY text)
SELECT doc_id, round(coalesce(CAST(e[1] AS DOUBLE), 0), 6) AS first, round(coalesce(list_sum([CAST(x AS DOUBLE) * x for x in e]), 0), 5) AS square FROM documents LEFT JOIN known USING (text)""")
def embed_reattach(spark, sf_dir):
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    known = known.join(docs.select(F.col("doc_id").alias("vec_id"), F.col("text").alias("chunk_text")), "vec_id")
    out = r.reattached(docs.select("doc_id", F.col("text").alias("chunk_text")), known, 64, order="vec_id")
    v = F.col("embedding")
    return out.select("doc_id", F.round(v[0].cast("double"), 6).alias("first"), F.round(vectors.dot(v, v), 5).alias("square"))


@catalogue.add("fallback_sort", "SELECT doc_id AS id, score FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS score FROM documents) ORDER BY score DESC NULLS LAST, id LIMIT 600")
def fallback_sort(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("score"))
    return r.fallback_sorted(docs, 600)


_MD = "'| part | brand | size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey)"


def _part_tables(spark, sf_dir):
    """Twenty parts to a Markdown table."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "p_name", "p_brand", F.col("p_size").cast("string")), F.lit(" |"))
    rows = F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line"))))
    body = F.array_join(F.transform(rows, lambda x: x["line"]), "\n")
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).cast("long").alias("table_id")).agg(
        F.concat(F.lit("| part | brand | size |\n| --- | --- | --- |\n"), body).alias("text"), F.min_by("p_name", "p_partkey").alias("wanted")
    )


@catalogue.add("table_lookup", "SELECT p_partkey // 20 AS table_id, arg_min(p_name, p_partkey) AS wanted, arg_min(p_brand, p_partkey) AS answer FROM part GROUP BY 1")
def table_lookup(spark, sf_dir):
    tables = _part_tables(spark, sf_dir)
    return tables.select("table_id", "wanted", r.table_lookup(tables, "text", F.col("wanted"), F.lit("Brand name")).alias("answer"))


# Documents of two sources stand for tables: a row for the document's own size.
_DISPATCH = f"""{_FUSED}, best AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM fused QUALIFY place <= 5),
hits AS (SELECT best.*, source, lang, n_chars, CASE WHEN source IN ('src0', 'src1') THEN 'table' ELSE 'narrative_text' END AS kind, substr(trim(text), 1, 20) AS summary FROM best JOIN documents ON doc_id = id),
tables AS (SELECT query_id, arg_min(id, place) AS id, arg_min(n_chars, place) AS n_chars FROM hits WHERE kind = 'table' GROUP BY query_id)"""


def _dispatch_hits(spark, sf_dir):
    best = r.ranked(_fused(spark, sf_dir).withColumn("score", F.round("score", 9)), 5, ["query_id"])
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    content = F.concat(F.lit("| key | size |\n| --- | :-- |\n| other | 1 |\n| D"), "id", F.lit(" | "), "n_chars", F.lit(" |"))
    kind = F.when(F.col("source").isin("src0", "src1"), "table").otherwise("narrative_text")
    return best.join(docs, "id").select("query_id", "id", "place", kind.alias("paragraph_type"), content.alias("content"), F.col("lang").alias("filename"), F.substring(F.trim("text"), 1, 20).alias("summary"))


@catalogue.add("first_table_hit", f"WITH {_DISPATCH} SELECT query_id, id FROM tables")
def first_table_hit(spark, sf_dir):
    return r.first_table(_dispatch_hits(spark, sf_dir), ["query_id"]).select("query_id", "id")


@catalogue.add("retrieval_dispatch", f"""WITH {_DISPATCH}, texts AS (SELECT query_id, string_agg('根据文档《' || lang || '》的信息：' || summary, chr(10) || chr(10) ORDER BY place) AS context FROM hits GROUP BY query_id),
a AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 <> 0 AND t.id IS NOT NULL THEN '根据查找到的表格信息，''D' || t.id || '''的''size''是''' || n_chars || '''。' END AS answer, t.id IS NOT NULL AS has_table FROM benchmark LEFT JOIN tables t ON t.query_id = item_id)
SELECT query_id, CASE WHEN answer IS NULL THEN 'documents' ELSE 'table' END AS route, answer, CASE WHEN answer IS NULL THEN CASE WHEN context IS NULL THEN '知识库中未能找到任何与您问题相关的信息。' WHEN has_table THEN '在表格的''key''列中未能找到与''absent''相关的行。' END END AS reason, CASE WHEN answer IS NULL THEN context END AS context
FROM a LEFT JOIN texts USING (query_id)""")
def retrieval_dispatch(spark, sf_dir):
    """A third of the questions ask the table for a row that it lacks, and go on to the documents."""
    asked = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "absent").otherwise("^d[0-9]+$").alias("row_identifier"), F.lit("File Size").alias("column_identifier")
    )
    return r.dispatched(asked, _dispatch_hits(spark, sf_dir), ["query_id"])


@catalogue.add("tool_answer", f"""WITH {_DISPATCH} SELECT query_id, 'RAG Answer: ' || query_id || repeat(chr(10), 3) || 'Supporting Context Snippets (Top 2):' || chr(10) || string_agg('  - Source: ' || lang || ', Score: ' || printf('%.2f', 1.0::DOUBLE / place) || ', Content: ' || summary || '...', chr(10) ORDER BY place) AS said
FROM hits WHERE place <= 2 GROUP BY query_id""")
def tool_answer(spark, sf_dir):
    hits = _dispatch_hits(spark, sf_dir)
    one = F.struct("place", F.col("filename").alias("source_type"), (1 / F.col("place")).alias("score"), F.col("summary").alias("content"))
    grouped = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("hits"))
    return grouped.select("query_id", r.tool_answer(F.concat(F.lit(" "), F.col("query_id").cast("string")), F.col("hits")).alias("said"))


@catalogue.add("embed_texts", "SELECT item_id, CAST(length(text) AS DOUBLE) AS size, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS es FROM benchmark")
def embed_texts(spark, sf_dir):
    """A registered embedding function over texts, in batches."""
    models.register_embedder("letters", lambda texts: [[len(t), t.count("e")] for t in texts])
    rows = table(spark, sf_dir, "benchmark").select("item_id", models.embedded(F.col("text"), "letters", 7).alias("v"))
    return rows.select("item_id", F.col("v")[0].cast("double").alias("size"), F.col("v")[1].cast("double").alias("es"))


@catalogue.add("hybrid_top5", f"""WITH {_FUSED} SELECT query_id, id, round(score, 9) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS place FROM fused) WHERE place <= 5""")
def hybrid_top5(spark, sf_dir):
    best = r.ranked(_fused(spark, sf_dir).withColumn("score", F.round("score", 9)), 5, ["query_id"])
    return best.select("query_id", "id", "score", F.col("place").cast("long").alias("place"))
