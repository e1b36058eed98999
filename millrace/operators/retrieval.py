"""Vector and keyword retrieval, and fusion of ranked lists."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from heapq import nsmallest
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from ..scratch import written
from .order import placed

#: BM25 and rank-fusion constants (fixed values).
K1, B, RRF_K = 1.5, 0.75, 60


# --- metadata filters -----------------------------------------------------------------

_OPERATORS = {
    "$eq": lambda c, v: c == F.lit(v),
    "$ne": lambda c, v: c != F.lit(v),
    "$gt": lambda c, v: c > F.lit(v),
    "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v),
    "$lte": lambda c, v: c <= F.lit(v),
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
    "$like": lambda c, v: c.like(v),
}


def where_column(where: dict) -> Column:
    """The condition of a filter tree of $and, $or, and {column: value or {operator: value}}."""
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [where_column(w) for w in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif isinstance(value, dict):
            parts += [_OPERATORS[op](F.col(f"`{key}`"), v) for op, v in value.items()]
        else:
            parts.append(F.col(f"`{key}`") == F.lit(value))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def merged_filter(user: dict | None, planned: dict | None) -> dict:
    """One tree from a user's ``must`` list and a planner's filter, each condition once."""
    import json

    found = []
    for entry in (user or {}).get("must", []):
        match = entry.get("match") if isinstance(entry, dict) else None
        if isinstance(match, dict) and "value" in match and entry.get("key"):
            found.append({entry["key"]: {"$eq": match["value"]}})
    if planned:
        found += planned["$and"] if "$and" in planned else [planned]
    unique = list({json.dumps(c, sort_keys=True): c for c in found}.values())
    return unique[0] if len(unique) == 1 else {"$and": unique} if unique else {}


# --- vectors --------------------------------------------------------------------------


def vector_topk(corpus: DataFrame, query: list[float], k: int = 5, where: dict | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows of a filtered corpus: key, distance (squared, of unit vectors), score."""
    kept = corpus.where(where_column(where)) if where else corpus
    q = F.lit([float(x) for x in query]).cast("array<double>")
    d = vectors.squared_l2(vectors.normalized(F.col(vector)), vectors.normalized(q))
    scored = kept.select(F.col(key), d.alias("distance"))
    return scored.orderBy("distance", key).limit(k).select(key, "distance", vectors.score_from_squared(F.col("distance")).alias("score"))


def vector_topk_batch(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id") -> DataFrame:
    """The ``k`` nearest rows for each of a stated set of queries: query_key, key, distance, place.

    The corpus passes once for each block of ``MAX_QUERIES`` queries, which are broadcast as
    one matrix; a task keeps only the ``k`` best for each query, of equal distances (to 12
    digits) those with the least keys, so that what is shuffled are k rows for each query
    and task. All query vectors pass through the driver, a block at a time. Rows without a
    vector, or with one of another length than the queries', are never near.
    """
    found = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).toLocalIterator()
    spec = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, corpus.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    rows, parts = corpus.select(F.col(key), F.col(vector).cast("array<double>").alias("v")), []
    while (block := list(islice(found, MAX_QUERIES))) or not parts:
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r.v), []).append((r.q, r.v))
        shared = corpus.sparkSession.sparkContext.broadcast({n: ([q for q, _ in own], vectors.unit_rows(np.array([v for _, v in own]))) for n, own in by_size.items()})
        parts.append(rows.mapInArrow(_nearest(shared, k, [to_arrow_type(f.dataType) for f in spec]), spec))
    best = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return best.withColumn("place", place).where(F.col("place") <= k)


def _nearest(shared, k: int, kinds: list):
    """A task's k best (query, key, distance) for each query of the block."""

    def run(batches):
        held = {n: [] for n in shared.value}
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
            for n, (_, unit) in shared.value.items():
                own = np.flatnonzero(sizes == n)
                for at in range(0, len(own), SLICE):
                    some = pa.array(own[at : at + SLICE])
                    x = pc.list_flatten(column.take(some)).to_numpy(zero_copy_only=False).reshape(-1, n)
                    u = vectors.unit_rows(x)
                    d = np.round((u * u).sum(1)[:, None] + (unit * unit).sum(1)[None, :] - 2 * (u @ unit.T), 12)
                    held[n] = _kept_best(held[n], keys.take(some).to_pylist(), np.maximum(d, 0.0), k)
        for n, (asked, _) in shared.value.items():
            rows = [(q, key, d) for q, best in zip(asked, held[n], strict=False) for d, key in best]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["q", "key", "distance"])

    return run


def _kept_best(best: list, keys: list, d: np.ndarray, k: int) -> list:
    """For each query the k least (distance, key), of those held and a slice's."""
    best = best or [[] for _ in range(d.shape[1])]
    bound = np.array([own[-1][0] if len(own) == k else np.inf for own in best])
    kth = np.partition(d, min(k, len(d)) - 1, 0)[min(k, len(d)) - 1]
    for i in np.flatnonzero(d.min(0) <= bound):
        near = np.flatnonzero(d[:, i] <= min(kth[i], bound[i]))
        best[i] = nsmallest(k, [*best[i], *((float(d[j, i]), keys[j]) for j in near)])
    return best


#: Queries of one block, and corpus rows that are compared with them at once.
MAX_QUERIES, SLICE = 1_000, 1_024


# --- keywords -------------------------------------------------------------------------

#: A token is a run of letters or digits, or of any character beyond ASCII; these characters stand between.
BETWEEN = "[^a-z0-9\\x{80}-\\x{10FFFF}]+"


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text, in order."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


class Bm25Index:
    """Postings (id, term, tf, dl), document lengths (id, dl) and terms (term, df) of a corpus."""

    def __init__(self, postings: DataFrame, lengths: DataFrame, terms: DataFrame):
        self.postings, self.lengths, self.terms = postings, lengths, terms

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text") -> Bm25Index:
        """The three tables of the documents whose text isn't blank.

        Texts are read and split once; each one's terms are counted where it is read, and written
        to the shared folder. Only where ids come more than once are counts summed by a shuffle.
        """
        kept = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("id"), tokens(F.col(text)).alias("words"))
        spec = T.StructType([T.StructField("id", kept.schema["id"].dataType), *(T.StructField(n, k) for n, k in (("term", T.StringType()), ("tf", T.LongType()), ("dl", T.LongType())))])
        rows = written(kept.mapInArrow(_counted, spec), "bm25-postings")
        lengths, postings = rows.where("term = ''").select("id", "dl"), rows.where("term <> ''")
        if lengths.groupBy("id", "dl").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):
            postings = postings.groupBy("id", "term", "dl").agg(F.sum("tf").alias("tf")).select("id", "term", "tf", "dl")
        return cls(postings, lengths, written(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "bm25-terms"))

    def with_df(self) -> DataFrame:
        """Postings with their term's number of documents.

        Many terms are dealt with the postings, which are looked up in hashed parts of the terms instead of being sorted.
        """
        few = self.terms.count() <= BROADCAST_TERMS
        return self.postings.join(F.broadcast(self.terms) if few else self.terms.hint("shuffle_hash"), "term")

    def write(self, path: str) -> None:
        """The index as three Parquet tables; postings are clustered by term for look-ups."""
        self.postings.repartition("term").sortWithinPartitions("term").write.parquet(f"{path}/postings")
        self.lengths.write.parquet(f"{path}/lengths")
        self.terms.write.parquet(f"{path}/terms")

    @classmethod
    def read(cls, spark, path: str) -> Bm25Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "lengths", "terms")))

    def search(self, queries: DataFrame, query_key: str = "query_id", query_text: str = "text") -> DataFrame:
        """(query_key, id, score) as ``bm25_scores`` gives it, from the index: no document's text is read."""
        wanted, terms = _wanted(queries, query_key, query_text)
        stats = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
        counted = self.postings.join(terms, "term")
        return _scored(counted, self.terms.join(terms, "term"), stats, wanted, query_key)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, term, tf, dl) of rows (id, words); a row of the term '' has a document's length alone."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            ids, lists = batch.slice(at, SLICE).columns
            n, sizes = len(ids), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            coded = lists.flatten().cast(pa.string()).dictionary_encode()
            keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), sizes)
            keys, counts = np.unique(keys, return_counts=True)
            place = np.concatenate([np.arange(n), keys % n])
            terms = pa.concat_arrays([pa.array([""] * n, pa.string()), coded.dictionary.take(pa.array(keys // n))])
            tf = np.concatenate([np.zeros(n, np.int64), counts.astype(np.int64)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(place)), terms, pa.array(tf), pa.array(sizes[place])], names=["id", "term", "tf", "dl"])


def _wanted(queries: DataFrame, query_key: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """The queries' (query_key, term), and all their terms, which are broadcast up to a number."""
    wanted = queries.select(F.col(query_key), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    terms = wanted.select("term").distinct()
    return wanted, F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms


def _scored(counted: DataFrame, df: DataFrame, stats: DataFrame, wanted: DataFrame, query_key: str) -> DataFrame:
    """Scores from (id, dl, term, tf), (term, df), one row (n, avgdl) and (query_key, term)."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.crossJoin(F.broadcast(stats)).select("term", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counted.join(weights, "term").join(wanted, "term").groupBy(query_key, "id").agg(F.sum(part).alias("score"))


def bm25_scores(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_key, id, score) of every document that shares a term with a query.

    The texts are read and split once. Only the queries' terms are counted, and those counts
    are written to the shared folder, while the corpus's size and mean length are observed
    in passing; the scores are made of the counts alone.
    """
    wanted, terms = _wanted(queries, query_key, query_text)
    seen = Observation()
    rows = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("id"), tokens(F.col(text)).alias("words"))
    rows = rows.select("id", "words", F.size("words").alias("dl")).observe(seen, F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    counted = rows.select("id", "dl", F.explode("words").alias("term")).join(terms, "term")
    counted = written(counted.groupBy("id", "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "bm25-counts")
    stats = docs.sparkSession.createDataFrame([(seen.get["n"], seen.get["avgdl"])], "n long, avgdl double")
    return _scored(counted, counted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), stats, wanted, query_key)


#: Distinct terms of the queries that are broadcast.
BROADCAST_TERMS = 100_000


def ranked(scores: DataFrame, k: int, by: list[str], key: str = "id", score: str = "score") -> DataFrame:
    """The ``k`` best of each group, best first, with a place from 1; ties go to the lesser key."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), key))
    return scores.withColumn("place", place).where(F.col("place") <= k)


# --- fusion ---------------------------------------------------------------------------


def union_sources(**lists: DataFrame) -> DataFrame:
    """Ranked lists in one frame, tagged by their names in ``source_type``."""
    tagged = [df.withColumn("source_type", F.lit(name)) for name, df in lists.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def rrf(hits: DataFrame, key: str = "id", by: list[str] = (), k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of rows (source_type, place, key): the sum of 1 / (k + place)."""
    return hits.groupBy(*by, key).agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))


def rrf_by_content(hits: DataFrame, by: list[str] = (), k: int = RRF_K, contents: bool = True) -> DataFrame:
    """Fusion where equal contents are one: rows (source_type, content, score), places by score.

    Places are given without a task that holds a source, on digests; ``contents`` are joined at the end.
    """
    keyed = hits.withColumn("content_hash", F.md5("content"))
    narrow = keyed.select(*by, "source_type", "content_hash", "score")
    places = placed(narrow, [*by, "source_type"], [(F.col("score"), True), (F.col("content_hash"), False)])
    fused = places.groupBy(*by, "content_hash").agg(F.sum(1.0 / (k + F.col("place"))).alias("score"))
    return fused.join(keyed.groupBy(*by, "content_hash").agg(F.min("content").alias("content")), [*by, "content_hash"]) if contents else fused


def hydrated(hits: DataFrame, store: DataFrame, key: str = "id", missing: str | None = None) -> DataFrame:
    """Hits with their contents; those the store lacks stay, with ``missing`` as text."""
    out = hits.join(store, key, "left")
    return out.withColumn("content", F.coalesce("content", F.lit(missing))) if missing is not None else out


def reattached(chunks: DataFrame, known: DataFrame, size: int, text: str = "chunk_text", vector: str = "embedding", order: str | None = None) -> DataFrame:
    """Chunks with the vector that is known for their text; without one a vector of ``size`` zeros.

    Of several vectors of one text the first by ``order`` counts. Texts meet by their digests.
    """
    own = known.where(F.col(text).isNotNull() & F.col(vector).isNotNull()).groupBy(F.md5(text).alias("_text"))
    by_text = own.agg((F.min_by(vector, order) if order else F.min(vector)).alias("_vector"))
    zeros = F.array_repeat(F.lit(0.0), size).cast(known.schema[vector].dataType)
    joined = chunks.drop(vector).withColumn("_text", F.md5(text)).join(by_text, "_text", "left")
    return joined.withColumn(vector, F.coalesce("_vector", zeros)).drop("_text", "_vector")


def fallback_sorted(docs: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The ``k`` best where no reranker answers: by the score they have, those without one last."""
    return docs.orderBy(F.col(score).desc_nulls_last(), key).limit(k)


def parents(chunks: DataFrame, parent: str = "parent_id", text: str = "chunk_text", order: str = "chunk_number", meta: list[str] = ()) -> DataFrame:
    """Parent documents: sorted chunk texts joined by blank lines, and the first chunk's metadata.

    A group is the chunks of one document, which a task holds at once.
    """
    return chunks.groupBy(parent).agg(
        F.array_join(F.sort_array(F.collect_list(text)), "\n\n").alias("parent_text"), *(F.min_by(m, order).alias(m) for m in meta)
    )


def small_to_big(hits: DataFrame, chunks: DataFrame, parent_docs: DataFrame, key: str = "id", parent: str = "parent_id", n: int = 5) -> DataFrame:
    """Parents of the hit chunks by their best chunk's score, at most ``n``; ties go to the lesser parent."""
    best = hits.join(chunks.select(key, parent), key).groupBy(parent).agg(F.max("score").alias("score"))
    return parent_docs.join(best.orderBy(F.desc("score"), parent).limit(n), parent)


def rerank_topn(docs: DataFrame, score: str, n: int = 5, key: str = "id") -> DataFrame:
    """The ``n`` best by a reranker's score, in which 0 and null count as -1."""
    s = F.col(score)
    effective = F.when(s.isNull() | (s == 0), F.lit(-1.0)).otherwise(s)
    return docs.orderBy(effective.desc(), key).limit(n)


def context_text(hits: DataFrame, by: list[str], order: list[str], source: str = "source_type", score: str = "score", content: str = "content") -> DataFrame:
    """One text for each group: source, score and content of its hits in order."""
    entry = F.concat(
        F.lit("Source Type: "), F.col(source), F.lit(", Score: "), F.when(F.col(score).isNotNull(), F.format_string("%.4f", F.col(score))).otherwise("N/A"), F.lit("\nContent: "), F.col(content)
    )
    rows = F.sort_array(F.collect_list(F.struct(*order, entry.alias("entry"))))
    joined = F.array_join(F.transform(rows, lambda r: r["entry"]), "\n\n---\n\n")
    return hits.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 0, joined).otherwise(F.lit("No context provided.")).alias("context"))


def summary_context(docs: DataFrame, by: list[str], order: str, name: str = "filename", summary: str = "summary", text: str = "content") -> DataFrame:
    """Summaries, or the first 500 characters of the text, as 《name》: summary, joined by blank lines.

    A group is the documents that were found for one question, some few.
    """
    own = F.coalesce(F.nullif(F.trim(F.col(summary)), F.lit("")), F.nullif(F.trim(F.substring(F.col(text), 1, 500)), F.lit("")))
    rows = F.sort_array(F.collect_list(F.when(own.isNotNull(), F.struct(order, F.concat(F.lit("《"), F.col(name), F.lit("》: "), own).alias("entry")))))
    return docs.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["entry"]), "\n\n").alias("context"))


# --- Markdown tables ------------------------------------------------------------------

SEPARATOR = "^\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?$"


def table_rows(text: Column) -> Column:
    """Rows of a Markdown table as arrays of trimmed cells, the header first, the separator left out."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.trim(line).startswith("|") & ~F.trim(line).rlike(SEPARATOR))
    return F.transform(lines, lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), "^\\||\\|$", ""), "\\|"), lambda cell: F.trim(cell)))


#: Answers and reasons of the dispatch (fixed values).
TABLE_ANSWER = "根据查找到的表格信息，'{row}'的'{column}'是'{value}'。"
NO_ROW = "在表格的'{key}'列中未能找到与'{row}'相关的行。"
NO_INSTRUCTION = "模型未能从问题中生成有效的表格查询指令。"
BAD_TABLE = "处理表格数据时遇到代码错误: {why}"
FEW_COLUMNS = "Table for QA must have at least two columns after processing."
NO_COLUMN = "Column '{column}' not found in table."
NO_DOCUMENTS = "知识库中未能找到任何与您问题相关的信息。"
NO_SUMMARIES = "虽然检索到了相关文档，但无法从中提炼出与您问题直接相关的核心信息。"
DOCUMENT_SAYS = "根据文档《{name}》的信息："
NO_NAME = "未知文档"


def table_cells(text: str) -> list[list[str]]:
    """Rows of a Markdown table as trimmed cells, the header first, separators left out."""
    lines = [line.strip() for line in text.split("\n")]
    return [[c.strip() for c in re.sub(r"^\||\|$", "", line).split("|")] for line in lines if "|" in line and not re.match(SEPARATOR, line)]


def table_answer(text: str, row: str | None, column: str | None) -> tuple[str | None, str | None]:
    """(answer, None) from a Markdown table, or (None, why there is none).

    The row is the first whose key cell the pattern ``row`` finds, the column the first whose
    name holds ``column`` or is held by it; both ignore case.
    """
    if row is None or column is None:
        return None, NO_INSTRUCTION
    cells = table_cells(text or "")
    header = cells[0] if cells else []
    if len(header) < 2:
        return None, BAD_TABLE.format(why=FEW_COLUMNS)
    name = column.lower()
    at = next((i for i, h in enumerate(header) if name in h.lower() or h.lower() in name), None)
    if at is None:
        return None, BAD_TABLE.format(why=NO_COLUMN.format(column=column))
    try:
        finds = re.compile(row, re.I).search
    except re.error as bad:
        return None, BAD_TABLE.format(why=bad)
    hit = next((r for r in cells[1:] if finds(r[0])), None)
    if hit is None:
        return None, NO_ROW.format(key=header[0], row=row)
    return TABLE_ANSWER.format(row=hit[0], column=header[at], value=hit[at] if at < len(hit) else ""), None


@F.pandas_udf(T.StructType([T.StructField("answer", T.StringType()), T.StructField("reason", T.StringType())]))
def _table_answers(text: pd.Series, row: pd.Series, column: pd.Series) -> pd.DataFrame:
    none = lambda x: None if x is None or x != x else x
    return pd.DataFrame([table_answer(none(t), none(r), none(c)) for t, r, c in zip(text, row, column, strict=True)], columns=["answer", "reason"], dtype=object)


def first_table(hits: DataFrame, by: list[str], place: str = "place", kind: str = "paragraph_type") -> DataFrame:
    """Of each question's hits the first that is a table, by place."""
    rest = [c for c in hits.columns if c not in by]
    first = hits.where(F.col(kind) == "table").groupBy(*by).agg(F.min_by(F.struct(*rest), F.col(place)).alias("hit"))
    return first.select(*by, "hit.*")


def dispatched(questions: DataFrame, hits: DataFrame, by: list[str], n: int = 5, name: str = "filename") -> DataFrame:
    """Each question's route, answer, failure reason and context.

    ``questions`` have the keys ``by``, row_identifier and column_identifier (what a model
    makes of the question, null if nothing); ``hits`` have the keys, place, paragraph_type,
    content, a file's name and a summary (null if the model finds nothing to say). The first
    hit that is a table is looked up; if there is none, or it doesn't answer, the context is
    made of the summaries of the first ``n`` hits. A question without hits says so. The hits
    are read twice, so they are written once to the shared folder.
    """
    hits = written(hits.select(*by, "place", "paragraph_type", "content", name, "summary"), "dispatch-hits")
    tables = first_table(hits, by).select(*by, F.col("content").alias("table_text"))
    found = questions.join(tables, by, "left").withColumn("found", _table_answers("table_text", "row_identifier", "column_identifier"))
    answer = F.when(F.col("table_text").isNotNull(), F.col("found.answer"))
    why = F.when(F.col("table_text").isNotNull(), F.col("found.reason"))
    said = F.concat(F.replace(F.lit(DOCUMENT_SAYS), F.lit("{name}"), F.coalesce(name, F.lit(NO_NAME))), F.col("summary"))
    entries = F.sort_array(F.collect_list(F.when(F.length("summary") > 0, F.struct("place", said.alias("entry")))))
    texts = hits.where(F.col("place") <= n).groupBy(*by).agg(F.array_join(F.transform(entries, lambda e: e["entry"]), "\n\n").alias("text"), F.lit(True).alias("any"))
    general = F.when(F.col("any").isNull(), NO_DOCUMENTS).when(F.length("text") == 0, NO_SUMMARIES)
    out = found.select(*by, answer.alias("answer"), why.alias("why")).join(texts, by, "left")
    is_table = F.col("answer").isNotNull()
    return out.select(
        *by, F.when(is_table, "table").otherwise("documents").alias("route"), "answer", F.when(~is_table, F.coalesce(general, "why")).alias("reason"),
        F.when(~is_table & general.isNull(), F.col("text")).alias("context"),
    )


#: Parts of the answer that a tool gives an agent (fixed values).
TOOL_ANSWER, TOOL_NOTHING, TOOL_SNIPPETS = "RAG Answer: ", "RAG service processed successfully but found no specific answer.", "\n\n\nSupporting Context Snippets (Top 2):"


def tool_answer(answer: Column, hits: Column, snippets: int = 2, chars: int = 100) -> Column:
    """A tool's text: the answer, and the first hits' source, score with two decimals and clipped content.

    ``hits`` is an array of structs with source_type, score and content.
    """
    entry = lambda h: F.concat(
        F.lit("  - Source: "), F.coalesce(h["source_type"], F.lit("N/A")), F.lit(", Score: "), F.when(h["score"].isNotNull(), F.format_string("%.2f", h["score"])).otherwise("N/A"),
        F.lit(", Content: "), F.substring(F.coalesce(h["content"], F.lit("N/A")), 1, chars), F.lit("..."),
    )
    lines = F.array_join(F.transform(F.slice(hits, 1, snippets), entry), "\n")
    shown = F.when(F.size(hits) > 0, F.concat(F.lit(TOOL_SNIPPETS + "\n"), lines)).otherwise(F.lit(""))
    return F.when(answer.isNull(), F.lit(TOOL_NOTHING)).otherwise(F.concat(F.lit(TOOL_ANSWER), F.trim(answer), shown))


def table_lookup(tables: DataFrame, text: str, row_id: Column, column_id: Column) -> Column:
    """The cell of the first row whose key contains ``row_id``, in the column that matches ``column_id``.

    Columns match if either name contains the other; all comparisons ignore case.
    """
    rows = table_rows(F.col(text))
    name = F.lower(column_id)
    at = F.array_position(F.transform(F.get(rows, F.lit(0)), lambda h: F.lower(h).contains(name) | name.contains(F.lower(h))), True)
    hit = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.lower(F.get(r, F.lit(0))).contains(F.lower(row_id)))
    return F.when((at > 0) & (F.size(hit) > 0), F.try_element_at(F.get(hit, F.lit(0)), at.cast("int")))
