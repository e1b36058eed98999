"""Keyword search (BM25) that passes over what can't come among the best.

Documents are indexed in blocks, made where the documents are read. For each term a block
holds its places with their counts, and bounds of the greatest weight the term has there. A search
adds up bounds first: a block whose bounds don't reach a query's k-th score so far isn't scored for
it, and within a block only documents are followed that the terms left can still lift to that score.
The hits are those of scoring everything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import nsmallest
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import written
from .retrieval import BROADCAST_TERMS, K1, MAX_QUERIES, B, tokens

#: Documents of a block at most; places within a block are 16-bit numbers.
BLOCK_DOCS = 1_024
#: Blocks of so many bytes are sorted together by term before they are written; bounds what a task holds.
RUN_BYTES = 16 << 20
#: One block in so many is searched first, for a k-th score to begin with.
FIRST_SHARE = 16
#: Digits to which scores are told; equal ones go by id.
DIGITS = 9
_SLACK = 10.0 ** (1 - DIGITS)


@dataclass(frozen=True)
class BlockIndex:
    """Rows (block, term, n, most, least, total, places, counts, ids), one for each block and term.

    ``n`` documents have the term, ``most`` times at most; the shortest has ``least`` tokens. The
    row of the term '' has all documents of the block: their ids, and their lengths as counts.
    """

    blocks: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, key: str = "doc_id", text: str = "text", words: Callable[[Column], Column] | None = None, only: list[str] | None = None) -> BlockIndex:
        """The index of the documents whose text isn't blank, made in one pass without a shuffle.

        ``words`` gives a text's tokens; with ``only`` other terms are left out.
        """
        rows = docs.where(F.length(F.trim(F.col(text))) > 0).select(F.col(key).alias("id"), (words or tokens)(F.col(text)).alias("words"))
        kind = rows.schema["id"].dataType
        spec = T.StructType(
            [T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("most", T.IntegerType())]
            + [T.StructField("least", T.IntegerType()), T.StructField("total", T.LongType()), T.StructField("places", T.ArrayType(T.ShortType()))]
            + [T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(kind))]
        )
        shared = rows.sparkSession.sparkContext.broadcast(only)
        return cls(rows.mapInArrow(_blocks(shared, to_arrow_type(kind)), spec))

    def write(self, path: str) -> None:
        """The index as Parquet; a task's rows come in runs that are each sorted by term."""
        self.blocks.write.parquet(path)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockIndex:
        return cls(spark.read.parquet(path))

    def documents(self) -> DataFrame:
        """(block, place, id) of the indexed documents."""
        return self.blocks.where("term = ''").select("block", F.posexplode("ids").alias("place", "id"))

    def weights(self, queries: DataFrame, query_key: str, query_text: str, words: Callable[[Column], Column] | None = None) -> tuple[DataFrame, float]:
        """(query_key, terms: term and weight) of the queries whose terms the index has, and the mean length."""
        wanted = queries.select(F.col(query_key), F.explode(F.array_distinct((words or tokens)(F.col(query_text)))).alias("term"))
        terms = written(wanted.select("term").distinct(), "keyword-terms")
        some = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
        n, total = self.blocks.where("term = ''").agg(F.sum("n"), F.sum("total")).first()
        df = self.blocks.select("term", "n").join(some, "term").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = wanted.join(df.select("term", idf.alias("weight")), "term")
        return rows.groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms")), (total or 0) / (n or 1)

    def search(
        self, queries: DataFrame, k: int, query_key: str = "query_id", query_text: str = "text", words: Callable[[Column], Column] | None = None, allowed: DataFrame | None = None, pad: bool = False
    ) -> DataFrame:
        """The ``k`` best documents of each query: (query_key, id, score, place), scores to nine digits.

        With ``allowed``, a table (id), only those documents are hits; numbers of documents and
        mean length stay those of the index. With ``pad`` a query gets further documents of score
        0, by id, until it has ``k``. Queries are broadcast in blocks.
        """
        out = self._searched(queries, k, query_key, query_text, words, allowed).where("scored is null").drop("scored")
        hits = _best(out, k, query_key)
        return hits if not pad else self._padded(hits, queries.select(query_key).distinct(), k, query_key, allowed)

    def scored_pairs(self, queries: DataFrame, k: int, query_key: str = "query_id", query_text: str = "text") -> DataFrame:
        """(query_key, scored): for how many documents a search makes the whole score."""
        return self._searched(queries, k, query_key, query_text, None, None).where("scored is not null").groupBy(query_key).agg(F.sum("scored").alias("scored"))

    def _searched(self, queries, k, query_key, query_text, words, allowed) -> DataFrame:
        spark = queries.sparkSession
        weights, mean = self.weights(queries, query_key, query_text, words)
        id_kind = self.blocks.schema["ids"].dataType.elementType
        spec = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField("id", id_kind), T.StructField("score", T.DoubleType()), T.StructField("scored", T.LongType())])
        parts: list[DataFrame] = []
        found = written(weights, "keyword-queries").toLocalIterator()
        while block := list(islice(found, MAX_QUERIES)):
            asked = [(r[0], [t.term for t in r.terms], [t.weight for t in r.terms]) for r in block]
            terms = sorted({t for _, own, _ in asked for t in own})
            terms_df = spark.createDataFrame([(t,) for t in ["", *terms]], "term string")
            rows = self.blocks.join(F.broadcast(terms_df) if len(terms) <= BROADCAST_TERMS else terms_df, "term", "left_semi")
            rows = rows.select("block", "term", "most", "least", "places", "counts", "ids")
            if allowed is not None:
                inside = self.documents().join(allowed.select("id").distinct(), "id").groupBy("block").agg(F.collect_list(F.col("place").cast("short")).alias("inside"))
                rows = rows.join(inside, "block")
            else:
                rows = rows.withColumn("inside", F.lit(None).cast("array<short>"))
            first = _search(rows.where(F.pmod(F.xxhash64("block"), F.lit(FIRST_SHARE)) == 0), asked, terms, mean, k, {}, spec)
            floor = {r[0]: r[1] for r in _best(first.where("scored is null"), k, query_key).where(F.col("place") == k).select(query_key, "score").toLocalIterator()}
            done = _search(rows, asked, terms, mean, k, floor, spec)
            # one plan for some queries; of more, each block's few hits are written on the way
            parts.append(done if len(block) < MAX_QUERIES and not parts else written(done, "keyword-hits"))
        out = parts[0] if parts else spark.createDataFrame([], spec)
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def _padded(self, hits: DataFrame, keys: DataFrame, k: int, query_key: str, allowed: DataFrame | None) -> DataFrame:
        ids = self.documents().select("id") if allowed is None else self.documents().join(allowed.select("id").distinct(), "id").select("id")
        spare = ids.orderBy("id").limit(2 * k)  # of which the hits take k at most
        lacking = keys.join(hits.groupBy(query_key).agg(F.count(F.lit(1)).alias("have")), query_key, "left").where(F.coalesce("have", F.lit(0)) < k)
        had = hits.select(F.col(query_key).alias("had_query"), F.col("id").alias("had_id"))
        more = lacking.select(query_key).join(F.broadcast(spare)).join(had, (F.col(query_key) == F.col("had_query")) & F.col("id").eqNullSafe(F.col("had_id")), "left_anti")
        both = hits.select(query_key, "id", "score").unionByName(more.withColumn("score", F.lit(0.0)))
        return _best(both, k, query_key)


def _best(hits: DataFrame, k: int, query_key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), "id"))
    return hits.withColumn("place", place).where(F.col("place") <= k)


def _blocks(shared, kind: pa.DataType) -> Callable:
    """Makes an index's rows from rows (id, words), in runs of some blocks by term and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        only = None if shared.value is None else pa.array(shared.value, pa.string())
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_DOCS):
                part = batch.slice(at, BLOCK_DOCS)
                held.append(_block(part.column(0), part.column(1), (task << 32) + made, only, kind))
                made += 1
                if sum(b.nbytes for b in held) >= RUN_BYTES:
                    yield from _by_term(held)
                    held = []
        if held:
            yield from _by_term(held)

    return run


def _by_term(blocks: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    rows = pa.Table.from_batches(blocks).sort_by([("term", "ascending"), ("block", "ascending")])
    return rows.combine_chunks().to_batches(max_chunksize=10_000)


def _block(ids: pa.Array, lists: pa.Array, number: int, only: pa.Array | None, kind: pa.DataType) -> pa.RecordBatch:
    n = len(ids)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
    coded = lists.flatten().cast(pa.string()).dictionary_encode()
    keys = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), sizes)
    if only is not None:
        keys = keys[pc.is_in(coded.dictionary, value_set=only).to_numpy(zero_copy_only=False)[keys // n]] if len(keys) else keys
    keys, counts = np.unique(keys, return_counts=True)
    term, place, counts = keys // n, (keys % n).astype(np.int16), counts.astype(np.int32)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(starts, len(keys)).astype(np.int32)
    m = len(starts)
    most = np.maximum.reduceat(counts, starts) if m else counts
    least = np.minimum.reduceat(sizes[place], starts) if m else counts
    own = pa.array([0, *[n] * 1], pa.int32())
    names = pa.concat_arrays([pa.array([""]), coded.dictionary.take(pa.array(term[starts]))])
    shown = np.concatenate([[0, n], ends[1:] + n]).astype(np.int32)
    columns = {
        "block": pa.array(np.full(m + 1, number, np.int64)),
        "term": names,
        "n": pa.array(np.concatenate([[n], np.diff(ends)]).astype(np.int32)),
        "most": pa.array(np.concatenate([[0], most]).astype(np.int32)),
        "least": pa.array(np.concatenate([[0], least]).astype(np.int32)),
        "total": pa.array([int(sizes.sum()), *[None] * m], pa.int64()),
        "places": pa.ListArray.from_arrays(pa.array(shown), pa.array(np.concatenate([np.arange(n, dtype=np.int16), place]))),
        "counts": pa.ListArray.from_arrays(pa.array(shown), pa.array(np.concatenate([sizes, counts]))),
        "ids": pa.concat_arrays([pa.ListArray.from_arrays(own, ids.cast(kind)), pa.nulls(m, pa.list_(kind))]),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _search(rows: DataFrame, asked: list, terms: list[str], mean: float, k: int, floor: dict, spec: T.StructType) -> DataFrame:
    """Each task's ``k`` best of each query, and how many documents it scored whole for it."""
    shared = rows.sparkSession.sparkContext.broadcast((asked, terms, floor))
    kinds = [to_arrow_type(f.dataType) for f in spec]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, terms, floor = shared.value
        search = _Search(asked, terms, mean, k, floor)
        held, now = [], None
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                block = row[0].as_py()
                if block != now and held:
                    search.block(held)
                    held = []
                now = block
                held.append(row)
        if held:
            search.block(held)
        out = [(asked[q][0], i, -s, None) for q, best in enumerate(search.best) for s, _, i in best]
        out += [(asked[q][0], None, None, n) for q, n in enumerate(search.scored.tolist()) if n]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=spec.names)

    return rows.repartition("block").sortWithinPartitions("block", "term").mapInArrow(run, spec)


class _Search:
    """The best documents so far, block by block."""

    def __init__(self, asked: list, terms: list[str], mean: float, k: int, floor: dict):
        self.number = {t: i for i, t in enumerate(terms)}
        self.own = [np.array([self.number[t] for t in own]) for _, own, _ in asked]
        self.weights = [np.array(w) for _, _, w in asked]
        self.flat, self.flat_weights = np.concatenate(self.own), np.concatenate(self.weights)
        self.starts = np.cumsum([0, *(len(x) for x in self.own[:-1])])
        self.mean, self.k = mean or 1.0, k
        self.floor = np.array([floor.get(q, -np.inf) for q, _, _ in asked])
        self.best: list[list] = [[] for _ in asked]
        self.scored = np.zeros(len(asked), np.int64)

    def block(self, rows: list) -> None:
        bounds, lists = np.zeros(len(self.number)), {}
        ids = lengths = inside = None
        for _, term, most, least, places, counts, own, some in rows:
            name = term.as_py()
            if name == "":
                ids, lengths = own.as_py(), counts.values.to_numpy()
                inside = None if some.as_py() is None else some.values.to_numpy()
                continue
            at, m = self.number[name], most.as_py()
            bounds[at] = m / (m + K1 * (1 - B + B * least.as_py() / self.mean))
            lists[at] = (places, counts)
        if not lists:
            return
        soft, open_ = K1 * (1 - B + B * lengths / self.mean), None
        if inside is not None:
            open_ = np.zeros(len(ids), bool)
            open_[inside] = True
        reach = np.add.reduceat(self.flat_weights * bounds[self.flat], self.starts)
        made: dict[int, tuple] = {}

        def parts(at: int) -> tuple:
            if at not in made:
                places, counts = lists[at][0].values.to_numpy(), lists[at][1].values.to_numpy()
                made[at] = places, counts / (counts + soft[places])
            return made[at]

        for q in np.flatnonzero((reach > 0) & (reach >= self.floor - _SLACK)).tolist():
            self._query(q, bounds, parts, ids, open_, len(ids))

    def _query(self, q: int, bounds: np.ndarray, parts: Callable, ids: list, open_: np.ndarray | None, n: int) -> None:
        lift = self.weights[q] * bounds[self.own[q]]
        order = np.argsort(-lift, kind="stable")
        order = order[lift[order] > 0]
        rest = np.append(np.cumsum(lift[order][::-1])[::-1], 0.0)  # what the terms from each on can add
        floor, score, at = self.floor[q] - _SLACK, np.zeros(n), 0
        while at < len(order) and rest[at] >= floor:  # these terms alone can bring a new document in
            term = order[at]
            places, parts_of = parts(self.own[q][term])
            score[places] += self.weights[q][term] * parts_of
            at += 1
        near = np.flatnonzero((score > 0) & (score + rest[at] >= floor) if open_ is None else (score > 0) & (score + rest[at] >= floor) & open_)
        for more in range(at, len(order)):
            if not len(near):
                return
            term = order[more]
            places, parts_of = parts(self.own[q][term])
            where = np.minimum(np.searchsorted(places, near), len(places) - 1)
            score[near] += np.where(places[where] == near, self.weights[q][term] * parts_of[where], 0.0)
            near = near[score[near] + rest[more + 1] >= floor]
        self.scored[q] += len(near)
        told = np.round(score[near], DIGITS)
        self.best[q] = nsmallest(self.k, [*self.best[q], *((-s, ids[i] is not None, ids[i]) for s, i in zip(told.tolist(), near.tolist(), strict=True))])
        if len(self.best[q]) == self.k:
            self.floor[q] = max(self.floor[q], -self.best[q][-1][0])


def block_search(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", query_key: str = "query_id", query_text: str = "text", **more) -> DataFrame:
    """``BlockIndex.search`` of an index of the queries' terms, which is written to the shared folder on the way."""
    words = more.get("words")
    terms = queries.select(F.explode((words or tokens)(F.col(query_text))).alias("term")).distinct()
    some = [r.term for r in terms.limit(BROADCAST_TERMS + 1).toLocalIterator()]
    index = BlockIndex.build(docs, key, text, words, only=some if len(some) <= BROADCAST_TERMS else None)
    return BlockIndex(written(index.blocks, "keyword-blocks")).search(queries, k, query_key, query_text, **more)
