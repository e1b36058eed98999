"""An index of vectors: cells with product-coded residuals, searched by cells, re-ranked exactly.

The model (centres of cells, code books of residuals) is trained on a bounded sample; every
vector is coded. A search reads the codes of the cells nearest to its queries, with the
metadata filter pushed into that scan, keeps a short list for each query, and reads whole
vectors for the short lists only. How many cells and how long a list is measured on the
sample when the index is built, for a recall that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from ..scratch import written
from .retrieval import MAX_QUERIES, where_column

#: Vectors that a model is trained on at most, and of them those that a search is tried with.
SAMPLE_ROWS, TRIED_QUERIES = 20_000, 200
#: Numbers of a code: one byte for so many components.
CODED_TOGETHER, CODE_VALUES = 4, 256
#: Neighbours that the measured recall is of.
TRIED_NEIGHBOURS = 10
#: Short lists of all queries of a block that are broadcast; longer ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows that are coded or compared at once.
SLICE = 4_096


@dataclass(frozen=True)
class Model:
    """Centres of cells, code books (one for each part of a vector), and how far a search goes."""

    centres: np.ndarray
    books: list[np.ndarray]
    probes: int = 8
    short: int = 10

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, np.cumsum([b.shape[1] for b in self.books])[:-1], axis=1)

    def coded(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row's cell, the codes of what it differs from the cell's centre, and the square of what they stand for."""
        cell = _nearest(unit, self.centres)
        codes = np.stack([_nearest(p, b) for p, b in zip(self.parts(unit - self.centres[cell]), self.books, strict=True)], 1).astype(np.uint8)
        told = self.centres[cell] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        return cell, codes, (told * told).sum(1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of each query's parts with all code values: queries x parts x values."""
        out = np.zeros((len(queries), len(self.books), CODE_VALUES))
        for j, (p, b) in enumerate(zip(self.parts(queries), self.books, strict=True)):
            out[:, j, : len(b)] = p @ b.T
        return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    square = (centres * centres).sum(1)
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), SLICE):
        out[at : at + SLICE] = (square - 2 * x[at : at + SLICE] @ centres.T).argmin(1)
    return out


def _means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """``k`` centres by Lloyd's rounds from spread rows; a centre without rows takes the farthest one."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if (n == 0).any():
            far = ((x - centres[own]) ** 2).sum(1).argsort()[::-1]
            centres[n == 0] = x[far[: (n == 0).sum()]]
    return centres


def trained(sample: np.ndarray, cells: int, recall: float) -> Model:
    """The model of a sample of unit vectors, with searches that find ``recall`` of the neighbours within the sample."""
    sample = sample[np.random.default_rng(0).permutation(len(sample))]
    centres = _means(sample, cells)
    left = sample - centres[_nearest(sample, centres)]
    cuts = range(CODED_TOGETHER, left.shape[1], CODED_TOGETHER)
    model = Model(centres, [_means(p, CODE_VALUES) for p in np.split(left, list(cuts), axis=1)])
    asked = sample[:TRIED_QUERIES]
    k = min(TRIED_NEIGHBOURS, len(sample))
    true = np.argsort((sample * sample).sum(1) - 2 * asked @ sample.T, axis=1)[:, :k]
    cell, codes, square = model.coded(sample)
    order = np.argsort(((centres * centres).sum(1) - 2 * asked @ centres.T), axis=1).argsort(1)  # a cell's rank for a query
    ranks = np.sort(order[np.arange(len(asked))[:, None], cell[true]].ravel())
    probes = int(ranks[min(len(ranks) - 1, int(np.ceil((1 + recall) / 2 * len(ranks))))]) + 1
    tables, short = model.tables(asked), []
    for q, table in enumerate(tables):
        near = np.flatnonzero(order[q, cell] < probes)
        told = square[near] - 2 * (centres[cell[near]] @ asked[q] + table[np.arange(codes.shape[1]), codes[near]].sum(1))
        place = dict(zip(near[np.argsort(told)].tolist(), range(len(near)), strict=True))
        short += [place[i] + 1 for i in true[q].tolist() if i in place]
    short = sorted(short)
    return Model(centres, model.books, probes, max(k, short[min(len(short) - 1, int(np.ceil((1 + recall) / 2 * len(short))))]) if short else k)


@dataclass(frozen=True)
class VectorIndex:
    """Rows (cell, key, code, square, vector, other columns kept), clustered by cell, and the model."""

    rows: DataFrame
    model: Model
    key: str
    vector: str

    @classmethod
    def build(cls, corpus: DataFrame, key: str = "vec_id", vector: str = "embedding", keep: list[str] = (), cells: int | None = None, recall: float = 0.95) -> VectorIndex:
        """Trains on a bounded sample and codes every vector; rows without a vector of the usual length are never near.

        ``keep`` names columns that searches filter by.
        """
        v = F.col(vector).cast("array<double>")
        usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        sizes = corpus.where(usable).groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
        if sizes is None:
            raise ValueError("no vector to index")
        n = sizes["count"]
        good = corpus.where(usable & (F.size(v) == sizes["size"]))
        share = F.pmod(F.xxhash64(v), F.lit(1 << 30)) < F.lit(int(min(1.0, 1.2 * SAMPLE_ROWS / n) * (1 << 30)))
        sample = good.where(share).limit(SAMPLE_ROWS).select(v.alias("v")).toArrow()
        unit = vectors.unit_rows(pc.list_flatten(sample["v"]).to_numpy().reshape(-1, sizes["size"]))
        model = trained(unit, cells or max(1, min(4_096, round(n**0.5))), recall)
        named = good.select(F.col(key).alias("key"), v.alias("vector"), *(F.col(f"`{c}`") for c in keep))
        spec = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("code", T.BinaryType()), T.StructField("square", T.DoubleType()), *named.schema.fields])
        shared = corpus.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    x = pc.list_flatten(part.column(1)).to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    cell, codes, square = shared.value.coded(vectors.unit_rows(x))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(square), *part.columns], names=spec.names)

        return cls(named.mapInArrow(run, spec), model, key, vector)

    def write(self, path: str) -> None:
        """The index as Parquet; a range of (cell, hash) is a file, so that a hot cell is many."""
        ranged = self.rows.withColumn("deal", F.xxhash64("key")).repartitionByRange("cell", "deal").sortWithinPartitions("cell").drop("deal")
        ranged.write.parquet(f"{path}/rows")
        m = self.model
        row = (self.key, self.vector, m.centres.tolist(), [b.tolist() for b in m.books], m.probes, m.short)
        self.rows.sparkSession.createDataFrame([row], "key string, vector string, centres array<array<double>>, books array<array<array<double>>>, probes int, short int").write.parquet(f"{path}/model")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> VectorIndex:
        m = spark.read.parquet(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/rows"), Model(np.array(m.centres), [np.array(b) for b in m.books], m.probes, m.short), m.key, m.vector)

    def search(self, queries: DataFrame, k: int, where: dict | None = None, query_key: str = "query_id", vector: str = "embedding", probes: int | None = None, short: int | None = None) -> DataFrame:
        """Near rows of each query: (query_key, key, distance, place), the distances exact.

        ``probes`` cells are read for a query, and the ``short`` rows that are best by their codes are compared exactly;
        without them, as many as the index found to be enough. Of equal distances (to 12 digits) the lesser
        key comes first. Queries are broadcast in blocks; a query of another length than the vectors has no hits.
        """
        probes, short = probes or self.model.probes, max(k, short or -(-self.model.short * k // min(k, TRIED_NEIGHBOURS)))
        kept = self.rows.where(where_column(where)) if where else self.rows
        found = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).alias("q"), F.col(vector).cast("array<double>").alias("v")).toLocalIterator()
        width, parts = self.model.centres.shape[1], []
        while (block := list(islice(found, MAX_QUERIES))) or not parts:
            asked = [(r.q, r.v) for r in block if len(r.v) == width and all(x is not None and np.isfinite(x) for x in r.v)]
            part = self._searched(kept, asked, probes, short, queries.schema[query_key].dataType)
            parts.append(part if len(block) < MAX_QUERIES and not parts else written(part, "vector-hits"))
        near = reduce(DataFrame.unionByName, parts)
        place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "key"))
        near = near.withColumn("place", place).where(F.col("place") <= k)
        return near.select(F.col("q").alias(query_key), F.col("key").alias(self.key), "distance", "place")

    def _searched(self, rows: DataFrame, asked: list, probes: int, short: int, query_kind: T.DataType) -> DataFrame:
        spark, model = rows.sparkSession, self.model
        unit = vectors.unit_rows(np.array([v for _, v in asked])) if asked else np.zeros((0, model.centres.shape[1]))
        far = (model.centres * model.centres).sum(1) - 2 * unit @ model.centres.T
        cells = np.argsort(far, axis=1, kind="stable")[:, :probes]
        by_cell: dict[int, np.ndarray] = {int(c): np.flatnonzero((cells == c).any(1)) for c in np.unique(cells)}
        shared = spark.sparkContext.broadcast((model, unit, by_cell))
        spec = T.StructType([T.StructField("asked", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("key", rows.schema["key"].dataType), T.StructField("told", T.DoubleType())])
        kinds = [to_arrow_type(f.dataType) for f in spec]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model, unit, by_cell = shared.value
            tables = model.tables(unit)
            best = _Shortest(len(unit), short)
            for batch in batches:
                cell = batch.column(0).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(cell), -1)
                square = batch.column(3).to_numpy()
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    for q in by_cell.get(c, np.zeros(0, int)).tolist():
                        told = square[at] - 2 * (model.centres[c] @ unit[q] + tables[q][np.arange(codes.shape[1]), codes[at]].sum(1))
                        best.add(q, told, at, c, batch.column(1))
            if rows_out := best.rows():
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows_out, strict=True), kinds, strict=True)], names=spec.names)

        probed = spark.createDataFrame([(c,) for c in by_cell], "cell int")
        some = rows.where(F.col("cell").isin(list(by_cell))) if len(by_cell) <= 1_000 else rows.join(F.broadcast(probed), "cell", "left_semi")
        listed = some.select("cell", "key", "code", "square").mapInArrow(run, spec)
        place = F.row_number().over(Window.partitionBy("asked").orderBy("told", "key"))
        listed = listed.withColumn("place", place).where(F.col("place") <= short).select("asked", "cell", "key")
        listed = F.broadcast(listed) if len(asked) * short <= BROADCAST_ROWS else listed
        told = spark.createDataFrame([(i, q, unit[i].tolist()) for i, (q, _) in enumerate(asked)], T.StructType([T.StructField("asked", T.IntegerType()), T.StructField("q", query_kind), T.StructField("unit", T.ArrayType(T.DoubleType()))]))
        pairs = some.select("cell", "key", "vector").join(listed, ["cell", "key"]).join(F.broadcast(told), "asked")
        distance = F.greatest(F.round(vectors.squared_l2(vectors.normalized(F.col("vector")), F.col("unit")), 12), F.lit(0.0))
        return pairs.select("q", "key", distance.alias("distance"))


class _Shortest:
    """For each query the rows that are nearest by their codes so far."""

    def __init__(self, queries: int, short: int):
        self.short = short
        self.held: list[list[tuple]] = [[] for _ in range(queries)]
        self.bound = np.full(queries, np.inf)

    def add(self, q: int, told: np.ndarray, at: np.ndarray, cell: int, keys: pa.Array) -> None:
        near = np.flatnonzero(told <= self.bound[q])
        if len(near) > self.short:
            near = near[np.argpartition(told[near], self.short - 1)[: self.short]]
        if len(near):
            own = self.held[q] + list(zip(told[near].tolist(), [cell] * len(near), keys.take(pa.array(at[near])).to_pylist(), strict=True))
            own.sort(key=lambda x: x[0])
            self.held[q] = own[: self.short]
            if len(own) >= self.short:
                self.bound[q] = self.held[q][-1][0]

    def rows(self) -> list[tuple]:
        return [(q, cell, key, told) for q, own in enumerate(self.held) for told, cell, key in own]
