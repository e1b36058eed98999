"""Near-duplicate embeddings by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the
nearest signed axis is its hash. Two rotations make a bucket's code; several tables and
multiprobing, with the axes next nearest, bring close vectors together in some bucket.
Pairs that share a bucket are verified by their cosine in double precision, each in the
first bucket that it shares; what leaves a comparison are numbers of links and the links
that span what is connected, never a list of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped_after, joined_by, stored
from .components import components

#: Rows that are compared in one call, about; each block pair stays whole.
BATCH_ROWS = 2_000
#: Pairs whose shared buckets are looked up at once.
_PAIRS = 20_000


@dataclass(frozen=True)
class Hashing:
    tables: int = 4
    rotations: int = 2  #: rotations whose axes make one code
    probes: int = 3  #: buckets of a vector in each table
    seed: int = 20_240
    block_rows: int = 512  #: rows of a bucket that are compared at once


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two, scaled to keep lengths."""
    n, h, x = x.shape[1], 1, x.copy()
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def probe_codes(unit: np.ndarray, how: Hashing) -> np.ndarray:
    """Codes (rows, tables, probes) of unit vectors; the first probe is the nearest axes' bucket."""
    width = 1 << max(0, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    out = np.empty((len(unit), how.tables, how.probes), np.int64)
    rows = np.arange(len(unit))
    n_axes = min(2 * width, how.probes)
    for t in range(how.tables):
        axes, losses = [], []
        for r in range(how.rotations):
            signs = np.random.default_rng([how.seed, t, r]).choice([-1.0, 1.0], (3, width))
            y = x
            for s in signs:
                y = hadamard(y * s)
            both = np.concatenate([y, -y], 1)
            top = np.argsort(-both, 1, kind="stable")[:, :n_axes]
            axes.append(top)
            losses.append(both[rows[:, None], top[:, :1]] - both[rows[:, None], top])
        code, loss = axes[0].astype(np.int64), losses[0]
        for top, more in zip(axes[1:], losses[1:], strict=True):
            code = (code[:, :, None] * (2 * width) + top[:, None, :]).reshape(len(x), -1)
            loss = (loss[:, :, None] + more[:, None, :]).reshape(len(x), -1)
        order = np.argsort(loss, 1, kind="stable")[:, : how.probes]
        got = code[rows[:, None], order]
        out[:, t, : got.shape[1]] = got
        out[:, t, got.shape[1] :] = got[:, :1]
    return out


def _unit(vectors: list) -> np.ndarray:
    x = np.asarray(np.stack(vectors), np.float64)
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components would leave the doubles' range
    return x / np.sqrt((x * x).sum(1))[:, None]


def _bucket_rows(how: Hashing):
    """(cls, codes): the buckets of a class in order, whose numbers tell table and dimensions, too."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2048):
                part = pdf.iloc[at : at + 2048]
                for size, own in part.groupby(part.v.map(len)):
                    codes = (probe_codes(_unit(own.v.tolist()), how) * how.tables + np.arange(how.tables)[None, :, None]) * (1 << 16) + size % (1 << 16)
                    yield pd.DataFrame({"cls": own.cls.to_numpy(), "codes": [np.unique(c) for c in codes.reshape(len(own), -1)]})

    return run


def vector_classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, cls, v): cls names the class of equal vectors in 128 bits; null for vectors that link with nothing."""
    v = F.col(f"`{vector}`").cast("array<double>")
    sound = F.size(v) > 0
    for bad in (lambda x: x.isNull(), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))):
        sound = sound & ~F.coalesce(F.exists(v, bad), F.lit(False))
    sound = F.coalesce(sound & F.exists(v, lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are equal; adding 0.0 makes them one
    v = F.transform(v, lambda x: x + F.lit(0.0))
    words = [F.unhex(F.lpad(F.hex(F.xxhash64(F.lit(seed), v)), 16, "0")) for seed in (1, 2)]
    return vectors.select(F.col(f"`{key}`").alias("vec_id"), F.when(sound, F.concat(*words)).alias("cls"), F.when(sound, v).alias("v"))


def near_vectors(vectors: DataFrame, least: float = 0.95, key: str = "vec_id", vector: str = "embedding", how: Hashing = Hashing()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    Equal vectors are one class, hashed and compared once and linked with each other.
    Within a bucket, classes are compared in blocks of ``how.block_rows``, so a hot bucket
    becomes many tasks. Vectors of different lengths never link; very long ones are compared
    whole; a cosine that ties with ``least`` links. Null and zero vectors, and those with
    null or non-finite components, link with nothing. Repeated rows are rows of one class.
    Rows with a null id count as links but can't be a component's id unless all its ids are
    null. An empty table gives an empty result; other columns, whatever their names, are not
    read.
    """
    rows = stored(vector_classes(vectors, key, vector), "vectors")
    classes = stored(rows.where("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "vector-classes")
    found = class_links(classes, least, how)
    others = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null").select("a", "b")).select(F.col("node").alias("cls"), "root")
    info = classes.select("cls", "n", "least_id").join(others, "cls", "left").join(roots, "cls", "left").select(
        "cls", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("root"), "least_id"
    )
    info = dropped_after(stored(info, "vector-info"), found, classes)
    ids = info.groupBy("root").agg(F.min("least_id").alias("component_id"))
    info = joined_by(info, ids, "root").select("cls", "n_links", "component_id")
    # a hot class has its rows on one side only, which a skewed join splits
    out = rows.select("vec_id", "cls").join(info, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def linked_pairs(unit: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b of rows whose cosine is at least ``least``, alike however the rows are blocked."""
    cos = unit @ unit.T
    a, b = np.nonzero(np.triu(cos >= least - 1e-9, 1))
    near = np.flatnonzero(cos[a, b] < least + 1e-9)  # sums in another order might differ
    keep = np.ones(len(a), bool)
    keep[near] = np.einsum("ij,ij->i", unit[a[near]], unit[b[near]]) >= least
    return a[keep], b[keep]


def _first_shared(codes: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether ``bucket`` is the least that the rows of each pair share; codes are rows in order, padded with -1."""
    out = np.empty(len(a), bool)
    for at in range(0, len(a), _PAIRS):
        x, y = codes[a[at : at + _PAIRS]], codes[b[at : at + _PAIRS]]
        earlier = (x >= 0) & (x < bucket)
        out[at : at + _PAIRS] = ~((x[:, :, None] == y[:, None, :]) & earlier[:, :, None]).any((1, 2))
    return out


def _compared(least: float):
    """For each block pair of a batch (a, null, n): vectors that a class links with, and (a, b, null): spanning links."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, bucket), rows in pdf.groupby(["pair", "bucket"], sort=False):
            if len(rows) < 2:
                continue
            names, block, n = rows.cls.to_numpy(), rows.block.to_numpy(), rows.n.to_numpy()
            codes = np.full((len(rows), max(map(len, rows.codes))), -1, np.int64)
            for i, own in enumerate(rows.codes):
                codes[i, : len(own)] = own
            a, b = linked_pairs(_unit(rows.v.tolist()), least)
            if block.min() != block.max():  # pairs within a block are found where it meets itself
                across = block[a] != block[b]
                a, b = a[across], b[across]
            first = _first_shared(codes, a, b, bucket)
            a, b = a[first], b[first]
            links = np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
            out += [(names[i], None, int(links[i])) for i in np.flatnonzero(links)]
            parent = list(range(len(rows)))
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                while parent[j] != j:
                    parent[j] = j = parent[parent[j]]
                if i != j:
                    parent[i] = j
                    out.append((names[i], names[j], None))
        return pd.DataFrame(out, columns=["a", "b", "n"], dtype=object)

    return run


def class_links(classes: DataFrame, least: float, how: Hashing) -> DataFrame:
    """Rows (a, null, n) of classes (cls, n, v) with numbers of vectors they link with, to be summed, and
    (a, b, null) of links that connect what is linked, among those that share a bucket."""
    hashed = stored(classes.select("cls", "v").mapInPandas(_bucket_rows(how), "cls binary, codes array<long>"), "vector-buckets")
    # buckets with one class give no pair; in the others a class's block is by its hash
    spots = hashed.select("cls", F.explode("codes").alias("bucket"))
    filled = spots.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / how.block_rows).cast("int"))
    placed = joined_by(spots, filled, "bucket").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    # a row goes to the block pairs (i, j), i <= j, that have its block; many pairs share a task's call
    spread = placed.select("cls", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    spread = stored(spread.select("cls", "bucket", "block", pair.alias("pair")), "vector-spread")
    batches = 1 + spread.count() // BATCH_ROWS
    whole = classes.select("cls", "n", "v").join(hashed, "cls")
    dealt = spread.withColumn("batch", F.pmod("pair", F.lit(batches))).join(whole, "cls")
    return dropped_after(stored(dealt.groupBy("batch").applyInPandas(_compared(least), "a binary, b binary, n long"), "vector-links"), hashed, spread)
