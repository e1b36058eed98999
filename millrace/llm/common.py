"""What the operators of this subpackage share: scratch tables and row-wise Arrow stages."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import scratch_folder

#: Rows that a Python stage works on at a time; bounds the Python objects alive at once.
SLICE_ROWS = 256


#: Scratch folders made within each open ``tidied`` block.
_open: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder's name below the folder that driver and executors share."""
    path = scratch_folder(spark, label)
    for made in _open:
        made.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back, which cuts its lineage.

    Executors that are lost later take nothing with them, since the rows are in files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped_after(made: DataFrame, *used: DataFrame) -> DataFrame:
    """``made``, a stored table, once the stored tables it was made from are removed."""
    for df in used:
        remove_path(df.sparkSession, df._scratch)
    return made


def joined_by(rows: DataFrame, one_each: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row for each key (of one column or more), so that a hot key's rows can be split.

    After a sum by key Spark would deal the rows as the sum was dealt, and then can't split a
    skewed partition; a second key, made of the first, has both sides dealt anew.
    """
    deal = f"deal_{uuid.uuid4().hex}"
    keys = [key] if isinstance(key, str) else key
    return rows.withColumn(deal, F.xxhash64(*keys)).join(one_each.withColumn(deal, F.xxhash64(*keys)), [*keys, deal], how).drop(deal)


#: Bits of the tables that tell what is surely not among keys: 262,144 rows of 16 bytes at most, whatever the input.
MAYBE_BITS = 1 << 24


def maybe_among(rows: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag`` that is false where the key is null or surely not in ``keys``' column of that name.

    One bit is kept for each hash of a key, in a table of fixed size that is broadcast, so
    that most rows can be told without a shuffle; the others still need an exact look.
    """
    word, place, bits = (f"{name}_{uuid.uuid4().hex}" for name in ("word", "place", "bits"))
    at = F.pmod(F.xxhash64(key), F.lit(MAYBE_BITS))
    table = keys.where(F.col(key).isNotNull()).select(at.alias(place)).groupBy(F.floor(F.col(place) / 64).alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, int({place} % 64)))").alias(bits))
    out = rows.withColumn(place, F.when(F.col(key).isNotNull(), at)).withColumn(word, F.floor(F.col(place) / 64)).join(F.broadcast(table), word, "left")
    return out.withColumn(flag, F.expr(f"coalesce(shiftright({bits}, int({place} % 64)) & 1, 0) = 1")).drop(word, place, bits)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch folders made within the block, in which results must be written."""
    made: list[str] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for path in made:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_memory() -> None:
    """Give what a finished task held back to the system, since Python workers idle on beside later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # other C libraries than glibc
        pass


@dataclass(frozen=True)
class Step:
    """New columns, made from others in Arrow batches.

    ``make()`` is called once for each task. It gives a function from lists of input values
    (one list per input) to an iterable of tuples of new values or, where ``arrays`` is
    set, from Arrow arrays to a list of Arrow arrays.
    """

    inputs: list[str]
    make: Callable[[], Callable]
    fields: list[T.StructField]
    arrays: bool = False

    def made(self) -> Callable[..., list[pa.Array]]:
        work = self.make()
        if self.arrays:
            return work
        kinds = [to_arrow_type(f.dataType) for f in self.fields]

        def over(*columns):
            rows = list(work(*(c.to_pylist() for c in columns)))
            return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

        return over


def append_steps(df: DataFrame, *steps: Step, drop: Sequence[str] = ()) -> DataFrame:
    """``df`` with the columns of the steps, each of which may use those of the steps before, in one pass.

    A new column replaces one that has its name; columns named in ``drop`` are left out of
    the result. A column goes to Python once, and only if a step or the result needs it.
    """
    new = {f.name.lower(): f for step in steps for f in step.fields}
    out = [f for f in [*(f for f in df.schema.fields if f.name.lower() not in new), *new.values()] if f.name.lower() not in {d.lower() for d in drop}]
    needed = {f.name.lower() for f in out if f.name.lower() not in new} | {i.lower() for step in steps for i in step.inputs}
    sent = [f.name for f in df.schema.fields if f.name.lower() in needed]
    keys, wanted = [n.lower() for n in sent], [f.name.lower() for f in out]
    source = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sent)))
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(out)])

    def run(batches):
        works = [step.made() for step in steps]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                held = dict(zip(keys, part.columns, strict=True))
                for step, work in zip(steps, works, strict=True):
                    made = work(*(held[i.lower()] for i in step.inputs))
                    held |= {f.name.lower(): m for f, m in zip(step.fields, made, strict=True)}
                yield pa.RecordBatch.from_arrays([held[n] for n in wanted], names=schema.names)
        del works
        release_memory()

    made = source.mapInArrow(run, schema)
    return made.select(*(F.col(a).alias(f.name) for a, f in zip(schema.names, out, strict=True)))


def emitted(df: DataFrame, inputs: list[str], make: Callable[[], Callable], schema: str, rows_at_once: int = 20_000) -> DataFrame:
    """Rows that ``make()``'s function yields for slices of ``df``'s inputs, as tuples.

    The function may have an attribute ``rest`` that yields what is left at a task's end.
    """
    struct = T._parse_datatype_string(schema)
    kinds = [to_arrow_type(f.dataType) for f in struct.fields]
    names = struct.names

    def packed(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        work, held = make(), []
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                for row in work(*(part.column(i).to_pylist() for i in range(part.num_columns))):
                    held.append(row)
                    if len(held) >= rows_at_once:
                        yield packed(held)
                        held = []
        if rest := getattr(work, "rest", None):
            held += rest()
        if held:
            yield packed(held)
        del work, rest, held
        release_memory()

    return df.select(*(F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(inputs))).mapInArrow(run, struct)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
