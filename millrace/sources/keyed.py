"""Stored tables with a key, changed in place: only the buckets that a change touches are rewritten.

A table is a folder of Parquet with a folder for each bucket of the key's hash. A change is a
table of rows with keys and a function that merges it with the stored rows of the same buckets. The
merged buckets are written to the shared scratch folder first and then put in the place of the old ones,
each with the number of the change, its epoch: a change that comes again, after a failure or as a
stream's batch, is not put into a bucket that has it. Changes are put in the order of their epochs;
one that failed is put again before the next.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

_BUCKET, _EPOCH, _MARK = "key_bucket", "key_epoch", "key_mark"
#: Buckets of a new table; a table of many rows wants more, so that one is a file of some hundred MB.
BUCKETS = 64


class KeyedTable:
    """A stored table. Changes are put one at a time; readers see a bucket as it was or as it is."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        made = spark.read.json(f"{path}/made").first()
        self.keys, self.buckets, self.schema = list(made.keys), made.buckets, T.StructType.fromJson(json.loads(made.schema))

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = BUCKETS) -> KeyedTable:
        """An empty table of a schema; an error if there is one."""
        row = spark.createDataFrame([(keys, buckets, schema.json())], "keys array<string>, buckets int, schema string")
        row.coalesce(1).write.mode("errorifexists").json(f"{path}/made")
        return cls(spark, path)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        own = T.StructType([*self.schema.fields, T.StructField(_EPOCH, T.LongType()), T.StructField(_MARK, T.BooleanType()), T.StructField(_BUCKET, T.IntegerType())])
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], own)
        return self.spark.read.schema(own).parquet(f"{self.path}/rows")

    def read(self) -> DataFrame:
        return self._stored().where(f"not {_MARK}").select(*(F.col(f"`{n}`") for n in self.schema.names))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        touched = self._touched(keys)
        rows = self._stored().where(F.col(_BUCKET).isin(touched) & F.expr(f"not {_MARK}")).select(*(F.col(f"`{n}`") for n in self.schema.names))
        return rows.join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # no more than the table has buckets

    def apply(self, changes: DataFrame, epoch: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Put a change into the table; the number of buckets that it was put into.

        ``merge`` gets the stored rows of the touched buckets and the changes to them, and gives the rows
        that take their place. It must treat each key by itself.
        """
        changes = written(changes.withColumn(_BUCKET, self._bucket()), "keyed-changes")
        touched = self._touched(changes)
        before = self._stored().where(F.col(_BUCKET).isin(touched))
        done = {r[0] for r in before.where(F.col(_MARK) & (F.col(_EPOCH) >= epoch)).select(_BUCKET).distinct().collect()}
        todo = [b for b in touched if b not in done]
        if not todo:
            return 0
        names = [F.col(f"`{n}`") for n in self.schema.names]
        kept = before.where(F.col(_BUCKET).isin(todo) & F.expr(f"not {_MARK}")).select(*names)
        merged = merge(kept, changes.where(F.col(_BUCKET).isin(todo)).drop(_BUCKET))
        cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows = merged.select(*cast).withColumn(_EPOCH, F.lit(epoch).cast("long")).withColumn(_MARK, F.lit(False)).withColumn(_BUCKET, self._bucket())
        marks = self.spark.createDataFrame([(b,) for b in todo], f"{_BUCKET} int").select(
            *(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), F.lit(epoch).cast("long").alias(_EPOCH), F.lit(True).alias(_MARK), _BUCKET
        )
        # read whole before the old buckets go
        new = written(rows.unionByName(marks), "keyed-rows")
        new.repartition(min(len(todo), 200), _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET).parquet(f"{self.path}/rows")
        return len(todo)

    def insert(self, rows: DataFrame, epoch: int) -> int:
        """Rows with new keys; of several rows of one key any, and none where the key is stored."""
        return self.apply(rows.dropDuplicates(self.keys), epoch, lambda old, new: old.unionByName(new.join(old.select(*self.keys), self.keys, "left_anti"), allowMissingColumns=True))

    def upsert(self, rows: DataFrame, epoch: int, order: str) -> int:
        """Rows put in or over those of their keys; of several rows of one key the last by ``order`` counts."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in old.columns if c not in self.keys]
            last = new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*self.keys, "last.*")
            return old.join(last.select(*self.keys), self.keys, "left_anti").unionByName(last)

        return self.apply(rows, epoch, merge)

    def delete(self, keys: DataFrame, epoch: int) -> int:
        return self.apply(keys.select(*self.keys), epoch, lambda old, gone: old.join(gone, self.keys, "left_anti"))
