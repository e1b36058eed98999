"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by, remove_path, scratch_path


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``; the root is the least node of its component.

    Each step groups edges by a node for the least neighbour only, and joins that back so
    that a hub's edges can be split and are never gathered; steps are written to the shared
    folder, and what the step before wrote is removed.
    """
    spark = edges.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "components"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
    now = kept(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = joined_by(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        linked = joined_by(large, large.groupBy("u").agg(F.min("v").alias("m")), "u").select("v", "u", "m")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v")))
        now = kept(small.where("u <> v").distinct())
        for path in paths[:-1]:
            remove_path(spark, path)
        del paths[:-1]
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
