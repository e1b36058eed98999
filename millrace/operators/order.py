"""Order statistics and ranks of groups of any size, without a task that holds a group."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written

#: Values of a group and rank that one task sorts at most; of more, a bracket around the rank is taken first.
SORTED_VALUES = 100_000
#: Cuts of a bracket, and the accuracy of the sketch that finds them (an error of far less than a cut).
CUTS, ACCURACY = 500, 10_000
#: Tables of groups that are broadcast.
BROADCAST_GROUPS = 10_000


def _with(rows: DataFrame, groups: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """``rows`` with the columns of their group; null keys are keys."""
    named = groups.withColumnsRenamed({k: f"{k}_own" for k in keys})
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(named[f"{k}_own"]) for k in keys])
    return rows.join(F.broadcast(named) if few else named, same).drop(*(f"{k}_own" for k in keys))


def quantiles(df: DataFrame, column: str, probabilities: list[float], by: list[str] = (), names: list[str] | None = None) -> DataFrame:
    """Exact quantiles of each group by linear interpolation: ``by`` and one double column each, q0, q1 ... or ``names``.

    Ranks are looked for in rounds over all groups at once. A bounded sketch cuts what is left
    of a group into brackets; counting how many values lie before the bracket of the rank and in it makes
    sure that it is the right one, and only its values go on, until a task can sort them. Null
    values are left out, groups without others have null; a null key is a key. An empty table has no groups.
    """
    own = uuid.uuid4().hex
    keys = [f"k{i}_{own}" for i in range(len(by))]
    at = [*keys, "t"]
    ps = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)))
    x = F.col(f"`{column}`") if isinstance(df.schema[column].dataType, T.NumericType) else F.col(f"`{column}`").cast("double")
    base = df.select(*(F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)), x.alias("x"))
    sizes = base.groupBy(*keys).agg(F.count("x").alias("n"))
    state = sizes.withColumn("z", F.explode(ps)).select(*keys, F.col("z.t").alias("t"), "n", (F.col("z.p") * (F.col("n") - 1)).alias("h"))
    state = state.select(*at, F.col("n").alias("inside"), F.lit(0).cast("long").alias("before"), F.floor("h").cast("long").alias("rank"), (F.col("h") - F.floor("h")).alias("part"), F.col("n").alias("all"))
    state, rows = written(state, "order-state"), base.where("x is not null").withColumn("t", F.explode(F.array(*(F.lit(i) for i in range(len(probabilities))))))
    small = state.where(F.col("inside") <= SORTED_VALUES)
    done = [_sorted(_with(rows, small.where("inside > 0"), at, _few(small)), at)]
    large = state.where(F.col("inside") > SORTED_VALUES)
    while large.take(1):
        few = _few(large)
        own_rows = _with(rows, large, at, few)
        cuts = F.percentile_approx("x", F.array(*(F.lit(i / CUTS) for i in range(CUTS + 1))), F.lit(ACCURACY))
        found = own_rows.groupBy(*at).agg(cuts.alias("cuts"))
        marked = _with(large, found, at, few)
        place = F.floor((F.col("rank") - F.col("before")) / F.col("inside") * CUTS).cast("int")
        marked = marked.withColumn("lo", F.get("cuts", F.greatest(place - 1, F.lit(0)))).withColumn("hi", F.get("cuts", F.least(place + 2, F.lit(CUTS)))).drop("cuts")
        marked = written(marked, "order-cuts")
        inner = _with(rows, marked.select(*at, "lo", "hi"), at, few)
        counts = inner.groupBy(*at).agg(F.count_if(F.expr("x < lo")).alias("less"), F.count_if(F.expr("x >= lo and x <= hi")).alias("within"))
        told = _with(marked, counts, at, few)
        # a rank, or the one after it, that the sketch missed: go on with all on that side
        start, last = F.col("before") + F.col("less"), F.least(F.col("rank") + 1, F.col("all") - 1)
        low = start <= F.col("rank")
        high = last < start + F.col("within")
        told = told.select(
            *at, "rank", "part", "all", F.when(low, F.col("lo")).alias("lo"), F.when(high, F.col("hi")).alias("hi"), F.when(low, start).otherwise(F.col("before")).alias("before"),
            (F.when(high, start + F.col("within")).otherwise(F.col("before") + F.col("inside")) - F.when(low, start).otherwise(F.col("before"))).alias("inside"), F.col("inside").alias("was"),
        )
        told = written(told, "order-told")
        kept = _with(rows, told.select(*at, "lo", "hi", "inside", "before", "rank", "part", "all", "was"), at, few)
        kept = kept.where("(lo is null or x >= lo) and (hi is null or x <= hi)")
        # many copies of one value can't be cut further; they need no sorting either, since they are summed first
        stuck = (F.col("inside") <= SORTED_VALUES) | (F.col("inside") == F.col("was")) | F.col("lo").eqNullSafe(F.col("hi"))
        rows = written(kept.select(*at, "x", "inside", "before", "rank", "part", "all", stuck.alias("last")), "order-rows")
        done.append(_sorted(rows.where("last"), at))
        large = told.where(~stuck).select(*state.columns)
        rows = rows.where("not last").select(*at, "x")
    out = reduce(DataFrame.unionByName, done)
    value = [F.max(F.when(F.col("t") == i, F.col("value"))).alias(n) for i, n in enumerate(names or [f"q{i}" for i in range(len(probabilities))])]
    empty = state.where("inside = 0").select(*at, F.lit(None).cast("double").alias("value"))
    return out.unionByName(empty).groupBy(*keys).agg(*value).withColumnsRenamed(dict(zip(keys, by, strict=True)))


def _few(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


def _sorted(rows: DataFrame, at: list[str]) -> DataFrame:
    """(at, value) from a group's values: equal ones are summed, then ranked."""
    counts = rows.groupBy(*at, "x", "before", "rank", "part", "all").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*at).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("upto", upto + F.col("before"))
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("x"))).cast("double")
    both = ranked.groupBy(*at, "part").agg(pick(F.col("rank")).alias("a"), pick(F.least(F.col("rank") + 1, F.col("all") - 1)).alias("b"))
    # as the built-in function weighs its two neighbours
    return both.select(*at, F.when((F.col("part") == 0) | (F.col("a") == F.col("b")), F.col("a")).otherwise((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("value"))


def placed(df: DataFrame, by: list[str], order: list[tuple[Column, bool]], place: str = "place") -> DataFrame:
    """``df`` with a place from 1 within each group, by ``order``: columns and whether they fall, nulls last then.

    Rows are dealt into ranges of (group, order) and written, each with its range's number;
    places within a range are shifted by the counts of the ranges before, so that no task
    holds a group. A row's own number is the last key, so that equal rows, which get places in
    any order, can be dealt apart. A null key is a key.
    """
    own = uuid.uuid4().hex
    number, part, start = (f"{n}_{own}" for n in ("number", "part", "start"))
    keys, sort = [f"k{i}_{own}" for i in range(len(by))], [f"s{i}_{own}" for i in range(len(order))]
    named = {k: F.col(f"`{b}`") for k, b in zip(keys, by, strict=True)} | {n: c for n, (c, _) in zip(sort, order, strict=True)}
    within = [F.col(n).desc_nulls_last() if falls else F.col(n).asc_nulls_first() for n, (_, falls) in zip(sort, order, strict=True)] + [F.col(number).asc()]
    rows = df.withColumns(named).withColumn(number, F.monotonically_increasing_id())
    dealt = written(rows.repartitionByRange(*(F.col(k).asc() for k in keys), *within).withColumn(part, F.spark_partition_id()), "order-ranges")
    counts = dealt.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("n"))  # a row for each range and group in it
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*keys, part, before.alias(start))
    numbered = dealt.withColumn(place, F.row_number().over(Window.partitionBy(*keys, part).orderBy(*within)).cast("long"))
    out = _with(numbered, starts, [*keys, part], False)
    return out.withColumn(place, F.col(place) + F.col(start)).drop(*keys, *sort, number, part, start)
