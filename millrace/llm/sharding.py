"""Sharding by a hierarchical weighted hash tree, in DataFrame expressions alone.

A row descends region, rack and shard. On each level every child draws ``-ln(u) / w``
with ``u`` from a hash of the child's name and the row's key and ``w`` the weight of the
child's subtree; the least draw wins. Draws of a child depend on its own name and weight
alone, so when a weight changes, rows move only into or out of subtrees whose weight
changed. A shard that is added as a region of its own takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a shard that are numbered together; groups of about this size are the unit of work.
SLOT_GROUP_ROWS = 1_024


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def fleet(shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """``base`` shards in regions of ``racks`` racks of ``per_rack``; each further one is a region.

    Every shard added beyond ``base`` opens a region, so that it takes rows only into itself.
    """
    per_region = racks * per_rack
    return [
        Shard(f"r{i // per_region}", f"k{i % per_region // per_rack}", i) if i < base else Shard(f"x{i}", "k0", i)
        for i in range(shards)
    ]


def _draw(key: Column, name: str, weight: float) -> Column:
    """``-ln(u) / weight`` with u in (0, 1) from 52 bits of a hash."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}/"), key)), 1, 13), 16, 10).cast("long")
    return -F.log((bits.cast("double") + 0.5) / F.lit(float(2**52))) / F.lit(float(weight))


def _least(options: list[tuple[Column, Column]]) -> Column:
    """The value whose draw is least; ties go to the first."""
    if len(options) == 1:
        return options[0][1]
    return F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i"), v.alias("v")) for i, (d, v) in enumerate(options))))["v"]


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The shard's number for a key; a null key counts as an empty one."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in shards:
        if s.weight <= 0:
            raise ValueError("weights must be positive")
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def in_rack(region: str, rack: str, own: list[Shard]) -> Column:
        return _least([(_draw(key, f"{region}.{rack}.{s.number}", s.weight), F.lit(s.number)) for s in own])

    def chosen(pick: Column, branches: list[Column]) -> Column:
        out = branches[-1]
        for i in range(len(branches) - 2, -1, -1):
            out = F.when(pick == i, branches[i]).otherwise(out)
        return out

    def in_region(region: str, racks: dict[str, list[Shard]]) -> Column:
        picks = [(_draw(key, f"{region}.{k}", sum(s.weight for s in own)), F.lit(i)) for i, (k, own) in enumerate(racks.items())]
        return chosen(_least(picks), [in_rack(region, k, own) for k, own in racks.items()])

    picks = [(_draw(key, r, sum(s.weight for own in racks.values() for s in own)), F.lit(i)) for i, (r, racks) in enumerate(regions.items())]
    return chosen(_least(picks), [in_region(r, racks) for r, racks in regions.items()])


def with_slots(df: DataFrame, shard: str, key: str, group: Column, slot: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 within each shard.

    Rows are numbered within (shard, group) and shifted by the counts of the groups before;
    the counts are one row for each group, so no task holds a shard.
    """
    marked = df.withColumn("_group", group)
    counts = marked.groupBy(shard, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inner = Window.partitionBy(shard, "_group").orderBy(key)
    numbered = marked.withColumn("_at", F.row_number().over(inner).cast("long") - 1)
    joined = numbered.join(starts, [shard, "_group"])
    return joined.withColumn(slot, F.col("_start") + F.col("_at")).drop("_group", "_at", "_start")


def hash_tree_shards(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after growth by one for each row of ``docs``.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text has size 1
    and the CRC-32 of no bytes (0), an empty one the same; a very long one is measured
    whole; rows with a null id go by the empty key; repeated rows share a shard and get
    slots of their own, and rows that tie by id are numbered in any order; an empty table
    gives an empty result; other columns of ``docs``, whatever their names, are not read.
    """
    doc_id, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    placed = docs.select(
        doc_id.alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(doc_id, fleet(shards, shards)).cast("int").alias("shard"),
        shard_of(doc_id, fleet(shards + 1, shards)).cast("int").alias("grown_shard"),
    )
    # rows without an id go to a shard as one, but are numbered in groups by their texts
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), "text_crc32"))), 14, 8)
    group = F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slot_groups(docs, shards)))
    slotted = with_slots(placed, "shard", "doc_id", group)
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def slot_groups(docs: DataFrame, shards: int) -> int:
    """Groups in each shard, from the number of rows (a count that Parquet footers answer)."""
    return max(1, -(-docs.select(F.lit(1)).count() // (shards * SLOT_GROUP_ROWS)))
