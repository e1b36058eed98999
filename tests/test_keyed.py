"""Stored tables with keys: only touched buckets change, and a change counts once."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import tasks
from millrace.sources.keyed import KeyedTable


def bucket_files(path):
    return {d: {f: os.path.getmtime(os.path.join(path, "rows", d, f)) for f in os.listdir(os.path.join(path, "rows", d)) if f.endswith(".parquet")} for d in os.listdir(os.path.join(path, "rows")) if d.startswith("key_bucket")}


def content(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_changes_touch_their_buckets_only(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}", i) for i in range(200)], "id long, title string, n int")
    path = str(tmp_path / "t")
    table = KeyedTable.create(spark, path, rows.schema, ["id"], 8)
    assert table.read().collect() == [] and table.delete(rows.where("id < 0"), 0) == 0
    assert table.insert(rows, 1) == 8
    before = bucket_files(path)
    assert table.upsert(spark.createDataFrame([(5, "old", 1, 1), (5, "new", 2, 2)], "id long, title string, n int, at int"), 2, "at") == 1
    after = bucket_files(path)
    changed = [b for b in before if before[b] != after[b]]
    assert len(changed) == 1 and before.keys() == after.keys()
    assert content(table) == sorted((i, "new" if i == 5 else f"t{i}", 2 if i == 5 else i) for i in range(200))
    again = KeyedTable(spark, path)  # opened anew
    assert [tuple(r) for r in again.lookup(spark.createDataFrame([(5,), (9_999,)], "id long")).collect()] == [(5, "new", 2)]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        KeyedTable.create(spark, path, rows.schema, ["id"])


def test_a_change_put_twice_counts_once(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0) for i in range(50)], "id long, n int")
    table = KeyedTable.create(spark, str(tmp_path / "t"), rows.schema, ["id"], 4)
    table.insert(rows, 1)
    more = lambda old, new: old.join(new, "id", "left").select("id", (F.col("n") + F.coalesce("by", F.lit(0))).alias("n"))
    by = spark.createDataFrame([(i, 10) for i in range(0, 50, 2)], "id long, by int")
    assert table.apply(by, 2, more) == 4
    assert table.apply(by, 2, more) == 0
    # a change that reached some buckets only, as when its job failed
    half = by.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(4))).where("b < 2").drop("b")
    table.apply(half, 3, more)
    assert table.apply(by, 3, more) == 2
    assert content(table) == [(i, 20 if i % 2 == 0 else 0) for i in range(50)]
    assert table.delete(rows, 4) == 4 and content(table) == []
    assert table.insert(rows.where("id = 7"), 5) == 1 and content(table) == [(7, 0)]


def test_tasks_in_a_store(spark, tmp_path):
    import datetime as dt

    due = dt.datetime(2024, 5, 1, 12)
    made = tasks.with_defaults(spark.createDataFrame([(1, "a", due, 30), (2, "b", None, None), (3, None, due, 5)], "id long, title string, due_date timestamp_ntz, reminder_offset_minutes int"))
    store = KeyedTable.create(spark, str(tmp_path / "t"), made.schema, ["id"], 4)
    store.insert(made, 1)
    store.insert(made.withColumn("title", F.lit("ignored")), 2)
    store.apply(spark.createDataFrame([(1, ["reminder_offset_minutes"], 60)], "id long, set_fields array<string>, reminder_offset_minutes int"), 3, tasks.patched)
    store.apply(spark.createDataFrame([(2,)], "id long"), 4, lambda old, ids: tasks.completed(old, ids).drop("error"))
    store.delete(spark.createDataFrame([(3,)], "id long"), 5)
    assert [(r.id, r.title, r.status, r.reminder_time) for r in store.read().orderBy("id").collect()] == [(1, "a", "pending", due - dt.timedelta(hours=1)), (2, "b", "completed", None)]


def test_null_keys_and_keys_of_two_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, l int, v string")
    table = KeyedTable.create(spark, str(tmp_path / "t"), rows.schema, ["k", "l"], 4)
    table.upsert(rows.withColumn("at", F.lit(1)), 1, "at")
    table.upsert(spark.createDataFrame([("a", 2, None, 1), ("c", 9, "new", 1)], "k string, l int, v string, at int"), 2, "at")
    assert sorted(content(table), key=str) == sorted([("a", 1, "x"), ("a", 2, None), ("b", 1, None), ("c", 9, "new")], key=str)
