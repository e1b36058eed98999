"""The bounded cache against a plain one."""

import datetime as dt
import random
from collections import Counter

import pandas as pd
import pytest

from millrace.streaming import ingest


def plain_cache(rows, entries, seconds):
    """Hits of (by, key, at), taken in order of time and key within each cache."""
    caches, hits = {}, []
    for at, by, key in sorted((at, by, key) for by, key, at in rows):
        held = caches.setdefault(by, {})
        for k in [k for k, (_, made) in held.items() if at >= made + dt.timedelta(seconds=seconds)]:
            del held[k]
        if key in held:
            held[key] = (at, held[key][1])
            hits.append((by, key, at, True))
            continue
        if len(held) >= entries:
            del held[min(held, key=lambda k: (held[k][0], k))]
        held[key] = (at, at)
        hits.append((by, key, at, False))
    return sorted(hits)


@pytest.mark.parametrize(("entries", "seconds"), [(3, 300), (100, 300), (1, 50)])
def test_bounded_cache_equals_a_plain_one(spark, tmp_path, entries, seconds):
    rng = random.Random(entries)
    start, rows, t = dt.datetime(2024, 1, 1), [], 0
    for _ in range(400):
        t += rng.choice([0, 1, 5, 40, 400]) if rng.random() < 0.5 else 1
        rows.append((rng.choice("ab"), f"k{rng.randint(0, 7)}", start + dt.timedelta(seconds=t)))
    for i in range(4):  # batches in the order of time
        spark.createDataFrame(rows[100 * i : 100 * (i + 1)], "by string, key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("by string, key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    served = ingest.bounded_cache(stream, "by", "key", "at", entries, seconds, "1 day")
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))
    served.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(served.schema).parquet(str(tmp_path / "out")).collect()
    assert sorted((r.by, r.key, r.at, r.hit) for r in out) == plain_cache(rows, entries, seconds)


def test_cache_of_events_equals_a_plain_one(spark):
    from millrace.plans import logs

    events = pd.read_parquet("/root/testdata/sf0.001/events.parquet")
    rows = [(str(u), e, t.to_pydatetime()) for u, e, t in zip(events["user_id"], events["event_type"], events["ts"], strict=True)]
    want, asked = Counter(), Counter()
    for by, key, _, hit in plain_cache(rows, logs._CACHE_ENTRIES, logs._CACHE_DAYS * 86_400):
        want[by, key] += hit
        asked[by, key] += 1
    got = {(r.by, r.key): (r.requests, r.hits) for r in logs.result_cache_bounded(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: (n, want[k]) for k, n in asked.items()}
    assert 0 < sum(want.values()) < sum(asked.values())


def test_late_rows_are_left_out_of_closed_windows(spark, tmp_path):
    day = dt.datetime(2024, 1, 1)
    batches = [[(day, "a"), (day + dt.timedelta(hours=3), "a")], [(day + dt.timedelta(days=2, hours=2), "a")], [(day + dt.timedelta(days=2, hours=3), "a")], [(day + dt.timedelta(hours=5), "a"), (day + dt.timedelta(days=2), "a")], [(day + dt.timedelta(days=9), "a")]]
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = ingest.windowed_counts(stream, "ts", "kind")
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))
    counts.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    # rows are late by the watermark of the batch before: that of the first day, after two batches of the third; the ninth day isn't closed
    assert sorted((r.start, r.n) for r in spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect()) == [(day, 2), (day + dt.timedelta(days=2), 3)]


def test_keys_share_calls_of_python_and_rows_without_a_stamp_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "GROUPS", 2)
    start = dt.datetime(2024, 1, 1)
    at = lambda s, micros=0: start + dt.timedelta(seconds=s, microseconds=micros)
    first = [(f"k{i}", at(i)) for i in range(50)] + [("k0", at(300)), ("k1", at(300)), (None, at(5)), (None, at(6)), ("k2", None), ("m", at(100, 900)), ("m", at(400, 100)), ("m", at(400, 950))]
    batches = [first, [("k0", at(599)), ("k0", at(600)), ("k49", at(3_000))], [("k49", at(3_200))]]
    for rows in batches:
        spark.createDataFrame(rows, "key string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    served = ingest.cached_requests(stream, "key", "ts", 300)
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))
    run = served.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.key, r.at): r.hit for r in spark.read.schema(served.schema).parquet(str(tmp_path / "out")).collect()}
    miss = {(f"k{i}", at(i)) for i in range(50)} | {(None, at(5)), ("k0", at(300)), ("k0", at(600)), ("k49", at(3_000)), ("m", at(100, 900)), ("m", at(400, 950))}
    assert got == {(k, t): None if t is None else (k, t) not in miss for rows in batches for k, t in rows}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 2


def test_timers_fire_once_and_rows_without_a_key_only_move_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "GROUPS", 2)
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    first = [(i, "j", at(10 + i), at(0)) for i in range(40)] + [(1, "k", at(70), at(0)), (2, "k", at(30), at(2)), (2, "k", at(5), at(1)), (3, "k", at(9), at(1)), (3, "k", None, at(3)), (4, None, at(8), at(0))]
    batches = [first, [(None, "j", None, at(30))] * 3_000, [(39, "j", None, at(31)), (38, "j", at(90), at(32))], [(None, None, at(1), at(60))], [(None, "j", None, at(80))]]
    for rows in batches:
        spark.createDataFrame(rows, "id long, job string, run_at timestamp, seen_at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, job string, run_at timestamp, seen_at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = ingest.due_timers(stream)
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))
    run = fired.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(((r.id, r.job, r.fired_for) for r in spark.read.schema(fired.schema).parquet(str(tmp_path / "out")).collect()), key=str)
    assert got == sorted([(i, "j", at(10 + i)) for i in range(38)] + [(1, "k", at(70)), (2, "k", at(30)), (4, None, at(8))], key=str)
    plan = run._jsq.explainInternal(False)
    assert plan.index("SPARK_PARTITION_ID") < plan.index("EventTimeWatermark")  # the filter stands over the watermark


def test_bounded_caches_share_calls_of_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "GROUPS", 2)
    start, rng = dt.datetime(2024, 1, 1), random.Random(8)
    rows = sorted(((f"b{rng.randint(0, 19)}", f"k{rng.randint(0, 3)}", start + dt.timedelta(seconds=rng.randint(0, 2_000))) for _ in range(400)), key=lambda r: r[2])
    for part in (rows[:150] + [("b1", "k1", None)], rows[150:]):
        spark.createDataFrame(part, "by string, key string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("by string, key string, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    served = ingest.bounded_cache(stream, "by", "key", "at", 2, 300, "1 day")
    put = lambda batch, epoch: batch.write.mode("overwrite").parquet(str(tmp_path / "out" / f"epoch={epoch}"))
    run = served.writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [(r.by, r.key, r.at, r.hit) for r in spark.read.schema(served.schema).parquet(str(tmp_path / "out")).collect()]
    assert [r for r in got if r[2] is None] == [("b1", "k1", None, None)]
    assert sorted(r for r in got if r[2]) == plain_cache(rows, 2, 300)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]) <= 2
