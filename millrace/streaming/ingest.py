"""Streams: files taken in as they come, logs appended by day, timers of tasks."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import files, parsers


def file_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """New files of a folder, each once, as rows (path, file_type, content)."""
    from ..functions import text as tx

    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    found = rows.option("maxFilesPerTrigger", files_at_once).load(folder)
    return found.select("path", tx.extension(F.col("path")).alias("file_type"), "content").where(F.col("file_type").isin(list(files.EXTENSIONS)))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse all files that have come since the last run and append their elements as Parquet."""
    elements = parsers.parsed(file_stream(spark, folder), "path", "content", "file_type")
    writer = elements.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def log_stream(rows: DataFrame, out: str, checkpoint: str, stamp: str) -> StreamingQuery:
    """Records as JSON lines in one folder for each batch and UTC day; a batch that is put again counts once."""

    def put(batch: DataFrame, epoch: int) -> None:
        files.write_log_batch(batch, out, F.col(stamp), epoch)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(rows: DataFrame, stamp: str, by: str, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Rows of each window and key; rows later than the watermark are left out."""
    return rows.withWatermark(stamp, late).groupBy(F.window(stamp, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_seen(rows: DataFrame, stamp: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key's first row within the watermark."""
    return rows.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


#: Groups that keys are dealt to. Python is called once for each group with rows or an ended timer, not for each key.
GROUPS = 1_024


def _group(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).alias("grp")


def cached_requests(requests: DataFrame, key: str, stamp: str, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """Requests (key, stamp, hit): whether a result for the key, kept for ``seconds`` after it was made, still served.

    A request without a live entry is a miss and makes one. Entries are dropped once event time
    has passed their end, when their group is asked for or by a timer when all of it has ended, so that
    what is kept are the keys of one period, in ``GROUPS`` rows. Requests of a batch are taken in the order of
    their stamps; one without a stamp has a null ``hit``. Rows that come later than
    ``late`` behind the newest row of an earlier batch are left out; a stream whose files are
    not in the order of time needs a ``late`` that covers them.
    """
    span = seconds * 1_000_000
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(stamp).alias("seen")).withWatermark("seen", late)
    rows = rows.select(_group("key"), "key", "seen", F.unix_micros(F.col("seen").cast("timestamp")).alias("at"))

    def work(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        made = dict(zip(*state.get, strict=True)) if state.exists else {}
        asked = pd.concat([rows[["key", "at"]] for rows in batches])
        bare = asked["key"][asked["at"].isna()]
        if len(bare):
            yield pd.DataFrame({"key": bare, "at": None, "hit": None})
            asked = asked.dropna(subset=["at"])
        codes, names = pd.factorize(asked["key"], use_na_sentinel=False)
        at = asked["at"].to_numpy(np.int64)
        order = np.lexsort((at, codes))
        codes, at, stamps = codes[order], at[order], at[order].tolist()
        ends, hit = np.searchsorted(codes, np.arange(len(names)), "right").tolist(), np.ones(len(at), bool)
        i = 0
        for name, end in zip((None if pd.isna(n) else n for n in names), ends, strict=True):
            if name in made:
                i = bisect_left(stamps, made[name] + span, i, end)
            while i < end:
                hit[i], made[name] = False, stamps[i]
                i = bisect_left(stamps, stamps[i] + span, i + 1, end)
        now = state.getCurrentWatermarkMs() * 1000
        made = {k: m for k, m in made.items() if m + span > now}
        if made:
            state.update((list(made), list(made.values())))
            state.setTimeoutTimestamp(-(-(max(made.values()) + span) // 1000))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": asked["key"].to_numpy()[order], "at": at, "hit": hit})

    out = rows.groupBy("grp").applyInPandasWithState(work, "key string, at long, hit boolean", "keys array<string>, made array<long>", "append", "EventTimeTimeout")
    return out.select("key", F.timestamp_micros("at").alias("at"), "hit")


def bounded_cache(requests: DataFrame, by: str, key: str, stamp: str, entries: int = 100, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """Requests (by, key, at, hit) of caches, one for each value of ``by``, that hold ``entries`` results at most.

    A result is kept for ``seconds`` after it was made; where one is to be made in a full cache, the
    entry that was asked for least recently leaves (of equal ones the lesser key). A hit doesn't make
    an entry last longer. State is bounded by ``entries`` for each cache, in ``GROUPS`` rows, and goes when all of
    a group has ended. Requests of a batch are taken in the order of stamp and key; late rows and ones without a
    stamp as in ``cached_requests``.
    """
    span = seconds * 1000
    rows = requests.select(F.col(by).cast("string").alias("by"), F.col(key).cast("string").alias("key"), F.col(stamp).alias("seen")).withWatermark("seen", late)
    rows = rows.select(_group("by"), "by", "key", "seen", F.unix_millis(F.col("seen").cast("timestamp")).alias("at"))

    def work(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        caches: dict[str, dict[str, tuple[int, int]]] = {}  # by, key: when it was asked for last, when it was made
        for name, k, used, made in zip(*state.get, strict=True) if state.exists else ():
            caches.setdefault(name, {})[k] = (used, made)
        asked: dict[str, list] = {}
        for part in batches:
            bare = part["at"].isna()
            if bare.any():
                yield part.loc[bare, ["by", "key"]].assign(at=None, hit=None)
                part = part[~bare]
            for name, at, k in zip(part["by"].tolist(), part["at"].astype("int64").tolist(), part["key"].tolist(), strict=True):
                asked.setdefault(name, []).append((at, k))
        out = []
        for name, own in asked.items():
            held = caches.get(name, {})
            for at, k in sorted(own):
                held = {x: v for x, v in held.items() if at < v[1] + span}
                out.append((name, k, at, k in held))
                if k in held:
                    held[k] = (at, held[k][1])
                    continue
                if len(held) >= entries:
                    del held[min(held, key=lambda x: (held[x][0], x))]
                held[k] = (at, at)
            caches[name] = held
        now = state.getCurrentWatermarkMs()
        kept = [(name, k, used, made) for name, held in caches.items() for k, (used, made) in held.items() if made + span > now]
        if kept:
            state.update(tuple(list(c) for c in zip(*kept, strict=True)))
            state.setTimeoutTimestamp(max(made for *_, made in kept) + span)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["by", "key", "at", "hit"])

    kept = "bys array<string>, keys array<string>, used array<long>, made array<long>"
    out = rows.groupBy("grp").applyInPandasWithState(work, "by string, key string, at long, hit boolean", kept, "append", "EventTimeTimeout")
    return out.select("by", "key", F.timestamp_millis("at").alias("at"), "hit")


def due_timers(tasks: DataFrame, stamp: str = "run_at", key: str = "id", seen: str = "seen_at") -> DataFrame:
    """Jobs (id, job, run_at) once event time has passed their time; a later row of a job replaces it, a null time cancels it.

    Rows of a batch are taken in the order of ``seen``, of equal ones a null or earlier time first. A row without
    a key only moves event time on, and goes no further. Waiting jobs are kept in ``GROUPS`` rows.
    """
    # the filter isn't deterministic, so that Spark doesn't move it before the watermark, which all rows must pass
    rows = tasks.withWatermark(seen, "0 seconds").where(F.col(key).isNotNull() | (F.spark_partition_id() < 0))
    millis = lambda name: F.unix_millis(F.col(name).cast("timestamp"))
    rows = rows.select(_group(key, "job"), F.col(key).cast("long").alias("id"), "job", F.col(seen).alias("seen"), millis(seen).alias("told"), millis(stamp).alias("due"))

    def work(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        waiting = {(i, job): due for i, job, due in zip(*state.get, strict=True)} if state.exists else {}
        if not state.hasTimedOut:
            asked = pd.concat([rows[["id", "job", "told", "due"]] for rows in batches]).sort_values(["told", "due"], na_position="first")
            for i, job, due in zip(asked["id"].tolist(), asked["job"].tolist(), asked["due"].tolist(), strict=True):
                if pd.isna(due):
                    waiting.pop((i, job), None)
                else:
                    waiting[i, job] = int(due)
        now = state.getCurrentWatermarkMs()
        fired = [(*k, due) for k, due in waiting.items() if due <= now]
        waiting = {k: due for k, due in waiting.items() if due > now}
        if waiting:
            state.update(([i for i, _ in waiting], [job for _, job in waiting], list(waiting.values())))
            state.setTimeoutTimestamp(min(waiting.values()))
        elif state.exists:
            state.remove()
        if fired:
            yield pd.DataFrame(fired, columns=["id", "job", "fired_for"])

    kept = "ids array<long>, jobs array<string>, due array<long>"
    out = rows.groupBy("grp").applyInPandasWithState(work, "id long, job string, fired_for long", kept, "append", "EventTimeTimeout")
    return out.select("id", "job", F.timestamp_millis("fired_for").alias("fired_for"))
