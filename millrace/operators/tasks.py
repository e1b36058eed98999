"""A task store as a table: defaults, patches, pages and jobs that are due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("pending", "in_progress", "completed", "cancelled")
#: Columns that a patch may set.
PATCHED = ("title", "description", "status", "priority", "due_date", "reminder_offset_minutes")


def reminder_time(due: Column, offset_minutes: Column) -> Column:
    """The due time less the offset; null if either is missing."""
    return due - F.make_dt_interval(F.lit(0), F.lit(0), offset_minutes, F.lit(0))


def with_defaults(rows: DataFrame) -> DataFrame:
    """New tasks (id, title, due_date, ...) with the defaults and the derived reminder."""
    fill = {"status": F.lit("pending"), "priority": F.lit(0), "reminder_offset_minutes": F.lit(None).cast("int"), "tags": F.array().cast("array<string>"), "action_payload": F.lit(None).cast("map<string,string>")}
    out = rows
    for name, default in fill.items():
        out = out.withColumn(name, F.coalesce(name, default) if name in rows.columns else default)
    return out.withColumn("reminder_time", reminder_time(F.col("due_date"), F.col("reminder_offset_minutes")))


def patched(tasks: DataFrame, patches: DataFrame) -> DataFrame:
    """Tasks with the fields that a patch names in ``set_fields`` replaced, and reminders derived anew.

    A patch is a row (id, set_fields, any of PATCHED); a field that is set to null is cleared.
    """
    own = [c for c in PATCHED if c in patches.columns and c in tasks.columns]
    p = patches.select(F.col("id"), F.col("set_fields"), *(F.col(c).alias(f"_new_{c}") for c in own))
    out = tasks.join(p, "id", "left")
    for c in own:
        out = out.withColumn(c, F.when(F.array_contains("set_fields", c), F.col(f"_new_{c}")).otherwise(F.col(c)))
    touched = F.array_contains("set_fields", "due_date") | F.array_contains("set_fields", "reminder_offset_minutes")
    again = F.when(touched, reminder_time(F.col("due_date"), F.col("reminder_offset_minutes"))).otherwise(F.col("reminder_time"))
    return out.withColumn("reminder_time", again).drop("set_fields", *(f"_new_{c}" for c in own))


def page(tasks: DataFrame, skip: int = 0, limit: int = 10, status: str | None = None, priority: int | None = None) -> DataFrame:
    """A page of tasks, newest first; limits are from 1 to 100."""
    if not 1 <= limit <= 100 or skip < 0:
        raise ValueError("limit must be from 1 to 100, skip 0 or more")
    out = tasks
    if status is not None:
        out = out.where(F.col("status") == status)
    if priority is not None:
        out = out.where(F.col("priority") == priority)
    return out.orderBy(F.desc_nulls_last("created_at"), "id").offset(skip).limit(limit)


def completed(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tasks with those of ``ids`` completed, and an error where they already were."""
    marked = tasks.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    again = F.col("_hit") & (F.col("status") == "completed")
    out = marked.withColumn("error", F.when(again, "already completed"))
    return out.withColumn("status", F.when(F.col("_hit"), "completed").otherwise(F.col("status"))).drop("_hit")


def deleted(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    return tasks.join(ids.select("id"), "id", "left_anti")


def due_jobs(tasks: DataFrame, as_of: Column | None = None) -> DataFrame:
    """(id, job, run_at): a reminder and an execution for each pending task that has their times."""
    jobs = F.explode(F.array(F.struct(F.lit("reminder").alias("job"), F.col("reminder_time").alias("run_at")), F.struct(F.lit("execution").alias("job"), F.col("due_date").alias("run_at"))))
    out = tasks.where("status = 'pending'").select("id", jobs.alias("j")).select("id", "j.job", "j.run_at").where("run_at is not null")
    return out if as_of is None else out.where(F.col("run_at") <= as_of)
