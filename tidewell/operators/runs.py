"""Run history: last status, gates, missed and overlapping runs, summaries.  ``runs`` follow ``schema.RUNS``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPEATED_HOUR_WINDOW_S = 70 * 60


def real(status: Column | None = None) -> Column:
    """Whether a run really ran; statuses that start with ``skipped`` are none."""
    return ~F.startswith(F.col("status") if status is None else status, F.lit("skipped"))


def last_status(runs: DataFrame) -> DataFrame:
    """(ref, status): the latest real run by id, for every task id and every stem."""
    refs = runs.where(real()).select("id", "status", F.explode(F.array_distinct(F.array("task_id", "stem"))).alias("ref"))
    return refs.where("ref is not null").groupBy("ref").agg(F.max_by("status", "id").alias("status"))


def dependency_gate(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """(task_id, depends_on, status, blocked): a task is blocked unless its dependency's last real run is ok."""
    last = last_status(runs).withColumnRenamed("ref", "depends_on")
    out = tasks.select("task_id", "depends_on").join(last, "depends_on", "left")
    return out.select("task_id", "depends_on", "status", (F.col("depends_on").isNotNull() & ~F.col("status").eqNullSafe(F.lit("ok"))).alias("blocked"))


def ran_since(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """``asked(task_id, since)`` with ``ran``: whether a real run began at or after that second."""
    newest = runs.where(real()).groupBy("task_id").agg(F.max(F.date_trunc("second", "started_at").cast("timestamp_ntz")).alias("newest"))
    out = asked.join(newest, "task_id", "left")
    return out.select("task_id", "since", F.coalesce(F.col("newest") >= F.date_trunc("second", "since").cast("timestamp_ntz"), F.lit(False)).alias("ran"))


def recent(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(limit)


def summary(runs: DataFrame) -> DataFrame:
    """Per task and status: runs, total and longest duration, first and last start."""
    return runs.groupBy("task_id", "status").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.sum("duration_s"), 6).alias("total_s"), F.max("duration_s").alias("longest_s"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at")
    )


# The next three order a task's rows by time.  They do so within days, and what a day needs of the days before (or after) it comes
# from one row a day, so that a busy task is as many tasks of Spark as it has days.


def _day(at: str = "at") -> Column:
    return F.date_trunc("day", F.col(at)).cast("date").alias("day")


def missed(due: DataFrame, runs: DataFrame) -> DataFrame:
    """``due(task_id, due, window_s)`` without a run that began within its window: one pass over due times and starts in order of time."""
    marks = due.select("task_id", F.col("due").alias("at"), "window_s", F.lit(1).alias("kind"))
    starts = runs.where(real()).select("task_id", F.col("started_at").alias("at"), F.lit(None).cast("long").alias("window_s"), F.lit(0).alias("kind"))
    lined = marks.unionByName(starts).withColumn("day", _day())
    later = Window.partitionBy("task_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = lined.groupBy("task_id", "day").agg(F.min(F.when(F.col("kind") == 0, F.col("at"))).alias("first")).withColumn("after", F.min("first").over(later)).drop("first")
    ahead = Window.partitionBy("task_id", "day").orderBy(F.desc("at"), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = lined.withColumn("in_day", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(ahead)).where("kind = 1").join(days, ["task_id", "day"])
    next_start = F.coalesce("in_day", "after")
    late = next_start.isNull() | (next_start > F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("window_s").cast("double")))
    return lined.where(late).select("task_id", F.col("at").alias("due"))


def overlapping(runs: DataFrame) -> DataFrame:
    """Runs that began while the same task's previous real run was still going: (task_id, id, previous_id)."""
    ends = F.col("started_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("duration_s"))
    lined = runs.where(real()).select("task_id", "id", "started_at", _day("started_at"), F.struct("id", ends.alias("end")).alias("run"))
    days = lined.groupBy("task_id", "day").agg(F.max_by("run", F.struct("started_at", "id")).alias("last"))
    days = days.withColumn("before", F.lag("last").over(Window.partitionBy("task_id").orderBy("day"))).drop("last")
    order = Window.partitionBy("task_id", "day").orderBy("started_at", "id")
    lined = lined.withColumn("in_day", F.lag("run").over(order)).join(days, ["task_id", "day"]).withColumn("previous", F.coalesce("in_day", "before"))
    return lined.where(F.col("previous.end") > F.col("started_at")).select("task_id", "id", F.col("previous.id").alias("previous_id"))


def coalesced(due: DataFrame, runs: DataFrame) -> DataFrame:
    """Per gap between two starts of a task: the due times in it count as one, the latest: (task_id, due, periods)."""
    marks = due.select("task_id", F.col("due").alias("at"), F.lit(1).alias("kind"))
    starts = runs.where(real()).select("task_id", F.col("started_at").alias("at"), F.lit(0).alias("kind"))
    lined = marks.unionByName(starts).withColumn("day", _day())
    earlier = Window.partitionBy("task_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = lined.groupBy("task_id", "day").agg(F.max(F.when(F.col("kind") == 0, F.col("at"))).alias("last")).withColumn("before", F.max("last").over(earlier)).drop("last")
    so_far = Window.partitionBy("task_id", "day").orderBy("at", F.desc("kind")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lined = lined.withColumn("in_day", F.last(F.when(F.col("kind") == 0, F.col("at")), ignorenulls=True).over(so_far)).where("kind = 1").join(days, ["task_id", "day"])
    return lined.groupBy("task_id", F.coalesce("in_day", "before").alias("gap")).agg(F.max("at").alias("due"), F.count(F.lit(1)).alias("periods")).drop("gap")


def repeated_hour(instants: DataFrame, zone: str) -> DataFrame:
    """``instants(at)`` (UTC, no zone) with ``repeated``: whether the offset one real hour before was larger than it is now."""
    offset = lambda t: F.unix_seconds(F.from_utc_timestamp(t, zone)) - F.unix_seconds(t)
    at = F.col("at").cast("timestamp")
    return instants.withColumn("repeated", offset(at - F.make_dt_interval(F.lit(0), F.lit(1))) > offset(at))


def gates(tasks: DataFrame, runs: DataFrame, states: DataFrame, now: float, started_at: str, repeated: bool, allow_tokens: bool, scheduled: bool) -> DataFrame:
    """(task_id, verdict): the status a task would be skipped with, or ``run``; gates in order: tokens, adaptive, dependency, repeated hour."""
    since = F.lit(started_at).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(REPEATED_HOUR_WINDOW_S)))
    ran = ran_since(tasks.select("task_id", since.alias("since")), runs).select("task_id", "ran")
    joined = tasks.join(dependency_gate(tasks, runs).select("task_id", "blocked"), "task_id").join(states.select("task_id", "skip_until"), "task_id", "left").join(ran, "task_id")
    waiting = F.lit(scheduled) & F.col("adaptive").isNotNull() & (F.lit(float(now)) < F.coalesce("skip_until", F.lit(0.0)))
    verdict = (
        F.when(F.col("uses_tokens") & ~F.lit(allow_tokens), "skipped_tokens")
        .when(waiting, "skipped_adaptive")
        .when(F.col("blocked"), "skipped_dependency")
        .when(F.lit(scheduled and repeated) & F.col("schedule_type").isin("daily", "weekly") & F.col("ran"), "skipped_repeated_hour")
        .otherwise("run")
    )
    return joined.select("task_id", verdict.alias("verdict"))
