"""Task file, run-history, back-off and streaming queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive, jobs, runs, tasks
from ..streaming import events as streams
from ..tables import shared_dir
from . import views as v


def _parsed(s):
    return tasks.parse(tasks.lines_of(s, v.TASK_FILE))


def parse_task_file(s, d):
    return _parsed(s)[0].select("line_no", "command", "schedule_type", "schedule_value", "uses_tokens", "local", "interval_seconds", "daily_hour", "daily_minute", "weekly_day", "timeout", "depends_on", "catchup", "adaptive", tasks.catch_up_seconds().alias("window_s"))


def task_errors(s, d):
    return _parsed(s)[1].select("line_no", "error")


def task_ids(s, d):
    return _parsed(s)[0].select("line_no", "task_id", "stem")


def due_times(s, d):
    return tasks.due_times(_parsed(s)[0], "2026-03-02 01:00:00", "2026-03-16 01:00:00")


def _due(s, d):
    """Every 15 minutes of January 2024 for each event type, with a window of 10 minutes."""
    types = v.runs(s, d).select("task_id").distinct()
    every = F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-30 23:45:00', interval 15 minutes)")
    return types.select("task_id", F.explode(every).alias("due"), F.lit(600).cast("long").alias("window_s"))


def missed_runs(s, d):
    return runs.missed(_due(s, d), v.runs(s, d))


def overlap_runs(s, d):
    return runs.overlapping(v.runs(s, d))


def coalesced_runs(s, d):
    return runs.coalesced(_due(s, d), v.runs(s, d))


def last_status(s, d):
    return runs.last_status(v.runs(s, d))


def _gated(s, d):
    """Each event type depends on a stem; one depends on what never ran."""
    t = v.runs(s, d).groupBy("task_id").agg(F.max("id").alias("m"))
    return t.select("task_id", F.when(F.col("task_id") == "error", "never").otherwise(F.concat(F.lit("u"), F.col("m") % 7)).alias("depends_on"))


def dependency_gate(s, d):
    return runs.dependency_gate(_gated(s, d), v.runs(s, d))


def ran_since(s, d):
    last = v.runs(s, d).groupBy("task_id").agg(F.max("started_at").alias("m"))
    asked = last.select("task_id", F.explode(F.array(F.col("m") - F.expr("interval 70 minutes"), F.col("m") + F.expr("interval 1 second"))).alias("since"))
    return runs.ran_since(asked, v.runs(s, d))


def gate_verdicts(s, d):
    """The gates in order for the tasks of the file, against runs of their stems."""
    t = _parsed(s)[0]
    h = v.runs(s, d).withColumn("stem", F.when(F.col("task_id") == "click", "sync").otherwise(F.col("stem")))
    states = t.where("adaptive is not null").select("task_id", F.lit(v.NOW + 60).alias("skip_until"))
    return runs.gates(t, h, states, v.NOW, "2024-01-02 00:00:00", True, False, True)


def recent_runs(s, d):
    return runs.recent(v.runs(s, d), 20).select("id", "task_id", "status", "duration_s")


def run_summary(s, d):
    return runs.summary(v.runs(s, d))


def repeated_hour(s, d):
    at = s.createDataFrame([(x,) for x in v.INSTANTS], "at string").select(F.col("at").cast("timestamp_ntz").alias("at"))
    return runs.repeated_hour(at, "Europe/Paris").select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "repeated")


def _outputs(s, d):
    """runs with an output of two kinds and a date, and blank ones; 24 tasks by user so that streaks arise."""
    r = v.runs(s, d).where(runs.real())
    kind = F.when(F.col("user_id") % 6 == 5, F.col("k") % 2).otherwise(F.floor(F.col("id") / 4000))
    output = F.when(F.col("k") % 97 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit("done 2024-01-"), F.lpad((F.col("k") % 28 + 1).cast("string"), 2, "0"), F.lit("T10:00:00Z  state "), kind.cast("string")))
    return r.select(
        F.concat(F.lit("t"), F.col("user_id") % 24).alias("task_id"), "id", (F.col("status") == "ok").alias("ok"), output.alias("output"), F.unix_seconds(F.col("started_at").cast("timestamp")).cast("double").alias("finished_at"),
        F.lit(900).cast("long").alias("period"), F.lit(8).cast("long").alias("cap"),
    )


def fingerprint(s, d):
    return _outputs(s, d).groupBy(adaptive.fingerprint(F.col("output")).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


def adaptive_state(s, d):
    return adaptive.latest_states(_outputs(s, d))


def adaptive_skips(s, d):
    """Runs after which the task would wait, with how long."""
    out = adaptive.states(_outputs(s, d)).where("skip_until > 0")
    return out.select("task_id", "id", "unchanged", (F.col("skip_until") - F.col("finished_at")).cast("long").alias("wait_s"))


def job_sync_diff(s, d):
    """The file's jobs against an older version of it."""
    new = _parsed(s)[0].select("task_id", "command", "schedule_value", "timeout")
    old = new.where("line_no <> 4").withColumn("timeout", F.when(F.col("task_id") == "rotate", 1).otherwise(F.col("timeout")))
    old = old.unionByName(s.createDataFrame([("gone", "echo gone", "5m", 120)], "task_id string, command string, schedule_value string, timeout long"))
    return jobs.sync(old, new)


def stream_due_windows(s, d):
    e = streams.read_events(s, f"{d}/events.parquet")
    return streams.run_to_table(streams.due_windows(e), "complete", shared_dir(s)).select("window_start", "event_type", "n")


def stream_adaptive(s, d):
    """Streaks kept as keyed state; the newest row of each task."""
    e = streams.read_events(s, f"{d}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("event_type").alias("task_id"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"), (k % 2).cast("string").alias("fingerprint"))
    out = streams.run_to_table(streams.streaks(rows), "update", shared_dir(s))
    newest = out.groupBy("task_id").agg(F.max_by(F.struct("runs", "unchanged", "longest", "times"), "__batch").alias("s"))
    return newest.select("task_id", "s.*")


def stream_dedup(s, d):
    """The first event of each user and type.  Which row of equals comes first is open, so only the keys are returned."""
    e = streams.read_events(s, f"{d}/events.parquet")
    return streams.run_to_table(streams.once_per_session(e), "append", shared_dir(s)).select("user_id", "event_type")


QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and not k.startswith("_") and getattr(f, "__module__", "") == __name__}
