"""Streaming twins of the run-history operators, over events that arrive as files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adaptive import multiplier_of

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS) -> DataFrame:
    """A stream over the Parquet files at a path; ``ts`` becomes a timestamp, which a watermark needs."""
    folder, _, name = path.rstrip("/").rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    # A table is a file or a folder of files; either way the stream watches a folder.
    stream = source.load(path, format="parquet") if _is_folder(spark, path) else spark.readStream.schema(schema).option("pathGlobFilter", name).load(folder, format="parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isDirectory()


def due_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, as a stream."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def once_per_session(events: DataFrame, late: str = "40 days") -> DataFrame:
    """The first event of each user and type, as a stream; state goes once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


STATE_OUT = "task_id string, runs long, unchanged long, longest long, times long"


def streaks(runs: DataFrame, cap: int = 8) -> DataFrame:
    """Per task the current streak of equal fingerprints, kept as state between batches: ``runs(task_id, id, ok, fingerprint)``."""

    def update(key, batches: Iterator[pd.DataFrame], state):
        seen, unchanged, n, longest = json.loads(state.get[0]) if state.exists else [None, 0, 0, 0]
        rows = pd.concat(list(batches)).sort_values("id")
        for ok, fp in zip(rows["ok"], rows["fingerprint"]):
            n += 1
            if not ok or pd.isna(fp):
                seen, unchanged = None, 0
            else:
                seen, unchanged = fp, unchanged + 1 if seen == fp else 0
            longest = max(longest, unchanged)
        state.update((json.dumps([seen, unchanged, n, longest]),))
        yield pd.DataFrame({"task_id": [key[0]], "runs": [n], "unchanged": [unchanged], "longest": [longest], "times": [multiplier_of(unchanged, cap)]})

    return runs.groupBy("task_id").applyInPandasWithState(update, STATE_OUT, "state string", "update", "NoTimeout")


def run_to_table(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all that is there now and return the rows that it emitted, as a table under ``folder``.

    In ``complete`` mode the last batch is the result; in ``update`` and ``append`` mode each batch's rows are kept with their batch number.
    """
    spark, tag = stream.sparkSession, uuid.uuid4().hex
    out = f"{folder}/stream-{tag}"

    def keep(df: DataFrame, batch: int) -> None:
        if mode == "complete":
            df.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/rows")
        else:
            # A folder per batch, so that a batch that is run again replaces its rows.
            df.write.mode("overwrite").parquet(f"{out}/rows/__batch={batch}")

    writer = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")
