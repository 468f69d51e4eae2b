"""Written intermediate tables.

Intermediate results go to Parquet tables under ``spark.checkpoint.dir``, the folder that
driver and executors share, so a lost executor costs only the tasks that it ran.  Where
that setting is unset a temporary folder takes its place, on a local master only.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, else, on a local master, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="tidewell-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return _own_dir[0]


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialise(df: DataFrame, tag: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder (a subfolder for each value of ``by``) and read it back, which cuts its lineage.

    The shuffle files of the write go with it.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewell-{tag}-{uuid.uuid4().hex}"
    out = df.write.options(compression="zstd", **options)
    with freeing_shuffles(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidewell_path = path
    return back


def discard(df: DataFrame | None, part: str = "") -> None:
    """Delete a table that ``materialise`` wrote, or the subfolder ``part`` of it; anything else is left alone."""
    path = getattr(df, "_tidewell_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
