"""The store's relations made of the given tables, by literal rules that the SQL of ``oracles`` repeats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fts_terms
from ..operators.index import Index, write_index
from ..operators.pivots import Pivots, write_pivots
from ..operators.strings import occurrences
from ..sources.snapshots import Store
from ..tables import shared_dir

#: The fixed "now" of all time-dependent queries: 2026-01-01 00:00:00 UTC.
NOW = 1767225600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark, sf_dir) -> DataFrame:
    """documents as chunks: source, type (the language), content; mtime counts back from NOW, every seventh has none."""
    d = table(spark, sf_dir, "documents")
    mtime = F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.lit(NOW) - (F.col("doc_id") % 400) * 86400.0)
    return d.select(F.col("doc_id").alias("rowid"), F.concat(F.lit("d"), "doc_id").alias("id"), "source", F.col("lang").alias("type"), F.col("text").alias("content"), mtime.alias("mtime"))


_indexes: dict[tuple, Index] = {}


def text_index(spark, sf_dir, tokenise=fts_terms) -> Index:
    """The stored full-text index of ``chunks``: written by the first query that asks for it, read by all later ones of the application while the table's files are the same."""
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, tokenise.__name__, _files(docs))
    if key not in _indexes:
        _indexes[key] = write_index(chunks(spark, sf_dir), f"{shared_dir(spark)}/tidewell-text-index-{uuid.uuid4().hex}", tokenise)
    return _indexes[key]


_pivots: dict[tuple, Pivots] = {}


def vector_index(spark, sf_dir) -> Pivots:
    """The vectors stored by pivot; written once, like ``text_index``."""
    rows = table(spark, sf_dir, "embeddings")
    key = (spark.sparkContext.applicationId, sf_dir, _files(rows))
    if key not in _pivots:
        _pivots[key] = write_pivots(vectors(spark, sf_dir), f"{shared_dir(spark)}/tidewell-vector-index-{uuid.uuid4().hex}")
    return _pivots[key]


_stores: dict[tuple, Store] = {}


def written_store(spark, sf_dir) -> Store:
    """A store of the documents on disk, masked, after three writes: all of them, every hundredth one anew with an end mark, and without the chunks of one source.

    Written by the first query that asks for it, like ``text_index``.
    """
    docs = table(spark, sf_dir, "documents")
    key = (spark.sparkContext.applicationId, sf_dir, _files(docs))
    if key not in _stores:
        store = Store(spark, f"{shared_dir(spark)}/tidewell-store-{uuid.uuid4().hex}")
        rows = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), "source", F.col("lang").alias("type"), F.col("text").alias("content"), F.col("doc_id").alias("batch_seq"))
        store.upsert(rows)
        store.upsert(rows.where("batch_seq % 100 = 0").withColumn("content", F.concat("content", F.lit(" revised edition"))))
        store.delete_by_source("src3")
        _stores[key] = store
    return _stores[key]


def _files(df: DataFrame) -> frozenset:
    """Path, length and time of each of a table's files."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in df.inputFiles()]
    found = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
    return frozenset((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def queries(spark, sf_dir) -> DataFrame:
    """benchmark items as queries, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("kind"))


def vectors(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("rowid"), F.concat(F.lit("v"), F.col("label"), F.lit("_"), "vec_id").alias("id"), F.concat(F.lit("s"), F.col("vec_id") % 5).alias("source"), F.col("label").cast("string").alias("type"), "embedding")


def vector_queries(spark, sf_dir) -> DataFrame:
    """The vectors whose id is divisible by 20, as queries."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def hybrid_chunks(spark, sf_dir) -> DataFrame:
    """chunks with vectors by doc_id modulo the number of vectors (every tenth chunk has none) and metadata from labels."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    c = chunks(spark, sf_dir).withColumn("vec_id", F.when(F.col("rowid") % 10 != 9, F.col("rowid") % n))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).select(F.col("doc_id").alias("rowid"), F.format_string('{"importance": %d}', "quality").alias("metadata"))
    return c.join(e.select("vec_id", "embedding"), "vec_id", "left").join(labels, "rowid", "left").drop("vec_id")


def hybrid_queries(spark, sf_dir) -> DataFrame:
    """benchmark items with a vector each; every third asks for what is recent."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    q = queries(spark, sf_dir)
    text = F.when(F.col("qid") % 3 == 0, F.concat(F.lit("latest "), "text")).otherwise(F.col("text"))
    return q.withColumn("text", text).join(e, "qid", "left")


def gold(spark, sf_dir) -> DataFrame:
    """(qid, rowid): documents that contain an item's whole text."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("needle"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    return occurrences(d, q).join(q, "needle").select("qid", F.col("key").alias("rowid"))


def runs(spark, sf_dir) -> DataFrame:
    """events as run history: the type is the task, ``error`` fails, a value above 150 is a timeout, k divisible by 10 a skipped run."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 150, "timeout").when(F.col("k") % 10 == 0, "skipped_tokens").otherwise("ok")
    return e.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("task_id"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("stem"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("started_at"),
        F.col("value").alias("duration_s"), status.alias("status"), "k", "user_id",
    )


def facts(spark, sf_dir) -> DataFrame:
    """A fact for every document: its object is the second line-free word run of 30 characters, of the next document for every fifteenth fact."""
    d = table(spark, sf_dir, "documents")
    f = d.select(F.col("doc_id").alias("n"), "source")
    shown = F.when(F.col("n") % 15 == 0, F.col("n") + 1).otherwise(F.col("n"))
    f = f.withColumn("shown", shown)
    t = d.select(F.col("doc_id").alias("shown"), F.translate(F.substring("text", 11, 30), "\n", " ").alias("object"), F.translate(F.substring("text", 1, 5), "\n", " ").alias("subject"))
    out = f.join(t, "shown")
    superseded = F.when(F.col("n") % 20 == 0, F.concat(F.lit("d"), F.col("n") + 5))
    return out.select(F.concat(F.lit("f"), "n").alias("id"), "source", "subject", "object", F.concat(F.lit("d"), F.col("n") + F.when(F.col("n") % 35 == 0, 10_000_000).otherwise(0)).alias("chunk_id"), superseded.alias("superseded_by"))


TASK_FILE = """# Tasks

## Every 15 minutes
- [ ] `python3 /opt/jobs/sync.py --all` -- [local] [timeout:60] copies notes
- [x] `bash /opt/jobs/rotate.sh` -- [id:rotate] [depends:sync] rotates logs
- [ ] `echo hi` -- says [tokens] later, which is prose

## Daily at 02:30
- [ ] `python -m pkg.backup` -- [local] [catchup:7200] [adaptive:4] backs up
- [ ] `bash /opt/jobs/rotate.sh` -- [id:rotate] again under another schedule

## Weekly on Friday at 17:45
- [ ] `node /srv/report.js` -- [tokens] [depends:rotate] weekly report
- [ ] `echo bad` -- [catchup:99999999] [adaptive:1] [depends:nothing] odd values
- [ ] `sh self.sh` -- [depends:self] waits for itself

## Every 0 minutes
- [ ] `echo lost` -- no valid schedule

## Daily at 25:00
## Weekly on Someday at 10:00
## On event: boot
## Every so often
### Notes
- [ ] `echo after notes` -- a heading ended the schedule
## Every 2 hours
- [ ] `echo no separator`
- ~~[ ] `echo struck` -- struck through~~
- [ ] `df -h` -- [local] disk
"""

INSTANTS = ["2026-10-24 23:30:00", "2026-10-25 00:30:00", "2026-10-25 01:30:00", "2026-10-25 02:30:00", "2026-03-29 00:30:00", "2026-03-29 01:30:00", "2026-07-01 12:00:00"]

DATE_TEXTS = [
    (1, "summary of the session on 2026-03-14"), (2, "Session du 3 février 2026"), (3, "the session of March 5th, 2026"), (4, "sessions before 2026-03-14"), (5, "session 2026-03-14 and 2026-03-15"),
    (6, "what happened on 2026-03-14"), (7, "session of 31 february 2026"), (8, "Session 1er août 2025, session 2025-08-01"), (9, "session of 5 mai 2026 or May 5 2026"), (10, "session entre le 3 mars 2026"), (11, "session 12026-03-14"),
]
HEADERS = [
    (1, "session", "Session 3fa9-01 - 2026-03-14 - Rollout\nbody"), (2, "session", "Notes\nSession 3fa9 - 2026-03-14 - x"), (3, "episode", "[session/3fa9]\nSession 3fa9 - 2026-03-15 - x"),
    (4, "episode", "Session 3fa9 - 2026-03-15 - x"), (5, "topic", "Session 3fa9 - 2026-03-15 - x"), (6, "session", "session ABC - 2026-01-02 - y"), (7, "episode", "[session/1]"),
]


def dated_prompts(spark, sf_dir) -> DataFrame:
    """conversations as (conv_id, turn, text): each turn with a request after it, in one of six forms by the sum of its numbers: three ask for the session of one day, three don't."""
    c = table(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    d = n % 28 + 1
    two = F.lpad(d.cast("string"), 2, "0")
    forms = [F.concat(F.lit("the session of 2026-03-"), two), F.concat(F.lit("la session du "), d, F.lit(" mars 2026")), F.concat(F.lit("sessions of March "), d, F.lit("th, 2026")), F.concat(F.lit("sessions after 2026-03-"), two), F.lit("the session of 2026-02-30"), F.concat(F.lit("notes of 2026-03-"), two)]
    asked = forms[0]
    for k in range(1, 6):
        asked = F.when(n % 6 == k, forms[k]).otherwise(asked)
    return c.select("conv_id", "turn", F.concat_ws(" ", "text", F.lit("--"), asked).alias("text"))


def headed_chunks(spark, sf_dir) -> DataFrame:
    """documents as chunks with a session header: of sessions in the first line, of episodes in the second one after a mark that every fifth lacks, of notes in vain."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    header = F.concat(F.lit("Session "), F.lower(F.hex(n)), F.lit(" - 2026-05-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit(" - notes\n"))
    kind = F.when(n % 3 == 0, "session").when(n % 3 == 1, "episode").otherwise("note")
    mark = F.when(n % 3 != 1, "").when(n % 5 == 0, "[other]\n").otherwise(F.concat(F.lit("[session/"), n, F.lit("]\n")))
    return d.select("doc_id", kind.alias("type"), F.concat(mark, header, F.coalesce("text", F.lit(""))).alias("content"))
