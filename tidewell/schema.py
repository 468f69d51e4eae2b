"""Relations of the store, the fact ledger, the task file and the run history."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _of(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


CHUNKS = _of(rowid=_L, id=_S, source=_S, type=_S, content=_S, mtime=_D, content_hash=_S, metadata=_S, created_at=_D, embedding=T.ArrayType(T.FloatType()))
SOURCES = _of(source=_S, type=_S, last_indexed=_D, content_hash=_S, chunk_count=_L)
FACTS = _of(id=_S, source=_S, subject=_S, object=_S, chunk_id=_S, superseded_by=_S)
PROVENANCE = _of(fact_id=_S, source=_S, evidence=_S, evidence_sha256=_S, source_sha256=_S, status=_S, superseded_fact_id=_S, updated_at=_D, absent_since=_D)
TASKS = _of(
    line_no=_I, command=_S, description=_S, schedule_type=_S, schedule_value=_S, uses_tokens=_B, local=_B, interval_seconds=_L, daily_hour=_I,
    daily_minute=_I, weekly_day=_I, timeout=_L, depends_on=_S, task_id=_S, catchup=_L, adaptive=_L,
)
RUNS = _of(id=_L, task_id=_S, stem=_S, command=_S, started_at=T.TimestampNTZType(), duration_s=_D, status=_S, exit_code=_I, output_tail=_S)
EVAL_CORPUS = _of(version=_L, description=_S, documents=T.ArrayType(_of(id=_S, title=_S, text=_S)))
EVAL_TRUTH = _of(version=_L, description=_S, questions=T.ArrayType(_of(id=_S, question=_S, relevant=T.ArrayType(_S), kind=_S)))
REQUIRED = ("id", "source", "type", "content")
