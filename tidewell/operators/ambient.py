"""Context for prompts: keyword and vector hits, fused, kept only on evidence, at most a few per prompt."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import AMBIENT_WORD, ascii_lower, basename, collapse, fold, identifiers, prompt_tokens
from ..tables import materialise
from .bm25 import search_fts
from .fusion import rrf_scores
from .strings import occurrences
from .topk import best
from .vector import of_type, search_l2

FTS_LIMIT, VECTOR_LIMIT, MAX_PICKS, HEAD_CHARS, EXTRACT_CHARS, SNIPPET_TOKENS, OLD_DAYS = 6, 6, 2, 200, 170, 22, 90.0
INDEX_FILES = ("MEMORY.md",)
JOURNAL = r"[0-9]{4}-[0-9][0-9]-[0-9][0-9](-weekly)?\.md$"


def unknown_identifiers(prompts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid): prompts that name an identifier which no chunk contains."""
    asked = prompts.select("qid", F.explode(identifiers(F.col("text"))).alias("identifier"))
    asked = asked.select("qid", ascii_lower(F.col("identifier")).alias("needle"))
    texts = chunks.select("rowid", ascii_lower(F.col("content")).alias("text")).withColumnRenamed("rowid", "key")
    known = occurrences(texts, asked).select("needle").distinct()
    return asked.join(known, "needle", "left_anti").select("qid").distinct()


def coverage(prompts: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, rowid, covers): how many distinct words of the prompt a chunk holds, both folded."""
    words = F.regexp_extract_all(fold(F.coalesce("content", F.lit(""))), F.lit(AMBIENT_WORD), F.lit(0))
    wanted = prompts.select("qid", F.transform(prompt_tokens(F.col("text")), fold).alias("wanted"))
    joined = hits.select("qid", "rowid").join(chunks.select("rowid", "content"), "rowid").join(wanted, "qid")
    return joined.select("qid", "rowid", F.size(F.array_intersect(words, "wanted")).alias("covers"))


def snippet(text: str, terms: list[str], size: int = SNIPPET_TOKENS) -> str:
    """About ``size`` tokens of a text around the place with the most distinct terms, with marks where it is cut."""
    spans = [m.span() for m in re.finditer(r"\w+", text)]
    if not spans:
        return text[:HEAD_CHARS]
    wanted = set(terms)
    hit = [text[a:b].lower() in wanted for a, b in spans]
    first = max(range(len(spans)), key=lambda i: (len({text[a:b].lower() for (a, b), h in zip(spans[i : i + size], hit[i : i + size]) if h}), hit[i], -i)) if any(hit) and len(spans) > size else 0
    last = min(len(spans), first + size) - 1
    return ("..." if first else "") + text[spans[first][0] if first else 0 : spans[last][1] if last < len(spans) - 1 else len(text)] + ("..." if last < len(spans) - 1 else "")


def _snippets():
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, terms in batches:
            yield pd.Series([snippet(t or "", list(w)) for t, w in zip(text, terms)], dtype="object")

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())


def qualifies(now: float, old_days: float = OLD_DAYS, index_files=INDEX_FILES, pinned=()) -> Column:
    """The evidence rules over the columns semantic, covers, mtime and source."""
    words, name = F.col("covers") >= 2, basename(F.col("source"))
    dated = F.coalesce(F.col("mtime"), F.lit(0.0)) != 0
    old = dated & ((F.lit(float(now)) - F.col("mtime")) / 86400.0 > old_days)
    if pinned:
        old = old & ~name.isin(*pinned)
    return (F.col("semantic") | words) & ~name.isin(*index_files) & ((F.col("semantic") & words) | ~(old | name.rlike(JOURNAL)))


def _candidates(prompts: DataFrame, chunks: DataFrame, now: float, snippets: bool, types: str | Iterable[str] | None, **rules) -> DataFrame:
    """Every chunk that a prompt may be given, with its extract and its order: at most FTS_LIMIT + VECTOR_LIMIT a prompt."""
    allowed = None
    if types is not None:
        allowed = of_type(types)
        allowed = F.lit(False) if allowed is None else allowed
    asked = materialise(prompts.where(F.size(prompt_tokens(F.col("text"))) >= 2).join(unknown_identifiers(prompts, chunks), "qid", "left_anti"), "asked")
    words = materialise(search_fts(asked, chunks, FTS_LIMIT, words=prompt_tokens, allowed=allowed).select("qid", "rowid", "rank"), "by-words")
    lists = words.select("qid", F.lit(0).alias("list_id"), "rank", F.col("rowid").alias("key"))
    near = None
    if "embedding" in prompts.columns:
        near = materialise(search_l2(asked.where("embedding is not null"), chunks, VECTOR_LIMIT, allowed).select("qid", "rowid", "rank"), "by-vectors")
        lists = lists.unionByName(near.select("qid", F.lit(1).alias("list_id"), "rank", F.col("rowid").alias("key")))
    fused = rrf_scores(lists).select("qid", F.col("key").alias("rowid"), F.round("score", 9).alias("score"), "place")
    ev = fused.join(coverage(asked, words, chunks), ["qid", "rowid"], "left").withColumn("covers", F.coalesce("covers", F.lit(0)))
    ev = ev.join(words.select("qid", "rowid", F.lit(True).alias("by_words")), ["qid", "rowid"], "left")
    if near is not None:
        ev = ev.join(near.select("qid", "rowid", F.lit(True).alias("semantic")), ["qid", "rowid"], "left").withColumn("semantic", F.coalesce("semantic", F.lit(False)))
    else:
        ev = ev.withColumn("semantic", F.lit(False))
    rows = ev.join(chunks.select("rowid", "type", "source", "content", "mtime"), "rowid").where(qualifies(now, **rules)).join(asked.select("qid", "session_id", "text"), "qid")
    head = F.substring("content", 1, HEAD_CHARS)
    text = F.when(F.col("by_words"), _snippets()(F.col("content"), prompt_tokens(F.col("text")))).otherwise(head) if snippets else head
    rows = rows.withColumn("extract", F.substring(collapse(text), 1, EXTRACT_CHARS)).where("extract <> ''")
    return rows.select("qid", "session_id", "rowid", "type", "source", "extract", "score", "place")


def select_context(prompts: DataFrame, chunks: DataFrame, now: float, limit: int = MAX_PICKS, given: DataFrame | None = None, snippets: bool = True, types: str | Iterable[str] | None = None, **rules) -> DataFrame:
    """(qid, pick, rowid, type, source, extract) for ``prompts(qid, session_id, text[, embedding])``; prompts without evidence get no rows.

    Only chunks of ``types`` are given, one type as a string or several; an empty list means no chunk, None all.  Statistics and known identifiers are those of all chunks.  ``given(session_id, rowid)`` never come again.  A batch takes all its prompts
    against the same ``given``; ``select_in_order`` follows the order within sessions.
    """
    rows = _candidates(prompts, chunks, now, snippets, types, **rules)
    if given is not None:
        rows = rows.join(given, ["session_id", "rowid"], "left_anti")
    order = [F.desc("score"), F.col("place"), F.col("rowid")]
    one = rows.withColumn("__n", F.row_number().over(Window.partitionBy("qid", "source").orderBy(*order))).where("__n = 1")
    return best(one, limit, *order, rank="pick").select("qid", "pick", "rowid", "type", "source", "extract")


def _in_turn(limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["turn", "qid", "score", "place", "rowid"], ascending=[True, True, False, True, True], kind="stable")
        given: set[int] = set()
        out = []
        for qid, rows in pdf.groupby("qid", sort=False):
            sources: set = set()
            for r in rows.itertuples(index=False):
                if r.rowid not in given and r.source not in sources and len(sources) < limit:
                    sources.add(r.source)
                    out.append((qid, len(sources), r.rowid, r.type, r.source, r.extract))
            given |= {x[2] for x in out if x[0] == qid}
        return pd.DataFrame(out, columns=["qid", "pick", "rowid", "type", "source", "extract"])

    return run


def select_in_order(prompts: DataFrame, chunks: DataFrame, now: float, limit: int = MAX_PICKS, snippets: bool = True, types: str | Iterable[str] | None = None, **rules) -> DataFrame:
    """``select_context`` for ``prompts`` with a ``turn``: what a session has been given in an earlier turn is not given to it again.

    All prompts are searched as one batch, and each session's few candidates are then dealt out in order; prompts without a session share one.
    """
    rows = _candidates(prompts, chunks, now, snippets, types, **rules).join(prompts.select("qid", "turn"), "qid")
    out = "qid long, pick int, rowid long, type string, source string, extract string"
    return rows.withColumn("session_id", F.coalesce("session_id", F.lit("?"))).groupBy("session_id").applyInPandas(_in_turn(limit), out)
