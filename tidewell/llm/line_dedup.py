"""Boilerplate lines by site-relative frequency, in DataFrame functions only.

A line's frequency is the share of its host's pages that contain it.  Lines above
``ratio`` and on ``min_pages`` pages or more go from every page of that host; the other
lines stay, in order.  Lines are known by a 96-bit hash within their host.

A host's boilerplate lines number less than (its lines per page) / ``ratio``, since each takes
more than ``ratio`` of its pages, so they travel to the pages as one short array per host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

RATIO, MIN_PAGES = 0.02, 5
#: Hosts, and keys of boilerplate lines over all hosts, up to which they go to every executor (some 50 MB); beyond it they are joined by a shuffle that AQE may split.
BROADCAST_HOSTS, BROADCAST_KEYS = 500_000, 2_000_000
BLANK = r"^[\x20\x09-\x0D]*$"


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def boilerplate(docs: DataFrame, host_col: str, text_col: str, ratio: float, min_pages: int, copies_once: bool = False) -> DataFrame:
    """Per host with boilerplate: ``__ld_host`` and ``__ld_lines``, the keys of its boilerplate lines; a null host counts as one host.

    With ``copies_once`` lines and pages are counted over a host's different texts; texts are known by the same kind of hash as lines.
    """
    pages = docs.select(F.col(host_col).alias("h"), F.col(text_col).alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: ~x.rlike(BLANK))
    text = [_key(F.col("t")).alias("page")] if copies_once else []
    each = pages.select("h", *text, F.explode(F.array_distinct(F.transform(lines, _key))).alias("k"))
    pages = pages.select("h", *text)
    if copies_once:
        each, pages = each.distinct(), pages.distinct()
    often = each.groupBy("h", "k").count().where(F.col("count") >= min_pages)
    totals = materialise(pages.groupBy("h").agg(F.count(F.lit(1)).alias("pages")), "lines-hosts")
    if totals.count() <= BROADCAST_HOSTS:
        totals = F.broadcast(totals)
    totals = totals.withColumnRenamed("h", "th")
    found = often.join(totals, F.col("h").eqNullSafe(F.col("th"))).where(F.col("count") > ratio * F.col("pages"))
    return materialise(found.groupBy(F.col("h").alias("__ld_host")).agg(F.collect_list("k").alias("__ld_lines")), "lines-found")


def dedup_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, copies_once: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines gone from ``text_col``, plus ``__ld_n_lines`` and ``__ld_n_dropped``.

    Null text stays null with zero lines; blank lines are never boilerplate; a text that is all boilerplate
    becomes empty, its row stays.  Repeated rows each count as a page, so a text stored often enough on one host loses all its
    lines; with ``copies_once`` equal texts of a host count as one page.  Other columns pass through unread.
    """
    found = boilerplate(docs, host_col, text_col, ratio, min_pages, copies_once)
    if (found.agg(F.sum(F.size("__ld_lines") + 4)).first()[0] or 0) <= BROADCAST_KEYS:
        found = F.broadcast(found)
    joined = docs.join(found, docs[host_col].eqNullSafe(found["__ld_host"]), "left")
    lines = F.split(text_col, "\n", -1)
    # Those of the page's lines that go are few, so that looking each line up in them costs little, however many the host has.
    joined = joined.withColumn("__ld_gone", F.array_intersect(F.transform(lines, _key), F.col("__ld_lines")))
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col("__ld_gone"), _key(x)))
    out = joined.withColumn("__ld_kept", F.when(F.coalesce(F.size("__ld_gone"), F.lit(0)) <= 0, lines).otherwise(kept))
    out = out.withColumns(
        {
            "__ld_n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long"),
            "__ld_n_dropped": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines) - F.size("__ld_kept")).cast("long"),
        }
    )
    out = out.withColumn(text_col, F.when(F.col("__ld_n_dropped") > 0, F.array_join("__ld_kept", "\n")).otherwise(F.col(text_col)))
    return out.select(*docs.columns, "__ld_n_lines", "__ld_n_dropped")
