"""Quality rules whose cutoffs come from quantile sketches per language and source.

Each text gets a few counts; their ratios, as whole 256ths, go into histograms with
logarithmic resolution (the low bits beyond the seven leading ones are cleared, so a value is
known to 1 part in 64).  Such histograms merge by adding counts: over partitions, and from
(language, source) groups into languages and into the whole, which stand in for groups
of fewer than ``MIN_ROWS`` texts.  A ratio's upper limit is the group's own upper quantile (named with the ratio) plus
``SPREADS`` times its distance from the median; the lower limit, where there is one, mirrors it.  No limit is a constant: where a group's texts
hold more symbols, capitals or repeats, its limits rise with them.  The upper quantile says what share of a group's texts may be junk without
moving the limit.  The limits are then joined to the rows; a text is above a limit only if it is so beyond counting noise (its count less ``NOISE`` of its roots).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise, ship

MIN_ROWS, SPREADS, NOISE, SCALE = 200, 4, 2, 256
#: Ratios: name, numerator, denominator, upper quantile in percent.
RATIOS = [
    ("symbols", "n_symbols", "n_words", 85),
    ("capitals", "n_upper", "word_chars", 95),
    ("repeats", "n_repeat_words", "n_words", 99),
    ("dup_lines", "n_dup_lines", "n_lines", 99),
    ("word_length", "word_chars", "n_words", 85),
]
#: The ratio that has a lower limit too, and its lower quantile in percent.
LOWER, LOWER_PERCENT = "word_length", 15
PERCENTS = sorted({50, LOWER_PERCENT, *(r[3] for r in RATIOS)})
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Groups up to which the limits go to every executor; beyond it rows and limits are joined by a shuffle that AQE may split.
BROADCAST_GROUPS = 100_000
WHITE, SYMBOLS, UPPER = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in a 3-word window that occurs twice or more."""
    ids: dict[bytes, int] = {}
    at = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    if len(at) < 4 or len(ids) == len(at):
        return 0
    pairs = np.unique(at[:-1] * len(ids) + at[1:], return_inverse=True)[1]
    _, which, times = np.unique(pairs[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
    again, inside = times[which] > 1, np.zeros(len(at), bool)
    for k in range(3):
        inside[k : k + len(again)] |= again
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS; n_lines counts lines with a word, n_upper the letters A-Z."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    return (len(words), len(text or "") - without(WHITE), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), without(UPPER))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        yield pd.DataFrame([measure(x) for x in s], columns=COUNTS, dtype="int64")


def sketches(measured: DataFrame) -> DataFrame:
    """Per (lang, source, ratio) the histogram: rows (lang, source, ratio, at, n)."""
    ratios = F.array(*[F.struct(F.lit(name).alias("ratio"), F.expr(f"__q.{a} * {SCALE} div nullif(__q.{b}, 0)").alias("v")) for name, a, b, _ in RATIOS])
    long = measured.where("not __q_base_failed").select("__q_lang", "__q_source", F.inline(ratios)).where("v is not null")
    long = long.withColumn("low", F.expr("greatest(length(bin(v)) - 7, 0)")).withColumn("at", F.expr("shiftleft(shiftright(v, low), low)"))
    return long.groupBy("__q_lang", "__q_source", "ratio", "at").agg(F.count(F.lit(1)).alias("n"))


def _quantiles(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Quantiles PERCENTS of merged histograms, with their row count."""
    merged = hist.groupBy(*keys, "ratio", "at").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    ranked = merged.select("*", F.sum("n").over(group.orderBy("at")).alias("upto"), F.sum("n").over(group).alias("rows"))
    at = lambda p: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * p, F.col("at"))).alias(f"q{p}")
    return ranked.groupBy(*keys, "ratio").agg(F.max("rows").alias("rows"), *[at(p) for p in PERCENTS])


def limits(measured: DataFrame) -> DataFrame:
    """Per (lang, source): the upper limit ``max_<ratio>`` of each ratio and the lower one of LOWER, in 256ths."""
    hist = materialise(sketches(measured), "quality-sketch")
    names = ["rows", *(f"q{p}" for p in PERCENTS)]
    as_ = lambda df, tag: df.select(*[c for c in df.columns if c not in names], *[F.col(c).alias(f"{tag}_{c}") for c in names])
    own, lang, whole = as_(_quantiles(hist, ["__q_lang", "__q_source"]), "s"), as_(_quantiles(hist, ["__q_lang"]), "l"), as_(_quantiles(hist, []), "w")
    lang = lang.withColumnsRenamed({"__q_lang": "l_lang", "ratio": "l_ratio"})
    both = own.join(lang, F.col("__q_lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio"))).join(whole, "ratio")
    pick = lambda c: F.when(F.col("s_rows") >= MIN_ROWS, F.col(f"s_{c}")).when(F.col("l_rows") >= MIN_ROWS, F.col(f"l_{c}")).otherwise(F.col(f"w_{c}"))
    both = both.select("__q_lang", "__q_source", "ratio", *[pick(c).alias(c) for c in names[1:]])
    beyond = lambda p: F.col(f"q{p}") + SPREADS * (F.col(f"q{p}") - F.col("q50"))
    cols = [F.max(F.when(F.col("ratio") == name, beyond(p))).alias(f"max_{name}") for name, _, _, p in RATIOS]
    cols.append(F.max(F.when(F.col("ratio") == LOWER, beyond(LOWER_PERCENT))).alias(f"min_{LOWER}"))
    out = materialise(both.groupBy("__q_lang", "__q_source").agg(*cols), "quality-limits")
    discard(hist)
    return out


def fine_sql(prefix: str, root: str = "sqrt") -> str:
    """SQL that is true for texts within the limits (null where a limit or a ratio is missing); ``prefix`` stands before a count's name."""
    tests = [f"{prefix}{a} - {NOISE} * {root}({prefix}{a}) <= max_{name} * {prefix}{b} / {SCALE}.0D" for name, a, b, _ in RATIOS]
    name, a, b, _ = next(r for r in RATIOS if r[0] == LOWER)
    return " and ".join(f"coalesce({t}, true)" for t in [*tests, f"{prefix}{a} + {NOISE} * {root}({prefix}{a}) >= min_{name} * {prefix}{b} / {SCALE}.0D"])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_cols: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``keep_cols``), ``__q`` (struct of COUNTS), ``__q_base_failed`` and ``__q_kept``.

    Null and empty texts have zero counts and fail the base rule.  Null languages and sources form groups of
    their own.  Rows repeat as they do in ``docs``.
    """
    ship(docs.sparkSession)
    cols = docs.columns if keep_cols is None else keep_cols
    counted = docs.select(*cols, F.col(lang_col).alias("__q_lang"), F.col(source_col).alias("__q_source"), _measures(F.col(text_col)).alias("__q"))
    failed = (F.col("__q.n_words") < MIN_WORDS) | (100 * F.col("__q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__q.n_words"))
    measured = materialise(counted.withColumn("__q_base_failed", failed), "quality-measured")
    lims = limits(measured).withColumnsRenamed({"__q_lang": "__q_l", "__q_source": "__q_s"})
    if lims.count() <= BROADCAST_GROUPS:
        lims = F.broadcast(lims)
    joined = measured.join(lims, F.col("__q_lang").eqNullSafe(F.col("__q_l")) & F.col("__q_source").eqNullSafe(F.col("__q_s")), "left")
    verdict = F.when(F.col("__q_base_failed"), F.lit(False)).otherwise(F.expr(fine_sql("__q.")))
    return joined.select(*cols, "__q", "__q_base_failed", verdict.alias("__q_kept"))
