"""Quality rules with risk-controlled thresholds."""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrays import release
from .common import read, stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Of the good documents of a stratum at most this share may be rejected by all rules together ...
RISK = 0.02
# ... in all strata at once with this probability of error.
ERROR = 0.05
# Rules reject above a cutoff of these statistics; tested cutoffs run from the loosest to the tightest in equal steps.
GRID = {
    "symbol_share": (1.0, 0.0, 100),
    "copied_lines": (1.0, 0.0, 100),
    "repeated_words": (1.0, 0.0, 100),
    "word_length": (30.0, 0.0, 120),
}

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def counts(text: str | None) -> tuple[int, ...]:
    """The base counts of one whole text and its lines with a word; null counts as empty."""
    if not text:
        return (0,) * 6
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return (len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated,
            len(lines))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def counts_of(texts: pd.Series) -> pd.DataFrame:
    found = pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS))
    release()
    return found


def base_failed() -> Column:
    """The plain rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_statistics() -> dict[str, Column]:
    """What the learned rules look at; 0 for a text without words."""
    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_share": share("n_symbols", "word_chars"), "copied_lines": share("n_dup_lines", "n_lines"),
            "repeated_words": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words")}


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def at_most(k: int, n: int, p: float) -> float:
    """Exact probability of at most k successes in n trials."""
    return 1.0 if k >= n else beta_fraction(n - k, k + 1, 1 - p)


def tightest(rejected: list[int], n: int, risk: float, error: float) -> int | None:
    """Index of the last cutoff that passes when the cutoffs are tested in order, loosest first, until one fails.

    A cutoff passes if so few rejections would have probability ``error`` at most were its true rate ``risk`` or more
    (an exact binomial test). Testing in a fixed order needs no correction among the cutoffs of one rule.
    """
    best = None
    for i, k in enumerate(rejected):
        if n == 0 or at_most(k, n, risk) > error:
            break
        best = i
    return best


def points(rule: str) -> list[float]:
    """The cutoffs of a rule, loosest first. Each is one division of whole numbers, as the statistics are, and both
    are rounded alike: comparing the two doubles is comparing the fractions."""
    loose, tight, n = GRID[rule]
    return [(tight * i + loose * (n - i)) / n for i in range(n + 1)]


def cutoffs(good: DataFrame, strata: int, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, a cutoff or null for each rule) from the counts of good labelled documents.

    The risk is shared by the rules, the error by strata and rules (Bonferroni). Documents are counted by stratum,
    rule and grid step before anything moves; a stratum's few hundred counts are then tested in one small task.
    """
    rules = list(GRID)
    steps = []
    for rule in rules:
        # The first cutoff, loosest first, that the value is above: as many as it is not above come before.
        kept = F.size(F.filter(F.array(*map(F.lit, points(rule))), lambda cutoff: F.col(rule) <= cutoff))
        steps.append(F.struct(F.lit(rule).alias("rule"), kept.alias("step")))
    counted = good.select("stratum", F.explode(F.array(*steps)).alias("s")).groupBy("stratum", "s.rule", "s.step").agg(
        F.count(F.lit(1)).alias("n"))

    def test(frame: pd.DataFrame) -> pd.DataFrame:
        found = {"stratum": frame["stratum"].iloc[0]}
        for rule in rules:
            grid = points(rule)
            by_step = frame[frame["rule"] == rule].groupby("step")["n"].sum()
            total, rejected = int(by_step.sum()), []
            for i in range(len(grid)):
                rejected.append(int(by_step.get(i, 0)) + (rejected[-1] if rejected else 0))
            best = tightest(rejected, total, risk / len(rules), error / max(1, strata * len(rules)))
            found[rule] = None if best is None else grid[best]
        return pd.DataFrame([found]).astype({r: "float64" for r in rules})

    return counted.groupBy("stratum").applyInPandas(test, "stratum string, " + ", ".join(f"{r} double" for r in rules))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``, all by default) in ``_row``, with the base counts, ``base_failed``
    and ``kept``.

    A document that passes the plain rules is rejected if a statistic is above its stratum's cutoff. All labelled
    documents of label 1 that pass the plain rules are the holdout; nothing else is learned from them. A stratum with
    too few of them to prove anything has no cutoffs and keeps its documents. Null stratum: a stratum of its own.
    Null text: empty, so base_failed. Null keys match no label. Repeated rows: judged each, counted each. Empty
    input: no rows.
    """
    columns = keep or docs.columns
    rows = stored(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(f"`{key}`").alias("_key"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{stratum}`")), F.lit("null")).alias("stratum"),
        counts_of(F.col(f"`{text}`")).alias("_c")).select("_row", "_key", "stratum", "_c.*"))
    measured = rows.withColumn("base_failed", base_failed()).withColumns(rule_statistics())
    marked = labels.filter("quality = 1").select(F.col(f"`{key}`").alias("_key")).filter("_key IS NOT NULL").distinct()
    good = measured.filter("NOT base_failed").select("_key", "stratum", *GRID).join(marked, "_key").drop("_key")
    found = stored(cutoffs(good, max(1, rows.select("stratum").distinct().count())))
    limits = found.select(F.col("stratum").alias("_s"), *[F.col(r).alias(f"_max_{r}") for r in GRID])
    over = F.lit(False)
    for rule in GRID:
        over = over | F.coalesce(F.col(rule) > F.col(f"_max_{rule}"), F.lit(False))
    return measured.join(limits, F.col("stratum") == F.col("_s"), "left").select(
        "_row", *COUNTS, "base_failed", (~F.col("base_failed") & ~over).alias("kept"))


def judged_documents(spark, directory: str) -> DataFrame:
    """op9: counts and verdict of every document; a stratum is a language."""
    docs = read(spark, directory, "documents", "doc_id", "lang", "text")
    labels = read(spark, directory, "labels", "doc_id", "quality")
    return judge(docs, labels, keep=["doc_id"]).select(
        "_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
