"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .arrays import release
from .common import ROW, carried, discard, read, stored

FEATURES = ("words", "word_length", "word_spread", "symbols", "marks", "upper", "digits", "variety", "repeats",
            "top_word", "line_copies", "sentence_words")
# Rows with this remainder of crc32(id) modulo FOLDS are never learned from.
FOLDS, HELD_OUT = 5, 0
# Scores from here on count as label 1.
THRESHOLD = 0.3
# Share of the pooled covariance in each class covariance, and share of its diagonal alone in that.
POOLED, DIAGONAL = 0.1, 0.3
# Smallest variance of a feature that a class may show.
FLOOR = 1e-4

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>@^~_=+\\{}\[\]]")
_MARK = re.compile(r"[!?]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_SENTENCE = re.compile(r"[.!?]+(?=[\x20\x09-\x0D]|$)")


def statistics(text: str | None) -> list[float]:
    """The twelve transformed statistics of one whole text: logarithms of counts, square roots of shares. Null, empty
    and white-space texts have the statistics of a text without words, all 0."""
    words = _WORD.findall(text) if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    lengths = list(map(len, words))
    chars = sum(lengths)
    mean = chars / n
    spread = math.sqrt(max(0.0, sum(x * x for x in lengths) / n - mean * mean))
    counts = Counter(words)
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    repeats = sum(map(str.__eq__, words, words[1:]))
    return [
        math.log1p(n), math.log1p(mean), math.log1p(spread),
        math.sqrt(len(_SYMBOL.findall(text)) / chars), math.sqrt(len(_MARK.findall(text)) / chars),
        math.sqrt(len(_UPPER.findall(text)) / chars), math.sqrt(len(_DIGIT.findall(text)) / chars),
        math.log1p(len(counts)) / math.log1p(n), math.sqrt(repeats / n),
        math.sqrt(max(counts.values()) / n) if n > 20 else 0.0,
        math.sqrt(1 - len(set(lines)) / len(lines)),
        math.log1p(n / (1 + len(_SENTENCE.findall(text)))),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    found = texts.map(statistics)
    release()
    return found


class Discriminant:
    """Two Gaussian classes with shrunken covariances. ``whiteners`` are the inverses of the Cholesky factors, found
    once, so a Mahalanobis distance is the squared length of whitener @ x - offset."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        """moments: label -> (rows, sums, sums of outer products)."""
        counts = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
        # With a class of fewer rows than features + 1 there is no density to compare: the labels' share is the score.
        self.constant = (counts[1] + 1) / (sum(counts.values()) + 2)
        self.fitted = min(counts.values()) > len(FEATURES)
        if not self.fitted:
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        covariances = {k: q / n - np.outer(means[k], means[k]) for k, (n, _, q) in moments.items()}
        total = sum(counts.values())
        pooled = sum(counts[k] / total * covariances[k] for k in (0, 1))
        self.whiteners, self.offsets, self.logs = {}, {}, {}
        for k in (0, 1):
            shrunk = (1 - POOLED) * covariances[k] + POOLED * pooled
            shrunk = (1 - DIAGONAL) * shrunk + DIAGONAL * np.diag(np.diag(shrunk)) + FLOOR * np.eye(len(FEATURES))
            factor = np.linalg.cholesky(shrunk)
            self.whiteners[k] = np.linalg.inv(factor)
            self.offsets[k] = self.whiteners[k] @ means[k]
            self.logs[k] = math.log(counts[k] / total) - float(np.log(np.diag(factor)).sum())

    def score(self, features: Column) -> Column:
        """Probability of label 1 from an array column, in plain column arithmetic."""
        if not self.fitted:
            return F.lit(self.constant)
        x = [features[i] for i in range(len(FEATURES))]
        density = {}
        for k in (0, 1):
            distance = F.lit(0.0)
            for row, offset in zip(self.whiteners[k], self.offsets[k]):
                z = sum((x[i] * float(w) for i, w in enumerate(row) if w), F.lit(-float(offset)))
                distance = distance + z * z
            density[k] = F.lit(self.logs[k]) - distance / 2
        gap = density[0] - density[1]
        return 1 / (1 + F.exp(F.greatest(F.least(gap, F.lit(700.0)), F.lit(-700.0))))


def held_out(key: Column) -> Column:
    """True where crc32 of the id as text leaves the held-out remainder; a null id is held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """Learn from (key, features) and (key, label): class counts, sums and outer products are added up by Spark, and
    only those few hundred numbers reach the driver. Every labelled row outside the held-out fold counts; rows with a
    null key or label do not; of several labels of one key the largest counts."""
    by_key = labels.filter("key IS NOT NULL AND label IN (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    known = features.filter(~held_out(F.col("key"))).join(by_key, "key").select("label", "features")
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("features")[i]).alias(f"s{i}") for i in range(d)]
    squares = [F.sum(F.col("features")[i] * F.col("features")[j]).alias(f"q{i}_{j}") for i, j in pairs]
    moments = {}
    for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *sums, *squares).collect():  # two rows
        outer = np.zeros((d, d))
        for i, j in pairs:
            outer[i, j] = outer[j, i] = row[f"q{i}_{j}"]
        moments[int(row["label"])] = (float(row["n"]), np.array([row[f"s{i}"] for i in range(d)]), outer)
    return Discriminant(moments)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (columns ``keep``, all by default) in ``_row``, with ``held_out``, ``score`` and
    ``predicted``.

    The statistics of every whole text are found once and stored with the row; the fit and the scores read them.
    Null and empty texts are scored like any other. Repeated rows are scored each, and each counts in the fit.
    Without labels of both classes all rows get the labels' smoothed share. Empty input: no rows.
    """
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias(ROW),
                              F.col(f"`{key}`").alias("key"), statistics_of(F.col(f"`{text}`")).alias("features")))
    model = fit(rows.select("key", "features"),
                labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")))
    return rows.select(ROW, held_out(F.col("key")).alias("held_out"), model.score(F.col("features")).alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   label: str = "quality") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, unchanged. Only statistics are stored for the fit;
    they are found again where the rows are filtered, so no text is written."""
    found = statistics_of(F.col(f"`{text}`"))
    features = stored(docs.select(F.col(f"`{key}`").alias("key"), found.alias("features")))
    model = fit(features, labels.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label")))
    discard(features)
    return carried(docs, features=found).filter(model.score(F.col("features")) >= THRESHOLD).select(f"{ROW}.*")


def scored_documents(spark, directory: str) -> DataFrame:
    """op3: quality score of every document."""
    docs = read(spark, directory, "documents", "doc_id", "text")
    labels = read(spark, directory, "labels", "doc_id", "quality")
    return classify(docs, labels, keep=["doc_id"]).select(f"{ROW}.doc_id", "held_out", "score", "predicted")
