"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import ROW, WORD, carried, read, seeded, stored, word_count

# Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
# The mix takes this share of all sizes, as a fraction of whole numbers.
BUDGET = (3, 2)
# No source is repeated more often than this.
MAX_EPOCHS = 2
SEED = 17
# Hex digits of the seeded hash that name a bucket: 4,096 buckets, so that only a 4,096th of a source is ever sorted.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, capped) from (source, source_size), one row per source.

    Every source gets ``level * weight``, clamped at ``max_epochs * source_size``. Sources are visited by the
    level at which they clamp; the level is what the budget leaves after the sources clamped so far, shared over
    the weight of the rest. The right level is the first that clamps no further source; where the budget exceeds
    all caps, all are clamped. All sums are whole numbers, so every engine finds the same doubles.
    """
    by_code_point = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.row_number().over(by_code_point) - 1) % len(weights) + 1).cast("long")
    named = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    numerator, denominator = budget
    swept = (
        named.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", numerator * F.col("total")
                    - denominator * F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # This source stays below its cap if all those before it are clamped.
        .withColumn("free", F.col("left") * F.col("weight") <= denominator * F.col("cap") * F.col("open"))
    )
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "left", "open"))).over(whole)
    level = swept.withColumn("level", first)
    share = (F.col("weight") * F.col("level.left")).cast("double") / (denominator * F.col("level.open")).cast("double")
    capped = F.col("level").isNull() | (
        F.col("weight") * F.col("level.left") >= denominator * F.col("cap") * F.col("level.open"))
    return level.select("source", "source_size", F.when(capped, F.col("cap").cast("double")).otherwise(share)
                        .alias("target"), capped.alias("capped"))


def _plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole copies, words left for a further copy of some documents, and the bucket where they end."""
    bucket_sizes = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    up_to = Window.partitionBy("source").orderBy("bucket")
    targets = (
        targets.withColumn("copies", F.when(F.col("capped"), F.lit(MAX_EPOCHS)).when(F.col("source_size") == 0, 0)
                           .otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long"))
        .withColumn("rest", F.round(F.col("target")).cast("long") - F.col("copies") * F.col("source_size"))
        .withColumn("rest", F.greatest(F.col("rest"), F.lit(0)))
    )
    ends = (
        bucket_sizes.withColumn("upto", F.sum("size").over(up_to)).withColumn("before", F.col("upto") - F.col("size"))
        .withColumnRenamed("source", "_s")
        .join(targets, F.col("_s").eqNullSafe(F.col("source")))
        .filter((F.col("before") < F.col("rest")) & (F.col("upto") >= F.col("rest")))
        .groupBy("source").agg(F.min(F.struct("before", "bucket")).alias("end"))
        .select(F.col("source").alias("_s"), "end")
    )
    return targets.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_source"), "source_size", "target", "copies", "rest",
        F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("end_before"))


def mix(docs: DataFrame, key: Column, source: Column, size: Column, *, weights: tuple[int, ...] = WEIGHTS,
        budget: tuple[int, int] = BUDGET, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` in the column ``_row``, with its source's size and target and what the mix takes of it:
    ``copies`` whole repetitions and the first ``part`` units of one more.

    Inside a source, documents stand in the order of a seeded hash of ``key``; the fractional repetition takes them
    from the front until the target is met to the unit, so at most one document of a source is taken in part.
    Only bucket sums (at most 4,096 rows a source) and the one bucket where a source's repetition ends are ordered;
    no task sees a whole source. Reruns agree whatever the partitioning.

    Null source: a source of its own, last in code-point order. Null text: size 0, so nothing is taken of it.
    Equal keys: equal hash; ordered by size, so which of several equal rows is taken in part does not change the
    sums. Empty input: no rows. Clashing column names: the input row is a struct and keeps its own names.
    """
    digest = seeded(key, seed)
    rows = carried(docs, source=source, size=F.coalesce(size, F.lit(0)).cast("long"), order=digest,
                   bucket=F.substring(digest, 1, BUCKET_DIGITS))
    sizes = rows.select("source", "size", "bucket")
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = stored(_plan(sizes, source_targets(totals, weights, budget)))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_source")))
    fixed = joined.withColumn("part", F.when(F.col("bucket") < F.col("end_bucket"), F.col("size"))
                              .otherwise(F.lit(0)).cast("long"))
    is_end = F.coalesce(F.col("bucket") == F.col("end_bucket"), F.lit(False))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("order", "size")
    running = F.sum("size").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    ended = joined.filter(is_end).withColumn("part", F.greatest(F.lit(0), F.least(
        F.col("size"), F.col("rest") - F.col("end_before") - F.coalesce(running, F.lit(0)))).cast("long"))
    out = [ROW, "source_size", "target", "size", "copies", "part"]
    return fixed.filter(~is_end).select(*out).unionByName(ended.select(*out)).withColumn(
        "taken", F.col("copies") * F.col("size") + F.col("part"))


def first_words(text: Column, count: Column) -> Column:
    """The text up to the end of its ``count``-th word."""
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD)
    length = F.aggregate(F.slice(words, F.lit(1), count), F.lit(0), lambda n, w: n + F.length(w)) \
        + F.aggregate(F.slice(gaps, F.lit(1), count), F.lit(0), lambda n, g: n + F.length(g))
    return F.substring(text, F.lit(1), length)


def repeat_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: every row as often as the mix takes it, the columns of ``docs`` unchanged but for
    the text (and ``n_chars``, if there) of a document taken in part."""
    mixed = mix(docs, F.col(f"`{key}`"), F.col(f"`{source}`"), word_count(F.col(f"`{text}`")))
    whole = mixed.filter("copies > 0 OR part = size AND size > 0").withColumn(
        "times", F.col("copies") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0))
    copies = whole.select(ROW, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("_copy")).select(f"{ROW}.*")
    own = {c: F.col(f"{ROW}.`{c}`") for c in docs.columns}
    cut = first_words(own[text], F.col("part").cast("int"))
    changed = {text: cut, "n_chars": F.length(cut).cast("long")}
    parts = mixed.filter("part > 0 AND part < size").select(
        *[changed.get(c, own[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return copies.unionByName(parts)


def mixed_documents(spark, directory: str) -> DataFrame:
    """op1: what the mix takes of every document."""
    sized = stored(read(spark, directory, "documents", "doc_id", "source", "text").select(
        "doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix(sized, F.col("doc_id"), F.col("source"), F.col("size")).select(
        f"{ROW}.doc_id", "size", "source_size", "target", "taken", "copies", "part")


# The twin writes the whole law as plain sums over all documents.
MIXED_DOCUMENTS_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
src AS (
  SELECT source, sum(size) AS source_size, 2 * sum(size) AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT a.source, a.cap / a.w AS clamps,
         3 * (SELECT sum(source_size) FROM src) - 2 * coalesce(sum(b.cap), 0) AS rest2,
         (SELECT sum(w) FROM src) - coalesce(sum(b.w), 0) AS open, a.cap, a.w
  FROM src a LEFT JOIN src b ON b.cap * a.w < a.cap * b.w
  GROUP BY a.source, a.cap, a.w),
level AS (SELECT rest2, open FROM levels WHERE rest2 * w <= 2 * cap * open ORDER BY clamps LIMIT 1),
target AS (
  SELECT source, source_size, w * rest2 >= 2 * cap * open AS capped,
         CASE WHEN w * rest2 >= 2 * cap * open THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * rest2 AS DOUBLE) / CAST(2 * open AS DOUBLE) END AS target
  FROM src, level),
plan AS (
  SELECT *, CASE WHEN capped THEN 2 WHEN source_size = 0 THEN 0
                 ELSE CAST(floor(target / source_size) AS BIGINT) END AS copies
  FROM target),
run AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.copies,
         greatest(0, CAST(round(p.target) AS BIGINT) - p.copies * p.source_size) AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(copies * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken,
       CAST(copies AS BIGINT) AS copies, CAST(greatest(0, least(size, rest - before)) AS BIGINT) AS part
FROM run
"""
