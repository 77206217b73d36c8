"""Sharding by proportional stratified interleaving, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import ROW, carried, read, seeded, stored

SHARDS = 16
SEED = 29
# Hex digits of the seeded hash that name a bucket; a source is ranked bucket by bucket.
BUCKET_DIGITS = 3
# The interleaved order is ranked in this many equal stretches.
STRETCHES = 4096


def _running(df: DataFrame, order: str, *keys: str) -> Column:
    """Sum of n over the rows before this one."""
    spec = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(spec), F.lit(0))


def interleave_shards(docs: DataFrame, key: Column, source: Column, tie: Column, shards: int = SHARDS,
                      seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` in the column ``_row``, with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in it).

    Inside its source a row gets the rank r of a seeded hash of ``key``; all rows are sorted by (2 r - 1) / 2 n, n
    rows in the source, and cut into shards whose row counts differ by one at most. A stretch of that order holds
    every source in its share, so each shard's mixture is the corpus's up to one row a source and cut.

    Ranks are found in two steps each: counts of buckets, then row numbers inside a bucket. A source, however
    large, is spread over 4,096 buckets of its hash, and the interleaved order over 4,096 stretches that are equal
    by construction, so no task sorts a source, and only counts (at most 4,096 a source) are added up in order.

    Null key or source: a value of its own, last. Equal keys: in the order of ``tie``; rows equal in both are
    interchangeable. Empty input: no rows. Extra columns: kept inside ``_row`` under their own names.
    """
    digest = seeded(key, seed)
    rows = carried(docs, source=source, order=digest, bucket=F.substring(digest, 1, BUCKET_DIGITS), tie=tie)
    buckets = stored(rows.groupBy("source", "bucket").agg(F.count(F.lit(1)).alias("n")))
    sources = buckets.groupBy("source").agg(F.sum("n").alias("of"))
    starts = (
        buckets.withColumn("start", _running(buckets, "bucket", "source")).withColumnRenamed("source", "_s")
        .join(sources, F.col("_s").eqNullSafe(F.col("source")))
        .select("_s", F.col("bucket").alias("_b"), "start", "of")
    )
    in_bucket = Window.partitionBy("source", "bucket").orderBy("order", "tie")
    rank = F.col("start") + F.row_number().over(in_bucket)
    part = (2 * rank - 1).cast("double") / (2 * F.col("of")).cast("double")
    ranked = (
        rows.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
        .withColumn("part", part)
        .withColumn("stretch", F.floor(F.col("part") * STRETCHES).cast("int"))
        .select(ROW, "source", "part", "stretch", "order", "tie")
    )
    ranked = stored(ranked)
    stretches = ranked.groupBy("stretch").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    placed = stored(
        stretches.select(F.col("stretch").alias("_stretch"), _running(stretches, "stretch").alias("before"),
                         F.sum("n").over(everything).alias("all")))
    in_stretch = Window.partitionBy("stretch").orderBy("part", F.col("source").isNull(), "source", "order", "tie")
    position = F.col("before") + F.row_number().over(in_stretch) - 1
    # A shard begins at the smallest position p with p * shards >= shard * all.
    return (
        ranked.join(placed, F.col("stretch") == F.col("_stretch"))
        .withColumn("position", position)
        .withColumn("shard", F.expr(f"position * {shards} div all").cast("int"))
        .withColumn("slot", F.col("position") - F.expr(f"(shard * all + {shards - 1}) div {shards}"))
        .select(ROW, "shard", "slot")
    )


def sharded_documents(spark, directory: str) -> DataFrame:
    """op7: the shard and slot of every document; the law is ``rows``."""
    narrow = stored(read(spark, directory, "documents", "doc_id", "source", "text").select(
        "doc_id", "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")))
    return interleave_shards(narrow, F.col("doc_id"), F.col("source"), F.struct("size", "text_crc32")).select(
        f"{ROW}.doc_id", f"{ROW}.size", f"{ROW}.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


SHARDED_DOCUMENTS_SQL = """
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 1, 2, 3, 4, 5, 6, 7]),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
texts AS (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT text FROM documents)),
sums AS (
  SELECT text, coalesce(xor(list_reduce(list_concat([4294967295::BIGINT],
             list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
             lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295), 0) AS crc
  FROM texts, crc_table),
rows AS (
  SELECT d.doc_id, d.source, coalesce(strlen(d.text), 0) + 1 AS size, s.crc AS text_crc32,
         md5('29:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')) AS h
  FROM documents d JOIN sums s ON d.text IS NOT DISTINCT FROM s.text),
ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY source ORDER BY h, size, text_crc32) - 1 AS DOUBLE)
            / CAST(2 * count(*) OVER (PARTITION BY source) AS DOUBLE) AS part
  FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY part, source NULLS LAST, h, size, text_crc32) - 1 AS p, count(*) OVER () AS n
  FROM ranked)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(p * 16 // n AS INT) AS shard,
       CAST(row_number() OVER (PARTITION BY p * 16 // n ORDER BY p) - 1 AS BIGINT) AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM placed
"""
