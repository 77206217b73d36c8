"""Shared pieces: tables, word patterns, stored intermediate tables, and carried rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..scale import spread
from ..session import checkpointed, table

# A word: characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
# The whole input row, kept as one struct while an operator adds columns of its own, so that no name can clash.
ROW = "_row"


def read(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table of a data folder, in as many partitions as the cluster has slots at least."""
    found = table(spark, directory, name)
    return spread(found.select(*columns) if columns else found)


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back: lost executors repeat nothing before it, and
    Catalyst knows its size, so that it broadcasts the table only if that size is below the session's limit."""
    return checkpointed(df)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for found in tables:
        files = found.inputFiles()
        if files:
            context = found.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def carried(df: DataFrame, **columns: Column) -> DataFrame:
    """The input row as one struct, and computed columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW),
                     *[value.alias(name) for name, value in columns.items()])


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded(key: Column, seed: int) -> Column:
    """Hex digest of a key and a seed: the same on every run, partitioning and engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
