"""Registry of queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.threads import message_id
from ..scale import computed
from ..session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its SQL twin where there is one."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def user_turns(spark: SparkSession, directory: str) -> DataFrame:
    """All user turns as queries: (query_id, query)."""
    return table(spark, directory, "conversations").filter(F.col("role") == "user").select(
        message_id().alias("query_id"), F.col("text").alias("query"))


def whole_documents(spark: SparkSession, directory: str) -> DataFrame:
    """Every document as one passage: (doc_id, chunk_no, source, url, page, text)."""
    # A computed zero: a literal would vanish from the partitioning by (doc_id, chunk_no).
    return computed(table(spark, directory, "documents"), chunk_no=F.lit(0)).select(
        "doc_id", "chunk_no", "source",
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id") % 10).alias("url"),
        (F.col("doc_id") % 10).cast("int").alias("page"), "text")


USER_TURNS_SQL = "SELECT conv_id * 4294967296 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'"
WHOLE_DOCUMENTS_SQL = (
    "SELECT doc_id, 0 AS chunk_no, source, 'https://' || source || '.example.org/' || (doc_id % 10) AS url, "
    "CAST(doc_id % 10 AS INT) AS page, text FROM documents")
