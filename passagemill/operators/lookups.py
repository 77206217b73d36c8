"""Languages, string tables, cohorts and entitlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import checkpointed

LANGUAGES = ("en", "fr", "es")


def resolve_language(prefs: Column | str) -> Column:
    """Language of the first preference that is supported, else English."""
    column = F.col(prefs) if isinstance(prefs, str) else prefs
    codes = F.filter(F.transform(column, lambda p: F.substring(F.lower(p), 1, 2)), lambda c: c.isin(*LANGUAGES))
    return F.coalesce(F.get(codes, F.lit(0)), F.lit("en"))


def lookup_strings(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Text of each wanted key: in its language, else in English, else the key: (lang, key, text).

    The catalog is stored first, so Spark knows its bytes and broadcasts it only below its own limit.
    """
    known = checkpointed(catalog.select("lang", "key", "value"))
    own = known.withColumnRenamed("value", "_own")
    english = known.filter(F.col("lang") == "en").select("key", F.col("value").alias("_english"))
    return (wanted.join(own, ["lang", "key"], "left").join(english, "key", "left")
            .withColumn("text", F.coalesce("_own", "_english", "key")).drop("_own", "_english"))


def missing_keys(catalog: DataFrame) -> DataFrame:
    """English keys that another language lacks: (lang, key). One pass, no pairing of languages with keys."""
    others = [c for c in LANGUAGES if c != "en"]
    held = catalog.groupBy("key").agg(F.collect_set("lang").alias("langs"))
    return (held.filter(F.array_contains("langs", "en"))
            .select("key", F.explode(F.array_except(F.lit(others), F.col("langs"))).alias("lang"))
            .select("lang", "key"))


def first_seen_cohort(events: DataFrame, cut_over: str) -> DataFrame:
    """First launch of every user and whether it came before the cut-over: (user_id, first_seen, founding)."""
    firsts = events.groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return firsts.withColumn("founding", F.col("first_seen") < F.lit(cut_over).cast("timestamp_ntz"))


def entitled_users(users: DataFrame, purchases: DataFrame, product: str, gate_active: bool = True) -> DataFrame:
    """Access and caps of every user: (user_id, owned, access, result_cap, token_cap).

    users (user_id, founding, requested_results, requested_tokens); purchases (user_id, product, verified, revoked).
    """
    valid = (F.col("product") == product) & F.col("verified") & ~F.col("revoked")
    owned = purchases.groupBy("user_id").agg(F.bool_or(valid).alias("owned"))
    access = F.lit(not gate_active) | F.col("founding") | F.col("owned")
    joined = users.join(owned, "user_id", "left").withColumn("owned", F.coalesce("owned", F.lit(False)))
    joined = joined.withColumn("access", access)
    return joined.select(
        "user_id", "owned", "access",
        F.when(F.col("access"), F.col("requested_results")).otherwise(F.least("requested_results", F.lit(1))).alias("result_cap"),
        F.when(F.col("access"), F.col("requested_tokens")).otherwise(F.least("requested_tokens", F.lit(500))).alias("token_cap"))
