"""Merge result lists and remove duplicate queries, URLs and results.

First-wins rules are minimum aggregates, which combine inside each task before the shuffle, so a key that
holds a large share of the rows is no problem.
"""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.features import has_temporal_intent
from ..functions.text import _col, non_blank, trim_all
from ..functions.urls import is_http, is_raw_url, url_key, url_key_strict
from ..scale import computed, numbered, spread
from ..session import checkpointed
from .cells import close_sets
from .components import connected

OVERFETCH = 3
# Term sets and terms of a block that meets other blocks in one task.
CELL_SETS = 16_384
CELL_TERMS = 4_000_000
# Texts of one term set that are put beside a pair in one task.
COPIES_AT_ONCE = 4_096


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order."""
    others = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*order, *others)
    return df.groupBy(*keys).agg(F.min(packed).alias("_first")).select(*keys, "_first.*").select(*df.columns)


def fold_query(column: Column | str) -> Column:
    """Query key: case and accents folded, white space collapsed."""
    plain = F.regexp_replace(F.lower(strip_accents(column)), "\\s+", " ")
    return trim_all(plain)


def _accented_letters() -> tuple[str, str]:
    """Characters of any script that decompose into a plain one and marks, and those plain ones."""
    forms = ((chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000)
    pairs = [(c, form[0]) for c, form in forms
             if c != form[0] and all(unicodedata.category(mark)[0] == "M" for mark in form[1:])]
    return "".join(c for c, _ in pairs), "".join(plain for _, plain in pairs)


_ACCENTED, _PLAIN = _accented_letters()


def strip_accents(column: Column | str) -> Column:
    """Letters without accents; combining marks are dropped."""
    return F.translate(F.regexp_replace(_col(column), "\\p{M}", ""), _ACCENTED, _PLAIN)


def query_terms(column: Column | str) -> Column:
    """Distinct folded tokens of three or more characters."""
    pieces = F.split(fold_query(column), "[^\\p{L}\\p{M}\\p{N}]+")
    return F.array_distinct(F.filter(pieces, lambda t: F.length(t) >= 3))


def dedupe_queries(df: DataFrame, *scope: str) -> DataFrame:
    """First query of every key, blanks dropped; input (query_id, pos, query) and scope columns."""
    keyed = (df.withColumn("query", trim_all("query")).filter(F.col("query") != "")
             .withColumn("query_key", fold_query("query")))
    return first_by(keyed, [*scope, "query_key"], ["pos"])


def interleave(results: DataFrame, limit: int) -> DataFrame:
    """Round-robin over result lists without repeated URLs: adds ``merged_pos`` (1..limit).

    A URL counts where it comes first in (position, list) order; what is left keeps that order, which is
    the order in which taking turns would find it.
    """
    keyed = results.withColumn("url_key", url_key("url"))
    firsts = first_by(keyed, ["query_id", "url_key"], ["pos", "list_no"])
    turn = Window.partitionBy("query_id").orderBy("pos", "list_no")
    return firsts.withColumn("merged_pos", F.row_number().over(turn)).filter(F.col("merged_pos") <= limit)


def dedupe_urls(results: DataFrame, http_only: bool = True) -> DataFrame:
    """First result per strict URL key and query."""
    kept = results.filter(is_http("url")) if http_only else results
    return first_by(kept.withColumn("url_key", url_key_strict("url")), ["query_id", "url_key"], ["pos"])


def append_novel(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing results followed by incoming ones whose raw URL is new; ``batch`` keeps the order."""
    novel = incoming.join(existing.select("query_id", "url").distinct(), ["query_id", "url"], "left_anti")
    return existing.withColumn("batch", F.lit(0)).unionByName(novel.withColumn("batch", F.lit(1)))


def sanitize_line(column: Column | str) -> Column:
    """A proposed query line without bullet, number and quotes."""
    bare = F.regexp_replace(_col(column), "^\\s*(?:[-*•]|\\d+[.)])\\s*", "")
    return trim_all(F.btrim(trim_all(bare), F.lit("\"'")))


def novelty(candidate: Column, original: Column) -> Column:
    """Number of terms the candidate adds to the original."""
    return F.size(F.array_except(query_terms(candidate), query_terms(original)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def clean_derived_queries(df: DataFrame, k: int = 3) -> DataFrame:
    """Usable queries among proposed lines: (query_id, pos, query), first k per question.

    Input (query_id, original, raw): raw holds one proposal per line. Lines of one row are bounded by the
    row, so the first-wins rule runs inside it.
    """
    lines = F.transform(F.split("raw", "\n"), lambda line, i: F.struct(i.alias("pos"), sanitize_line(line).alias("query")))
    df = computed(df, _lines=lines, _own=query_terms("original"), _own_key=fold_query("original"))
    long = (df.select("query_id", "_own", "_own_key", F.explode("_lines").alias("l"))
            .select("query_id", "_own", "_own_key", "l.pos", "l.query")
            .filter((F.col("query") != "") & ~is_raw_url("query")))
    long = computed(long, _terms=query_terms("query"), query_key=fold_query("query"))
    usable = long.filter((F.size(F.array_except("_terms", "_own")) >= 2) & (F.col("query_key") != F.col("_own_key")))
    close = F.when(F.size("_own") > 0, jaccard(F.col("_terms"), F.col("_own")) >= 0.75).otherwise(False)
    firsts = first_by(usable, ["query_id", "query_key"], ["pos"]).filter(~close)
    order = Window.partitionBy("query_id").orderBy("pos")
    return (firsts.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
            .select("query_id", F.col("n").alias("pos"), "query"))


def near_duplicates(df: DataFrame, threshold: float = 0.75, fold_copies: bool = True) -> DataFrame:
    """Pairs of texts whose term sets have a Jaccard similarity of at least the threshold:
    (id_a, id_b, similarity), id_a < id_b; input (id, text).

    Texts with equal term sets count once, under their smallest id; ``copies`` lists the others, so a large
    group of copies costs one row here and no pairs. Without ``fold_copies`` every text counts: pairs of equal sets and
    those of all copies are listed too, as many rows as there are such pairs. Two sets above the threshold must share terms among
    the rarest ones of each (prefix filter); blocks of sets of like size meet in cells, where candidates are counted and
    compared, so only pairs above the threshold leave a task.
    """
    if fold_copies:
        groups = _term_sets(df).groupBy("_key", "terms").agg(F.min("id").alias("id")).select("id", "terms")
        return _close_pairs(_by_rarity(checkpointed(groups)), threshold)
    sets = checkpointed(_term_sets(df).filter(F.col("id").isNotNull()).distinct())
    # Sets are numbered: a text's id may stand at several of them.
    groups = checkpointed(sets.select("_key", "terms").distinct().withColumn("set", F.monotonically_increasing_id()))
    members = checkpointed(sets.join(groups, ["_key", "terms"]).select("set", "id"))
    close = _close_pairs(_by_rarity(groups.select(F.col("set").alias("id"), "terms")), threshold)
    return _pairs_of_members(close, members)


def _pairs_of_members(close: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b, similarity) of all texts of members (set, id) whose sets are close (id_a, id_b, similarity) or the same.

    A set of many texts is cut into parts, and a pair meets each part in a task of its own.
    """
    parts = F.ceil(F.count(F.lit(1)) / COPIES_AT_ONCE).cast("int")
    cut = checkpointed(members.groupBy("set").agg(parts.alias("parts"), F.count(F.lit(1)).alias("texts")))
    dealt = members.join(cut.drop("texts"), "set").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    same = cut.filter("texts > 1").select(F.col("set").alias("a"), F.col("set").alias("b"), F.lit(1.0).alias("similarity"))
    found = same.unionByName(close.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "similarity"))
    for side in ("a", "b"):
        all_parts = cut.select(F.col("set").alias(side), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        texts = dealt.select(F.col("set").alias(side), "part", F.col("id").alias(f"text_{side}"))
        found = found.join(all_parts, side).join(texts, [side, "part"]).drop("part")
    once = (F.col("a") != F.col("b")) & (F.col("text_a") != F.col("text_b")) | (F.col("text_a") < F.col("text_b"))
    return found.filter(once).select(F.least("text_a", "text_b").alias("id_a"), F.greatest("text_a", "text_b").alias("id_b"), "similarity")


def _term_sets(df: DataFrame) -> DataFrame:
    sets = computed(spread(df.select("id", "text"), "id"), terms=F.sort_array(query_terms("text"))).drop("text")
    return sets.filter(F.size("terms") > 0).withColumn("_key", F.xxhash64("terms"))


def copies(df: DataFrame) -> DataFrame:
    """Texts with the same term set as an earlier one: (id, copy_of), copy_of being the smallest id."""
    sets = _term_sets(df)
    firsts = sets.groupBy("_key", "terms").agg(F.min("id").alias("copy_of"))
    return (sets.join(firsts, ["_key", "terms"]).filter(F.col("id") != F.col("copy_of")).select("id", "copy_of"))


def near_groups(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Every text with terms and the smallest id of the group that similarity of at least the threshold connects it to:
    (id, group_id); input (id, text).

    As many rows as texts, however many are alike. Equal term sets are one. Then every set is compared with one other,
    of the sets of smallest id in its lists the one that most of them name: as many pairs as sets. What these links
    connect is one component, and in the join that follows only sets of unlike components meet, so no link between
    groups is lost.
    """
    sets = checkpointed(_term_sets(df))
    groups = checkpointed(sets.groupBy("_key", "terms").agg(F.min("id").alias("id")))
    ordered = _by_rarity(groups)
    prefix = checkpointed(_prefixes(ordered, threshold))
    here = ["term", "size_class"]
    heads = checkpointed(prefix.groupBy(*here).agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("rows"))
                         .filter("rows > 1").drop("rows"))
    named = (prefix.select(F.col("id").alias("id_b"), *here).join(heads, here).filter("id_a <> id_b")
             .groupBy("id_b", "id_a").agg(F.count(F.lit(1)).alias("lists")))
    star = named.groupBy("id_b").agg(F.max_by("id_a", F.struct("lists", "id_a")).alias("id_a"))
    first = checkpointed(_verified(star, ordered, threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    known = connected(first).withColumnRenamed("node", "id")
    rooted = ordered.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    second = _close_pairs(rooted, threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    roots = connected(first.unionByName(checkpointed(second))).withColumnRenamed("node", "id")
    found = groups.join(roots, "id", "left").select("_key", "terms", F.coalesce("root", "id").alias("group_id"))
    return sets.join(found, ["_key", "terms"]).select("id", "group_id")


def _by_rarity(groups: DataFrame) -> DataFrame:
    """(id, n, terms) of distinct term sets: numbers of the terms that several sets hold, rarest first, and the size.

    Numbers go up with the sets that hold a term, so they are the order too. A term of one set only cannot be shared: it
    counts for the size, not for the join.
    """
    long = groups.select("id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    shared = long.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    codes = checkpointed(numbered(shared.select(F.struct("df", "term").alias("key")), "key", "code"))
    # Half the bytes as long as the numbers are short.
    short = "int" if (codes.agg(F.max("code")).first()[0] or 0) < 2 ** 31 else "long"
    ordered = (long.join(codes.select("key.term", F.col("code").cast(short).alias("code")), "term")
               .groupBy("id", "n").agg(F.sort_array(F.collect_list("code")).alias("terms")))
    return checkpointed(ordered)


def _size_class(threshold: float) -> Column:
    """Sizes within the threshold lie in the same class or in neighbouring ones."""
    return F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")


def _prefixes(ordered: DataFrame, threshold: float) -> DataFrame:
    """(id, size_class, term): the rarest terms, of which sets above the threshold must share one."""
    n_alone = F.col("n") - F.size("terms")
    keep = F.greatest(F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1 - n_alone, F.lit(0)).cast("int")
    return ordered.select("id", _size_class(threshold).alias("size_class"),
                          F.explode(F.slice("terms", F.lit(1), keep)).alias("term"))


def _similarity(threshold: float) -> tuple[Column, Column]:
    """Jaccard similarity from the sizes and the shared terms of two sets, and whether it reaches the threshold."""
    value = F.round(F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")), 9)
    return value.alias("similarity"), value >= threshold


def _verified(found: DataFrame, ordered: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, similarity) of the candidates that reach the threshold."""
    side = lambda s: ordered.select(F.col("id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("terms").alias(f"h_{s}"))
    pairs = found.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b")
    value, close = _similarity(threshold)
    return pairs.withColumn("both", F.size(F.array_intersect("h_a", "h_b"))).filter(close).select("id_a", "id_b", value)


def _close_pairs(ordered: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, similarity) of all sets (id, n, terms) that reach the threshold, id_a < id_b; with a column ``root``
    only of sets that differ in it.

    A block is a part of a size class that a task can hold. Blocks of the same and of neighbouring classes meet in a
    cell each, so sets of unlike size never do, and what is shuffled is blocks, not pairs.
    """
    if "root" not in ordered.columns:
        ordered = ordered.withColumn("root", F.col("id"))
    sets = ordered.filter(F.col("id").isNotNull()).withColumn("size_class", _size_class(threshold))
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(CELL_SETS), F.sum(F.size("terms")) / F.lit(CELL_TERMS), F.lit(1)))
    # A row a class: as many as the logarithm of the largest size.
    parts = checkpointed(sets.groupBy("size_class").agg(blocks.cast("int").alias("parts")))
    for name, step in (("below", -1), ("above", 1)):
        next_ = parts.select((F.col("size_class") - step).alias("size_class"), F.col("parts").alias(name))
        sets = sets.join(F.broadcast(next_), "size_class", "left")
    sets = sets.join(F.broadcast(parts), "size_class").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    own, part = F.col("size_class"), F.col("part")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    cell = lambda left_class, left, right_class, right, side: F.struct(
        left_class.alias("left_class"), left.alias("left"), right_class.alias("right_class"), right.alias("right"), F.lit(side).alias("side"))
    cells = F.concat(
        F.transform(F.sequence(part, F.col("parts") - 1), lambda q: cell(own, part, own, q, 0)),
        F.transform(upto(part), lambda q: cell(own, q, own, part, 1)),
        F.transform(upto(F.coalesce("above", F.lit(0))), lambda q: cell(own, part, own + 1, q, 0)),
        F.transform(upto(F.coalesce("below", F.lit(0))), lambda q: cell(own - 1, q, own, part, 1)))
    met = sets.select("id", "root", "n", "terms", F.explode(cells).alias("c")).select("c.*", "id", "root", "n", "terms")
    kind = ordered.schema["id"].dataType.simpleString()
    found = met.groupBy("left_class", "left", "right_class", "right").applyInArrow(
        lambda table: close_sets(table, threshold), f"a {kind}, b {kind}, n_a int, n_b int, both int")
    value, close = _similarity(threshold)
    return found.filter(close).select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"), value)


def first_successes(fetches: DataFrame, limit: int, overfetch: int = OVERFETCH) -> DataFrame:
    """The first ``limit`` successful fetches by completion among the first limit + overfetch candidates."""
    order = Window.partitionBy("query_id").orderBy("completed_at", "pos")
    return (fetches.filter((F.col("pos") < limit + overfetch) & F.col("content").isNotNull())
            .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit))


PROVIDERS = ("web", "encyclopedia")


def route_providers(queries: DataFrame, web_cap: int = 6, encyclopedia_cap: int = 2, use_web: bool = True,
                    use_encyclopedia: bool = True) -> DataFrame:
    """Providers to ask: (query_id, provider, cap, merged_cap, encyclopedia_host).

    A question about recent matters skips the encyclopedia. Input (query_id, query, lang).
    """
    host = F.when(F.col("lang") == "fr", "fr.wikipedia.org").otherwise("en.wikipedia.org")
    temporal = has_temporal_intent("query")
    offers = [F.struct(F.lit("web").alias("provider"), F.lit(web_cap).alias("cap"), F.lit(use_web).alias("on")),
              F.struct(F.lit("encyclopedia").alias("provider"), F.lit(encyclopedia_cap).alias("cap"),
                       (F.lit(use_encyclopedia) & ~temporal).alias("on"))]
    return (queries.filter(trim_all("query") != "")
            .select("query_id", host.alias("encyclopedia_host"), F.explode(F.array(*offers)).alias("p"))
            .filter("p.on")
            .select("query_id", "p.provider", "p.cap", F.lit(web_cap + encyclopedia_cap).alias("merged_cap"),
                    F.when(F.col("p.provider") == "encyclopedia", F.col("encyclopedia_host")).alias("encyclopedia_host")))


def search_outcomes(answers: DataFrame) -> DataFrame:
    """Outcome of each query over its providers: results, empty or error.

    Input (query_id, provider, failed, n_results): an error only when nothing came back and a provider failed.
    """
    return answers.groupBy("query_id").agg(
        F.sum("n_results").alias("n_results"), F.count_if("failed").alias("n_failed")).withColumn(
        "outcome", F.when(F.col("n_results") > 0, "results").when(F.col("n_failed") > 0, "error").otherwise("empty"))


def split_prefetched(results: DataFrame, context_urls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results that came with content, URLs that still need fetching).

    results (query_id, pos, url, retrieved); context_urls (query_id, pos, url) come first in fetch order.
    """
    with_key = results.withColumn("url_key", url_key_strict("url"))
    given = first_by(with_key.filter(non_blank("retrieved").isNotNull()), ["query_id", "url_key"], ["pos"])
    wanted = (context_urls.select("query_id", F.lit(0).alias("origin"), "pos", "url")
              .unionByName(results.select("query_id", F.lit(1).alias("origin"), "pos", "url"))
              .withColumn("url_key", url_key_strict("url")))
    firsts = first_by(wanted, ["query_id", "url_key"], ["origin", "pos"])
    return given, firsts.join(given.select("query_id", "url_key"), ["query_id", "url_key"], "left_anti")


def deep_search_plan(sessions: DataFrame, web_cap: int = 6, encyclopedia_cap: int = 2, derived: int = 3) -> DataFrame:
    """Queries of a deep search with their caps: (query_id, pos, query, web_limit, encyclopedia_limit,
    merged_limit, shown); input (query_id, query, derived array)."""
    listed = F.concat(F.array("query"), F.coalesce("derived", F.array().cast("array<string>")))
    long = (sessions.select("query_id", F.posexplode(listed).alias("pos", "query")))
    unique = dedupe_queries(long, "query_id").drop("query_key")
    return unique.select(
        "query_id", "pos", "query", F.lit(web_cap + OVERFETCH).alias("web_limit"),
        F.lit(encyclopedia_cap).alias("encyclopedia_limit"),
        F.lit((web_cap + encyclopedia_cap + OVERFETCH) * derived).alias("merged_limit"),
        F.lit(web_cap + encyclopedia_cap).alias("shown"))
