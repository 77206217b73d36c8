"""Score queries against passages.

Everything a query can share with a passage (terms, numbers, equation, figure and page references) is a
*key*, so scoring is one equi-join of query keys with passage keys. What does not need a shared key
(length, presence of digits, formula or figure marks) depends only on the *class* of the passage, so
passages that share nothing with a query are ranked by class and never paired with it one by one.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import constants as K, features as feat
from ..functions.text import terms, tokens
from ..scale import BROADCAST_ROWS, broadcast_if_small, computed, first_rows, is_small, spread
from ..session import checkpointed
from . import cells

CHUNK_ID = ["doc_id", "chunk_no"]
# Class bits of a passage.
_LONG, _NUMBER, _FORMULA, _FIGURE, _TERMS = 1, 2, 4, 8, 16
CLASSES = 32
# Passages with the most keys are scored first to bound every query's k-th score: 2 * k and as many as this.
SEEDS = 128
# A query is pruned by its bound if that leaves at most this share of its postings; others meet all of them.
PRUNED_SHARE = 0.5
# From this many query keys times passages, the most postings that there could be, blocks of both meet in cells.
BOUND_FROM = 10 ** 8
# Keys of a block of queries; keys and passages of a piece, and pieces of a block of passages: what a task holds.
QUERY_KEYS = 8_000_000
PASSAGE_KEYS = 8_000_000
PASSAGES = 32_768
PIECES = 8
# Rows that leave a cell, at most (but for ties).
FOUND = 4_000_000
# Cells a slot, if keys are many enough to part the queries; keys of the smallest part.
SPARE, FEW_KEYS = 3, 50_000
# What rounding may add to a score.
SLACK = 1e-6
# A term found in more passages than this is split into parts of that size when the join is shuffled.
HOT_KEY_ROWS = 1_000_000
# Intent bits of a query.
Q_TERMS, Q_NUMBERS, Q_ANY_NUMBER, Q_EQUATION, Q_REFS, Q_FIGURE = 1, 2, 4, 8, 16, 32
INTENTS = 64
# Kinds of shared keys that bring more than their weight.
_E, _F, _P = 1, 2, 4
KEY_KINDS = {"e": _E, "f": _F, "p": _P}
# First letters of keys: terms, numbers, equations, figures, pages.
KINDS = ("t", "n", "e", "f", "p")
# Columns of a passage that go along with its keys.
PASSAGE = [*CHUNK_ID, "n_chars", "entry_len", "class"]


KEY_TYPE = "array<struct<key:string,weight:double>>"


def _prefixed(prefix: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.concat(F.lit(prefix), v).alias("key"), F.lit(1.0).alias("weight")))


def with_term_weights(df: DataFrame, text_col: str, method: str) -> DataFrame:
    """Add ``terms``: one (key, weight) per distinct term longer than two characters.

    Weights are 1 for overlap and counts otherwise; ``norm`` is the length of the count vector (1 for overlap).
    """
    if method == "overlap":
        return df.withColumn("terms", _prefixed("t", terms(text_col))).withColumn("norm", F.lit(1.0))
    # Sorted tokens: the last position of every run of equal tokens, then differences of those positions.
    # Lambdas see only their own elements, so every step is linear in the text.
    after = F.concat(F.slice("_tokens", F.lit(2), F.size("_tokens")), F.array(F.lit(None).cast("string")))
    marked = F.zip_with("_tokens", after, lambda a, b: F.struct(a.alias("t"), (b.isNull() | (a != b)).alias("last")))
    lasts = F.filter(F.transform(marked, lambda m, i: F.struct(m["t"].alias("t"), m["last"].alias("last"), i.alias("i"))),
                     lambda m: m["last"])
    before = F.concat(F.array(F.lit(-1)), F.transform("_lasts", lambda m: m["i"]))
    counts = F.filter(F.zip_with("_lasts", before, lambda m, p: F.struct(
        F.concat(F.lit("t"), m["t"]).alias("key"), (m["i"] - p).cast("double").alias("weight"))),
        lambda k: k["key"].isNotNull())
    df = computed(df, _tokens=F.sort_array(F.filter(tokens(text_col), lambda t: F.length(t) > 2)))
    df = computed(df, _lasts=lasts)
    df = computed(df, terms=counts).drop("_tokens", "_lasts")
    return df.withColumn("norm", F.sqrt(F.aggregate(
        "terms", F.lit(0.0), lambda total, t: total + t["weight"] * t["weight"])))


def _bits(*flags: tuple[Column, int]) -> Column:
    return sum((F.when(flag, bit).otherwise(0) for flag, bit in flags), F.lit(0))


def query_profile(queries: DataFrame, method: str = "overlap") -> DataFrame:
    """Keys and intent bits of every query: (query_id, keys, norm, intents); input (query_id, query)."""
    none = F.array().cast("array<string>")
    profile = with_term_weights(queries.select("query_id", "query"), "query", method)
    profile = profile.select(
        "query_id", "query", "terms", "norm", feat.numeric_tokens("query").alias("numbers"),
        feat.has_numeric_intent("query").alias("numeric"), feat.has_equation_intent("query").alias("equation"),
        feat.has_figure_intent("query").alias("figure"))
    profile = (profile.withColumn("refs", F.when(F.col("equation"), feat.equation_references("query")).otherwise(none))
               .withColumn("figures", F.when(F.col("figure"), feat.figure_references("query")).otherwise(none))
               .withColumn("pages", F.when(F.col("figure"), feat.requested_pages("query")).otherwise(none)))
    keys = F.concat("terms", _prefixed("n", F.col("numbers")), _prefixed("e", F.col("refs")),
                    _prefixed("f", F.col("figures")), _prefixed("p", F.col("pages")))
    has_terms = F.size("terms") > 0
    return profile.select(
        "query_id",
        # Without terms every score is zero, so nothing has to match.
        F.when(has_terms, keys).otherwise(F.array().cast(KEY_TYPE)).alias("keys"), "norm",
        _bits((has_terms, Q_TERMS), (F.size("numbers") > 0, Q_NUMBERS),
              (F.col("numeric") & (F.size("numbers") == 0), Q_ANY_NUMBER), (F.col("equation"), Q_EQUATION),
              (F.size("refs") > 0, Q_REFS), (F.col("figure"), Q_FIGURE)).alias("intents"))


def passage_profile(chunks: DataFrame, method: str = "overlap") -> DataFrame:
    """Keys, lengths and class of every passage: (doc_id, chunk_no, n_chars, entry_len, norm, class, keys);
    input (doc_id, chunk_no, source, page, text)."""
    page = F.when(F.col("page").isNotNull(), F.array(F.col("page").cast("string"))).otherwise(
        F.array().cast("array<string>"))
    profile = with_term_weights(chunks.select(*CHUNK_ID, "source", "page", "text"), "text", method)
    # Only the cosine score is zero for a passage without terms.
    usable = F.size("terms") > 0 if method == "cosine" else F.lit(True)
    profile = profile.select(
        *CHUNK_ID, F.length("text").alias("n_chars"), entry_length().alias("entry_len"), "norm",
        _bits((F.length("text") > K.LONG_CHUNK_CHARS, _LONG), (feat.any_number("text"), _NUMBER),
              (feat.formula_syntax("text"), _FORMULA), (feat.figure_cue("text"), _FIGURE),
              (usable, _TERMS)).alias("class"),
        F.concat("terms", _prefixed("n", feat.numeric_tokens("text")), _prefixed("e", feat.equation_references("text")),
                 _prefixed("f", feat.figure_references("text")), _prefixed("p", page)).alias("keys"))
    return profile


def stored_profile(chunks: DataFrame, method: str = "overlap") -> DataFrame:
    """The profile of all passages, tokenised once where the texts lie, then read from the shared folder.

    Without texts. Few pairs are then scored where all keys of a passage lie in one task, many in cells.
    """
    return checkpointed(passage_profile(spread(chunks), method))


def entry_length() -> Column:
    """Length of a passage as a context entry: "Source: s", a newline, the text."""
    return F.length("source") + F.length("text") + F.lit(len("Source: ") + 1)


def _has(bit: int) -> Column:
    return F.col("class").bitwiseAND(F.lit(bit)) != 0


def _asks(bit: int) -> Column:
    return F.col("intents").bitwiseAND(F.lit(bit)) != 0


def _class_bonus(intents: int, cls: int) -> float:
    """Score of a passage of a class without shared keys, for a query with these intents."""
    if not intents & Q_TERMS or not cls & _TERMS:
        return 0.0
    wanted = ((True, _LONG, K.LONG_CHUNK_BONUS), (intents & Q_ANY_NUMBER, _NUMBER, K.NUMBER_PRESENCE_BONUS),
              (intents & Q_EQUATION and not intents & Q_REFS, _FORMULA, K.EQUATION_PRESENCE_BONUS),
              (intents & Q_FIGURE, _FIGURE, K.FIGURE_PRESENCE_BONUS))
    return round(sum(bonus for asked, bit, bonus in wanted if asked and cls & bit), 9)


def class_score() -> Column:
    """Score of a passage that shares no key with the query, looked up by (intents, class)."""
    table = [_class_bonus(i, c) for i in range(INTENTS) for c in range(CLASSES)]
    return F.get(F.lit(table), F.col("intents") * CLASSES + F.col("class"))


def key_weights() -> dict[str, float]:
    """What one shared key of each kind adds; terms add the product of their weights."""
    return {"n": K.NUMBER_MATCH_BONUS, "e": K.EQUATION_MATCH_BONUS, "f": K.FIGURE_MATCH_BONUS, "p": K.FIGURE_PAGE_BONUS}


def overlap_weight(key: Column) -> Column:
    """What a shared key adds to an overlap score, but for what goes along with its kind."""
    return F.coalesce(*[F.when(F.substring(key, 1, 1) == kind, value) for kind, value in key_weights().items()], F.lit(1.0))


def score_column(shared: Column, kinds: Column) -> Column:
    """Score from the summed weights of the shared keys and the kinds of keys among them."""
    found = lambda bit: kinds.bitwiseAND(F.lit(bit)) != 0
    caption = F.when(_has(_FIGURE), K.FIGURE_CAPTION_BONUS).otherwise(0.0)
    formula = F.when(found(_E) & _has(_FORMULA), K.EQUATION_FORMULA_BONUS).otherwise(0.0)
    captions = F.when(found(_F), caption).otherwise(0.0) + F.when(found(_P), caption).otherwise(0.0)
    # A match replaces the bonus for a mere figure mark.
    instead = F.when(found(_F | _P) & _has(_FIGURE), K.FIGURE_PRESENCE_BONUS).otherwise(0.0)
    special = F.when(kinds > 0, formula + captions - instead).otherwise(0.0)
    # Sums of the same bonuses must compare equal whatever the order of addition.
    return F.when(_has(_TERMS), F.round(shared + class_score() + special, 9)).otherwise(0.0)


def class_bound() -> Column:
    """Highest score a passage without shared keys can reach for a query."""
    return (F.lit(K.LONG_CHUNK_BONUS) + F.when(_asks(Q_ANY_NUMBER), K.NUMBER_PRESENCE_BONUS).otherwise(0.0)
            + F.when(_asks(Q_EQUATION) & ~_asks(Q_REFS), K.EQUATION_PRESENCE_BONUS).otherwise(0.0)
            + F.when(_asks(Q_FIGURE), K.FIGURE_PRESENCE_BONUS).otherwise(0.0) + F.lit(1e-6))


def query_keys(profile: DataFrame) -> DataFrame:
    """(query_id, intents, key, q_weight, kind): what a match of each of a query's keys adds, but for the weight that the
    passage gives to it. A column ``room`` of the profile is kept."""
    kind = F.substring("k.key", 1, 1)
    weight = F.when(kind == "t", F.col("k.weight") / F.col("norm"))
    for name, value in key_weights().items():
        weight = weight.when(kind == name, value)
    mark = F.lit(0)
    for name, bit in KEY_KINDS.items():
        mark = F.when(kind == name, bit).otherwise(mark)
    room = [c for c in profile.columns if c == "room"]
    return profile.select("query_id", "intents", "norm", *room, F.explode("keys").alias("k")).select(
        "query_id", "intents", *room, F.col("k.key").alias("key"), weight.alias("q_weight"), mark.alias("kind"))


def passage_keys(passages: DataFrame) -> DataFrame:
    """One row per key of every passage, with the passage's columns and ``weight``."""
    return passages.select(*PASSAGE, "norm", F.explode("keys").alias("k")).select(
        *PASSAGE, F.col("k.key").alias("key"),
        F.when(F.substring("k.key", 1, 1) == "t", F.col("k.weight") / F.col("norm")).otherwise(1.0).alias("weight"))


def match_pairs(profile: DataFrame, passages: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Scored (query, passage) pairs that share at least one key.

    Few queries: their keys are broadcast and the passages, hashed by id, are exploded, joined and
    aggregated in the same tasks, so pairs are never shuffled. Many queries: both sides are shuffled by
    key, keys found in very many passages being split into parts first. If the profile has a column ``room``, only
    passages of that entry length at most are met.
    """
    asked, told = query_keys(profile), passage_keys(passages)
    if is_small(asked, max_broadcast):
        hits = told.join(F.broadcast(asked), "key")
    else:
        hits = _split_hot_keys(told, asked)
    if "room" in asked.columns:
        hits = hits.filter(F.col("entry_len") <= F.col("room"))
    pairs = hits.groupBy("query_id", "intents", *PASSAGE).agg(
        F.sum(F.col("q_weight") * F.col("weight")).alias("shared"), F.bit_or("kind").alias("kinds"))
    return pairs.select("query_id", *PASSAGE, "intents", score_column(F.col("shared"), F.col("kinds")).alias("score"))


def bounded_keys(profile: DataFrame, passages: DataFrame, k: int,
                 max_broadcast: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Which postings of every query can lead to one of its k best passages by overlap, and the passages' keys as numbers.

    First (query_id, intents, code, q_weight, kind, n, rest, lowest, open, pruned): a query's keys from the rarest on;
    ``rest`` bounds what a passage can score that shares this key and none before it, ``lowest`` is the k-th best
    score among the passages with the most keys, so the k-th best of all is no lower. ``open``: the key can reach it.
    ``pruned``: whether that spares the query enough postings. Keys that no passage has are left out.
    Second the passages (PASSAGE, told), ``told`` being the numbers of their keys that any query has.
    """
    asked = checkpointed(query_keys(profile))
    told = passage_keys(passages).select(*PASSAGE, "key")
    wanted = broadcast_if_small(asked.select("key").distinct(), max_broadcast)
    # The last digit in base 8 is the kind of a key.
    number = F.monotonically_increasing_id() * 8 + F.instr(F.lit("".join(KINDS)), F.substring("key", 1, 1)) - 1
    frequency = checkpointed(told.join(wanted, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("code", number))
    coded = checkpointed(told.join(broadcast_if_small(frequency.select("key", "code"), max_broadcast), "key")
                         .groupBy(*PASSAGE).agg(F.collect_list("code").alias("told")))
    rows = checkpointed(asked.join(frequency, "key").drop("key"))
    # Of all their keys, not only those that are asked for: these are of the language of most queries.
    widest = (passages.select(*CHUNK_ID, F.size("keys").alias("size")).orderBy(F.col("size").desc(), *CHUNK_ID)
              .limit(2 * k + SEEDS))
    # Twice k rows and a few: always small.
    seeds = coded.join(F.broadcast(widest.drop("size")), CHUNK_ID, "left_semi").select(*PASSAGE, F.explode("told").alias("code"))
    met = seeds.join(broadcast_if_small(rows, max_broadcast), "code").groupBy("query_id", "intents", *PASSAGE).agg(
        F.sum("q_weight").alias("shared"), F.bit_or("kind").alias("kinds"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))
    lowest = (met.select("query_id", score_column(F.col("shared"), F.col("kinds")).alias("score")).withColumn("place", place)
              .filter(F.col("place") == k).select("query_id", F.col("score").alias("lowest")))
    extra = (F.when(F.col("kind") == _E, K.EQUATION_FORMULA_BONUS).when(F.col("kind") > 0, K.FIGURE_CAPTION_BONUS)
             .otherwise(0.0))
    onward = Window.partitionBy("query_id").orderBy("n", "code").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (rows.withColumn("rest", F.sum(F.col("q_weight") + extra).over(onward) + class_bound() + SLACK)
            .join(lowest, "query_id", "left")
            .withColumn("open", F.col("lowest").isNull() | (F.col("rest") >= F.col("lowest"))))
    whole = Window.partitionBy("query_id")
    spared = F.sum(F.when(F.col("open"), F.col("n")).otherwise(0)).over(whole) <= PRUNED_SHARE * F.sum("n").over(whole)
    return checkpointed(rows.withColumn("pruned", F.col("lowest").isNotNull() & spared)), coded


def candidate_pairs(bounded: DataFrame, coded: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """(query_id, doc_id, chunk_no) pairs of the pruned queries that their bounds leave."""
    asked = bounded.filter("pruned AND open").select("query_id", F.col("code").alias("key"))
    told = coded.select(*CHUNK_ID, F.explode("told").alias("key"))
    if is_small(asked, max_broadcast):
        hits = told.join(F.broadcast(asked), "key")
    else:
        hits = _split_hot_keys(told, asked)
    return hits.groupBy("query_id", *CHUNK_ID).agg(F.count(F.lit(1)).alias("hits")).drop("hits")


def _overlaps(candidates: DataFrame, bounded: DataFrame, coded: DataFrame, max_broadcast: int) -> DataFrame:
    """Overlap scores of given pairs, from the numbers of both sides' keys."""
    asked = bounded.filter("pruned").groupBy("query_id", "intents").agg(F.collect_list("code").alias("asked"))
    both = candidates.join(coded, CHUNK_ID).join(broadcast_if_small(asked, max_broadcast), "query_id")
    both = computed(both.select("query_id", "intents", *PASSAGE, F.array_intersect("told", "asked").alias("shared")),
                    counts=F.transform(F.array(*map(F.lit, range(len(KINDS)))), lambda kind: F.size(
                        F.filter("shared", lambda code: code % 8 == kind))))
    count = {kind: F.get("counts", F.lit(i)) for i, kind in enumerate(KINDS)}
    total = count["t"].cast("double")
    for kind, weight in key_weights().items():
        total = total + count[kind] * F.lit(weight)
    kinds = sum((F.when(count[name] > 0, bit).otherwise(0) for name, bit in KEY_KINDS.items()), F.lit(0))
    both = computed(both, total=total, kinds=kinds)
    return both.select("query_id", *PASSAGE, "intents", score_column(F.col("total"), F.col("kinds")).alias("score"))


def score_pairs(candidates: DataFrame, profile: DataFrame, passages: DataFrame, method: str) -> DataFrame:
    """Scores of given pairs, from the two lists of keys."""
    names = lambda keys: F.transform(keys, lambda k: k["key"])
    asked = profile.select("query_id", "intents", F.col("norm").alias("q_norm"), F.col("keys").alias("asked"))
    told = passages.select(*PASSAGE, "norm", F.col("keys").alias("told"))
    both = candidates.join(told, CHUNK_ID).join(broadcast_if_small(asked), "query_id")
    if method == "overlap":
        # Every term weighs 1, so names are enough.
        both = computed(both, shared=F.array_intersect(names(F.col("told")), names(F.col("asked"))))
        terms_sum = F.size(F.filter("shared", lambda n: n.startswith("t"))).cast("double")
    else:
        # The names both have are found once a pair, so that what follows looks through those only.
        both = computed(both, told_names=names(F.col("told")), asked_names=names(F.col("asked")))
        both = computed(both, common=F.array_intersect("told_names", "asked_names"))
        common = lambda keys: F.filter(keys, lambda k: F.array_contains("common", k["key"]))
        both = computed(both, met=common("told"), wanted=common("asked"))
        weight = lambda k: F.element_at(F.filter("wanted", lambda q: q["key"] == k["key"]), 1)["weight"]
        terms_sum = F.aggregate(F.filter("met", lambda k: k["key"].startswith("t")), F.lit(0.0), lambda total, k:
                                total + (weight(k) / F.col("q_norm")) * (k["weight"] / F.col("norm")))
        both = both.withColumn("shared", names(F.col("met")))
    count = lambda prefix: F.size(F.filter("shared", lambda n: n.startswith(prefix)))
    total = terms_sum
    for prefix, weight_ in key_weights().items():
        total = total + count(prefix) * F.lit(weight_)
    kinds = sum((F.when(count(name) > 0, bit).otherwise(0) for name, bit in KEY_KINDS.items()), F.lit(0))
    both = computed(both, total=total, kinds=kinds)
    return both.select("query_id", *PASSAGE, "intents", score_column(F.col("total"), F.col("kinds")).alias("score"))


def top_matches(profile: DataFrame, passages: DataFrame, k: int, method: str = "overlap",
                max_broadcast: int = BROADCAST_ROWS, bound_from: int = BOUND_FROM) -> DataFrame:
    """The k best pairs of every query among all that share a key, as match_pairs gives them, with ``rank``.

    Exact. Where the profile has a column ``room``, only passages of that entry length at most count; where it has
    ``last``, only those behind that passage in rank order. Where query keys and passages are many, blocks of both meet
    in cells and only the k best of each cell leave its task; both ways give the same rows.
    """
    by_query = Window.partitionBy("query_id").orderBy(*rank_order())
    first = lambda found: found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    asked = profile.agg(F.sum(F.size("keys"))).first()[0] or 0
    if asked * passages.count() >= bound_from:
        return first(_cell_pairs(profile, passages, k, method))
    pairs = match_pairs(profile, passages.repartition(*CHUNK_ID), max_broadcast)
    if "last" in profile.columns:
        pairs = pairs.join(broadcast_if_small(profile.select("query_id", "last").distinct(), max_broadcast), "query_id").filter(
            F.col("last").isNull() | (rank_key() > F.col("last"))).drop("last")
    return first(pairs)


def _cell_pairs(profile: DataFrame, passages: DataFrame, k: int, method: str) -> DataFrame:
    """Pairs that share a key, as match_pairs gives them, the k best of every query among them and few others.

    By overlap, the passages with the most keys are scored first: the k-th best of all is no lower than theirs, so
    less than that does not leave a cell.
    """
    none = lambda kind: F.lit(None).cast(kind)
    kind = lambda key: F.substring(key["key"], 1, 1)
    weight = lambda key: F.coalesce(*[F.when(kind(key) == name, value) for name, value in key_weights().items()],
                                    key["weight"] / F.col("norm"))
    last = F.col("last") if "last" in profile.columns else F.lit(None).cast(
        passages.select(rank_key(F.lit(0.0))).schema[0].dataType)
    asked = checkpointed(profile.filter(F.size("keys") > 0).select(
        "query_id", "intents", F.transform("keys", lambda key: key["key"]).alias("keys"), F.transform("keys", weight).alias("weights"),
        (F.col("room") if "room" in profile.columns else none("int")).cast("int").alias("room"), none("double").alias("floor"),
        (-last["s"]).alias("last_score"), (-last["n"]).cast("int").alias("last_chars"), last["doc_id"].alias("last_doc"),
        last["chunk_no"].alias("last_chunk")))
    if method == "overlap":
        widest = checkpointed(passages.filter(F.size("keys") > 0).orderBy(F.size("keys").desc(), *CHUNK_ID).limit(2 * k + SEEDS))
        by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc())
        seeds = _in_cells(asked, widest, k).select("query_id", "score").withColumn("place", F.row_number().over(by_query))
        floor = seeds.filter(F.col("place") == k).select("query_id", F.col("score").alias("floor"))
        asked = checkpointed(asked.drop("floor").join(floor, "query_id", "left").select(*asked.columns))
    return _in_cells(asked, passages, k)


def _packed(passages: DataFrame) -> DataFrame:
    """Passages with keys as stored pieces of many each, made where they lie (see cells.pieces)."""
    told = passages.filter(F.size("keys") > 0)
    if not told.groupBy(*CHUNK_ID).count().filter("count > 1").isEmpty():
        # Rows of one passage have to be in one piece.
        weights = F.transform("keys", lambda k: F.struct(k["key"].alias("key"), F.when(
            k["key"].startswith("t"), k["weight"] / F.col("norm")).otherwise(k["weight"]).alias("weight")))
        told = told.select(*PASSAGE, weights.alias("keys")).groupBy(*PASSAGE).agg(
            F.flatten(F.collect_list("keys")).alias("keys"), F.lit(1.0).alias("norm"))
    told = told.select(*PASSAGE, "norm", F.transform("keys", lambda k: k["key"]).alias("keys"),
                       F.transform("keys", lambda k: k["weight"]).alias("weights"))
    columns = ", ".join(f"{c} array<{told.schema[c].dataType.simpleString()}>" for c in (*PASSAGE, "norm"))
    most_keys, most_rows = PASSAGE_KEYS, PASSAGES
    return checkpointed(told.mapInArrow(
        lambda batches: cells.pieces(batches, TaskContext.get().partitionId(), most_keys, most_rows), f"{columns}, {cells.PIECE}"))


def _in_cells(asked: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """The k best pairs of every query and block of passages, each cell of two blocks in one task."""
    slots = asked.sparkSession.sparkContext.defaultParallelism
    told = _packed(passages)
    n_queries, asked_keys = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    told_keys, told_rows = F.sum(F.length("counts") / F.col("width")), F.sum(F.length("sizes") / 4)
    found, rows, parts, size = told.agg(
        F.count(F.lit(1)), F.coalesce(told_rows, F.lit(0)), F.max("part"),
        F.greatest(told_keys / F.lit(PASSAGE_KEYS * PIECES), told_rows / F.lit(PASSAGES * PIECES))).first()
    queries = max(1, -(-asked_keys // QUERY_KEYS), -(-n_queries * k // FOUND))
    blocks = max(1, ceil(size or 0))
    # Few cells: blocks of single tiles, as queries are shuffled at less cost than passages.
    few = SPARE * slots
    blocks = max(blocks, min(-(-few // queries), ceil((size or 0) * PIECES)))
    if queries * blocks < few:
        # Then smaller tiles and more parts of the queries: a tile is made anew for each part, a query starts anew in each tile.
        blocks = max(blocks, min(found, -(-few // queries), ceil((few * rows / (4 * max(n_queries, 1))) ** 0.5)))
        queries = max(queries, min(-(-few // blocks), -(-asked_keys // FEW_KEYS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = (asked.withColumn("_query", F.pmod(F.xxhash64("query_id"), F.lit(queries)).cast("int"))
            .withColumn("_block", every(blocks)))
    right = (told.withColumn("_block", F.pmod(F.col("seq") * ((parts or 0) + 1) + F.col("part"), F.lit(blocks)).cast("int"))
             .withColumn("_query", every(queries)))
    bits = np.array([KEY_KINDS.get(kind, 0) for kind in KINDS], np.int64)
    bonus = np.array([[_class_bonus(i, c) for c in range(CLASSES)] for i in range(INTENTS)])
    kind = lambda df, name: f"{name} {df.schema[name].dataType.simpleString()}"
    schema = ", ".join([kind(asked, "query_id"), *(kind(passages, c) for c in PASSAGE), kind(asked, "intents"), "score double"])
    most_keys, most_rows = PASSAGE_KEYS, PASSAGES

    def score(shared, kinds, intents, classes):
        return _cell_scores(shared, kinds, intents, classes, bonus)

    def best(left, right):
        return cells.best_pairs(left.drop_columns(["_query", "_block"]), right.drop_columns(["_query", "_block"]), score, bits, k,
                                most_keys, most_rows)

    return left.groupBy("_query", "_block").cogroup(right.groupBy("_query", "_block")).applyInArrow(best, schema)


def _cell_scores(shared: np.ndarray, kinds: np.ndarray, intents: np.ndarray, classes: np.ndarray, bonus: np.ndarray) -> np.ndarray:
    """score_column over arrays."""
    total = shared + bonus[intents, classes]
    if kinds.any():
        figure, formula = classes & _FIGURE != 0, classes & _FORMULA != 0
        total += np.where(kinds & _E != 0, formula * K.EQUATION_FORMULA_BONUS, 0.0)
        for mark in (_F, _P):
            total += np.where(kinds & mark != 0, figure * K.FIGURE_CAPTION_BONUS, 0.0)
        total -= np.where(kinds & (_F | _P) != 0, figure * K.FIGURE_PRESENCE_BONUS, 0.0)
    return np.where(classes & _TERMS != 0, np.round(total, 9), 0.0)


def _split_hot_keys(told: DataFrame, asked: DataFrame) -> DataFrame:
    # Partial counts are combined before the shuffle; a key gets as many parts as its size asks for.
    sizes = told.groupBy("key").agg(F.count(F.lit(1)).alias("rows"))
    hot = checkpointed(sizes.filter(F.col("rows") > HOT_KEY_ROWS)
                       .select("key", F.ceil(F.col("rows") / HOT_KEY_ROWS).cast("int").alias("parts")))
    hot = broadcast_if_small(hot)
    parts = F.coalesce("parts", F.lit(1))
    left = told.join(hot, "key", "left").withColumn(
        "part", F.pmod(F.xxhash64(*CHUNK_ID), parts).cast("int")).drop("parts")
    right = asked.join(hot, "key", "left").withColumn(
        "part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, ["key", "part"]).drop("part")


def rank_order() -> list[Column]:
    """Score, then length, then id: a total order."""
    return [F.col("score").desc(), F.col("n_chars").desc(), F.col("doc_id"), F.col("chunk_no")]


def rank_key(score: Column | None = None) -> Column:
    """Struct that sorts ascending in rank order."""
    return F.struct((-(F.col("score") if score is None else score)).alias("s"), (-F.col("n_chars")).alias("n"), F.col("doc_id"), F.col("chunk_no"))


def top_chunks(queries: DataFrame, chunks: DataFrame, k: int = 3, method: str = "overlap",
               max_broadcast: int = BROADCAST_ROWS, passages: DataFrame | None = None) -> DataFrame:
    """The k best passages of every query, among all passages: (query_id, doc_id, chunk_no, score, n_chars, rank).

    Exact, without pairing a query with passages it shares nothing with: inside a class a passage that
    shares a key always beats one that does not, so the first 2k passages of each class are enough to
    complete a query whose own matches do not fill its list. ``passages`` is the stored profile of the chunks, if there
    is one already.
    """
    profile = checkpointed(query_profile(spread(queries, "query_id"), method))
    passages = stored_profile(chunks, method) if passages is None else passages
    by_query = Window.partitionBy("query_id").orderBy(*rank_order())
    keep = ["query_id", *CHUNK_ID, "n_chars", "score"]
    # Every task cuts its pairs to k per query before they are shuffled.
    matched = checkpointed(top_matches(profile, passages, k, method, max_broadcast).select(*keep, "rank"))
    reached = matched.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lowest"))
    open_queries = (profile.drop("keys").join(reached, "query_id", "left")
                    .filter((F.coalesce("n", F.lit(0)) < k) | (F.col("lowest") <= class_bound())))
    if open_queries.isEmpty():
        return matched
    # Scores of the others depend on intents and class only: for each kind of query the first 2k of all classes.
    kinds = open_queries.select("intents").distinct().withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    by_kind = Window.partitionBy("intents").orderBy(*rank_order())
    leaders = (kinds.join(class_leaders(passages, 2 * k), "class").withColumn("score", class_score())
               .withColumn("place", F.row_number().over(by_kind)).filter(F.col("place") <= 2 * k)
               .select("intents", *CHUNK_ID, "n_chars", "score"))
    full = F.coalesce("n", F.lit(0)) >= k
    # INTENTS * 2k rows at most.
    filled = (open_queries.join(broadcast_if_small(checkpointed(leaders), max_broadcast), "intents")
              .filter(~full | (F.col("score") >= F.col("lowest"))).select(*keep)
              .join(matched.select("query_id", *CHUNK_ID), ["query_id", *CHUNK_ID], "left_anti"))
    return (matched.select(*keep).unionByName(filled)
            .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k))


def class_leaders(passages: DataFrame, rows: int) -> DataFrame:
    """The longest passages of each class: at most CLASSES * rows rows, whatever the corpus."""
    order = [F.col("n_chars").desc(), F.col("doc_id"), F.col("chunk_no")]
    return first_rows(passages.select("class", *CHUNK_ID, "n_chars"), ["class"], order, F.lit(rows), "place").drop("place")


def term_freq(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Counts of tokens longer than two characters: (id, term, tf). Counting happens inside each row."""
    return (with_term_weights(df.select(id_col, text_col), text_col, "counts")
            .select(id_col, F.explode("terms").alias("k"))
            .select(id_col, F.expr("substring(k.key, 2)").alias("term"), F.col("k.weight").cast("long").alias("tf")))


def intent_profile(df: DataFrame, text_col: str, *group: str) -> DataFrame:
    """How many rows of each group ask for numbers, equations, figures or recent matters."""
    flag = lambda c: F.count_if(c)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        flag(feat.has_numeric_intent(text_col)).alias("numeric"),
        flag(feat.has_temporal_intent(text_col)).alias("temporal"),
        flag(feat.has_equation_intent(text_col)).alias("equation"),
        flag(feat.has_figure_intent(text_col)).alias("figure"),
        flag(feat.any_number(text_col)).alias("any_number"),
        flag(feat.formula_syntax(text_col)).alias("formula"))
