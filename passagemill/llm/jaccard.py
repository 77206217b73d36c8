"""Near-duplicate documents by a Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles. All sets put their shingles in one order, rarest first. If two sets reach
the threshold, then for every l the first ``n - need + l`` shingles of both share l shingles, where n is a set's
size and need the overlap that the threshold asks of it at least. Each set chooses its own l by what the postings of
its prefix would cost; two sets are verified only if their prefixes share as many shingles as the smaller l, and as
many as their two sizes ask for.

Only links between components are looked for. Equal sets are one. Then every set is compared with one partner: of the
first sets of like size in its posting lists, the one that most of its postings name; these are as many pairs as sets. What they link is one component, and in the full join that follows a posting list's largest component meets
only the sets outside it. So a large group of copies costs its size, and no link between components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import lowered, mixed, text_bytes, tidy_batches, tidy_table, word_hashes, word_spans
from .blocks import (ROW_BITS, bucket_count, bucket_of, by_bucket, found_in, groups_of, low_half, rows_of, squeeze,
                     store_blocks, unsqueeze, with_answers)
from .common import discard, read, stored
from .components import components

# Largest l that a document may choose.
MOST_MATCHES = 8
# Cost of comparing two sets, per shingle, against the cost of one pair in a posting list.
VERIFY = 0.05


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of every document, and their documents, sorted by both. Fewer words
    than a shingle has: the whole sequence is the only one. A-Z count as a-z."""
    data = lowered(data)
    starts, ends, documents = word_spans(data, offsets)
    names = word_hashes(data, starts, ends)
    counts = np.bincount(documents, minlength=len(offsets) - 1)
    n = len(names)
    hashes = np.zeros(max(0, n - words + 1), np.uint64)
    for i in range(words):
        hashes = mixed(hashes * np.uint64(3) + names[i:i + len(hashes)])
    if len(hashes):
        inside = documents[:len(hashes)] == documents[words - 1:]
        hashes, owner = hashes[inside], documents[:len(inside)][inside]
    else:
        owner = np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(counts)])[short]
        whole = np.full(len(short), 0x5851F42D4C957F2D, np.uint64)
        for i in range(words - 1):
            more = counts[short] > i
            whole[more] = mixed(whole[more] * np.uint64(5) + names[begin[more] + i])
        hashes, owner = np.concatenate([hashes, whole]), np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _counts(blocks: DataFrame, buckets: int, text: str, words: int) -> DataFrame:
    """(block, bucket, keys, counts): for every block, in how many documents of all its shingles are, where that is
    more than one."""
    def count(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, _ = shingles(*text_bytes(rows_of(payload).column(text)), words)
                found = np.sort(found)
                starts = groups_of(found)
                n = np.diff(np.append(starts, len(found))).astype(np.uint32)
                found = found[starts]
                low, runs = low_half(found), by_bucket(bucket_of(found, buckets))
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in runs], pa.int64()), pa.array([block] * len(runs), pa.int64()),
                    pa.array([low[x:y].tobytes() for _, x, y in runs], pa.binary()),
                    pa.array([n[x:y].tobytes() for _, x, y in runs], pa.binary())],
                    names=["bucket", "block", "keys", "counts"])

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()]
        joined = np.concatenate(keys)
        n = np.concatenate([np.frombuffer(k, np.uint32) for k in table.column("counts").to_pylist()]).astype(np.int64)
        source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(joined, kind="stable")
        starts = groups_of(joined[order])
        total = np.add.reduceat(n[order], starts)
        all_ = np.empty(len(joined), np.int64)
        all_[order] = np.repeat(total, np.diff(np.append(starts, len(order))))
        kept = np.flatnonzero(all_ > 1)
        blocks_, buckets_ = table.column("block").to_pylist(), table.column("bucket").to_pylist()
        out = [(blocks_[i], buckets_[i], squeeze(joined[kept[a:b]]),
                squeeze(np.minimum(all_[kept[a:b]], 0xFFFFFFFF).astype(np.uint32)))
               for i, a, b in by_bucket(source[kept])]
        return pa.table([pa.array([o[i] for o in out], t)
                         for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                        names=["block", "bucket", "keys", "counts"])

    entries = blocks.select("block", "payload").mapInArrow(
        tidy_batches(count), "bucket long, block long, keys binary, counts binary")
    return entries.groupBy("bucket").applyInArrow(tidy_table(add), "block long, bucket long, keys binary, counts binary")


def prefix_choice(frequency: np.ndarray, n: int, percent: int) -> tuple[int, int]:
    """(l, prefix length) for shingles in order, given how many documents hold each.

    An l-prefix has postings of S = sum(frequency - 1) others; no more than S / l of them can share l shingles with
    it. The l with the least S + verification of S / l is taken, the smallest of equal ones.
    """
    need = -(-percent * n // 100)
    others = np.cumsum(frequency.astype(np.int64) - 1)
    best, chosen = None, (1, n - need + 1)
    for matches in range(1, min(MOST_MATCHES, need) + 1):
        length = n - need + matches
        postings = float(others[length - 1])
        cost = postings + postings / matches * (1 + VERIFY * n)
        if best is None or cost < best:
            best, chosen = cost, (matches, length)
        if postings == 0:
            break
    return chosen


def _sets(blocks: DataFrame, counts: DataFrame, buckets: int, key: str, text: str, words: int, percent: int,
          key_type: T.DataType) -> DataFrame:
    """One row per document: place, key, size and hashes of the set, and how many of its shingles no other document
    has; where its prefix may be shared, also l, the prefix's postings and the set itself."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left.column("payload")[0].as_py())
        block = left.column("block")[0].as_py()
        n_rows = rows.num_rows
        hashes, owner = shingles(*text_bytes(rows.column(text)), words)
        frequency = np.ones(len(hashes), np.uint32)
        wide = (bucket_of(hashes, buckets).astype(np.uint64) << np.uint64(32)) | low_half(hashes)
        known = [unsqueeze(k, np.uint32).astype(np.uint64) | np.uint64(b << 32)
                 for b, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist())]
        if known:
            known = np.concatenate(known)
            often = np.concatenate([unsqueeze(c, np.uint32) for c in right.column("counts").to_pylist()])
            order = np.argsort(known, kind="stable")
            place = found_in(wide, known[order])
            frequency[place >= 0] = often[order][place[place >= 0]]
        signed = hashes.view(np.int64)
        edges = np.searchsorted(owner, np.arange(n_rows + 1))
        sizes = np.diff(edges)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ np.uint64(salt)))]) for salt in (1, 2)]
        names = [(s[edges[1:]] - s[edges[:-1]]).view(np.int64) for s in sums]
        order = np.lexsort((hashes, frequency, owner))
        alone = np.bincount(owner[frequency == 1], minlength=n_rows)
        matches, postings, sets = [], [], []
        for i in range(n_rows):
            a, b = edges[i], edges[i + 1]
            n, found = int(b - a), None
            # A set so small that only equal sets reach the threshold needs no postings.
            if n and percent * (n + 1) <= 100 * n:
                mine = frequency[order[a:b]]
                l, length = prefix_choice(mine, n, percent)
                shared = mine[:length] > 1
                if int(shared.sum()) >= l:
                    found = signed[order[a:b]][:length][shared]
            matches.append(None if found is None else l)
            postings.append(None if found is None else found)
            sets.append(None if found is None else signed[a:b])
        longs = pa.list_(pa.int64())
        keys = rows.column(key)
        return pa.table([pa.array((block << ROW_BITS) + np.arange(n_rows), pa.int64()), keys,
                         pa.array(sizes, pa.int64()), pa.array(names[0]), pa.array(names[1]),
                         pa.array(alone, pa.int64()), pa.array(matches, pa.int32()), pa.array(postings, longs),
                         pa.array(sets, longs)],
                        names=[f.name for f in schema.fields])

    schema = T.StructType([T.StructField("ref", T.LongType()), T.StructField("key", key_type),
                           T.StructField("n", T.LongType()), T.StructField("name1", T.LongType()),
                           T.StructField("name2", T.LongType()), T.StructField("alone", T.LongType()),
                           T.StructField("matches", T.IntegerType()),
                           T.StructField("postings", T.ArrayType(T.LongType())),
                           T.StructField("set", T.ArrayType(T.LongType()))])
    return stored(with_answers(blocks.select("block", "payload"), counts, work, schema))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold, by counting what they share."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("ref").alias(name), F.col("set").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - shared
    return both.filter(100 * shared >= percent * union).select("a", "b")


def _matching(pairs: DataFrame, active: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share as many shingles as the smaller l asks for, and as the two sizes ask for:
    what two prefixes do not share can only be shared behind the one that ends first."""
    def side(x: str) -> DataFrame:
        rest = F.ceil(percent * F.col("n") / 100) - F.col("matches")
        return active.select(F.col("ref").alias(x), F.col("n").alias(f"n_{x}"), F.col("matches").alias(f"l_{x}"),
                             rest.alias(f"rest_{x}"), F.col("postings").alias(f"postings_{x}"))
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    least = F.greatest(F.least("l_a", "l_b"), overlap - F.greatest("rest_a", "rest_b"))
    shared = F.size(F.array_intersect("postings_a", "postings_b"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(shared >= least).select("a", "b")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                   percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Blocks of ``docs``, and (ref, key, n, root) for every row: its place, set size, and the place of the first row
    of the group that similarity links connect it to (its own if it is linked with nothing).

    Words end at ASCII white space; two rows link if 100 * shared >= percent * union of their shingle sets. Sets are
    compared by 64-bit hashes of shingles. Null text or no words: an empty set, linked with nothing. Fewer words than
    a shingle: the whole sequence is the set. Null and repeated keys do not matter, rows are known by their place.
    Very long texts count whole. Empty input: no rows.
    """
    blocks = store_blocks(docs, text)
    buckets = bucket_count(blocks)
    nodes = _sets(blocks, _counts(blocks, buckets, text, words), buckets, key, text, words, percent,
                  docs.schema[key].dataType)
    equal = nodes.filter("n > 0").groupBy("n", "name1", "name2").agg(F.min("ref").alias("first"), F.count(F.lit(1)).alias("c"))
    copies = stored(nodes.filter("n > 0").select("ref", "n", "name1", "name2").join(
        equal.filter("c > 1").drop("c"), ["n", "name1", "name2"]).filter("ref <> first").select(
        F.col("ref").alias("a"), F.col("first").alias("b")))
    active = stored(nodes.filter("matches IS NOT NULL").join(
        copies.select(F.col("a").alias("ref")), "ref", "left_anti").select("ref", "n", "alone", "matches", "postings", "set"))
    sets = active.select("ref", "set")
    # A posting's place in its set's order; the shingles that no other set has come first.
    lists = active.select("ref", "n", (F.col("n") - F.col("alone")).alias("known"),
                          F.posexplode("postings").alias("place", "shingle")).withColumn(
        "place", F.col("place") + F.col("n") - F.col("known") + 1)
    # One partner each, from a list's sets of like size (less than a third apart) one with few shingles of its own.
    sized = lists.select("ref", "shingle", F.floor(4 * F.log("n")).alias("class"), (F.col("n") - F.col("known")).alias("own"))
    heads = sized.groupBy("shingle", "class").agg(F.min(F.struct("own", "ref"))["ref"].alias("head"),
                                                  F.count(F.lit(1)).alias("c"))
    named = sized.join(heads.filter("c > 1").drop("c"), ["shingle", "class"]).filter("ref <> head")
    votes = named.groupBy("ref", "head").agg(F.count(F.lit(1)).alias("votes"))
    partner = votes.groupBy("ref").agg(F.max_by("head", F.struct("votes", -F.col("head"))).alias("b"))
    first = stored(_linked(partner.select(F.col("ref").alias("a"), "b"), sets, percent))
    known = stored(components(first))
    # The full join, between components only.
    at = stored(lists.join(known.withColumnRenamed("node", "ref"), "ref", "left").withColumn(
        "root", F.coalesce("root", "ref")))
    by_root = at.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("c"))
    largest = by_root.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("largest"),
                                             F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    open_ = stored(at.join(largest.drop("roots"), "shingle"))
    def side(x: str):
        return [F.col(c).alias(f"{c}_{x}") for c in ("ref", "n", "known", "place", "root")]
    outside = open_.filter("root <> largest").select("shingle", *side("a"))
    every = open_.select("shingle", *side("b"), (F.col("root") == F.col("largest")).alias("inner"))
    # Two sets must share this much. They can share no more than what either has in common with any other set, and
    # the first shingle that they share has that much less one behind it in both.
    overlap = F.ceil(percent * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    near = (F.col("root_a") != F.col("root_b")) & (F.col("inner") | (F.col("ref_a") < F.col("ref_b"))) & (
        100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (
        F.least("known_a", "known_b") >= overlap) & (
        F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1 >= overlap)
    meetings = outside.join(every, "shingle").filter(near).select(
        F.least("ref_a", "ref_b").alias("a"), F.greatest("ref_a", "ref_b").alias("b")).distinct()
    candidates = _matching(meetings, active, percent)
    second = stored(_linked(candidates, sets, percent))
    roots = components(copies.unionByName(first).unionByName(second))
    grouped = nodes.select("ref", "key", "n").join(roots.withColumnRenamed("node", "ref"), "ref", "left").select(
        "ref", "key", "n", F.coalesce("root", "ref").alias("root"))
    grouped = stored(grouped)
    discard(nodes, copies, active, first, known, at, open_, second)
    return blocks, grouped


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) of every row: the size of its set and the smallest key of its group. Null keys
    count only where a group has no other."""
    blocks, grouped = similar_groups(docs, key, text, words, percent)
    discard(blocks)
    smallest = grouped.filter("root <> ref").select("root").distinct().withColumnRenamed("root", "_r")
    least = grouped.join(smallest, F.col("root") == F.col("_r")).groupBy("_r").agg(F.min("key").alias("least"))
    return grouped.join(least, F.col("root") == F.col("_r"), "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("_r").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5,
                percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are linked to a row with a smaller key: of every group the row with the
    smallest key stays, the first place among equal or null keys. All columns unchanged."""
    blocks, grouped = similar_groups(docs, key, text, words, percent)
    several = grouped.filter("root <> ref").select(F.col("root").alias("_r")).distinct()
    members = grouped.join(several, F.col("root") == F.col("_r")).select("_r", "ref", "key")
    rank = F.struct(F.col("key").isNull(), F.col("key"), F.col("ref"))
    stays = members.groupBy("_r").agg(F.min(rank)["ref"].alias("stays"))
    gone = members.join(stays, "_r").filter("ref <> stays").select(
        F.shiftright("ref", ROW_BITS).alias("block"), F.expr(f"ref & {(1 << ROW_BITS) - 1}").alias("place"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left.column("payload")[0].as_py())
        keep = np.ones(rows.num_rows, bool)
        keep[right.column("place").to_numpy()] = False
        return rows.filter(pa.array(keep))

    return with_answers(blocks.select("block", "payload"), gone, work, docs.schema)


def grouped_documents(spark, directory: str) -> DataFrame:
    """op10: three-word shingles, a similarity of 0.9."""
    return classes(read(spark, directory, "documents", "doc_id", "text"), words=3, percent=90)
