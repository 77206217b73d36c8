"""Phrase collocations: word n-grams counted by extending intervals of bidirectional FM-indexes, one index a shard.

A shard's pieces of words are one circular sequence of numbers with a border (0) between pieces. Its rotations, sorted
by their first words, give the forward transform (the word before each rotation); the reversed sequence gives the
backward one. A phrase is an interval of both. All words that stand before (after) the phrases of a shard are read off
the forward (backward) transform at once, which gives the longer phrases' two intervals and counts.

What a shard finds is added up over all shards before it goes on: a phrase is extended only if its corpus count
reaches the minimum, and one word longer it is counted only if its first and its last words both do. A phrase is known
by the numbers of these two, so counts are exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .arrays import lowered, mixed, text_bytes, tidy_batches, tidy_table, word_spans
from .blocks import BLOCK_BITS, bucket_of, by_bucket, groups_of, squeeze, unsqueeze, with_answers
from .common import discard, read, stored

# Words of the longest phrases; the transforms are sorted by as many words.
LONGEST = 5
MIN_COUNT = 100
TOP = 2000
# A shard holds whole documents with about this many bytes of text, one document at least.
SHARD_BYTES = 1 << 23
# Counts are added up in as many buckets as the text has units of this many bytes.
BUCKET_BYTES = 1 << 22
# A list of best phrases is first cut in so many parts of a stratum.
PARTS = 64

_SPACE = np.isin(np.arange(256), [32, 9])
_MARK = np.isin(np.arange(256), [*b".,;:!?", 10, 11, 12, 13])


def sorted_rotations(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the rotations of a circular sequence in the order of their first ``depth`` numbers."""
    rank, have = sequence.astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        _, rank = np.unique(rank * (int(rank.max()) + 1) + np.roll(rank, -step), return_inverse=True)
        have += step
    return np.argsort(rank, kind="stable")


def transform(sequence: np.ndarray, depth: int = LONGEST) -> np.ndarray:
    """The number before each rotation, in the order of the rotations."""
    return np.roll(sequence, 1)[sorted_rotations(sequence, depth)]


def extended(before: np.ndarray, near: np.ndarray, far: np.ndarray, size: np.ndarray):
    """All extensions of phrases by one word on the side of a transform.

    Phrase i has the rows [near, near + size) of this transform and as many from ``far`` on of the other. Returned by
    extension, without borders: the phrase that is extended, the longer phrase's rows (near, far, size), and the
    phrase of the first as many words as a phrase has on the extended side (-1 if it is none of them).
    """
    if not len(size):
        return (np.zeros(0, np.int64),) * 5
    first = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(size)), size)
    rows = np.arange(len(owner)) - first[owner] + near[owner]
    words = before[rows].astype(np.int64)
    code = owner * (int(before.max(initial=0)) + 1) + words
    order = np.argsort(code, kind="stable")
    starts = groups_of(code[order])
    count = np.diff(np.append(starts, len(order)))
    head = order[starts]
    own, word, row = owner[head], words[head], rows[head]
    # The k-th row that holds a word goes to the k-th rotation that begins with it.
    place = np.empty(len(before), np.int64)
    place[np.argsort(before, kind="stable")] = np.arange(len(before))
    longer_near = place[row]
    # In the other transform a phrase's rows are sorted by the word that extends it here.
    longer_far = far[own] + starts - first[own]
    by_near = np.argsort(near)
    at = np.searchsorted(near[by_near], longer_near, side="right") - 1
    shared = by_near[at]
    shared = np.where((at >= 0) & (longer_near < near[shared] + size[shared]), shared, -1)
    inside = word > 0
    return own[inside], longer_near[inside], longer_far[inside], count[inside], shared[inside]


def store_shards(docs: DataFrame, text: str, stratum: str, other: str) -> DataFrame:
    """(block, n_bytes, n_words, forward, backward, strata, words, counts): the two transforms of each shard, and its
    different words by stratum in the order of their numbers, which begin at 1."""
    def shard(data, offsets, strata):
        data = lowered(data)
        names, of = np.unique(strata, return_inverse=True) if len(strata) else (np.zeros(0, object), np.zeros(0, np.int64))
        mark = _MARK[data]
        solid = ~(_SPACE[data] | mark)
        starts, ends, documents = word_spans(data, offsets, solid)
        marks = np.concatenate([[0], np.cumsum(mark)])
        kept = np.concatenate([[0], np.cumsum(ends - starts)])
        column = pa.Array.from_buffers(pa.large_string(), len(starts), [
            None, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[solid]))])
        found = column.dictionary_encode()
        words = found.dictionary
        code = of[documents] * max(1, len(words)) + found.indices.to_numpy(zero_copy_only=False)
        different, number, counts = np.unique(code, return_inverse=True, return_counts=True)
        border = np.ones(len(starts), bool)
        border[1:] = (documents[1:] != documents[:-1]) | (marks[starts[1:]] != marks[ends[:-1]])
        sequence = np.zeros(len(starts) + int(border.sum()) + 1, np.uint32)
        sequence[np.arange(len(starts)) + np.cumsum(border)] = number + 1
        longs = pa.int64()
        return [int(offsets[-1]), len(starts), squeeze(transform(sequence)), squeeze(transform(sequence[::-1])),
                [str(names[i]) for i in different // max(1, len(words))],
                words.take(pa.array(different % max(1, len(words)), longs)).cast(pa.string()).to_pylist(), counts.tolist()]

    def run(batches):
        number, held, parts = TaskContext.get().partitionId() << BLOCK_BITS, 0, []

        def out():
            nonlocal number, held, parts
            data = np.concatenate([d for d, _, _ in parts])
            sizes = np.concatenate([np.diff(o) for _, o, _ in parts])
            row = shard(data, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([s for _, _, s in parts]))
            batch = pa.RecordBatch.from_pylist([dict(zip(schema.names, [number, *row]))], schema)
            number, held, parts = number + 1, 0, []
            return batch

        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            strata = np.array(batch.column(1).to_pylist(), object)
            first = 0
            while first < batch.num_rows:
                room = offsets[first] + SHARD_BYTES - held
                last = max(int(np.searchsorted(offsets, room, side="right")) - 1, first if parts else first + 1)
                last = min(last, batch.num_rows)
                if last > first:
                    parts.append((data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], strata[first:last]))
                    held += int(offsets[last] - offsets[first])
                if last < batch.num_rows:
                    yield out()
                first = last
        if parts:
            yield out()

    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("n_words", pa.int64()), ("forward", pa.binary()),
                        ("backward", pa.binary()), ("strata", pa.list_(pa.string())), ("words", pa.list_(pa.string())),
                        ("counts", pa.list_(pa.int64()))])
    rows = docs.select(F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{stratum}`").cast("string"), F.lit(other)).alias("stratum"))
    return stored(rows.mapInArrow(tidy_batches(run), "block long, n_bytes long, n_words long, forward binary, backward binary, "
                                  "strata array<string>, words array<string>, counts array<long>"))


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers by place of their bytes, compressed."""
    return squeeze(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T)


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(unsqueeze(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _flat(table: pa.Table, name: str) -> np.ndarray:
    chunks = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column(name).chunks]
    return np.concatenate(chunks).astype(np.int64) if chunks else np.zeros(0, np.int64)


def _send(shards: DataFrame, messages: DataFrame, depth: int, buckets: int, last: bool) -> DataFrame:
    """Every shard's phrases of ``depth`` words, from its phrases with one word less that the messages number.

    Rows (bucket, block, first, keys, counts): numbers of the phrases of the first and of the last words, and counts;
    and, unless this is the ``last`` depth, one row of bucket -1 with the intervals in the order of what was sent.
    Even depths are reached to the left, odd ones to the right.
    """
    left_side = depth % 2 == 0

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {name: [] for name in ("bucket", "block", "first", "keys", "counts", "intervals")}
        if left.num_rows:
            before = unsqueeze(left.column("side")[0].as_py(), np.uint32)
            slots, numbers = _flat(right, "slots"), _flat(right, "numbers")
            known = [v for v in right.column("intervals").to_pylist() if v is not None]
            if known:
                forward, backward, size = _unplanes(known[0]).reshape(3, -1)[:, slots]
            else:
                # One word: the rotations that begin with it, the same in both transforms.
                each = np.bincount(before)
                forward = backward = (np.cumsum(each) - each)[slots]
                size = each[slots]
            near, far = (forward, backward) if left_side else (backward, forward)
            own, near, far, size, shared = extended(before, near, far, size)
            fits = shared >= 0
            own, near, far, size, shared = own[fits], near[fits], far[fits], size[fits], shared[fits]
            outer, inner = numbers[shared], numbers[own]
            prefix, suffix = (outer, inner) if left_side else (inner, outer)
            bucket = bucket_of(mixed(mixed(prefix.astype(np.uint64)) + suffix.astype(np.uint64)), buckets)
            order = np.argsort(bucket, kind="stable")
            block = left.column("block")[0].as_py()
            for b, start, stop in by_bucket(bucket[order]):
                part = order[start:stop]
                for name, value in zip(out, (b, block, start, _planes(np.concatenate([prefix[part], suffix[part]])),
                                             _planes(size[part]), None)):
                    out[name].append(value)
            if len(order) and not last:
                forward, backward = (near, far) if left_side else (far, near)
                rows = _planes(np.concatenate([forward[order], backward[order], size[order]]))
                for name, value in zip(out, (-1, block, 0, None, None, rows)):
                    out[name].append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    sides = shards.select("block", F.col("forward" if left_side else "backward").alias("side"))
    return stored(with_answers(sides, messages, work,
                               "bucket long, block long, first long, keys binary, counts binary, intervals binary"))


def _number_words(shards: DataFrame, buckets: int, min_count: int) -> DataFrame:
    """Answers (block, slots, numbers) about the shards' words that reach the minimum in their stratum, and rows of
    block null with these words (numbers, strata, words, totals)."""
    def send(batches):
        for batch in batches:
            for block, strata, words, counts in zip(*[batch.column(i) for i in range(4)]):
                strata, words, counts = strata.values, words.values, counts.values
                # One string for both: the stratum's length tells where it ends.
                keys = pc.binary_join_element_wise(pc.binary_length(strata).cast(pa.string()), strata, words, ":")
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys.to_pylist()), np.uint64, len(keys))
                bucket = bucket_of(hashes, buckets)
                order = np.argsort(bucket, kind="stable")
                for b, start, stop in by_bucket(bucket[order]):
                    part = pa.array(order[start:stop])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([b], pa.int64()), pa.array([block.as_py()], pa.int64()),
                        *[pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), values)
                          for values in (part, keys.take(part), strata.take(part), words.take(part), counts.take(part))]],
                        names=["bucket", "block", "slots", "keys", "strata", "words", "counts"])

    def add(table: pa.Table) -> pa.Table:
        flat = {name: pa.concat_arrays([c.flatten() for c in table.column(name).chunks])
                for name in ("slots", "keys", "strata", "words", "counts")}
        sizes = pc.list_value_length(table.column("slots")).to_numpy()
        source = np.repeat(np.arange(len(sizes)), sizes)
        word = flat["keys"].dictionary_encode().indices.to_numpy()
        totals = np.zeros(int(word.max(initial=-1)) + 1, np.int64)
        np.add.at(totals, word, flat["counts"].to_numpy())
        often = np.flatnonzero(totals >= min_count)
        name = np.full(len(totals), -1)
        name[often] = (table.column("bucket")[0].as_py() << 36) + np.arange(len(often))
        one = np.zeros(len(totals), np.int64)
        one[word] = np.arange(len(word))
        number, slots = name[word], flat["slots"].to_numpy()
        blocks = table.column("block").to_pylist()
        kept = np.flatnonzero(number >= 0)
        rows = [dict(block=blocks[i], slots=slots[kept[a:b]] + 1, numbers=number[kept[a:b]]) for i, a, b in by_bucket(source[kept])]
        if len(often):
            heads = pa.array(one[often])
            rows.append(dict(numbers=name[often], strata=flat["strata"].take(heads).to_pylist(),
                             words=flat["words"].take(heads).to_pylist(), totals=totals[often]))
        return pa.Table.from_pylist(rows, schema)

    longs, texts = pa.list_(pa.int64()), pa.list_(pa.string())
    schema = pa.schema([("block", pa.int64()), ("slots", longs), ("numbers", longs), ("strata", texts), ("words", texts),
                        ("totals", longs)])
    sent = shards.select("block", "strata", "words", "counts").mapInArrow(tidy_batches(send),
        "bucket long, block long, slots array<long>, keys array<string>, strata array<string>, words array<string>, "
        "counts array<long>")
    return stored(sent.groupBy("bucket").applyInArrow(
        tidy_table(add), "block long, slots array<long>, numbers array<long>, strata array<string>, words array<string>, "
                         "totals array<long>"))


def _add_up(sent: DataFrame, min_count: int) -> DataFrame:
    """Answers (block, slots, numbers) about the phrases that reach the minimum, and rows of block null with these
    phrases (numbers, prefixes, suffixes, totals)."""
    def add(table: pa.Table) -> pa.Table:
        keys = [_unplanes(k).reshape(2, -1) for k in table.column("keys").to_pylist()]
        counts = np.concatenate([_unplanes(c) for c in table.column("counts").to_pylist()])
        source = np.repeat(np.arange(len(keys)), [k.shape[1] for k in keys])
        place = np.concatenate([np.arange(k.shape[1]) + f for k, f in zip(keys, table.column("first").to_pylist())])
        prefix, suffix = np.concatenate(keys, axis=1)
        order = np.lexsort((suffix, prefix))
        new = np.ones(len(order), bool)
        new[1:] = (prefix[order][1:] != prefix[order][:-1]) | (suffix[order][1:] != suffix[order][:-1])
        starts = np.flatnonzero(new)
        totals = np.add.reduceat(counts[order], starts)
        often = np.flatnonzero(totals >= min_count)
        name = np.full(len(starts), -1)
        name[often] = (table.column("bucket")[0].as_py() << 36) + np.arange(len(often))
        number = np.empty(len(order), np.int64)
        number[order] = np.repeat(name, np.diff(np.append(starts, len(order))))
        blocks = table.column("block").to_pylist()
        kept = np.flatnonzero(number >= 0)
        rows = [dict(block=blocks[i], slots=place[kept[a:b]], numbers=number[kept[a:b]]) for i, a, b in by_bucket(source[kept])]
        heads = order[starts[often]]
        if len(often):
            rows.append(dict(numbers=name[often], prefixes=prefix[heads], suffixes=suffix[heads], totals=totals[often]))
        return pa.Table.from_pylist(rows, schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("slots", longs), ("numbers", longs), ("prefixes", longs),
                        ("suffixes", longs), ("totals", longs)])
    return stored(sent.filter("bucket >= 0").select("bucket", "block", "first", "keys", "counts").groupBy("bucket").applyInArrow(
        tidy_table(add), "block long, slots array<long>, numbers array<long>, prefixes array<long>, suffixes array<long>, "
                         "totals array<long>"))


def frequent_phrases(docs: DataFrame, text: str = "text", stratum: str = "lang", longest: int = LONGEST,
                     min_count: int = MIN_COUNT, other: str = "und") -> tuple[list[DataFrame], DataFrame]:
    """Tables of all phrases of 1, 2, ... ``longest`` words that occur ``min_count`` times or more in their stratum,
    and (stratum, n) with the number of all words.

    A table has (number, prefix, suffix, stratum, phrase, last, a, firsts, rests): numbers of the phrases without the
    last and without the first word in the table before, the phrase with single spaces, its last word, its count, and
    the counts of its first (last) 1, 2, ... words. A-Z count as a-z; words are parted by spaces and tabs, and phrases
    do not cross ``.,;:!?`` or the four line ends. Occurrences may overlap.

    Null text: empty. Null stratum: ``other``. Very long texts: whole, a shard each. Repeated rows count each. Empty
    input: empty tables. Other columns are not read.
    """
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases of 1 to {LONGEST} words")
    shards = store_shards(docs, text, stratum, other)
    buckets = max(1, -(-(shards.agg(F.sum("n_bytes")).first()[0] or 0) // BUCKET_BYTES))
    n_words = stored(shards.select(F.explode(F.arrays_zip("strata", "counts")).alias("w")).groupBy(
        F.col("w.strata").alias("stratum")).agg(F.sum("w.counts").alias("n")))
    answers = _number_words(shards, buckets, min_count)
    level = stored(answers.filter("block IS NULL").select(
        F.explode(F.arrays_zip("numbers", "strata", "words", "totals")).alias("w")).select(
        F.col("w.numbers").alias("number"), F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"),
        F.col("w.strata").alias("stratum"), F.col("w.words").alias("phrase"), F.col("w.words").alias("last"),
        F.col("w.totals").alias("a"), F.array("w.totals").alias("firsts"), F.array("w.totals").alias("rests")))
    messages = answers.filter("block IS NOT NULL").select(
        "block", "slots", "numbers", F.lit(None).cast("binary").alias("intervals"))
    levels, done = [level], [answers]
    for depth in range(2, longest + 1):
        sent = _send(shards, messages, depth, buckets, depth == longest)
        discard(*done)
        answers = _add_up(sent, min_count)
        done = [sent, answers]
        found = answers.filter("block IS NULL").select(
            F.explode(F.arrays_zip("numbers", "prefixes", "suffixes", "totals")).alias("p")).select(
            F.col("p.numbers").alias("number"), F.col("p.prefixes").alias("prefix"), F.col("p.suffixes").alias("suffix"),
            F.col("p.totals").alias("a"))
        head = level.select(F.col("number").alias("prefix"), "stratum", F.col("phrase").alias("p"), "firsts")
        tail = level.select(F.col("number").alias("suffix"), "last", "rests")
        level = stored(found.join(head, "prefix").join(tail, "suffix").select(
            "number", "prefix", "suffix", "stratum", F.concat_ws(" ", "p", "last").alias("phrase"), "last", "a",
            F.array_append("firsts", F.col("a")).alias("firsts"), F.array_append("rests", F.col("a")).alias("rests")))
        levels.append(level)
        none = F.array().cast("array<long>")
        messages = answers.filter("block IS NOT NULL").select(
            "block", "slots", "numbers", F.lit(None).cast("binary").alias("intervals")).unionByName(
            sent.filter("bucket = -1").select("block", none.alias("slots"), none.alias("numbers"), "intervals"))
    discard(shards, *done)
    return levels, n_words


def _lowest_cut(n: Column) -> Column:
    """(score, k, l, r) of the cut behind the first k words with the lowest score, the smallest k of equal ones.

    Products are decimals of 38 digits, and ``div`` cuts off what is behind the point."""
    def cut(k: Column) -> Column:
        l = F.element_at("firsts", k)
        r = F.element_at("rests", F.size("firsts") - k)
        return F.struct(l.alias("l"), r.alias("r"), k.alias("k"))
    wide = "decimal(19,0)"
    cuts = F.transform(F.sequence(F.lit(1), F.size("firsts") - 1), cut)
    above = (F.lit(1000) * F.col("a")).cast(wide) * n.cast(wide)
    return F.array_min(F.transform(cuts, lambda c: F.struct(
        F.call_function("div", above, c.l.cast(wide) * c.r.cast(wide)).alias("score"), c.k.alias("k"),
        c.l.alias("l"), c.r.alias("r"))))


def collocations(docs: DataFrame, text: str = "text", stratum: str = "lang", longest: int = LONGEST,
                 min_count: int = MIN_COUNT, top: int = TOP, percent: int = 100, other: str = "und") -> DataFrame:
    """(stratum, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of every stratum.

    The score is floor(1000 * a * n / (l * r)) at the cut into two parts with counts l and r where it is lowest; a is
    the phrase's count, n that of all the stratum's words. A phrase is dropped if a phrase one word longer, and so any
    longer one, has ``percent`` percent of its count. Order: score and a descending, then the phrase's bytes. Strata
    are cut in parts first, so no task holds more than PARTS * ``top`` rows of one.

    Nulls, empty and odd input: as ``frequent_phrases`` says; a stratum without such phrases has no rows.
    """
    levels, n_words = frequent_phrases(docs, text, stratum, longest, min_count, other)
    kept = []
    for i, level in enumerate(levels[1:], 1):
        if i + 1 < len(levels):
            longer = levels[i + 1]
            most = longer.select(F.col("prefix").alias("number"), F.col("a").alias("longer")).unionByName(
                longer.select(F.col("suffix").alias("number"), F.col("a").alias("longer"))).groupBy("number").agg(
                F.max("longer").alias("longer"))
            level = level.join(most, "number", "left").filter(F.expr(f"longer IS NULL OR 100 * longer < {percent} * a"))
        kept.append(level.select("stratum", "phrase", "a", "firsts", "rests"))
    if not kept:
        return levels[0].select("stratum", F.lit(0).alias("rank"), "phrase", "a", F.col("a").alias("l"), F.col("a").alias("r"),
                                F.col("a").alias("n"), F.col("a").alias("score")).filter("false")
    phrases = kept[0]
    for level in kept[1:]:
        phrases = phrases.unionByName(level)
    scored = phrases.join(n_words, "stratum").withColumn(
        "c", _lowest_cut(F.col("n"))).select("stratum", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = F.row_number().over(Window.partitionBy("stratum", "part").orderBy(*order))
    best = scored.withColumn("part", part).withColumn("rank", first).filter(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("stratum").orderBy(*order)))
    return ranked.filter(F.col("rank") <= top).select("stratum", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l",
                                                      "r", "n", "score")


def mined_documents(spark, directory: str) -> DataFrame:
    """op12: the best phrases of every language."""
    return collocations(read(spark, directory, "documents", "text", "lang")).withColumnRenamed("stratum", "lang")


MINED_DOCUMENTS_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
lists AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists WHERE len(words) > 0),
grams AS (
  SELECT lang, d, array_to_string(words[i:i + d - 1], ' ') AS phrase, count(*) AS f
  FROM places, range(1, {LONGEST + 1}) AS lengths(d) WHERE i + d - 1 <= len(words) GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE d = 1 GROUP BY lang),
candidates AS (SELECT lang, d, phrase, f AS a FROM grams WHERE d > 1 AND f >= {MIN_COUNT}),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates o WHERE o.lang = c.lang AND o.d > c.d AND 100 * o.a >= 100 * c.a
      AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM kept, range(1, {LONGEST}) AS places(k) WHERE k < d),
scores AS (
  SELECT c.lang, c.phrase, a, h.f AS l, t.f AS r, n, k,
         (CAST(1000 AS HUGEINT) * a * n) // (CAST(h.f AS HUGEINT) * t.f) AS score
  FROM cuts c JOIN grams h ON h.lang = c.lang AND h.phrase = c.head
  JOIN grams t ON t.lang = c.lang AND t.phrase = c.tail JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scores),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
         CAST(score AS BIGINT) AS score
  FROM lowest WHERE place = 1)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
