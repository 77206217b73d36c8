"""Removal of repeated passages by prefix-free parsing.

Triggers cut every document into phrases: a place is a trigger if the rolling hash of its 16 bytes is the smallest
in one of the 50-byte strings around it. So every 50-byte string holds a trigger that depends on its bytes alone, and
equal strings lie in phrases with the same trigger. A phrase reaches from the first string that a trigger stands for
to the end of the last one; neighbours overlap, so no phrase is a prefix of what follows.

1. Triggers that only one document holds are dropped: their 16 bytes occur nowhere else, so no string does.
2. The other phrases form the dictionary, each distinct phrase once a block, with the smallest and largest id of the
   documents that hold it. A bucket sorts the 50-byte prefixes of its phrases' suffixes by a 64-bit hash, which brings
   equal ones together as a suffix array does (their alphabetical order is of no use here). Phrases that are alone
   with their trigger need no sorting: all their suffixes share one answer.
3. The parse, the phrases of each document in order, takes the answers back to the corpus: the smallest id for every
   run of strings of a phrase.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .arrays import Powers, mixed, prefix_hash, span_hash, text_bytes, tidy_batches, tidy_table
from .blocks import (bucket_count, bucket_of, by_bucket, found_in, groups_of, low_half, rows_of, squeeze,
                     store_blocks, unsqueeze, with_answers)
from .common import ROW, read

# Bytes of a string that counts as repeated, and of a trigger.
LENGTH = 50
TRIGGER = 16
# Bytes for which triggers are searched at a time; small enough for a processor's cache.
SEARCHED = 1 << 16
NO_ID = np.iinfo(np.int64).max


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """32-bit hashes of the TRIGGER bytes at every place that has them, by doubling."""
    sums, size, factor = data.astype(np.uint32), 1, 0x9E3779B1
    while size < TRIGGER:
        sums = sums[:-size] * np.uint32(factor) + sums[size:]
        size, factor = 2 * size, factor * factor & 0xFFFFFFFF
    sums ^= sums >> np.uint32(16)
    sums *= np.uint32(0x85EBCA6B)
    sums ^= sums >> np.uint32(13)
    sums *= np.uint32(0xC2B2AE35)
    sums ^= sums >> np.uint32(16)
    return sums


def _leftmost_smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (the first of equal ones) in every window of ``width``, by doubling."""
    best = hashes.astype(np.uint64) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[:len(best) - (width - size)], best[width - size:])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start of every phrase, and its trigger; LENGTH-byte strings do not cross documents."""
    width = LENGTH - TRIGGER + 1
    begins, triggers = [], []
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for low in range(0, max(0, len(data) - LENGTH + 1), SEARCHED):
        high = min(low + SEARCHED, len(data) - LENGTH + 1)
        trigger = _leftmost_smallest(rolling_hash(data[low:high + LENGTH - 1]), width)[:high - low] + low
        place = np.arange(low, high)
        whole = ends[low:high] - place >= LENGTH
        place, trigger = place[whole], trigger[whole]
        new = np.ones(len(place), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (place[1:] != place[:-1] + 1)
        begins.append(place[new])
        triggers.append(trigger[new])
    if not begins:
        none = np.zeros(0, np.int64)
        return none, none, none
    begin, trigger = np.concatenate(begins), np.concatenate(triggers)
    # A phrase that was cut where the search was cut is one again.
    new = np.ones(len(begin), bool)
    new[1:] = trigger[1:] != trigger[:-1]
    begin, trigger = begin[new], trigger[new]
    documents = np.searchsorted(offsets, begin, side="right") - 1
    last = offsets[documents + 1] - LENGTH
    follows = documents[1:] == documents[:-1]
    last[:-1][follows] = begin[1:][follows] - 1
    return begin, last, trigger


def _marks(data: np.ndarray, offsets: np.ndarray) -> bytes:
    """Phrases of a block, small: distances between starts, and of the trigger from its phrase's start."""
    begin, last, trigger = phrases(data, offsets)
    return squeeze(np.concatenate([np.diff(begin, prepend=0), last - begin, trigger - begin]).astype(np.uint32))


class Block:
    """The bytes, ids and phrases of a stored block."""

    def __init__(self, payload: bytes, marks: bytes, key: str, text: str):
        self.rows = rows_of(payload)
        self.data, self.offsets = text_bytes(self.rows.column(text))
        self.ids = self.rows.column(key).cast(pa.int64()).fill_null(NO_ID).to_numpy()
        gaps, spans, backs = unsqueeze(marks, np.uint32).astype(np.int64).reshape(3, -1)
        self.begin = np.cumsum(gaps)
        self.last = self.begin + spans
        self.back = backs
        self.owner = self.ids[np.searchsorted(self.offsets, self.begin, side="right") - 1] if len(self.begin) \
            else np.zeros(0, np.int64)

    def trigger_hash(self) -> np.ndarray:
        return _trigger_hash(self.data, self.begin + self.back)

    def phrase_hash(self, which=slice(None)) -> np.ndarray:
        return _phrase_hash(self.data, self.begin[which], self.last[which] + LENGTH, self.back[which])


def _shared_triggers(blocks: DataFrame, buckets: int, key: str, text: str) -> DataFrame:
    """(block, bucket, keys): for every block, those of its triggers that several documents hold."""
    def count(batches):
        for batch in batches:
            for block, payload, marks in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                at = Block(payload, marks, key, text)
                names = at.trigger_hash()
                order = np.lexsort((at.owner, names))
                names, owner = names[order], at.owner[order]
                starts = groups_of(names)
                stops = np.append(starts[1:], len(names)) - 1
                several = owner[starts] < owner[stops]
                names = names[starts]
                bucket, low = bucket_of(names, buckets), low_half(names)
                runs = by_bucket(bucket)
                yield pa.RecordBatch.from_arrays([
                    pa.array([b for b, _, _ in runs], pa.int64()), pa.array([block] * len(runs), pa.int64()),
                    pa.array([low[x:y].tobytes() for _, x, y in runs], pa.binary()),
                    pa.array([np.packbits(several[x:y]).tobytes() for _, x, y in runs], pa.binary())],
                    names=["bucket", "block", "keys", "several"])

    def share(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        keys = [np.frombuffer(k, np.uint32) for k in columns["keys"]]
        sizes = [len(k) for k in keys]
        joined = np.concatenate(keys)
        several = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8))[:n]
                                  for s, n in zip(columns["several"], sizes)]).astype(bool)
        source = np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(joined, kind="stable")
        starts = groups_of(joined[order])
        counts = np.diff(np.append(starts, len(order)))
        shared = np.repeat((counts > 1) | np.logical_or.reduceat(several[order], starts), counts)
        kept = np.sort(order[shared])
        out, source, joined = [], source[kept], joined[kept]
        for i, a, b in by_bucket(source):
            out.append((columns["block"][i], columns["bucket"][i], joined[a:b].tobytes()))
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                        names=["block", "bucket", "keys"])

    entries = blocks.select("block", "payload", "marks").mapInArrow(
        tidy_batches(count), "bucket long, block long, keys binary, several binary")
    return entries.groupBy("bucket").applyInArrow(tidy_table(share), "block long, bucket long, keys binary")


_ENTRY = [("spans", np.uint8), ("backs", np.uint8), ("least", np.int64),
          ("more", np.int64), ("text", np.uint8)]


def _trigger_hash(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the TRIGGER bytes at every place."""
    if len(places) == 0:
        return np.zeros(0, np.uint64)
    halves = data[places[:, None] + np.arange(TRIGGER)].view(np.uint64)
    return mixed(mixed(halves[:, 0]) + halves[:, 1])


def _phrase_hash(data: np.ndarray, begin: np.ndarray, end: np.ndarray, back: np.ndarray) -> np.ndarray:
    """64-bit hashes of the phrases' bytes and their triggers' place."""
    powers = Powers()
    return mixed(span_hash(prefix_hash(data, powers), begin, end, powers) + back.astype(np.uint64))


def _dictionary(blocks: DataFrame, shared: DataFrame, buckets: int, key: str, text: str) -> DataFrame:
    """(bucket, block, packed arrays): the distinct phrases of every block behind shared triggers."""
    names = ["bucket", "block"] + [n for n, _ in _ENTRY]

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64())] * 2 + [pa.array([], pa.binary())] * len(_ENTRY), names=names)
        if left.num_rows == 0 or right.num_rows == 0:
            return empty
        at = Block(left.column("payload")[0].as_py(), left.column("marks")[0].as_py(), key, text)
        triggers = at.trigger_hash()
        wide = (bucket_of(triggers, buckets).astype(np.uint64) << np.uint64(32)) | low_half(triggers)
        known = np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32)
                                for b, k in zip(right.column("bucket").to_pylist(), right.column("keys").to_pylist())])
        which = np.flatnonzero(found_in(wide, np.sort(known)) >= 0)
        phrase = at.phrase_hash(which)
        order = np.lexsort((at.owner[which], phrase, wide[which] >> np.uint64(32)))
        which, phrase = which[order], phrase[order]
        starts = groups_of(phrase)
        least = at.owner[which[starts]]
        most = at.owner[which[np.append(starts[1:], len(which)) - 1]]
        which, phrase = which[starts], phrase[starts]
        spans = at.last[which] - at.begin[which]
        out = []
        for bucket, a, b in by_bucket((wide[which] >> np.uint64(32)).astype(np.int64)):
            w, s = which[a:b], spans[a:b]
            sizes = s + LENGTH
            place = np.repeat(at.begin[w] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            arrays = {"spans": s, "backs": at.back[w], "least": least[a:b], "more": most[a:b] - least[a:b],
                      "text": at.data[place]}
            out.append([bucket, left.column("block")[0].as_py()]
                       + [squeeze(arrays[n].astype(kind)) for n, kind in _ENTRY])
        if not out:
            return empty
        kinds = [pa.int64()] * 2 + [pa.binary()] * len(_ENTRY)
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=names)

    schema = "bucket long, block long, " + ", ".join(f"{n} binary" for n, _ in _ENTRY)
    return with_answers(blocks.select("block", "payload", "marks"), shared, work, schema)


def string_answers(keys: np.ndarray, spans: np.ndarray, least: np.ndarray, data: np.ndarray):
    """Smallest id for every string of every distinct phrase, as runs: (phrase, first string, last string, id).

    ``keys`` group phrases by trigger, ``data`` are the phrases' bytes one behind the other.
    """
    order = np.argsort(keys, kind="stable")
    starts = groups_of(keys[order])
    counts = np.diff(np.append(starts, len(order)))
    alone = np.zeros(len(keys), bool)
    alone[order] = np.repeat(counts == 1, counts)
    single = np.flatnonzero(alone)
    several = np.flatnonzero(~alone)
    answers = [(single, np.zeros(len(single), np.int64), spans[single], least[single])]
    if len(several):
        begins = np.concatenate([[0], np.cumsum(spans + LENGTH)])[:-1][several]
        n = spans[several] + 1
        owner = np.repeat(np.arange(len(several)), n)
        inner = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        powers = Powers()
        place = begins[owner] + inner
        suffixes = span_hash(prefix_hash(data, powers), place, place + LENGTH, powers)
        ranked = np.argsort(suffixes, kind="stable")
        starts = groups_of(suffixes[ranked])
        smallest = np.minimum.reduceat(least[several][owner][ranked], starts)
        found = np.empty(len(ranked), np.int64)
        found[ranked] = np.repeat(smallest, np.diff(np.append(starts, len(ranked))))
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        final = np.append(first[1:], len(found)) - 1
        answers.append((several[owner[first]], inner[first], inner[final], found[first]))
    return [np.concatenate([a[i] for a in answers]) for i in range(4)]


_ANSWER = [("names", np.uint64), ("first", np.uint8), ("last", np.uint8), ("least", np.int64)]


def _answers(dictionary: DataFrame) -> DataFrame:
    """(block, packed arrays): for the phrases of every block, runs of strings that a smaller id holds too."""
    def work(table: pa.Table) -> pa.Table:
        columns = {n: [unsqueeze(v, kind) for v in table.column(n).to_pylist()] for n, kind in _ENTRY}
        sizes = [len(v) for v in columns["spans"]]
        spans, backs, least, more, data = (np.concatenate(columns[n]) for n, _ in _ENTRY)
        spans = spans.astype(np.int64)
        begins = np.concatenate([[0], np.cumsum(spans + LENGTH)[:-1]])
        keys = _trigger_hash(data, begins + backs)
        names = _phrase_hash(data, begins, begins + spans + LENGTH, backs)
        source = np.repeat(np.arange(len(sizes)), sizes)
        # One of each distinct phrase, with the smallest id of all blocks.
        order = np.lexsort((least, names))
        starts = groups_of(names[order])
        one = order[starts]
        number = np.empty(len(names), np.int64)
        number[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
        s = spans[one] + LENGTH
        place = np.repeat(begins[one] - np.concatenate([[0], np.cumsum(s)[:-1]]), s) + np.arange(s.sum())
        phrase, first, last, smallest = string_answers(keys[one], spans[one], least[one], data[place])
        # Every (block, phrase) takes the runs of its phrase whose id is below the largest of its own.
        order = np.argsort(phrase, kind="stable")
        phrase, first, last, smallest = phrase[order], first[order], last[order], smallest[order]
        from_, to = np.searchsorted(phrase, number), np.searchsorted(phrase, number, side="right")
        entry = np.repeat(np.arange(len(names)), to - from_)
        run = np.arange(len(entry)) - np.repeat(np.concatenate([[0], np.cumsum(to - from_)[:-1]]) - from_, to - from_)
        useful = smallest[run] < (least + more)[entry]
        entry, run = entry[useful], run[useful]
        blocks = table.column("block").to_pylist()
        out = []
        for i, a, b in by_bucket(source[entry]):
            arrays = {"names": names[entry[a:b]], "first": first[run[a:b]], "last": last[run[a:b]],
                      "least": smallest[run[a:b]]}
            out.append([blocks[i]] + [squeeze(arrays[n].astype(kind)) for n, kind in _ANSWER])
        kinds = [pa.int64()] + [pa.binary()] * len(_ANSWER)
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                        names=["block"] + [n for n, _ in _ANSWER])

    return dictionary.groupBy("bucket").applyInArrow(
        tidy_table(work), "block long, " + ", ".join(f"{n} binary" for n, _ in _ANSWER))


def covered(at: Block, answers: dict[str, np.ndarray]) -> np.ndarray:
    """True for every byte of a block that lies in a string which a smaller id holds too."""
    depth = np.zeros(len(at.data) + 1, np.int64)
    if len(answers["names"]) and len(at.begin):
        order = np.argsort(answers["names"], kind="stable")
        names, first, last, least = (answers[n][order] for n, _ in _ANSWER)
        phrase = at.phrase_hash()
        from_, to = np.searchsorted(names, phrase), np.searchsorted(names, phrase, side="right")
        which = np.repeat(np.arange(len(phrase)), to - from_)
        run = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(to - from_)[:-1]]) - from_, to - from_)
        useful = least[run] < at.owner[which]
        which, run = which[useful], run[useful]
        depth += np.bincount(at.begin[which] + first[run], minlength=len(depth))
        depth -= np.bincount(at.begin[which] + last[run] + LENGTH, minlength=len(depth))
    return np.cumsum(depth)[:-1] > 0


def whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Marks all bytes of every character of which one byte is marked."""
    if not len(data):
        return gone
    character = np.cumsum((data & 0xC0) != 0x80) - 1
    return np.bincount(character, weights=gone)[character] > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """Every row of ``docs`` in ``_row``, with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept``, the bytes that stay.

    With ``characters``, a character that loses a byte goes whole, so ``kept`` is text. A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller key. Strings are
    judged on the input and never cross documents; all strings of all texts count, however often they occur. A string
    is told from others by its trigger and a 64-bit hash.

    Null or empty text, or one shorter than LENGTH: nothing goes. Null key: larger than all keys, and null keys are
    equal among themselves. Equal keys: not smaller than each other, so repeated rows stay unless a smaller key holds
    their strings. Very long texts are blocks of their own. Empty input: no rows. Other columns ride along inside
    ``_row``.
    """
    blocks = store_blocks(docs, text, _marks)
    buckets = bucket_count(blocks)
    dictionary = _dictionary(blocks, _shared_triggers(blocks, buckets, key, text), buckets, key, text)
    answers = _answers(dictionary)
    schema = T.StructType([T.StructField(ROW, docs.schema), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
                           T.StructField("kept", T.BinaryType())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        at = Block(left.column("payload")[0].as_py(), left.column("marks")[0].as_py(), key, text)
        found = {n: np.concatenate([np.zeros(0, kind)] + [unsqueeze(v, kind) for v in right.column(n).to_pylist()])
                 for n, kind in _ANSWER}
        gone = covered(at, found)
        if characters:
            gone = whole_characters(at.data, gone)
        sums = np.concatenate([[0], np.cumsum(gone)])
        n_removed = sums[at.offsets[1:]] - sums[at.offsets[:-1]]
        opens = gone.copy()
        opens[1:] &= ~gone[:-1]
        inner = at.offsets[:-1][np.diff(at.offsets) > 0]
        opens[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(opens)])
        n_spans = spans[at.offsets[1:]] - spans[at.offsets[:-1]]
        rest = at.data[~gone]
        ends = np.cumsum(np.diff(at.offsets) - n_removed).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [
            None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes()), pa.py_buffer(rest.tobytes())])
        rows = at.rows.combine_chunks()
        columns = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns]
        return pa.table([pa.StructArray.from_arrays(columns, names=rows.column_names),
                         pa.array(np.diff(at.offsets), pa.int64()), pa.array(n_removed, pa.int64()),
                         pa.array(n_spans, pa.int64()), kept.cast(pa.binary())],
                        names=[ROW, "n_bytes", "n_removed", "n_spans", "kept"])

    return with_answers(blocks.select("block", "payload", "marks"), answers, work, schema)


def without_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` with what stays of each text, cut at whole characters; ``n_chars``, if there, is counted
    anew. Rows from which nothing goes are unchanged, null texts too."""
    found = remove_repeats(docs, text=text, characters=True).withColumn("_rest", F.col("kept").cast("string"))

    def column(name: str):
        own = F.col(f"{ROW}.`{name}`")
        changed = {text: F.col("_rest"), "n_chars": F.length("_rest")}.get(name)
        if changed is None:
            return own.alias(name)
        return F.when(F.col("n_removed") > 0, changed.cast(docs.schema[name].dataType)).otherwise(own).alias(name)

    return found.select(*[column(c) for c in docs.columns])


def deduplicated_documents(spark, directory: str) -> DataFrame:
    """op2: what stays of every document."""
    found = remove_repeats(read(spark, directory, "documents", "doc_id", "text"))
    return found.select(f"{ROW}.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
