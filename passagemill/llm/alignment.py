"""Alignment of two tokenizers' tokens over the same bytes, and how often the corpus links two ids."""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .arrays import tidy_batches
from .blocks import BLOCK_BITS, pack_rows, rows_of, squeeze, unsqueeze, with_answers
from .common import discard, read, stored

# Texts that are tokenised at a time hold about this many characters, one text at least.
SLICE_CHARS = 1 << 19
# A block holds whole documents with about this many tokens of the first tokenizer.
BLOCK_TOKENS = 1 << 19
# White space in a row from which the tokenizer file itself is asked: tiktoken's stack ends at a million.
WHITE = 100_000
# Ids of this many different parts of texts are remembered, long ones aside; then the memory starts anew.
REMEMBERED = 1 << 18
LONG_PART = 64
_PART = re.compile(r" *[^ ]+| +")
_WHITE_RUN = re.compile(r"\s{%d}" % WHITE)


class BytePieces:
    """Ids of a byte-level tokenizer file, special tokens' strings being plain text, and the bytes of every id."""

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        self.vocabulary, self.whole = vocabulary, None
        # The printable characters that stand for the 256 bytes: printable Latin-1 itself, the rest from U+0100 on.
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in plain} | {
            chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        found = json.loads(vocabulary)
        added = {t["content"] for t in found["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in found["model"]["vocab"].items() if t not in added}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if len(text) >= WHITE and _WHITE_RUN.search(text):
            from tokenizers import Tokenizer

            if self.whole is None:
                self.whole = Tokenizer.from_str(self.vocabulary)
                self.whole.encode_special_tokens = True
            return self.whole.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class SentencePieces:
    """Ids of a sentencepiece model, which puts a space before a text, and the bytes of every id.

    No piece holds a space behind another character, so a text falls into independent parts, each of some spaces and
    what follows them up to the next; the ids of short parts are remembered. A model with other pieces is refused.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in piece.lstrip("▁") for piece in pieces):
            raise ValueError("a piece holds a space behind another character")
        self.tokens = [bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
                       for i, piece in enumerate(pieces)]
        self.known: dict[str, bytes] = {" ": array("I", [self.model.piece_to_id("▁")]).tobytes()}

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of a space and each text, as this machine's unsigned ints; None if their bytes differ from it."""
        parts = [_PART.findall(" " + text) for text in texts]
        new = list(set().union(*parts).difference(self.known))
        # The model puts the first space of a part there itself.
        for part, ids in zip(new, self.model.encode([part[1:] for part in new], num_threads=1)):
            same = b"".join(map(self.tokens.__getitem__, ids)) == part.encode()
            self.known[part] = array("I", ids).tobytes() if same else b""
        found = [list(map(self.known.__getitem__, some)) for some in parts]
        if len(self.known) > REMEMBERED:
            self.known = {" ": self.known[" "]}
        else:
            for part in new:
                if len(part) > LONG_PART:
                    del self.known[part]
        return [b"".join(some) if all(some) else None for some in found]


def _ranges(first: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [first, first + count), and the range that each is of."""
    owner = np.repeat(np.arange(len(first)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + first[owner], owner


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray,
                b_to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the two ascending arrays of byte ends where both end, for intervals of both that end together.

    Divide and conquer, all intervals side by side: the end of A nearest to an interval's middle that a bisect also
    finds in B cuts it, and both halves are cut again. It is looked for among ever more ends around the middle, twice
    as many each time. An interval without such an end is a leaf. Returned in ascending order, the intervals' own ends
    included.
    """
    cuts_a, cuts_b = [a_to - 1], [b_to - 1]
    while True:
        several = (a_to - a_from > 1) & (b_to - b_from > 1)
        a_from, a_to, b_from, b_to = a_from[several], a_to[several], b_from[several], b_to[several]
        if not len(a_from):
            break
        last = a_to - 2
        middle = (a_from + last) // 2
        cut_a = np.full(len(middle), -1)
        cut_b = np.full(len(middle), -1)
        todo, near, far = np.arange(len(middle)), 0, 0
        while todo.size:
            m = middle[todo]
            low, high = np.maximum(a_from[todo], m - far), np.minimum(last[todo], m + far)
            below, own = _ranges(low, np.maximum(m - near - low + 1, 0))
            if near:
                above, owner = _ranges(m + near, np.maximum(high - m - near + 1, 0))
                below, own = np.concatenate([below, above]), np.concatenate([own, owner])
            place = np.searchsorted(ends_b, ends_a[below])
            hit = ends_b[place] == ends_a[below]
            below, own, place = below[hit], own[hit], place[hit]
            nearest = np.lexsort((np.abs(below - m[own]), own))
            nearest = nearest[np.diff(own[nearest], prepend=-1) > 0]
            cut_a[todo[own[nearest]]], cut_b[todo[own[nearest]]] = below[nearest], place[nearest]
            more = (cut_a[todo] < 0) & ((m - far > a_from[todo]) | (m + far < last[todo]))
            todo, near, far = todo[more], far + 1, 2 * far + 2
        cut = np.flatnonzero(cut_a >= 0)
        x, y = cut_a[cut], cut_b[cut]
        cuts_a.append(x)
        cuts_b.append(y)
        a_from, a_to = np.concatenate([a_from[cut], x + 1]), np.concatenate([x + 1, a_to[cut]])
        b_from, b_to = np.concatenate([b_from[cut], y + 1]), np.concatenate([y + 1, b_to[cut]])
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def align(docs: DataFrame, vocabulary: str, pattern: str, model: str, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """(key, a_ids, b_ids, a_cuts, b_cuts) of every row: ids of a space and the whole text by the byte-level tokenizer
    file ``vocabulary`` (A, whose split pattern is ``pattern``) and of the text by the sentencepiece file ``model``
    (B), and how many tokens of each end at or before the end of each group. Little-endian unsigned 32-bit numbers.

    Groups lie between the byte offsets at which a token of A and one of B both end. Rows are worked on where they
    are; nothing is shuffled. Both files are read on the driver and travel with the job, a few MB bounded by the
    vocabularies. A task holds texts of about half a million characters, one text at least.

    Null or empty text, and text whose bytes either tokenizer changes: no tokens and no groups. Very long texts: whole,
    in n log n steps. Repeated rows: each. Null keys stay null. Empty input: no rows. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy_batches(_aligner(vocabulary, pattern, model)),
                           f"key {kind}, a_ids binary, b_ids binary, a_cuts binary, b_cuts binary"
                           ).withColumnRenamed("key", key)


def _aligner(vocabulary: str, pattern: str, model: str):
    """From batches of (key, text) to batches of (key, a_ids, b_ids, a_cuts, b_cuts)."""
    with open(vocabulary, encoding="utf-8") as file:
        a_file = file.read()
    with open(model, "rb") as file:
        b_file = file.read()

    def run(batches):
        a_pieces, b_pieces = BytePieces(a_file, pattern), SentencePieces(b_file)
        a_sizes, b_sizes = (np.array([len(t) for t in p.tokens], np.int64) for p in (a_pieces, b_pieces))
        none = np.zeros(0, np.uint32)

        def aligned(keys, texts: list[str]):
            sides = [], []
            for value, theirs in zip(texts, b_pieces.encode(texts)):
                ours = none if theirs is None or not value else np.array(a_pieces.encode(" " + value), np.uint32)
                # A drops characters at most, so as many bytes are the same bytes.
                fits = len(ours) and int(a_sizes[ours].sum()) == len(value.encode()) + 1
                sides[0].append(ours if fits else none)
                sides[1].append(np.frombuffer(theirs, np.uint32) if fits else none)
            ids = [np.concatenate(side) for side in sides]
            edges = [np.concatenate([[0], np.cumsum([len(one) for one in side])]) for side in sides]
            ends_a, ends_b = np.cumsum(a_sizes[ids[0]]), np.cumsum(b_sizes[ids[1]])
            used = np.flatnonzero(np.diff(edges[0]))
            cuts = shared_cuts(ends_a, ends_b, edges[0][used], edges[0][used + 1], edges[1][used], edges[1][used + 1])
            # As many groups in both; a group's document is that of its last token.
            document = np.searchsorted(edges[0], cuts[0], side="right") - 1
            cut_edges = np.searchsorted(document, np.arange(len(texts) + 1))
            out = []
            for values, at in ((ids[0], edges[0]), (ids[1], edges[1])) + tuple(
                    (c + 1 - e[document], cut_edges) for c, e in zip(cuts, edges)):
                values = np.ascontiguousarray(values, "<u4")
                out.append(pa.Array.from_buffers(pa.large_binary(), len(texts), [
                    None, pa.py_buffer(4 * at.astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary()))
            return pa.RecordBatch.from_arrays([keys, *out], names=["key", "a_ids", "b_ids", "a_cuts", "b_cuts"])

        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            first, texts, held = 0, [], 0
            for i in range(batch.num_rows):
                texts.append(column[i].as_py() or "")
                held += len(texts[-1])
                if held >= SLICE_CHARS or i + 1 == batch.num_rows:
                    yield aligned(keys.slice(first, len(texts)), texts)
                    first, texts, held = i + 1, [], 0

    return run


def _numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column, and len + 1 offsets."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, "<u4", count=int(offsets[-1]) // 4) if data is not None and offsets[-1] else np.zeros(0, "<u4")
    return values[offsets[0] // 4:], (offsets - offsets[0]) // 4


class GroupTexts:
    """Digests of documents' groups, written ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self):
        self.known: dict[str, np.ndarray] = {}

    def _words(self, ids: np.ndarray, ends: np.ndarray, end: str) -> np.ndarray:
        """The ids as text, each with the mark behind it."""
        most, marks = int(ids.max()) + 1, self.known.get(end)
        if marks is None or len(marks) < most:
            marks = self.known[end] = np.array([(f"{i},", f"{i}{end}") for i in range(most)], object)
        is_end = np.zeros(len(ids), np.int64)
        is_end[ends - 1] = 1
        return marks[ids, is_end]

    def digest(self, a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> str:
        """SHA-256 in hexadecimal; empty for a document without tokens."""
        if not len(a_ids):
            return ""
        out = np.empty(len(a_ids) + len(b_ids), object)
        a_cuts, b_cuts = a_cuts.astype(np.int64), b_cuts.astype(np.int64)
        a_sizes, b_sizes = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
        out[np.arange(len(a_ids)) + np.repeat(b_cuts - b_sizes, a_sizes)] = self._words(a_ids, a_cuts, "|")
        out[np.arange(len(b_ids)) + np.repeat(a_cuts, b_sizes)] = self._words(b_ids, b_cuts, ";")
        return hashlib.sha256("".join(out.tolist())[:-1].encode()).hexdigest()


def _blocks(docs: DataFrame, aligner, key: str, text: str) -> DataFrame:
    """(block, payload, links, pairs, counts): rows of (key, n_a, n_b, n_groups, n_links, groups_sha256), the place in
    ``pairs`` of every link in order, the block's different pairs of linked ids, and how often it links each."""
    def run(batches):
        number, texts = TaskContext.get().partitionId() << BLOCK_BITS, GroupTexts()
        for batch in batches:
            (a, a_at), (b, b_at), (x, x_at), (y, y_at) = (_numbers(batch.column(i)) for i in range(1, 5))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(a_at, a_at[first] + BLOCK_TOKENS, side="right")) - 1
                last = min(max(last, first + 1), batch.num_rows)
                digests = [texts.digest(a[a_at[i]:a_at[i + 1]], b[b_at[i]:b_at[i + 1]], x[x_at[i]:x_at[i + 1]],
                                        y[y_at[i]:y_at[i + 1]]) for i in range(first, last)]
                groups = np.diff(x_at[first:last + 1])
                # Two ids are linked where their tokens end together: the last ones of each group.
                link_a = a[np.repeat(a_at[first:last], groups) + x[x_at[first]:x_at[last]] - 1].astype(np.int64)
                link_b = b[np.repeat(b_at[first:last], groups) + y[y_at[first]:y_at[last]] - 1].astype(np.int64)
                pairs, place, counts = np.unique(link_a << 32 | link_b, return_inverse=True, return_counts=True)
                longs = pa.int64()
                rows = pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, last - first), pa.array(np.diff(a_at[first:last + 1]), longs),
                    pa.array(np.diff(b_at[first:last + 1]), longs), pa.array(groups, longs), pa.array(groups, longs),
                    pa.array(digests, pa.string())],
                    names=["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], longs), pa.array([pack_rows(rows)], pa.binary()),
                    pa.array([squeeze(place.astype(np.uint32))], pa.binary()),
                    pa.array([pairs], pa.list_(longs)), pa.array([counts], pa.list_(longs))],
                    names=["block", "payload", "links", "pairs", "counts"])
                number, first = number + 1, last

    # Aligned batches go straight on: between two steps Spark would gather them into batches ten times as big.
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    found = rows.mapInArrow(
        tidy_batches(lambda batches: run(aligner(batches))), "block long, payload binary, links binary, pairs array<long>, counts array<long>")
    return stored(found)


def count_links(docs: DataFrame, vocabulary: str, pattern: str, model: str, key: str = "doc_id",
                text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row, from the groups of ``align``.

    Two tokens are linked if they end together; an id pair's count is the number of links of all rows. ``n_best`` are
    the row's links whose count is the highest that their B id has, ``count_sum`` sums the counts over its links.
    Links are added up in a block of about half a million tokens before they move, so a pair that every document links
    costs one entry a block; counts come back to the blocks by a join on the pair, which Catalyst broadcasts if the
    stored size of the counts allows it. Rows without tokens: zeros and an empty digest. Nulls, long and odd texts: as
    ``align`` says. Empty input: no rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(docs, _aligner(vocabulary, pattern, model), key, text)
    totals = stored(blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count")))
    b_id = F.expr(f"pair & {(1 << 32) - 1}")
    highest = totals.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))
    known = stored(totals.withColumn("b", b_id).join(highest, "b").select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")))
    answers = blocks.select("block", F.posexplode("pairs").alias("slot", "pair")).join(known, "pair").select(
        F.col("block").alias("block"), "slot", "count", "best")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = rows_of(left.column("payload")[0].as_py())
        links = unsqueeze(left.column("links")[0].as_py(), np.uint32)
        slots = right.column("slot").to_numpy()
        count, best = np.zeros(len(slots), np.int64), np.zeros(len(slots), np.int64)
        count[slots], best[slots] = right.column("count").to_numpy(), right.column("best").to_numpy()
        edges = np.concatenate([[0], np.cumsum(rows.column("n_links").to_numpy())])
        sums = [np.concatenate([[0], np.cumsum(v[links])]) for v in (best, count)]
        found = [pa.array(s[edges[1:]] - s[edges[:-1]], pa.int64()) for s in sums]
        return rows.append_column("n_best", found[0]).append_column("count_sum", found[1]).select(names)

    names = ["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    counted = with_answers(blocks.select("block", "payload", "links"), answers, work,
                           f"key {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups_sha256 string")
    discard(totals)
    return counted.withColumnRenamed("key", key)


def aligned_documents(spark, directory: str) -> DataFrame:
    """op11: groups and links of every document."""
    import public_tokenizers

    docs = read(spark, directory, "documents", "doc_id", "text")
    return count_links(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                       public_tokenizers.path("piece_bpe_32k.model"))
