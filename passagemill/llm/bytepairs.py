"""Byte-level BPE by backtracking over longest matches, and back to bytes."""

from __future__ import annotations

import base64
import sys
from array import array
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import tidy_batches
from .common import read

# Ids of this many different pieces are remembered, and compatible pairs of adjacent tokens; then the memory starts anew.
REMEMBERED = 1 << 18
REMEMBERED_PAIRS = 1 << 20
# Pieces of more characters are encoded each time.
LONG_PIECE = 64
# Pieces of a text that are held at a time; shorter texts are split in one call.
PIECES = 1 << 16
LONG_TEXT = 1 << 20
# Rows handed on at a time hold about this many ids, one row at least.
BATCH_IDS = 1 << 19


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ids, which are 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [ranks[i] for i in range(len(ranks))]


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts that merging leaves if the first of the pairs with the lowest rank is merged again and again, and the
    last merge to the whole of ``data`` is not made."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 2:
        best, at = min(((ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
        if best == sys.maxsize:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def split_table(tokens: list[bytes]) -> tuple[array, array]:
    """By id: the two tokens whose merge gives the token (itself twice for one byte). Tokens that merging never gives
    hold -1: only a whole piece can be one."""
    ranks = {token: i for i, token in enumerate(tokens)}
    left, right = array("i", range(len(tokens))), array("i", range(len(tokens)))
    for i, token in enumerate(tokens):
        if len(token) > 1:
            parts = merged(token, ranks)
            fits = len(parts) == 2 and all(p in ranks for p in parts)
            left[i], right[i] = (ranks[parts[0]], ranks[parts[1]]) if fits else (-1, -1)
    return left, right


class Encoder:
    """Ids of pieces, exactly as byte-pair merging in the order of ranks gives them, in linear time.

    A sequence of tokens is what merging gives if every two adjacent tokens are what merging gives for their joined
    bytes. So the longest token at each place is tried first, then its shorter prefixes, and a place that no
    compatible token leads on from is never tried again. Token bytes are Latin-1 strings to the automaton that finds
    the longest tokens.
    """

    def __init__(self, tokens: list[bytes], left: array, right: array):
        import ahocorasick

        self.left, self.right = left, right
        self.whole = {token.decode("latin-1"): i for i, token in enumerate(tokens)}
        self.size = [len(token) for token in tokens]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.merge = {(a, b): i for i, (a, b) in enumerate(zip(left, right)) if a >= 0 and len(tokens[i]) > 1}
        self.automaton = ahocorasick.Automaton()
        made = {}
        for i, token in enumerate(tokens):
            if left[i] >= 0:
                made[token] = i
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        # The longest shorter token that a token starts with.
        self.shorter = [next((made[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in made), -1)
                        for token in tokens]

    def compatible(self, first: int, second: int) -> bool:
        """Whether merging the two tokens' joined bytes gives these two tokens: going back through the merges, no
        pair across the border may have merged before the later of the two sides was made."""
        known = self.pairs.get((first, second))
        if known is not None:
            return known
        a, b, limit, fits = first, second, sys.maxsize, True
        while True:
            if self.merge.get((a, b), sys.maxsize) < limit:
                fits = False
                break
            # Undo the later merge; on the border's left the inner part is the right one, on its right the left one.
            # Of equal ranks the one further left was merged first.
            split_a, split_b = self.right[a], self.left[b]
            if a > b and split_a != a:
                a, limit = split_a, a
            elif split_b != b:
                b, limit = split_b, b + 1
            elif split_a != a:
                a, limit = split_a, a
            else:
                break
        if len(self.pairs) >= REMEMBERED_PAIRS:
            self.pairs.clear()
        self.pairs[first, second] = fits
        return fits

    def encode(self, piece: str) -> list[int]:
        """Ids of a piece whose bytes are given as Latin-1."""
        found = self.whole.get(piece)
        if found is not None:
            return [found]
        n, size, shorter, compatible = len(piece), self.size, self.shorter, self.compatible
        longest = [0] * n
        for end, token in self.automaton.iter(piece):
            longest[end + 1 - size[token]] = token  # later matches from one place are longer
        open_ = bytearray(b"\x01") * (n + 1)  # places that may still lead to the end
        ids: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            while True:
                end = place + size[token]
                if open_[end] and (not ids or compatible(ids[-1], token)):
                    ids.append(token)
                    place = end
                    if place < n:
                        token = longest[place]
                    break
                token = shorter[token]
                if token < 0:
                    # Nothing leads on from here: the token before must be a shorter one.
                    open_[place] = 0
                    token = ids.pop()
                    place -= size[token]
                    break
        return ids


class Splitter:
    """Pieces of a text, as tiktoken's own pattern engine splits it.

    The two engines know different versions of Unicode; texts with a character that they class differently are split
    by a pattern that lists the classes' characters.
    """

    def __init__(self, pattern: str, classes: dict[str, str], differing: str):
        import regex

        self.pattern, self.classes, self.differing = pattern, classes, set(differing)
        self.findall, self.finditer, self.listed = regex.compile(pattern).findall, regex.compile(pattern).finditer, None

    def _listed(self):
        import regex

        if self.listed is None:
            pattern = self.pattern
            for name, characters in self.classes.items():
                pattern = pattern.replace(name, "[" + _ranges(characters) + "]")
            self.listed = regex.compile("(?V1)" + pattern).finditer
        return self.listed

    def pieces(self, text: str):
        """Lists of pieces, one list for a short text."""
        plain = text.isascii() or self.differing.isdisjoint(text)
        if plain and len(text) <= LONG_TEXT:
            yield self.findall(text)
            return
        found = (self.finditer if plain else self._listed())(text)
        while several := [m.group() for m in islice(found, PIECES)]:
            yield several


def _ranges(characters: str) -> str:
    points, out = sorted(map(ord, characters)), []
    for point in points:
        if out and out[-1][1] == point - 1:
            out[-1][1] = point
        else:
            out.append([point, point])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _everything() -> str:
    return "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))


def pattern_classes(pattern: str) -> dict[str, str]:
    """The characters of each class ``\\p{..}`` of a pattern, as tiktoken's engine knows them."""
    import re

    import tiktoken

    everything, single = _everything(), {bytes([i]): i for i in range(256)}
    return {name: bytes(tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
                        .encode_ordinary(everything)).decode()
            for name in sorted(set(re.findall(r"\\p\{\w+\}", pattern)))}


def differing_characters(classes: dict[str, str]) -> str:
    """The characters that the worker's pattern engine puts into other classes."""
    import regex

    everything = _everything()
    return "".join(sorted(set().union(*[set(regex.findall(name, everything)) ^ set(characters)
                                        for name, characters in classes.items()])))


def encode_text(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row: ids of the whole text as little-endian unsigned 32-bit numbers, four bytes each.

    Each match of ``pattern`` is encoded for itself; characters that it matches nowhere have no ids. Rows are worked on
    where they are, nothing is shuffled. The rank file is read on the driver; its tokens and their splits, a few MB
    bounded by the vocabulary, travel with the job. A task holds one batch of rows, and of a text over a million
    characters 65,536 pieces at a time beside its ids.

    Null or empty text: no ids. Very long texts and pieces: whole, in linear time. Repeated rows: each. Null keys stay
    null. Empty input: no rows. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    tokens = load_ranks(ranks)
    left, right = split_table(tokens)
    classes = pattern_classes(pattern)
    differing = differing_characters(classes)

    def run(batches):
        encoder, splitter = Encoder(tokens, left, right), Splitter(pattern, classes, differing)
        known: dict[str, bytes] = {}
        recall = known.__getitem__

        def remember(pieces: list[str]) -> bytes:
            for piece in set(pieces).difference(known):
                known[piece] = array("I", encoder.encode(piece.encode().decode("latin-1"))).tobytes()
            joined = b"".join(map(recall, pieces))
            if len(known) > REMEMBERED:
                known.clear()
            for piece in [p for p in pieces if len(p) > LONG_PIECE]:
                known.pop(piece, None)
            return joined

        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            first, found, held = 0, [], 0
            for i in range(batch.num_rows):
                value = texts[i].as_py()
                ids = b"".join(map(remember, splitter.pieces(value))) if value else b""
                found.append(ids)
                held += len(ids) // 4
                if held >= BATCH_IDS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [keys.slice(first, len(found)), pa.array(found, pa.binary())], names=["key", "ids"])
                    first, found, held = i + 1, [], 0

    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise RuntimeError("ids are written as this machine's unsigned ints, which must be little-endian and four bytes")
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy_batches(run), f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode_ids(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, bytes) of every row: the joined bytes of its ids' tokens. Null or empty ids: no bytes. An id that the
    rank file does not hold is an error. Null keys stay null; repeated rows count each; empty input: no rows."""
    kind = encoded.schema[key].dataType.simpleString()
    tokens = load_ranks(ranks)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            found = [b"".join(map(tokens.__getitem__, memoryview(v.as_buffer()).cast("I"))) if v.is_valid and len(v.as_buffer())
                     else b"" for v in column]
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(found, pa.binary())],
                                             names=["key", "ids", "bytes"])

    rows = encoded.select(F.col(f"`{key}`").alias("key"), F.col(f"`{ids}`").alias("ids"))
    return rows.mapInArrow(tidy_batches(run), f"key {kind}, ids binary, bytes binary").withColumnRenamed("key", key)


def encoded_documents(spark, directory: str) -> DataFrame:
    """op13: number and digest of every document's ids, and the digest of what they decode to."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = encode_text(read(spark, directory, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN)
    back = decode_ids(encoded, ranks)
    return back.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
