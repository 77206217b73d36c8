"""Order-preserving packing of documents into token sequences by dynamic programming."""

from __future__ import annotations

import base64
import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import table
from .arrays import tidy_batches

LENGTH = 1024
END = 0
# What a cut costs, in tokens of padding: at a document's end nothing, at a sentence's end a little, elsewhere more.
SENTENCE_COST = 4
BROKEN_COST = 16
# Tokens that are cut at a time inside a task. The window that is still open moves on to the next stretch.
STRETCH = 1 << 18
# Documents that are tokenised at a time.
DOCUMENTS = 64
# White space in a row from which the tokenizer file is asked: the pattern's look-ahead goes back over a run, and
# tiktoken's stack of such steps ends at a million.
WHITE = 100_000


def load_encoder(ranks: str, pattern: str, vocabulary: str):
    """Function from text to ids, and the bytes of every id. The ids are those of the tokenizer file ``vocabulary``;
    tiktoken finds the same ones sooner, but for texts with added tokens and with very long runs of white space."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    whole = None
    with open(vocabulary, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}

    def encode(text: str) -> list[int]:
        nonlocal whole
        if any(token in text for token in added) or (
                len(text) >= WHITE and any(m.end() - m.start() >= WHITE for m in re.finditer(r"\s+", text))):
            whole = whole or Tokenizer.from_file(vocabulary)
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode, table | {token.encode(): i for token, i in added.items()}


def sentence_ends(table: dict[bytes, int]) -> np.ndarray:
    """By id: whether a sentence may end behind the token."""
    found = np.zeros(max(table.values()) + 1, bool)
    for token, rank in table.items():
        found[rank] = token.endswith((b".", b"!", b"?", b"\n"))
    return found


def cut(ends: np.ndarray, costs: np.ndarray, length: int = LENGTH, final: bool = True) -> list[int]:
    """Indices of the chosen cuts among candidate positions ``ends`` (ascending, the last is the end of the stretch;
    none more than ``length`` behind the one before). If the stretch goes on, the last cut is the cheapest to reach
    among those that leave less than one window.

    best[j] = costs[j] + min over i with ends[j] - ends[i] <= length of best[i] + length - (ends[j] - ends[i]).
    The minimum of best[i] + ends[i] slides with j, so a monotone queue finds it: each candidate enters and leaves once.
    """
    best, back = [0.0] * (len(ends) + 1), [0] * (len(ends) + 1)
    places, prices = [0, *ends.tolist()], [0.0, *costs.tolist()]
    queue = deque([0])  # indices; best + place grows
    for j in range(1, len(places)):
        at = places[j]
        while at - places[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        back[j] = i
        best[j] = prices[j] + best[i] + places[i] + length - at
        key = best[j] + at
        while queue and best[queue[-1]] + places[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen, j = [], len(places) - 1
    if not final:
        j = min(range(int(np.searchsorted(ends, ends[-1] - length, side="right")) + 1, len(places)), key=best.__getitem__)
    while j:
        chosen.append(j - 1)
        j = back[j]
    return chosen[::-1]


def candidates(ids: np.ndarray, document_ends: np.ndarray, may_end: np.ndarray, length: int = LENGTH):
    """Positions where a window may end, and what a cut there costs: document ends, sentence ends, and inside a
    sentence a full window after the end of a document or sentence, and every full window of a longer sentence."""
    total = int(document_ends[-1])
    ends = np.union1d(np.flatnonzero(may_end[ids]) + 1, document_ends)
    full = ends[ends + length < total] + length
    starts = np.concatenate([[0], ends])
    gaps = np.diff(starts)
    wide = np.flatnonzero(gaps > length)
    inner = [np.arange(s + length, s + g, length) for s, g in zip(starts[wide], gaps[wide])]
    broken = np.setdiff1d(np.concatenate([[length] if length < total else [], full, *inner]).astype(np.int64), ends)
    costs = np.full(len(ends), float(SENTENCE_COST))
    costs[np.searchsorted(ends, document_ends)] = 0.0
    ends = np.concatenate([ends, broken])
    order = np.argsort(ends, kind="stable")
    return ends[order], np.concatenate([costs, np.full(len(broken), float(BROKEN_COST))])[order]


def pack(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text",
         length: int = LENGTH, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: (key, start, length, ids, doc_tokens, sequence_id, offset); ids are little-endian unsigned
    32-bit numbers.

    A document's tokens and one end mark follow those of the document before it, in the order of the input partition;
    each partition is cut into windows of up to ``length`` tokens that cost least in padding and broken sentences.
    Nothing is shuffled, and a task holds one stretch of about 262,144 tokens and the document it reads. The window
    that is open at the end of a stretch is cut anew with the next one. A sequence's number holds its partition's, so
    it is unique; a task that is run again makes the same if its input comes in the same order, as that of a file does.

    ``vocabulary`` is the tokenizer file of the rank file, by default the one of its name with the ending ``.json``.
    Its added tokens in a text are tokens.

    Null or empty text: the end mark alone. Very long texts: as many windows as needed. Repeated rows: packed each.
    Null keys stay null. Empty input: no rows. Other columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encode, table = load_encoder(ranks, pattern, vocabulary or ranks.removesuffix(".tiktoken") + ".json")
        may_end = sentence_ends(table)
        number = TaskContext.get().partitionId() << 36
        names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        key_type = pa.int64()
        pending: list[tuple] = []  # (key, whole tokens, start of the rest, ids of the rest)
        held = 0

        def windows(final: bool):
            """Cut what is pending; what is behind the last cut stays pending unless this is the end."""
            nonlocal number, pending, held
            ids = np.concatenate([p[3] for p in pending])
            sizes = np.array([len(p[3]) for p in pending])
            document_ends = np.cumsum(sizes)
            ends, costs = candidates(ids, document_ends, may_end, length)
            chosen = ends[cut(ends, costs, length, final)]
            last = int(chosen[-1])
            borders = np.union1d(np.concatenate([[0], chosen]), document_ends[document_ends < last])
            starts, stops = borders[:-1], borders[1:]
            owner = np.searchsorted(document_ends, starts, side="right")
            window = np.searchsorted(chosen, starts, side="right")
            opens = np.concatenate([[0], chosen])[window]
            first = document_ends - sizes
            raw = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array([pending[o][0] for o in owner], key_type),
                pa.array([pending[o][2] + int(s - first[o]) for o, s in zip(owner, starts)], pa.int64()),
                pa.array(stops - starts, pa.int64()),
                pa.array([raw[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
                pa.array([pending[o][1] for o in owner], pa.int64()),
                pa.array(number + window, pa.int64()),
                pa.array(starts - opens, pa.int64())], names=names)
            number += len(chosen)
            rest = []
            for i in range(int(np.searchsorted(document_ends, last, side="right")), len(pending)):
                k, whole, begun, tokens = pending[i]
                skip = max(0, last - int(first[i]))
                rest.append((k, whole, begun + skip, tokens[skip:]))
            pending, held = rest, len(ids) - last

        for batch in batches:
            key_type = batch.column(0).type
            for at in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(at, DOCUMENTS)
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    tokens = np.array([*encode(t or ""), END], np.int64)
                    pending.append((k, len(tokens), 0, tokens))
                    held += len(tokens)
                    if held >= STRETCH:
                        yield from windows(False)
        if pending:
            yield from windows(True)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        tidy_batches(run), f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    ).withColumnRenamed("key", key)


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of all documents with a digest of their ids."""
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def packed_documents(spark, directory: str) -> DataFrame:
    """op5: the pieces of every document, in the order of the files: a narrow input is read as it is."""
    return packed(table(spark, directory, "documents").select("doc_id", "text"))
