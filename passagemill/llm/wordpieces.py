"""Token counts by a linear longest-match automaton over a vocabulary."""

from __future__ import annotations

import base64
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import distinct_words, slices, text_bytes, tidy_batches, word_spans
from .common import read

# Words up to this many bytes run through the automaton side by side, longer ones alone.
SIDE_BY_SIDE = 64
# Piece counts of about this many different words are remembered, long words aside; then the memory starts anew.
REMEMBERED = 1 << 18


def load_vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file: a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class PieceCounter:
    """Greedy longest-match piece counts in one pass over a word.

    A trie of the vocabulary; every node that is no token has a failure link to the node that remains after the
    longest-match pieces of its string are taken off, and the count of those pieces. A byte that has no edge follows
    the links and adds the counts; no piece is ever built and no byte is read twice. All bytes are made tokens, so
    every word has pieces. Edges are one sorted array of (node, byte), for lookups of many words at once.
    """

    def __init__(self, tokens: list[bytes]):
        children: list[dict[int, int]] = [{}]
        final = [False]
        for token in [bytes([b]) for b in range(256)] + [t for t in tokens if t]:
            node = 0
            for byte in token:
                found = children[node].get(byte)
                if found is None:
                    found = children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = found
            final[node] = True
        fail, popped = [0] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, child in children[node].items():
                if final[child]:
                    popped[child] = 1
                else:
                    rest, count = fail[node], popped[node]
                    while byte not in children[rest]:
                        count += popped[rest]
                        rest = fail[rest]
                    fail[child], popped[child] = children[rest][byte], count
                queue.append(child)
        edges = sorted((node << 8 | byte, child) for node, at in enumerate(children) for byte, child in at.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([c for _, c in edges], np.int32)
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)

    def _edge(self, nodes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = nodes.astype(np.int64) << 8 | data
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return self.keys[place] == key, self.targets[place]

    def _rest(self, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        while (open_ := np.flatnonzero(nodes)).size:
            counts[open_] += self.popped[nodes[open_]]
            nodes[open_] = self.fail[nodes[open_]]
        return counts

    def one(self, word: bytes) -> int:
        """Pieces of one long word."""
        edges = getattr(self, "_edges", None)
        if edges is None:
            edges = self._edges = dict(zip(self.keys.tolist(), self.targets.tolist()))
        fail, popped, node, count = self.fail, self.popped, 0, 0
        for byte in word:
            while (after := edges.get(node << 8 | byte)) is None:
                count += int(popped[node])
                node = int(fail[node])
            node = after
        while node:
            count += int(popped[node])
            node = int(fail[node])
        return count

    def many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of the words data[start:end], each behind one space."""
        sizes = ends - starts
        order = np.argsort(-sizes, kind="stable")
        counts = np.zeros(len(starts), np.int64)
        long = int(np.searchsorted(-sizes[order], -SIDE_BY_SIDE))
        for i in order[:long]:
            counts[i] = self.one(b" " + data[starts[i]:ends[i]].tobytes())
        order = order[long:]
        first, length = starts[order], sizes[order]
        nodes, sums = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
        for place in range(-1, int(length[0]) if len(order) else -1):
            active = int(np.searchsorted(-length, -place))  # words longer than place
            if place < 0:
                active = len(order)
            step = np.full(active, 32, np.int64) if place < 0 else data[first[:active] + place].astype(np.int64)
            todo = np.arange(active)
            while todo.size:
                found, target = self._edge(nodes[todo], step[todo])
                nodes[todo[found]] = target[found]
                todo = todo[~found]
                sums[todo] += self.popped[nodes[todo]]
                nodes[todo] = self.fail[nodes[todo]]
        counts[order] = self._rest(nodes, sums)
        return counts


def count_pieces(docs: DataFrame, tokens: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_pieces) of every row; a word is counted with one space before it.

    Rows are worked on where they are; nothing is shuffled. The automaton is built once on the driver and travels
    with the job, a few MB bounded by the vocabulary. Null or empty text, or white space only: 0 and 0. Words of
    any length and repeated rows count as they are; null keys stay null; other columns are not read.
    """
    counter = PieceCounter(tokens)
    kind = docs.schema[key].dataType

    def run(batches):
        known: dict[bytes, int] = {}
        for batch in batches:
            keys = batch.column(0)
            data, offsets = text_bytes(batch.column(1))
            for first, last in slices(offsets):
                low, high = offsets[first], offsets[last]
                part, places = data[low:high], offsets[first:last + 1] - low
                starts, ends, documents = word_spans(part, places)
                number, words = distinct_words(part, starts, ends)
                some = np.zeros(len(words), np.int64)
                some[number] = np.arange(len(number))  # one place of each word
                pieces = np.array([known.get(w, -1) for w in words], np.int64)
                new = np.flatnonzero(pieces < 0)
                pieces[new] = counter.many(part, starts[some[new]], ends[some[new]])
                if len(known) > REMEMBERED:
                    known.clear()
                known.update((words[i], int(pieces[i])) for i in new if len(words[i]) <= SIDE_BY_SIDE)
                n = last - first
                yield pa.RecordBatch.from_arrays([
                    keys.slice(first, n), pa.array(np.bincount(documents, minlength=n).astype(np.int64)),
                    pa.array(np.bincount(documents, weights=pieces[number], minlength=n).astype(np.int64))],
                    names=["key", "n_words", "n_pieces"])

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(tidy_batches(run), f"key {kind.simpleString()}, n_words long, n_pieces long").withColumnRenamed("key", key)


def counted_documents(spark, directory: str) -> DataFrame:
    """op8: words and greedy longest-match pieces of every document, over the byte vocabulary of 50,256 tokens."""
    import public_tokenizers


    tokens = load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return count_pieces(read(spark, directory, "documents", "doc_id", "text"), tokens)
