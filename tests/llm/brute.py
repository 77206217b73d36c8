"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2 ** 63 - 1


def without_repeats(rows, length=50):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) for rows (doc_id, text)."""
    least = {}
    texts = [(LAST if k is None else k, k, (t or "").encode()) for k, t in rows]
    for order, _, data in texts:
        for i in range(len(data) - length + 1):
            piece = data[i:i + length]
            if order < least.get(piece, LAST + 1):
                least[piece] = order
    out = []
    for order, k, data in texts:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if least[data[i:i + length]] < order:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((k, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingle_set(text, words):
    found = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    if not found:
        return frozenset()
    return frozenset([tuple(found)] if len(found) < words else zip(*[found[i:] for i in range(words)]))


def groups(rows, words, percent):
    """(doc_id, set size, smallest id of the group) for rows (doc_id, text)."""
    sets = [shingle_set(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    seen = set()
    for members in holders.values():
        for x, i in enumerate(members):
            for j in members[:x]:
                if (j, i) not in seen:
                    seen.add((j, i))
                    shared = len(sets[i] & sets[j])
                    if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                        parent[root(i)] = root(j)
    least = defaultdict(lambda: LAST)
    for i, (k, _) in enumerate(rows):
        least[root(i)] = min(least[root(i)], LAST if k is None else k)
    return [(k, len(sets[i]), None if least[root(i)] == LAST else least[root(i)]) for i, (k, _) in enumerate(rows)]


def pieces(text, vocabulary, longest):
    """Words and greedy longest-match pieces, each word behind a space."""
    words, n = WORD.findall(text or ""), 0
    for word in words:
        data = b" " + word.encode()
        while data:
            size = next(s for s in range(min(longest, len(data)), 0, -1) if s == 1 or data[:s] in vocabulary)
            data, n = data[size:], n + 1
    return len(words), n


def slow_checksum(data):
    """The page checksum, bit by bit."""
    value = 0
    for byte in data:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ (0x04C11DB7 if value & 0x80000000 else 0)) & 0xFFFFFFFF
    return value


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text or "")
    lines, copies, seen = (text or "").split("\n"), 0, set()
    for line in lines:
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows, marked = [tuple(words[i:i + 3]) for i in range(len(words) - 2)], set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            marked |= {i, i + 1, i + 2}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, copies, len(marked)


def key(rows):
    """Rows in an order that takes nulls."""
    return sorted(map(tuple, rows), key=repr)
