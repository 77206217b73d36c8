"""What two blocks of rows share, counted side by side in one task.

Operators that compare all rows with all put blocks of rows together by a shuffle; a block has a fixed size, so a task
holds no more than two of them, and pairs that lead to nothing never leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Matches and counters that are held at once.
AT_ONCE = 2_000_000


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of lists without nulls, and where each list starts (and the last one ends)."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    ends = np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64))
    return whole.flatten(), np.concatenate([[0], ends])


def ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the given ranges one after another, and the range that each is of."""
    sizes = np.maximum(ends - starts, 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner], owner


def slices(costs: np.ndarray, most: float) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring items whose costs add up to no more than ``most``, or one item."""
    total, start = np.cumsum(costs), 0
    while start < len(costs):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + most, side="right")))
        yield start, end
        start = end


def close_sets(table: pa.Table, threshold: float) -> pa.Table:
    """Pairs of sets of unlike roots, one of each side, that may reach a Jaccard similarity, with their sizes and the
    number of shared terms: (a, b, n_a, n_b, both); input (side, id, root, n, terms), terms rarest first and without
    those of one set only. With one side all pairs of it.

    Sets share a term of their prefixes; what they share behind the first of the two prefixes' ends is at most what that
    set has there. Only pairs whose shared prefix terms leave enough are compared.
    """
    side, n = table["side"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    roots = pc.unique(table["root"])
    root = pc.index_in(table["root"], roots).to_numpy().astype(np.int64)
    terms, at = lists(table["terms"])
    _, term = np.unique(terms.to_numpy(zero_copy_only=False), return_inverse=True)
    sizes = np.diff(at)
    reach = np.ceil(threshold * n - 1e-9).astype(np.int64)
    keep = np.clip(n - reach + 1 - (n - sizes), 0, sizes)
    # Where a prefix ends in the order of all terms; without shared terms in it, nothing is met.
    last = np.where(keep > 0, term[np.minimum(at[:-1] + np.maximum(keep - 1, 0), max(len(term) - 1, 0))] if len(term) else 0, -1)
    one_side = not (side == 1).any()
    left = np.flatnonzero(side == 0)
    right = left if one_side else np.flatnonzero(side == 1)
    place, owner = ranges(at[right], at[right] + keep[right])
    key = term[place] * len(roots) + root[right[owner]]
    order = np.argsort(key, kind="stable")
    key, met = key[order], owner[order]
    place, owner = ranges(at[left], at[left] + keep[left])
    own = root[left[owner]]
    start = term[place] * len(roots)
    # Rows of the same term before and behind those of the own root.
    bounds = [np.searchsorted(key, k, how) for k, how in (
        (start, "left"), (start + own, "left"), (start + own, "right"), (start + len(roots), "left"))]
    matches = np.bincount(owner, (bounds[1] - bounds[0]) + (bounds[3] - bounds[2]), len(left))
    entry = np.searchsorted(owner, np.arange(len(left) + 1))
    out = []
    for first, end in slices(np.maximum(matches, len(right)), AT_ONCE):
        here = slice(entry[first], entry[end])
        before, before_of = ranges(bounds[0][here], bounds[1][here])
        behind, behind_of = ranges(bounds[2][here], bounds[3][here])
        of = owner[here][np.concatenate([before_of, behind_of])] - first
        pair = of * len(right) + met[np.concatenate([before, behind])]
        if one_side:
            pair = pair[pair // len(right) + first < pair % len(right)]
        hits = np.bincount(pair) if len(pair) else np.zeros(0, np.int64)
        pair = np.flatnonzero(hits)
        a, b = left[pair // len(right) + first], right[pair % len(right)]
        need = threshold / (1 + threshold) * (n[a] + n[b]) - 1e-6
        rest = np.where(last[a] <= last[b], reach[a] - 1, reach[b] - 1)
        may = (n[a] >= n[b] * threshold - 1e-9) & (n[b] >= n[a] * threshold - 1e-9) & (hits[pair] + rest >= need)
        a, b, need = a[may], b[may], need[may]
        for x, y in slices(sizes[a] + sizes[b], AT_ONCE):
            values = []
            for of_side in (a[x:y], b[x:y]):
                place, of = ranges(at[of_side], at[of_side + 1])
                values.append(of * (len(term) + 1) + term[place])
            values = np.sort(np.concatenate(values))
            both = np.bincount(values[1:][values[1:] == values[:-1]] // (len(term) + 1), minlength=y - x)
            good = both >= need[x:y]
            out.append((a[x:y][good], b[x:y][good], both[good]))
    a, b, both = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    ids = table["id"]
    return pa.table([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(n[a], pa.int32()), pa.array(n[b], pa.int32()),
                     pa.array(both, pa.int32())], names=["a", "b", "n_a", "n_b", "both"])


def numbers(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """Equal values of the columns as equal numbers; null is a value."""
    whole = pa.concat_arrays([chunk for column in columns for chunk in column.chunks])
    found = whole.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return np.split(found, np.cumsum([len(column) for column in columns])[:-1])


def _rows_alike(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of all rows that are alike in these numbers, and the number of each row's kind in the order of those."""
    _, first, kind = np.unique(np.stack(columns, 1), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return first[order], place[kind.reshape(-1)]


# Classes of passages.
CLASSES = 32
# Bytes of the table of frequent terms and passages of a tile.
DENSE_BYTES = 96 * 1024 * 1024
# A term in fewer than one of so many passages of a tile is not in that table.
SPARSE = 200
# What a piece has besides the lists of its passages' columns.
PIECE = "names array<string>, sizes binary, codes binary, counts binary, width int, part int, seq int"
_TOLD = ["doc_id", "chunk_no", "n_chars", "entry_len", "class"]
_TIES = [("n_chars", "descending"), ("doc_id", "ascending"), ("chunk_no", "ascending")]
_WIDTHS = {1: np.uint8, 2: np.uint16, 8: np.float64}


def _piece(rows: list[pa.RecordBatch], part: int, seq: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(rows)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    whole = lambda name: pa.concat_arrays(table[name].chunks)
    values, at = lists(table["keys"])
    known = values.dictionary_encode("encode")
    weights = lists(table["weights"])[0].to_numpy(zero_copy_only=False)
    width = next(n for n, kind in _WIDTHS.items() if (weights.astype(kind) == weights).all())
    held = lambda array: pa.array([array.tobytes()], pa.binary())
    return pa.record_batch({
        **{name: one(whole(name)) for name in (*_TOLD, "norm")}, "names": one(known.dictionary),
        "sizes": held(np.diff(at).astype(np.int32)),
        "codes": held(known.indices.to_numpy().astype(np.uint16 if len(known.dictionary) <= 65536 else np.int32)),
        "counts": held(weights.astype(_WIDTHS[width])), "width": pa.array([width], pa.int32()),
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32())})


def pieces(batches: Iterator[pa.RecordBatch], part: int, most_keys: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """Passages (doc_id, chunk_no, n_chars, entry_len, class, norm, keys, weights) as rows of many each: their columns as
    lists, every key once, and the numbers and weights of keys as bytes. A piece has up to so many keys and rows, or one row."""
    waiting, keys, rows, seq = [], 0, 0, 0
    for batch in batches:
        total = np.cumsum(pc.list_value_length(batch["keys"]).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(total):
            before = total[start - 1] if start else 0
            end = min(int(np.searchsorted(total, before + most_keys - keys, side="right")), start + most_rows - rows)
            if end <= start and waiting:
                yield _piece(waiting, part, seq)
                waiting, keys, rows, seq = [], 0, 0, seq + 1
                continue
            end = max(end, start + 1)
            waiting.append(batch.slice(start, end - start))
            keys, rows, start = keys + int(total[end - 1] - before), rows + end - start, end
    if waiting:
        yield _piece(waiting, part, seq)


def _is_term(names: pa.Array) -> np.ndarray:
    return pc.starts_with(names, "t").to_numpy(zero_copy_only=False)


class Tile:
    """Passages of some pieces, the shortest entries first, and which of the given keys they have how often.

    Rows of equal columns are one passage with the keys of all. Frequent keys among the ``plain`` ones are rows of a table.
    """

    def __init__(self, rows: pa.Table, names: pa.Array, plain: np.ndarray, repeats: int):
        columns = {name: pa.chunked_array([lists(rows[name])[0]]) for name in (*_TOLD, "norm")}
        told, first_name = lists(rows["names"])
        read = lambda name, kinds: [np.frombuffer(value, kind) for value, kind in zip(rows[name].to_pylist(), kinds)]
        sizes = np.concatenate(read("sizes", [np.int32] * len(rows)))
        counts = np.concatenate(read("counts", [_WIDTHS[width] for width in rows["width"].to_pylist()]))
        narrow = [np.uint16 if n <= 65536 else np.int32 for n in np.diff(first_name)]
        code = np.concatenate([codes + at for codes, at in zip(read("codes", narrow), first_name)])
        code = pc.fill_null(pc.index_in(told, names), -1).to_numpy()[code]
        norm = columns.pop("norm").to_numpy()
        norm = np.where(norm > 0, norm, 1.0)
        first, kind = _rows_alike(*(numbers(column)[0] for column in columns.values()))
        self.n, self.columns = len(first), pa.table(columns).take(pa.array(first))
        lengths = pc.fill_null(self.columns["entry_len"], 2 ** 31 - 1).to_numpy()
        order = np.argsort(lengths, kind="stable")
        self.columns, self.lengths = self.columns.take(pa.array(order)), lengths[order]
        self.classes = pc.fill_null(self.columns["class"], 0).to_numpy()
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        place, self.norm = place[kind], np.ones(self.n)
        self.norm[place] = norm
        of = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
        counts, code = counts[code >= 0], code[code >= 0].astype(np.int64)
        if (self.norm[place] != norm).any():
            # Alike but for their norms: what each adds is weighed first.
            counts = np.where(_is_term(names)[code], counts / norm[of], counts)
            self.norm[:] = 1.0
        pair = code * self.n + place[of]
        if counts.dtype.kind == "u" and len(names) * self.n < 2 ** 47:
            # Sorted as one number each.
            both = np.sort(pair << 16 | counts)
            pair, counts = both >> 16, (both & 0xFFFF).astype(counts.dtype)
        else:
            order = np.argsort(pair, kind="stable")
            pair, counts = pair[order], counts[order]
        head = np.flatnonzero(np.diff(pair, prepend=-1))
        if len(head) < len(pair):
            pair, counts = pair[head], np.add.reduceat(counts.astype(float), head)
        self.pair, self.posting, self.counts = pair, (pair % self.n).astype(np.int32), counts
        self.start = np.searchsorted(pair, np.arange(len(names) + 1) * self.n)
        # Sums of whole counts fit these numbers, a key coming up to ``repeats`` times.
        self.whole = counts.dtype.kind == "u" or bool((counts == np.floor(counts)).all())
        most = float(np.bincount(self.posting, counts, 1).max()) * repeats
        self.kind = next((kind for kind in (np.uint8, np.uint16, np.uint32) if self.whole and most <= np.iinfo(kind).max), np.float64)
        size = np.diff(self.start)
        frequent = np.flatnonzero((size * SPARSE >= self.n) & plain)
        fit = DENSE_BYTES // (self.n * np.dtype(self.kind).itemsize)
        frequent = frequent[np.argsort(-size[frequent], kind="stable")[:fit]]
        self.dense, self.row = np.zeros((len(frequent), self.n), self.kind), np.full(len(names), -1)
        self.row[frequent] = np.arange(len(frequent))
        at, of = ranges(self.start[frequent], self.start[frequent + 1])
        self.dense[of, self.posting[at]] = self.counts[at]
        self.scale = None if (self.norm == 1).all() else (1 / self.norm).astype(np.float32)

    def postings(self, key: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of the first ``n`` passages have a key, and how often."""
        own = slice(self.start[key], self.start[key + 1])
        posting, counts = self.posting[own], self.counts[own]
        if n < self.n:
            # Postings go up with the passages.
            end = np.searchsorted(posting, n)
            return posting[:end], counts[:end]
        return posting, counts

    def how_often(self, keys: np.ndarray, passages: np.ndarray) -> np.ndarray:
        """How often passages have keys, a row a key."""
        row = self.row[keys]
        found = np.zeros((len(keys), len(passages)))
        found[row >= 0] = self.dense[row[row >= 0][:, None], passages[None, :]]
        sparse = np.flatnonzero(row < 0)
        if len(sparse):
            pair = keys[sparse][:, None] * self.n + passages[None, :]
            at = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            found[sparse] = np.where(self.pair[at] == pair, self.counts[at], 0)
        return found

    def places(self, marks: pa.Table | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Each passage's place in the order that parts equal scores; for marks, how many come no later."""
        ties = self.columns.select([name for name, _ in _TIES])
        if marks is not None:
            ties = pa.concat_tables([ties, marks.rename_columns(ties.column_names).cast(ties.schema)])
        ties = ties.append_column("after", pa.array(np.arange(len(ties)) >= self.n))
        order = pc.sort_indices(ties, [*_TIES, ("after", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
        own = order < self.n
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(own) - own
        return place[:self.n], place[self.n:]


def _tiles(rows: pa.Table, most_keys: int, most_rows: int) -> Iterator[pa.Table]:
    """Pieces put together, up to so many keys and rows."""
    keys = pc.binary_length(rows["counts"]).to_numpy() / rows["width"].to_numpy()
    for start, end in slices(np.maximum(keys / most_keys, pc.binary_length(rows["sizes"]).to_numpy() / (4 * most_rows)), 1.0):
        yield rows.slice(start, end - start)


def best_pairs(asked: pa.Table, told: pa.Table, score, bits: np.ndarray, k: int, most_keys: int, most_rows: int) -> pa.Table:
    """The ``k`` best of all pairs of a query and a passage that share a key: (query row, passage columns, score), and what
    else ties with the last one.

    asked (query_id, intents, keys, weights, room, floor, last_score, last_chars, last_doc, last_chunk): only passages of
    an entry length up to ``room``, of a score from ``floor`` on, and behind the last one in rank order count, where these
    are given. told: pieces of passages. ``score`` makes scores of the summed products of weights, the kinds of keys
    among them, the intents and the classes; ``bits`` has the kinds by the first letters of keys. Rows of equal columns
    are one with the keys of all.

    Passages come a tile at a time. A tile's frequent terms are the rows of a table of counts; a query adds up its rows, so
    a pair costs a byte or two a term, and only passages that may be among the best by that sum are scored.
    """
    query, asked_of = _rows_alike(numbers(asked["query_id"])[0], asked["intents"].to_numpy().astype(np.int64))
    plain = lambda name, none: pc.fill_null(asked[name], none).to_numpy()[query]
    intents, room, floor, last = (plain(*c) for c in (
        ("intents", 0), ("room", 2 ** 31 - 1), ("floor", -1.0), ("last_score", float("inf"))))
    floor, after = floor.copy(), bool(np.isfinite(last).any())
    marks = asked.select(["last_chars", "last_doc", "last_chunk"]).take(pa.array(query)) if after else None
    keys, at = lists(asked["keys"])
    known = keys.dictionary_encode("encode")
    names, code = known.dictionary, known.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = pc.index_in(pc.utf8_slice_codeunits(names, 0, 1), pa.array(list("tnefp"), names.type))
    kinds, terms = bits[first.to_numpy(zero_copy_only=False).astype(np.int64)], _is_term(names)
    weight, owner = lists(asked["weights"])[0].to_numpy(zero_copy_only=False), asked_of[ranges(at[:-1], at[1:])[1]]
    # Terms first, those of one weight together.
    order = np.lexsort((weight, ~terms[code], owner))
    code, weight, owner = code[order], weight[order], owner[order]
    entry = np.searchsorted(owner, np.arange(len(query) + 1))
    _, repeats = np.unique(owner * len(names) + code, return_counts=True)
    every = np.arange(CLASSES)
    bonus = {i: score(np.zeros(CLASSES), np.zeros(CLASSES, np.int64), i, every) for i in set(intents.tolist())}
    # What the kinds of shared keys add in each class.
    all_kinds = np.arange(int(kinds.max(initial=0)) * 2 or 1)
    extra = (score(np.full((len(all_kinds), CLASSES), 100.0), all_kinds[:, None], 0, every[None, :])
             - score(np.full((1, CLASSES), 100.0), np.zeros((1, 1), np.int64), 0, every[None, :])).astype(np.float32)
    # Classes whose passages score nothing, whatever they share.
    dead = score(np.full(CLASSES, 1e6), np.zeros(CLASSES, np.int64), 0, every) == 0
    best, columns, rows = [[] for _ in query], [], 0
    for part in _tiles(told, most_keys, most_rows):
        tile = Tile(part, names, kinds == 0, int(repeats.max(initial=0)))
        place, upto = tile.places(marks)
        hits, bare = tile.start[code + 1] > tile.start[code], np.flatnonzero(dead[tile.classes])
        of_class = {i: values[tile.classes].astype(np.float32) for i, values in bonus.items()}
        longest = np.searchsorted(tile.lengths, room, side="right")
        for q in range(len(query)):
            own = np.arange(entry[q], entry[q + 1])[hits[entry[q]:entry[q + 1]]]
            if not longest[q] or not len(own):
                continue
            behind = (last[q], place, upto[q]) if after and np.isfinite(last[q]) else None
            found, scores = _best_of(
                tile, code[own], weight[own], terms, kinds, extra, int(longest[q]), bare, of_class[intents[q]], float(bonus[intents[q]].max()),
                lambda shared, kind, classes: score(shared, kind, intents[q], classes), k, floor[q], behind)
            if len(found) > k:
                order = np.lexsort((place[found], -scores))[:k]
                found, scores = found[order], scores[order]
            if len(found) == k:
                floor[q] = max(floor[q], scores.min())
            if len(found):
                best[q].append((found + rows, scores))
        columns.append(tile.columns)
        rows += tile.n
    listed = []
    for q, parts in enumerate(best):
        if parts:
            found, scores = (np.concatenate(values) for values in zip(*parts))
            kept = scores >= floor[q]
            listed.append((np.full(int(kept.sum()), query[q]), found[kept], scores[kept]))
    q, p, scores = (np.concatenate(values) for values in zip(*listed)) if listed else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    asked = asked.select(["query_id", "intents"]).take(pa.array(q))
    told = pa.concat_tables(columns).take(pa.array(p))
    return pa.table([asked["query_id"], *(told[c] for c in _TOLD), asked["intents"], pa.array(scores)],
                    names=["query_id", *_TOLD, "intents", "score"])


def _places(marked: np.ndarray) -> np.ndarray:
    """Where an array of truth values, few of them true, is true: first by words of eight."""
    whole = len(marked) // 8 * 8
    word = np.flatnonzero(marked[:whole].view(np.uint64))
    place = (word[:, None] * 8 + np.arange(8)).reshape(-1)
    return np.concatenate([place[marked[place]], np.arange(whole, len(marked))[marked[whole:]]])


def _best_of(tile: Tile, code: np.ndarray, weight: np.ndarray, terms: np.ndarray, kinds: np.ndarray, extra: np.ndarray, n: int, bare: np.ndarray,
             of_class: np.ndarray, most_bonus: float, score, k: int, floor: float,
             behind: tuple[float, np.ndarray, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Passages among the first ``n`` of a tile that share one of the keys and may be among the ``k`` best, and their scores.

    First sums of short numbers, then the scores of those whose sums come near the k-th largest.
    """
    is_term = terms[code]
    # Whole counts that all weigh one are added up without loss.
    exact = tile.whole and tile.scale is None and bool((weight[is_term] == 1).all())
    kind_of_sum = np.float64 if exact and behind else np.float32
    sums = np.zeros(n, kind_of_sum)

    def add(chosen: np.ndarray) -> None:
        group, held = None, None
        for key, value in zip(code[chosen].tolist(), weight[chosen].tolist()):
            if value != held:
                if group is not None:
                    np.add(sums, group if held == 1 else group * kind_of_sum(held), out=sums)
                group, held = np.zeros(n, tile.kind), value
            row = tile.row[key]
            if row >= 0:
                np.add(group, tile.dense[row, :n], out=group)
            else:
                posting, counts = tile.postings(key, n)
                group[posting] += counts.astype(tile.kind, copy=False)
        if group is not None:
            np.add(sums, group if held == 1 else group * kind_of_sum(held), out=sums)

    add(is_term)
    if tile.scale is not None:
        sums *= tile.scale[:n]
    simple = kinds[code] == 0
    add(~is_term & simple)
    kind, special = np.zeros(0 if simple.all() else n, np.uint8), []
    for key, value in zip(code[~simple].tolist(), weight[~simple].tolist()):
        posting, counts = tile.postings(key, n)
        sums[posting] += (value * counts).astype(kind_of_sum)
        kind[posting] |= np.uint8(kinds[key])
        special.append(posting)
    kind_at = lambda at: kind[at].astype(np.int64) if len(kind) else np.zeros(len(at), np.int64)
    classes = tile.classes[:n]
    if exact and behind:
        shares, slack = score(sums, kind_at(np.arange(n)), classes), 1e-9
    else:
        shares = sums + of_class[:n]
        if special:
            special = np.concatenate(special)
            shares[special] = sums[special] + of_class[special] + extra[kind[special], classes[special]]
        if len(bare):
            shares[bare[bare < n]] = 0
        # More than what short numbers lose.
        slack = (len(code) + 16) * 2.0 ** -22 * (float(shares.max()) + 4)
    exactly = lambda at: score((weight[:, None] * np.where(
        is_term[:, None], (often := tile.how_often(code, at)) / tile.norm[at], often)).sum(axis=0), kind_at(at), classes[at])
    if behind:
        last, place, upto = behind
        if not (exact and behind):
            near = np.flatnonzero(np.abs(shares - last) <= slack)
            shares[near] = -1.0
            values = exactly(near)
            kept = (values < last) | (values == last) & (place[near] >= upto)
            shares[near[kept]] = values[kept]
            shares[shares > last + slack] = -1.0
        else:
            shares[(shares > last) | (shares == last) & (place[:n] < upto)] = -1.0
    least = floor - slack
    width = n // max(4 * k, 64)
    if width > 1:
        # The k-th largest of the maxima of groups is no more than the k-th largest of all.
        maxima = shares[:n // width * width].reshape(width, -1).max(axis=0)
        bound = float(np.partition(maxima, len(maxima) - k)[len(maxima) - k]) - 2 * slack
        if bound > most_bonus + slack:
            least = max(least, bound)
    if least > most_bonus + slack:
        found = _places(shares >= least)
    else:
        found = _places((sums > 0) & (shares >= least))
    if not len(found):
        return found, np.zeros(0)
    if exact and is_term.all():
        scores = score(sums[found].astype(float), kind_at(found), classes[found])
    else:
        scores = exactly(found)
    kept = (scores >= floor) & (shares[found] >= 0)
    return found[kept], scores[kept]
