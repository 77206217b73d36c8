"""Alignment of two tokenizers against plain code."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from passagemill.llm import alignment
from passagemill.session import table

FILES = [public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[2])


def plain_tokens(libraries, text):
    """Lists of (id, end) of both tokenizers; nothing where a tokenizer changes the bytes."""
    a, b = libraries
    if not text:
        return [], []
    found = a.encode(" " + text, add_special_tokens=False)
    stands = {}
    for i in range(256):
        stands[alphabet(i)] = i
    sides = [[(i, bytes(stands[c] for c in a.id_to_token(i))) for i in found.ids]]
    pieces = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        pieces.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    sides.append(pieces)
    whole, out = b" " + text.encode(), []
    for side in sides:
        if b"".join(t for _, t in side) != whole:
            return [], []
        ends, at = [], 0
        for i, token in side:
            at += len(token)
            ends.append((i, at))
        out.append(ends)
    return out


def alphabet(byte):
    """The printable character of a byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return chr(byte) if byte in shown else chr(256 + [b for b in range(256) if b not in shown].index(byte))


def plain_rows(libraries, rows):
    counts, kept = Counter(), []
    for key, text in rows:
        a, b = plain_tokens(libraries, text)
        ends_b = {e: i for i, e in b}
        links = [(i, ends_b[e]) for i, e in a if e in ends_b]
        counts.update(links)
        cuts = sorted({e for _, e in a} & set(ends_b))
        groups = [(",".join(str(i) for i, e in a if low < e <= high), ",".join(str(i) for i, e in b if low < e <= high))
                  for low, high in zip([0, *cuts], cuts)] if len(a) < 3000 else None
        kept.append((key, a, b, links, groups, len(cuts)))
    highest = Counter()
    for (_, b), c in counts.items():
        highest[b] = max(highest[b], c)
    return [(key, len(a), len(b), n, len(links), sum(counts[x] == highest[x[1]] for x in links),
             sum(counts[x] for x in links),
             None if groups is None else hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if groups else "")
            for key, a, b, links, groups, n in kept]


def comparable(rows, plain):
    skip = {(p[0], p[1], p[2]) for p in plain if p[-1] is None}
    strip = lambda r: tuple(r)[:-1] + (None if tuple(r)[:3] in skip else r[-1],)
    return sorted(map(strip, rows), key=str), sorted(map(tuple, plain), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=25), st.lists(st.integers(1, 4), min_size=1, max_size=25)),
                min_size=1, max_size=5))
def test_cuts_are_all_shared_ends(documents):
    # Both sides of a document are stretched to the same length by their last token.
    a, b, edges_a, edges_b = [], [], [0], [0]
    for x, y in documents:
        total = max(sum(x), sum(y))
        a += x[:-1] + [x[-1] + total - sum(x)]
        b += y[:-1] + [y[-1] + total - sum(y)]
        edges_a.append(len(a))
        edges_b.append(len(b))
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    _, want_a, want_b = np.intersect1d(ends_a, ends_b, return_indices=True)
    got = alignment.shared_cuts(ends_a, ends_b, *map(np.array, (edges_a[:-1], edges_a[1:], edges_b[:-1], edges_b[1:])))
    assert got[0].tolist() == want_a.tolist() and got[1].tolist() == want_b.tolist()


def test_a_long_interval_without_cuts_is_one_leaf():
    n = 200_000
    ends_a, ends_b = np.append(np.arange(1, n) * 2, 2 * n + 3), np.append(np.arange(1, n) * 2 + 1, 2 * n + 3)
    one = lambda v: np.array([v])
    got = alignment.shared_cuts(ends_a, ends_b, one(0), one(n), one(0), one(n))
    assert got[0].tolist() == got[1].tolist() == [n - 1]


TEXTS = ["", None, "one two", "a  b\t\n c", "<|endoftext|> <s> </s> <0x41>", "has ▁ inside", "é\U0001F600 日本 ½ x\r\n", "a\x00b",
         " lead and trail  ", "­ 　 wide", "one two", "Unbelievably tokenised internationalisation 12345!!!"]


def test_rows_against_plain_code(spark, odd, nothing, libraries, monkeypatch):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "one two")], "doc_id long, text string")
    for df in (texts.repartition(3), odd, nothing, table(spark, "/root/testdata/sf0.001", "documents")):
        rows = alignment.count_links(df, *FILES).collect()
        assert len(rows) == df.count()
        got, want = comparable(rows, plain_rows(libraries, df.select("doc_id", "text").collect()))
        assert got == want


def test_blocks_do_not_change_rows(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_TOKENS", 300)
    monkeypatch.setattr(alignment, "SLICE_CHARS", 2000)
    df = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    got, want = comparable(alignment.count_links(df, *FILES).collect(),
                           plain_rows(libraries, df.select("doc_id", "text").collect()))
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("  ab the\n\t<0x41>▁é😀日　"), st.characters(codec="utf-8")), min_size=1, max_size=50))
def test_parts_of_a_text_are_independent(pieces, libraries, text):
    ids = libraries[1].encode(text)
    same = b"".join(map(pieces.tokens.__getitem__, ids)) == b" " + text.encode()
    assert pieces.encode([text, text + " x"])[0] == (np.array(ids, "<u4").tobytes() if same else None)


@pytest.fixture(scope="module")
def pieces():
    with open(FILES[2], "rb") as file:
        return alignment.SentencePieces(file.read())


def test_groups_hold_every_token(spark, odd):
    for r in alignment.align(odd, *FILES).collect():
        ids, cuts = ([np.frombuffer(r[c], "<u4") for c in names] for names in (("a_ids", "b_ids"), ("a_cuts", "b_cuts")))
        assert len(cuts[0]) == len(cuts[1])
        for one, cut in zip(ids, cuts):
            assert (cut[-1] if len(cut) else 0) == len(one) and (np.diff(cut.astype(int)) > 0).all()


def test_very_long_white_space_asks_the_tokenizer_file(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WHITE", 10)
    monkeypatch.setattr(alignment, "_WHITE_RUN", alignment.re.compile(r"\s{10}"))
    with open(FILES[0], encoding="utf-8") as file:
        pieces = alignment.BytePieces(file.read(), FILES[1])
    for text in ("a" + " " * 30 + "<|endoftext|>\n", "short", "\n" * 200):
        assert pieces.encode(text) == libraries[0].encode(text, add_special_tokens=False).ids
    assert pieces.whole is not None
