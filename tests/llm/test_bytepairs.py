"""Byte-level BPE against tiktoken and against plain merging."""

import hashlib
from array import array

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from passagemill.llm import bytepairs
from passagemill.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENS = bytepairs.load_ranks(RANKS)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(TOKENS)})


@pytest.fixture(scope="module")
def encoder():
    return bytepairs.Encoder(TOKENS, *bytepairs.split_table(TOKENS))


@pytest.fixture(scope="module")
def splitter():
    classes = bytepairs.pattern_classes(public_tokenizers.PATTERN)
    return bytepairs.Splitter(public_tokenizers.PATTERN, classes, bytepairs.differing_characters(classes))


def ids_of(encoder, splitter, text):
    return [i for pieces in splitter.pieces(text) for p in pieces for i in encoder.encode(p.encode().decode("latin-1"))]


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab theing \n\t'1é😀日　\x1c՘"), st.characters(codec="utf-8")), max_size=60))
def test_any_text_as_the_library(library, encoder, splitter, text):
    assert ids_of(encoder, splitter, text) == library.encode_ordinary(text)


def test_characters_that_engines_class_differently(library, encoder, splitter):
    assert splitter.differing
    for c in sorted(splitter.differing)[::150]:
        assert ids_of(encoder, splitter, f"a{c}b {c}1{c}  {c}") == library.encode_ordinary(f"a{c}b {c}1{c}  {c}")


def merge_plainly(data, tokens):
    ranks = {t: i for i, t in enumerate(tokens)}
    if data in ranks:
        return [ranks[data]]
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, at = min(found)
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=6), unique=True, max_size=14), st.text("abc", min_size=1, max_size=40))
def test_any_vocabulary_as_plain_merging(words, text):
    # Also tokens that merging never gives, and ranks in any order.
    tokens = [b"a", b"b", b"c"] + [w.encode() for w in words]
    encoder = bytepairs.Encoder(tokens, *bytepairs.split_table(tokens))
    assert encoder.encode(text) == merge_plainly(text.encode(), tokens)


def test_long_pieces_and_texts(library, encoder, splitter, monkeypatch):
    monkeypatch.setattr(bytepairs, "LONG_TEXT", 50)
    monkeypatch.setattr(bytepairs, "PIECES", 7)
    for text in ("a" * 30_000, "ab" * 9_000, " " * 9_000 + "x", "one two  three\n" * 40, "é" * 5_000):
        assert ids_of(encoder, splitter, text) == library.encode_ordinary(text)


def test_encoded_rows(spark, odd, nothing, library):
    for df in (odd, nothing, table(spark, "/root/testdata/sf0.001", "documents")):
        encoded = bytepairs.encode_text(df, RANKS, public_tokenizers.PATTERN)
        rows = bytepairs.decode_ids(encoded, RANKS).collect()
        plain = []
        for key, text in df.select("doc_id", "text").collect():
            ids = array("I", library.encode_ordinary(text or ""))
            plain.append((str(key), ids.tobytes(), (text or "").encode()))
        assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.bytes)) for r in rows) == sorted(plain)


def test_query_columns(spark, library):
    directory = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in bytepairs.encoded_documents(spark, directory).collect()}
    for key, text in table(spark, directory, "documents").select("doc_id", "text").collect():
        ids = array("I", library.encode_ordinary(text))
        assert tuple(found[key]) == (key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                                     hashlib.sha256(text.encode()).hexdigest())


def test_ranks_must_be_whole(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bytepairs.load_ranks(str(path))
