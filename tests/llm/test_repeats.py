import brute
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from passagemill.llm import repeats
from passagemill.session import table

COLUMNS = ["_row.doc_id", "n_bytes", "n_removed", "n_spans"]


def found(df):
    from pyspark.sql import functions as F
    return brute.key(repeats.remove_repeats(df).select(*COLUMNS, F.sha2("kept", 256)).collect())


def plain(df):
    return brute.key(brute.without_repeats([tuple(r) for r in df.select("doc_id", "text").collect()]))


def test_odd_rows(odd):
    assert found(odd) == plain(odd)


def test_empty(nothing):
    assert found(nothing) == []


@pytest.mark.parametrize("directory", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_documents(spark, directory):
    documents = table(spark, directory, "documents").repartition(5)
    assert found(documents) == plain(documents)


def test_all_columns_stay(odd):
    rest = repeats.without_repeats(odd)
    assert rest.schema.simpleString() == odd.schema.simpleString()
    rows = {(r.doc_id, r.text) for r in rest.collect()}
    assert (5, odd.filter("doc_id = 5").first().text) not in rows  # it shares strings with document 0
    assert (1, None) in rows and (14, "a" * 5000) in rows
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rest.collect())
    assert "�" not in "".join(r.text or "" for r in rest.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=300).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=6))
def test_every_string_lies_in_one_phrase(texts):
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    begin, last, trigger = repeats.phrases(data, offsets)
    starts = [p for a, b in zip(begin, last) for p in range(a, b + 1)]
    assert starts == [p for a, b in zip(offsets, offsets[1:]) for p in range(a, b - repeats.LENGTH + 1)]
    assert all(a <= t and t + repeats.TRIGGER <= b + repeats.LENGTH for a, b, t in zip(begin, last, trigger))
    # Equal strings have their trigger at the same place.
    place = {}
    for a, b, t in zip(begin, last, trigger):
        for p in range(a, b + 1):
            assert place.setdefault(bytes(data[p:p + repeats.LENGTH]), t - p) == t - p


def test_long_stretches_are_searched_in_parts(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 30, 3000, 5000])
    whole = repeats.phrases(data, offsets)
    monkeypatch.setattr(repeats, "SEARCHED", 64)
    assert all((a == b).all() for a, b in zip(whole, repeats.phrases(data, offsets)))
