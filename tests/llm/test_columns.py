"""Token counts, media, quality statistics and rules: operators that work row by row."""

import base64
import math
import random
import zlib

import brute
import pytest
import public_tokenizers
from hypothesis import given, settings, strategies as st

from passagemill.llm import ogg, quality, rules, wordpieces
from passagemill.session import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"


# Token counts

def test_token_counts(spark, odd, nothing):
    tokens = wordpieces.load_vocabulary(RANKS)
    vocabulary, longest = set(tokens), max(map(len, tokens))
    for df in (odd, nothing, table(spark, SMALL, "documents")):
        found = wordpieces.count_pieces(df, tokens).collect()
        plain = [(k, *brute.pieces(t, vocabulary, longest)) for k, t in df.select("doc_id", "text").collect()]
        assert brute.key(found) == brute.key(plain)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=90), max_size=5))
def test_automaton_is_greedy(tokens, words):
    tokens = [t.encode() for t in tokens] + [b" a", b" ab"]
    counter, vocabulary = wordpieces.PieceCounter(tokens), set(tokens)
    text = " ".join(words).encode()
    import numpy as np
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = wordpieces.word_spans(data, np.array([0, len(data)]))
    plain = [brute.pieces(w, vocabulary, 6)[1] for w in words]
    assert counter.many(data, starts, ends).tolist() == plain
    assert [counter.one(b" " + w.encode()) for w in words] == plain


# Ogg

@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 2304, 2305, 64 * 1024, 300_001])
def test_container_round_trip(size):
    data = random.Random(size).randbytes(size)
    media = ogg.encode(data)
    found = ogg.decode(media)
    padded = found["payload"]
    assert padded[:size] == data and set(padded[size:]) <= {255} and len(padded) % 576 == 0 and padded
    assert len(padded) - size < 576 or size == 0
    assert found["n_bytes"] == size and found["seconds"] == len(padded) / ogg.RATE
    assert found["page_seconds"][-1] == found["seconds"] and found["page_seconds"] == sorted(found["page_seconds"])
    assert ogg.encode(data) == media


def test_checksum_and_lacing():
    for data in (b"", b"OggS", bytes(range(256)) * 3):
        assert ogg.checksum(data) == brute.slow_checksum(data)
    pages = ogg.pages_of([b"a" * 255, b"", b"b" * 255 * 300], [1, 2, 3], 9, 0)
    first = ogg.page(ogg.FIRST, 0, 9, 0, b"\x01", b"h")
    numbered = [first] + ogg.pages_of([b"a" * 255, b"", b"b" * 255 * 300], [1, 2, 3], 9, 1)
    stream = ogg.demultiplex(b"".join(numbered))[9]
    assert stream["packets"] == [b"h", b"a" * 255, b"", b"b" * 255 * 300]
    # The first page ends with a packet that goes on, so its time is that of the packet before.
    assert stream["times"] == [(1, 0), (3, 2), (4, 3)] and len(pages) == 2


def test_broken_containers_fail():
    media = ogg.encode(b"some text " * 9000)
    for at in (0, 30, 100, 5000, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            ogg.demultiplex(bytes(broken))
    for cut in (10, 28, 4000, len(media) - 1):
        with pytest.raises(ValueError):
            ogg.decode(media[:cut])


def test_media_column(spark, odd, nothing):
    texts = odd.select("doc_id", "text").collect()
    found = ogg.read_media(ogg.write_media(odd)).collect()
    plain = [(k, (t or "").encode()) for k, t in texts]
    assert brute.key((r.doc_id, bytes(r.payload)[:r.n_bytes]) for r in found) == brute.key(plain)
    assert ogg.read_media(ogg.write_media(nothing)).collect() == []
    row = ogg.stored_documents(spark, SMALL).filter("doc_id = 0").first()
    text = table(spark, SMALL, "documents").filter("doc_id = 0").first().text.encode()
    padded = text + b"\xff" * (-len(text) % 576)
    assert row.tail_crc32 == zlib.crc32(padded[-32:]) and row.payload_bytes == len(padded) and row.n_bytes == len(text)


# Quality classifier

def test_held_out_accuracy(spark):
    directory = "/root/testdata/sf0.1"
    found = quality.scored_documents(spark, directory).join(table(spark, directory, "labels"), "doc_id")
    rows = found.filter("held_out").select("predicted", "quality", "score").collect()
    bad = [r for r in rows if r.quality == 0]
    good = [r for r in rows if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(r.predicted for r in bad) <= 0.1 * len(bad)
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(odd, nothing, labels):
    # Too few labels for a density: every row gets the labels' share. Fold 0 is never learned from.
    found = quality.classify(odd, labels).collect()
    assert len(found) == odd.count() and {r.predicted for r in found} == {1}
    assert all(r.held_out == (r._row.doc_id is None or zlib.crc32(str(r._row.doc_id).encode()) % 5 == 0) for r in found)
    assert quality.classify(nothing, labels).collect() == []
    assert quality.good_documents(odd, labels.limit(0)).schema.simpleString() == odd.schema.simpleString()
    assert quality.statistics(None) == quality.statistics("") == quality.statistics(" \n") == [0.0] * 12


def test_scores_of_odd_texts(spark, odd):
    texts = spark.createDataFrame([(i, f"Some plain words stand here {i} times. " * (1 + i % 5)) for i in range(60)]
                                  + [(i, f"#$ {i} " * (3 + i % 7)) for i in range(60, 120)], "doc_id long, text string")
    known = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(texts.select("doc_id", quality.statistics_of("text").alias("features")).withColumnRenamed(
        "doc_id", "key"), known.withColumnRenamed("doc_id", "key").withColumnRenamed("quality", "label"))
    assert model.fitted
    from pyspark.sql import functions as F
    scores = odd.select(model.score(quality.statistics_of("text")).alias("s")).collect()
    assert all(r.s is not None and 0 <= r.s <= 1 for r in scores)
    own = texts.select("doc_id", model.score(quality.statistics_of("text")).alias("s")).collect()
    assert all((r.s > 0.5) == (r.doc_id < 60) for r in own)


# Rules

def test_base_counts(spark, odd):
    rows = table(spark, SMALL, "documents").select("text").limit(60).collect() + odd.select("text").filter(
        "length(text) < 20000 OR text IS NULL").collect()
    for r in rows:
        assert rules.counts(r.text)[:5] == brute.base_counts(r.text)


@pytest.mark.parametrize("n, p", [(1, 0.5), (30, 0.1), (400, 0.005), (2000, 0.02)])
def test_exact_binomial(n, p):
    total = 0.0
    for k in range(0, min(n, 60) + 1):
        total += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        assert abs(rules.at_most(k, n, p) - min(total, 1.0)) < 1e-9


def test_tightest_stops_at_the_first_failure():
    assert rules.tightest([0, 0, 1, 50, 0], 2000, 0.02, 0.01) == 2
    assert rules.tightest([0], 100, 0.005, 0.01) is None  # too few documents to prove anything
    assert rules.tightest([], 0, 0.02, 0.05) is None


def test_cutoffs_limit_false_rejections(spark):
    random_ = random.Random(1)
    rows = [("en", random_.betavariate(1, 60), 0.0, 0.0, 5 + random_.random()) for _ in range(6000)] + [
        ("fr", 0.1, 0.0, 0.0, 5.0)] * 20
    good = spark.createDataFrame(rows, "stratum string, symbol_share double, copied_lines double, "
                                       "repeated_words double, word_length double")
    found = {r.stratum: r for r in rules.cutoffs(good, 2).collect()}
    limit = found["en"].symbol_share
    rejected = sum(r[1] > limit for r in rows if r[0] == "en")
    assert limit < 0.2 and rules.at_most(rejected, 6000, rules.RISK / 4) <= rules.ERROR / 8
    assert found["en"].word_length < 7 and found["en"].copied_lines == 0.0
    assert found["fr"].symbol_share is None


def test_strata_are_counted_exactly(spark, labels, monkeypatch):
    counted, cutoffs = [], rules.cutoffs
    monkeypatch.setattr(rules, "cutoffs", lambda good, strata: counted.append(strata) or cutoffs(good, strata))
    for n in (3, 50, 60, 1000):
        docs = spark.range(2 * n).selectExpr("id AS doc_id", f"nullif(concat('l', id % {n}), 'l0') AS lang", "'a b' AS text")
        rules.judge(docs, labels)
        assert counted.pop() == n


def test_rules_on_odd_rows(spark, odd, nothing, labels):
    found = rules.judge(odd, labels).collect()
    assert len(found) == odd.count()
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in found)
    assert all(r.kept == (not r.base_failed) for r in found)  # no stratum has labels enough
    assert rules.judge(nothing, labels).collect() == []


def test_rules_keep_clean_documents(spark):
    directory = "/root/testdata/sf0.1"
    found = rules.judged_documents(spark, directory).join(table(spark, directory, "labels"), "doc_id")
    good = found.filter("quality = 1 AND NOT base_failed")
    assert good.filter("NOT kept").count() <= 0.02 * good.count()
