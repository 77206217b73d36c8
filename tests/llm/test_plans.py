"""Packing, mixing, sharding and URL filters: operators that place rows."""

import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from passagemill.llm import common, mixing, packing, reputation, sharding
from passagemill.session import table

SMALL = "/root/testdata/sf0.001"


# Packing

def whole(found):
    by_key = defaultdict(list)
    for r in found:
        by_key[r.doc_id].append(r)
    return by_key


def test_pieces_are_whole_documents(spark, odd, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd.dropDuplicates(["doc_id"]), table(spark, SMALL, "documents")):
        found = packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
        by_key = whole(found)
        for key, text in df.select("doc_id", "text").collect():
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
            parts = sorted(by_key.pop(key), key=lambda r: r.start)
            assert [i for r in parts for i in np.frombuffer(r.ids, "<u4")] == ids
            assert {r.doc_tokens for r in parts} == {len(ids)}
            assert [r.start for r in parts] == np.cumsum([0] + [r.length for r in parts])[:-1].tolist()
        assert not by_key
        sequences = defaultdict(list)
        for r in found:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            assert [o for o, _ in sorted(parts)] == np.cumsum([0] + [n for _, n in sorted(parts)])[:-1].tolist()
            assert sum(n for _, n in parts) <= 1024
    assert packing.packed(nothing).collect() == []


def test_ids_are_the_tokenizer_files(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["End of it. <|endoftext|> More.", "<|endoftext|>", "<|endoftext|><|endoftext|>\n", "<|endoftext |>",
             "a" + " " * 1_010_000 + "b", "a" + "\n" * 1_200_000, "a" + "\u00a0" * 100_000 + "b", " " * 99_999 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    by_key = whole(found)
    for key, text in enumerate(texts):
        parts = sorted(by_key[key], key=lambda r: r.start)
        ids = [i for r in parts for i in np.frombuffer(r.ids, "<u4")]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [0], text[:30]
    assert 50256 in np.frombuffer(by_key[0][0].ids, "<u4")


def test_little_padding(spark):
    found = packing.packed_documents(spark, "/root/testdata/sf0.01")
    total = found.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n"), F.count("n")).first()
    assert total[0] / (1024 * total[1]) > 0.98


def test_repeated_rows_are_packed_each(odd):
    assert packing.packed(odd.filter("doc_id = 5")).filter("start = 0").count() == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(0, 9)), min_size=1, max_size=40))
def test_cuts_cost_least(steps):
    ends, costs = np.cumsum([s for s, _ in steps]), np.array([float(c) for _, c in steps])
    best = [0.0]
    places = [0, *ends.tolist()]
    for j in range(1, len(places)):
        best.append(costs[j - 1] + min(best[i] + 12 - (places[j] - places[i])
                                       for i in range(j) if places[j] - places[i] <= 12))
    chosen = packing.cut(ends, costs, 12)
    marks = [0, *[int(ends[i]) for i in chosen]]
    assert all(b - a <= 12 for a, b in zip(marks, marks[1:])) and marks[-1] == places[-1]
    assert sum(costs[i] for i in chosen) + sum(12 - (b - a) for a, b in zip(marks, marks[1:])) == pytest.approx(best[-1])


def test_stretches_do_not_change_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3000)
    found = packing.packed_documents(spark, SMALL)
    plain = found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t"))
    assert plain.filter("n <> t").count() == 0
    totals = found.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r.n for r in totals) <= 1024 and sum(r.n for r in totals) > 0.95 * 1024 * len(totals)


# Mixing

def test_targets_are_water_filled(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 20):
        sizes = [(f"s{i:02d}" if i else None, int(rng.integers(0, 1000) ** 2)) for i in range(n)]
        found = {r.source: r.target for r in mixing.source_targets(
            spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, (s, _) in enumerate(order)}
        budget, caps = 1.5 * sum(x for _, x in sizes), {s: 2 * x for s, x in sizes}
        target, open_ = dict.fromkeys(caps, 0.0), set(caps)
        while open_:
            left = budget - sum(target[s] for s in caps if s not in open_)
            total = sum(weight[s] for s in open_)
            over = {s for s in open_ if left * weight[s] / total > caps[s]}
            if not over:
                target |= {s: left * weight[s] / total for s in open_}
                break
            target |= {s: float(caps[s]) for s in over}
            open_ -= over
        assert found == pytest.approx(target)


def test_mixture_meets_its_targets(spark, odd, nothing):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    for df in (documents, odd):
        found = mixing.mix(df, F.col("doc_id"), F.col("source"), common.word_count(F.col("text"))).select(
            "_row.source", "size", "target", "taken")
        assert found.count() == df.count()
        for r in found.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect():
            assert abs(r.t - r.w) <= 1
        assert found.filter("taken > 2 * size").count() == 0
    again = mixing.mix(documents.repartition(7), F.col("doc_id"), F.col("source"), common.word_count(F.col("text")))
    once = mixing.mix(documents, F.col("doc_id"), F.col("source"), common.word_count(F.col("text")))
    assert brute.key(again.select("_row.doc_id", "taken").collect()) == brute.key(once.select("_row.doc_id", "taken").collect())
    assert mixing.mix(nothing, F.col("doc_id"), F.col("source"), F.lit(1)).collect() == []


def test_repeated_rows_hold_what_is_taken(spark, odd, nothing):
    mixed = mixing.repeat_rows(odd)
    assert mixed.schema.simpleString() == odd.schema.simpleString()
    words = mixed.groupBy("source").agg(F.sum(common.word_count(F.col("text"))).alias("n"))
    taken = mixing.mix(odd, F.col("doc_id"), F.col("source"), common.word_count(F.col("text"))).groupBy(
        "_row.source").agg(F.sum("taken").alias("n"))
    assert brute.key(words.filter("n > 0").collect()) == brute.key(taken.filter("n > 0").collect())
    assert mixing.repeat_rows(nothing).collect() == []


@pytest.mark.parametrize("count, kept", [(0, ""), (1, " one"), (2, " one two"), (3, " one two\nthree")])
def test_first_words(spark, count, kept):
    df = spark.createDataFrame([(" one two\nthree ", count)], "t string, n int")
    assert df.select(mixing.first_words(F.col("t"), F.col("n"))).first()[0].rstrip() == kept


# Sharding

def test_shards_match_the_mixture(spark, odd, nothing):
    documents = table(spark, "/root/testdata/sf0.01", "documents")
    found = sharding.interleave_shards(documents, F.col("doc_id"), F.col("source"), F.lit(0)).select(
        "_row.source", "shard", "slot").collect()
    per = defaultdict(list)
    mixture = defaultdict(lambda: defaultdict(int))
    for r in found:
        per[r.shard].append(r.slot)
        mixture[r.source][r.shard] += 1
    assert sorted(per) == list(range(16)) and all(sorted(s) == list(range(len(s))) for s in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(abs(n - sum(m.values()) / 16) <= 2 for m in mixture.values() for n in m.values())
    small = sharding.interleave_shards(odd, F.col("doc_id"), F.col("source"), F.col("text")).collect()
    assert len(small) == odd.count() and len({(r.shard, r.slot) for r in small}) == len(small)
    assert sharding.interleave_shards(nothing, F.col("doc_id"), F.col("source"), F.col("text")).collect() == []


# URL filters

def test_hosts_and_rules(spark):
    urls = {
        None: ("", "", None), "no scheme": ("", "", None), "http://": ("", "", None),
        "https://A.Example.COM": ("a.example.com", "", None), "https://a.example.com/": ("a.example.com", "/", "com/"),
        "http://www.example.com/en/x?y#z": ("www.example.com", "/en/x", "www.example.com/en/"),
        "http://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/"), "http://x.net/es/a": ("x.net", "/es/a", "net/es/"),
        "http://x.net/es": ("x.net", "/es", None), "a://b?c://d/e": ("b", "", None), "http://com/fr/": ("com", "/fr/", "com/"),
    }
    df = spark.createDataFrame([(u,) for u in urls] * 2, "url string")
    empty = spark.createDataFrame([], "host string, bad int")
    found = reputation.judge(df, F.col("url"), reputation.host_reputations(empty)).select("_row.url", "host", "path", "rule", "verdict")
    rows = found.collect()
    assert len(rows) == 2 * len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule) == urls[r.url]
        assert r.verdict == ("block" if r.rule in ("example.com/en/", "net/es/") else "allow")


def test_names(spark):
    df = spark.createDataFrame([("u@a.b.co.uk:80",), ("b.co.uk",), ("x.y.org",), ("org",), ("",)], "h string")
    name = reputation.name_of(F.col("h"))
    found = df.select(reputation.domain_of(name), reputation.suffix_of(name)).collect()
    assert [tuple(r) for r in found] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("y.org", "org"), ("org", "org"), ("", "")]


def test_posterior_probability(spark):
    rng = np.random.default_rng(4)
    for a, b in ((1.0, 1.0), (2.5, 7.0), (40.0, 90.0), (3000.0, 9000.0)):
        value = spark.range(1).select(reputation.above(F.lit(a), F.lit(b), 0.25)).first()[0]
        assert abs(value - (rng.beta(a, b, 400_000) > 0.25).mean()) < 0.004


def test_reputation_shrinks(spark):
    rows = [("bad.x.org", 1)] * 80 + [("bad.x.org", 0)] * 20 + [("good.x.org", 0)] * 95 + [("good.x.org", 1)] * 5 + [
        ("new.x.org", 1)] + [(f"h{i}.y.org", int(i % 9 == 0)) for i in range(90)]
    found = {r.host: r for r in reputation.host_reputations(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert found["bad.x.org"].blocked and not found["good.x.org"].blocked
    assert not found["new.x.org"].blocked and found["new.x.org"].rate < 0.95
    assert all(0 <= r.above <= 1 for r in found.values())
