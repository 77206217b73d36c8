"""Phrases and their counts against plain code and SQL."""

import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from passagemill.llm import collocations
from passagemill.session import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, longest=5):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang or "und"] += len(words)
            for d in range(1, longest + 1):
                for i in range(len(words) - d + 1):
                    counts[lang or "und"][tuple(words[i:i + d])] += 1
    return counts, sizes


def plain_collocations(rows, min_count, top, longest=5):
    counts, sizes = plain_counts(rows, longest)
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= min_count}
        inner = set()
        for p, a in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p) and 100 * a >= 100 * found[p[i:j]]:
                        inner.add(p[i:j])
        scored = []
        for p, a in candidates.items():
            if p not in inner:
                score, k = min((1000 * a * sizes[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=6))
def test_extension_on_both_sides(pieces):
    sequence = np.array([0] + [v for p in pieces for v in [*p, 0]], np.uint32)
    forward, backward = collocations.transform(sequence), collocations.transform(sequence[::-1])
    each = np.bincount(sequence)
    slots = np.flatnonzero(each)[1:]
    phrases = [(int(w),) for w in slots]
    near = (np.cumsum(each) - each)[slots]
    lo, back, size = near, near, each[slots]
    plain = Counter(tuple(p[i:i + d]) for p in pieces for d in range(1, 6) for i in range(len(p) - d + 1))
    for depth in range(2, 6):
        if depth % 2 == 0:
            own, lo2, back2, size2, shared = collocations.extended(forward, lo, back, size)
            longer = [(phrases[s][0],) + phrases[o] for o, s in zip(own, shared)]
        else:
            own, back2, lo2, size2, shared = collocations.extended(backward, back, lo, size)
            longer = [phrases[o] + (phrases[s][-1],) for o, s in zip(own, shared)]
        lo, back, size, phrases = lo2, back2, size2, longer
        assert (shared >= 0).all() and len(set(phrases)) == len(phrases)
        assert dict(zip(phrases, size.tolist())) == {p: c for p, c in plain.items() if len(p) == depth}


def check(spark, rows, min_count, top, partitions=3, **options):
    df = spark.createDataFrame([(i, lang, text) for i, (lang, text) in enumerate(rows)],
                               "doc_id long, lang string, text string").repartition(partitions)
    found = collocations.collocations(df, min_count=min_count, top=top, **options).collect()
    assert sorted(map(tuple, found)) == plain_collocations(rows, min_count, top, **options)
    return found


def random_rows(n, seed=3):
    chance = np.random.default_rng(seed)
    words = ["a", "B", "b", "cé", "dd", "e", "FF", "ff", " g"]
    seps = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "! "]
    rows = [(None if i % 7 == 0 else "und" if i % 11 == 0 else "xy"[i % 2],
             "".join(words[w] + seps[s] for w, s in zip(chance.zipf(1.5, 40) % 9, chance.integers(0, 9, 40))))
            for i in range(n)]
    return rows + [("x", None), ("y", ""), ("x", " . ,\n"), ("z", "only one"), ("x", "new york city " * 5)]


def test_against_plain_code(spark, monkeypatch):
    rows = random_rows(60)
    for shard, bucket in ((1 << 23, 1 << 22), (700, 500), (1, 3000)):
        monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
        monkeypatch.setattr(collocations, "BUCKET_BYTES", bucket)
        assert check(spark, rows, 4, 50)
    check(spark, rows, 3, 1000, longest=3)


def test_few_ranks_and_ties(spark):
    found = check(spark, [("x", f"w{i} v{i}. " * 3) for i in range(40)], 2, 7)
    assert [r.rank for r in found] == list(range(1, 8)) and len({r.score for r in found}) == 1


def test_products_beyond_64_bits(spark):
    n = 3 * 10 ** 15
    rows = spark.createDataFrame([(2 * 10 ** 12, [5 * 10 ** 12, 2 * 10 ** 12], [7 * 10 ** 12, 2 * 10 ** 12], n)],
                                 "a long, firsts array<long>, rests array<long>, n long")
    from pyspark.sql import functions as F
    assert rows.select(collocations._lowest_cut(F.col("n"))["score"]).first()[0] == 1000 * 2 * 10 ** 12 * n // (35 * 10 ** 24)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.lang, r.text) for r in odd.collect()]
    found = collocations.collocations(odd, min_count=5).collect()
    assert sorted(map(tuple, found)) == plain_collocations(rows, 5, 2000)
    assert collocations.collocations(nothing).collect() == []
    assert collocations.collocations(odd, longest=1).collect() == []
    with pytest.raises(ValueError):
        collocations.frequent_phrases(odd, longest=6)


def test_frequent_phrases_of_all_lengths(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    levels, sizes = collocations.frequent_phrases(docs, min_count=20)
    counts, plain_sizes = plain_counts([(r.lang, r.text) for r in docs.select("lang", "text").collect()])
    assert {r.stratum: r.n for r in sizes.collect()} == dict(plain_sizes)
    for d, level in enumerate(levels, 1):
        found = {(r.stratum, r.phrase): r.a for r in level.collect()}
        assert found == {(lang, " ".join(p)): a for lang, c in counts.items() for p, a in c.items() if len(p) == d and a >= 20}


def test_sql_twin_on_more_rows(spark):
    directory = "/root/testdata/sf0.01"
    found = compare.run_spark(collocations.mined_documents(spark, directory))
    assert len(found[1]) > 20 and found == compare.run_sql(collocations.MINED_DOCUMENTS_SQL, directory)
