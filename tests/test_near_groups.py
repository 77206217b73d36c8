"""Groups of near copies by a star of links; connected components."""

import random

from pyspark.sql import functions as F

from passagemill.operators import merging as M
from passagemill.operators.components import connected


def plain_groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200, 260)] + [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(60)] + [(300, i) for i in range(301, 400)]
    found = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert found == plain_groups(links, {n for l in links for n in l})
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_groups_against_all_pairs(spark):
    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    texts = []
    for base in range(12):
        start = rng.sample(words, rng.randint(3, 30))
        for _ in range(rng.randint(1, 9)):
            changed = list(start)
            for _ in range(rng.randint(0, 4)):
                changed[rng.randrange(len(changed))] = rng.choice(words)
            texts.append(" ".join(changed))
            start = changed if rng.random() < 0.5 else start
    rows = list(enumerate(texts)) + [(900, ""), (901, None), (902, texts[0])]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    sets = {i: frozenset(w for w in t.split()) for i, t in rows if t}
    for threshold in (0.5, 0.75, 0.9):
        pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
        found = {r.id: r.group_id for r in M.near_groups(df, threshold).collect()}
        assert found == plain_groups(pairs, sets)


def test_many_copies_cost_as_many_rows(spark):
    # Near copies of one text: all pairs would be 200 million.
    n = 20_000
    df = spark.range(n).select("id", F.concat(F.lit(" ".join(f"shared{i}" for i in range(30)) + " own"), F.col("id") % 4000,
                                              F.lit(" more"), F.col("id") % 3).alias("text"))
    found = M.near_groups(df).groupBy("group_id").count().collect()
    assert [(r.group_id, r["count"]) for r in found] == [(0, n)]


def test_close_pairs_across_blocks(spark, monkeypatch):
    # Blocks of few sets: pairs of one block, of two blocks of a class and of neighbouring classes.
    monkeypatch.setattr(M, "CELL_SETS", 7)
    rng = random.Random(11)
    words = [f"word{i}" for i in range(50)]
    texts = []
    for _ in range(15):
        start = rng.sample(words, rng.randint(1, 40))
        texts += [" ".join(start[:len(start) - rng.randint(0, 5)] + rng.sample(words, rng.randint(0, 3))) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0] + " more"), (500, None)], "id long, text string").repartition(3)
    sets = {}
    for i, t in enumerate(texts):
        if t:
            sets.setdefault(frozenset(t.split()), i)
    for threshold in (0.5, 0.75, 0.9):
        expect = {(i, j): round(len(a & b) / len(a | b), 9) for a, i in sets.items() for b, j in sets.items()
                  if i < j and len(a & b) >= threshold * len(a | b)}
        rows = M.near_duplicates(df, threshold).collect()
        assert {(r.id_a, r.id_b): r.similarity for r in rows} == expect and len(rows) == len(expect)


def test_candidates_are_not_shuffled(spark, capsys):
    # Sets that share a term of their prefixes but too little besides: they met in pairs behind a shuffle, with their terms.
    rows = [(i, f"rare{i % 2} " + " ".join(f"own{i}x{j} common{j}" for j in range(8))) for i in range(40)]
    found = M.near_duplicates(spark.createDataFrame(rows, "id long, text string"))
    found.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" not in plan and "FlatMapGroupsInArrow" in plan and found.isEmpty()


def test_pairs_of_copies(spark, monkeypatch):
    # Equal term sets are pairs as well, and each text of a set is beside each of a close one; sets of many texts are cut.
    monkeypatch.setattr(M, "COPIES_AT_ONCE", 2)
    texts = ["red green blue grey", "grey blue green red", "red green blue grey more", "more red green blue grey", "red green blue grey",
             "alone here", "", None, "other words", "other words"]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[0])]
    sets = {i: frozenset((t or "").split()) for i, t in enumerate(texts)}
    expect = sorted((i, j, round(len(a & b) / len(a | b), 9)) for i, a in sets.items() for j, b in sets.items()
                    if i < j and a and b and len(a & b) >= 0.75 * len(a | b))
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    found = M.near_duplicates(df, fold_copies=False).collect()
    assert sorted((r.id_a, r.id_b, r.similarity) for r in found) == expect and len(expect) == 11
