import brute
import numpy as np
import pytest
from sample import BASE, DOCUMENTS, row

from passagemill.llm import jaccard
from passagemill.llm.components import components
from passagemill.session import table


def found(df, words=3, percent=90):
    return brute.key(jaccard.classes(df, words=words, percent=percent).collect())


def plain(df, words=3, percent=90):
    return brute.key(brute.groups([tuple(r) for r in df.select("doc_id", "text").collect()], words, percent))


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (1, 50)])
def test_odd_rows(odd, words, percent):
    assert found(odd, words, percent) == plain(odd, words, percent)


def test_empty(nothing):
    assert found(nothing) == []
    assert jaccard.one_of_each(nothing).collect() == []


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_documents(spark, words, percent):
    documents = table(spark, "/root/testdata/sf0.01", "documents").repartition(5)
    assert found(documents, words, percent) == plain(documents, words, percent)


def near_copies(spark, n=160, words=90, seed=5):
    """Chains and clusters: many copies with a few edits each, so that links run through others."""
    rng, rows = np.random.default_rng(seed), []
    for group in range(4):
        base = [f"w{group}x{i}" for i in range(words + 30 * group)]
        for i in range(n // 4):
            text = list(base)
            for place in rng.integers(0, len(text), rng.integers(0, 4)):
                text[place] = f"e{rng.integers(0, 6)}"
            rows.append(row(int(rng.integers(0, 10_000)), " ".join(text)))
    return spark.createDataFrame(rows, DOCUMENTS).repartition(4)


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 85)])
def test_near_copies(spark, words, percent):
    documents = near_copies(spark)
    assert found(documents, words, percent) == plain(documents, words, percent)


def test_one_of_each_group_stays(spark, odd):
    rest = jaccard.one_of_each(odd)
    assert rest.schema.simpleString() == odd.schema.simpleString()
    ids = brute.key((r.doc_id, r.text is None) for r in rest.collect())
    assert ids.count((5, False)) == 1 and (7, False) not in ids and ids.count((2, False)) == 2
    assert (4, False) in ids and (8, False) not in ids
    documents = near_copies(spark)
    groups = brute.groups([tuple(r) for r in documents.select("doc_id", "text").collect()], 5, 80)
    assert jaccard.one_of_each(documents).count() == len({g for _, _, g in groups})


def test_prefix_choice_lengthens_where_it_pays():
    rare, common = np.ones(80, np.uint32), np.full(20, 1000, np.uint32)
    assert jaccard.prefix_choice(np.sort(np.concatenate([rare, common])), 100, 90) == (1, 11)
    crowded = np.full(100, 1000, np.uint32)
    matches, length = jaccard.prefix_choice(crowded, 100, 90)
    assert matches > 1 and length == 10 + matches


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (7, 7), (20, 21), (21, 20), (None, 4)] + [
        (100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 260)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 9: 7, 8: 7, 7: 7, 20: 20, 21: 20} | {
        i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 261)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_equal_words_and_case(spark):
    rows = [row(1, BASE), row(2, BASE.upper()), row(3, BASE.replace(" ", "\n")), row(4, BASE + "tail")]
    assert found(spark.createDataFrame(rows, DOCUMENTS)) == plain(spark.createDataFrame(rows, DOCUMENTS))
