"""Cases in which a result was once wrong."""

import brute
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from passagemill.llm import arrays, jaccard, packing, reputation, rules, wordpieces
from passagemill.session import table


def alternating(letters, size=1024):
    """A word of two letters in the Thue-Morse order: it and its mirror have the same sum of letter * base ** place
    modulo 2 ** 64 for every odd base."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def test_words_that_polynomials_confuse():
    data = np.frombuffer(" ".join([alternating("ab"), alternating("ba"), alternating("ab")]).encode(), np.uint8)
    starts, ends, _ = arrays.word_spans(data, np.array([0, len(data)]))
    a, b, c = arrays.word_hashes(data, starts, ends).tolist()
    assert a == c != b


def test_groups_of_words_that_polynomials_confuse(spark):
    rows = [(1, " ".join([alternating("ab")] * 3)), (2, " ".join([alternating("ba")] * 3)), (3, " ".join([alternating("ab")] * 3))]
    found = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=90).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 1}


def test_counts_of_words_that_polynomials_confuse(spark):
    tokens = wordpieces.load_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = [(1, alternating("an")), (2, alternating("na")), (3, alternating("an") + " " + alternating("na"))]
    found = wordpieces.count_pieces(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), tokens).collect()
    plain = [(k, *brute.pieces(t, set(tokens), max(map(len, tokens)))) for k, t in rows]
    assert brute.key(found) == brute.key(plain) and len({p[2] for p in plain[:2]}) == 2


def test_statistics_on_a_cutoff_are_not_above_it(spark):
    # 100 of 4,000 good documents have a symbol share of exactly 1/20: 60 words of ten letters, 30 symbols among them.
    words = [f"w{j:09d}" for j in range(60)]
    marked = " ".join(w[:-1] + "#" if j % 2 else w for j, w in enumerate(words))
    rows = [(i, marked if i < 100 else " ".join(words), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = rules.judge(docs, docs.select("doc_id", F.lit(1).alias("quality"))).select("_row.doc_id", "kept", "base_failed").collect()
    assert len(found) == 4000 and not any(r.base_failed for r in found) and all(r.kept for r in found)


def test_every_simple_share_meets_its_own_cutoff(spark):
    for rule in ("symbol_share", "word_length"):
        grid = rules.points(rule)
        for i, cutoff in enumerate(grid):
            for m in (1, 3, 7, 49):
                n = len(grid) - 1
                top, bottom = (n - i) * m * int(rules.GRID[rule][0]), n * m
                assert top / bottom == cutoff


def test_cutoff_on_a_grid_point_rejects_what_it_counted(spark):
    shares = [1 / 20] * 100 + [0.0] * 3900
    good = spark.createDataFrame([("en", s, 0.0, 0.0, 5.0) for s in shares], "stratum string, symbol_share double, "
                                 "copied_lines double, repeated_words double, word_length double")
    limit = rules.cutoffs(good, 1).first().symbol_share
    assert sum(s > limit for s in shares) == 0 and limit == 0.05


def test_hosts_without_outcomes_take_their_parents_rate(spark):
    rows = [(f"h{i}.bad.org", 1) for i in range(5) for _ in range(20)] + [(f"g{i}.good.com", 0) for i in range(5) for _ in range(20)]
    outcomes = spark.createDataFrame(rows, "host string, bad int")
    others = spark.createDataFrame([("new.bad.org",), ("bad.org",), ("new.good.com",), ("h1.bad.org",), ("x.else.net",), (None,)],
                                   "host string")
    found = {r.host: r for r in reputation.host_reputations(outcomes, others=others).collect()}
    assert {h for h, r in found.items() if r.blocked} >= {f"h{i}.bad.org" for i in range(5)} | {"new.bad.org", "bad.org"}
    assert not found["new.good.com"].blocked and found["h1.bad.org"].n == 20 and None not in found
    # A suffix without outcomes has the overall rate.
    assert abs(found["x.else.net"].rate - 0.5) < 1e-9 and found["new.bad.org"].rate > 0.9
    # Hosts without outcomes change nothing for the others.
    alone = {r.host: tuple(r) for r in reputation.host_reputations(outcomes).collect()}
    assert all(alone[h] == tuple(found[h]) for h in alone)


def test_pages_of_odd_hosts(spark):
    schema = "page_id long, url string, host string, path string, rule string, verdict string, _row string"
    urls = [None, "no scheme", "http://", "HTTP://A.B/x", "http://a.b/" + "y" * 300_000, "x://" + "h" * 100_000 + "?q", "http://user@a.b:80/z#f"]
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "v", "w") for i, u in enumerate(urls)] * 2, schema)
    outcomes = spark.createDataFrame([("a.b", 1)], "host string, bad int")
    known = reputation.host_reputations(outcomes, others=pages.select(reputation.host_of(F.col("url")).alias("host")))
    found = reputation.judge(pages, F.col("url"), known).collect()
    assert len(found) == 14 and {r.verdict for r in found} <= {"allow", "block"} and all(r["_row"].verdict == "v" for r in found)
    assert reputation.judge(pages.limit(0), F.col("url"), known).collect() == []
    assert reputation.host_reputations(outcomes.limit(0), others=pages.select("host").limit(0)).collect() == []
    assert not any(r.blocked for r in reputation.host_reputations(outcomes.limit(0), others=pages.select("host")).collect())


def test_a_narrow_input_is_packed_in_its_order(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 37 + j) % 101}" for j in range(1 + i * 13 % 190))) for i in range(400)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    found = packing.packed_documents(spark, str(tmp_path)).collect()
    order = [r.doc_id for r in sorted(found, key=lambda r: (r.sequence_id, r.offset))]
    assert sorted(set(order), key=order.index) == list(range(400))
    import corpus_pipeline
    again = corpus_pipeline.sequences(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found))
