"""Plans of retrieval and packing: what a bound spares, and which bands a query asks for."""

import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators import scoring as S, selection as Z
from passagemill.plans.registry import user_turns, whole_documents
from passagemill.scale import first_rows, spread
from passagemill.session import checkpointed


def test_a_bound_leaves_under_a_fifth_of_the_pairs(spark):
    directory = "/root/testdata/sf0.1"
    queries = user_turns(spark, directory).filter("query_id % 7 = 0")
    profile = checkpointed(S.query_profile(spread(queries, "query_id")))
    passages = checkpointed(S.stored_profile(whole_documents(spark, directory)))
    bounded, coded = S.bounded_keys(profile, passages, 10)
    pruned = bounded.filter("pruned").select("query_id").distinct()
    all_pairs = S.match_pairs(profile, passages).groupBy("query_id").count()
    visited = S.candidate_pairs(bounded, coded).count() + (
        all_pairs.join(pruned, "query_id", "left_anti").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0])
    assert 5 * visited < all_pairs.agg(F.sum("count")).first()[0]
    # Of the postings far less are left.
    left = bounded.agg(F.sum(F.when(F.expr("NOT pruned OR open"), F.col("n"))), F.sum("n")).first()
    assert 8 * left[0] < left[1]


def plain_top(spark, queries, chunks, k, method):
    profile, passages = S.query_profile(queries, method), S.passage_profile(chunks, method)
    place = F.row_number().over(S.Window.partitionBy("query_id").orderBy(*S.rank_order()))
    return S.match_pairs(profile, passages).withColumn("rank", place).filter(F.col("rank") <= k)


@pytest.mark.parametrize("method", ["overlap", "cosine"])
def test_bounded_lists_are_exact(spark, method):
    chance = random.Random(5)
    words = [f"term{int(chance.paretovariate(0.6)) % 400}" for _ in range(20_000)]
    marks = ["", "", " see eq. 3 x = 1", " Fig. 2", " over 25 km", " how many", " equation 3", " figure 2 on page 1"]
    text = lambda n: " ".join(chance.sample(words, n)) + chance.choice(marks)
    chunks = spark.createDataFrame([(i, 0, "s", "u", i % 3, text(chance.randint(1, 60))) for i in range(700)],
                                   "doc_id long, chunk_no int, source string, url string, page int, text string")
    queries = spark.createDataFrame([(i, text(chance.randint(0, 12))) for i in range(120)], "query_id long, query string")
    for k, most in ((1, S.BROADCAST_ROWS), (7, S.BROADCAST_ROWS), (60, 0)):
        profile = checkpointed(S.query_profile(queries, method))
        passages = S.stored_profile(chunks, method)
        found = S.top_matches(profile, passages, k, method, most, bound_from=0).select("query_id", "doc_id", "rank", F.round("score", 9)).collect()
        plain = plain_top(spark, queries, chunks, k, method).select("query_id", "doc_id", "rank", F.round("score", 9)).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, plain))
        assert method == "cosine" or k > 7 or not S.bounded_keys(profile, passages, k, most)[0].filter("pruned").isEmpty()


def test_bands_are_the_lengths_that_fit(spark):
    rooms = [0, 1, 2, 9, 10, 11, 100, 1023, 1024, 8198, 100_000]
    asked = spark.createDataFrame([(r,) for r in rooms], "room int").select("room", F.explode(Z._reached(F.col("room"))).alias("band"))
    lengths = spark.range(0, 9000, 7).select(F.col("id").cast("int").alias("n")).select("n", F.explode(Z._dyadic(F.col("n"))).alias("band"))
    met = lengths.join(asked, "band").groupBy("room", "n").count().collect()
    assert {r["count"] for r in met} == {1}
    assert {(r.room, r.n) for r in met} == {(r, n) for r in rooms for n in range(0, 9000, 7) if n <= r}


def test_fillers_are_asked_by_class_and_band(spark):
    budget = 8198
    passages = S.stored_profile(whole_documents(spark, "/root/testdata/sf0.01"))
    bands = Z.filler_bands(passages, budget)
    assert bands.select("class", "band").distinct().count() > 1000
    rooms = [(i, 0, 40 * i, i % 2) for i in range(200)]
    asking = spark.createDataFrame(rooms, "query_id long, intents int, room int, taken int")
    none = spark.createDataFrame([], "query_id long, doc_id long, chunk_no int")
    found = Z._class_fillers(asking, passages, none, budget)
    worst = found.groupBy("query_id", "room", "class", "entry_len").count().filter(
        f"count > floor((room + {Z.SEPARATOR}) / (entry_len + {Z.SEPARATOR})) OR entry_len > room")
    assert worst.isEmpty() and not found.isEmpty()


def test_fillers_behind_what_was_met(spark):
    # Ten equal passages: what a query has met of them does not use up what its room holds.
    rows = [(i, 0, "s", "u", 1, "alpha") for i in range(10)]
    passages = S.stored_profile(spark.createDataFrame(rows, "doc_id long, chunk_no int, source string, url string, page int, text string"))
    length = passages.first().entry_len
    asking = spark.createDataFrame([(1, 0, 2 * length + Z.SEPARATOR, 0)], "query_id long, intents int, room int, taken int")
    met = spark.createDataFrame([(1, i, 0) for i in range(6)], "query_id long, doc_id long, chunk_no int")
    found = Z._class_fillers(asking, passages, met, 12 * length).collect()
    assert sorted(r.doc_id for r in found) == [6, 7]


def test_first_rows_of_hot_groups(spark):
    rows = [("hot", i, i % 5) for i in range(3000)] + [(f"g{i}", i, 0) for i in range(50)] + [(None, 1, 1)]
    df = spark.createDataFrame(rows, "g string, id int, v int").repartition(5)
    found = first_rows(df, ["g"], [F.col("v").desc(), F.col("id")], F.lit(700), "place").collect()
    plain = {}
    for g, i, v in rows:
        plain.setdefault(g, []).append((-v, i))
    assert {(r.g, r.id, r.place) for r in found} == {(g, i, n) for g, l in plain.items() for n, (_, i) in enumerate(sorted(l)[:700], 1)}


@pytest.mark.parametrize("method", ["overlap", "cosine"])
def test_cells_with_repeated_rows_rooms_and_last_ones(spark, method, monkeypatch):
    # Small blocks, rows that repeat, null ids; then only what fits and comes behind the third one.
    monkeypatch.setattr(S, "PASSAGE_KEYS", 150)
    monkeypatch.setattr(S, "QUERY_KEYS", 60)
    chance = random.Random(9)
    words = [f"term{int(chance.paretovariate(0.7)) % 60}" for _ in range(4000)]
    marks = ["", " see eq. 3 x = 1", " Fig. 2", " over 25 km", " equation 3", " figure 2 on page 1"]
    text = lambda n: " ".join(chance.sample(words, n)) + chance.choice(marks)
    rows = [(i, i % 2, "s", "u", i % 3, text(chance.randint(1, 20))) for i in range(90)]
    chunks = spark.createDataFrame(rows + rows[:5] + [(None, 0, "s", "u", None, text(8))],
                                   "doc_id long, chunk_no int, source string, url string, page int, text string")
    asked = [(i, text(chance.randint(0, 8))) for i in range(40)]
    queries = spark.createDataFrame(asked + asked[:3] + [(None, "term1 term2")], "query_id long, query string")
    profile, passages = checkpointed(S.query_profile(queries, method)), S.stored_profile(chunks, method)
    listed = lambda df: sorted(map(str, df.select("query_id", "doc_id", "chunk_no", F.round("score", 9), "n_chars", "entry_len", "class", "rank").collect()))
    plain = checkpointed(S.top_matches(profile, passages, 4, method, bound_from=10 ** 12))
    assert listed(S.top_matches(profile, passages, 4, method, bound_from=0)) == listed(plain)
    last = plain.filter("rank = 3").select("query_id", S.rank_key().alias("last"), F.col("entry_len").alias("room"))
    behind = checkpointed(profile.join(last, "query_id"))
    found = S.top_matches(behind, passages, 4, method, bound_from=0)
    assert listed(found) == listed(S.top_matches(behind, passages, 4, method, bound_from=10 ** 12)) and not found.isEmpty()


def test_many_pairs_stay_in_their_tasks(spark, capsys):
    rows = [(i, 0, "s", "u", None, f"alpha beta gamma{i}") for i in range(50)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, source string, url string, page int, text string")
    queries = spark.createDataFrame([(i, f"alpha beta gamma{i}") for i in range(50)], "query_id long, query string")
    S.top_matches(checkpointed(S.query_profile(queries)), S.stored_profile(chunks), 3, bound_from=0).explain()
    plan = capsys.readouterr().out
    assert "FlatMapCoGroupsInArrow" in plan and "HashAggregate" not in plan


@pytest.mark.parametrize("method", ["overlap", "cosine"])
def test_what_is_shuffled_to_cells_is_packed(spark, method):
    # Every key of a passage went to each block of queries as a string; now a few numbered pieces hold all passages.
    rows = [(i, 0, "s", "u", i % 3, " ".join(f"word{(i * j) % 300}" for j in range(40)) + " word7" * (i % 400)) for i in range(300)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, source string, url string, page int, text string").coalesce(2)
    packed = S._packed(S.passage_profile(chunks, method))
    assert packed.count() == 2 and packed.agg(F.sum(F.size("doc_id"))).first()[0] == 300
    keys = F.sum(F.length("codes") + F.length("counts"))
    told = S.passage_profile(chunks, method).agg(F.sum(F.size("keys")), F.sum(F.aggregate(
        "keys", F.lit(0), lambda n, k: n + F.length(k["key"])))).first()
    assert packed.agg(keys).first()[0] <= 4 * told[0] < told[1]
