"""Governed replies over a stream, message sink, catalogs and templates from files, deep search."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from passagemill.operators import calls as G, lookups as J, scoring as S, threads as P
from passagemill.plans import jobs
from passagemill.sources import tables as A
from passagemill.streaming import calls as ST

START = dt.datetime(2024, 1, 1)


def random_searches(spark, n=120):
    rng = random.Random(4)
    rows = [(f"t{rng.randint(0, 12)}", i, START + dt.timedelta(seconds=i), rng.choice(["searchContext", "webSearch", None]),
             rng.choice([" Find  one", "find one", "find two", None, ""])) for i in range(n)]
    return spark.createDataFrame(rows, "turn_key string, seq long, ts timestamp, tool string, args string")


def reply(queries):
    return queries.select("query_id", F.concat(F.lit("re: "), "query").alias("reply"))


def test_replies_after_a_failure_equal_the_batch(spark, tmp_path):
    calls = random_searches(spark)
    for i in range(3):
        calls.filter((F.col("seq") >= i * 40) & (F.col("seq") < i * 40 + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: ST.govern_calls(spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    batches = []

    def failing(queries):
        batches.append(1)
        if len(batches) == 2:
            raise RuntimeError("lost")
        return reply(queries)

    with pytest.raises(Exception, match="lost"):
        ST.serve_to_end(read(), failing, str(tmp_path / "out"))
    found = ST.serve_to_end(read(), reply, str(tmp_path / "out")).collect()
    filled = calls.fillna("", ["tool", "args"])
    decided = G.govern_calls(filled).join(filled.select("turn_key", "seq", "tool", "args"), ["turn_key", "seq"])
    wanted = ST.answer_calls(decided, reply).collect()
    assert wanted and sorted(map(tuple, found)) == sorted(map(tuple, wanted))
    # One more run finds nothing new.
    assert ST.serve_to_end(read(), reply, str(tmp_path / "out")).count() == len(wanted)


def test_idle_turns_start_anew(spark, tmp_path):
    # The state of a turn goes once the watermark is past its last call and the idle time, in a batch without it.
    day = lambda n: START + dt.timedelta(days=n)
    rows = [("t", 1, START, "calc", "1"), ("t", 2, START + dt.timedelta(hours=1), "calc", "1"), ("x", 3, day(9), "calc", "1"),
            ("x", 4, day(20), "calc", "1"), ("t", 5, day(20), "calc", "1"), ("t", 6, day(20), "calc", "1")]
    schema = "turn_key string, seq long, ts timestamp, tool string, args string"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = {r.seq: r.decision for r in ST.run_to_table(ST.govern_calls(stream)).collect()}
    assert found == {1: "allow", 2: "duplicate", 3: "allow", 4: "duplicate", 5: "allow", 6: "duplicate"}


def test_a_turn_of_many_calls_keeps_a_short_list(spark, tmp_path):
    rows = [("t", i, START, "calc", str(i)) for i in range(3000)]
    schema = "turn_key string, seq long, ts timestamp, tool string, args string"
    spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path))
    found = {r.seq: r.decision for r in ST.run_to_table(ST.govern_calls(stream)).collect()}
    assert [s for s, v in sorted(found.items()) if v == "allow"] == list(range(8)) and len(found) == 3000


def test_a_batch_of_messages_counts_once(spark, tmp_path):
    messages = spark.createDataFrame([(c, t, f"m{c}{t}", 10 * c + t) for c in range(5) for t in range(4)],
                                     "conv_id long, turn long, text string, sent long")
    path = str(tmp_path)
    for batch, turns in ((0, "turn < 2"), (1, "turn >= 2"), (0, "turn < 2"), (1, "turn >= 2")):
        A.append_messages(messages.filter(turns), path, batch)
    assert sorted(map(tuple, A.read_messages(spark, path).collect())) == sorted(map(tuple, messages.collect()))
    assert sorted(map(tuple, A.read_threads(spark, path).collect())) == [(c, 10 * c + 3, 4) for c in range(5)]


def test_a_stream_of_messages_is_stored(spark, tmp_path):
    schema = "conv_id long, turn long, text string, sent long"
    for turn in range(3):
        spark.createDataFrame([(c, turn, "m", turn) for c in range(3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ST.store_messages(stream, str(tmp_path / "out"), str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert A.read_messages(spark, str(tmp_path / "out")).count() == 9
    assert {tuple(r) for r in A.read_threads(spark, str(tmp_path / "out")).collect()} == {(c, 2, 3) for c in range(3)}


def test_files_by_path(spark, tmp_path):
    files = spark.createDataFrame([("a.en.json", '{"k": "old", "only": "a"}'), ("b.en.json", '{"k": "new"}'), ("c.fr.json", '{"k": "fr"}'),
                                   ("d.xx.json", '{"k": "no"}'), ("prompt.normal.chat.fr.txt", "Bonjour {{name}}\n{{name}}"),
                                   ("prompt.normal.chat.short.fr.txt", "{{name}}")], "name string, value string")
    path = tmp_path / "files"
    A.write_files(files, str(path))
    (path / "plain").mkdir()
    (path / "plain" / "e.es.json").write_text('{"k":\n "es"}')
    found = A.read_files(spark, str(path))
    assert found.count() == 7 and found.filter("modified IS NULL").isEmpty()
    assert {tuple(r) for r in A.read_catalogs(found).collect()} == {
        ("en", "k", "new"), ("en", "only", "a"), ("fr", "k", "fr"), ("es", "k", "es")}
    templates = A.read_templates(found)
    asked = spark.createDataFrame([(1, "normal", "chat", None, "fr"), (2, "normal", "chat", "short", "fr"), (3, "normal", "chat", "x", "en")],
                                  "query_id long, mode string, feature string, variant string, lang string")
    texts = {r.query_id: r.t for r in A.resolve_template(asked, templates).select(
        "query_id", P.fill_template(F.col("text"), {"name": F.lit("Ana")}).alias("t")).collect()}
    assert texts == {1: "Bonjour Ana\nAna", 2: "Ana", 3: None}


def test_wide_templates_are_not_broadcast(spark):
    wide = spark.range(100_000).select(F.lit("normal").alias("mode"), F.col("id").cast("string").alias("feature"),
                                       F.lit(None).cast("string").alias("variant"), F.lit("en").alias("lang"),
                                       F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(str(i))), 512) for i in range(4)]).alias("text"))
    asked = spark.range(10).select(F.col("id").alias("query_id"), F.lit("normal").alias("mode"), F.col("id").cast("string").alias("feature"),
                                   F.lit(None).cast("string").alias("variant"), F.lit("en").alias("lang"))
    plan = A.resolve_template(asked, wide)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
    catalog = wide.select("lang", F.col("feature").alias("key"), F.col("text").alias("value"))
    keys = asked.select("lang", F.col("feature").alias("key"))
    joined = J.lookup_strings(keys, catalog)
    assert "strategy=broadcast" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.filter("length(text) < 100").isEmpty()


def test_deep_search_sums_the_terms_of_all_queries(spark):
    sessions = spark.createDataFrame([(1, "red apples", ["green pears", "RED  apples", " "]), (2, "quiet rivers", None)],
                                     "query_id long, query string, derived array<string>")
    texts = ["red apples fall", "green pears fall", "red apples and green pears", "quiet rivers run", "nothing of it"]
    results = spark.createDataFrame(
        [(q, p, v, i, d, f"https://x.org/{d}", f"s{d}", texts[d]) for q, p in ((1, 0), (1, 1), (1, 2), (2, 0), (2, 1))
         for v in ("web", "encyclopedia") for i, d in enumerate(range(5))],
        "query_id long, query_pos int, provider string, pos int, doc_id long, url string, title string, text string")
    found = jobs.deep_search(sessions, results)
    assert {(r.query_id, r.pos) for r in found["plan"].collect()} == {(1, 0), (1, 1), (2, 0)}
    merged = [(r.query_id, r.merged_pos, r.doc_id) for r in found["merged"].orderBy("query_id", "merged_pos").collect()]
    assert merged == [(q, i + 1, i) for q in (1, 2) for i in range(5)]
    first = {r.query_id: r.doc_id for r in found["selected"].filter("position = 1").collect()}
    assert first == {1: 2, 2: 3}
    assert {r.query_id: r.s for r in found["percent"].groupBy("query_id").agg(F.sum("pct").alias("s")).collect()} == {1: 100, 2: 100}
