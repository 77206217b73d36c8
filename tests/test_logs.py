"""Threads and call logs: cut groups equal whole ones; goldens; streams with several batches."""

import datetime as dt
import random

from passagemill.operators import calls as G, layout as L, threads as T
from passagemill.scale import OrderedGroups
from passagemill.sources import tables as A
from passagemill.streaming import calls as ST
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def hot_messages(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(0, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["a", "b", "c", f"m{t}"])) for t in range(n)]
    data += [(c, t, "user", f"x{t}") for c in range(1, 20) for t in range(3)]
    return spark.createDataFrame(data, "conv_id int, turn int, role string, text string")


def test_cut_threads_equal_whole_threads(spark):
    m = hot_messages(spark)
    assert OrderedGroups(m, ["conv_id"], ["turn"], 50).is_cut
    for fn in (T.history_window, T.contextual_queries, T.prior_questions):
        assert rows(fn(m), "conv_id", "turn") == rows(fn(m, group_rows=50), "conv_id", "turn")


def test_prior_questions_against_a_loop(spark):
    m = hot_messages(spark, 150, 3)
    users = [r for r in m.orderBy("conv_id", "turn").collect() if r.role == "user"]
    for r in T.prior_questions(m).collect():
        mine = next(u for u in users if (u.conv_id, u.turn) == (r.conv_id, r.turn))
        expect = [u.text for u in users if u.conv_id == r.conv_id and u.turn < r.turn and u.text != mine.text][-6:]
        assert r.questions == expect


def random_calls(spark, n=600):
    rng = random.Random(5)
    data = [(("hot" if rng.random() < 0.4 else f"t{rng.randrange(60)}"), i, START + dt.timedelta(seconds=i),
             rng.choice(["webSearch", "searchContext", "calc"]), rng.choice(["a b", "A  b", "c", "d", "e"])) for i in range(n)]
    return data, spark.createDataFrame(data, "turn_key string, seq long, ts timestamp, tool string, args string")


def govern_loop(data):
    state, out = {}, {}
    caps = {"webSearch": 2, "searchContext": 3}
    for key, seq, _, tool, args in data:
        attempts, seen, allowed = state.setdefault(key, [0, {}, {}])
        state[key][0] += 1
        if state[key][0] > 8:
            out[seq] = ("total_budget", 0)
            continue
        mark = (tool, " ".join(args.lower().split()))
        seen[mark] = seen.get(mark, 0) + 1
        if seen[mark] > 1:
            out[seq] = ("duplicate", seen[mark])
        elif allowed.get(tool, 0) >= caps.get(tool, 8):
            out[seq] = ("tool_budget", 1)
        else:
            allowed[tool] = allowed.get(tool, 0) + 1
            out[seq] = ("allow", 1)
    return out


def test_governor_batch_cut_and_stream(spark, tmp_path):
    data, df = random_calls(spark)
    expect = govern_loop(data)
    for found in (G.govern_calls(df), G.govern_calls(df, group_rows=20)):
        assert {r.seq: (r.decision, r.repeats) for r in found.collect()} == expect
    # Three files in time order give three micro-batches.
    for i in range(3):
        df.filter((F.col("seq") >= i * 200) & (F.col("seq") < i * 200 + 200)).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = ST.run_to_table(ST.govern_calls(stream))
    assert {r.seq: (r.decision, r.repeats) for r in found.collect()} == expect


def test_loop_guard(spark):
    times = [0, 3, 6, 9, 12, 30, 33]
    df = spark.createDataFrame([("2+2", START + dt.timedelta(seconds=s), i) for i, s in enumerate(times)] + [("3", START, 9)],
                               "expression string, ts timestamp, call_id int")
    for found in (G.loop_guard(df), G.loop_guard(df, group_rows=2)):
        assert [(r.call_id, r.n, r.blocked) for r in found.orderBy("call_id").collect()] == [
            (0, 1, False), (1, 2, False), (2, 3, False), (3, 4, True), (4, 5, True), (5, 1, False), (6, 2, False), (9, 1, False)]


def test_transcript(spark):
    data = [("s", i, "search", "q", f"result {i} " + "x" * 100) for i in range(8)] + [("s", 9, "calc", "", "  "), ("t", 1, "calc", "", "42")]
    df = spark.createDataFrame(data, "session string, seq int, tool string, args string, result string")
    out = {r.session: r.transcript for r in G.recent_transcript(df, 500).collect()}
    assert len(out["s"]) <= 500 and "result 7" in out["s"] and "result 1 " not in out["s"]
    assert out["t"] == "Tool: calc\nArguments: —\nResult:\n42"


def test_reading_order(spark):
    def text(boxes):
        df = spark.createDataFrame([(1, i, *b) for i, b in enumerate(boxes)],
                                   "page_id long, obs_id long, text string, x double, y double, w double, h double")
        return L.reading_order(df).first().text

    left, right = "Left column line ", "Right column line "
    prose = [(right + "1", .58, .80, .3, .03), (left + "1", .08, .80, .3, .03), (left + "2", .08, .74, .3, .03), (right + "2", .58, .74, .3, .03)]
    assert text(prose) == f"{left}1 {left}2\n\n{right}1 {right}2"
    cells = [(t, x, y, .1, .03) for t, x, y in (("A", .1, .8), ("B", .4, .801), ("C", .7, .8), ("1", .1, .7), ("2", .4, .7), ("3", .7, .699))]
    assert text(cells) == "A    B    C\n1    2    3"


def test_windows_with_late_rows(spark, tmp_path):
    def batch(*offsets):
        data = [(i + len(written) * 100, START + dt.timedelta(minutes=m), "t", 1.0) for i, m in enumerate(offsets)]
        spark.createDataFrame(data, "event_id long, ts timestamp, tool string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path))
        written.append(1)

    written = []
    batch(1, 2)
    batch(300)
    batch(302)
    batch(3, 301)   # minute 3 is behind the watermark by now
    batch(900)
    schema = "event_id long, ts timestamp, tool string, value double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = ST.run_to_table(ST.windowed_event_stats(stream, "1 hour", lateness="10 minutes"))
    counts = {r.window_start: r.n for r in found.collect()}
    assert counts[START] == 2 and counts[START + dt.timedelta(hours=5)] == 3


def test_event_stream_reads_a_folder_of_parts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for directory in (str(tmp_path), "/root/testdata/sf0.001"):
        found = ST.run_to_table(ST.read_event_stream(spark, directory, 2))
        assert found.count() == events.count()


def test_streams_do_not_depend_on_the_cut_into_batches(spark, tmp_path):
    """Parts with rows out of order, inside the lateness, give what the batch operators give."""
    schema = "event_id long, ts timestamp, key string"
    # Seconds of the events of every part; the third part holds one that is late but not too late.
    parts = [[0, 20], [25, 3], [18, 30], [31, 55], [47, 90]]
    rows = [(10 * p + i, START + dt.timedelta(seconds=s), "k" if s % 2 else "j") for p, part in enumerate(parts) for i, s in enumerate(part)]
    for p in range(len(parts)):
        spark.createDataFrame([r for r in rows if r[0] // 10 == p], schema).coalesce(1).write.mode("append") \
            .parquet(str(tmp_path / "events.parquet"))
    batch = spark.createDataFrame(rows, schema)

    def calls(df):
        return df.select(F.lit("e").alias("expression"), "ts", F.col("event_id").alias("call_id"))

    def snapshots(df):
        return df.select(F.lit("s").alias("key"), "ts", "event_id", F.col("key").alias("content"))

    def same(found, wanted):
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.select(found.columns).collect()))

    late = "1 minute"
    same(ST.run_to_end(spark, str(tmp_path), lambda e: ST.loop_guard(calls(e), late, 10)), G.loop_guard(calls(batch), 10))
    same(ST.run_to_end(spark, str(tmp_path), lambda e: ST.suppress_unchanged(snapshots(e), late)),
         G.suppress_unchanged(snapshots(batch)).drop("ts"))
    same(ST.run_to_end(spark, str(tmp_path), lambda e: ST.debounce(snapshots(e), late, 5000)).select("event_id"),
         G.debounce(snapshots(batch), 5000).select("event_id"))


def test_file_names_are_unique(spark):
    def stored(*names):
        df = spark.createDataFrame([(i, n, i) for i, n in enumerate(names)], "file_id long, name string, ts long")
        return [r.stored for r in A.dedupe_filenames(df).orderBy("file_id").collect()]

    assert stored("a", "a.pdf", "a (2).pdf") == ["a.pdf", "a (3).pdf", "a (2).pdf"]
    assert stored("a (2)", "a", "a", "a (4)", "a", "a", "a (2)") == [
        "a (2).pdf", "a.pdf", "a (3).pdf", "a (4).pdf", "a (5).pdf", "a (6).pdf", "a (2) (2).pdf"]
    assert stored("a (1)", "a", "a (02)", "a") == ["a (1).pdf", "a.pdf", "a (02).pdf", "a (2).pdf"]
    rng = random.Random(3)
    many = stored(*(rng.choice(["b", "b (2)", "b (3)", "b (2) (2)", "b (5)"]) for _ in range(80)))
    assert len(set(many)) == 80
