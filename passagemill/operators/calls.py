"""Govern and analyse logs of tool calls and requests.

All running state inside a turn, key or session goes through OrderedGroups, so one hot key does not have to
fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import trim_all
from ..scale import GROUP_ROWS, OrderedGroups, computed


def normalized_arguments(column: Column | str) -> Column:
    """Arguments with case and spacing ignored."""
    value = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(F.lower(trim_all(value)), "\\s+", " ")


def tool_cap(tool: Column) -> Column:
    caps = F.lit(K.MAX_CALLS_PER_TURN)
    for name, cap in K.TOOL_CAPS.items():
        caps = F.when(tool == name, cap).otherwise(caps)
    return caps


def govern_calls(calls: DataFrame, max_calls: int = K.MAX_CALLS_PER_TURN, caps: Column | None = None,
                 group_rows: int = GROUP_ROWS) -> DataFrame:
    """Decision per call: (turn_key, seq, attempt, decision, repeats).

    Input (turn_key, seq, tool, args). Attempts beyond the total are refused and leave no trace (repeats 0); a
    repeated signature is a duplicate; a tool beyond its cap is refused but its signature is remembered.
    """
    groups = OrderedGroups(calls, ["turn_key"], ["seq"], group_rows).running("attempt", F.lit(1))
    rows = groups.plain()
    late = rows.filter(F.col("attempt") > max_calls)
    # No more than max_calls rows per turn are left, so plain windows are bounded.
    early = rows.filter(F.col("attempt") <= max_calls).withColumn("_sig", normalized_arguments("args"))
    by_signature = Window.partitionBy("turn_key", "tool", "_sig").orderBy("attempt")
    early = early.withColumn("repeats", F.row_number().over(by_signature))
    by_tool = Window.partitionBy("turn_key", "tool").orderBy("attempt")
    fresh = F.sum(F.when(F.col("repeats") == 1, 1).otherwise(0)).over(by_tool)
    cap = caps if caps is not None else tool_cap(F.col("tool"))
    decision = (F.when(F.col("repeats") > 1, "duplicate").when(fresh > cap, "tool_budget").otherwise("allow"))
    early = early.withColumn("decision", decision)
    columns = ["turn_key", "seq", "attempt", "decision", "repeats"]
    return early.select(*columns).unionByName(
        late.withColumn("decision", F.lit("total_budget")).withColumn("repeats", F.lit(0)).select(*columns))


def loop_guard(calls: DataFrame, window_seconds: float = K.LOOP_WINDOW_SECONDS, threshold: int = K.LOOP_THRESHOLD,
               group_rows: int = GROUP_ROWS) -> DataFrame:
    """Calls with the running count of equal expressions less than the window apart:
    (expression, ts, call_id, n, blocked)."""
    groups = OrderedGroups(calls.select("expression", "ts", "call_id"), ["expression"], ["ts", "call_id"], group_rows)
    groups = groups.with_neighbours(before=1)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(
        F.lag("ts").over(groups.window()).cast("timestamp"))
    starts = F.coalesce(gap >= int(window_seconds * 1_000_000), F.lit(True))
    groups = groups.replace(groups.df.withColumn("_start", starts)).own_rows()
    groups = groups.running("_place", F.lit(1)).running("_from", F.when(F.col("_start"), F.col("_place")), "max")
    n = F.col("_place") - F.col("_from") + 1
    return groups.plain().select("expression", "ts", "call_id", n.alias("n"), (n > threshold).alias("blocked"))


def recent_transcript(replies: DataFrame, budget: int, keep: int = 6, shown: int = 4) -> DataFrame:
    """Newest replies of a session as recovery text: (session, transcript);
    input (session, seq, tool, args, result). Blank results are not recorded."""
    newest = Window.partitionBy("session").orderBy(F.col("seq").desc())
    kept = (replies.select("session", "seq", "tool", trim_all("args").alias("args"), trim_all("result").alias("result"))
            .filter(F.col("result") != "").withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep))
    header = F.concat(F.lit("Tool: "), F.col("tool"), F.lit("\nArguments: "),
                      F.when(F.col("args") == "", "—").otherwise(F.col("args")), F.lit("\nResult:"))

    def block(item: Column, room: Column) -> Column:
        left = F.greatest(room - F.length(item["header"]) - 1, F.lit(0)).cast("int")
        cut = F.when(left > 1, F.concat(trim_all(F.substring(item["result"], F.lit(1), left - 1)), F.lit("…"))).otherwise("")
        body = F.when(F.length(item["result"]) <= left, item["result"]).otherwise(cut)
        return trim_all(F.concat(item["header"], F.lit("\n"), body))

    sessions = kept.groupBy("session").agg(F.array_sort(F.collect_list(
        F.struct("_n", header.alias("header"), "result"))).alias("items"))
    first_room = F.lit(max(160, budget // max(1, shown)))

    def step(state: Column, item: Column) -> Column:
        size = F.length(block(item, first_room)) + F.when(F.size(state["chosen"]) > 0, 2).otherwise(0)
        takes = (F.size(state["chosen"]) < shown) & (
            (state["used"] + size <= budget) | (F.size(state["chosen"]) == 0))
        return F.struct(F.when(takes, state["used"] + size).otherwise(state["used"]).alias("used"),
                        F.when(takes, F.array_append(state["chosen"], item)).otherwise(state["chosen"]).alias("chosen"))

    kind = sessions.schema["items"].dataType.simpleString()
    start = F.struct(F.lit(0).alias("used"), F.array().cast(kind).alias("chosen"))
    sessions = computed(sessions, chosen=F.reverse(F.aggregate("items", start, step, lambda s: s["chosen"])))
    room = F.greatest(F.lit(160), F.floor(F.lit(budget) / F.size("chosen")))
    text = F.array_join(F.transform("chosen", lambda c: block(c, room)), "\n\n")
    text = F.when(F.length(text) <= budget, text).otherwise(trim_all(F.substring(text, 1, budget)))
    return sessions.select("session", text.alias("transcript"))


def debounce(events: DataFrame, millis: int = K.DEBOUNCE_MILLIS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Events followed by a quiet gap: only these act. Input (key, ts, event_id)."""
    groups = OrderedGroups(events, ["key"], ["ts", "event_id"], group_rows).with_neighbours(after=1)
    gap = F.unix_micros(F.lead("ts").over(groups.window()).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    df = groups.df.withColumn("_acts", F.coalesce(gap >= millis * 1000, F.lit(True)))
    return groups.replace(df).own_rows().plain().filter("_acts").drop("_acts")


def suppress_unchanged(snapshots: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Snapshots that are not empty and differ from the one before. Input (key, ts, event_id, content)."""
    given = snapshots.filter(F.coalesce(F.col("content"), F.lit("")) != "")
    groups = OrderedGroups(given, ["key"], ["ts", "event_id"], group_rows).with_neighbours(before=1)
    same = F.lag("content").over(groups.window()).eqNullSafe(F.col("content"))
    return groups.replace(groups.df.withColumn("_same", same)).own_rows().plain().filter(~F.col("_same")).drop("_same")


def latest_request_wins(events: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Result events with ``accepted``: their request is the last one started before them.

    Input (key, ts, event_id, kind, request_id); kind is 'start' or 'result'.
    """
    groups = OrderedGroups(events, ["key"], ["ts", "event_id"], group_rows)
    started = F.when(F.col("kind") == "start", F.struct("ts", "event_id", "request_id"))
    groups = groups.running("_last", started, "max")
    return (groups.plain().filter(F.col("kind") == "result")
            .withColumn("accepted", F.coalesce(F.col("_last.request_id") == F.col("request_id"), F.lit(False)))
            .drop("_last"))


def context_key(context: Column, paths: Column, images: Column, web: Column, vision: Column, seed: Column,
                web_cap: Column, encyclopedia_cap: Column) -> Column:
    """Key under which collected context is reused; empty when nothing was asked for."""
    joined = lambda values: F.array_join(F.sort_array(F.array_distinct(values)), "|")
    text, files, pictures = F.lower(trim_all(context)), joined(paths), joined(images)
    query = F.when(web, F.lower(trim_all(seed))).otherwise("")
    empty = (text == "") & (files == "") & (pictures == "") & (query == "")
    asked = F.struct(text.alias("text"), files.alias("files"), pictures.alias("pictures"), web.alias("web"),
                     vision.alias("vision"), query.alias("query"), web_cap.alias("web_cap"),
                     encyclopedia_cap.alias("encyclopedia_cap"))
    return F.when(empty, "").otherwise(F.sha2(F.to_json(asked), 256))


def context_cache_hits(requests: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Requests with ``hit``: same key and budgets as the request before, and chunks unless nothing was asked.

    Input (session, seq, key, budget, n_chunks); a cache with a single entry.
    """
    groups = OrderedGroups(requests, ["session"], ["seq"], group_rows).with_neighbours(before=1)
    w = groups.window()
    same = (F.lag("key").over(w) == F.col("key")) & (F.lag("budget").over(w) == F.col("budget"))
    usable = (F.col("key") == "") | (F.lag("n_chunks").over(w) > 0)
    hit = F.coalesce(same & usable, F.lit(False))
    return groups.replace(groups.df.withColumn("hit", hit)).own_rows().plain()


def job_progress(items: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Completed share of each job after every item: (job, seq, done, total, progress); a job has one item at least."""
    groups = OrderedGroups(items, ["job"], ["seq"], group_rows).running("done", F.when(F.col("completed"), 1).otherwise(0))
    totals = items.groupBy("job").agg(F.count(F.lit(1)).alias("total"))
    return (groups.plain().join(totals, "job")
            .select("job", "seq", "done", "total", (F.col("done") / F.greatest("total", F.lit(1))).alias("progress")))


_PERMANENT = "guardrail|unsupportedlanguage|unsupportedlocale|unsupportedguide"


def retry_outcomes(attempts: DataFrame) -> DataFrame:
    """How each request ended under the retry ladder: (request, outcome, calls).

    Input (request, with_tools, errors): the errors of the tries in order, null for success. First try; one
    more if the error is transient; one without tools if tools were on. Cancelling ends the request.
    """
    error = lambda i: F.get("errors", F.lit(i))
    failed = lambda i: (F.size("errors") > i) & error(i).isNotNull()
    cancelled = lambda i: failed(i) & (F.lower(error(i)) == "cancelled")
    transient = ~F.lower(error(0)).rlike(_PERMANENT) & ~cancelled(0)
    # Position of the tool-free try depends on whether there was a second one.
    third = F.when(transient, 2).otherwise(1)
    third_failed = F.get("errors", third).isNotNull()
    outcome = (
        F.when(~failed(0), "first")
        .when(cancelled(0), "cancelled")
        .when(transient & ~failed(1), "retry")
        .when(transient & cancelled(1), "cancelled")
        .when(F.col("with_tools") & ~third_failed, "without_tools")
        .otherwise("failed"))
    calls = (F.when(~failed(0) | cancelled(0), 1)
             .when(transient & (~failed(1) | cancelled(1)), 2)
             .otherwise(F.when(transient, 2).otherwise(1) + F.when(F.col("with_tools"), 1).otherwise(0)))
    return attempts.select("request", outcome.alias("outcome"), calls.alias("calls"))


def windowed_event_stats(events: DataFrame, width: str, slide: str | None = None) -> DataFrame:
    """Calls per tool and time window: (window_start, tool, n, total); works on streams with a watermark."""
    spans = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (events.groupBy(spans.alias("w"), "tool").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
            .select(F.col("w.start").alias("window_start"), "tool", "n", "total"))
