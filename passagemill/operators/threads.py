"""Conversation threads: titles, history windows, prompts.

Look-backs inside a thread go through OrderedGroups, so a thread that holds a large share of all messages
is cut into blocks instead of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import constants as K
from ..functions.text import non_blank, trim_all
from ..scale import GROUP_ROWS, OrderedGroups, broadcast_if_small
from .merging import first_by

_KEY, _ORDER = ["conv_id"], ["turn"]


def message_id() -> Column:
    """One number for (conv_id, turn): distinct for turns below 2^32; conv_id from 2^31 on is an overflow error."""
    return F.col("conv_id") * F.lit(2 ** 32) + F.col("turn")


def title_of(text: Column) -> Column:
    body = trim_all(text)
    return F.when(F.length(body) <= K.TITLE_CHARS, body).otherwise(
        F.concat(F.substring(body, 1, K.TITLE_CHARS), F.lit("...")))


def conversation_titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title) from the first user message."""
    firsts = (messages.filter(F.col("role") == "user").groupBy("conv_id")
              .agg(F.min_by("text", "turn").alias("text")))
    return firsts.select("conv_id", title_of(F.col("text")).alias("title"))


def conversation_list(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, last_turn); sort by last_turn where the list is shown."""
    return (messages.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn")))


def history_window(messages: DataFrame, n: int = K.HISTORY_MESSAGES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """At each user turn the n messages before it, rendered: (conv_id, turn, history)."""
    groups = OrderedGroups(messages, _KEY, _ORDER, group_rows).with_neighbours(before=n)
    line = F.concat(F.when(F.col("role") == "assistant", "Assistant: ").otherwise("User: "), F.col("text"))
    frame = groups.window().rowsBetween(-n, -1)
    seen = groups.df.withColumn("history", F.array_join(F.collect_list(line).over(frame), "\n"))
    return (groups.replace(seen).own_rows().plain()
            .filter(F.col("role") == "user").select("conv_id", "turn", "history"))


def contextual_queries(messages: DataFrame, context: Column | None = None, n: int = K.RECENT_MESSAGES,
                       group_rows: int = GROUP_ROWS) -> DataFrame:
    """Search query of each user turn: the message, the last n messages (itself included) and the context."""
    groups = OrderedGroups(messages, _KEY, _ORDER, group_rows).with_neighbours(before=n - 1)
    frame = groups.window().rowsBetween(1 - n, 0)
    spoken = F.when(F.col("role").isin("user", "assistant"), F.col("text"))
    recent = F.array_join(F.collect_list(spoken).over(frame), ". ")
    df = groups.replace(groups.df.withColumn("_recent", recent)).own_rows().plain().filter(F.col("role") == "user")
    extra = non_blank(context) if context is not None else F.lit(None).cast("string")
    query = F.concat_ws(" ", non_blank("text"), non_blank("_recent"), extra)
    return df.select("conv_id", "turn", F.substring(query, 1, K.SEARCH_QUERY_CHARS).alias("query"))


def prior_questions(messages: DataFrame, n: int = K.HISTORY_MESSAGES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """At each user turn the last n earlier user messages with another text: (conv_id, turn, questions).

    Runs of one repeated message keep only their last n members as candidates: for any later turn those
    are enough, and inside the run none counts. The last n * (n + 1) candidates then hold n with another
    text, so the look-back is bounded however often a message is repeated.
    """
    users = messages.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    groups = OrderedGroups(users, _KEY, _ORDER, group_rows).with_neighbours(before=1)
    changed = ~F.lag("text").over(groups.window()).eqNullSafe(F.col("text"))
    groups = groups.replace(groups.df.withColumn("_new", changed.cast("int"))).own_rows()
    groups = groups.running("_run", F.col("_new")).with_neighbours(after=n)
    in_run = F.lead("_run", n).over(groups.window()) == F.col("_run")
    groups = groups.replace(groups.df.withColumn("_kept", F.when(F.coalesce(in_run, F.lit(False)), 0).otherwise(1)))
    groups = groups.own_rows().running("_at", F.col("_kept"))
    # Candidates by their number; every turn reads the numbers up to its own.
    rows = groups.plain().select("conv_id", "turn", "text", "_kept", "_at")
    reach = n * (n + 1) + 1
    candidates = OrderedGroups(rows, _KEY, ["_at", "turn"], group_rows)
    if not candidates.is_cut:
        frame = Window.partitionBy(*_KEY).orderBy("_at").rangeBetween(-reach, 0)
        near = F.collect_list(F.when(F.col("_kept") == 1, F.struct("turn", "text"))).over(frame)
        found = rows.withColumn("_near", near)
    else:
        # Numbered buckets of ``reach`` candidates: a turn reads its own bucket and the one before.
        kept = rows.filter("_kept = 1").select("conv_id", F.floor(F.col("_at") / reach).alias("_bucket"),
                                               F.struct("turn", "text").alias("_item"))
        packed = kept.groupBy("conv_id", "_bucket").agg(F.collect_list("_item").alias("_items"))
        packed = packed.withColumn("_bucket", F.explode(F.array(F.col("_bucket"), F.col("_bucket") + 1)))
        packed = packed.groupBy("conv_id", "_bucket").agg(F.flatten(F.collect_list("_items")).alias("_near"))
        found = rows.withColumn("_bucket", F.floor(F.col("_at") / reach)).join(packed, ["conv_id", "_bucket"], "left")
    others = F.array_sort(F.filter(F.col("_near"), lambda x: (x["turn"] < F.col("turn")) & (x["text"] != F.col("text"))))
    last = F.slice(others, F.greatest(F.size(others) - n + 1, F.lit(1)), F.lit(n))
    return found.select("conv_id", "turn", F.coalesce(F.transform(last, lambda x: x["text"]),
                                                      F.array().cast("array<string>")).alias("questions"))


def load_thread(messages: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """Messages of the given threads, any role but user shown as assistant."""
    wanted = conv_ids.select("conv_id").distinct()
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    return (messages.join(broadcast_if_small(wanted), "conv_id", "left_semi")
            .select("conv_id", "turn", role.alias("role"), "text"))


def regenerate_from(messages: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages kept, questions to ask again) when the assistant turns in targets (conv_id, turn) are redone.

    The nearest user turn before the target and everything after it goes.
    """
    aimed = targets.select("conv_id", F.col("turn").alias("_target"))
    assistant = messages.filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("_target"))
    aimed = aimed.join(assistant, ["conv_id", "_target"], "left_semi").groupBy("conv_id").agg(
        F.min("_target").alias("_target"))
    cuts = (messages.filter(F.col("role") == "user").select("conv_id", "turn")
            .join(broadcast_if_small(aimed), "conv_id").filter(F.col("turn") < F.col("_target"))
            .groupBy("conv_id").agg(F.max("turn").alias("_cut")))
    marked = messages.join(broadcast_if_small(cuts), "conv_id", "left")
    kept = marked.filter(F.col("_cut").isNull() | (F.col("turn") < F.col("_cut"))).drop("_cut")
    again = marked.filter(F.col("turn") == F.col("_cut")).select("conv_id", "turn", F.col("text").alias("question"))
    return kept, again


def base_filename(column: Column | str) -> Column:
    """File name without the " (n)" that a repeated drop adds before the extension."""
    value = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(value, " \\(\\d+\\)(?=\\.[^.]+$)", "")


def latest_by_file(threads: DataFrame, names: DataFrame) -> DataFrame:
    """Newest thread per asked file name: (name, conv_id). A thread anchored to the file beats threads that
    only list it. threads (conv_id, updated_at, file, files); names (name)."""
    asked = names.select("name").distinct().withColumn("_base", base_filename("name"))
    anchored = threads.select(F.col("file").alias("_base"), F.lit(0).alias("_class"), "updated_at", "conv_id")
    listed = threads.select(F.explode(F.array_distinct("files")).alias("_base"), F.lit(1).alias("_class"),
                            "updated_at", "conv_id")
    best = F.min(F.struct("_class", (-F.unix_micros(F.col("updated_at").cast("timestamp"))).alias("age"), "conv_id"))
    newest = anchored.unionByName(listed).filter(F.col("_base").isNotNull()).groupBy("_base").agg(best.alias("b"))
    return asked.join(newest, "_base").select("name", F.col("b.conv_id").alias("conv_id"))


def latest_by_checksum(threads: DataFrame, checksums: DataFrame) -> DataFrame:
    """Newest thread per checksum: (checksum, conv_id)."""
    best = F.max_by("conv_id", F.struct("updated_at", (-F.col("conv_id")).alias("c")))
    newest = threads.filter(F.col("checksum").isNotNull()).groupBy("checksum").agg(best.alias("conv_id"))
    return newest.join(checksums.select("checksum").distinct(), "checksum", "left_semi")


def seed_from_search(exchanges: DataFrame) -> DataFrame:
    """Two-message threads from search exchanges: (conv_id, turn, role, text, citations, title);
    input (conv_id, query, answer, citations)."""
    none = F.lit(None).cast("string")
    parts = F.array(
        F.struct(F.lit("user").alias("role"), non_blank("query").alias("text"), none.alias("citations")),
        F.struct(F.lit("assistant").alias("role"), non_blank("answer").alias("text"),
                 non_blank("citations").alias("citations")))
    kept = F.filter(parts, lambda p: p["text"].isNotNull())
    title = F.when(non_blank("query").isNotNull(), title_of(F.col("query")))
    return (exchanges.select("conv_id", title.alias("title"), F.posexplode(kept).alias("turn", "p"))
            .select("conv_id", "turn", "p.role", "p.text", "p.citations", "title"))


def _label(name: str) -> Column:
    pairs = [F.lit(v) for lang, labels in K.PROMPT_LABELS.items() for v in (lang, labels[name])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("lang")), F.lit(K.PROMPT_LABELS["en"][name]))


def assemble_prompts(requests: DataFrame) -> DataFrame:
    """Prompt of every request: grounding, earlier questions, then the imperative with the question last.

    Input (query_id, lang, question, prior array, grounding); assistant answers never appear.
    """
    grounding = non_blank("grounding")
    earlier = F.when(F.size("prior") > 0, F.concat(_label("earlier"), F.lit("\n"), F.array_join(
        F.transform("prior", lambda q: F.concat(F.lit("- "), q)), "\n")))
    imperative = F.when(grounding.isNotNull(), _label("grounded")).otherwise(_label("ungrounded"))
    prompt = F.concat_ws("\n\n", F.concat(_label("grounding"), F.lit("\n"), grounding), earlier,
                         F.concat(imperative, F.lit("\n"), F.col("question")))
    return requests.select("query_id", prompt.alias("prompt"))


def assemble_recovery_prompts(requests: DataFrame, total_chars: int) -> DataFrame:
    """Prompt after a call overflow: tool results first. Input as for assemble_prompts plus transcript."""
    cap = F.least(F.length("transcript"), F.lit(max(200, int(total_chars * 0.55))))
    transcript = non_blank(F.substring(F.col("transcript"), F.lit(1), cap))
    rest = F.greatest(F.lit(total_chars) - cap, F.lit(0))
    grounding = non_blank(F.substring(F.col("grounding"), F.lit(1), rest))
    earlier = F.when(F.size("prior") > 0, F.concat(_label("earlier"), F.lit("\n"), F.array_join(
        F.transform("prior", lambda q: F.concat(F.lit("- "), q)), "\n")))
    prompt = F.concat_ws("\n\n", F.concat(_label("transcript"), F.lit("\n"), transcript),
                         F.concat(_label("grounding"), F.lit("\n"), grounding), earlier,
                         F.concat(_label("recovery"), F.lit("\n"), F.col("question")))
    return requests.select("query_id", prompt.alias("prompt"))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace every ``{{key}}`` of a template."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def delete_conversations(conversations: DataFrame, messages: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the doomed threads."""
    gone = broadcast_if_small(doomed.select("conv_id").distinct())
    return conversations.join(gone, "conv_id", "left_anti"), messages.join(gone, "conv_id", "left_anti")


def attachment_changes(log: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Turns whose ordered file list differs from the one before: (conv_id, turn, files)."""
    named = log.withColumn("files", F.transform("files", base_filename))
    groups = OrderedGroups(named, _KEY, _ORDER, group_rows).with_neighbours(before=1)
    before = F.coalesce(F.lag("files").over(groups.window()), F.array().cast("array<string>"))
    df = groups.df.withColumn("_same", before.eqNullSafe(F.col("files")))
    return groups.replace(df).own_rows().plain().filter(~F.col("_same")).select("conv_id", "turn", "files")
