"""Reading order of recognised text boxes, stitched pages, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.markup import aligned_text_to_tables
from ..functions.text import non_blank, trim_all
from .chunking import label_text

ROW_SHARE = 0.6
MIN_LABEL_CONFIDENCE, MAX_LABELS = 0.15, 8
_CELL_GAP = "    "


def text_rows(boxes: DataFrame) -> DataFrame:
    """Boxes with the text row they belong to: adds row_y, the middle of the row's first box.

    A row starts at a box and takes the boxes whose middle lies within 0.6 median heights below it. Where
    two neighbouring middles lie further apart than that, a row must start, so pages are first cut at such
    gaps; only inside these strips the rows are walked one after the other.
    """
    boxes = boxes.withColumn("mid", F.col("y") + F.col("h") / 2)
    sizes = boxes.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))
    # Upper median without collecting the page: position n/2 (from zero) of the sorted heights.
    heights = boxes.groupBy("page_id", "h").agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy("page_id").orderBy("h")
    median = (heights.withColumn("upto", F.sum("c").over(upto)).join(sizes, "page_id")
              .filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("page_id").agg(F.min("h").alias("median")))
    mids = boxes.select("page_id", "mid").distinct().join(median, "page_id")
    down = Window.partitionBy("page_id").orderBy(F.col("mid").desc())
    tolerance = F.col("median") * ROW_SHARE
    gap = F.lag("mid").over(down) - F.col("mid")
    strips = mids.withColumn("strip", F.sum(F.when(gap <= tolerance, 0).otherwise(1)).over(down))

    def walk(state, mid):
        anchor = F.when(state["anchor"] - mid <= state["limit"], state["anchor"]).otherwise(mid)
        return F.struct(anchor.alias("anchor"), state["limit"].alias("limit"), F.array_append(
            state["out"], F.struct(mid.alias("mid"), anchor.alias("row_y"))).alias("out"))

    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.col("limit"),
                     F.array().cast("array<struct<mid:double,row_y:double>>").alias("out"))
    walked = strips.groupBy("page_id", "strip", tolerance.alias("limit")).agg(
        F.sort_array(F.collect_list("mid"), asc=False).alias("mids"))
    rows = (walked.select("page_id", F.explode(F.aggregate("mids", start, walk, lambda s: s["out"])).alias("r"))
            .select("page_id", "r.mid", "r.row_y"))
    return boxes.join(rows, ["page_id", "mid"])


def reading_order(boxes: DataFrame) -> DataFrame:
    """Text of every page in reading order: (page_id, text); input (page_id, obs_id, text, x, y, w, h).

    Runs of rows that look like two columns of prose are read column by column, others row by row.
    """
    placed = text_rows(boxes)
    right_edge = F.col("x") + F.col("w")
    side = (F.when(F.col("w") > 0.55, "x").when((F.col("x") < 0.24) & (right_edge <= 0.50), "l")
            .when(F.col("x") >= 0.45, "r").otherwise("x"))
    items = F.array_sort(F.collect_list(F.struct("x", (-F.col("mid")).alias("m"), "obs_id", "text", side.alias("side"))))
    rows = placed.groupBy("page_id", "row_y").agg(items.alias("i"))
    of_side = lambda s: trim_all(F.array_join(F.transform(F.filter("i", lambda v: v["side"] == s), lambda v: v["text"]), " "))
    rows = rows.select(
        "page_id", "row_y", of_side("l").alias("left"), of_side("r").alias("right"),
        F.array_join(F.transform(F.filter("i", lambda v: v["text"] != ""), lambda v: v["text"]), _CELL_GAP).alias("line"),
        (~F.exists("i", lambda v: v["side"] == "x")).alias("columns"))
    rows = rows.withColumn("columns", F.col("columns") & ((F.length("left") >= 18) | (F.length("right") >= 18)))
    down = Window.partitionBy("page_id").orderBy(F.col("row_y").desc())
    # A new block starts at every row that is not in columns, and after it.
    starts = ~(F.col("columns") & F.coalesce(F.lag("columns").over(down), F.lit(False)))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(down))
    joined = F.array_sort(F.collect_list(F.struct((-F.col("row_y")).alias("o"), "left", "right", "line")))
    blocks = rows.groupBy("page_id", "block").agg(joined.alias("r"), F.first("columns").alias("columns"))

    def column_text(name: str):
        lines = F.filter(F.transform("r", lambda r: r[name]), lambda t: t != "")
        flowed = F.aggregate(lines, F.lit(""), lambda acc, t: F.when(acc == "", t).when(
            acc.endswith("-"), F.concat(F.substring(acc, F.lit(1), F.length(acc) - 1), t)).otherwise(
            F.concat(acc, F.lit(" "), t)))
        return flowed

    two_sided = F.exists("r", lambda r: r["left"] != "") & F.exists("r", lambda r: r["right"] != "")
    by_row = F.array_join(F.filter(F.transform("r", lambda r: F.when(
        F.col("columns"), F.array_join(F.filter(F.array(r["left"], r["right"]), lambda t: t != ""), _CELL_GAP)
    ).otherwise(r["line"])), lambda t: t != ""), "\n")
    text = F.when(F.col("columns") & (F.size("r") >= 2) & two_sided,
                  F.concat(column_text("left"), F.lit("\n\n"), column_text("right"))).otherwise(by_row)
    parts = blocks.select("page_id", "block", text.alias("t")).filter(F.col("t") != "")
    pages = parts.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("block", "t"))).alias("p"))
    full = pages.select("page_id", trim_all(F.array_join(F.transform("p", lambda p: p["t"]), "\n")).alias("text"))
    return boxes.select("page_id").distinct().join(full, "page_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def stitch_pages(pages: DataFrame, max_chars: int) -> DataFrame:
    """Text of a rendered document from its pages: (doc_id, text); input (doc_id, page_no from 1, text, labels)."""
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("Visual content: "), label_text(F.col("labels"))))
    body = F.concat_ws("\n\n", non_blank("text"), labels)
    section = F.concat(F.lit("[Rendered webpage page "), F.col("page_no"), F.lit("]\n"), body)
    sections = pages.filter(body != "").groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page_no", section.alias("s")))).alias("p"))
    joined = sections.select("doc_id", F.array_join(F.transform("p", lambda p: p["s"]), "\n\n").alias("text"))
    return joined.select("doc_id", F.substring(trim_all(aligned_text_to_tables("text")), 1, max_chars).alias("text"))


def top_labels(labels: DataFrame, keys: list[str], order: str, min_confidence: float = MIN_LABEL_CONFIDENCE,
               k: int = MAX_LABELS) -> DataFrame:
    """First k labels of each key, in the given order, among those confident enough: adds ``place``."""
    place = Window.partitionBy(*keys).orderBy(order)
    return (labels.filter(F.col("confidence") >= min_confidence)
            .withColumn("place", F.row_number().over(place)).filter(F.col("place") <= k))
