"""Cut documents into passages of whole units with overlap.

A document is one row, so everything happens inside the row and nothing is shuffled. Text stays in
Catalyst expressions; the sequential packing sees only unit lengths, and only units longer than a whole
chunk pass through a small text splitter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import constants as K
from ..functions.markup import aligned_text_to_tables
from ..functions.text import _col, non_blank, normalize_ws, sentences, trim_all, trim_line
from ..scale import computed

SENTENCE, LINE, TABLE = "sentence", "line", "table"
_ROW_LINE = "(?m)^[ \\t]*\\|[^\\n]+\\|[ \\t]*$"
_RULE_LINE = "^\\|+(?:[ \\t]*[-:]+[ \\t]*\\|+)+$"
_ANY_RULE = "(?m)^[ \\t]*\\|+(?:[ \\t]*[-:]+[ \\t]*\\|+)+[ \\t]*$"


def _is_row(line: Column) -> Column:
    return trim_line(line).rlike("^\\|[^\\n]+\\|$")


def _is_rule(line: Column) -> Column:
    return trim_line(line).rlike(_RULE_LINE)


def with_units(df: DataFrame) -> DataFrame:
    """Add ``_units``: array of (section_id, kind, text) of the prepared text.

    Every step is computed once; one nested expression would repeat the early steps many times.
    """
    df = computed(df, _clean=prepared_text("text"))
    df = computed(df, _lines=F.split("_clean", "\n"))
    # A blank line wherever table rows meet other lines.
    before = F.concat(F.slice("_lines", 1, 1), F.slice("_lines", F.lit(1), F.size("_lines") - 1))
    parted = F.array_join(F.zip_with("_lines", before, lambda now, prev: F.when(
        _is_row(now) != _is_row(prev), F.concat(F.lit("\n"), now)).otherwise(now)), "\n")
    parted = F.when(F.col("_clean").rlike(_ROW_LINE), parted).otherwise(F.col("_clean"))
    df = df.withColumn("_blocks", F.filter(F.split(parted, "\n{2,}"), lambda b: trim_all(b) != ""))
    df = computed(df, _blocks=F.transform("_blocks", lambda b, i: F.struct(
        i.alias("section_id"), _is_row(F.substring_index(b, "\n", 1)).alias("table"), trim_all(b).alias("block"),
        sentences(b).alias("sentences"),
        F.filter(F.transform(F.split(b, "\n"), trim_line), lambda l: l != "").alias("lines"))))

    def units(block: Column) -> Column:
        prose = F.when(F.size(block["sentences"]) >= 2, block["sentences"]).when(
            F.size(block["lines"]) >= 2, block["lines"]).otherwise(F.array(block["block"]))
        pieces = F.when(block["table"], F.array(F.array_join(block["lines"], "\n"))).otherwise(prose)
        kind = F.when(block["table"], TABLE).when(F.size(block["sentences"]) >= 2, SENTENCE).otherwise(LINE)
        return F.transform(pieces, lambda p: F.struct(
            block["section_id"].alias("section_id"), kind.alias("kind"), p.alias("text")))

    return computed(df, _units=F.flatten(F.transform("_blocks", units))).drop("_clean", "_lines", "_blocks")


def prepared_text(column: Column | str) -> Column:
    """Aligned tables to Markdown, white space collapsed, trimmed."""
    return trim_all(normalize_ws(aligned_text_to_tables(column)))


def _cut(text: str, start: int, hard_end: int) -> int:
    """Best place to cut in the last fifth before hard_end."""
    low = hard_end - max(1, (hard_end - start) // 5)
    tail = text[low:hard_end]
    paragraph = tail.rfind("\n\n")
    if paragraph >= 0:
        return low + paragraph + 2
    ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", tail)]
    if ends:
        return low + ends[-1]
    newline = tail.rfind("\n")
    if newline >= 0:
        return low + newline + 1
    at = hard_end
    # Leave a number whole: digits with . or , between them, or digit groups parted by one space.
    while at > low:
        left, right = text[at - 1], text[at]
        grouped = right == " " and left.isnumeric() and text[at + 1:at + 2].isnumeric()
        clustered = all(c.isnumeric() or c in ".," for c in (left, right)) and (left.isnumeric() or right.isnumeric())
        if not (grouped or clustered):
            break
        at -= 1
    if at > low and text[at - 1].islower() and text[at].islower():
        # Inside a word: go back to the blank before it.
        while at > low and not text[at].isspace():
            at -= 1
        at += at > low
    return at


def split_long_text(text: str, limit: int) -> list[str]:
    """Pieces of at most limit characters."""
    pieces, start = [], 0
    while start < len(text):
        hard_end = start + limit
        end = len(text) if hard_end >= len(text) else _cut(text, start, hard_end)
        pieces.append(text[start:end].strip())
        start = end
    return [p for p in pieces if p]


def pack_lengths(lengths: list[int], gaps: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first, size) of each chunk of whole units; gaps[i] is the separator length before unit i."""
    ranges, first = [], 0
    while first < len(lengths):
        used, end = lengths[first], first + 1
        while end < len(lengths) and used + gaps[end] + lengths[end] <= limit:
            used += gaps[end] + lengths[end]
            end += 1
        ranges.append((first, end - first))
        if end == len(lengths):
            break
        back = end
        if overlap > 0 and end - first > 1:
            # At least one unit is repeated, more while they fit the overlap, never the whole chunk.
            back = end - 1
            shared = lengths[back]
            while back - 1 > first and shared + gaps[back] + lengths[back - 1] <= overlap:
                shared += gaps[back] + lengths[back - 1]
                back -= 1
            if back - 1 == first and shared + gaps[back] + lengths[first] <= overlap:
                back = end - 1
        first = back
    return ranges


def _splitter(limit: int):
    @F.pandas_udf("array<array<string>>")
    def split_long(texts: pd.Series) -> pd.Series:
        return texts.map(lambda found: [None if t is None else split_long_text(t, limit) for t in found])
    return split_long


def _packer(limit: int, overlap: int):
    @F.pandas_udf("array<struct<first:int,size:int>>")
    def pack(lengths: pd.Series, gaps: pd.Series) -> pd.Series:
        return pd.Series([
            [{"first": f, "size": n} for f, n in pack_lengths(list(ls), list(gs), limit, overlap)]
            for ls, gs in zip(lengths, gaps)], dtype=object)
    return pack


def chunk_sizes(max_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    """Characters per chunk and per overlap."""
    limit = max(K.MIN_CHUNK_CHARS, max_tokens * K.CHARS_PER_TOKEN)
    return limit, min(limit // 2, max(0, overlap_tokens * K.CHARS_PER_TOKEN))


def _with_units(docs: DataFrame, limit: int) -> DataFrame:
    df = with_units(docs)
    # Only texts longer than a chunk go to Python; the rest of the array is null.
    df = df.withColumn("_long", F.transform("_units", lambda u: F.when(F.length(u["text"]) > limit, u["text"])))
    df = computed(df.withColumn("_pieces", _splitter(limit)("_long")).drop("_long"), _pieces=F.col("_pieces"))
    return computed(df, _units=F.flatten(F.zip_with("_units", "_pieces", lambda unit, pieces: F.when(
        pieces.isNull(), F.array(unit)).otherwise(F.transform(pieces, lambda p: F.struct(
            unit["section_id"].alias("section_id"), unit["kind"].alias("kind"), p.alias("text"))))))).drop("_pieces")


def chunk_units(docs: DataFrame, max_chars: int) -> DataFrame:
    """(doc_id, unit_no, section_id, kind, text) for documents (doc_id, text)."""
    return (_with_units(docs.select("doc_id", "text"), max_chars)
            .select("doc_id", F.posexplode("_units").alias("unit_no", "u"))
            .select("doc_id", "unit_no", "u.section_id", "u.kind", "u.text"))


def propagate_headers(chunks: Column) -> Column:
    """Give table rows that were cut from their header the latest header of the same width.

    A chunk whose first row is a header itself, a row above a rule line, keeps it and gets no other.
    """
    lines = F.transform(chunks, lambda c: F.split(c, "\n"))
    # Rule lines at the very start belong to a table of an earlier chunk.
    lines = F.transform(lines, lambda ls: F.slice(ls, F.coalesce(F.nullif(F.array_position(
        F.transform(ls, _is_rule), F.lit(False)).cast("int"), F.lit(0)), F.size(ls) + 1), F.size(ls)))
    width = lambda line: F.greatest(F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) - 1, F.lit(1))

    def read(ls: Column) -> Column:
        rows = F.filter(F.zip_with(ls, F.slice(ls, F.lit(2), F.size(ls)), lambda a, b: F.struct(
            width(trim_line(a)).alias("width"), F.concat_ws("\n", a, b).alias("head"),
            F.coalesce(_is_rule(b), F.lit(False)).alias("heads"), (_is_row(a) & ~_is_rule(a)).alias("row"))),
            lambda r: r["row"])
        first = F.get(rows, F.lit(0))
        return F.struct(ls.alias("lines"), F.when(~first["heads"], first["width"]).alias("width"),
                        F.transform(F.filter(rows, lambda r: r["heads"]), lambda r: F.struct(
                            r["width"].alias("width"), r["head"].alias("head"))).alias("heads"))

    def step(state: Column, item: Column) -> Column:
        known = F.filter(state["heads"], lambda h: h["width"] == item["width"])
        text = F.array_join(item["lines"], "\n")
        text = F.when(F.size(known) > 0, F.concat_ws("\n", F.get(known, F.size(known) - 1)["head"], text)).otherwise(text)
        return F.struct(F.array_append(state["out"], text).alias("out"),
                        F.concat(state["heads"], item["heads"]).alias("heads"))

    start = F.struct(F.array().cast("array<string>").alias("out"),
                     F.array().cast("array<struct<width:int,head:string>>").alias("heads"))
    folded = F.aggregate(F.transform(lines, read), start, step, lambda s: s["out"])
    has_rule = F.exists(chunks, lambda c: c.rlike(_ANY_RULE))
    return F.when((F.size(chunks) > 1) & has_rule, folded).otherwise(chunks)


def chunk(docs: DataFrame, max_tokens: int = K.WEB_CHUNK[0], overlap_tokens: int = K.WEB_CHUNK[1]) -> DataFrame:
    """Chunks of documents (doc_id, source, url, page, text):
    (doc_id, chunk_no, source, url, page, text, n_chars). Other columns are carried along."""
    limit, overlap = chunk_sizes(max_tokens, overlap_tokens)
    carried = [c for c in docs.columns if c != "text"]
    df = _with_units(docs, limit)
    before = F.concat(F.slice("_units", 1, 1), F.slice("_units", F.lit(1), F.greatest(F.size("_units") - 1, F.lit(0))))
    gap = lambda u, prev: (F.when(u["section_id"] != prev["section_id"], "\n\n")
                           .when((u["kind"] == SENTENCE) & (prev["kind"] == SENTENCE), " ").otherwise("\n"))
    df = computed(df, _units=F.zip_with("_units", before, lambda u, prev: F.struct(
        u["text"].alias("text"), gap(u, prev).alias("gap"))))
    df = df.withColumn("_lengths", F.transform("_units", lambda u: F.length(u["text"])))
    df = df.withColumn("_gaps", F.transform("_units", lambda u: F.length(u["gap"])))
    df = computed(df.withColumn("_ranges", _packer(limit, overlap)("_lengths", "_gaps")), _ranges=F.col("_ranges"))
    render = lambda r: F.array_join(F.transform(
        F.slice(F.col("_units"), r["first"] + 1, r["size"]),
        lambda u, i: F.when(i == 0, u["text"]).otherwise(F.concat(u["gap"], u["text"]))), "")
    df = computed(df, _texts=F.transform("_ranges", render))
    return (df.select(*carried, F.posexplode(propagate_headers(F.col("_texts"))).alias("chunk_no", "text"))
            .withColumn("n_chars", F.length("text")))


def page_chunks(pages: DataFrame, max_context_tokens: int) -> DataFrame:
    """A page that fits the context stays whole, a bigger one is cut; ``whole`` tells which."""
    budget = max(1, max_context_tokens * K.CHARS_PER_TOKEN)
    cap = int(budget * K.WHOLE_PAGE_SHARE)
    clean = pages.withColumn("text", non_blank("text")).filter(F.col("text").isNotNull())
    whole = clean.filter(F.length("text") <= cap)
    cut = chunk(clean.filter(F.length("text") > cap), *K.PAGED_CHUNK)
    carried = [c for c in pages.columns if c != "text"]
    return whole.select(*carried, F.lit(0).alias("chunk_no"), "text", F.length("text").alias("n_chars"),
                        F.lit(True).alias("whole")).unionByName(cut.withColumn("whole", F.lit(False)))


def content_ladder(results: DataFrame, scraped: DataFrame, tool_mode: bool = False) -> DataFrame:
    """Text of a result: provider content, else scraped page, else snippet; ``rung`` tells which.

    Tool mode has no scraped rung and drops results without any text.
    """
    given = non_blank("retrieved")
    if tool_mode:
        text = F.coalesce(given, F.nullif(F.col("snippet"), F.lit("")))
        return (results.withColumn("rung", F.when(given.isNotNull(), "provider").otherwise("snippet"))
                .withColumn("text", text).filter(F.col("text").isNotNull()))
    # One text a page: blank ones do not count, of several the smallest.
    pages = scraped.select("url", non_blank("text").alias("_scraped")).groupBy("url").agg(F.min("_scraped").alias("_scraped"))
    joined = results.join(pages, "url", "left")
    return (joined
            .withColumn("rung", F.when(given.isNotNull(), "provider").when(F.col("_scraped").isNotNull(), "scraped")
                        .otherwise("snippet"))
            .withColumn("text", F.coalesce(given, F.col("_scraped"), F.col("snippet"))).drop("_scraped"))


def label_text(labels: Column) -> Column:
    """"label (0.00), …" of an array of (label, confidence)."""
    return F.array_join(F.transform(labels, lambda l: F.format_string("%s (%.2f)", l["label"], l["confidence"])), ", ")


def attach_labels(chunks: DataFrame, heading: str = "Page content") -> DataFrame:
    """Append the labels (array column ``labels``) to the text as a block of their own."""
    block = F.when(F.size("labels") > 0, F.concat(F.lit(f"{heading}: "), label_text(F.col("labels"))))
    return chunks.withColumn("text", F.concat_ws("\n\n", F.nullif(F.col("text"), F.lit("")), block)).drop("labels")
