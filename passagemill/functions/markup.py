"""Tables inside HTML and inside plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import _MARK, _col, decode_entities, trim_all, trim_line

_TABLE = "(?is)<table[^>]*>(.*?)</table>"
_ROW = "(?is)<tr[^>]*>(.*?)</tr>"
_CELL = "(?is)<(t[dh])[^>]*>(.*?)</\\1>"


def cell_text(cell: Column) -> Column:
    """Text of one table cell, safe inside a Markdown row."""
    text = F.regexp_replace(decode_entities(F.regexp_replace(cell, "<[^>]+>", " ")), "\\s+", " ")
    return trim_all(F.replace(text, F.lit("|"), F.lit("\\|")))


def table_rows(table: Column) -> Column:
    """Rows of cells of one table body; rows without any content are dropped."""
    rows = F.transform(
        F.regexp_extract_all(table, F.lit(_ROW), 1),
        lambda row: F.transform(F.regexp_extract_all(row, F.lit(_CELL), 2), cell_text),
    )
    return F.filter(rows, lambda cells: F.exists(cells, lambda c: c != ""))


def html_tables(column: Column | str) -> Column:
    """All tables of a page: array of rows of cells each."""
    return F.transform(F.regexp_extract_all(_col(column), F.lit(_TABLE), 1), table_rows)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is read; the optimizer keeps no common parts of lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def markdown_table(rows: Column) -> Column:
    """Markdown text of rows of cells, padded to the widest row; first row is the header."""
    padded = lambda cells, width: F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    rule = lambda width: F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    lines = lambda width: F.transform(rows, lambda cells: F.concat(F.lit("| "), F.array_join(padded(cells, width), " | "), F.lit(" |")))
    text = lambda width: bound(lines(width), lambda lines: F.array_join(F.concat(
        F.slice(lines, 1, 1), F.array(rule(width)), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))
    return bound(F.array_max(F.transform(rows, F.size)), text)


def tables_to_markdown(column: Column | str) -> Column:
    """Replace every HTML table by its Markdown text between blank lines."""
    html = _col(column)
    # Odd pieces are table bodies.
    pieces = F.split(F.regexp_replace(html, _TABLE, f"{_MARK}$1{_MARK}"), _MARK)

    def block(piece: Column) -> Column:
        return bound(table_rows(piece), lambda rows: F.when(
            F.size(rows) > 0, F.concat(F.lit("\n\n"), markdown_table(rows), F.lit("\n\n"))).otherwise(""))

    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, block(p)).otherwise(p)), "")
    return F.when(html.rlike("(?i)<table[^>]*>"), rebuilt).otherwise(html)


def aligned_cells(line: Column) -> Column:
    """Cells of a text line cut at runs of two or more blanks; single blanks stay inside a cell."""
    body = F.regexp_replace(line, "^[ \\t\\u00A0]+|[ \\t\\u00A0]+$", "")
    cells = F.transform(F.split(body, "[ \\t\\u00A0]{2,}"),
                        lambda c: trim_line(F.regexp_replace(c, "[ \\t\\u00A0]", " ")))
    return F.filter(cells, lambda c: c != "")


def _modal_width(rows: Column) -> Column:
    """Most frequent number of cells; the smaller one wins a tie."""
    sizes = F.transform(rows, F.size)
    ranked = F.transform(F.array_distinct(sizes), lambda s: F.struct(
        F.size(F.filter(sizes, lambda t: t == s)).alias("n"), (-s).alias("minus_width")))
    return -F.array_max(ranked)["minus_width"]


def _fitted(cells: Column, width: Column) -> Column:
    """Cells padded to the width; surplus cells join the last one."""
    short = F.concat(cells, F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    long = F.concat(F.slice(cells, F.lit(1), width - 1), F.array(F.array_join(F.slice(cells, width, F.size(cells)), " ")))
    return F.when(F.size(cells) > width, long).otherwise(short)


def aligned_text_to_tables(column: Column | str) -> Column:
    """Turn runs of lines whose columns are aligned with blanks into Markdown tables.

    A fold over the lines of one text gathers runs of wide rows, then every run is formatted; texts
    without a line of three cells are returned untouched.
    """
    text = _col(column)
    lines = F.transform(F.split(text, "\n"), lambda line: F.struct(line.alias("line"), aligned_cells(line).alias("cells")))
    no_rows = F.array().cast("array<array<string>>")
    start = F.struct(F.array().cast("array<struct<line:string,rows:array<array<string>>>>").alias("done"), no_rows.alias("rows"))

    def gather(state: Column, item: Column) -> Column:
        is_row = F.size(item["cells"]) >= 3
        run = F.struct(F.lit(None).cast("string").alias("line"), state["rows"].alias("rows"))
        closed = F.when(F.size(state["rows"]) > 0, F.array_append(state["done"], run)).otherwise(state["done"])
        plain = F.array_append(closed, F.struct(item["line"].alias("line"), no_rows.alias("rows")))
        return F.struct(F.when(is_row, state["done"]).otherwise(plain).alias("done"),
                        F.when(is_row, F.array_append(state["rows"], item["cells"])).otherwise(no_rows).alias("rows"))

    runs = F.aggregate(lines, start, gather, lambda s: F.when(F.size(s["rows"]) > 0, F.array_append(
        s["done"], F.struct(F.lit(None).cast("string").alias("line"), s["rows"].alias("rows")))).otherwise(s["done"]))
    sized = F.transform(runs, lambda r: F.struct(r["line"].alias("line"), r["rows"].alias("rows"),
                                                 F.when(F.size(r["rows"]) >= 2, _modal_width(r["rows"])).alias("width")))
    row_text = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    def shown(run: Column) -> Column:
        rows = F.transform(run["rows"], lambda cells: row_text(_fitted(cells, run["width"])))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), run["width"]))
        whole = F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(run["rows"])))
        return F.coalesce(run["line"], F.when(run["width"].isNotNull(), F.array_join(whole, "\n")),
                          F.array_join(F.get(run["rows"], F.lit(0)), " "))

    folded = F.array_join(F.transform(sized, shown), "\n")
    has_wide_line = text.rlike("(?m)^[ \\t\\u00A0]*[^ \\t\\u00A0\\n]+(?:[ \\t\\u00A0][^ \\t\\u00A0\\n]+)*+[ \\t\\u00A0]{2,}"
                               "[^ \\t\\u00A0\\n]+(?:[ \\t\\u00A0][^ \\t\\u00A0\\n]+)*+[ \\t\\u00A0]{2,}[^ \\t\\u00A0\\n]")
    return F.when(has_wide_line, folded).otherwise(text)
