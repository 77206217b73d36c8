"""Text preparation as Catalyst expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K

# Splitting mark: a Unicode non-character, so it never occurs in valid text.
_MARK = "\uFDD0"
_BLANKS = " \t\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202F\u205F\u3000"
_WHITE = _BLANKS + "\n\r\u000B\u000C\u0085\u2028\u2029"
_WORD_START = "(?<![\\p{L}\\p{N}])(?=[\\p{L}\\p{N}])"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_all(column: Column | str) -> Column:
    """Trim all Unicode white space, newlines included."""
    return F.btrim(_col(column), F.lit(_WHITE))


def trim_line(column: Column | str) -> Column:
    """Trim horizontal white space only."""
    return F.btrim(_col(column), F.lit(_BLANKS))


def non_blank(column: Column | str) -> Column:
    """Trimmed text, or null when nothing is left."""
    trimmed = trim_all(column)
    return F.when(trimmed != "", trimmed)


def normalize_ws(column: Column | str) -> Column:
    """Collapse horizontal runs to one space and blank-line runs to one paragraph break."""
    text = F.regexp_replace(_col(column), K.HORIZONTAL_SPACE, " ")
    # Without blanks before newlines, a run of blank lines is a run of newlines.
    text = F.regexp_replace(text, "[ \\t]+\n", "\n")
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def code_point_text(number: Column) -> Column:
    """The character of a code point; null for surrogates and numbers out of range."""
    valid = ((number >= 0) & (number < 0xD800)) | ((number > 0xDFFF) & (number <= 0x10FFFF))
    # UTF-32 big endian: four bytes per code point.
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def decode_entities(column: Column | str) -> Column:
    """Decode named, decimal and hexadecimal references once; unknown references stay."""
    text = _col(column)
    # Cut the text at every reference; odd pieces are references. One pass, so a decoded '&' is never
    # combined with what follows it.
    reference = "&(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]+);"
    pieces = F.split(F.regexp_replace(text, f"({reference})", f"{_MARK}$1{_MARK}"), _MARK)
    names = F.create_map(*[F.lit(v) for pair in K.PAGE_ENTITIES.items() for v in pair])

    def decoded(piece: Column) -> Column:
        body = F.substring(piece, F.lit(2), F.length(piece))
        body = F.substring_index(body, ";", 1)
        hexadecimal = F.conv(F.regexp_extract(body, "^#x0*([0-9A-Fa-f]{1,8})$", 1), 16, 10).cast("long")
        decimal = F.regexp_extract(body, "^#0*([0-9]{1,8})$", 1).try_cast("long")
        value = (
            F.when(body.startswith("#x"), code_point_text(hexadecimal))
            .when(body.startswith("#"), code_point_text(decimal))
            .otherwise(F.try_element_at(names, body))
        )
        return F.coalesce(value, piece)

    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, decoded(p)).otherwise(p)), "")
    return F.when(text.rlike(reference), rebuilt).otherwise(text)


def drop_elements(column: Column | str) -> Column:
    """Remove non-content elements together with what they contain."""
    names = "|".join(K.DROPPED_ELEMENTS)
    return F.regexp_replace(_col(column), f"(?is)<({names})[^>]*>.*?</\\1>", "")


def html_to_text(column: Column | str, max_chars: int | None = None, tables: bool = True) -> Column:
    """Readable text of an HTML page; ``max_chars`` cuts it to a page budget."""
    from .markup import tables_to_markdown

    html = tables_to_markdown(column) if tables else _col(column)
    text = F.regexp_replace(drop_elements(html), "(?s)<!--.*?-->", "")
    text = decode_entities(F.regexp_replace(text, "<[^>]+>", " "))
    text = trim_all(normalize_ws(text))
    return text if max_chars is None else F.substring(text, 1, max_chars)


def snippet_text(column: Column | str) -> Column:
    """Plain text of a result snippet: tags vanish, entities become ASCII one after the other."""
    text = F.regexp_replace(_col(column), "<[^>]+>", "")
    for entity, plain in K.SNIPPET_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    pieces = F.split(F.regexp_replace(text, "(&#\\d+;)", f"{_MARK}$1{_MARK}"), _MARK)

    def decoded(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^&#0*([0-9]{1,8});$", 1).try_cast("long")
        return F.coalesce(code_point_text(number), piece)

    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, decoded(p)).otherwise(p)), "")
    return trim_all(F.when(text.rlike("&#\\d+;"), rebuilt).otherwise(text))


def tokens(column: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(_col(column)), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def terms(column: Column | str) -> Column:
    """Distinct tokens longer than two characters."""
    return F.array_distinct(F.filter(tokens(column), lambda t: F.length(t) > 2))


def truncate_words(column: Column | str, words: int) -> Column:
    """Text up to the start of word n + 1, trimmed; unchanged when there are no more than n words."""
    text = _col(column)
    if words <= 0:
        return F.lit("")
    # Every piece but a leading one without a word starts a word; the limit keeps the rest in one piece.
    pieces = F.split(text, _WORD_START, words + 2)
    kept = words + F.when(text.rlike("^[\\p{L}\\p{N}]"), 0).otherwise(1)
    return F.when(F.size(pieces) > kept, trim_all(F.array_join(F.slice(pieces, F.lit(1), kept), ""))).otherwise(text)


def paragraphs(column: Column | str) -> Column:
    """Blank-line separated blocks, blank ones dropped."""
    flat = F.regexp_replace(_col(column), "\n[ \\t]*\n([ \\t]*\n)*", "\n\n")
    return F.filter(F.split(flat, "\n\n"), lambda p: trim_all(p) != "")


def sentences(column: Column | str) -> Column:
    """Pieces ending in . ! or ? before white space, trimmed, blanks dropped."""
    pieces = F.split(F.regexp_replace(_col(column), "([.!?])\\s+", f"$1{_MARK}"), _MARK)
    return F.filter(F.transform(pieces, trim_all), lambda s: s != "")


def safe_segments(column: Column | str) -> Column:
    """End offsets of the pieces that can be shown on their own: after . ! ? before white space or the end,
    after a newline, after a closed display formula; never inside a formula.

    A fold over the marks of the text; offsets count characters from the start.
    """
    text = _col(column)

    def step(state: Column, item: Column) -> Column:
        piece = item["piece"]
        at = state["at"] + F.length(piece)
        bracket = (state["bracket"] + F.when(piece == "\\[", 1).otherwise(0)
                   - F.when((piece == "\\]") & (state["bracket"] > 0), 1).otherwise(0))
        paren = (state["paren"] + F.when(piece == "\\(", 1).otherwise(0)
                 - F.when((piece == "\\)") & (state["paren"] > 0), 1).otherwise(0))
        display = F.when(piece == "$$", ~state["display"]).otherwise(state["display"])
        inline = F.when(piece == "$", ~state["inline"] & ~_digit_beside(item)).otherwise(state["inline"])
        closed = (bracket == 0) & (paren == 0) & ~inline & ~display
        following = F.when(item["after"] != "", item["after"]).otherwise(item["next"])
        ends = (piece == "\\]") | (piece == "$$") | (piece == "\n") | (
            piece.isin(".", "!", "?") & following.rlike("^(?:[ \\n\\r\\t]|\\z)"))
        moved = F.struct(bracket.alias("bracket"), paren.alias("paren"), inline.alias("inline"), display.alias("display"))
        rest = F.struct(*[state[c].alias(c) for c in ("bracket", "paren", "inline", "display")])
        now = F.when(item["is_mark"], moved).otherwise(rest)
        return F.struct(
            at.alias("at"), *[now[c].alias(c) for c in ("bracket", "paren", "inline", "display")],
            F.when(item["is_mark"] & closed & ends, F.array_append(state["out"], at)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("bracket"), F.lit(0).alias("paren"),
                     F.lit(False).alias("inline"), F.lit(False).alias("display"),
                     F.array().cast("array<int>").alias("out"))
    marks = "(?s)(\\\\.|\\$\\$|\\$|[.!?]|\n)"
    return F.aggregate(marked_pieces(text, marks), start, step, lambda s: F.array_distinct(s["out"]))


def headings_to_bold(column: Column | str) -> Column:
    """Markdown heading lines become bold lines."""
    text = F.regexp_replace(_col(column), "(?m)^\\s*#{1,6}\\s*(.+?)\\s*#{0,6}\\s*$", "**$1**")
    return F.regexp_replace(text, "(?m)^\\s*#{1,6}\\s*(.+?)\\s*$", "**$1**")


def digit_powers(column: Column | str) -> Column:
    """``10^6`` and ``10^{6}`` in upright formula notation; of the two ways to write an exponent one group is empty."""
    power = "(?<!\\\\mathrm\\{)([0-9]+)\\^(?:\\{([^{}]+)\\}|(-?[0-9]+))"
    return F.regexp_replace(_col(column), power, "\\\\mathrm{$1}^\\\\mathrm{$2$3}")


def split_commands(column: Column | str) -> Column:
    """Put spaces around known formula commands."""
    # No command is the beginning of another, so one pass before and one behind find them all.
    names = "|".join(K.FORMULA_COMMANDS)
    text = F.regexp_replace(_col(column), f"(?<!\\s)(\\\\(?:{names}))", " $1")
    text = F.regexp_replace(text, f"(\\\\(?:{names}))(?=[A-Za-z0-9])", "$1 ")
    return F.when(_col(column).contains("\\"), text).otherwise(_col(column))


def marked_pieces(text: Column, marks: str) -> Column:
    """Text cut at every mark: array of (piece, before, after, next, is_mark) in order.

    Folds read the neighbours from the element, so no lambda goes back to the whole array.
    """
    pieces = F.split(F.regexp_replace(text, marks, f"{_MARK}$1{_MARK}"), _MARK)
    none = F.lit("")
    shifted = lambda by: F.concat(F.slice(pieces, F.lit(by + 1), F.size(pieces)), F.array_repeat(none, by))
    paired = F.zip_with(pieces, F.concat(F.array(none), F.slice(pieces, F.lit(1), F.size(pieces) - 1)),
                        lambda piece, before: F.struct(piece.alias("piece"), before.alias("before")))
    ahead = F.zip_with(shifted(1), shifted(2), lambda a, n: F.struct(
        F.coalesce(a, none).alias("after"), F.coalesce(n, none).alias("next")))
    both = F.zip_with(paired, ahead, lambda p, n: F.struct(
        p["piece"].alias("piece"), p["before"].alias("before"), n["after"].alias("after"), n["next"].alias("next")))
    return F.transform(both, lambda p, i: F.struct(
        p["piece"].alias("piece"), p["before"].alias("before"), p["after"].alias("after"), p["next"].alias("next"),
        (i % 2 == 1).alias("is_mark")))


def _digit_beside(mark: Column) -> Column:
    return mark["before"].rlike("\\p{N}\\z") | mark["after"].rlike("^\\p{N}")


def escape_currency(column: Column | str) -> Column:
    """Escape dollars that are currency; dollars that open or close a formula stay.

    A fold over the pieces between dollar marks carries one flag: is a formula open.
    """
    text = _col(column)

    def step(state: Column, item: Column) -> Column:
        single = item["is_mark"] & (item["piece"] == "$")
        currency = single & ~state["open"] & _digit_beside(item)
        return F.struct(
            F.when(single & ~currency, ~state["open"]).otherwise(state["open"]).alias("open"),
            F.array_append(state["out"], F.when(currency, F.lit("\\$")).otherwise(item["piece"])).alias("out"))

    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(marked_pieces(text, "(\\\\\\$|\\$\\$|\\$)"), start, step, lambda s: F.array_join(s["out"], ""))
    return F.when(text.contains("$"), folded).otherwise(text)


def clean_answer(column: Column | str) -> Column:
    """All answer clean-up steps in their fixed order."""
    return headings_to_bold(digit_powers(split_commands(escape_currency(column))))


def strip_document_wrappers(column: Column | str) -> Column:
    """Body of a typeset document without preamble lines."""
    text = trim_all(column)
    body = F.regexp_extract(text, "(?s)^.*?\\\\begin\\{document\\}(.*)$", 1)
    inner = F.substring_index(body, "\\end{document}", 1)
    closed = body.contains("\\end{document}") & (
        F.instr(text, "\\begin{document}") < F.instr(text, "\\end{document}"))
    text = F.when(closed, trim_all(inner)).otherwise(text)
    for command in ("documentclass", "usepackage"):
        text = F.regexp_replace(text, f"(?m)^\\s*\\\\{command}(?:\\[[^\\]]*\\])?\\{{[^}}]*\\}}\\s*$", "")
    for mark in ("\\begin{document}", "\\end{document}"):
        text = F.replace(text, F.lit(mark), F.lit(""))
    return trim_all(text)
