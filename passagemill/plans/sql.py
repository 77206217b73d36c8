"""SQL fragments shared by the SQL twins."""

from __future__ import annotations

from ..functions import constants as K

WHITE = "[\\s\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\v]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"


def trim(x: str) -> str:
    return replace_all(x, f"\\A{WHITE}+|{WHITE}+\\z", "")


def normalized(x: str) -> str:
    x = replace_all(x, "[ \\t\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]+", " ")
    x = replace_all(x, "[ \\t]+\\n", "\n")
    return replace_all(x, "\\n{3,}", "\n\n")


def entities(x: str) -> str:
    for name, char in K.PAGE_ENTITIES.items():
        if name != "amp":
            x = f"replace({x}, '&{name};', {quoted(char)})"
    return f"replace({x}, '&amp;', '&')"


def snippet(x: str) -> str:
    x = replace_all(x, "<[^>]+>", "")
    for entity, char in K.SNIPPET_ENTITIES:
        x = f"replace({x}, {quoted(entity)}, {quoted(char)})"
    return trim(x)


def page_text(html: str) -> str:
    blocks = "|".join(f"<{t}[^>]*>.*?</{t}>" for t in K.DROPPED_ELEMENTS)
    x = replace_all(html, f"(?is){blocks}", "")
    x = replace_all(x, "(?s)<!--.*?-->", "")
    x = replace_all(x, "<[^>]+>", " ")
    return trim(normalized(entities(x)))


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def terms(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) > 2))"


def any_of(x: str, cues) -> str:
    return "(" + " OR ".join(f"contains({x}, {quoted(c)})" for c in cues) + ")"


def numeric_intent(x: str) -> str:
    return (f"(regexp_matches({x}, '\\p{{Nd}}') OR {any_of(f'lower({x})', K.NUMERIC_SIGNS)}"
            f" OR {any_of(f'lower({x})', K.NUMERIC_CUES)})")


def temporal_intent(x: str) -> str:
    return any_of(f"lower({x})", K.TEMPORAL_CUES)


def word_intent(x: str, words) -> str:
    listed = ", ".join(quoted(w) for w in words)
    return f"list_has_any({tokens(x)}, [{listed}])"


def numeric_tokens(x: str) -> str:
    pattern = "[-+]?\\d+(?:[.,\\x{00A0}\\x{202F} ]\\d+)*(?:%|°[CcFfKk]?|[a-zA-Z]{1,4})?"
    raw = f"list_transform(regexp_extract_all({x}, {quoted(pattern)}), lambda t: lower(t))"
    digits = f"list_transform({raw}, lambda t: regexp_replace(t, '\\P{{N}}', '', 'g'))"
    return f"list_distinct(list_filter(list_concat({raw}, {digits}), lambda t: t <> ''))"


def equation_references(x: str) -> str:
    pattern = K.EQUATION_REFERENCE
    both = (f"list_distinct(list_filter(list_concat(regexp_extract_all({x}, {quoted(pattern)}, 1), "
            f"regexp_extract_all({x}, {quoted(pattern)}, 2)), lambda t: t <> ''))")
    short = f"list_filter({numeric_tokens(x)}, lambda t: regexp_full_match(t, '\\p{{N}}{{1,3}}'))"
    return f"CASE WHEN len({both}) > 0 THEN {both} WHEN {word_intent(x, K.EQUATION_WORDS)} THEN {short} ELSE [] END"


def figure_references(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {quoted(K.FIGURE_REFERENCE)}, 1))"


def page_references(x: str) -> str:
    return f"list_distinct(regexp_extract_all({x}, {quoted(K.PAGE_REFERENCE)}, 1))"


def formula(x: str) -> str:
    return any_of(f"lower({x})", K.FORMULA_MARKS)


def figure_cue(x: str) -> str:
    return any_of(f"lower({x})", K.FIGURE_MARKS)


def folded(x: str) -> str:
    return trim(replace_all(f"lower(strip_accents({x}))", "\\s+", " "))


def query_terms(x: str) -> str:
    return (f"list_distinct(list_filter(string_split_regex({folded(x)}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+'), "
            "lambda t: length(t) >= 3))")


def sentences(x: str) -> str:
    marked = replace_all(x, "([.!?])\\s+", "\\1\uFDD0")
    return f"list_filter(list_transform(string_split({marked}, '\uFDD0'), lambda s: {trim('s')}), lambda s: s <> '')"


def word_pieces(x: str) -> str:
    """Words with what follows each."""
    return f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*')"


def first_words(x: str, pieces: str, n: int) -> str:
    return f"regexp_extract({x}, '^[^\\p{{L}}\\p{{N}}]*') || array_to_string({pieces}[1:{n}], '')"


def unnest_at(sql_list: str, at: str, value: str) -> str:
    """Select items that unnest a list with zero-based positions."""
    return f"unnest(range(len({sql_list}))) AS {at}, unnest({sql_list}) AS {value}"


def joined_sorted(sql_list: str) -> str:
    return f"array_to_string(list_sort({sql_list}), ' ')"


def scored_pairs(queries: str, passages: str, method: str = "overlap") -> str:
    """CTEs ending in ``scored(query_id, doc_id, chunk_no, n_chars, entry_len, score)``: every query with every passage."""
    q_keys = (f"qt AS (SELECT query_id, t.term, count(*) AS tf FROM (SELECT query_id, unnest({tokens('query')}) AS term "
              "FROM q) t WHERE length(term) > 2 GROUP BY ALL)")
    p_keys = (f"pt AS (SELECT doc_id, chunk_no, t.term, count(*) AS tf FROM (SELECT doc_id, chunk_no, "
              f"unnest({tokens('text')}) AS term FROM p) t WHERE length(term) > 2 GROUP BY ALL)")
    base = "count(*)" if method == "overlap" else "sum(qt.tf * pt.tf)"
    norms = "" if method == "overlap" else (
        ", qn AS (SELECT query_id, sqrt(sum(tf * tf)) AS qn FROM qt GROUP BY 1)"
        ", pn AS (SELECT doc_id, chunk_no, sqrt(sum(tf * tf)) AS pn FROM pt GROUP BY 1, 2)")
    part = "coalesce(m.base, 0)" if method == "overlap" else "coalesce(m.base / (qn.qn * pn.pn), 0)"
    norm_joins = "" if method == "overlap" else (
        " LEFT JOIN qn ON qn.query_id = qf.query_id LEFT JOIN pn ON pn.doc_id = pf.doc_id AND pn.chunk_no = pf.chunk_no")
    usable = "qf.has_terms" if method == "overlap" else "qf.has_terms AND pn.pn IS NOT NULL"
    shared = "len(list_intersect(qf.{0}, pf.{0}))"
    figure = (f"(CASE WHEN {shared.format('figures')} > 0 THEN {shared.format('figures')} * {K.FIGURE_MATCH_BONUS} + "
              f"(CASE WHEN pf.cue THEN {K.FIGURE_CAPTION_BONUS} ELSE 0 END) ELSE 0 END + "
              f"CASE WHEN list_contains(qf.pages, CAST(pf.page AS VARCHAR)) THEN {K.FIGURE_PAGE_BONUS} + "
              f"(CASE WHEN pf.cue THEN {K.FIGURE_CAPTION_BONUS} ELSE 0 END) ELSE 0 END)")
    return f"""q AS ({queries}), p AS ({passages}), {q_keys}, {p_keys}{norms},
m AS (SELECT query_id, doc_id, chunk_no, {base} AS base FROM qt JOIN pt USING (term) GROUP BY ALL),
qf AS (SELECT query_id, len({terms('query')}) > 0 AS has_terms, {numeric_tokens('query')} AS numbers,
  {numeric_intent('query')} AS numeric_intent, {word_intent('query', K.EQUATION_WORDS)} AS equation,
  {equation_references('query')} AS refs, {word_intent('query', K.FIGURE_WORDS)} AS figure,
  {figure_references('query')} AS figures, {page_references('query')} AS pages FROM q),
pf AS (SELECT doc_id, chunk_no, page, length(text) AS n_chars, length(text) + length(source) + 9 AS entry_len,
  {numeric_tokens('text')} AS numbers, regexp_matches(text, '\\p{{Nd}}') AS any_number,
  {equation_references('text')} AS refs, {formula('text')} AS formula,
  {figure_references('text')} AS figures, {figure_cue('text')} AS cue FROM p),
scored AS (SELECT qf.query_id, pf.doc_id, pf.chunk_no, pf.n_chars, pf.entry_len,
  CASE WHEN NOT ({usable}) THEN 0 ELSE round({part}
    + CASE WHEN pf.n_chars > {K.LONG_CHUNK_CHARS} THEN {K.LONG_CHUNK_BONUS} ELSE 0 END
    + CASE WHEN len(qf.numbers) > 0 THEN {shared.format('numbers')} * {K.NUMBER_MATCH_BONUS}
           WHEN qf.numeric_intent AND pf.any_number THEN {K.NUMBER_PRESENCE_BONUS} ELSE 0 END
    + CASE WHEN NOT qf.equation THEN 0
           WHEN len(qf.refs) > 0 THEN CASE WHEN {shared.format('refs')} > 0 THEN {shared.format('refs')} * {K.EQUATION_MATCH_BONUS}
             + (CASE WHEN pf.formula THEN {K.EQUATION_FORMULA_BONUS} ELSE 0 END) ELSE 0 END
           WHEN pf.formula THEN {K.EQUATION_PRESENCE_BONUS} ELSE 0 END
    + CASE WHEN NOT qf.figure THEN 0 WHEN {figure} > 0 THEN {figure}
           WHEN pf.cue THEN {K.FIGURE_PRESENCE_BONUS} ELSE 0 END, 9) END AS score
  FROM qf CROSS JOIN pf LEFT JOIN m ON m.query_id = qf.query_id AND m.doc_id = pf.doc_id AND m.chunk_no = pf.chunk_no{norm_joins})"""
