"""What a query asks for and what a passage contains, as columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import _col, tokens


def _any_of(lowered: Column, cues: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (lowered.contains(cue) for cue in cues))


def _any_word(lowered: Column, cues: Iterable[str]) -> Column:
    # One alternation instead of one scan per cue.
    escaped = "|".join(cue.replace("'", "\\'") for cue in sorted(cues, key=len, reverse=True))
    return lowered.rlike(f"(?<![\\p{{L}}\\p{{N}}])(?:{escaped})(?![\\p{{L}}\\p{{N}}])")


def any_number(column: Column | str) -> Column:
    return _col(column).rlike("\\p{Nd}")


def has_numeric_intent(column: Column | str, strict: bool = False) -> Column:
    """A digit, a percent or currency sign, or a quantity cue; strict matches cues as whole words."""
    lowered = F.lower(_col(column))
    cues = _any_word(lowered, K.NUMERIC_CUES) if strict else _any_of(lowered, K.NUMERIC_CUES)
    return any_number(lowered) | _any_of(lowered, K.NUMERIC_SIGNS) | cues


def has_temporal_intent(column: Column | str, strict: bool = False) -> Column:
    """A cue for recent or current matters; strict matches cues as whole words."""
    lowered = F.lower(_col(column))
    return _any_word(lowered, K.TEMPORAL_CUES) if strict else _any_of(lowered, K.TEMPORAL_CUES)


def has_equation_intent(column: Column | str) -> Column:
    return F.arrays_overlap(tokens(column), F.lit(list(K.EQUATION_WORDS)))


def has_figure_intent(column: Column | str) -> Column:
    return F.arrays_overlap(tokens(column), F.lit(list(K.FIGURE_WORDS)))


def formula_syntax(column: Column | str) -> Column:
    return _any_of(F.lower(_col(column)), K.FORMULA_MARKS)


def figure_cue(column: Column | str) -> Column:
    return _any_of(F.lower(_col(column)), K.FIGURE_MARKS)


def numeric_tokens(column: Column | str) -> Column:
    """Distinct lower-cased number tokens together with their digits-only forms."""
    raw = F.transform(F.regexp_extract_all(_col(column), F.lit(K.NUMBER_TOKEN), 0), F.lower)
    digits = F.filter(F.transform(raw, lambda t: F.regexp_replace(t, "\\P{N}", "")), lambda t: t != "")
    found = F.array_distinct(F.concat(raw, digits))
    return F.when(any_number(column), found).otherwise(F.array().cast("array<string>"))


def equation_references(column: Column | str) -> Column:
    """Numbers of referenced equations; with intent but no reference, short plain numbers."""
    text = _col(column)
    found = F.array_distinct(F.filter(F.concat(
        F.regexp_extract_all(text, F.lit(K.EQUATION_REFERENCE), 1),
        F.regexp_extract_all(text, F.lit(K.EQUATION_REFERENCE), 2)), lambda n: n != ""))
    short = F.filter(numeric_tokens(text), lambda t: t.rlike("^\\p{N}{1,3}$"))
    none = F.array().cast("array<string>")
    return (F.when(~any_number(text), none).when(F.size(found) > 0, found)
            .when(has_equation_intent(text), short).otherwise(none))


def figure_references(column: Column | str) -> Column:
    """Numbers of referenced figures."""
    text = _col(column)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(K.FIGURE_REFERENCE), 1))
    return F.when(any_number(text), found).otherwise(F.array().cast("array<string>"))


def requested_pages(column: Column | str) -> Column:
    """Page numbers a query names."""
    text = _col(column)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(K.PAGE_REFERENCE), 1))
    return F.when(any_number(text), found).otherwise(F.array().cast("array<string>"))
