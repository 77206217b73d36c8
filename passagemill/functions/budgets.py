"""Token and character budgets: integer arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import constants as K


def _lit(value: Column | int) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def clamp(value: Column | int, low: Column | int, high: Column | int) -> Column:
    return F.least(F.greatest(_lit(value), _lit(low)), _lit(high))


def output_tokens(requested: Column, instructions: int = K.INSTRUCTION_TOKENS) -> Column:
    top = max(K.CONTEXT_WINDOW - instructions - K.PROMPT_OVERHEAD_TOKENS - K.MIN_CONTEXT_TOKENS, 1)
    return clamp(requested, 1, top)


def available_context_tokens(requested: Column) -> Column:
    free = K.CONTEXT_WINDOW - K.INSTRUCTION_TOKENS - K.PROMPT_OVERHEAD_TOKENS - output_tokens(requested)
    return F.greatest(free, F.lit(K.MIN_CONTEXT_TOKENS))


def context_tokens(requested: Column, output: Column) -> Column:
    low, high = K.CONTEXT_TOKENS_RANGE
    upper = F.least(F.lit(high), available_context_tokens(output))
    return clamp(requested, F.least(F.lit(low), upper), upper)


def context_chars(output: Column, share: float, instructions: int = K.INSTRUCTION_TOKENS) -> Column:
    free = K.CONTEXT_WINDOW - instructions - K.PROMPT_OVERHEAD_TOKENS - output_tokens(output, instructions)
    chars = F.greatest(free, F.lit(0)) * K.CHARS_PER_TOKEN
    return F.floor(chars.cast("double") * F.lit(share)).cast("int")


def tool_response_tokens(requested: Column) -> Column:
    return output_tokens(requested, K.INSTRUCTION_TOKENS + K.TOOL_OVERHEAD_TOKENS)


def _tool_room(requested: Column) -> Column:
    return (K.CONTEXT_WINDOW - K.INSTRUCTION_TOKENS - K.TOOL_OVERHEAD_TOKENS - K.PROMPT_OVERHEAD_TOKENS
            - tool_response_tokens(requested))


def tool_reply_tokens(requested: Column) -> Column:
    wanted = F.greatest(F.lit(K.TOOL_REPLY_FLOOR), tool_response_tokens(requested) * 2)
    room = F.floor(F.greatest(_tool_room(requested), F.lit(0)) / K.CONCURRENT_REPLIES).cast("int")
    return F.least(wanted, room)


def web_reply_tokens(requested: Column) -> Column:
    return F.least(tool_reply_tokens(requested), F.lit(K.WEB_REPLY_CAP))


def grounding_chars(requested: Column) -> Column:
    return context_chars(requested, 1.0, K.INSTRUCTION_TOKENS + K.TOOL_OVERHEAD_TOKENS)


def hybrid_grounding_chars(requested: Column, reserved: Column) -> Column:
    free = _tool_room(requested) - F.greatest(reserved, F.lit(0))
    return F.greatest(free, F.lit(0)) * K.CHARS_PER_TOKEN


def chars_of_tokens(count: Column) -> Column:
    return F.greatest(count, F.lit(0)) * K.CHARS_PER_TOKEN


def sentences_of_tokens(count: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars_of_tokens(count) / K.CHARS_PER_SENTENCE).cast("int"))


def words_of_tokens(count: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars_of_tokens(count) / K.CHARS_PER_WORD).cast("int"))


def tokens_of_words(count: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.greatest(count, F.lit(0)) * K.CHARS_PER_WORD / K.CHARS_PER_TOKEN).cast("int"))


def tokens_of_chars(count: Column) -> Column:
    return F.ceil(F.greatest(count, F.lit(0)) / K.CHARS_PER_TOKEN).cast("int")


def chat_scrape_chars(count: Column) -> Column:
    low, high = K.SCRAPE_CHARS_RANGE
    return clamp(chars_of_tokens(clamp(count, *K.CONTEXT_TOKENS_RANGE)) * 2, low, high)


def search_scrape_chars(count: Column) -> Column:
    return F.greatest(chars_of_tokens(count) * 2, F.lit(K.SCRAPE_CHARS_RANGE[0]))


def provider_results(count: Column) -> Column:
    return clamp(count, K.RESULTS_RANGE[0], K.PROVIDER_RESULTS_CAP)
