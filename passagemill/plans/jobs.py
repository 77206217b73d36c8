"""End-to-end jobs: search and summarise, chat turns, tool calls.

Each is a plain composition of operators; intermediate tables are ordinary DataFrames, so a job can start
from a persisted chunk table instead of raw documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions import budgets as B, constants as K
from ..functions.text import trim_all, truncate_words
from ..operators import chunking as C, merging as M, scoring as S, selection as Z, threads as T
from ..scale import broadcast_if_small
from ..session import checkpointed


def cite_best(queries: DataFrame, chunks: DataFrame, k: int = K.TOP_CITATIONS, lang: str = "en") -> DataFrame:
    """Citations of the best passages of every query: (query_id, citations)."""
    top = S.top_chunks(queries, chunks, k)
    named = chunks.select(*S.CHUNK_ID, "source", "url", "page").join(broadcast_if_small(top), S.CHUNK_ID)
    return Z.citation_block(named, lang)


def search_and_summarise(queries: DataFrame, results: DataFrame, page_texts: DataFrame, response_tokens: int = 500,
                         merged_limit: int = 8, profile: str = "fast", lang: str = "en") -> dict[str, DataFrame]:
    """One question per row to merged results, packed context, shares, re-ranked results and citations.

    queries (query_id, query); results (query_id, list_no, pos, url, title, snippet, retrieved);
    page_texts (url, text). Citations are those of the best passages, packed or not.
    """
    merged = checkpointed(M.interleave(results, merged_limit).withColumn(
        "doc_id", F.xxhash64("url", "title", "snippet", "retrieved")))
    owners = merged.select("query_id", "doc_id")
    # Equal results of several questions are one document.
    fetched = merged.select("doc_id", "url", "title", "snippet", "retrieved").dropDuplicates(["doc_id"])
    docs = C.content_ladder(fetched, page_texts).select(
        "doc_id", F.col("title").alias("source"), "url", F.lit(None).cast("int").alias("page"), "rung", "text")
    chunks = checkpointed(C.chunk(docs, *K.WEB_CHUNK))
    free = K.CONTEXT_WINDOW - K.INSTRUCTION_TOKENS - K.PROMPT_OVERHEAD_TOKENS - response_tokens
    chars = int(free * K.CHARS_PER_TOKEN * K.UTILISATION[profile])
    scored = Z.score_own(queries, chunks, owners)
    selected = checkpointed(Z.select_own_context(queries, scored, chars))
    shares = Z.source_share(selected.join(chunks.select(*S.CHUNK_ID, "url"), S.CHUNK_ID))
    percent = checkpointed(Z.rebalance_percent(shares, merged.select("query_id", "url")))
    shown = merged.select("query_id", F.col("merged_pos").alias("pos"), "url", "title")
    by_query = Window.partitionBy("query_id").orderBy(*S.rank_order())
    top = scored.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= K.TOP_CITATIONS)
    named = chunks.select(*S.CHUNK_ID, "source", "url", "page").join(top, S.CHUNK_ID)
    return {"merged": merged, "selected": selected, "context": Z.context_text(selected, chunks, chars),
            "percent": percent, "reranked": Z.rerank_results(shown, percent),
            "citations": Z.citation_block(named, lang),
            "rungs": chunks.filter(F.col("chunk_no") == 0).join(owners, "doc_id").select("query_id", "url", "rung")}


def deep_search(sessions: DataFrame, results: DataFrame, response_tokens: int = 500, web_cap: int = 6,
                encyclopedia_cap: int = 2, derived: int = 3) -> dict[str, DataFrame]:
    """A session's question and its derived queries to merged lists, packed context and sources.

    sessions (query_id, query, derived); results (query_id, query_pos, provider, pos, doc_id, url, title, text), what
    each provider (``web`` or another) gave for each query, equal documents with equal doc_id. Every query's lists are
    cut to its caps and take turns in one merged list; its passages are scored by cosine against one sparse vector of
    all terms of the session's queries, and packed.
    """
    plan = checkpointed(M.deep_search_plan(sessions, web_cap, encyclopedia_cap, derived))
    caps = plan.select("query_id", F.col("pos").alias("query_pos"), "web_limit", "encyclopedia_limit")
    web = F.col("provider") == "web"
    # Lists go without texts, which are read once a document.
    lists = (results.drop("text").join(caps, ["query_id", "query_pos"])
             .filter(F.col("pos") < F.when(web, F.col("web_limit")).otherwise(F.col("encyclopedia_limit")))
             .withColumn("list_no", F.col("query_pos") * 2 + F.when(web, 0).otherwise(1)))
    merged = checkpointed(M.interleave(lists.drop("query_pos", "provider", "web_limit", "encyclopedia_limit"),
                                       (web_cap + encyclopedia_cap + M.OVERFETCH) * derived))
    # The counts of all queries' terms are those of their joined text.
    joined = F.array_sort(F.collect_list(F.struct("pos", "query")))
    queries = checkpointed(plan.groupBy("query_id").agg(
        F.array_join(F.transform(joined, lambda q: q["query"]), " ").alias("query")))
    listed = merged.select("doc_id").distinct()
    docs = (results.select("doc_id", "title", "url", "text").join(listed, "doc_id", "left_semi").dropDuplicates(["doc_id"])
            .select("doc_id", F.col("title").alias("source"), "url", F.lit(None).cast("int").alias("page"), "text"))
    chunks = checkpointed(C.chunk(docs, *K.WEB_CHUNK))
    free = K.CONTEXT_WINDOW - K.INSTRUCTION_TOKENS - K.PROMPT_OVERHEAD_TOKENS - response_tokens
    chars = int(free * K.CHARS_PER_TOKEN * K.UTILISATION["deep"])
    scored = Z.score_own(queries, chunks, merged.select("query_id", "doc_id"), "cosine")
    selected = checkpointed(Z.select_own_context(queries, scored, chars))
    named = selected.join(chunks.select(*S.CHUNK_ID, "url"), S.CHUNK_ID)
    return {"plan": plan, "merged": merged, "selected": selected, "context": Z.context_text(selected, chunks, chars),
            "percent": Z.rebalance_percent(Z.source_share(named), merged.select("query_id", "url")),
            "shown": merged.filter(F.col("merged_pos") <= web_cap + encyclopedia_cap)}


def chat_turns(messages: DataFrame, chunks: DataFrame, response_tokens: int = 500, context_tokens: int = 3400,
               lang: str = "en") -> DataFrame:
    """Prompt of every user turn against a chunk table: (query_id, context, prompt).

    The context is packed at the chat share of the window, cut to its word and character caps, and placed
    before the earlier questions and the question itself.
    """
    users = messages.filter(F.col("role") == "user")
    key = T.message_id().alias("query_id")
    queries = users.select(key, F.col("text").alias("query"))
    free = (K.CONTEXT_WINDOW - K.INSTRUCTION_TOKENS - K.PROMPT_OVERHEAD_TOKENS - response_tokens) * K.CHARS_PER_TOKEN
    packed = int(free * K.UTILISATION["chat"])
    selected = Z.select_context(queries, chunks, packed)
    context = final_context(Z.context_text(selected, chunks, packed), context_tokens, free)
    prior = T.prior_questions(messages).select(key, F.col("questions").alias("prior"))
    requests = (queries.join(context, "query_id", "left").join(prior, "query_id", "left")
                .select("query_id", F.lit(lang).alias("lang"), F.col("query").alias("question"), "prior",
                        F.coalesce("context", F.lit(K.NO_CONTEXT)).alias("grounding")))
    return T.assemble_prompts(requests).join(context, "query_id", "left")


def final_context(contexts: DataFrame, context_tokens: int, free_chars: int) -> DataFrame:
    """Context after the word cap and the character cap."""
    tokens = min(context_tokens, -(-free_chars // K.CHARS_PER_TOKEN))
    words = max(1, tokens * K.CHARS_PER_TOKEN // K.CHARS_PER_WORD)
    return contexts.withColumn("context", trim_all(F.substring(truncate_words("context", words), 1, free_chars)))


def plan_budgets(requests: DataFrame) -> DataFrame:
    """All budgets of a request table: (request_id, response, context, reserve) to one column per budget."""
    response, context, reserve = F.col("response"), F.col("context"), F.col("reserve")
    return requests.select(
        "request_id",
        B.output_tokens(response).alias("output_tokens"),
        B.available_context_tokens(response).alias("available_context"),
        B.context_tokens(context, response).alias("context_tokens"),
        *[B.context_chars(response, share).alias(f"context_chars_{name}") for name, share in K.UTILISATION.items()],
        B.tool_response_tokens(response).alias("tool_response"),
        B.tool_reply_tokens(response).alias("tool_reply"),
        B.web_reply_tokens(response).alias("web_reply"),
        B.grounding_chars(response).alias("grounding_chars"),
        B.hybrid_grounding_chars(response, reserve).alias("hybrid_grounding_chars"),
        B.chars_of_tokens(context).alias("chars"), B.sentences_of_tokens(context).alias("sentences"),
        B.words_of_tokens(context).alias("words"), B.tokens_of_words(context).alias("tokens_of_words"),
        B.tokens_of_chars(context).alias("tokens_of_chars"),
        B.chat_scrape_chars(context).alias("chat_scrape_chars"),
        B.search_scrape_chars(context).alias("search_scrape_chars"),
        F.least(reserve, F.lit(K.FAST_PAGE_CAP)).alias("fast_pages"),
        F.least(B.search_scrape_chars(context), F.lit(K.FAST_CHARS_CAP)).alias("fast_chars"),
        B.provider_results(reserve).alias("provider_results"),
        B.clamp(reserve, *K.RESULTS_RANGE).alias("setting_results"))
