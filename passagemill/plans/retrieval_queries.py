"""Queries that score, rank, pack and cite."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, features as feat
from ..operators import chunking as C, scoring as S, selection as Z
from ..scale import spread
from ..session import checkpointed, table
from . import jobs, sql as Q
from .text_queries import chunks_sql
from ..operators.threads import message_id
from .registry import USER_TURNS_SQL, WHOLE_DOCUMENTS_SQL, query, user_turns, whole_documents

_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, n_chars DESC, doc_id, chunk_no)"
# Turns and documents that also speak of numbers, equations, figures and pages.
_ASKING = ("SELECT conv_id * 4294967296 + turn AS query_id, text || CASE turn % 6 WHEN 0 THEN ' explain equation ' || conv_id % 7 "
           "WHEN 1 THEN ' how many' WHEN 2 THEN ' describe figure ' || conv_id % 5 || ' on page ' || conv_id % 10 "
           "WHEN 3 THEN ' which equation' WHEN 4 THEN ' about ' || conv_id || 'km in fig' ELSE '' END AS query "
           "FROM conversations WHERE role = 'user'")
_TOLD = ("SELECT doc_id, 0 AS chunk_no, source, 'https://' || source || '.example.org/' || (doc_id % 10) AS url, "
         "CAST(doc_id % 10 AS INT) AS page, text || CASE doc_id % 5 WHEN 0 THEN ' see eq. ' || doc_id % 7 || ' x = 1' "
         "WHEN 1 THEN ' Fig. ' || doc_id % 5 WHEN 2 THEN ' over ' || doc_id % 100 || ' km (' || doc_id % 7 || ')' "
         "WHEN 3 THEN ' sqrt figure' ELSE '' END AS text FROM documents")


def asking_turns(spark, d):
    t, c = F.col("turn"), F.col("conv_id")
    tail = (F.when(t % 6 == 0, F.concat(F.lit(" explain equation "), c % 7)).when(t % 6 == 1, " how many")
            .when(t % 6 == 2, F.concat(F.lit(" describe figure "), c % 5, F.lit(" on page "), c % 10))
            .when(t % 6 == 3, " which equation").when(t % 6 == 4, F.concat(F.lit(" about "), c, F.lit("km in fig"))).otherwise(""))
    return table(spark, d, "conversations").filter(F.col("role") == "user").select(
        message_id().alias("query_id"), F.concat("text", tail).alias("query"))


def telling_documents(spark, d):
    n = F.col("doc_id")
    tail = (F.when(n % 5 == 0, F.concat(F.lit(" see eq. "), n % 7, F.lit(" x = 1"))).when(n % 5 == 1, F.concat(F.lit(" Fig. "), n % 5))
            .when(n % 5 == 2, F.concat(F.lit(" over "), n % 100, F.lit(" km ("), n % 7, F.lit(")")))
            .when(n % 5 == 3, " sqrt figure").otherwise(""))
    return whole_documents(spark, d).withColumn("text", F.concat("text", tail))


_TOP = f"SELECT query_id, doc_id, chunk_no, score, n_chars, rank FROM (SELECT *, {_RANK} AS rank FROM scored)"


@query("score_overlap", f"WITH {Q.scored_pairs(USER_TURNS_SQL, WHOLE_DOCUMENTS_SQL)} {_TOP} WHERE rank <= 10")
def score_overlap(spark, d):
    """The ten best documents for every user turn."""
    return S.top_chunks(user_turns(spark, d), whole_documents(spark, d), 10)


@query("score_cosine", f"WITH {Q.scored_pairs(USER_TURNS_SQL, WHOLE_DOCUMENTS_SQL, 'cosine')} {_TOP} WHERE rank <= 10")
def score_cosine(spark, d):
    return S.top_chunks(user_turns(spark, d), whole_documents(spark, d), 10, "cosine")


@query("score_overlap_boosted", f"WITH {Q.scored_pairs(_ASKING, _TOLD)} {_TOP} WHERE rank <= 10")
def score_overlap_boosted(spark, d):
    """Number, equation, figure and page boosts on top of the overlap."""
    return S.top_chunks(asking_turns(spark, d), telling_documents(spark, d), 10)


@query("score_cosine_boosted", f"WITH {Q.scored_pairs(_ASKING, _TOLD, 'cosine')} {_TOP} WHERE rank <= 10")
def score_cosine_boosted(spark, d):
    return S.top_chunks(asking_turns(spark, d), telling_documents(spark, d), 10, "cosine")


@query("score_shuffled", f"WITH {Q.scored_pairs(_ASKING, _TOLD)} {_TOP} WHERE rank <= 3")
def score_shuffled(spark, d):
    """The plan for query sets that are too big to broadcast."""
    return S.top_chunks(asking_turns(spark, d), telling_documents(spark, d), 3, max_broadcast=0)


@query("rank_chunks", f"WITH {Q.scored_pairs(_ASKING, _TOLD)} SELECT query_id, doc_id, chunk_no, score, rank FROM ({_TOP}) WHERE rank <= 50")
def rank_chunks(spark, d):
    return S.top_chunks(asking_turns(spark, d), telling_documents(spark, d), 50).drop("n_chars")


@query("top_chunks", f"WITH {Q.scored_pairs('SELECT item_id AS query_id, text AS query FROM benchmark', WHOLE_DOCUMENTS_SQL)} {_TOP} WHERE rank <= 3")
def top_chunks(spark, d):
    """Three best documents for every benchmark item."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return S.top_chunks(asked, whole_documents(spark, d), K.TOP_CITATIONS)


_FEATURES = f"SELECT doc_id, {Q.joined_sorted(Q.numeric_tokens('text'))} AS numbers, {Q.joined_sorted('(' + Q.equation_references('text') + ')')} AS equations, {Q.joined_sorted(Q.figure_references('text'))} AS figures FROM ({_TOLD})"


@query("numeric_tokens", _FEATURES)
def numeric_tokens(spark, d):
    """Numbers, equation and figure references of every document."""
    docs = spread(telling_documents(spark, d), "doc_id")
    joined = lambda c: F.array_join(F.sort_array(c), " ")
    return docs.select("doc_id", joined(feat.numeric_tokens("text")).alias("numbers"),
                       joined(feat.equation_references("text")).alias("equations"),
                       joined(feat.figure_references("text")).alias("figures"))


@query("intents", f"""SELECT query_id, {Q.numeric_intent('query')} AS numeric, {Q.temporal_intent('query')} AS temporal,
  {Q.word_intent('query', K.EQUATION_WORDS)} AS equation, {Q.word_intent('query', K.FIGURE_WORDS)} AS figure,
  {Q.joined_sorted(Q.page_references('query'))} AS pages FROM ({_ASKING})""")
def intents(spark, d):
    return asking_turns(spark, d).select(
        "query_id", feat.has_numeric_intent("query").alias("numeric"), feat.has_temporal_intent("query").alias("temporal"),
        feat.has_equation_intent("query").alias("equation"), feat.has_figure_intent("query").alias("figure"),
        F.array_join(F.sort_array(feat.requested_pages("query")), " ").alias("pages"))


@query("text_flags", f"""SELECT doc_id, regexp_matches(text, '\\p{{Nd}}') AS any_number, {Q.formula('text')} AS formula,
  {Q.figure_cue('text')} AS figure_cue FROM ({_TOLD})""")
def text_flags(spark, d):
    return telling_documents(spark, d).select("doc_id", feat.any_number("text").alias("any_number"),
                                              feat.formula_syntax("text").alias("formula"),
                                              feat.figure_cue("text").alias("figure_cue"))


def _count(x):
    return f"count(*) FILTER (WHERE {x})"


@query("intent_profile", f"""SELECT role, count(*) AS n_rows, {_count(Q.numeric_intent('text'))} AS numeric,
  {_count(Q.temporal_intent('text'))} AS temporal, {_count(Q.word_intent('text', K.EQUATION_WORDS))} AS equation,
  {_count(Q.word_intent('text', K.FIGURE_WORDS))} AS figure, {_count("regexp_matches(text, '[0-9]')")} AS any_number,
  {_count(Q.formula('text'))} AS formula FROM conversations GROUP BY role""")
def intent_profile(spark, d):
    return S.intent_profile(table(spark, d, "conversations"), "text", "role")


# --- packing -----------------------------------------------------------------------------------------

_BUDGET = 8198


def _packed(queries: str, passages: str, budget: int) -> str:
    """CTEs ending in ``picked(query_id, doc_id, chunk_no, position, fallback)``: a fold over all passages in rank order."""
    return f"WITH {Q.scored_pairs(queries, passages)}, {_folded('scored', budget)}"


def _folded(scored: str, budget: int) -> str:
    return f"""lists AS (SELECT query_id, list({{'used': 0::BIGINT, 'need': entry_len::BIGINT, 'ids': [doc_id * 100000 + chunk_no]}}
  ORDER BY score DESC, n_chars DESC, doc_id, chunk_no) AS l FROM {scored} GROUP BY query_id),
folded AS (SELECT query_id, l[1].ids AS best, list_reduce(list_prepend({{'used': 0::BIGINT, 'need': 0::BIGINT, 'ids': []::BIGINT[]}}, l),
  lambda a, x: CASE WHEN a.used + x.need + CASE WHEN len(a.ids) > 0 THEN 7 ELSE 0 END <= {budget}
    THEN {{'used': a.used + x.need + CASE WHEN len(a.ids) > 0 THEN 7 ELSE 0 END, 'need': 0::BIGINT, 'ids': list_concat(a.ids, x.ids)}}
    ELSE a END) AS s FROM lists),
ids AS (SELECT query_id, len(s.ids) = 0 AS fallback, CASE WHEN len(s.ids) = 0 THEN best ELSE s.ids END AS ids FROM folded),
picked AS (SELECT query_id, fallback, unnest(ids) // 100000 AS doc_id, CAST(unnest(ids) % 100000 AS INT) AS chunk_no, unnest(range(1, len(ids) + 1)) AS position FROM ids)"""


@query("select_context", f"{_packed(_ASKING, _TOLD, _BUDGET)} SELECT * FROM picked")
def select_context(spark, d):
    """Documents packed whole into a context of 8,198 characters, skipping misfits."""
    found = Z.select_context(asking_turns(spark, d), telling_documents(spark, d), _BUDGET)
    return found.select("query_id", "fallback", "doc_id", "chunk_no", "position")


_SMALL = 260
_JOINED = (f"SELECT query_id, string_agg(CASE WHEN fallback THEN left('Source: ' || source || chr(10) || text, greatest(200, {{0}})) "
           "ELSE 'Source: ' || source || chr(10) || text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context "
           "FROM picked JOIN p USING (doc_id, chunk_no) GROUP BY query_id")


@query("context_text", f"{_packed(USER_TURNS_SQL, WHOLE_DOCUMENTS_SQL, _SMALL)} {_JOINED.format(_SMALL)}")
def context_text(spark, d):
    """Packed text for a budget below most documents."""
    docs = whole_documents(spark, d)
    return Z.context_text(Z.select_context(user_turns(spark, d), docs, _SMALL), docs, _SMALL)


_SEP = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query("pack_prefix", f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, {Q.unnest_at('lines', 'spot', 'text')} FROM l),
b AS (SELECT *, sum(length(text)) OVER w AS own, row_number() OVER w AS n FROM u WINDOW w AS (PARTITION BY doc_id ORDER BY spot)),
f AS (SELECT *, own + 7 * greatest(n - 2, 0) > 1500 AS over FROM b),
k AS (SELECT *, max(CASE WHEN over THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY spot) AS stopped,
  sum(length(text) + 7) OVER (PARTITION BY doc_id) - 7 AS total FROM f)
SELECT doc_id, CASE WHEN any_value(total) <= 1500 THEN string_agg(text, {_SEP} ORDER BY spot)
  WHEN count(*) FILTER (WHERE stopped = 0) = 0 THEN left(min_by(text, spot), 1500)
  ELSE string_agg(text, {_SEP} ORDER BY spot) FILTER (WHERE stopped = 0) END AS context FROM k GROUP BY doc_id""")
def pack_prefix(spark, d):
    """Lines of a document as context blocks, cut to 1,500 characters."""
    docs = spread(table(spark, d, "documents"), "doc_id")
    return Z.pack_prefix(docs.select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit(K.ENTRY_SEPARATOR)).alias("context")), 1500)


# Selected passages derived from events: users as queries, event types as URLs.
_SELECTED = "SELECT user_id AS query_id, CASE WHEN event_type = 'error' THEN NULL ELSE 'https://example.org/' || event_type END AS url, value AS score FROM events"
_SHARES = f"""sel AS ({_SELECTED}), sums AS (SELECT query_id, url, sum(greatest(score, 0)) AS s FROM sel WHERE url IS NOT NULL GROUP BY ALL),
shares AS (SELECT query_id, url, s / sum(s) OVER (PARTITION BY query_id) * 100 AS pct FROM sums QUALIFY sum(s) OVER (PARTITION BY query_id) > 0)"""
_SHOWN = "SELECT DISTINCT user_id AS query_id, 'https://example.org/' || event_type AS url FROM events WHERE event_type <> 'view'"
_PERCENT = f"""shown AS ({_SHOWN}), kept AS (SELECT query_id, url, pct FROM shares JOIN shown USING (query_id, url)),
sc AS (SELECT query_id, url, round(pct / sum(pct) OVER (PARTITION BY query_id) * 100, 9) AS x FROM kept),
fl AS (SELECT query_id, url, floor(x) AS w, round(x - floor(x), 9) AS r, 100 - sum(floor(x)) OVER (PARTITION BY query_id) AS missing FROM sc),
percent AS (SELECT query_id, url, CAST(w + CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY r DESC, url) <= missing THEN 1 ELSE 0 END AS BIGINT) AS pct FROM fl)"""


def _selected(spark, d):
    url = F.when(F.col("event_type") != "error", F.concat(F.lit("https://example.org/"), "event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), url.alias("url"), F.col("value").alias("score"))


def _shown(spark, d):
    return table(spark, d, "events").filter(F.col("event_type") != "view").select(
        F.col("user_id").alias("query_id"), F.concat(F.lit("https://example.org/"), "event_type").alias("url"))


@query("source_share", f"WITH {_SHARES} SELECT query_id, url, round(pct, 6) AS pct FROM shares")
def source_share(spark, d):
    return Z.source_share(_selected(spark, d)).withColumn("pct", F.round("pct", 6))


@query("rebalance_percent", f"WITH {_SHARES}, {_PERCENT} SELECT * FROM percent")
def rebalance_percent(spark, d):
    return Z.rebalance_percent(Z.source_share(_selected(spark, d)), _shown(spark, d))


@query("rerank_results", f"""WITH {_SHARES}, {_PERCENT},
res AS (SELECT user_id AS query_id, 'https://example.org/' || event_type AS url, min(event_id) AS pos FROM events GROUP BY ALL)
SELECT query_id, url, pos, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(pct, 0) DESC, pos) AS place FROM res LEFT JOIN percent USING (query_id, url)""")
def rerank_results(spark, d):
    results = table(spark, d, "events").groupBy(
        F.col("user_id").alias("query_id"), F.concat(F.lit("https://example.org/"), "event_type").alias("url")).agg(
        F.min("event_id").alias("pos"))
    return Z.rerank_results(results, Z.rebalance_percent(Z.source_share(_selected(spark, d)), _shown(spark, d)))


@query("search_corpus")
def search_corpus(spark, d):
    """Replies for every benchmark item over chunked documents."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Z.search_corpus(asked, stored_chunks(spark, d), 500)


def stored_chunks(spark, d):
    """All documents as chunks, written once because every job below reads them several times."""
    return checkpointed(C.chunk(spread(whole_documents(spark, d).drop("chunk_no"), "doc_id")))


@query("excerpt", f"""
WITH t AS (SELECT doc_id, {Q.trim('text')} AS body, 'xyzzy ' || substr({Q.trim('text')}, CAST(greatest(length({Q.trim('text')}) // 2, 1) AS INT), 12) AS query FROM documents),
f AS (SELECT doc_id, body, greatest(coalesce(list_min(list_filter(list_transform({Q.tokens('query')}, lambda w: instr(lower(body), w)), lambda i: i > 0)), 1) - 1 - 100, 0) AS start FROM t)
SELECT doc_id, CASE WHEN length(body) <= 300 THEN body WHEN start = 0 THEN {Q.trim('substr(body, 1, 300)')}
  ELSE '…' || {Q.trim('substr(body, CAST(start + 1 AS INT), 300)')} END AS text FROM f""")
def excerpt(spark, d):
    """Excerpts of 300 characters around words from the middle of each document."""
    from ..functions.text import trim_all

    body = trim_all("text")
    asked = F.concat(F.lit("xyzzy "), F.substring(body, F.greatest(F.floor(F.length(body) / 2), F.lit(1)).cast("int"), F.lit(12)))
    docs = spread(table(spark, d, "documents"), "doc_id").select("doc_id", "text", asked.alias("query"))
    return docs.select("doc_id", Z.excerpt(F.col("text"), F.col("query"), F.lit(300)).alias("text"))


@query("render_results", f"""
WITH r AS (SELECT page_id // 7 AS query_id, page_id AS pos, 'Title ' || page_id AS title, url, CASE WHEN page_id % 3 = 0 THEN html WHEN page_id % 3 = 1 THEN ' ' END AS retrieved,
  CASE WHEN page_id % 2 = 0 THEN 'scraped ' || url END AS scraped, 'snippet ' || page_id AS snippet FROM pages),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM r)
SELECT query_id, string_agg('--- Result ' || n || ': ' || title || chr(10) || 'URL: ' || url || chr(10) || 'Content: ' ||
  CASE WHEN {Q.trim("coalesce(retrieved, '')")} <> '' THEN left(retrieved, 480) WHEN scraped IS NOT NULL THEN left(scraped, 480) ELSE snippet END, chr(10) || chr(10) ORDER BY n) AS reply
FROM n WHERE n <= 5 GROUP BY query_id""")
def render_results(spark, d):
    n = F.col("page_id")
    results = table(spark, d, "pages").select(
        F.floor(n / 7).alias("query_id"), n.alias("pos"), F.concat(F.lit("Title "), n).alias("title"), "url",
        F.when(n % 3 == 0, F.col("html")).when(n % 3 == 1, " ").alias("retrieved"),
        F.when(n % 2 == 0, F.concat(F.lit("scraped "), "url")).alias("scraped"), F.concat(F.lit("snippet "), n).alias("snippet"))
    return Z.render_results(results, 1000)


_CITED = ("SELECT query_id, string_agg(rank || '. [' || url || '](' || url || ')' || chr(10) || '   PDF Page: ' || page, "
          "chr(10) || chr(10) ORDER BY rank) AS citations FROM ({0}) t JOIN p USING (doc_id, chunk_no) WHERE rank <= 3 GROUP BY query_id")


@query("citation_block", f"WITH {Q.scored_pairs(USER_TURNS_SQL, WHOLE_DOCUMENTS_SQL)} {_CITED.format(_TOP)}")
def citation_block(spark, d):
    return jobs.cite_best(user_turns(spark, d), whole_documents(spark, d))


@query("debug_dump", f"""{_packed('SELECT item_id AS query_id, text AS query FROM benchmark', WHOLE_DOCUMENTS_SQL, _BUDGET)}
SELECT query_id, position, source || ' | url=' || url || ' | page=' || page AS provenance, printf('%.3f', score) AS score, n_chars AS chars
FROM picked JOIN scored USING (query_id, doc_id, chunk_no) JOIN p USING (doc_id, chunk_no)""")
def debug_dump(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = whole_documents(spark, d)
    chosen = Z.select_context(asked, docs, _BUDGET)
    return Z.debug_dump(chosen.join(docs.select(*S.CHUNK_ID, "source", "url", "page"), S.CHUNK_ID))


def flagship(spark, directory):
    """Chunk the corpus, score the first question of every conversation, cite the three best passages."""
    first = (table(spark, directory, "conversations").filter(F.col("role") == "user").groupBy("conv_id")
             .agg(F.min_by("text", "turn").alias("query")).select(F.col("conv_id").alias("query_id"), "query"))
    return jobs.cite_best(first, stored_chunks(spark, directory))


_FIRST_TURNS = "SELECT conv_id AS query_id, arg_min(text, turn) AS query FROM conversations WHERE role = 'user' GROUP BY conv_id"
_CHUNKS = ("SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, source, 'https://' || source || '.example.org/' || (doc_id % 10) AS url, "
           f"CAST(doc_id % 10 AS INT) AS page, text FROM ({chunks_sql(720, 120)})")
query("flagship", f"WITH {Q.scored_pairs(_FIRST_TURNS, _CHUNKS)} {_CITED.format(_TOP)}")(flagship)


@query("select_chunks", f"{_packed('SELECT item_id AS query_id, text AS query FROM benchmark', _CHUNKS, _BUDGET)} SELECT query_id, doc_id, chunk_no, position FROM picked")
def select_chunks(spark, d):
    """Chunks packed for every benchmark item."""
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = Z.select_context(asked, stored_chunks(spark, d), _BUDGET)
    return found.select("query_id", "doc_id", "chunk_no", "position")


_DEEP_CHARS = int((K.CONTEXT_WINDOW - K.INSTRUCTION_TOKENS - K.PROMPT_OVERHEAD_TOKENS - 500) * K.CHARS_PER_TOKEN * K.UTILISATION["deep"])
# What two providers gave for each query of a session, spread over the documents: (provider, list sizes).
_PROVIDERS = (("web", 12), ("encyclopedia", 5))
_SESSIONS = "SELECT conv_id AS query_id, list(text ORDER BY turn)[1:4] AS said FROM conversations WHERE role = 'user' GROUP BY conv_id"
_DEEP = f"""sessions AS ({_SESSIONS}),
said AS (SELECT query_id, {Q.unnest_at('said', 'pos', 'line')} FROM sessions),
plan AS (SELECT query_id, min(pos) AS pos, arg_min({Q.trim('line')}, pos) AS query FROM said WHERE {Q.trim('line')} <> '' GROUP BY query_id, {Q.folded('line')}),
size AS (SELECT count(*) AS n FROM documents),
lists AS (SELECT query_id, i AS pos, pos * 2 + v AS list_no, (query_id * 31 + pos * 7 + v * 3 + i * 13) % n AS doc_id
  FROM plan, size, range(2) AS w(v), range(9) AS r(i) WHERE i < CASE v WHEN 0 THEN 9 ELSE 2 END),
once AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY pos, list_no) AS seen FROM lists SEMI JOIN documents USING (doc_id)),
places AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, list_no) AS merged_pos FROM once WHERE seen = 1),
merged AS (SELECT * FROM places WHERE merged_pos <= 33)"""
_JOINED_QUERIES = "SELECT query_id, string_agg(query, ' ' ORDER BY pos) AS query FROM plan GROUP BY query_id"


@query("deep_search", f"""
WITH {_DEEP}, {Q.scored_pairs(_JOINED_QUERIES, f"SELECT doc_id, CAST(chunk_no AS INT) AS chunk_no, source, CAST(NULL AS INT) AS page, text FROM ({chunks_sql(720, 120)})", 'cosine')},
own AS (SELECT scored.* FROM scored JOIN merged USING (query_id, doc_id)), {_folded('own', _DEEP_CHARS).replace('lists AS', 'ranked AS').replace('FROM lists', 'FROM ranked')}
SELECT query_id, doc_id, chunk_no, position, fallback, merged_pos FROM picked JOIN merged USING (query_id, doc_id)""")
def deep_search(spark, d):
    """A thread's first question with up to three later ones as derived queries: lists of two providers for each, merged,
    scored by cosine against all queries' terms, packed."""
    found = jobs.deep_search(*_deep_input(spark, d))
    return found["selected"].select("query_id", "doc_id", "chunk_no", "position", "fallback").join(
        found["merged"].select("query_id", "doc_id", "merged_pos"), ["query_id", "doc_id"])


@query("deep_search_merged", f"WITH {_DEEP} SELECT query_id, doc_id, merged_pos, merged_pos <= 8 AS shown FROM merged")
def deep_search_merged(spark, d):
    """Merged lists of the same sessions, with what is shown of them."""
    found = jobs.deep_search(*_deep_input(spark, d))
    shown = found["shown"].select("query_id", "doc_id", F.lit(True).alias("s"))
    return (found["merged"].join(shown, ["query_id", "doc_id"], "left")
            .select("query_id", "doc_id", "merged_pos", F.coalesce("s", F.lit(False)).alias("shown")))


def _deep_input(spark, d):
    turns = table(spark, d, "conversations").filter(F.col("role") == "user")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"])
    sessions = turns.groupBy(F.col("conv_id").alias("query_id")).agg(said.alias("said")).select(
        "query_id", F.get("said", F.lit(0)).alias("query"), F.slice("said", 2, 3).alias("derived"))
    docs = table(spark, d, "documents")
    asked = sessions.select("query_id", F.posexplode(F.concat(F.array("query"), F.col("derived"))).alias("query_pos", "q"))
    place = lambda v: F.col("query_id") * 31 + F.col("query_pos") * 7 + v * 3 + F.col("pos") * 13
    lists = [asked.select("query_id", "query_pos", F.lit(name).alias("provider"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
             .withColumn("doc_id", F.pmod(place(v), F.lit(docs.count()))) for v, (name, n) in enumerate(_PROVIDERS)]
    given = docs.select("doc_id", F.concat(F.lit("https://"), "source", F.lit(".example.org/"), "doc_id").alias("url"),
                        F.col("source").alias("title"), "text")
    return sessions, lists[0].unionByName(lists[1]).join(given, "doc_id")


@query("chat_turns")
def chat_turns(spark, d):
    """Prompts of all user turns over chunked documents."""
    return jobs.chat_turns(table(spark, d, "conversations"), stored_chunks(spark, d))
