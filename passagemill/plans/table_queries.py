"""Queries over result lists, threads, call logs, budgets and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, urls as U
from ..operators import (calls as G, chunking as C, layout as L, lookups as J, merging as M, scoring as S,
                         selection as Z, threads as T)
from ..scale import OrderedGroups, numbered, spread
from ..session import checkpointed, new_folder, table
from ..sources import tables as A
from ..streaming import calls as ST
from . import jobs, sql as Q
from .registry import query, user_turns, whole_documents


def conversations(spark, d):
    return table(spark, d, "conversations")


def page_results(spark, d):
    """Pages as result lists: five questions per block of pages, two providers each."""
    n = F.col("page_id")
    return table(spark, d, "pages").select(
        (n % 25).alias("query_id"), (n % 2).alias("list_no"), F.floor(n / 50).alias("pos"), "url", "page_id")


_RESULTS = "SELECT page_id % 25 AS query_id, page_id % 2 AS list_no, page_id // 50 AS pos, url, page_id FROM pages"

# scheme, host, path, query of the crawled URLs
_KEY = ("lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) || "
        "CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) END || "
        "regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1)")


@query("url_key", f"""SELECT page_id, {_KEY} AS k, {_KEY} AS noisy,
  regexp_replace(url, '//', '//Me@') AS strict FROM pages""")
def url_key(spark, d):
    """Keys of the crawled URLs; ``noisy`` has upper-case host, port, user and fragment."""
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    rest = F.regexp_extract("url", "//[^/?#]*([^#]*)", 1)
    scheme = F.upper(F.substring_index("url", ":", 1))
    noisy = F.concat(scheme, F.lit("://Me@"), F.upper(host), F.lit(":8080"), rest, F.lit("#part"))
    fragment = F.regexp_extract("url", "(#.*)$", 1)
    strict = F.concat(scheme, F.lit("://Me@"), F.upper(host), rest, fragment)
    return table(spark, d, "pages").select("page_id", U.url_key("url").alias("k"), U.url_key(noisy).alias("noisy"),
                                           U.url_key_strict(strict).alias("strict"))


@query("dedupe_queries", f"""
WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN translate({Q.trim('text')}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE {Q.trim('text')} END AS query FROM conversations),
k AS (SELECT *, {Q.folded('query')} AS query_key FROM l WHERE {Q.trim('query')} <> '')
SELECT query_key, count(*) AS n, min(conv_id * 4294967296 + turn) AS pos, arg_min({Q.trim('query')}, conv_id * 4294967296 + turn) AS query FROM k GROUP BY query_key""")
def dedupe_queries(spark, d):
    """All messages, every other one in capitals (a to z); first spelling wins."""
    from string import ascii_lowercase, ascii_uppercase

    from ..functions.text import trim_all

    start = trim_all("text")
    long = conversations(spark, d).select(
        T.message_id().alias("pos"),
        F.when(F.col("turn") % 2 == 0, F.translate(start, ascii_lowercase, ascii_uppercase)).otherwise(start).alias("query"))
    counts = long.filter(trim_all("query") != "").groupBy(M.fold_query("query").alias("query_key")).agg(F.count(F.lit(1)).alias("n"))
    return M.dedupe_queries(long).join(counts, "query_key")


@query("interleave", f"""
WITH r AS ({_RESULTS}), f AS (SELECT *, {_KEY} AS url_key FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, url_key ORDER BY pos, list_no, page_id) AS seen FROM f),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos, list_no, page_id) AS merged_pos FROM o WHERE seen = 1)
SELECT query_id, url_key, page_id, merged_pos FROM m WHERE merged_pos <= 8""")
def interleave(spark, d):
    """Two lists of pages per question take turns."""
    return M.interleave(page_results(spark, d), 8).select("query_id", "url_key", "page_id", "merged_pos")


@query("dedupe_urls", f"""
SELECT query_id, url AS url_key, min(pos * 1000000000000 + page_id) AS pos FROM ({_RESULTS}) GROUP BY ALL""")
def dedupe_urls(spark, d):
    shouted = F.concat(F.upper(F.regexp_extract("url", "^[^/]*//[^/]*", 0)), F.regexp_extract("url", "^[^/]*//[^/]*(.*)$", 1))
    results = page_results(spark, d).select("query_id", (F.col("pos") * 1_000_000_000_000 + F.col("page_id")).alias("pos"),
                                            shouted.alias("url"))
    return M.dedupe_urls(results).select("query_id", "url_key", "pos")


@query("append_novel", f"""
WITH r AS ({_RESULTS}), e AS (SELECT * FROM r WHERE list_no = 0), i AS (SELECT query_id, page_id, CASE WHEN page_id % 3 = 0 THEN 'https://new.example.org/' || page_id ELSE url END AS url FROM r)
SELECT query_id, url, page_id, 0 AS batch FROM e UNION ALL
SELECT query_id, url, page_id, 1 FROM i WHERE (query_id, url) NOT IN (SELECT query_id, url FROM e)""")
def append_novel(spark, d):
    r = page_results(spark, d).select("query_id", "url", "page_id", "list_no")
    new = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://new.example.org/"), "page_id")).otherwise(F.col("url"))
    return M.append_novel(r.filter("list_no = 0").drop("list_no"), r.withColumn("url", new).drop("list_no"))


_LINES_OF = "SELECT doc_id AS query_id, string_split(text, chr(10)) AS said FROM documents"


@query("clean_derived_queries", f"""
WITH c AS (SELECT query_id, said[1] AS original, said FROM ({_LINES_OF})), l AS (SELECT query_id, original, {Q.unnest_at("said", 'pos', 'line')} FROM c),
x AS (SELECT query_id, original, 2 * pos + k AS pos, {Q.trim("line")} AS query FROM l, (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR pos % 3 <> 0),
t AS (SELECT *, {Q.query_terms('query')} AS terms, {Q.query_terms('original')} AS own, {Q.folded('query')} AS query_key FROM x WHERE query <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id, query_key ORDER BY pos) AS seen FROM t
  WHERE len(list_filter(terms, lambda w: NOT list_contains(own, w))) >= 2 AND query_key <> {Q.folded('original')}),
g AS (SELECT *, len(list_intersect(terms, own)) AS n_shared FROM f WHERE seen = 1),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM g WHERE len(own) = 0 OR n_shared / (len(terms) + len(own) - n_shared) < 0.75)
SELECT query_id, n AS pos, query FROM n WHERE n <= 3""")
def clean_derived_queries(spark, d):
    """Lines of a document as proposals to its first line: quoted, numbered, and links between."""
    lines = F.split("text", "\n")
    raw = F.array_join(F.transform(lines, lambda l, i: F.concat(
        F.when(F.btrim(l) == "", l).otherwise(F.concat(F.lit(" - \""), F.btrim(l), F.lit("\""))),
        F.lit("\n"), F.when(i % 3 == 0, "https://x.example.org/a").otherwise(F.concat(F.lit("2) "), l)))), "\n")
    docs = spread(table(spark, d, "documents"), "doc_id")
    return M.clean_derived_queries(docs.select(F.col("doc_id").alias("query_id"), F.get(lines, F.lit(0)).alias("original"), raw.alias("raw")))


def _near(source: str, ident: str, threshold: float) -> str:
    return f"""
WITH s AS (SELECT {ident} AS id, list_sort({Q.query_terms('text')}) AS terms FROM {source}),
g AS (SELECT min(id) AS id, terms FROM s WHERE len(terms) > 0 GROUP BY terms),
t AS (SELECT id, len(terms) AS n, unnest(terms) AS term FROM g),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, count(*) AS c FROM t a JOIN t b USING (term) WHERE a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, round(c / (n_a + n_b - c), 9) AS similarity FROM p WHERE round(c / (n_a + n_b - c), 9) >= {threshold}"""


_REWORDED = """(SELECT (conv_id * 4294967296 + turn) * 2 AS message, text FROM conversations
UNION ALL SELECT (conv_id * 4294967296 + turn) * 2 + 1, text || ' reworded' FROM conversations)"""


@query("near_duplicate_queries", f"""
WITH s AS (SELECT DISTINCT message AS id, list_sort({Q.query_terms('text')}) AS terms FROM {_REWORDED}),
g AS (SELECT terms, row_number() OVER () AS no FROM (SELECT DISTINCT terms FROM s WHERE len(terms) > 0)),
m AS (SELECT no, id FROM s JOIN g USING (terms)),
t AS (SELECT no, len(terms) AS n, unnest(terms) AS term FROM g),
p AS (SELECT a.no AS a, b.no AS b, a.n AS n_a, b.n AS n_b, count(*) AS c FROM t a JOIN t b USING (term) GROUP BY ALL),
near AS (SELECT a, b, round(c / (n_a + n_b - c), 9) AS similarity FROM p WHERE round(c / (n_a + n_b - c), 9) >= 0.75)
SELECT x.id AS id_a, y.id AS id_b, similarity FROM near JOIN m x ON x.no = near.a JOIN m y ON y.no = near.b WHERE x.id < y.id""")
def near_duplicate_queries(spark, d):
    """Every message beside a wording of it with one term more; messages of equal terms are pairs as well."""
    asked = conversations(spark, d).select((T.message_id() * 2).alias("id"), "text")
    reworded = asked.select((F.col("id") + 1).alias("id"), F.concat("text", F.lit(" reworded")).alias("text"))
    return M.near_duplicates(asked.unionByName(reworded), fold_copies=False)


@query("near_duplicate_documents", _near("documents", "doc_id", 0.75))
def near_duplicate_documents(spark, d):
    return M.near_duplicates(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("near_groups", f"""
WITH RECURSIVE pairs AS ({_near("documents", "doc_id", 0.75)}),
t AS (SELECT doc_id, list_sort({Q.query_terms('text')}) AS terms FROM documents),
one AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY terms) AS head FROM t WHERE len(terms) > 0),
links AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT DISTINCT head AS id, head AS root FROM one UNION SELECT b, root FROM reach JOIN links ON a = id),
least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT doc_id AS id, root AS group_id FROM one JOIN least ON least.id = head""")
def near_groups(spark, d):
    """Every document with the smallest id of its group of near copies."""
    return M.near_groups(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("copies", f"""
WITH s AS (SELECT doc_id, list_sort({Q.query_terms('text')}) AS terms FROM documents)
SELECT id, copy_of FROM (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY terms) AS copy_of FROM s WHERE len(terms) > 0) WHERE id <> copy_of""")
def copies(spark, d):
    return M.copies(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("is_raw_url", f"""SELECT page_id, true AS plain, false AS spoken, contains(url, '://') AS www FROM pages""")
def is_raw_url(spark, d):
    return table(spark, d, "pages").select(
        "page_id", U.is_raw_url(F.concat(F.lit(" "), "url", F.lit("\n"))).alias("plain"),
        U.is_raw_url(F.concat(F.lit("see "), "url")).alias("spoken"),
        U.is_raw_url(F.concat(F.lit("WWW.example.org/"), F.regexp_replace("url", "^[^:]*://", ""))).alias("www"))


@query("novelty", f"""
WITH p AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, len(list_filter({Q.query_terms('text')}, lambda w: NOT list_contains({Q.query_terms('before')}, w))) AS n FROM p WHERE before IS NOT NULL""")
def novelty(spark, d):
    """How many terms each message adds to the one before."""
    groups = OrderedGroups(conversations(spark, d), ["conv_id"], ["turn"]).with_neighbours(before=1)
    seen = groups.df.withColumn("before", F.lag("text").over(groups.window()))
    return (groups.replace(seen).own_rows().plain().filter(F.col("before").isNotNull())
            .select("conv_id", "turn", M.novelty(F.col("text"), F.col("before")).alias("n")))


_FETCHES = """SELECT user_id AS query_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos,
  CASE WHEN event_type <> 'error' THEN props END AS content, value AS completed_at FROM events"""


@query("first_successes", f"""
SELECT query_id, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY completed_at, pos) AS place
  FROM ({_FETCHES}) WHERE pos < 8 AND content IS NOT NULL) WHERE place <= 5""")
def first_successes(spark, d):
    """Events as fetches: errors failed, the value is the completion time."""
    events = OrderedGroups(table(spark, d, "events"), ["user_id"], ["event_id"]).running("n", F.lit(1)).plain()
    fetches = events.select(
        F.col("user_id").alias("query_id"), "event_id", (F.col("n") - 1).alias("pos"),
        F.when(F.col("event_type") != "error", F.col("props")).alias("content"), F.col("value").alias("completed_at"))
    return M.first_successes(fetches, 5).select("query_id", "event_id", "place")


@query("route_providers", f"""
WITH q AS (SELECT conv_id * 4294967296 + turn AS query_id, text || CASE turn % 4 WHEN 0 THEN ' latest' ELSE '' END AS query, CASE WHEN conv_id % 3 = 0 THEN 'fr' ELSE 'es' END AS lang FROM conversations WHERE role = 'user')
SELECT query_id, 'web' AS provider, 6 AS cap, 8 AS merged_cap, NULL AS encyclopedia_host FROM q WHERE {Q.trim('query')} <> '' UNION ALL
SELECT query_id, 'encyclopedia', 2, 8, CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END || '.wikipedia.org' FROM q WHERE {Q.trim('query')} <> '' AND NOT {Q.temporal_intent('query')}""")
def route_providers(spark, d):
    turns = conversations(spark, d).filter(F.col("role") == "user").select(
        T.message_id().alias("query_id"),
        F.concat("text", F.when(F.col("turn") % 4 == 0, " latest").otherwise("")).alias("query"),
        F.when(F.col("conv_id") % 3 == 0, "fr").otherwise("es").alias("lang"))
    return M.route_providers(turns)


@query("search_outcomes", """
SELECT user_id AS query_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS n_results, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS n_failed,
  CASE WHEN sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) > 0 THEN 'results' WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN 'error' ELSE 'empty' END AS outcome
FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING true""".replace("SELECT user_id AS query_id,", "SELECT user_id * 100000 + date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS query_id,"))
def search_outcomes(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    answers = table(spark, d, "events").select(
        (F.col("user_id") * 100000 + day).alias("query_id"), F.col("event_type").alias("provider"),
        (F.col("event_type") == "error").alias("failed"), F.when(F.col("event_type") == "click", 1).otherwise(0).alias("n_results"))
    return M.search_outcomes(answers)


@query("split_prefetched", f"""
WITH r AS ({_RESULTS}), given AS (SELECT query_id, url, min(pos * 1000 + list_no) AS p FROM r WHERE page_id % 3 = 0 GROUP BY ALL),
w AS (SELECT query_id, url FROM r UNION SELECT query_id, url FROM r WHERE contains(url, '?'))
SELECT query_id, url, 'given' AS kind FROM given UNION ALL SELECT query_id, url, 'fetch' FROM w WHERE (query_id, url) NOT IN (SELECT query_id, url FROM given)""")
def split_prefetched(spark, d):
    r = page_results(spark, d).withColumn("retrieved", F.when(F.col("page_id") % 3 == 0, "text").otherwise(" "))
    r = r.withColumn("pos", F.col("pos") * 1000 + F.col("list_no")).drop("list_no")
    given, fetch = M.split_prefetched(r.select("query_id", "pos", "url", "retrieved"),
                                      r.filter(F.col("url").contains("?")).select("query_id", "pos", "url"))
    named = lambda df, kind: df.select("query_id", "url", F.lit(kind).alias("kind"))
    return named(given, "given").unionByName(named(fetch, "fetch"))


@query("deep_search_plan", f"""
WITH l AS (SELECT query_id, {Q.unnest_at('said', 'pos', 'line')} FROM ({_LINES_OF})),
k AS (SELECT query_id, pos, {Q.trim('line')} AS query, {Q.folded('line')} AS key FROM l WHERE {Q.trim('line')} <> '')
SELECT query_id, min(pos) AS pos, arg_min(query, pos) AS query, 9 AS web_limit, 2 AS encyclopedia_limit, 33 AS merged_limit, 8 AS shown FROM k GROUP BY query_id, key""")
def deep_search_plan(spark, d):
    """Lines of a document: the first is the question, the others its derived queries."""
    lines = F.split("text", "\n")
    sessions = spread(table(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").alias("query_id"), F.get(lines, F.lit(0)).alias("query"), F.slice(lines, F.lit(2), F.size(lines)).alias("derived"))
    return M.deep_search_plan(sessions)


# --- budgets -----------------------------------------------------------------------------------------


def _clamp(x, low, high):
    return f"least(greatest({x}, {low}), {high})"


_R, _C, _V = "k * 50", "(user_id * 97) % 5000 - 200", "event_id % 45 - 2"
_OUT, _TOOL = _clamp(_R, 1, 3616), _clamp(_R, 1, 3016)


@query("plan_budgets", f"""
WITH e AS (SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
b AS (SELECT event_id AS request_id, {_OUT} AS o, {_TOOL} AS t, {_C} AS c, {_V} AS v FROM e)
SELECT request_id, o AS output_tokens, greatest(3916 - o, 300) AS available_context,
  {_clamp('c', 'least(300, least(3500, greatest(3916 - o, 300)))', 'least(3500, greatest(3916 - o, 300))')} AS context_tokens,
  CAST(floor((3916 - o) * 3 * 0.8::DOUBLE) AS INT) AS context_chars_chat, CAST(floor((3916 - o) * 3 * 0.65::DOUBLE) AS INT) AS context_chars_fast,
  CAST(floor((3916 - o) * 3 * 0.8::DOUBLE) AS INT) AS context_chars_deep, t AS tool_response,
  least(greatest(500, 2 * t), (3316 - t) // 2) AS tool_reply, least(1000, least(greatest(500, 2 * t), (3316 - t) // 2)) AS web_reply,
  (3316 - t) * 3 AS grounding_chars, greatest(3316 - t - greatest(v, 0), 0) * 3 AS hybrid_grounding_chars,
  greatest(c, 0) * 3 AS chars, greatest(1, greatest(c, 0) * 3 // 140) AS sentences, greatest(1, greatest(c, 0) * 3 // 5) AS words,
  greatest(1, greatest(c, 0) * 5 // 3) AS tokens_of_words, (greatest(c, 0) + 2) // 3 AS tokens_of_chars,
  {_clamp(f"{_clamp('c', 300, 3500)} * 6", 1500, 12000)} AS chat_scrape_chars, greatest(greatest(c, 0) * 6, 1500) AS search_scrape_chars,
  least(v, 6) AS fast_pages, least(greatest(greatest(c, 0) * 6, 1500), 4500) AS fast_chars,
  {_clamp('v', 1, 30)} AS provider_results, {_clamp('v', 1, 20)} AS setting_results FROM b""")
def plan_budgets(spark, d):
    """Every event as a request: response tokens from its properties, context and reserve from its ids."""
    requests = table(spark, d, "events").select(
        F.col("event_id").alias("request_id"), (F.get_json_object("props", "$.k").cast("int") * 50).alias("response"),
        ((F.col("user_id") * 97) % 5000 - 200).cast("int").alias("context"), (F.col("event_id") % 45 - 2).cast("int").alias("reserve"))
    return jobs.plan_budgets(requests)


@query("final_context", f"""
WITH w AS (SELECT doc_id, text, {Q.word_pieces('text')} AS l FROM documents)
SELECT doc_id, {Q.trim("substr(CASE WHEN len(l) > 180 THEN " + Q.trim(Q.first_words('text', 'l', 180)) + " ELSE text END, 1, 900)")} AS context FROM w""")
def final_context(spark, d):
    """Documents as contexts, cut to 180 words (300 tokens) and 900 characters."""
    docs = spread(table(spark, d, "documents"), "doc_id").select("doc_id", F.col("text").alias("context"))
    return jobs.final_context(docs, 300, 900)


# --- threads -----------------------------------------------------------------------------------------


@query("conversation_titles", f"""
WITH f AS (SELECT conv_id, {Q.trim("arg_min(text, turn)")} AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(t) <= 50 THEN t ELSE substr(t, 1, 50) || '...' END AS title FROM f""")
def conversation_titles(spark, d):
    return T.conversation_titles(conversations(spark, d))


@query("conversation_list", "SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_list(spark, d):
    return T.conversation_list(conversations(spark, d))


_HISTORY = """
WITH h AS (SELECT conv_id, turn, role, string_agg(CASE WHEN role = 'assistant' THEN 'Assistant: ' ELSE 'User: ' END || text, chr(10))
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS history FROM conversations)
SELECT conv_id, turn, coalesce(history, '') AS history FROM h WHERE role = 'user'"""


@query("history_window", _HISTORY)
def history_window(spark, d):
    return T.history_window(conversations(spark, d))


@query("history_window_cut", _HISTORY)
def history_window_cut(spark, d):
    """The same with every thread treated as too big for one task."""
    return T.history_window(conversations(spark, d), group_rows=1)


_CONTEXTUAL = f"""
WITH h AS (SELECT conv_id, turn, role, text, string_agg(CASE WHEN role IN ('user', 'assistant') THEN text END, '. ')
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS recent FROM conversations)
SELECT conv_id, turn, substr(array_to_string(list_filter([{Q.trim('text')}, {Q.trim("coalesce(recent, '')")}, 'thread ' || conv_id], lambda x: x <> ''), ' '), 1, 500) AS query
FROM h WHERE role = 'user'"""


@query("contextual_queries", _CONTEXTUAL)
def contextual_queries(spark, d):
    return T.contextual_queries(conversations(spark, d), F.concat(F.lit(" thread "), "conv_id"))


_PRIOR = """
WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
p AS (SELECT a.conv_id, a.turn, b.turn AS t, b.text AS x, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS n
  FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.text <> a.text)
SELECT u.conv_id, u.turn, coalesce(string_agg(x, '|' ORDER BY t), '') AS questions FROM u LEFT JOIN p ON p.conv_id = u.conv_id AND p.turn = u.turn AND p.n <= 6 GROUP BY ALL"""


@query("prior_questions", _PRIOR)
def prior_questions(spark, d):
    found = T.prior_questions(conversations(spark, d))
    return found.withColumn("questions", F.array_join("questions", "|"))


@query("load_thread", """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations
WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def load_thread(spark, d):
    """Threads that have a system message."""
    m = conversations(spark, d)
    return T.load_thread(m, m.filter(F.col("role") == "system").select("conv_id"))


_TARGET = "SELECT conv_id, max(turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id"


@query("regenerate_from", f"""
WITH t AS ({_TARGET}), c AS (SELECT conv_id, max(turn) AS cut FROM conversations JOIN t USING (conv_id) WHERE role = 'user' AND turn < t GROUP BY conv_id)
SELECT conv_id, turn, text, 'kept' AS kind FROM conversations LEFT JOIN c USING (conv_id) WHERE cut IS NULL OR turn < cut
UNION ALL SELECT conv_id, turn, text, 'again' FROM conversations JOIN c USING (conv_id) WHERE turn = cut""")
def regenerate_from(spark, d):
    """The last assistant turn of every thread is redone."""
    m = conversations(spark, d)
    targets = m.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    kept, again = T.regenerate_from(m, targets)
    return kept.select("conv_id", "turn", "text", F.lit("kept").alias("kind")).unionByName(
        again.select("conv_id", "turn", F.col("question").alias("text"), F.lit("again").alias("kind")))


_THREADS = """SELECT doc_id AS conv_id, TIMESTAMP '2024-01-01' + to_seconds(n_chars) AS updated_at,
  CASE WHEN doc_id % 3 = 0 THEN lang || '.pdf' END AS file, [source || '.pdf', lang || '.pdf'] AS files, md5(text) AS checksum FROM documents"""


def _threads(spark, d):
    file = F.concat("lang", F.lit(".pdf"))
    updated = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("n_chars"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("conv_id"), updated.alias("updated_at"), F.when(F.col("doc_id") % 3 == 0, file).alias("file"),
        F.array(F.concat("source", F.lit(".pdf")), file).alias("files"), F.md5("text").alias("checksum"))


@query("latest_by_file", f"""
WITH t AS ({_THREADS}), n AS (SELECT DISTINCT file AS base FROM t WHERE file IS NOT NULL UNION SELECT DISTINCT files[1] FROM t),
c AS (SELECT file AS base, 0 AS class, updated_at, conv_id FROM t WHERE file IS NOT NULL UNION ALL SELECT unnest(files), 1, updated_at, conv_id FROM t)
SELECT replace(base, '.pdf', ' (3).pdf') AS name, conv_id FROM (SELECT base, conv_id, row_number() OVER (PARTITION BY base ORDER BY class, updated_at DESC, conv_id) AS n FROM c JOIN n USING (base)) WHERE n = 1""")
def latest_by_file(spark, d):
    """Documents as threads, asked for by renamed copies of every file name."""
    threads = _threads(spark, d)
    names = threads.select(F.explode(F.array_union(F.slice("files", 1, 1), F.array("file"))).alias("name")).filter(
        F.col("name").isNotNull()).select(F.replace(F.col("name"), F.lit(".pdf"), F.lit(" (3).pdf")).alias("name"))
    return T.latest_by_file(threads, names)


@query("latest_by_checksum", f"""
WITH t AS ({_THREADS}) SELECT checksum, conv_id FROM (SELECT checksum, conv_id, row_number() OVER (PARTITION BY checksum ORDER BY updated_at DESC, conv_id) AS n FROM t) WHERE n = 1""")
def latest_by_checksum(spark, d):
    threads = _threads(spark, d)
    return T.latest_by_checksum(threads, threads.select("checksum"))


@query("seed_from_search", f"""
WITH e AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '  ' ELSE ' ' || url || ' ' END AS q, CASE WHEN page_id % 3 = 0 THEN '' ELSE html END AS a FROM pages)
SELECT page_id AS conv_id, 0 AS turn, 'user' AS role, trim(q) AS text, NULL AS citations, CASE WHEN length(trim(q)) <= 50 THEN trim(q) ELSE substr(trim(q), 1, 50) || '...' END AS title FROM e WHERE trim(q) <> ''
UNION ALL SELECT page_id, CASE WHEN trim(q) = '' THEN 0 ELSE 1 END, 'assistant', {Q.trim('a')}, CASE WHEN page_id % 2 = 0 THEN '1. x' END,
  CASE WHEN trim(q) = '' THEN NULL WHEN length(trim(q)) <= 50 THEN trim(q) ELSE substr(trim(q), 1, 50) || '...' END FROM e WHERE {Q.trim('a')} <> ''""")
def seed_from_search(spark, d):
    n = F.col("page_id")
    exchanges = table(spark, d, "pages").select(
        n.alias("conv_id"), F.when(n % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" "))).alias("query"),
        F.when(n % 3 == 0, "").otherwise(F.col("html")).alias("answer"), F.when(n % 2 == 0, " 1. x").otherwise("\n").alias("citations"))
    return T.seed_from_search(exchanges)


def _case_label(name: str) -> str:
    return ("CASE lang " + " ".join(f"WHEN '{lang}' THEN {Q.quoted(K.PROMPT_LABELS[lang][name])}" for lang in ("fr", "es"))
            + f" ELSE {Q.quoted(K.PROMPT_LABELS['en'][name])} END")


_REQUESTS = f"""WITH pq AS ({_PRIOR.strip()}),
r AS (SELECT conv_id * 4294967296 + turn AS query_id, conv_id, turn, text AS question, CASE conv_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'es' WHEN 2 THEN 'en' ELSE 'de' END AS lang, questions,
  CASE WHEN turn % 4 = 0 THEN '' ELSE 'Source: thread ' || conv_id END AS grounding FROM conversations JOIN pq USING (conv_id, turn))"""
_EARLIER = f"CASE WHEN questions <> '' THEN {_case_label('earlier')} || chr(10) || '- ' || replace(questions, '|', chr(10) || '- ') || chr(10) || chr(10) ELSE '' END"


def _requests(spark, d):
    users = conversations(spark, d).filter(F.col("role") == "user")
    c = F.col("conv_id")
    prior = T.prior_questions(conversations(spark, d)).withColumnRenamed("questions", "prior")
    return users.join(prior, ["conv_id", "turn"]).select(
        T.message_id().alias("query_id"), F.col("text").alias("question"), "prior",
        F.when(c % 4 == 0, "fr").when(c % 4 == 1, "es").when(c % 4 == 2, "en").otherwise("de").alias("lang"),
        F.when(F.col("turn") % 4 == 0, " ").otherwise(F.concat(F.lit("Source: thread "), c, F.lit("\n"))).alias("grounding"),
        F.concat(F.lit("Tool: "), F.repeat(F.lit("x"), (c % 5 * 100).cast("int"))).alias("transcript"))


@query("assemble_prompts", f"""{_REQUESTS}
SELECT query_id, CASE WHEN grounding <> '' THEN {_case_label('grounding')} || chr(10) || grounding || chr(10) || chr(10) ELSE '' END || {_EARLIER} ||
  CASE WHEN grounding <> '' THEN {_case_label('grounded')} ELSE {_case_label('ungrounded')} END || chr(10) || question AS prompt FROM r""")
def assemble_prompts(spark, d):
    return T.assemble_prompts(_requests(spark, d))


@query("assemble_recovery_prompts", f"""{_REQUESTS}
SELECT query_id, {_case_label('transcript')} || chr(10) || rtrim(left('Tool: ' || repeat('x', CAST(conv_id % 5 * 100 AS INT)), 220)) || chr(10) || chr(10) ||
  CASE WHEN grounding <> '' THEN {_case_label('grounding')} || chr(10) || left(grounding, CAST(400 - least(220, 6 + conv_id % 5 * 100) AS INT)) || chr(10) || chr(10) ELSE '' END || {_EARLIER} ||
  {_case_label('recovery')} || chr(10) || question AS prompt FROM r""")
def assemble_recovery_prompts(spark, d):
    return T.assemble_recovery_prompts(_requests(spark, d), 400)


@query("delete_conversations", """
SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""")
def delete_conversations(spark, d):
    """Threads with a system message go, together with their messages."""
    m = conversations(spark, d)
    threads, messages = T.delete_conversations(m.select("conv_id").distinct(), m, m.filter(F.col("role") == "system"))
    return messages.join(threads, "conv_id", "left_semi").select("conv_id", "turn")


@query("attachment_changes", """
WITH f AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'a.pdf|b.pdf' WHEN 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'a.pdf|b.pdf' ELSE 'b.pdf|a.pdf' END ELSE '' END AS files FROM conversations),
l AS (SELECT *, lag(files, 1, '') OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM f)
SELECT conv_id, turn, files FROM l WHERE files <> before""")
def attachment_changes(spark, d):
    """Roles as attachment lists: users hold copies of two files, every other assistant in reverse order."""
    mine = F.array(F.lit("a (2).pdf"), F.lit("b.pdf"))
    theirs = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("a.pdf"), F.lit("b (7).pdf"))).otherwise(F.reverse(mine))
    files = F.when(F.col("role") == "user", mine).when(F.col("role") == "assistant", theirs).otherwise(F.array().cast("array<string>"))
    changed = T.attachment_changes(conversations(spark, d).select("conv_id", "turn", files.alias("files")))
    return changed.withColumn("files", F.array_join("files", "|"))


# --- call logs ---------------------------------------------------------------------------------------


def event_calls(events):
    """Events as tool calls: a turn is a user's day, the properties are the arguments."""
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")
    tool = F.when(F.col("event_type") == "click", "webSearch").when(F.col("event_type") == "view", "searchContext").otherwise(F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    args = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" Find  "), k % 7)).otherwise(F.concat(F.lit("find "), k % 7))
    return events.select(F.concat(F.col("user_id"), F.lit(":"), day).alias("turn_key"), F.col("event_id").alias("seq"),
                         F.col("ts").cast("timestamp").alias("ts"), tool.alias("tool"), args.alias("args"))


_CALLS = """SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS turn_key, event_id AS seq, ts,
  CASE event_type WHEN 'click' THEN 'webSearch' WHEN 'view' THEN 'searchContext' ELSE event_type END AS tool,
  'find ' || CAST(json_extract(props, '$.k') AS INT) % 7 AS args FROM events"""
_GOVERNED = f"""
WITH c AS ({_CALLS}), a AS (SELECT *, row_number() OVER (PARTITION BY turn_key ORDER BY seq) AS attempt FROM c),
s AS (SELECT *, row_number() OVER (PARTITION BY turn_key, tool, args ORDER BY attempt) AS repeats FROM a WHERE attempt <= 8),
t AS (SELECT *, sum(CASE WHEN repeats = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY turn_key, tool ORDER BY attempt) AS fresh FROM s),
g AS (SELECT turn_key, seq, attempt, CASE WHEN repeats > 1 THEN 'duplicate'
  WHEN fresh > CASE tool WHEN 'webSearch' THEN 2 WHEN 'searchContext' THEN 3 ELSE 8 END THEN 'tool_budget' ELSE 'allow' END AS decision, repeats FROM t
UNION ALL SELECT turn_key, seq, attempt, 'total_budget', 0 FROM a WHERE attempt > 8)"""


@query("govern_calls", f"{_GOVERNED} SELECT * FROM g")
def govern_calls(spark, d):
    return G.govern_calls(event_calls(table(spark, d, "events")))


@query("govern_calls_cut", f"{_GOVERNED} SELECT * FROM g")
def govern_calls_cut(spark, d):
    """The same with the biggest turns cut into blocks."""
    return G.govern_calls(event_calls(table(spark, d, "events")), group_rows=4)


@query("stream_govern_calls", f"{_GOVERNED} SELECT turn_key, seq, decision, repeats FROM g")
def stream_govern_calls(spark, d):
    return ST.run_to_table(ST.govern_calls(event_calls(ST.read_event_stream(spark, d)))).drop("tool", "args")


def _asking_calls(events, spark, d):
    """Calls of the users that have a thread; a search asks for the thread's first question."""
    first = conversations(spark, d).filter(F.col("role") == "user").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("question")).select(F.col("conv_id").alias("user_id"), "question")
    calls = event_calls(events).withColumn("user_id", F.substring_index("turn_key", ":", 1).cast("long"))
    return calls.join(first, "user_id").withColumn("args", F.when(
        F.col("tool") == ST.SEARCH_TOOL, F.col("question")).otherwise(F.col("args"))).drop("user_id", "question")


def _corpus_search(spark, d):
    """Search over all documents as chunks; their profile is stored once and serves every batch."""
    chunks = checkpointed(C.chunk(spread(whole_documents(spark, d).drop("chunk_no"), "doc_id")))
    passages = checkpointed(S.passage_profile(chunks))
    return lambda queries: Z.search_corpus(queries, chunks, 500, passages=passages)


@query("governed_replies")
def governed_replies(spark, d):
    """Replies to the search calls that the governor allows."""
    calls = checkpointed(_asking_calls(table(spark, d, "events"), spark, d))
    decided = G.govern_calls(calls).join(calls.select("turn_key", "seq", "tool", "args"), ["turn_key", "seq"])
    return ST.answer_calls(decided, _corpus_search(spark, d))


@query("stream_governed_replies")
def stream_governed_replies(spark, d):
    """The same over the events as a stream: governed on typed state, answered batch by batch."""
    stream = ST.govern_calls(_asking_calls(ST.read_event_stream(spark, d), spark, d))
    return ST.serve_to_end(stream, _corpus_search(spark, d), new_folder(spark, "streams"))


@query("append_messages", """
SELECT conv_id, turn, role, text, max(turn) OVER w AS updated_at, count(*) OVER w AS n_messages FROM conversations WINDOW w AS (PARTITION BY conv_id)""")
def append_messages(spark, d):
    """Messages appended in three batches, the second one twice, with their thread's last time and size."""
    path = new_folder(spark, "messages")
    sent = conversations(spark, d).withColumn("sent", F.col("turn"))
    for batch in (0, 1, 1, 2):
        A.append_messages(sent.filter(F.col("turn") % 3 == batch), path, batch)
    return A.read_messages(spark, path).drop("sent").join(A.read_threads(spark, path), "conv_id")


_LOOPS = """
WITH c AS (SELECT user_id || event_type AS expression, ts, event_id AS call_id FROM events),
g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS start FROM c WINDOW w AS (PARTITION BY expression ORDER BY ts, call_id)),
s AS (SELECT *, sum(start) OVER (PARTITION BY expression ORDER BY ts, call_id) AS run FROM g),
n AS (SELECT expression, call_id, row_number() OVER (PARTITION BY expression, run ORDER BY ts, call_id) AS n FROM s)
SELECT expression, call_id, n, n > 3 AS blocked FROM n"""


def _loops(events):
    return events.select(F.concat("user_id", "event_type").alias("expression"), "ts", F.col("event_id").alias("call_id"))


@query("loop_guard", _LOOPS)
def loop_guard(spark, d):
    """A user's events of one type as repeated expressions, six hours apart at most."""
    return G.loop_guard(_loops(table(spark, d, "events")), 6 * 3600).drop("ts")


@query("loop_guard_cut", _LOOPS)
def loop_guard_cut(spark, d):
    return G.loop_guard(_loops(table(spark, d, "events")), 6 * 3600, group_rows=10).drop("ts")


@query("stream_loop_guard", _LOOPS)
def stream_loop_guard(spark, d):
    return ST.run_to_end(spark, d, lambda events: ST.loop_guard(_loops(events), window_seconds=6 * 3600))


@query("recent_transcript")
def recent_transcript(spark, d):
    """Messages of a thread as tool replies, rendered into 900 characters."""
    replies = conversations(spark, d).select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("role").alias("tool"),
                                             F.when(F.col("turn") % 3 == 0, " ").otherwise("find it").alias("args"), F.col("text").alias("result"))
    return G.recent_transcript(replies, 900)


_BURSTS = """
WITH c AS (SELECT user_id AS key, ts, event_id FROM events),
l AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS after FROM c)
SELECT key, event_id FROM l WHERE after IS NULL OR after - ts >= INTERVAL 3 HOUR"""
_THREE_HOURS = 3 * 3600 * 1000


def _keyed(events):
    return events.select(F.col("user_id").alias("key"), "ts", "event_id", F.col("event_type").alias("content"))


@query("debounce", _BURSTS)
def debounce(spark, d):
    return G.debounce(_keyed(table(spark, d, "events")).drop("content"), _THREE_HOURS).select("key", "event_id")


@query("debounce_cut", _BURSTS)
def debounce_cut(spark, d):
    return G.debounce(_keyed(table(spark, d, "events")).drop("content"), _THREE_HOURS, group_rows=20).select("key", "event_id")


_CHANGES = """
WITH c AS (SELECT user_id AS key, ts, event_id, event_type AS content FROM events WHERE event_type <> ''),
l AS (SELECT *, lag(content) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM c)
SELECT key, event_id, content FROM l WHERE before IS NULL OR before <> content"""


@query("suppress_unchanged", _CHANGES)
def suppress_unchanged(spark, d):
    return G.suppress_unchanged(_keyed(table(spark, d, "events"))).drop("ts")


@query("stream_suppress_unchanged", _CHANGES)
def stream_suppress_unchanged(spark, d):
    kept = ST.run_to_end(spark, d, lambda events: ST.suppress_unchanged(_keyed(events)))
    return kept.withColumn("key", F.col("key").cast("long"))


_LATEST = """
WITH c AS (SELECT user_id AS key, ts, event_id, CASE WHEN event_type IN ('view', 'click') THEN 'start' ELSE 'result' END AS kind, CAST(json_extract(props, '$.k') AS INT) % 4 AS request_id FROM events),
l AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN request_id END IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, event_id) AS started FROM c)
SELECT key, event_id, coalesce(started = request_id, false) AS accepted FROM l WHERE kind = 'result'"""


def _request_events(spark, d):
    kind = F.when(F.col("event_type").isin("view", "click"), "start").otherwise("result")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), "ts", "event_id", kind.alias("kind"),
                                            (F.get_json_object("props", "$.k").cast("int") % 4).alias("request_id"))


@query("latest_request_wins", _LATEST)
def latest_request_wins(spark, d):
    return G.latest_request_wins(_request_events(spark, d)).select("key", "event_id", "accepted")


@query("latest_request_wins_cut", _LATEST)
def latest_request_wins_cut(spark, d):
    return G.latest_request_wins(_request_events(spark, d), group_rows=20).select("key", "event_id", "accepted")


@query("context_cache_hits", """
WITH c AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS INT) AS k, event_type FROM events),
r AS (SELECT user_id AS session, event_id AS seq, CASE WHEN k % 3 = 0 AND k % 2 <> 0 THEN '' ELSE
  CASE WHEN k % 3 = 0 THEN 'none' ELSE 'ask ' || k % 2 END || ', ' || CASE WHEN k % 2 = 0 THEN event_type ELSE 'offline' END END AS key0, k FROM c),
f AS (SELECT *, CASE WHEN k % 3 = 0 AND k % 2 <> 0 THEN '' ELSE key0 END AS key FROM r),
l AS (SELECT *, lag(key) OVER w AS pk, lag(k % 2) OVER w AS pb, lag(k % 5) OVER w AS pc FROM f WINDOW w AS (PARTITION BY session ORDER BY seq))
SELECT session, seq, coalesce(pk = key AND pb = k % 2 AND (key = '' OR pc > 0), false) AS hit FROM l""")
def context_cache_hits(spark, d):
    """Events as context requests with few distinct contexts, so that neighbours often ask for the same."""
    k = F.get_json_object("props", "$.k").cast("int")
    web = k % 2 == 0
    paths = F.when((k % 3 == 0) & ~web, F.array().cast("array<string>")).otherwise(F.array(F.lit("b.pdf"), F.lit("a.pdf"), F.lit("b.pdf")))
    key = G.context_key(F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit(" Ask "), k % 2)), paths, F.array().cast("array<string>"),
                        web, F.lit(False), F.upper("event_type"), F.lit(6), F.lit(2))
    requests = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), key.alias("key"),
                                                (k % 2).alias("budget"), (k % 5).alias("n_chunks"))
    return G.context_cache_hits(requests).select("session", "seq", "hit")


@query("job_progress", """
WITH e AS (SELECT user_id AS job, event_id AS seq, event_type <> 'error' AS ok FROM events)
SELECT job, seq, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY seq) AS done, count(*) OVER (PARTITION BY job) AS total,
  sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY seq) / count(*) OVER (PARTITION BY job) AS progress FROM e""")
def job_progress(spark, d):
    items = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"),
                                             (F.col("event_type") != "error").alias("completed"))
    return G.job_progress(items)


@query("retry_outcomes", """
WITH e AS (SELECT event_id AS request, event_id % 2 = 0 AS tools, event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
x AS (SELECT request, tools, CASE event_type WHEN 'view' THEN NULL WHEN 'error' THEN 'GuardrailViolation' WHEN 'click' THEN 'exceededContextWindowSize' WHEN 'purchase' THEN 'cancelled' ELSE 'rateLimited' END AS e0,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'cancelled' ELSE 'again' END AS e1, CASE WHEN k % 2 = 0 THEN NULL ELSE 'last' END AS e2 FROM e),
t AS (SELECT *, e0 IS NOT NULL AND e0 NOT IN ('GuardrailViolation', 'cancelled') AS transient FROM x)
SELECT request, CASE WHEN e0 IS NULL THEN 'first' WHEN e0 = 'cancelled' THEN 'cancelled' WHEN transient AND e1 IS NULL THEN 'retry' WHEN transient AND e1 = 'cancelled' THEN 'cancelled'
  WHEN tools AND CASE WHEN transient THEN e2 ELSE e1 END IS NULL THEN 'without_tools' ELSE 'failed' END AS outcome,
  CASE WHEN e0 IS NULL OR e0 = 'cancelled' THEN 1 WHEN transient AND (e1 IS NULL OR e1 = 'cancelled') THEN 2 ELSE CASE WHEN transient THEN 2 ELSE 1 END + CASE WHEN tools THEN 1 ELSE 0 END END AS calls FROM t""")
def retry_outcomes(spark, d):
    k, kind = F.get_json_object("props", "$.k").cast("int"), F.col("event_type")
    first = (F.when(kind == "error", "GuardrailViolation").when(kind == "click", "exceededContextWindowSize")
             .when(kind == "purchase", "cancelled").when(kind != "view", "rateLimited"))
    second = F.when(k % 3 == 1, "cancelled").when(k % 3 == 2, "again")
    attempts = table(spark, d, "events").select(F.col("event_id").alias("request"), (F.col("event_id") % 2 == 0).alias("with_tools"),
                                                F.array(first, second, F.when(k % 2 == 1, "last")).alias("errors"))
    return G.retry_outcomes(attempts)


def _micros(df):
    return df.withColumn("window_start", F.unix_micros("window_start")).withColumn("total", F.round("total", 6))


def _tooled(events):
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"), "value")


_TUMBLING = """SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS window_start, event_type AS tool, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL"""


@query("windowed_event_stats", _TUMBLING)
def windowed_event_stats(spark, d):
    return _micros(G.windowed_event_stats(_tooled(table(spark, d, "events")), "6 hours"))


@query("sliding_event_stats", """
WITH w AS (SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 3 HOUR AS s, event_type, value FROM events, (SELECT unnest([0, 1]) AS i))
SELECT epoch_us(s) AS window_start, event_type AS tool, count(*) AS n, round(sum(value), 6) AS total FROM w GROUP BY ALL""")
def sliding_event_stats(spark, d):
    return _micros(G.windowed_event_stats(_tooled(table(spark, d, "events")), "6 hours", "3 hours"))


@query("stream_windowed_event_stats", _TUMBLING)
def stream_windowed_event_stats(spark, d):
    return _micros(ST.run_to_end(spark, d, lambda events: ST.windowed_event_stats(_tooled(events), "6 hours")))


@query("stream_debounce", _BURSTS)
def stream_debounce(spark, d):
    return ST.run_to_end(spark, d, lambda events: ST.debounce(_keyed(events), millis=_THREE_HOURS)).select("key", "event_id")


# --- lookups -----------------------------------------------------------------------------------------


@query("resolve_language", """
SELECT doc_id, CASE WHEN lang IN ('en', 'fr', 'es') THEN lang WHEN doc_id % 2 = 0 THEN 'es' ELSE 'en' END AS lang FROM documents""")
def resolve_language(spark, d):
    prefs = F.array(F.concat(F.upper("lang"), F.lit("-XX")), F.when(F.col("doc_id") % 2 == 0, "es-MX").otherwise("pt-BR"))
    return table(spark, d, "documents").select("doc_id", J.resolve_language(prefs).alias("lang"))


# The first word of a text is a key of its language.
_FIRST_WORD = "regexp_extract(text, '^[A-Za-z]+')"
_CATALOG = f"SELECT DISTINCT lang, {_FIRST_WORD} AS key, lang || '/' || {_FIRST_WORD} AS value FROM documents"


def _catalog(spark, d):
    first = F.regexp_extract("text", "^[A-Za-z]+", 0)
    return table(spark, d, "documents").select(
        "lang", first.alias("key"), F.concat("lang", F.lit("/"), first).alias("value")).distinct()


@query("lookup_strings", f"""
WITH c AS ({_CATALOG}), d AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'fr' WHEN 'fr' THEN 'es' ELSE lang END AS lang, {_FIRST_WORD} AS key FROM documents)
SELECT d.doc_id, d.lang, d.key, coalesce(o.value, e.value, d.key) AS text FROM d
LEFT JOIN c o ON o.lang = d.lang AND o.key = d.key LEFT JOIN c e ON e.lang = 'en' AND e.key = d.key""")
def lookup_strings(spark, d):
    """Strings from all documents; English ones are asked for in French, French ones in Spanish."""
    asked = F.when(F.col("lang") == "en", "fr").when(F.col("lang") == "fr", "es").otherwise(F.col("lang"))
    wanted = table(spark, d, "documents").select("doc_id", asked.alias("lang"), F.regexp_extract("text", "^[A-Za-z]+", 0).alias("key"))
    return J.lookup_strings(wanted, _catalog(spark, d))


@query("missing_keys", f"""
WITH c AS ({_CATALOG}) SELECT l.lang, c.key FROM c, (SELECT unnest(['fr', 'es']) AS lang) l WHERE c.lang = 'en' AND (l.lang, c.key) NOT IN (SELECT lang, key FROM c)""")
def missing_keys(spark, d):
    return J.missing_keys(_catalog(spark, d))


_FIRST = "SELECT user_id, epoch_us(min(ts)) AS first_seen, min(ts) < TIMESTAMP '2024-01-02' AS founding FROM events GROUP BY user_id"


@query("first_seen_cohort", _FIRST)
def first_seen_cohort(spark, d):
    cohort = J.first_seen_cohort(table(spark, d, "events"), "2024-01-02")
    return cohort.withColumn("first_seen", F.unix_micros(F.col("first_seen").cast("timestamp")))


@query("entitled_users", f"""
WITH f AS ({_FIRST}), p AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 50 AND event_id % 2 = 0) AS owned FROM events GROUP BY user_id)
SELECT user_id, owned, founding OR owned AS access, CASE WHEN founding OR owned THEN user_id % 20 ELSE least(user_id % 20, 1) END AS result_cap,
  CASE WHEN founding OR owned THEN user_id * 10 ELSE least(user_id * 10, 500) END AS token_cap FROM f JOIN p USING (user_id)""")
def entitled_users(spark, d):
    """Purchases above 50 count as the product, odd ones were revoked."""
    events = table(spark, d, "events")
    users = J.first_seen_cohort(events, "2024-01-02").select(
        "user_id", "founding", (F.col("user_id") % 20).alias("requested_results"), (F.col("user_id") * 10).alias("requested_tokens"))
    purchases = events.select("user_id", F.when(F.col("value") > 50, "premium").otherwise("other").alias("product"),
                              (F.col("event_type") == "purchase").alias("verified"), (F.col("event_id") % 2 == 1).alias("revoked"))
    return J.entitled_users(users, purchases, "premium")


# Results that a provider sends a question, by how many places the second provider's list starts behind the first's,
# and by how many the lists of the next question do.
_SENT, _SHIFT, _STRIDE = 6, 2, 8


def dealt_results(questions, pages):
    """Two overlapping result lists for every question: questions (query_id), pages (n, page_id, url, sent).

    Pages go round over the numbered questions, eight other ones a question, so each question has its own and every
    page is some question's while there are at most eight times as many. The first provider sends the text it has
    of a page along.
    """
    place = F.explode(F.sequence(F.lit(0), F.lit(_SENT - 1))).alias("pos")
    slots = (numbered(questions.select("query_id"), "query_id", "i")
             .select("query_id", "i", F.explode(F.array(F.lit(0), F.lit(1))).alias("list_no"))
             .select("*", place)
             .select("query_id", "list_no", "pos", F.pmod(
                 F.col("i") * _STRIDE + F.col("pos") + F.col("list_no") * _SHIFT,
                 F.lit(max(1, pages.count()))).alias("n")))
    return slots.join(pages.drop("text"), "n").select(
        "query_id", "list_no", "pos", "url", F.concat(F.lit("Page "), "page_id").alias("title"),
        F.lit("snippet").alias("snippet"), F.when(F.col("list_no") == 0, F.col("sent")).alias("retrieved"))


def _asked(spark, d):
    return conversations(spark, d).filter(F.col("role") == "user").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.min_by("text", "turn").alias("query"))


@query("search_and_summarise")
def search_and_summarise(spark, d):
    """Whole search job: two result lists for every conversation's first question, page text where the provider sent none.

    A row per shown result with its share; the context and the citations of a question stand beside its first result.
    """
    from ..functions.text import html_to_text

    asked = checkpointed(_asked(spark, d))
    raw = table(spark, d, "pages")
    article = html_to_text(F.regexp_extract("html", "(?s)<article[^>]*>(.*)</article>", 1))
    pages = checkpointed(spread(raw, "page_id").join(numbered(raw.select("page_id"), "page_id", "n"), "page_id").select(
        "n", "page_id", "url", html_to_text("html").alias("text"),
        F.when(F.col("page_id") % 3 == 0, article).alias("sent")))
    out = jobs.search_and_summarise(asked, dealt_results(asked, pages), pages.select("url", "text"))
    answers = asked.select("query_id", F.lit(1).alias("place")).join(out["context"], "query_id", "left").join(
        out["citations"], "query_id", "left")
    shown = out["reranked"].join(out["percent"], ["query_id", "url"], "left").join(out["rungs"], ["query_id", "url"], "left")
    # A question without any result keeps its row.
    return shown.join(answers, ["query_id", "place"], "full").select(
        "query_id", "url", "place", F.coalesce("pct", F.lit(0)).alias("pct"), "rung", "context", "citations")
