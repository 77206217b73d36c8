"""Queries over documents and pages: sources, text preparation, tables, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K, markup, text as X, urls as U
from ..operators import chunking as C, layout as L, scoring as S, threads as P
from ..scale import computed, spread
from ..session import ensure_checkpoint_dir, new_folder, table
from ..sources import tables as A
from . import sql as Q
from .registry import query, whole_documents

_DOCS = "documents"


def documents(spark, d):
    return spread(table(spark, d, _DOCS), "doc_id")


def pages(spark, d):
    return spread(table(spark, d, "pages"), "page_id")


# --- sources -----------------------------------------------------------------------------------------


@query("read_corpus", f"""
SELECT 'document' AS origin, doc_id, 'PDF: ' || source AS source, NULL AS url, lang, text FROM documents
UNION ALL
SELECT 'page', page_id, 'Web: ' || url, url, regexp_extract(html, '<html lang="([a-z]+)"', 1), {Q.page_text('html')} FROM pages""")
def read_corpus(spark, d):
    return A.read_corpus(spark, d, page_chars=None)


_SLUG = "concat('Page_', page_id)"


@query("ingest_encyclopedia", f"""
WITH hits AS (SELECT page_id AS query_id, page_id % 2 AS french, unnest([0, 1, 2]) AS pos FROM pages),
keyed AS (SELECT query_id, french, pos, (query_id + pos * 3) AS target FROM hits),
joined AS (SELECT k.*, p.url, p.html FROM keyed k LEFT JOIN pages p ON p.page_id = k.target AND p.page_id % 2 = k.french)
SELECT query_id, pos, CASE WHEN pos = 1 THEN 'Page ' || target ELSE 'Title ' || target END AS title,
  CASE WHEN url IS NULL OR target % 4 = 3 THEN 'https://' || CASE WHEN french = 1 THEN 'fr' ELSE 'en' END
       || '.wikipedia.org/wiki/Page_' || target
       WHEN target % 3 = 0 THEN url ELSE 'https://mirror.example.org/' || target END AS url,
  CASE WHEN pos = 2 THEN 'Wikipedia page' ELSE 'found & ' || target END AS snippet,
  CASE WHEN url IS NOT NULL AND target % 5 <> 0 THEN nullif({Q.trim('html')}, '') END AS retrieved
FROM joined""")
def ingest_encyclopedia(spark, d):
    """Each page asks for three keys; details exist for keys of the same parity."""
    base = table(spark, d, "pages")
    lang = F.when(F.col("page_id") % 2 == 1, "fr").otherwise("en")

    def hit(pos):
        target = F.col("page_id") + pos * 3
        return F.struct(
            F.concat(F.lit("Page_"), target).alias("key"),
            F.lit(" ").alias("title") if pos == 1 else F.concat(F.lit(" Title "), target).alias("title"),
            (F.lit("<i></i>") if pos == 2 else F.concat(F.lit("<b>found</b> &amp; "), target)).alias("excerpt"),
            F.lit("unused").alias("description"))

    searches = base.select(F.col("page_id").alias("query_id"), lang.alias("lang"),
                           F.to_json(F.struct(F.array(*[hit(i) for i in range(3)]).alias("pages"))).alias("body"))
    page = F.col("page_id")
    built = page % 4 == 3
    details = base.select(lang.alias("lang"), F.to_json(F.struct(
        F.concat(F.lit("Page_"), page).alias("key"), F.lit("t").alias("title"),
        F.when(page % 5 != 0, F.col("html")).otherwise("  ").alias("source"),
        F.when(~built & (page % 3 == 0), F.struct(F.struct(F.col("url").alias("page")).alias("desktop"))).alias("content_urls"),
        F.when(~built, F.concat(F.lit("https://mirror.example.org/"), page)).alias("html_url"))).alias("body"))
    return A.ingest_encyclopedia(searches, details, 3)


@query("extract_links", """
SELECT page_id, pos, CASE WHEN pos % 3 = 1 THEN url ELSE url || '&p=' || pos END AS url,
  CASE WHEN pos = 2 THEN 'Result 2' ELSE 'Hit ' || pos || ' <' || page_id || '>' END AS title,
  CASE WHEN pos % 4 = 0 THEN 'No description available' ELSE 'about "' || page_id || '"' END AS snippet
FROM pages, (SELECT unnest([1, 2, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20]) AS pos)""")
def extract_links(spark, d):
    """The crawled pages, which hold no results, with result pages built from their URLs behind: 25 items each, the third
    without a link."""
    def item(pos):
        if pos == 3:
            return F.lit(' name="x">none</a>')
        link = F.concat(F.lit("//duckduckgo.com/l/?x=1&uddg="), F.url_encode("url"), F.lit("&rut=abc")) \
            if pos % 3 == 1 else F.concat("url", F.lit(f"&p={pos}"))
        title = F.lit("<b></b>") if pos == 2 else F.concat(F.lit(f"<b>Hit</b> {pos} &lt;"), "page_id", F.lit("&gt;"))
        tag = "a" if pos % 2 else "div"
        body = F.lit("") if pos % 4 == 0 else F.concat(F.lit("about &quot;"), "page_id", F.lit("&quot;"))
        return F.concat(F.lit(' href="'), link, F.lit('">'), title, F.lit(f'</a><{tag} class="x result__snippet">'), body,
                        F.lit(f"</{tag}>"))

    parts = [F.concat("html", F.lit("<html><a "))] + [item(i) for i in range(1, 26)]
    html = F.concat_ws('<a class="result__a"', *parts)
    return A.extract_links(table(spark, d, "pages").select("page_id", html.alias("html")))


_ANCHOR = "(?is)(<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"


@query("extract_anchors", f"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '{_ANCHOR}', 1) AS found FROM pages),
l AS (SELECT page_id, {Q.unnest_at('found', 'pos', 'a')} FROM a)
SELECT page_id, pos, regexp_extract(a, '(?i)href="([^"]*)"', 1) AS href,
  {Q.snippet("regexp_extract(a, '(?s)>(.*)</[aA]>$', 1)")} AS title FROM l""")
def extract_anchors(spark, d):
    return A.extract_anchors(pages(spark, d))


@query("read_catalogs", """
WITH files AS (SELECT doc_id, 'strings' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.' || lang || '.json' AS file, lang, source, n_chars
  FROM documents WHERE lang IN ('en', 'fr', 'es'))
SELECT lang, source AS key, arg_max(CAST(n_chars AS VARCHAR), file) AS value FROM files GROUP BY ALL""")
def read_catalogs(spark, d):
    """Catalog files for every hundred documents and language, written and read back: a source is a key, the length of its
    last document the text; later files win."""
    group = F.lpad(F.floor(F.col("doc_id") / 100).cast("string"), 12, "0")
    last = table(spark, d, _DOCS).filter(F.col("lang").isin("en", "fr", "es")).groupBy(
        F.concat(F.lit("strings"), group, F.lit("."), "lang", F.lit(".json")).alias("name"), "source").agg(
        F.max_by("n_chars", "doc_id").cast("string").alias("text"))
    files = last.groupBy("name").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("source", "text")))).alias("value"))
    return A.read_catalogs(_written(spark, files))


def _written(spark, files):
    """Files (name, value) written to the shared folder and read back from there."""
    path = new_folder(spark, "files")
    A.write_files(files, path)
    return A.read_files(spark, path)


@query("resolve_template", """
WITH t AS (SELECT DISTINCT source, lang FROM documents WHERE lang IN ('en', 'fr', 'es'))
SELECT d.doc_id AS query_id, 'normal' AS mode, d.source AS feature, CASE WHEN d.doc_id % 3 = 0 THEN 'instructions' WHEN d.doc_id % 3 = 1 THEN 'other' END AS variant,
  d.lang, CASE WHEN t.source IS NULL THEN NULL WHEN d.doc_id % 3 = 0 THEN 'Instructions ' ELSE 'Prompt ' END || t.source || '/' || t.lang AS text
FROM documents d LEFT JOIN t USING (source, lang)""")
def resolve_template(spark, d):
    """Templates named after the sources and languages at hand, asked for by every document."""
    docs = table(spark, d, _DOCS)
    pairs = docs.select("source", "lang").distinct()
    named = lambda variant, head: pairs.select(
        F.concat(F.lit("prompt.normal."), "source", F.lit(variant), F.lit("."), "lang", F.lit(".txt")).alias("name"),
        F.concat(F.lit(head), "source", F.lit("/"), "lang").alias("value"))
    files = named("", "Prompt ").unionByName(named(".instructions", "Instructions "))
    templates = A.read_templates(_written(spark, files))
    templates = templates.filter(F.col("lang").isin("en", "fr", "es"))
    wanted = docs.select(F.col("doc_id").alias("query_id"), F.lit("normal").alias("mode"), F.col("source").alias("feature"),
                         F.when(F.col("doc_id") % 3 == 0, "instructions").when(F.col("doc_id") % 3 == 1, "other").alias("variant"),
                         "lang")
    return A.resolve_template(wanted, templates)


@query("fill_template", """
SELECT doc_id AS query_id, 'From ' || source || ' (' || lang || '): ' || n_chars || ' characters, ' || n_chars || '.' || chr(10) || '{{other}} stays' AS prompt
FROM documents WHERE lang IN ('en', 'fr', 'es')""")
def fill_template(spark, d):
    """Templates of two lines, written as files and read back, filled for every document."""
    docs = table(spark, d, _DOCS).filter(F.col("lang").isin("en", "fr", "es"))
    files = docs.select("source", "lang").distinct().select(
        F.concat(F.lit("prompt.normal."), "source", F.lit("."), "lang", F.lit(".txt")).alias("name"),
        F.lit("From {{source}} ({{lang}}): {{n}} characters, {{n}}.\n{{other}} stays").alias("value"))
    wanted = docs.select(F.col("doc_id").alias("query_id"), F.lit("normal").alias("mode"), F.col("source").alias("feature"),
                         F.lit(None).cast("string").alias("variant"), "lang", F.col("n_chars").cast("string").alias("n"))
    found = A.resolve_template(wanted, A.read_templates(_written(spark, files)))
    filled = P.fill_template(F.col("text"), {"source": F.col("feature"), "lang": F.col("lang"), "n": F.col("n")})
    return found.select("query_id", filled.alias("prompt"))


@query("write_chunks", """
SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang""")
def write_chunks(spark, d):
    """Write the documents as passages by language to the shared folder, twice, and read them back."""
    from uuid import uuid4

    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid4().hex}"
    chunks = table(spark, d, _DOCS).select("doc_id", F.lit(0).alias("chunk_no"), "source", "lang", "text")
    for _ in range(2):
        A.write_chunks(chunks, path)
    return spark.read.parquet(path).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("migrate_settings", """
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
r AS (SELECT *, least(greatest(CASE WHEN event_id % 2 = 0 THEN k * 50 ELSE 500 END, 500), 3500) AS resp FROM e),
c AS (SELECT *, CASE event_id % 4 WHEN 0 THEN k * 40 WHEN 1 THEN greatest(1, CAST(floor(k * 30 * 5 / 3) AS INT))
  WHEN 2 THEN greatest(1, k * 100 // 3) ELSE 3400 END AS req,
  least(3500, greatest(4096 - 100 - 80 - least(greatest(resp, 1), 3616), 300)) AS up FROM r)
SELECT event_id AS id, least(greatest(CASE WHEN event_id % 3 = 0 THEN k WHEN event_id % 3 = 1 THEN k // 2 ELSE 6 END, 1), 20) AS web_results,
  least(greatest(CASE WHEN event_id % 5 = 0 THEN k ELSE 2 END, 1), 20) AS encyclopedia_results, resp AS response_tokens,
  CASE WHEN event_id % 7 = 0 THEN least(greatest(CAST(k AS DOUBLE) / 50, 0.3), 1.0) ELSE 0.4 END AS temperature,
  least(greatest(req, least(300, up)), up) AS context_tokens FROM c""")
def migrate_settings(spark, d):
    """Settings derived from the event properties: current, legacy and missing keys."""
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    fields = {
        "maxDuckDuckGoResults": F.when(n % 3 == 0, k), "maxSearchResults": F.when(n % 3 == 1, F.floor(k / 2).cast("int")),
        "maxWikipediaResults": F.when(n % 5 == 0, k), "maxResponseTokens": F.when(n % 2 == 0, k * 50),
        "temperature": F.when(n % 7 == 0, k / 50), "maxContextTokens": F.when(n % 4 == 0, k * 40),
        "maxContextWords": F.when(n % 4 == 1, k * 30), "maxScrapingCharacters": F.when(n % 4 == 2, k * 100)}
    stored = table(spark, d, "events").select(
        n.alias("id"), F.to_json(F.struct(*[v.alias(name) for name, v in fields.items()])).alias("json"))
    return A.migrate_settings(stored)


_PARAMS = "string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')"


@query("explode_query_params", f"""
WITH u AS (SELECT url, list_filter({_PARAMS}, lambda p: p <> '') AS items FROM pages),
l AS (SELECT url, {Q.unnest_at('items', 'pos', 'item')} FROM u)
SELECT url, pos, split_part(item, '=', 1) AS name, {Q.trim("url_decode(substr(item, instr(item, '=') + 1))")} AS value
FROM l WHERE contains(item, '=') AND {Q.trim("url_decode(substr(item, instr(item, '=') + 1))")} <> ''""")
def explode_query_params(spark, d):
    return A.explode_query_params(table(spark, d, "pages").select("url"))


@query("route_shared_links", """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'share' WHEN 1 THEN 'search' WHEN 2 THEN 'search' WHEN 3 THEN 'url' WHEN 4 THEN 'link' ELSE 'none' END AS action,
  CASE page_id % 6 WHEN 1 THEN 'page ' || page_id WHEN 2 THEN '' END AS query,
  CASE page_id % 6 WHEN 0 THEN url || '|x' WHEN 3 THEN url WHEN 4 THEN url ELSE '' END AS urls,
  CASE WHEN page_id % 6 = 0 THEN page_id || '.pdf' ELSE '' END AS pdfs FROM pages""")
def route_shared_links(spark, d):
    n, enc = F.col("page_id") % 6, F.url_encode("url")
    link = (F.when(n == 0, F.concat(F.lit("mill://share?url="), enc, F.lit("&url=x&sharedPDF="), "page_id", F.lit(".pdf&q=no")))
            .when(n == 1, F.concat(F.lit("mill://search?q=page%20"), "page_id", F.lit("&url=y")))
            .when(n == 2, F.lit("MILL://Search?lang=en")).when(n == 3, F.concat(F.lit("mill://open?url="), enc))
            .when(n == 4, F.col("url")).otherwise(F.concat(F.lit("mill://open/"), "page_id")))
    links = table(spark, d, "pages").select("page_id", link.alias("link"))
    routed = A.route_shared_links(links.select("link").distinct(), "mill")
    return links.join(routed, "link").select("page_id", "action", "query", F.array_join("urls", "|").alias("urls"),
                                             F.array_join("pdfs", "|").alias("pdfs"))


# --- text preparation --------------------------------------------------------------------------------


@query("normalize_ws", f"SELECT doc_id, {Q.normalized(chr(10).join(['replace(text, chr(32), chr(32) || chr(9) || chr(160))']))} AS text FROM documents")
def normalize_ws(spark, d):
    """Blanks are first widened to blank, tab and no-break blank, so that every run has to be collapsed."""
    wide = F.replace(F.col("text"), F.lit(" "), F.lit(" \t\u00A0"))
    return documents(spark, d).select("doc_id", X.normalize_ws(wide).alias("text"))


@query("html_to_text", f"SELECT page_id, {Q.page_text('html')} AS text FROM pages")
def html_to_text(spark, d):
    return pages(spark, d).select("page_id", X.html_to_text("html", None).alias("text"))


@query("snippet_text", f"SELECT page_id, {Q.snippet('html')} AS text FROM pages")
def snippet_text(spark, d):
    return pages(spark, d).select("page_id", X.snippet_text("html").alias("text"))


@query("decode_entities", f"""
SELECT page_id, {Q.entities('html')} || ' ' || chr(CAST(945 + page_id % 24 AS INT)) || chr(CAST(65 + page_id % 26 AS INT)) || ' &unknown; &lt;' AS text FROM pages""")
def decode_entities(spark, d):
    """Page source followed by a decimal, a hexadecimal, an unknown and a doubly escaped reference."""
    tail = F.concat(F.lit(" &#"), 945 + F.col("page_id") % 24, F.lit(";&#x"), F.hex(65 + F.col("page_id") % 26),
                    F.lit("; &unknown; &amp;lt;"))
    return pages(spark, d).select("page_id", X.decode_entities(F.concat("html", tail)).alias("text"))


@query("html_tables", """
SELECT c_custkey AS page_id, 'before' || chr(10) || chr(10) || '| Name | Balance & more |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name
  || ' | ' || c_nationkey || '\\|' || c_custkey || ' |' || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || '| only |  |' ELSE '' END
  || chr(10) || chr(10) || 'after' AS text, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END AS n_rows FROM customer""")
def html_tables(spark, d):
    """One page per customer with a table that has an empty row, escaped pipes and uneven rows."""
    html = F.concat(
        F.lit("before<TABLE class=x><tr><th>Name</th><th>Balance &amp; more</th></tr><tr><td> <b>"), "c_name",
        F.lit("</b></td><td>"), "c_nationkey", F.lit("|"), "c_custkey", F.lit("</td></tr><tr><td> </td><td></td></tr>"),
        F.when(F.col("c_custkey") % 2 == 0, "<tr><td>only</td></tr>").otherwise(""), F.lit("</TABLE>after"))
    base = computed(table(spark, d, "customer").select(F.col("c_custkey").alias("page_id"), html.alias("html")),
                    html=F.col("html"))
    return spread(base, "page_id").select("page_id", markup.tables_to_markdown("html").alias("text"),
                       F.size(F.get(markup.html_tables("html"), F.lit(0))).alias("n_rows"))


@query("aligned_tables", """
WITH o AS (SELECT o_orderkey AS doc_id, o_custkey AS c, unnest(range(1, o_orderkey % 6 + 3)) AS i FROM orders),
x AS (SELECT *, (doc_id + i) % 3 = 0 AS extra FROM o),
l AS (SELECT *, 2 * sum(CASE WHEN extra THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) > count(*) OVER (PARTITION BY doc_id) + 1 AS wide FROM x)
SELECT doc_id, 'intro text' || chr(10) || CASE WHEN any_value(wide) THEN '| Part name | Customer | Line |  |' || chr(10) || '| --- | --- | --- | --- |'
    ELSE '| Part name | Customer | Line |' || chr(10) || '| --- | --- | --- |' END || chr(10) ||
  string_agg('| part ' || (doc_id + i) || ' | ' || c || ' | ' || i || CASE WHEN extra THEN CASE WHEN wide THEN ' | extra' ELSE ' extra' END WHEN wide THEN ' | ' ELSE '' END
    || ' |', chr(10) ORDER BY i) || chr(10) || 'prose' || chr(10) || 'lone wide line' || chr(10) || 'end' AS text FROM l GROUP BY doc_id""")
def aligned_tables(spark, d):
    """One text per order: a table aligned with blanks, some rows with a surplus cell, a lone wide line."""
    key = F.col("o_orderkey")
    lines = F.transform(F.sequence(F.lit(1).cast("long"), key % 6 + 2), lambda i: F.concat(
        F.lit("part "), key + i, F.lit("    "), F.col("o_custkey"), F.lit("\t  "), i, F.when((key + i) % 3 == 0, "   extra").otherwise("")))
    text = F.concat(F.lit("intro text\nPart name    Customer    Line\n"), F.array_join(lines, "\n"),
                    F.lit("\nprose\nlone    wide    line\nend"))
    docs = computed(table(spark, d, "orders").select(key.alias("doc_id"), text.alias("text")), text=F.col("text"))
    return spread(docs, "doc_id").select("doc_id", markup.aligned_text_to_tables("text").alias("text"))


@query("clean_answers")
def clean_answers(spark, d):
    return computed(documents(spark, d), text=X.escape_currency("text")).select(
        "doc_id", X.headings_to_bold(X.digit_powers(X.split_commands("text"))).alias("text"))


_HEAD = Q.replace_all("text", "(?m)^\\s*#{1,6}\\s*(.+?)\\s*#{0,6}\\s*$", "**\\1**")


@query("headings_to_bold", f"""
SELECT doc_id, {Q.replace_all(_HEAD, "(?m)^\\s*#{1,6}\\s*(.+?)\\s*$", "**\\1**")} AS text FROM (
  SELECT doc_id, '## Title ' || doc_id || ' ##' || chr(10) || text AS text FROM documents)""")
def headings_to_bold(spark, d):
    titled = F.concat(F.lit("## Title "), "doc_id", F.lit(" ##\n"), "text")
    return documents(spark, d).select("doc_id", X.headings_to_bold(titled).alias("text"))


# Marks and what lies between them, with both neighbours; a fold carries whether a formula is open.
@query("escape_currency", """
WITH t AS (SELECT doc_id, 'Cost $' || doc_id || ' or ' || doc_id || '$ but $x_' || doc_id || '$ and $$y$$ or \\$5 ' || source || ' ' || text AS text
  FROM documents),
k AS (SELECT doc_id, regexp_extract_all(text, '\\\\\\$|\\$\\$|\\$|[^\\\\$]+|\\\\') AS k FROM t),
z AS (SELECT doc_id, list_transform(range(1, len(k) + 1), lambda i: {'open': false, 'out': '', 'mark': k[i] = '$',
  'digit': regexp_matches(coalesce(k[i - 1], ''), '\\p{N}$') OR regexp_matches(coalesce(k[i + 1], ''), '^\\p{N}'), 'piece': k[i]}) AS z FROM k),
f AS (SELECT doc_id, list_reduce(list_prepend({'open': false, 'out': '', 'mark': false, 'digit': false, 'piece': ''}, z), lambda a, x: {
  'open': CASE WHEN x.mark AND (a.open OR NOT x.digit) THEN NOT a.open ELSE a.open END,
  'out': a.out || CASE WHEN x.mark AND NOT a.open AND x.digit THEN '\\$' ELSE x.piece END,
  'mark': false, 'digit': false, 'piece': ''}) AS s FROM z)
SELECT doc_id, s.out AS text FROM f""")
def escape_currency(spark, d):
    """A made-up sentence with every kind of dollar before each document's whole text."""
    raw = F.concat(F.lit("Cost $"), "doc_id", F.lit(" or "), "doc_id", F.lit("$ but $x_"), "doc_id",
                   F.lit("$ and $$y$$ or \\$5 "), "source", F.lit(" "), "text")
    return computed(spread(table(spark, d, _DOCS), "doc_id"), t=raw).select("doc_id", X.escape_currency("t").alias("text"))


@query("strip_document_wrappers", f"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {Q.trim('text')} ELSE {Q.trim("'intro' || chr(10) || chr(10) || text")} END AS text FROM documents""")
def strip_document_wrappers(spark, d):
    whole = F.concat(F.lit("\\documentclass[a4]{article}\n\\usepackage{x}\n\\begin{document}\n"), "text",
                     F.lit("\n\\end{document}\nrest"))
    open_ended = F.concat(F.lit("intro\n\\begin{document}\n"), "text")
    raw = F.when(F.col("doc_id") % 2 == 0, whole).otherwise(open_ended)
    return computed(documents(spark, d), t=raw).select("doc_id", X.strip_document_wrappers("t").alias("text"))


@query("extract_urls", """
SELECT page_id, unnest(list_distinct([url, 'https://x.example.org/' || page_id])) AS url FROM pages""")
def extract_urls(spark, d):
    said = F.concat(F.lit("See "), "url", F.lit(". Again ("), "url", F.lit("); and [x](https://x.example.org/"), "page_id",
                    F.lit("), www.example.org")) 
    return A.extract_urls(table(spark, d, "pages").select("page_id", said.alias("t")), "page_id", "t")


@query("extract_citation_links", """
SELECT page_id, pos, CASE WHEN pos = 0 THEN url ELSE 'https://x.example.org/' || page_id END AS url
FROM pages, (SELECT unnest([0, 1]) AS pos) WHERE pos = 0 OR page_id % 2 = 1""")
def extract_citation_links(spark, d):
    """Odd pages cite with Markdown links; even pages name plain links only, one of them twice."""
    marked = F.concat(F.lit("[a]("), "url", F.lit(") https://ignored.example.org [b](https://x.example.org/"), "page_id",
                      F.lit(") [c]("), "url", F.lit(")"))
    plain = F.concat(F.lit("plain "), "url", F.lit(". and "), "url", F.lit(";"))
    said = F.when(F.col("page_id") % 2 == 1, marked).otherwise(plain)
    return A.extract_citation_links(table(spark, d, "pages").select("page_id", said.alias("t")), "page_id", "t")


@query("truncate_words", f"""
WITH w AS (SELECT doc_id, text, {Q.word_pieces('text')} AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 60 THEN {Q.trim(Q.first_words('text', 'l', 60))} ELSE text END AS text FROM w""")
def truncate_words(spark, d):
    return documents(spark, d).select("doc_id", X.truncate_words("text", 60).alias("text"))


@query("paragraphs", f"""
WITH p AS (SELECT doc_id, list_filter(string_split({Q.replace_all("replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10) || chr(10))", "\\n[ \\t]*\\n([ \\t]*\\n)*", chr(10) * 2)}, chr(10) || chr(10)),
  lambda x: {Q.trim('x')} <> '') AS l FROM documents)
SELECT doc_id, {Q.unnest_at('l', 'para_no', 'text')} FROM p""")
def paragraphs(spark, d):
    """Sentence-ending lines are first parted by blank lines."""
    parted = F.replace(F.col("text"), F.lit(".\n"), F.lit(".\n \n\n"))
    return documents(spark, d).select("doc_id", F.posexplode(X.paragraphs(parted)).alias("para_no", "text"))


@query("sentences", f"""
WITH s AS (SELECT doc_id, {Q.sentences('text')} AS l FROM documents)
SELECT doc_id, {Q.unnest_at('l', 'sent_no', 'text')} FROM s""")
def sentences(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.sentences("text")).alias("sent_no", "text"))


@query("safe_segments")
def safe_segments(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(X.safe_segments("text")).alias("seg_no", "end_off"))


@query("reading_order")
def reading_order(spark, d):
    """Lines of an order as recognised boxes on a page, in two columns."""
    n = F.col("l_linenumber")
    boxes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page_id"), n.cast("long").alias("obs_id"),
        F.concat(F.lit("part number "), "l_partkey", F.lit(" of supplier "), "l_suppkey").alias("text"),
        F.when(n % 2 == 0, 0.58).otherwise(0.08).alias("x"), (0.9 - F.floor((n - 1) / 2) * 0.06 - (n % 2) * 0.005).alias("y"),
        F.lit(0.3).alias("w"), F.lit(0.03).alias("h"))
    return L.reading_order(boxes)


@query("stitch_pages", f"""
WITH g AS (SELECT d.doc_id // 5 AS doc_id, d.doc_id % 5 + 1 AS page_no, {Q.trim('d.text')} AS t, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, string_agg('[Rendered webpage page ' || page_no || ']' || chr(10) || CASE WHEN page_no = 2 THEN '' ELSE t || CASE WHEN quality IS NULL THEN '' ELSE chr(10) || chr(10) END END ||
  CASE WHEN quality IS NULL THEN '' ELSE 'Visual content: quality (' || quality || '.25)' END, chr(10) || chr(10) ORDER BY page_no) AS text
FROM g WHERE page_no <> 2 OR quality IS NOT NULL GROUP BY doc_id""")
def stitch_pages(spark, d):
    """Five documents make one rendered document; the second page has no text, labels come from the label table."""
    labels = table(spark, d, "labels").select("doc_id", F.array(F.struct(
        F.lit("quality").alias("label"), (F.col("quality") + 0.25).alias("confidence"))).alias("labels"))
    docs = table(spark, d, _DOCS).join(labels, "doc_id", "left").select(
        F.floor(F.col("doc_id") / 5).alias("doc_id"), (F.col("doc_id") % 5 + 1).alias("page_no"),
        F.when(F.col("doc_id") % 5 == 1, " ").otherwise(F.col("text")).alias("text"), "labels")
    return L.stitch_pages(docs, 2_000_000_000)


@query("top_labels", """
WITH c AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS confidence FROM embeddings),
k AS (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS place FROM c WHERE confidence >= 0.15::FLOAT)
SELECT vec_id, pos, place FROM k WHERE place <= 8""")
def top_labels(spark, d):
    """Vector components as label confidences."""
    long = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "confidence"))
    found = L.top_labels(long.filter(F.col("confidence") >= F.lit(0.15).cast("float")), ["vec_id"], "pos", 0.0)
    return found.select("vec_id", "pos", "place")


@query("dedupe_filenames", """
SELECT doc_id AS file_id, replace(lang || ':' || source, ':', '-') || CASE WHEN n = 1 THEN '' ELSE ' (' || n || ')' END || '.pdf' AS stored
FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars, doc_id) AS n FROM documents)""")
def dedupe_filenames(spark, d):
    files = table(spark, d, _DOCS).select(F.col("doc_id").alias("file_id"),
                                          F.concat("lang", F.lit(":"), "source").alias("name"), F.col("n_chars").alias("ts"))
    return A.dedupe_filenames(files)


# --- chunks ------------------------------------------------------------------------------------------

_BLOCKS = f"list_filter(regexp_split_to_array({Q.trim(Q.normalized('text'))}, '\\n{{2,}}'), lambda b: {Q.trim('b')} <> '')"
_LINES = f"list_filter(list_transform(string_split(block, chr(10)), lambda l: {Q.trim('l')}), lambda l: l <> '')"


_UNITS = f"""
b AS (SELECT doc_id, {_BLOCKS} AS blocks FROM documents),
e AS (SELECT doc_id, {Q.unnest_at('blocks', 'section_id', 'block')} FROM b),
s AS (SELECT doc_id, section_id, {Q.sentences('block')} AS sents, {_LINES} AS lines, {Q.trim('block')} AS block FROM e),
u AS (SELECT doc_id, section_id, CASE WHEN len(sents) >= 2 THEN 'sentence' ELSE 'line' END AS kind,
  CASE WHEN len(sents) >= 2 THEN sents WHEN len(lines) >= 2 THEN lines ELSE [block] END AS l FROM s),
x AS (SELECT doc_id, section_id, kind, {Q.unnest_at('l', 'i', 'text')} FROM u),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_id, i) - 1 AS unit_no, section_id, kind, text FROM x)"""


@query("chunk_units", f"WITH {_UNITS} SELECT * FROM units")
def chunk_units(spark, d):
    """Units of all documents; the limit is beyond every text, so none is split."""
    return C.chunk_units(documents(spark, d), 2_000_000_000)


def chunks_sql(limit: int, overlap: int) -> str:
    """Select of all document chunks. Long units of these documents hold no sentence end or newline,
    so the only cuts are before a word or at the limit."""
    back = limit // 5
    tail = f"substr(text, start + {limit - back + 2}, {back})"
    cut = f"""CASE WHEN length(text) - start <= {limit} THEN length(text)
      WHEN regexp_matches(substr(text, start + {limit}, 2), '^\\p{{Ll}}\\p{{Ll}}$') THEN
        CASE WHEN regexp_matches({tail}, '\\s') THEN start + {limit - back} + length(regexp_extract({tail}, '(?s)^(.*\\s)', 1)) + 1
        ELSE start + {limit - back} END
      ELSE start + {limit} END"""
    return f"""WITH RECURSIVE {_UNITS},
starts AS (SELECT doc_id, unit_no, section_id, text, 0 AS k, CAST(0 AS BIGINT) AS start FROM units),
cuts AS (SELECT *, {cut} AS stop FROM starts
  UNION ALL SELECT *, {cut} AS stop FROM (SELECT doc_id, unit_no, section_id, text, k + 1 AS k, stop AS start FROM cuts WHERE stop < length(text))),
parts AS (SELECT doc_id, unit_no, section_id, k, {Q.trim('substr(text, start + 1, stop - start)')} AS text FROM cuts),
n AS (SELECT doc_id, section_id, text, length(text) AS len, row_number() OVER w - 1 AS i,
  CASE WHEN lag(section_id) OVER w = section_id THEN 1 ELSE 2 END AS gap,
  lag(section_id) OVER w = section_id AS same, unit_no FROM parts WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY unit_no, k)),
kinds AS (SELECT n.*, units.kind, sum(gap + len) OVER (PARTITION BY doc_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY doc_id) AS final
  FROM n JOIN units USING (doc_id, unit_no)),
fits AS (SELECT a.doc_id, a.i, a.final, max(b.i) AS last FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND b.i >= a.i
  AND (b.i = a.i OR b.upto - a.upto + a.len <= {limit}) GROUP BY ALL),
backs AS (SELECT a.doc_id, a.i, min(b.i) AS back FROM kinds a JOIN kinds b ON a.doc_id = b.doc_id AND b.i <= a.i
  AND (b.i = a.i OR a.upto - b.upto + b.len <= {overlap}) GROUP BY ALL),
ranges AS (SELECT doc_id, 0 AS chunk_no, i AS first, last, final FROM fits WHERE i = 0
  UNION ALL SELECT r.doc_id, r.chunk_no + 1, f.i, f.last, f.final FROM ranges r JOIN backs b ON b.doc_id = r.doc_id AND b.i = r.last
  JOIN fits f ON f.doc_id = r.doc_id AND f.i = CASE WHEN r.last = r.first THEN r.last + 1 WHEN b.back <= r.first THEN r.last ELSE b.back END
  WHERE r.last < r.final),
chunks AS (SELECT r.doc_id, r.chunk_no, string_agg(CASE WHEN k.i = r.first THEN '' WHEN NOT k.same THEN chr(10) || chr(10)
  WHEN k.kind = 'sentence' THEN ' ' ELSE chr(10) END || k.text, '' ORDER BY k.i) AS text
  FROM ranges r JOIN kinds k ON k.doc_id = r.doc_id AND k.i BETWEEN r.first AND r.last GROUP BY ALL)
SELECT doc_id, chunk_no, source, lang, c.text, length(c.text) AS n_chars FROM chunks c JOIN documents d USING (doc_id)"""


@query("chunk", chunks_sql(720, 120))
def chunk(spark, d):
    return C.chunk(documents(spark, d).select("doc_id", "source", "lang", "text"))


@query("propagate_headers", """
WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '|', '/'), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
r AS (SELECT *, '| ' || line || ' | y |' AS two, '| ' || line || ' | y | z |' AS three, chr(10) || '| --- | --- |' || chr(10) AS rule2, chr(10) || '| --- | --- | --- |' || chr(10) AS rule3 FROM l)
SELECT doc_id, i AS chunk_no, CASE i % 8 WHEN 0 THEN '| h' || i || ' | b |' || rule2 || two WHEN 1 THEN '| h' || (i - 1) || ' | b |' || rule2 || two
  WHEN 5 THEN '| h' || (i - 5) || ' | b |' || rule2 || two WHEN 4 THEN '| h' || i || ' | b | c |' || rule3 || three
  WHEN 6 THEN '| h' || (i - 2) || ' | b | c |' || rule3 || three WHEN 2 THEN CASE WHEN i > 8 THEN '| h' || (i - 6) || ' | b | c |' || rule3 ELSE '' END || three ELSE line END AS text FROM r""")
def propagate_headers(spark, d):
    """Every line of a document as a chunk: tables of two and three columns, rows cut from them, rows below a stray rule, prose."""
    def as_chunk(line, i):
        head = F.concat(F.lit("| h"), i.cast("string"))
        two, three = (F.concat(F.lit("| "), line, F.lit(end)) for end in (" | y |", " | y | z |"))
        return (F.when(i % 8 == 0, F.concat(head, F.lit(" | b |\n| --- | --- |\n"), two))
                .when(i % 8 == 4, F.concat(head, F.lit(" | b | c |\n| --- | --- | --- |\n"), three))
                .when((i % 8).isin(1, 5), two).when((i % 8).isin(2, 6), F.concat(F.lit("| --- | --- |\n"), three)).otherwise(line))

    lines = F.split(F.replace("text", F.lit("|"), F.lit("/")), "\n")
    cut = computed(documents(spark, d).select("doc_id", F.transform(lines, as_chunk).alias("_chunks")), _chunks=F.col("_chunks"))
    return cut.select("doc_id", F.posexplode(C.propagate_headers(F.col("_chunks"))).alias("chunk_no", "text"))


@query("content_ladder_tool", """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'provider' ELSE 'snippet' END AS rung,
  CASE page_id % 3 WHEN 0 THEN 'content of ' || url ELSE 'snippet ' || page_id END AS text FROM pages WHERE page_id % 3 < 2""")
def content_ladder_tool(spark, d):
    """Results of a tool call: every third has content of its own, every third a snippet, the others neither."""
    n = F.col("page_id") % 3
    results = pages(spark, d).select("page_id", "url", F.when(n == 0, F.concat(F.lit(" content of "), "url", F.lit("\n"))).alias("retrieved"),
                                     F.when(n < 2, F.concat(F.lit("snippet "), "page_id")).otherwise("").alias("snippet"))
    return C.content_ladder(results, results.select("url", "snippet"), tool_mode=True).select("page_id", "rung", "text")


@query("page_chunks", f"""
SELECT doc_id, count(*) = 1 AND bool_and(length({Q.trim('text')}) <= 2700) AS whole FROM documents GROUP BY doc_id""")
def page_chunks(spark, d):
    """Which documents stay whole for a context of 1,000 tokens."""
    docs = documents(spark, d).select("doc_id", "source", "text")
    return C.page_chunks(docs, 1000).groupBy("doc_id").agg(F.bool_and("whole").alias("whole"))


@query("content_ladder", f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'provider' WHEN 1 THEN 'scraped' ELSE 'snippet' END AS rung,
  CASE page_id % 3 WHEN 0 THEN 'content of ' || url WHEN 1 THEN {Q.page_text('html')} ELSE 'snippet ' || page_id END AS text FROM pages""")
def content_ladder(spark, d):
    base = pages(spark, d)
    n = F.col("page_id") % 3
    results = base.select("page_id", "url", F.when(n == 0, F.concat(F.lit(" content of "), "url", F.lit("\n")))
                          .when(n == 1, "  ").alias("retrieved"), F.concat(F.lit("snippet "), "page_id").alias("snippet"))
    scraped = base.filter(n == 1).select("url", X.html_to_text("html", None).alias("text"))
    return C.content_ladder(results, scraped).select("page_id", "rung", "text")


@query("attach_labels", """
SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE text END || CASE WHEN l.doc_id IS NULL THEN '' ELSE
  CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE chr(10) || chr(10) END || 'Page content: quality (' || quality || '.50), toxic (' || toxic || '.25)' END AS text
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def attach_labels(spark, d):
    pair = lambda name, add: F.struct(F.lit(name).alias("label"), (F.col(name) + add).alias("confidence"))
    labels = table(spark, d, "labels").select("doc_id", F.array(pair("quality", 0.5), pair("toxic", 0.25)).alias("labels"))
    docs = table(spark, d, _DOCS).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")).alias("text"))
    return C.attach_labels(docs.join(labels, "doc_id", "left"))


@query("tokens", f"SELECT doc_id, len({Q.tokens('text')}) AS n_tokens, array_to_string({Q.tokens('text')}, ' ') AS tokens FROM documents")
def tokens(spark, d):
    return documents(spark, d).select("doc_id", F.size(X.tokens("text")).alias("n_tokens"),
                                      F.array_join(X.tokens("text"), " ").alias("tokens"))


@query("term_freq", f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({Q.tokens('text')}) AS term FROM documents)
WHERE length(term) > 2 GROUP BY ALL""")
def term_freq(spark, d):
    return S.term_freq(documents(spark, d), "doc_id", "text")
