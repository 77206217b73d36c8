"""Corpus, result pages, encyclopedia answers, catalogs, templates, settings and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions import constants as K
from ..functions.budgets import clamp, context_tokens, tokens_of_words
from ..functions.text import html_to_text, non_blank, snippet_text, trim_all
from ..functions.urls import query_items, unwrap_redirect
from ..scale import OrderedGroups
from ..session import checkpointed, table

MAX_LINKS = 20


def read_corpus(spark: SparkSession, directory: str, page_chars: int | None = None) -> DataFrame:
    """Documents and crawled pages as one corpus: (origin, doc_id, source, url, lang, text)."""
    none = F.lit(None).cast("string")
    documents = table(spark, directory, "documents").select(
        F.lit("document").alias("origin"), "doc_id", F.concat(F.lit("PDF: "), F.col("source")).alias("source"),
        none.alias("url"), "lang", "text")
    pages = table(spark, directory, "pages").select(
        F.lit("page").alias("origin"), F.col("page_id").alias("doc_id"),
        F.concat(F.lit("Web: "), F.col("url")).alias("source"), "url",
        F.regexp_extract("html", "<html lang=\"([a-z]+)\"", 1).alias("lang"),
        html_to_text("html", page_chars).alias("text"))
    return documents.unionByName(pages)


SEARCH_SCHEMA = T.StructType([T.StructField("pages", T.ArrayType(T.StructType([
    T.StructField(name, T.StringType()) for name in ("key", "title", "excerpt", "description")])))])
DETAIL_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("title", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("content_urls", T.StructType([T.StructField("desktop", T.StructType([
        T.StructField("page", T.StringType())]))])),
    T.StructField("html_url", T.StringType())])


def path_escape(column: Column) -> Column:
    """Percent-encode what must not appear in a path segment."""
    encoded = F.replace(F.url_encode(column), F.lit("+"), F.lit("%20"))
    for code, char in (("%27", "'"), ("%28", "("), ("%29", ")"), ("%21", "!"), ("%7E", "~"), ("%3A", ":"), ("%40", "@"),
                       ("%26", "&"), ("%3D", "="), ("%24", "$"), ("%2C", ","), ("%2B", "+"), ("%3B", ";")):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return encoded


def ingest_encyclopedia(searches: DataFrame, details: DataFrame, limit: int) -> DataFrame:
    """Search answers joined with page details: (query_id, pos, title, url, snippet, retrieved).

    searches (query_id, lang, body); details (lang, body), both JSON texts. A page without details keeps
    its built URL; the first detail per key counts.
    """
    found = (searches.select("query_id", "lang", F.from_json("body", SEARCH_SCHEMA).alias("b"))
             .select("query_id", "lang", F.posexplode(F.slice("b.pages", 1, max(limit, 0))).alias("pos", "p"))
             .select("query_id", "lang", "pos", "p.*"))
    read = (details.select("lang", F.from_json("body", DETAIL_SCHEMA).alias("d")).select("lang", "d.*")
            .filter(non_blank("key").isNotNull())
            .select("lang", "key", F.struct("content_urls", "html_url", "source").alias("d")))
    read = read.groupBy("lang", "key").agg(F.min("d").alias("d"))
    host = F.when(F.col("lang") == "fr", "fr.wikipedia.org").otherwise("en.wikipedia.org")
    built = F.concat(F.lit("https://"), host, F.lit("/wiki/"), path_escape(F.col("key")))
    url = F.coalesce(trim_all("d.content_urls.desktop.page"), trim_all("d.html_url"), built)
    snippet = F.nullif(snippet_text(F.coalesce("excerpt", "description", F.lit(""))), F.lit(""))
    return (found.join(read, ["lang", "key"], "left")
            .select("query_id", "pos", F.coalesce(non_blank("title"), F.replace("key", F.lit("_"), F.lit(" "))).alias("title"),
                    url.alias("url"), F.coalesce(snippet, F.lit("Wikipedia page")).alias("snippet"),
                    non_blank("d.source").alias("retrieved"))
            .filter(F.col("url") != ""))


def extract_links(pages: DataFrame, cap: int = MAX_LINKS) -> DataFrame:
    """Result items of a search result page: (page_id, pos, url, title, snippet); positions count from 1."""
    parts = F.split("html", "class=\"result__a\"")
    items = (pages.select("page_id", F.posexplode(F.slice(parts, 2, cap)).alias("pos", "part"))
             .withColumn("pos", F.col("pos") + 1))
    href = F.regexp_extract("part", "(?s)^.*?href=\"([^\"]*)\"", 1)
    has_href = F.col("part").rlike("href=\"[^\"]*\"")
    has_title = F.col("part").rlike("(?s)^[^>]*>.*?</a>")
    title = F.nullif(snippet_text(F.regexp_extract("part", "(?s)^[^>]*>(.*?)</a>", 1)), F.lit(""))

    def inner(tag: str) -> Column:
        return F.nullif(F.regexp_extract(
            "part", f"(?is)<{tag}[^>]*class=\"[^\"]*\\bresult__snippet\\b[^\"]*\"[^>]*>(.*?)</{tag}>", 1), F.lit(""))

    snippet = F.nullif(snippet_text(F.coalesce(inner("a"), inner("div"), F.lit(""))), F.lit(""))
    return items.filter(has_href & has_title).select(
        "page_id", "pos", unwrap_redirect(href).alias("url"),
        F.coalesce(title, F.concat(F.lit("Result "), F.col("pos"))).alias("title"),
        F.coalesce(snippet, F.lit("No description available")).alias("snippet"))


def extract_anchors(pages: DataFrame) -> DataFrame:
    """Every link of a page with its text: (page_id, pos, href, title); positions count from 0."""
    found = F.regexp_extract_all("html", F.lit("(?is)(<a\\s[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), 1)
    return (pages.select("page_id", F.posexplode(found).alias("pos", "a"))
            .select("page_id", "pos", F.regexp_extract("a", "(?i)href=\"([^\"]*)\"", 1).alias("href"),
                    snippet_text(F.regexp_extract("a", "(?s)>(.*)</[aA]>$", 1)).alias("title")))


def extract_urls(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct http(s) URLs of free text: (id, url)."""
    found = F.regexp_extract_all(text_col, F.lit("(?i)(https?://[^\\s<>\"]+)"), 1)
    clean = F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, "[.,;:)\\]}]+$", "")))
    return df.select(id_col, F.explode(clean).alias("url"))


def extract_citation_links(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cited links in order of first occurrence: (id, pos, url); Markdown links first, plain URLs only without any."""
    marked = F.regexp_extract_all(text_col, F.lit("\\[[^\\]]+\\]\\((https?://[^\\s)]+)\\)"), 1)
    plain = F.regexp_extract_all(text_col, F.lit("(?i)(https?://[^\\s<>\"]+)"), 1)
    chosen = F.when(F.size(marked) > 0, marked).otherwise(plain)
    clean = F.array_distinct(F.transform(chosen, lambda u: F.regexp_replace(u, "^[.,;:)\\]}]+|[.,;:)\\]}]+$", "")))
    return df.select(id_col, F.posexplode(clean).alias("pos", "url"))


def write_files(files: DataFrame, path: str) -> None:
    """Small text files below ``path``: input (name, value). Each is a folder of its name with one part, so writers on
    all executors can make them; a line end is added to every value. Names must be unique."""
    files.select("name", "value").write.partitionBy("name").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """All text files below ``path``, whole: (file, modified, value)."""
    read = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_modification_time").alias("modified"), "value")


def file_name(file: Column | str = "file") -> Column:
    """Last part of a path; for a part of a file that write_files made, that file's name."""
    return F.regexp_extract(file, "([^/=]+)(?:/part-[^/]*)?$", 1)


def read_catalogs(files: DataFrame) -> DataFrame:
    """String catalogs ``*.{lang}.json`` merged: (lang, key, value); the later file in the order of paths wins."""
    entries = (files.select("file", F.regexp_extract(file_name(), "\\.(en|fr|es)\\.json$", 1).alias("lang"),
                            F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))
               .filter(F.col("lang") != ""))
    return entries.groupBy("lang", "key").agg(F.max_by("text", "file").alias("value"))


def read_templates(files: DataFrame) -> DataFrame:
    """Prompt templates ``prompt.{mode}.{feature}[.variant].{lang}.txt``: (mode, feature, variant, lang, text)."""
    files = files.withColumn("name", file_name())
    pattern = "^prompt\\.([^.]+)\\.([^.]+)(?:\\.([^.]+))?\\.([a-z]{2})\\.txt$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    return files.filter(F.col("name").rlike(pattern)).select(
        part(1).alias("mode"), part(2).alias("feature"), F.nullif(part(3), F.lit("")).alias("variant"),
        part(4).alias("lang"), F.regexp_replace("value", "\\n\\z", "").alias("text"))


def resolve_template(wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """Template of each request: its variant, else the base; input (query_id, mode, feature, variant, lang).

    Templates are stored first, so Spark knows their bytes and broadcasts them only below its own limit.
    """
    keys = ["mode", "feature", "lang"]
    known = checkpointed(templates.select(*keys, "variant", "text"))
    exact = known.filter(F.col("variant").isNotNull()).withColumnRenamed("text", "_exact")
    base = known.filter(F.col("variant").isNull()).drop("variant").withColumnRenamed("text", "_base")
    return (wanted.join(exact, [*keys, "variant"], "left").join(base, keys, "left")
            .withColumn("text", F.coalesce("_exact", "_base")).drop("_exact", "_base"))


def write_chunks(chunks: DataFrame, path: str, partition: str = "lang") -> None:
    """Persist a chunk table for reuse, partitioned for pruning; rewriting replaces only its partitions.

    Rows are spread by document inside each partition value, so one large language is not one task.
    """
    (chunks.repartition(partition, "doc_id").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path))


def replace_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write rows as the partition of a batch; a batch that is run again replaces what it wrote before."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def append_messages(messages: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent sink of a message stream (conv_id, sent and others): the batch's messages, and beside them what it
    says of their threads. Both replace what the same batch wrote before."""
    stored = checkpointed(messages)
    replace_batch(stored, f"{path}/messages", batch_id)
    said = stored.groupBy("conv_id").agg(F.max("sent").alias("updated_at"), F.count(F.lit(1)).alias("n_messages"))
    replace_batch(said, f"{path}/threads", batch_id)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """All messages that append_messages has written below ``path``."""
    return spark.read.parquet(f"{path}/messages").drop("batch_id")


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """(conv_id, updated_at, n_messages): the threads' last times and sizes, merged from the partitions of all batches
    without reading a message."""
    return spark.read.parquet(f"{path}/threads").groupBy("conv_id").agg(
        F.max("updated_at").alias("updated_at"), F.sum("n_messages").alias("n_messages"))


SETTINGS_SCHEMA = T.StructType([
    T.StructField("maxDuckDuckGoResults", T.IntegerType()), T.StructField("maxWikipediaResults", T.IntegerType()),
    T.StructField("maxResponseTokens", T.IntegerType()), T.StructField("temperature", T.DoubleType()),
    T.StructField("maxContextTokens", T.IntegerType()), T.StructField("maxSearchResults", T.IntegerType()),
    T.StructField("maxContextWords", T.IntegerType()), T.StructField("maxScrapingCharacters", T.IntegerType())])


def migrate_settings(stored: DataFrame) -> DataFrame:
    """Stored settings with defaults, legacy keys translated and values clamped to their ranges:
    input (id, json)."""
    d = K.SETTINGS_DEFAULTS
    read = stored.select("id", F.from_json("json", SETTINGS_SCHEMA).alias("s")).select("id", "s.*")
    low, high = K.RESULTS_RANGE
    response = clamp(F.coalesce("maxResponseTokens", F.lit(d["max_response_tokens"])), *K.RESPONSE_TOKENS_RANGE)
    words = F.greatest(F.lit(1), tokens_of_words(F.col("maxContextWords")))
    chars = F.greatest(F.lit(1), F.floor(F.col("maxScrapingCharacters") / K.CHARS_PER_TOKEN).cast("int"))
    context = F.coalesce(F.col("maxContextTokens"), F.when(F.col("maxContextWords").isNotNull(), words),
                         F.when(F.col("maxScrapingCharacters").isNotNull(), chars), F.lit(d["max_context_tokens"]))
    return read.select(
        "id",
        clamp(F.coalesce("maxDuckDuckGoResults", "maxSearchResults", F.lit(d["max_web_results"])), low, high).alias("web_results"),
        clamp(F.coalesce("maxWikipediaResults", F.lit(d["max_encyclopedia_results"])), low, high).alias("encyclopedia_results"),
        response.alias("response_tokens"),
        F.least(F.greatest(F.coalesce("temperature", F.lit(d["temperature"])), F.lit(K.TEMPERATURE_RANGE[0])),
                F.lit(K.TEMPERATURE_RANGE[1])).alias("temperature"),
        context_tokens(context, response).alias("context_tokens"))


def explode_query_params(urls: DataFrame) -> DataFrame:
    """Query items of every URL: (url, pos, name, value), values trimmed, blank ones dropped."""
    return (urls.select("url", F.posexplode(query_items("url")).alias("pos", "q"))
            .select("url", "pos", F.col("q.name").alias("name"), non_blank("q.value").alias("value"))
            .filter(F.col("value").isNotNull()))


def route_shared_links(links: DataFrame, scheme: str) -> DataFrame:
    """What an incoming link asks for: (link, action, query, urls, pdfs, images).

    ``scheme`` is the application's own scheme; order of precedence: share, search, url, plain link.
    """
    items = query_items("link")
    values = lambda name: F.filter(F.transform(F.filter("_items", lambda i: i["name"] == name),
                                               lambda i: trim_all(F.coalesce(i["value"], F.lit("")))), lambda v: v != "")
    df = links.withColumn("_items", items).withColumn("_own", F.lower("link").startswith(f"{scheme.lower()}:"))
    place = F.lower(F.regexp_extract("link", "^[^:]*://([^?#]*)", 1))
    host, path = F.substring_index(place, "/", 1), place
    df = (df.withColumn("_urls", values("url")).withColumn("_pdfs", values("sharedPDF"))
          .withColumn("_images", values("sharedImage")))
    asked = F.get(F.filter("_items", lambda i: i["name"].isin("q", "query")), F.lit(0))["value"]
    only_url = F.get(F.filter("_items", lambda i: i["name"] == "url"), F.lit(0))["value"]
    in_own = F.col("_own") & F.col("link").contains("?")
    sharing = in_own & ((host == "share") | path.contains("share")) & (
        (F.size("_urls") > 0) | (F.size("_pdfs") > 0) | (F.size("_images") > 0))
    blank_search = in_own & ((host == "search") | path.contains("search")) & asked.isNull()
    searching = in_own & non_blank(asked).isNotNull()
    opening = in_own & non_blank(only_url).isNotNull()
    action = (F.when(sharing, "share").when(blank_search | searching, "search").when(opening, "url")
              .when(F.col("link").rlike("^https?://"), "link").otherwise("none"))
    none = F.array().cast("array<string>")
    return (df.withColumn("action", action)
            .select("link", "action",
                    F.when(F.col("action") == "search", F.coalesce(asked, F.lit(""))).alias("query"),
                    F.when(F.col("action") == "share", F.col("_urls")).when(F.col("action") == "url", F.array(only_url))
                    .when(F.col("action") == "link", F.array("link")).otherwise(none).alias("urls"),
                    F.when(F.col("action") == "share", F.col("_pdfs")).otherwise(none).alias("pdfs"),
                    F.when(F.col("action") == "share", F.col("_images")).otherwise(none).alias("images")))


def dedupe_filenames(files: DataFrame, extension: str = "pdf") -> DataFrame:
    """Unique storage names in arrival order: (file_id, stored); input (file_id, name, ts).

    Later arrivals of a name get " (2)", " (3)" and so on before the extension; numbers that would give a name which
    some file already came with are left out.
    """
    clean = F.replace(F.replace(trim_all("name"), F.lit("/"), F.lit("-")), F.lit(":"), F.lit("-"))
    clean = F.coalesce(F.nullif(clean, F.lit("")), F.lit(f"dropped.{extension}"))
    full = F.when(F.lower(clean).endswith(f".{extension}"), clean).otherwise(F.concat(clean, F.lit(f".{extension}")))
    named = files.withColumn("_full", full).withColumn("_base", F.regexp_replace("_full", "\\.[^.]*$", "")) \
        .withColumn("_ext", F.regexp_extract("_full", "\\.([^.]*)$", 1))
    key = ["_base", "_ext"]
    counted = OrderedGroups(named, key, ["ts", "file_id"]).running("_n", F.lit(1)).plain().select(
        "file_id", *key, F.col("_n").cast("long").alias("_n"))
    own_number = "^(.*) \\(([1-9][0-9]{0,17})\\)$"
    taken = named.select(F.regexp_extract("_base", own_number, 1).alias("_root"), "_ext",
                         F.nullif(F.regexp_extract("_base", own_number, 2), F.lit("")).cast("long").alias("_number"))
    taken = taken.filter(F.col("_number") > 1).withColumnRenamed("_root", "_base").distinct()
    taken = OrderedGroups(taken, key, ["_number"]).running("_i", F.lit(1)).plain()
    # The n-th arrival is past the i-th taken number where that number less i is under n.
    both = counted.withColumn("_taken", F.lit(0)).unionByName(taken.select(
        F.lit(None).cast(counted.schema["file_id"].dataType).alias("file_id"), *key, (F.col("_number") - F.col("_i")).alias("_n"),
        F.lit(1).alias("_taken")))
    placed = OrderedGroups(both, key, ["_n", "_taken"]).running("_skipped", F.col("_taken")).plain().filter("_taken = 0")
    number = F.col("_n") + F.col("_skipped")
    suffix = F.when(F.col("_n") == 1, "").otherwise(F.concat(F.lit(" ("), number.cast("string"), F.lit(")")))
    return placed.select("file_id", F.concat("_base", suffix, F.lit("."), F.col("_ext")).alias("stored"))
