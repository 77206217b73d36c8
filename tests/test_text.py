"""Text preparation on small fixtures."""

from pyspark.sql import functions as F

from passagemill.functions import features as feat, markup, text as X, urls as U
from passagemill.operators import merging as M


def value(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", fn("t").alias("v")).orderBy("i").collect()]


def test_white_space(spark):
    assert value(spark, X.normalize_ws, "line A\n \n \n \nline B", "lots\t  of    \t spaces", "row 1\nrow 2\n\nrow 3") == [
        "line A\n\nline B", "lots of spaces", "row 1\nrow 2\n\nrow 3"]


def test_entities_are_decoded_once_in_pages_and_twice_in_snippets(spark):
    assert value(spark, X.decode_entities, "&amp;lt; &#65;&#x42; &mdash; &nope; &#38;amp;") == ["&lt; AB \u2014 &nope; &amp;"]
    assert value(spark, X.snippet_text, " <b>a</b>&amp;lt; &mdash; &#65; ") == ["a< - A"]


def test_html_table_to_markdown(spark):
    html = ("<p>x</p><table><tr><th>Year</th><th>Population</th></tr><tr><td>2010</td><td>1,234,567</td></tr>"
            "<tr><td></td></tr></table><p>no table</p>")
    text = value(spark, X.html_to_text, html)[0]
    assert "| Year | Population |\n| --- | --- |\n| 2010 | 1,234,567 |" in text
    assert value(spark, markup.tables_to_markdown, "<p>none</p>") == ["<p>none</p>"]


def test_aligned_tables(spark):
    quote = "Article    Qty    Price\nAmortisseurs    2    64,24\nPneus d'hiver    4    80"
    odd = "a    b    c\nd    e    f    g\nh    i"
    out = value(spark, markup.aligned_text_to_tables, quote, odd, "just prose here", "one    wide    line")
    assert out[0] == "| Article | Qty | Price |\n| --- | --- | --- |\n| Amortisseurs | 2 | 64,24 |\n| Pneus d'hiver | 4 | 80 |"
    assert out[1] == "| a | b | c |\n| --- | --- | --- |\n| d | e | f g |\nh    i"
    assert out[2:] == ["just prose here", "one wide line"]


def test_currency_and_formulas(spark):
    out = value(spark, X.escape_currency, "**$5** and 5$", "$a_3$ costs $7", "$$x$$", "\\$5")
    assert out == ["**\\$5** and 5\\$", "$a_3$ costs \\$7", "$$x$$", "\\$5"]
    assert value(spark, X.digit_powers, "10^6 10^{-3}") == ["\\mathrm{10}^\\mathrm{6} \\mathrm{10}^\\mathrm{-3}"]
    assert value(spark, X.split_commands, "x\\alpha2") == ["x \\alpha 2"]
    assert value(spark, X.headings_to_bold, "## Title ##\nbody") == ["**Title**\nbody"]


def test_segments(spark):
    out = value(spark, X.safe_segments, "One. Two!", "a $x. y$ b.", "\\[x. y\\] z", "$$a. b$$c", "v 1.5 is. ok\n", "costs $5. Yes")
    assert out == [[4, 9], [11], [8], [8], [9, 13], [9]]


def test_truncate_words(spark):
    assert value(spark, lambda c: X.truncate_words(c, 2), "  one, two; three", "one", "--") == ["one, two;", "one", "--"]


def test_wrappers(spark):
    assert value(spark, X.strip_document_wrappers, "\\documentclass{a}\n\\begin{document}\nbody\n\\end{document}") == ["body"]


def test_url_keys(spark):
    raw = ["HTTPS://User@Example.ORG:8080/A?x=1#top", "http://example.org", "example.org/x", "not a url "]
    assert value(spark, U.url_key, *raw) == ["https://example.org/A?x=1", "http://example.org/", "https://example.org/x", "not a url"]
    assert value(spark, U.url_key_strict, *raw)[0] == "https://User@example.org:8080/A?x=1#top"


def test_redirects(spark):
    out = value(spark, U.unwrap_redirect, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx%2By&rut=1", "https://b.org")
    assert out == ["https://a.org/x+y", "https://b.org"]


def test_intents(spark):
    asked = ["how many people live there", "combien d'habitants", "what is the definition of an apple"]
    assert value(spark, feat.has_numeric_intent, *asked) == [True, True, False]
    assert value(spark, feat.has_temporal_intent, "what's the latest news", "dernières tendances IA", "what is photosynthesis",
                 "know it") == [True, True, False, True]
    assert value(spark, lambda c: feat.has_temporal_intent(c, strict=True), "know it", "right now") == [False, True]


def test_numbers_and_references(spark):
    assert [sorted(v) for v in value(spark, feat.numeric_tokens, "5km and 1,234.5 or 12%", "none")] == [
        ["1,234.5", "12", "12%", "12345", "5", "5km"], []]
    assert [sorted(v) for v in value(spark, feat.equation_references, "eq. 5 and (7)", "equation no 12", "equation of 42")] == [
        ["5", "7"], ["12"], ["42"]]
    assert value(spark, feat.figure_references, "Fig. 3, figures 4")[0] == ["3", "4"]
    assert value(spark, feat.requested_pages, "figure 5 on page 8")[0] == ["8"]


def test_query_folding(spark):
    assert value(spark, M.fold_query, "  Été  À\tParis ") == ["ete a paris"]


def test_tables_of_one_file_are_spread(spark, tmp_path):
    from passagemill.plans.catalog import QUERIES

    spark.range(100).selectExpr("id AS c_custkey", "concat('n', id) AS c_name", "id % 5 AS c_nationkey").coalesce(1).write.parquet(
        str(tmp_path / "customer.parquet"))
    assert "REPARTITION" in QUERIES["html_tables"](spark, str(tmp_path))._jdf.queryExecution().toString()
