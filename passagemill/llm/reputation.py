"""URL filters: written rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, carried, read, stored

# Fixed values of the rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two labels under which names are registered; others have one label.
DOUBLE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.nz", "co.jp", "com.br", "co.in", "co.za")
# A host is blocked if its rate of bad pages is above MAX_BAD with this posterior probability.
MAX_BAD = 0.25
CERTAINTY = 0.95
# Points of the numerical integral of a posterior density, and its half width in standard deviations.
POINTS = 400
WIDTH = 8.0


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without a :// or for null."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(found, upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict); null if none does. A rule fits its host and all
    subdomains if the path starts with the rule's. Equally long: the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    choice = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        hit = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        choice = F.when(fits, hit).otherwise(choice)
    return choice


def name_of(host: Column) -> Column:
    """Host name without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def domain_of(name: Column) -> Column:
    """Registered domain: the public suffix and one label more."""
    labels = F.split(name, r"\.")
    double = F.concat_ws(".", F.slice(labels, -2, 2)).isin(*DOUBLE_SUFFIXES) & (F.size(labels) > 2)
    last = F.when(double, 3).otherwise(2)
    return F.when(F.size(labels) <= last, name).otherwise(F.concat_ws(".", F.slice(labels, -last, last)))


def suffix_of(name: Column) -> Column:
    """Public suffix: the last label, or the last two where names are registered under two."""
    labels = F.split(name, r"\.")
    double = F.concat_ws(".", F.slice(labels, -2, 2)).isin(*DOUBLE_SUFFIXES) & (F.size(labels) > 2)
    return F.when(double, F.concat_ws(".", F.slice(labels, -2, 2))).otherwise(F.element_at(labels, -1))


def _strength(groups: DataFrame) -> DataFrame:
    """Prior strength (alpha + beta) of the rates of groups under one parent, by the method of moments: the spread
    between the groups' rates beyond what binomial chance explains. (parent mean excluded; one row.)

    Few or equal groups give no spread to see; the strength is then held at 1,000 outcomes, and at 2 from below.
    """
    totals = groups.filter("n > 0").agg(F.sum("n").alias("all"), F.sum("bad").alias("bads"), F.count(F.lit(1)).alias("k"),
                        F.sum(F.col("n") * F.col("n")).alias("squares"),
                        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("parts"))
    mean = F.try_divide("bads", "all")
    between = F.try_divide(F.col("parts") - F.col("all") * mean * mean, F.col("k") - 1)
    within = F.try_divide(F.col("bads") - F.col("parts"), F.col("all") - F.col("k"))
    size = F.try_divide(F.col("all") - F.try_divide("squares", "all"), F.col("k") - 1)
    share = F.try_divide(between - within, between + (size - 1) * within)
    seen = (F.col("k") > 1) & (F.col("all") > F.col("k")) & (share > 0)
    return totals.select(F.when(seen, F.least(F.greatest(F.try_divide(F.lit(1.0), share) - 1, F.lit(2.0)), F.lit(1000.0)))
                         .otherwise(F.lit(1000.0)).alias("strength"), F.coalesce(mean, F.lit(0.0)).alias("mean"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series behind a shift by 6; correct to about 10 digits for x > 0."""
    shift = sum((F.ln(x + i) for i in range(1, 6)), F.ln(x))
    y = x + 6
    series = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y)
    return series - shift


def above(alpha: Column, beta: Column, limit: float) -> Column:
    """Probability that a beta(alpha, beta) rate is above limit, by the midpoint rule where the density lies."""
    mean = alpha / (alpha + beta)
    deviation = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    low = F.greatest(F.lit(0.0), mean - WIDTH * deviation)
    high = F.least(F.lit(1.0), mean + WIDTH * deviation)
    step = (high - low) / POINTS
    constant = _log_gamma(alpha + beta) - _log_gamma(alpha) - _log_gamma(beta)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(
        (low + (i + 0.5) * step).alias("x")))
    weights = F.transform(pieces, lambda p: F.struct(p.x.alias("x"), F.exp(
        constant + (alpha - 1) * F.ln(p.x) + (beta - 1) * F.ln(1 - p.x)).alias("w")))
    start = F.lit(0.0)
    total = F.aggregate(weights, start, lambda s, p: s + p.w)
    over = F.aggregate(weights, start, lambda s, p: s + F.when(p.x > limit, p.w).otherwise(0.0))
    return over / total


def host_reputations(outcomes: DataFrame, max_bad: float = MAX_BAD, certainty: float = CERTAINTY,
                     others: DataFrame | None = None) -> DataFrame:
    """(host, n, bad, rate, above, blocked) from labelled outcomes (host, bad 0/1), one row per page, and for ``others``
    (host), which need no outcomes.

    Three levels of beta-binomial shrinkage: a suffix's rate is drawn to the overall rate, a registered domain's to
    its suffix's, a host's to its domain's, each with the strength that the spread on that level shows. A host is
    blocked if its posterior rate of bad pages is above ``max_bad`` with probability ``certainty``. A host without
    outcomes has its domain's rate as posterior mean, one of an unseen domain its suffix's, one of an unseen suffix
    the overall rate. A prior's counts include those of the host itself. Outcomes are added up by host before anything
    moves. Null hosts have no row. No outcomes: the rate is 0, so all hosts are allowed. No hosts: no rows.
    """
    rows = outcomes.select("host", F.lit(1).alias("one"), "bad")
    if others is not None:
        rows = rows.unionByName(others.select("host", F.lit(0).alias("one"), F.lit(0).alias("bad")))
    hosts = stored(
        rows.filter("host IS NOT NULL").groupBy("host").agg(F.sum("one").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
        .withColumn("name", name_of(F.col("host")))
        .withColumn("domain", domain_of(F.col("name"))).withColumn("suffix", suffix_of(F.col("name"))))
    counts = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("suffix", "domain").agg(*counts)
    suffixes = domains.groupBy("suffix").agg(*counts)

    def shrunk(level: DataFrame, parent: DataFrame | None, on: str | None, name: str) -> DataFrame:
        # One row: the strength on this level.
        strength = F.broadcast(_strength(level))
        prior = level.join(parent, on) if parent is not None else level
        mean = F.col("prior") if parent is not None else F.col("mean")
        return prior.join(strength).withColumn("alpha", F.col("bad") + F.col("strength") * mean).withColumn(
            "beta", F.col("n") - F.col("bad") + F.col("strength") * (1 - mean))

    posterior = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    by_suffix = shrunk(suffixes, None, None, "suffix").select("suffix", posterior.alias("prior"))
    by_domain = shrunk(domains, by_suffix, "suffix", "domain").select("domain", posterior.alias("prior"))
    by_host = shrunk(hosts, by_domain, "domain", "host").select("host", "n", "bad", "alpha", "beta")
    judged = by_host.withColumn("rate", posterior).withColumn(
        "above", F.when(F.col("alpha") <= 0, 0.0).when(F.col("beta") <= 0, 1.0)
        .otherwise(above(F.col("alpha"), F.col("beta"), max_bad)))
    return judged.select("host", "n", "bad", "rate", "above", (F.col("above") >= certainty).alias("blocked"))


def judge(pages: DataFrame, url: Column, reputations: DataFrame, rules=RULES) -> DataFrame:
    """Every row of ``pages`` in the column ``_row``, with ``host``, ``path``, ``rule`` and ``verdict``.

    Null url or no ``://``: host and path empty, no rule; the empty host is judged as any other. A host without
    reputation is allowed. Very long urls: whole. Repeated rows: judged each. Other columns ride along inside ``_row``,
    whatever their names. Empty input: no rows. Reputations are joined by host; Catalyst broadcasts them if their stored
    size allows, else a skewed host is split by AQE.
    """
    rows = carried(pages, host=host_of(url), path=path_of(url))
    ruled = rows.withColumn("hit", rule_of(F.col("host"), F.col("path")))
    bad = reputations.filter("blocked").select(F.col("host").alias("_bad"))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("_bad").isNull(), "allow").otherwise("block"))
    return ruled.join(bad, F.col("host") == F.col("_bad"), "left").select(
        ROW, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))


def judged_pages(spark, directory: str) -> DataFrame:
    """op4: the verdict on every page. A page's outcome is the label that carries its id: bad if of low quality or
    toxic."""
    pages = read(spark, directory, "pages", "page_id", "url")
    labels = read(spark, directory, "labels", "doc_id", "quality", "toxic").filter("doc_id IS NOT NULL")
    bad = F.greatest(F.coalesce(1 - F.col("quality"), F.lit(0)), F.coalesce(F.col("toxic"), F.lit(0)))
    by_page = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max(bad).alias("bad"))
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    outcomes = hosts.join(by_page, F.col("page_id") == F.col("_id")).select("host", "bad")
    reputations = stored(host_reputations(outcomes, others=hosts))
    return judge(pages, F.col("url"), reputations).select(f"{ROW}.page_id", "host", "path", "rule", "verdict")


_COUNTS = "sum(n) AS n, sum(bad) AS bad"


def _strength_sql(level: str) -> str:
    return f"""
  SELECT CASE WHEN k > 1 AND total > k AND share > 0 THEN least(greatest(1 / share - 1, 2), 1000) ELSE 1000 END
         AS strength, coalesce(mean, 0) AS mean
  FROM (SELECT *, (between_ - within_) / nullif(between_ + (size - 1) * within_, 0) AS share
        FROM (SELECT *, (parts - total * mean * mean) / nullif(k - 1, 0) AS between_,
                     (bads - parts) / nullif(total - k, 0) AS within_,
                     (total - squares / total) / nullif(k - 1, 0) AS size
              FROM (SELECT sum(n) AS total, sum(bad) AS bads, count(*) AS k, sum(n * n) AS squares,
                           sum(bad * bad / n) AS parts, sum(bad) / sum(n) AS mean FROM {level} WHERE n > 0)))"""


_NAME = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_TWO = "(" + ", ".join(f"'{s}'" for s in DOUBLE_SUFFIXES) + ")"
_RULE_SQL = "\n".join(
    f"              WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)))
_VERDICT_SQL = " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)

JUDGED_PAGES_SQL = f"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
{_RULE_SQL} END AS rule FROM parsed),
labelled AS (
  SELECT doc_id, max(greatest(coalesce(1 - quality, 0), coalesce(toxic, 0))) AS bad FROM labels GROUP BY doc_id),
hosts AS (
  SELECT host, CAST(count(doc_id) AS DOUBLE) AS n, CAST(coalesce(sum(l.bad), 0) AS DOUBLE) AS bad,
         string_split({_NAME}, '.') AS p
  FROM parsed LEFT JOIN labelled l ON page_id = doc_id GROUP BY host),
named AS (
  SELECT host, n, bad,
         CASE WHEN len(p) > 2 AND array_to_string(p[-2:], '.') IN {_TWO} THEN array_to_string(p[-3:], '.')
              ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN len(p) > 2 AND array_to_string(p[-2:], '.') IN {_TWO} THEN array_to_string(p[-2:], '.')
              ELSE p[-1] END AS suffix
  FROM hosts),
domains AS (SELECT suffix, domain, {_COUNTS} FROM named GROUP BY suffix, domain),
suffixes AS (SELECT suffix, {_COUNTS} FROM domains GROUP BY suffix),
s1 AS ({_strength_sql('suffixes')}), s2 AS ({_strength_sql('domains')}), s3 AS ({_strength_sql('named')}),
by_suffix AS (SELECT suffix, (bad + strength * mean) / (n + strength) AS prior FROM suffixes, s1),
by_domain AS (SELECT domain, (bad + strength * prior) / (n + strength) AS prior
              FROM domains JOIN by_suffix USING (suffix), s2),
by_host AS (SELECT host, bad + strength * prior AS a, n - bad + strength * (1 - prior) AS b
            FROM named JOIN by_domain USING (domain), s3),
spread AS (
  SELECT host, a, b, greatest(0, a / (a + b) - {WIDTH} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS low,
         least(1, a / (a + b) + {WIDTH} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) AS high
  FROM by_host WHERE a > 0 AND b > 0),
points AS (
  SELECT host, a, b, low + (i + 0.5) * (high - low) / {POINTS} AS x FROM spread, range({POINTS}) AS r(i)),
weights AS (SELECT host, x, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + (a - 1) * ln(x) + (b - 1) * ln(1 - x)) AS w
            FROM points),
blocked AS (
  SELECT host FROM weights GROUP BY host
  HAVING sum(CASE WHEN x > {MAX_BAD} THEN w ELSE 0 END) / sum(w) >= {CERTAINTY}
  UNION ALL SELECT host FROM by_host WHERE b <= 0)
SELECT page_id, host, path, rule,
       CASE rule {_VERDICT_SQL} ELSE CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END END
       AS verdict
FROM ruled
"""
