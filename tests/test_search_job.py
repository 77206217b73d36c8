"""The whole search job: every conversation has its own results, context, shares and citations."""

import re
from collections import defaultdict

from passagemill.plans import table_queries as Q
from passagemill.scale import numbered
from passagemill.session import table

DIRECTORY = "/root/testdata/sf0.01"


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 1000, 7).repartition(5)
    assert [r.n for r in numbered(df, "id", "n").sort("id").collect()] == list(range(143))
    assert numbered(df.filter("id < 0"), "id", "n").collect() == []


def test_every_conversation_is_answered(spark):
    urls = {r.page_id: r.url for r in table(spark, DIRECTORY, "pages").select("page_id", "url").collect()}
    asked = {r.conv_id for r in table(spark, DIRECTORY, "conversations").filter("role = 'user'").collect()}
    found = defaultdict(list)
    for r in Q.search_and_summarise(spark, DIRECTORY).collect():
        found[r.query_id].append(r)
    assert set(found) == asked and len(asked) == 100
    assert {r.url for rows in found.values() for r in rows} == set(urls.values())
    assert {r.rung for rows in found.values() for r in rows} >= {"provider", "scraped"}
    lists = set()
    for rows in found.values():
        rows.sort(key=lambda r: r.place)
        assert [r.place for r in rows] == list(range(1, 9))
        own = {r.url for r in rows}
        lists.add(frozenset(own))
        assert sum(r.pct for r in rows) in (0, 100)
        assert [r.pct for r in rows] == sorted((r.pct for r in rows), reverse=True)
        assert all(r.context is None and r.citations is None for r in rows[1:])
        sources = re.findall(r"^Source: Page (\d+)$", rows[0].context, re.M)
        assert sources and {urls[int(s)] for s in sources} <= own
        # All of the score lies in packed passages, so a result with a share is a source of the context.
        assert {r.url for r in rows if r.pct} <= {urls[int(s)] for s in sources}
        cited = re.findall(r"^(\d)\. \[(.*)\]\(\2\)$", rows[0].citations, re.M)
        assert [n for n, _ in cited] == ["1", "2", "3"] and {u for _, u in cited} <= own
    assert len(lists) > 30


def test_questions_without_pages_keep_a_row(spark, tmp_path):
    table(spark, "/root/testdata/sf0.001", "conversations").write.parquet(str(tmp_path / "conversations.parquet"))
    table(spark, "/root/testdata/sf0.001", "pages").filter("page_id < 0").write.parquet(str(tmp_path / "pages.parquet"))
    rows = Q.search_and_summarise(spark, str(tmp_path)).collect()
    assert len(rows) == 20 and {(r.url, r.context, r.pct) for r in rows} == {(None, None, 0)}
