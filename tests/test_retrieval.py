"""Scoring and packing against brute force, with and without broadcast; budgets and replies."""

import re

from passagemill.operators import scoring as S, selection as Z
from passagemill.plans import jobs


def tables(spark):
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud", "zinc"]
    chunks = [(d, c, f"s{d % 3}", f"https://x.org/{d % 4}", None,
               " ".join(words[(d * 3 + c * 5 + i * (c + 1)) % 8] for i in range((d * 7 + c * 3) % 60 + 1)))
              for d in range(40) for c in range(2)]
    queries = [(0, "alpha river"), (1, "zinc"), (2, "to be"), (3, "unknown words only"), (4, "beta gamma delta stone cloud")]
    return (spark.createDataFrame(queries, "query_id int, query string"),
            spark.createDataFrame(chunks, "doc_id int, chunk_no int, source string, url string, page int, text string"), queries, chunks)


def ranked(query, chunks):
    asked = {t for t in re.findall(r"\w+", query) if len(t) > 2}
    scored = [(round(len(asked & set(c[5].split())) + (0.2 if len(c[5]) > 300 else 0), 9) if asked else 0.0, len(c[5]), c[0], c[1],
               len(c[2]) + 9 + len(c[5])) for c in chunks]
    return sorted(scored, key=lambda s: (-s[0], -s[1], s[2], s[3]))


def test_top_chunks(spark):
    q, c, queries, chunks = tables(spark)
    for k in (1, 7, 60):
        for limit in (1_000_000, 0):
            found = {}
            for r in S.top_chunks(q, c, k, max_broadcast=limit).collect():
                found.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.chunk_no, r.score))
            for ident, text in queries:
                expect = [(i + 1, s[2], s[3], s[0]) for i, s in enumerate(ranked(text, chunks)[:k])]
                assert sorted(found[ident]) == expect


def greedy(query, chunks, budget):
    room, out = budget, []
    for s in ranked(query, chunks):
        need = s[4] + (7 if out else 0)
        if need <= room:
            room -= need
            out.append((s[2], s[3]))
    return out


def test_select_context(spark):
    q, c, queries, chunks = tables(spark)
    for budget, first in ((30, 100), (700, 100), (700, 3), (5000, 2)):
        rows = Z.select_context(q, c, budget, first_round=first).collect()
        for ident, text in queries:
            found = [(r.doc_id, r.chunk_no) for r in sorted(rows, key=lambda r: r.position) if r.query_id == ident]
            assert found == (greedy(text, chunks, budget) or [ranked(text, chunks)[0][2:4]])


def test_fallback_and_context_text(spark):
    q, c, queries, chunks = tables(spark)
    chosen = Z.select_context(q, c, 5)
    assert chosen.filter("fallback").count() == len(queries)
    assert all(len(r.context) <= 200 for r in Z.context_text(chosen, c, 5).collect())


def test_boosts(spark):
    def order(query, rows):
        c = spark.createDataFrame([(i, 0, "s", None, page, text) for i, (text, page) in enumerate(rows)],
                                  "doc_id int, chunk_no int, source string, url string, page int, text string")
        q = spark.createDataFrame([(1, query)], "query_id int, query string")
        return [r.doc_id for r in S.top_chunks(q, c, len(rows)).orderBy("rank").collect()]

    assert order("explain equation 5", [("a much longer passage about nothing", 1), ("relationship of eq 5 x = y", 1)])[0] == 1
    assert order("describe figure 5 on page 8", [("fig 4 shown", 8), ("fig 5 shown", 7), ("fig 5 shown", 8)])[0] == 2
    assert order("what happened in 1990", [("the year what 1991", 1), ("in 1990 it", 1)])[0] == 1


def test_percentages_sum_to_100(spark):
    shares = spark.createDataFrame([(1, f"u{i}", 33.3) for i in range(3)] + [(2, f"u{i}", 1.0) for i in range(6)] + [(3, "u", 0.0)],
                                   "query_id int, url string, pct double")
    rows = Z.rebalance_percent(shares, shares).collect()
    sums = {}
    for r in rows:
        sums[r.query_id] = sums.get(r.query_id, 0) + r.pct
    assert sums == {1: 100, 2: 100}
    assert {r.url: r.pct for r in rows if r.query_id == 1} == {"u0": 34, "u1": 33, "u2": 33}


def test_reply_contains_the_target(spark):
    text = "filler words here. " * 200 + "The equation 4 links x and y. " + "more filler. " * 200
    c = spark.createDataFrame([(1, 0, "doc", None, 3, text)], "doc_id int, chunk_no int, source string, url string, page int, text string")
    q = spark.createDataFrame([(1, "equation 4"), (2, "  ")], "query_id int, query string")
    replies = {r.query_id: r.reply for r in Z.search_corpus(q, c, 200).collect()}
    assert len(replies[1]) <= 600 and "equation 4" in replies[1] and replies[1].startswith("--- Result 1: doc (page 3) ---")
    assert replies[2] == "Error: empty query"


def test_citations(spark):
    top = spark.createDataFrame([(1, 1, "s", "https://a.org", 3), (1, 2, "PDF: x", None, None)],
                                "query_id int, rank int, source string, url string, page int")
    assert Z.citation_block(top).first().citations == "1. [https://a.org](https://a.org)\n   PDF Page: 3\n\n2. PDF: x"


def test_budgets(spark):
    df = spark.createDataFrame([(i, v, 3400, 0) for i, v in enumerate((0, 500, 1500, 3500, 10000))],
                               "request_id int, response int, context int, reserve int")
    rows = {r.request_id: r for r in jobs.plan_budgets(df).collect()}
    assert (rows[1].context_chars_fast, rows[1].context_chars_chat, rows[1].tool_reply, rows[1].grounding_chars) == (6661, 8198, 1000, 8448)
    for r in rows.values():
        assert 2 * r.tool_reply + r.tool_response + 780 <= 4096 and 1 <= r.output_tokens <= 3616


def test_pairs_are_not_shuffled(spark, capsys):
    q, c, _, _ = tables(spark)
    passages = S.passage_profile(c.repartition(*S.CHUNK_ID))
    S.match_pairs(S.query_profile(q), passages).explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan
    # The only shuffle is the one that puts the keys of a passage together.
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_COL" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
