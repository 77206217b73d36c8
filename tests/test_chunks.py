"""Chunking: goldens and properties."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from passagemill.operators import chunking as C

SCHEMA = "doc_id int, source string, url string, page int, text string"


def chunks(spark, *texts, tokens=240, overlap=40):
    docs = spark.createDataFrame([(i, "s", None, None, t) for i, t in enumerate(texts)], SCHEMA)
    rows = C.chunk(docs, tokens, overlap).orderBy("doc_id", "chunk_no").collect()
    return [[r.text for r in rows if r.doc_id == i] for i in range(len(texts))]


def test_empty_and_bounds(spark):
    out = chunks(spark, "", "  \n ", "word " * 1000, "x" * 3000, tokens=100, overlap=0)
    assert out[0] == out[1] == []
    assert len(out[2]) > 1 and all(len(t) <= 300 for t in out[2] + out[3])
    assert "".join(out[3]) == "x" * 3000


def test_numbers_stay_whole(spark):
    out = chunks(spark, "x" * 200 + " 8,432,567 " + "y" * 200, tokens=70, overlap=0)
    assert any("8,432,567" in t for t in out[0])


def test_overlap_starts_on_a_sentence(spark):
    text = "First sentence that is rather long indeed, one may say. " * 2
    second = "Second sentence that is rather long indeed, one may say so."
    out = chunks(spark, text + second + " Third sentence ends the text after all of that here.", tokens=18, overlap=20)[0]
    assert len(out) > 1
    for before, after in zip(out, out[1:]):
        assert after.split(". ")[0].rstrip(".") in before


def test_headers_follow_their_rows(spark):
    rows = "\n".join(f"| row {i} | {'v' * 20} |" for i in range(30))
    out = chunks(spark, f"| A | B |\n| --- | --- |\n{rows}", tokens=70, overlap=0)[0]
    assert len(out) > 1 and all(t.startswith("| A | B |\n| --- | --- |\n") for t in out)


def headers(spark, *texts):
    df = spark.createDataFrame([(list(texts),)], "c array<string>")
    return df.select(C.propagate_headers(F.col("c"))).first()[0]


def test_header_choice(spark):
    first = "| a | b |\n| --- | --- |\n| 1 | 2 |"
    second = "| x | y | z |\n|---|---|---|\n| 3 | 4 | 5 |"
    assert headers(spark, first, second, "| --- | --- |\n| 6 | 7 | 8 |", "plain") == [
        first, second, "| x | y | z |\n|---|---|---|\n| 6 | 7 | 8 |", "plain"]
    assert headers(spark, "| --- |\nalone") == ["| --- |\nalone"]
    other = "| c | d |\n| --- | --- |\n| 5 | 6 |"
    assert headers(spark, first, other, "| 7 | 8 |") == [first, other, "| c | d |\n| --- | --- |\n| 7 | 8 |"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=40), st.integers(0, 60), st.randoms())
def test_packing_properties(lengths, overlap, rng):
    gaps = [rng.choice([1, 2]) for _ in lengths]
    ranges = C.pack_lengths(lengths, gaps, 100, overlap)
    covered = set()
    for first, size in ranges:
        total = sum(lengths[first:first + size]) + sum(gaps[first + 1:first + size])
        assert total <= 100 or size == 1
        covered |= set(range(first, first + size))
    assert covered == set(range(len(lengths)))
    assert [f for f, _ in ranges] == sorted({f for f, _ in ranges})


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab 1,.\nX", min_size=1, max_size=400))
def test_long_text_properties(text):
    pieces = C.split_long_text(text, 50)
    assert all(0 < len(p) <= 50 for p in pieces)
    assert "".join("".join(pieces).split()) == "".join(text.split())


def test_page_policy(spark):
    pages = spark.createDataFrame([(1, "p", "short page"), (2, "p", "One sentence here. " * 400)], "doc_id int, source string, text string")
    counts = {r.doc_id: r["count"] for r in C.page_chunks(pages, 1000).groupBy("doc_id").count().collect()}
    assert counts[1] == 1 and counts[2] > 1
