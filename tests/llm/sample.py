"""Small documents with everything that can go wrong."""

from pyspark.sql import types as T

# The columns of documents, and others whose names clash with what operators add.
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("size", T.StringType()), T.StructField("key", T.StringType()), T.StructField("block", T.StringType()),
    T.StructField("target", T.StringType()), T.StructField("score", T.StringType()), T.StructField("_row", T.StringType()),
    T.StructField("stratum", T.StringType()), T.StructField("part", T.StringType()), T.StructField("_key", T.StringType())])

BASE = ("The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing an old song "
        "about the long winter and the short summer that followed it last year. ")


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text)) + ("x",) * 9


def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and ids, passages shared at odd places."""
    long = " ".join(f"word{i} of{i % 7}" for i in range(40_000))
    return [
        row(5, BASE * 2), row(5, BASE * 2), row(7, BASE * 2), row(None, BASE * 2), row(None, BASE), row(1, None),
        row(2, ""), row(2, ""), row(3, " \n\t "), row(4, "one two"), row(8, "ONE two"), row(9, None, None, None),
        row(10, "é" * 60 + " tail"), row(11, "x" + "é" * 60 + " tail two"), row(12, long, "de", "b"),
        row(13, "intro words here. " + long[1000:9000] + " more", "de", "b"), row(14, "a" * 5000, "fr", None),
        row(15, "a" * 70 + "b", "fr", None), row(16, BASE + "Nothing else is the same in here.", None, "c"),
        row(17, "line one is here\n" * 30, "es", "c"), row(18, "#$% " * 80, "es", "c"),
        row(0, "zero " + BASE[20:100] + " end", "en", "c"),
    ]
