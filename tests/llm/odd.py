"""Odd documents that every operator must cope with."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 60_000


def odd_documents() -> list[tuple]:
    """Nulls in each column, empty and blank texts, a very long one, ties, and repeated rows."""
    texts = ["", "   \n\t ", None, "one", "one two three", LONG, "Ein ſtraßeÆ ÄÖÜ   nbsp em", "😀 emoji \U0001f600", "dup dup dup dup " * 30, "same text here again " * 20, "same text here again " * 20, "\x00 nul and \x1f unit"]
    texts[7] = "smile \U0001f600 emoji"
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id", None, None, None), (None, None, None, None, None), (100, "tie a", None, "src1", 5), (101, "tie b", None, None, 5)]
    return rows


def empty(spark, kind: str = DOCS):
    return spark.createDataFrame([], kind)


def documents(spark, extra: bool = False):
    """extra: with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_documents(), DOCS)
    if extra:
        for name in ("blob", "fp", "_src", "_size", "host", "k1", "c0", "_id", "id", "clean", "cuts", "key", "day", "_copies", "_epoch", "start", "end"):
            docs = docs.withColumn(name, F.lit(f"x-{name}"))
    return docs
