"""Rows that every operator has to cope with."""

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def row(doc_id, text, lang="en", source="a"):
    return doc_id, text, lang, source, None if text is None else len(text)


LONG = " ".join(f"word{i % 997}" for i in range(30_000))

ODD = [
    (None, None, None, None), (None, "no id here at all", "en", "a"), (1, None, "en", None), (2, "", "de", "b"),
    (3, " \n\t ", "fr", "b"), (4, "x", "en", "a"), (5, "same text again and again", "en", "a"),
    (6, "same text again and again", "en", "a"), (7, "row that is there twice", "en", "a"),
    (7, "row that is there twice", "en", "a"), (8, LONG, "en", "c"), (9, "é ü ß ñ €\U0001f600 <|endoftext|> ▁x", "de", "c"),
    (10, "a" * 5000, "en", "c"), (-11, "a negative id", "en", "d"), (12, "12345 !!! ...", "en", "d"),
]
