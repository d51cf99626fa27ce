"""Terms of large lexicons in texts: every term that a text holds, by one pass over the text.

A few dozen terms can stand in a plan as one test each (``functions.entities``); a hundred thousand cannot. Here
the terms become an automaton with failure links, built once per Python worker, that finds all of them in one
pass whatever their number. Terms travel as a broadcast of bounded bytes: a lexicon above ``SLICE_BYTES`` is dealt into
slices by hash, each is a pass of its own, and what the passes find is put together per text. So neither a task nor the
driver ever holds more than one slice.

A term is found wherever it stands, also inside words, in lower case, as the short lexicons do. Null texts hold nothing;
null and empty terms are left out, repeated ones are one. Found terms come in their own order, without repeats.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.session import via_table

SLICE_BYTES = 4 << 20

_automata: dict[str, ahocorasick.Automaton] = {}


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for term in terms:
        made.add_word(term, term)
    made.make_automaton()
    return made


def _finder(spark, terms: list[str]):
    """A column function: the terms a text holds. The automaton is built once per worker and kept for its query."""
    sent, key = spark.sparkContext.broadcast(terms), uuid.uuid4().hex

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        if key not in _automata:
            _automata.clear()
            _automata[key] = automaton(sent.value)
        made = _automata[key]
        return texts.map(lambda t: sorted({term for _, term in made.iter(t)}), na_action="ignore")

    return found


def lexicon_slices(lexicon: DataFrame, term: str = "term", limit: int = SLICE_BYTES) -> tuple[DataFrame, int]:
    """The written terms with their slice, and the number of slices: as many as keep each below the limit."""
    terms = lexicon.select(F.lower(term).alias("term")).where(F.col("term") != "").distinct()
    table = via_table(terms, "lexicon")
    size = table.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    slices = max(1, -(-2 * size // limit)) if size > limit else 1
    return table.withColumn("slice", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int")), slices


def lexicon_terms(texts: DataFrame, key: str, text: str, lexicon: DataFrame, term: str = "term", limit: int = SLICE_BYTES) -> DataFrame:
    """``key, terms`` of every row (``key`` unique): the lexicon's terms that the text holds."""
    spark = texts.sparkSession
    table, slices = lexicon_slices(lexicon, term, limit)

    def of(n: int) -> Column:
        terms = [r["term"] for r in table.where(F.col("slice") == n).select("term").collect()]  # one slice: bounded bytes
        if not terms:
            return F.array().cast("array<string>")
        return F.coalesce(_finder(spark, terms)(F.lower(text)), F.array().cast("array<string>"))

    if slices == 1:
        return texts.select(key, of(0).alias("terms"))
    passes = [via_table(texts.select(key, of(n).alias("found")), "lexicon-pass") for n in range(slices)]
    whole = passes[0]
    for one in passes[1:]:
        whole = whole.union(one)
    return whole.groupBy(key).agg(F.sort_array(F.flatten(F.collect_list("found"))).alias("terms"))
