"""Correction of mis-heard terms: spans, distinct retrieval, gate, choice, rewrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.similarity import ratio
from earshot.functions.text import let, tokens
from earshot.operators import gate as G
from earshot.operators import retrieval as V
from earshot.operators import spans as P
from earshot.schemas import CORRECTION
from earshot.session import salted_join, via_table, written_lookup

GATED, UNGATED = "gated_phrase_correction", "ungated_phrase_correction"


def proposals(
    forms: DataFrame,
    index: DataFrame,
    gate: G.Coefficients | PipelineModel | None = G.DEFAULT,
    threshold: float = V.THRESHOLD,
    gate_threshold: float = G.THRESHOLD,
) -> DataFrame:
    """The accepted correction of each distinct form, whatever its number of occurrences.

    ``forms`` has a column ``form``; the result is one struct ``proposal`` per accepted form.
    """
    # Ranking costs much per form and its rows are small: adaptive execution would hand all forms to a few tasks.
    parts = 2 * forms.sparkSession.sparkContext.defaultParallelism
    distinct = forms.select(F.col("form").alias("span")).distinct().repartition(parts, "span")
    best = V.best_candidates(distinct, index, threshold)
    record = G.features(F.col("span"), F.col("semantic_score"), F.col("fuzzy_score"), F.col("phonetic_score"))
    judged = best.withColumn("features", record)
    if gate is None:
        accepted = judged.withColumn("gate_probability", F.lit(None).cast("double"))
    else:
        accepted = G.gate_filter(judged, gate, gate_threshold)
    proposal = F.struct(
        F.col("term").alias("candidate"), "final_score", "gate_probability",
        "semantic_score", "fuzzy_score", "phonetic_score", "features",
    )
    return accepted.select(F.col("span").alias("form"), proposal.alias("proposal"))


def _hits_of(df: DataFrame, index: DataFrame, key: str, text: str, gate: G.Coefficients | PipelineModel | None,
             threshold: float, gate_threshold: float = G.THRESHOLD) -> DataFrame:
    """The accepted spans of each text that has any: (key, _hits).

    Spans within reach of the vocabulary are few and written once; they are looked up once per distinct
    form. The accepted forms then meet those spans: broadcast when a count permits, else salted, as a
    frequent form is a hot key. What is grouped per text are its accepted spans only.
    """
    reached = via_table(P.candidate_spans(df, key, text, reach=V.reach(index, threshold)), "reached")
    accepted, small = written_lookup(proposals(reached, index, gate, threshold, gate_threshold))
    if small:
        hits = reached.join(F.broadcast(accepted), "form")
    else:
        hits = salted_join(reached, accepted, "form", [key, "start", "end"])
    return hits.groupBy(key).agg(F.collect_list(F.struct("start", "end", "proposal")).alias("_hits"))


def corrections_of(
    df: DataFrame,
    index: DataFrame,
    key: str,
    text: str,
    gate: G.Coefficients | PipelineModel | None = G.DEFAULT,
    threshold: float = V.THRESHOLD,
) -> DataFrame:
    """The chosen corrections of each text that has any: (key, chosen)."""
    hits = _hits_of(df, index, key, text, gate, threshold)
    return hits.select(key, P.select_spans(F.col("_hits")).alias("_chosen"))


def _records(words: Column, chosen: Column, kind: str) -> Column:
    """The audit records of the chosen spans, scores rounded to four digits."""

    def spelled(p: Column) -> Column:
        def record(c: Column) -> Column:
            original = F.array_join(F.slice(p["words"], c["start"] + 1, c["end"] - c["start"]), " ")
            found = c["proposal"]
            return F.struct(
                F.lit(kind).alias("type"),
                original.alias("original"),
                P.clean_span(original).alias("clean_span"),
                found["candidate"].alias("corrected"),
                F.round(found["final_score"], 4).alias("retrieval_score"),
                F.round(found["gate_probability"], 4).alias("gate_probability"),
                F.round(found["semantic_score"], 4).alias("semantic_score"),
                F.round(found["fuzzy_score"], 4).alias("fuzzy_score"),
                F.round(found["phonetic_score"], 4).alias("phonetic_score"),
                found["features"].alias("features"),
            )

        return F.transform(p["chosen"], record)

    return let(F.struct(words.alias("words"), chosen.alias("chosen")), spelled)


def correct(
    df: DataFrame,
    index: DataFrame,
    key: str,
    text: str,
    gate: G.Coefficients | PipelineModel | None = G.DEFAULT,
    threshold: float = V.THRESHOLD,
    enabled: bool = True,
) -> DataFrame:
    """Add ``corrected_text``, ``corrections`` and ``digits_lost`` to every row (``key`` unique).

    ``gate=None`` applies every accepted retrieval; ``enabled=False`` is the identity.
    """
    empty = F.array().cast(T.ArrayType(CORRECTION))
    if not enabled:
        return df.withColumns(
            {"corrected_text": F.col(text), "corrections": empty, "digits_lost": F.lit(False)}
        )
    kind = UNGATED if gate is None else GATED
    # The words are a column of their own, so that a text is parted once.
    joined = df.join(corrections_of(df, index, key, text, gate, threshold), key, "left").withColumn("_words", tokens(F.col(text)))
    words = F.col("_words")
    edits = F.transform(
        "_chosen",
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["proposal"]["candidate"].alias("candidate")),
    )
    records = F.when(F.col("_chosen").isNotNull(), _records(words, F.col("_chosen"), kind)).otherwise(empty)
    done = joined.withColumns(
        {"corrected_text": P.apply_corrections(words, edits), "corrections": records.cast(T.ArrayType(CORRECTION))}
    )
    lost = F.exists("corrections", lambda c: c["original"].rlike(r"(?U)\d") & ~c["corrected"].rlike(r"(?U)\d"))
    return done.withColumn("digits_lost", lost).drop("_chosen", "_words")


def correct_both(df: DataFrame, index: DataFrame, key: str, text: str,
                 gate: G.Coefficients | PipelineModel = G.DEFAULT, threshold: float = V.THRESHOLD) -> DataFrame:
    """Add ``ungated_text, ungated_corrections, gated_text, gated_corrections`` from one search.

    The two forms differ only in which accepted spans may be chosen, so forms are ranked and judged once,
    with a gate that keeps all, and spans are chosen twice from the same hits.
    """
    hits = _hits_of(df, index, key, text, gate, threshold, gate_threshold=0.0)
    passed = F.filter("_hits", lambda h: h["proposal"]["gate_probability"] >= G.THRESHOLD)
    chosen = hits.select(key, P.select_spans(F.col("_hits")).alias("_all"),
                         F.when(F.size(passed) > 0, P.select_spans(passed)).alias("_passed"))
    words, empty = F.col("_words"), F.array().cast(T.ArrayType(CORRECTION))
    joined = df.join(chosen, key, "left").withColumn("_words", tokens(F.col(text)))

    def written(spans: str, kind: str, judged: bool) -> tuple[Column, Column]:
        edits = F.transform(spans, lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["proposal"]["candidate"].alias("candidate")))
        records = F.when(F.col(spans).isNotNull(), _records(words, F.col(spans), kind)).otherwise(empty)
        if not judged:  # an ungated correction carries no probability
            records = F.transform(records, lambda r: r.withField("gate_probability", F.lit(None).cast("double")))
        return P.apply_corrections(words, edits), records.cast(T.ArrayType(CORRECTION))

    ungated, gated = written("_all", UNGATED, False), written("_passed", GATED, True)
    return joined.withColumns({
        "ungated_text": ungated[0], "ungated_corrections": ungated[1],
        "gated_text": gated[0], "gated_corrections": gated[1],
    }).drop("_all", "_passed", "_words")


# The short list of the word-by-word corrector and its acceptance.
WORD_LIST = [
    "metformin", "lisinopril", "hydroxyzine", "atorvastatin", "insulin", "amlodipine", "omeprazole",
]
WORD_RATIO = 0.85
WORD_REASON = "closest vocabulary match"


def word_matches(df: DataFrame, key: str, text: str, terms: Sequence[str] = WORD_LIST) -> DataFrame:
    """Words whose closest term reaches the ratio: (key, start, end, word, candidate, score).

    Row by row, without a shuffle: a word meets only the terms whose length
    permits the ratio, a banded edit distance (never above the insertions and
    deletions the ratio counts) drops most of those, and the few left are
    scored. Ties go to the earlier term of the list.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("order"), F.lit(t).alias("term"), F.lit(len(t)).alias("length"))
            for i, t in enumerate(terms)
        ]
    )
    words = df.select(key, F.posexplode_outer(tokens(F.col(text))).alias("start", "word")).where(
        F.col("word").isNotNull()
    )
    size = F.length("word")
    shortest, longest = min(map(len, terms)), max(map(len, terms))
    slack = 2 / WORD_RATIO - 1
    # 2 x min / (a + b) >= ratio bounds each length by the other.
    feasible = words.where((size >= int(shortest / slack)) & (size <= int(longest * slack) + 1))
    near = feasible.select(key, "start", "word", F.inline(pairs)).where(
        (2 * F.least(size, "length") >= WORD_RATIO * (size + F.col("length")))
        & (F.levenshtein("word", "term") <= (1 - WORD_RATIO) * (size + F.col("length")) + 1e-9)
    )
    scored = near.withColumn("score", ratio(F.col("word"), F.col("term")))
    best = scored.groupBy(key, "start", "word").agg(
        F.max(F.struct("score", (-F.col("order")).alias("order"), "term")).alias("best")
    )
    found = best.where((F.col("best.score") >= WORD_RATIO) & (F.lower("word") != F.lower("best.term")))
    return found.select(
        key, "start", (F.col("start") + 1).alias("end"), "word",
        F.col("best.term").alias("candidate"), F.col("best.score").alias("score"),
    )


def word_fuzzy_correct(df: DataFrame, key: str, text: str, terms: Sequence[str] = WORD_LIST) -> DataFrame:
    """Add ``corrected_text`` and ``word_corrections`` by the word-by-word corrector."""
    chosen = word_matches(df, key, text, terms).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "candidate", "word"))).alias("chosen")
    )
    record = F.transform(
        "chosen",
        lambda c: F.struct(
            F.lit("medical_term").alias("type"),
            c["word"].alias("original"),
            c["candidate"].alias("corrected"),
            F.lit(WORD_REASON).alias("reason"),
        ),
    )
    empty = F.array().cast("array<struct<type:string,original:string,corrected:string,reason:string>>")
    return df.join(chosen, key, "left").withColumns(
        {
            "corrected_text": P.apply_corrections(tokens(F.col(text)), F.col("chosen")),
            "word_corrections": F.coalesce(record, empty),
        }
    ).drop("chosen")
