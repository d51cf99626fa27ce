"""Vocabulary index, retrieval of the nearest terms and their ranking.

The built-in encoder turns a text into the unit vector over its distinct
character trigrams. Such vectors are sparse, so an index is a table of
(term, gram) rows and a dot product is a join on the gram with a sum: work
grows with shared trigrams, not with spans x terms. Callers with vectors of
their own use ``semantic_topk`` on array columns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.similarity import masks_if_short, metaphone, ratio_by_masks, trigrams
from earshot.functions.text import let
from earshot.operators.setjoin import bag, similar_sets
from earshot.operators.spans import MOST_COUNTED, Reach
from earshot.session import via_table

# Weights of the three scores, the acceptance threshold, candidates re-ranked.
SEMANTIC_WEIGHT, FUZZY_WEIGHT, PHONETIC_WEIGHT = 0.5, 0.3, 0.2
THRESHOLD = 0.70
TOP_K = 3

# An index is broadcast only when a count shows it has no more rows than this.
BROADCAST_ROWS = 200_000
# Terms and queries per block of the dense product.
BLOCK_TERMS, BLOCK_QUERIES = 4096, 8192


def normalized(v: Column) -> Column:
    """A vector scaled to length 1; the zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(
        F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")),
        lambda z: F.when(z["n"] == 0, z["x"]).otherwise(z["x"] / z["n"]),
    )


def build_index(terms: DataFrame, term: str = "term") -> DataFrame:
    """The index as rows (term, grams, weight, gram): the unit trigram vector of each term."""
    encoded = terms.select(F.col(term).alias("term")).distinct().withColumn("_grams", trigrams(F.col("term")))
    return encoded.select(
        "term",
        F.size("_grams").alias("grams"),
        (1 / F.sqrt(F.size("_grams"))).alias("weight"),
        F.explode("_grams").alias("gram"),
    )


def _term_facts(index: DataFrame) -> DataFrame:
    """What the ranking needs of each term: its letters and its sound code as bit masks."""
    return index.select("term").distinct().select(
        "term",
        F.lower("term").alias("lowered"),
        masks_if_short(F.lower("term")).alias("masks"),
        metaphone(F.col("term")).alias("code"),
        masks_if_short(metaphone(F.col("term"))).alias("code_masks"),
    )


def _broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def retrieve(spans: DataFrame, index: DataFrame, k: int = TOP_K, min_semantic: float = 0.0) -> DataFrame:
    """The ``k`` nearest terms of each distinct span: (span, term, semantic_score).

    Terms without a common trigram have score 0 and are left out, so a span can have fewer than ``k``.

    ``min_semantic`` drops weaker pairs before the ranking. Weaker pairs rank
    below all others, so those that remain keep their places.
    """
    cut = spans.select("span").withColumn("_grams", trigrams(F.col("span")))
    rows = cut.select("span", F.size("_grams").alias("span_grams"), F.explode_outer("_grams").alias("gram"))
    near = rows.join(_broadcast_if_small(index), "gram")
    if min_semantic > 0:
        # Sizes alone bound the cosine of two sets from above.
        small, large = F.least("span_grams", "grams"), F.greatest("span_grams", "grams")
        near = near.where(small >= large * (min_semantic * min_semantic))
    pairs = near.groupBy("span", "term").agg(
        F.count(F.lit(1)).alias("shared"), F.first("span_grams").alias("span_grams"), F.first("grams").alias("grams")
    )
    semantic = F.col("shared") / F.sqrt(F.col("span_grams") * F.col("grams"))
    scored = pairs.select("span", "term", semantic.alias("semantic_score"))
    if min_semantic > 0:
        scored = scored.where(F.col("semantic_score") >= min_semantic)
    best = Window.partitionBy("span").orderBy(F.desc("semantic_score"), "term")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")


def filled(near: DataFrame, spans: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """The retrieved terms of every distinct span, filled up to ``k`` with terms of score 0 in the order of the terms.

    A span lacks at most ``k`` terms and has fewer than ``k``, so the first ``k`` terms of the index hold those it needs.
    """
    heads = F.array(*(F.lit(r["term"]) for r in index.select("term").distinct().orderBy("term").limit(k).collect())).cast("array<string>")
    found = near.groupBy("span").agg(F.collect_list(F.struct("term", "semantic_score")).alias("found"))
    rows = spans.select("span").distinct().join(found, "span", "left")
    have = F.coalesce("found", F.array().cast(found.schema["found"].dataType))
    rest = F.slice(F.filter(heads, lambda t: ~F.array_contains(have["term"], t)), F.lit(1), k - F.size(have))
    more = F.transform(rest, lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("semantic_score")))
    return rows.select("span", F.inline(F.concat(have, more)))


# Spans longer than this are held to the need of this length.
REACH_LENGTHS = 64
# Terms are told apart up to this number; more of them share groups by their hash.
REACH_GROUPS = 64


def reach(index: DataFrame, threshold: float = THRESHOLD) -> Reach | None:
    """The least a span must share with a vocabulary to reach the threshold for any of its terms.

    A span with s shared trigrams has at least s trigrams, so its semantic
    score for a term of n trigrams is at most sqrt(s / n); lengths bound the
    letter score, and the sound score is at most 1. Forms consist of letters
    and blanks, so at most 27^3 trigrams matter, whatever the vocabulary; each
    comes with the groups of terms that have it, and of a group's terms only the distinct sizes are
    looked at. None when the threshold asks for nothing.
    """
    if threshold <= FUZZY_WEIGHT + PHONETIC_WEIGHT:
        return None
    names = [r["term"] for r in index.select("term").distinct().limit(REACH_GROUPS + 1).collect()]
    if len(names) <= REACH_GROUPS:
        group = F.array_position(F.array(*(F.lit(t) for t in sorted(names))).cast("array<string>"), F.col("term")) - 1
    else:
        group = F.pmod(F.xxhash64("term"), F.lit(REACH_GROUPS))
    dealt = index.withColumn("group", group.cast("int"))
    useful = dealt.where(F.col("gram").rlike("^[a-z ]{3}$"))
    groups = {r["gram"]: tuple(sorted(r["groups"])) for r in useful.groupBy("gram").agg(F.collect_set("group").alias("groups")).collect()}
    shapes: dict[int, list[tuple[int, int]]] = {}
    for r in dealt.select("group", F.col("grams").alias("n"), F.length("term").alias("size")).distinct().collect():
        shapes.setdefault(r["group"], []).append((r["n"], r["size"]))
    if not shapes:
        return None

    def ceiling(shared: int, length: int, n: int, size: int) -> float:
        semantic = min(1.0, (shared / n) ** 0.5)
        letters = 2 * min(length, size) / (length + size)
        return SEMANTIC_WEIGHT * semantic + FUZZY_WEIGHT * letters + PHONETIC_WEIGHT

    def least(mine: list[tuple[int, int]]) -> list[int]:
        most = max((n for n, _ in mine), default=MOST_COUNTED)

        def need(length: int) -> int:
            return next(
                (s for s in range(most + 1) if any(ceiling(s, length, n, size) >= threshold - 1e-9 for n, size in mine)),
                most,
            )

        needed = [need(max(length, 1)) for length in range(REACH_LENGTHS)]
        # Blanks at the ends of a form may shorten it: a length answers for the lengths below it too.
        needed = [min(needed[max(0, i - 3) : i + 1]) for i in range(REACH_LENGTHS)]
        return [*needed, min(needed)]

    # A group without terms is never reached.
    all_groups = [least(shapes[g]) if g in shapes else [MOST_COUNTED] * (REACH_LENGTHS + 1) for g in range(max(shapes) + 1)]
    # Trigrams that span two words, where a term has several.
    across = 3 if any(" " in g.strip() or "  " in g for g in groups) else 0
    spread = [(1, 1, 1, 1)] * (max(shapes) + 1)
    for g, mine in shapes.items():
        grams, sizes = zip(*mine)
        spread[g] = (min(grams), max(grams), min(sizes), max(sizes))
    weights = (SEMANTIC_WEIGHT, FUZZY_WEIGHT, PHONETIC_WEIGHT)
    return Reach(groups, tuple(zip(*all_groups)), across, tuple(spread), weights, threshold)


def final_score(semantic: Column, fuzzy: Column, phonetic: Column) -> Column:
    return SEMANTIC_WEIGHT * semantic + FUZZY_WEIGHT * fuzzy + PHONETIC_WEIGHT * phonetic


def _scored(near: DataFrame, index: DataFrame, least: float = 0.0) -> DataFrame:
    """Add letter, sound and weighted score to retrieved pairs.

    Pairs that cannot reach ``least`` by meaning and letters, were they alike in sound, go before their sounds are spelled.
    """
    facts = near.join(_broadcast_if_small(_term_facts(index)), "term").withColumn(
        "fuzzy_score", ratio_by_masks(F.col("masks"), F.col("lowered"), F.lower("span")))
    if least > 0:
        facts = facts.where(final_score(F.col("semantic_score"), F.col("fuzzy_score"), F.lit(1.0)) >= least - 1e-9)
    coded = facts.withColumn("_code", metaphone(F.col("span")))
    phonetic = F.when((F.col("_code") == "") | (F.col("code") == ""), F.lit(0.0)).otherwise(
        ratio_by_masks(F.col("code_masks"), F.col("code"), F.col("_code"))
    )
    return (
        coded.withColumn("phonetic_score", phonetic)
        .withColumn(
            "final_score", final_score(F.col("semantic_score"), F.col("fuzzy_score"), F.col("phonetic_score"))
        )
        .select("span", "term", "semantic_score", "fuzzy_score", "phonetic_score", "final_score")
    )


def _by_score() -> list[Column]:
    """Scores that differ by less than their arithmetic's noise are ties, which go by term."""
    return [F.round("final_score", 9).desc(), F.round("semantic_score", 9).desc(), F.col("term")]


def _ranked(scored: DataFrame) -> DataFrame:
    order = Window.partitionBy("span").orderBy(*_by_score())
    return scored.withColumn("rank", F.row_number().over(order))


def rank_candidates(spans: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` nearest terms by meaning of each distinct span (all, if the index has fewer), ranked by the weighted score."""
    return _ranked(_scored(filled(retrieve(spans, index, k), spans, index, k), index))


def _listed(spans: DataFrame, index: DataFrame, depth: float | None) -> DataFrame:
    """``span, term`` of all pairs that stand in one of three lists, sorted by trigrams, letters and sounds, down to ``depth``.

    ``spans``: ``span``, and ``depth`` where it is not one number. Common letters bound the letter score
    from above, those of the sound codes the sound score, so the lists hold every pair whose scores lie that deep.
    """
    terms = via_table(index.select("term").distinct(), "terms")
    spans = spans.withColumnRenamed("depth", "at_least")

    def listed(tokens, measure: str) -> DataFrame:
        left = spans.select(F.col("span").alias("left_id"), *(["at_least"] if depth is None else []), tokens(F.col("span")).alias("tokens"))
        right = terms.select(F.col("term").alias("right_id"), tokens(F.col("term")).alias("tokens"))
        return similar_sets(left, right, depth, measure).select(F.col("left_id").alias("span"), F.col("right_id").alias("term"))

    sounds = listed(lambda c: bag(metaphone(c)), "dice")
    return listed(trigrams, "cosine").union(listed(lambda c: bag(F.lower(c)), "dice")).union(sounds).distinct()


def _measured(pairs: DataFrame, index: DataFrame, least: Column) -> DataFrame:
    """All scores of ``span, term`` pairs, of those that can reach ``least`` by their trigrams and common letters."""

    def share(a: Column, b: Column) -> Column:
        return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))

    grams = F.struct(trigrams(F.col("span")).alias("a"), trigrams(F.col("term")).alias("b"))
    semantic = let(grams, lambda g: F.size(F.array_intersect(g["a"], g["b"])) / F.sqrt(F.size(g["a"]) * F.size(g["b"])))
    told = pairs.withColumn("semantic_score", semantic)
    bags = F.struct(*(bag(x).alias(n) for n, x in (
        ("a", F.lower("span")), ("b", F.lower("term")), ("c", metaphone(F.col("span"))), ("d", metaphone(F.col("term"))))))
    ceiling = let(bags, lambda g: final_score(F.lit(0.0), share(g["a"], g["b"]), share(g["c"], g["d"])))
    can = told.where(SEMANTIC_WEIGHT * F.col("semantic_score") + ceiling >= least - 1e-9)
    return _scored(can.select("span", "term", "semantic_score"), index)


def rank_by_all(spans: DataFrame, index: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best terms of each distinct span by the weighted score, whatever their rank by meaning.

    A threshold search over three sorted lists. The ``k`` nearest by meaning are scored first; the last of them says
    how deep the lists of trigrams, letters and sounds must be read: the weights add up to 1, so a term below that
    depth in all three lists scores below it too. Nothing else is scored, and the result is that of scoring every pair.
    """
    first = via_table(rank_candidates(spans, index, k), "first-candidates")
    depth = first.groupBy("span").agg(F.min("final_score").alias("depth"), F.count("*").alias("n"))
    more = _listed(depth.where(F.col("n") == k).select("span", "depth"), index, None)
    new = more.join(first.select("span", "term"), ["span", "term"], "left_anti").join(depth.select("span", "depth"), "span")
    scored = _measured(new, index, F.col("depth")).unionByName(first.drop("rank"))
    return _ranked(scored).where(F.col("rank") <= k)


def best_by_all(spans: DataFrame, index: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best of all terms of each span when it reaches the threshold, however low, and differs from the span."""
    if not 0 < threshold <= 1:
        raise ValueError(f"the threshold lies above 0 and up to 1, not {threshold}")
    pairs = _listed(spans.select("span").distinct(), index, threshold)
    reached = _measured(pairs, index, F.lit(threshold)).where(F.col("final_score") >= threshold)
    return _ranked(reached).where(F.col("rank") == 1).drop("rank").where(F.lower("span") != F.lower("term"))


def best_candidates(spans: DataFrame, index: DataFrame, threshold: float = THRESHOLD, k: int = TOP_K) -> DataFrame:
    """The best term of each span when it reaches the threshold and differs from the span.

    Pairs that cannot reach the threshold go early: before the ranking those
    whose semantic score is too low even with the other two at 1, after it
    those too unlike in length. Neither can be or displace an accepted best.
    Letters and sound alone must not reach the threshold: terms that share no
    trigram with a span are not looked at, so lower ones are refused.
    """
    if threshold <= FUZZY_WEIGHT + PHONETIC_WEIGHT:
        raise ValueError(f"the threshold must be above {FUZZY_WEIGHT + PHONETIC_WEIGHT}")
    floor = (threshold - FUZZY_WEIGHT - PHONETIC_WEIGHT) / SEMANTIC_WEIGHT
    near = retrieve(spans, index, k, floor * (1 - 1e-9))
    a, b = F.length("span"), F.length("term")
    ceiling = final_score(F.col("semantic_score"), 2 * F.least(a, b) / (a + b), F.lit(1.0))
    scored = _scored(near.where(ceiling >= threshold - 1e-9), index, threshold)
    reached = scored.where(F.col("final_score") >= threshold)
    order = Window.partitionBy("span").orderBy(*_by_score())
    best = reached.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == 1).drop("rank")
    return best.where(F.lower("span") != F.lower("term"))


def best_places(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row, ties by column; not-a-numbers come last.

    Rows are parted at their k-th value; only what reaches it is sorted.
    """
    ranked = np.where(np.isnan(scores), -np.inf, scores)
    k = min(k, ranked.shape[1])
    least = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, ranked.shape[1] - k]
    rows, columns = np.nonzero(ranked >= least[:, None])
    order = np.lexsort((columns, -ranked[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(len(ranked)))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], columns[keep]


def semantic_topk(
    queries: DataFrame, index: DataFrame, k: int = 5, query: str = "query_id", term: str = "term"
) -> DataFrame:
    """The ``k`` terms with the largest dot product per query vector, ties by term.

    The matrix product is done block by block: hash blocks of queries meet
    hash blocks of terms, each pair of blocks is one numpy product in a task
    and gives k rows per query, and the k best of all blocks are kept.
    """
    term_blocks = 1 + index.count() // BLOCK_TERMS
    query_blocks = 1 + queries.count() // BLOCK_QUERIES

    def block(key: str, n: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = queries.select(
        query, F.col("embedding").cast("array<double>").alias("q"),
        block(query, query_blocks).alias("qb"), every(term_blocks).alias("tb"),
    )
    right = index.select(
        term, F.col("embedding").cast("array<double>").alias("t"),
        block(term, term_blocks).alias("tb"), every(query_blocks).alias("qb"),
    )
    schema = T.StructType(
        [queries.schema[query], index.schema[term], T.StructField("semantic_score", T.DoubleType())]
    )

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        b = b.sort_values(term, kind="stable")
        scores = np.stack(a["q"].to_numpy()) @ np.stack(b["t"].to_numpy()).T
        rows, top = best_places(scores, k)
        return pd.DataFrame(
            {
                query: a[query].to_numpy()[rows],
                term: b[term].to_numpy()[top],
                "semantic_score": scores[rows, top],
            }
        )

    local = left.groupBy("qb", "tb").cogroup(right.groupBy("qb", "tb")).applyInPandas(product, schema)
    order = Window.partitionBy(query).orderBy(F.desc("semantic_score"), term)
    return local.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
