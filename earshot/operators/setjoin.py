"""Joins of sets by similarity, through prefixes in order of rarity.

Tokens are put in one global order, rarest in the index first. Two sets that share ``need`` tokens
or more must share one among the first ``size - need + 1`` of either, so only those few, rare tokens are
joined: tokens that most sets hold stand last and are hardly ever joined, however many sets hold
them. Sizes that rule a pair out are a condition of the join. A candidate is verified by the exact
intersection where it first meets, so no pair is shuffled twice and none needs to be made distinct.

Sets without tokens meet nothing. Ids are unique on either side; pairs without a common token are never reported.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.similarity import characters
from earshot.functions.text import let
from earshot.session import salted_join, via_table

# A side is broadcast only when its measured tokens have no more bytes than this.
BROADCAST_BYTES = 64 << 20
_SLACK = 1e-9


def bag(c: Column) -> Column:
    """The characters of a text as a set: each with the number of its occurrence."""

    def numbered(chars: Column) -> Column:
        return F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string")))

    return let(characters(c), numbered)


def need(measure: str, a: Column, b: Column, at_least: Column) -> Column:
    """Shared tokens that sets of sizes ``a`` and ``b`` must have for the similarity."""
    return at_least * F.sqrt(a * b) if measure == "cosine" else at_least * (a + b) / 2


def _least_need(measure: str, size: Column, at_least: Column) -> Column:
    """The least that a set of ``size`` must share with any set it is similar to."""
    return at_least * at_least * size if measure == "cosine" else at_least * size / (2 - at_least)


def _in_order(sets: DataFrame, key: str, frequency: DataFrame) -> DataFrame:
    """``sets`` with their tokens rarest first; tokens the index has not come before all."""
    rows = sets.select(key, F.explode("tokens").alias("token"))
    told = rows.join(frequency, "token", "left").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("pairs"))
    return sets.drop("tokens").join(told, key).withColumn("tokens", F.col("pairs.token")).drop("pairs")


def token_bytes(sets: DataFrame) -> int:
    return sets.agg(F.sum(F.octet_length(F.array_join("tokens", "")) + 24 * F.size("tokens"))).first()[0] or 0


def candidates(left: DataFrame, right: DataFrame, at_least: float | None = None, measure: str = "cosine") -> DataFrame:
    """Rows of the prefix join, before verification: keys, sizes, both token lists and the token they meet at.

    ``left``: ``left_id, tokens``, and ``at_least`` where the similarity asked for is not one number;
    ``right``: ``right_id, tokens``. Tokens are distinct.
    """
    frequency = via_table(right.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "token-counts")
    asked = F.col("at_least") if at_least is None else F.lit(float(at_least))
    a = _in_order(left.withColumn("asked", asked).select("left_id", "asked", "tokens"), "left_id", frequency)
    b = via_table(_in_order(right.select("right_id", "tokens"), "right_id", frequency), "ordered-index")

    def first(df: DataFrame, least: Column) -> Column:
        return F.slice("tokens", 1, F.greatest(F.lit(1), F.size("tokens") - F.ceil(least - _SLACK).cast("int") + 1))

    head = first(a, _least_need(measure, F.size("tokens"), F.col("asked")))
    # One similarity for all rows bounds the other side too; with one per row, its whole sets are looked up.
    tail = F.col("tokens") if at_least is None else first(b, _least_need(measure, F.size("tokens"), F.lit(float(at_least))))
    probes = a.select("left_id", "asked", F.col("tokens").alias("left_tokens"), F.explode(head).alias("token"))
    table = b.select("right_id", F.col("tokens").alias("right_tokens"), F.explode(tail).alias("token"))
    met = probes.join(F.broadcast(table), "token") if token_bytes(b) * 8 <= BROADCAST_BYTES else _salted(probes, table)
    sizes = F.size("left_tokens"), F.size("right_tokens")
    return met.where(F.least(*sizes) >= need(measure, *sizes, F.col("asked")) - _SLACK)


def _salted(probes: DataFrame, table: DataFrame) -> DataFrame:
    """The shuffle form: probes of one token are dealt to several tasks. ``table`` has several rows per token."""
    return salted_join(probes, table, "token", ["left_id"])


def similar_sets(left: DataFrame, right: DataFrame, at_least: float | None = None, measure: str = "cosine") -> DataFrame:
    """``left_id, right_id, shared, left_size, right_size`` of all pairs that reach the similarity and share a token.

    ``cosine``: shared / sqrt(a b); ``dice``: 2 shared / (a + b).
    """
    if measure not in ("cosine", "dice"):
        raise ValueError(f"measure: cosine or dice, not {measure!r}")
    if at_least is not None and not (0 <= at_least <= 1 and math.isfinite(at_least)):
        raise ValueError(f"at_least lies between 0 and 1, not {at_least}")
    met = candidates(left, right, at_least, measure).withColumn("common", F.array_intersect("left_tokens", "right_tokens"))
    sizes = F.size("left_tokens"), F.size("right_tokens")
    good = (F.size("common") >= need(measure, *sizes, F.col("asked")) - _SLACK) & (F.get("common", F.lit(0)) == F.col("token"))
    return met.where(good).select("left_id", "right_id", F.size("common").alias("shared"),
                                  sizes[0].alias("left_size"), sizes[1].alias("right_size"))
