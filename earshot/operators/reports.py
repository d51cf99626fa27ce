"""Reports: aggregations over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.scoring import METRICS, SCORES

LOWER_IS_BETTER = ("wer", "cer")


def summary(scored: DataFrame) -> DataFrame:
    """Mean metrics and number of samples per system and condition."""
    return scored.groupBy("baseline_name", "condition").agg(
        *[F.avg(m).alias(m) for m in METRICS], F.count("sample_id").alias("NumSamples")
    )


def ablation(scored: DataFrame, baseline: str = "baseline", digits: int = 4) -> DataFrame:
    """Mean scores per baseline."""
    return scored.groupBy(F.col(baseline).alias("baseline")).agg(
        *[F.round(F.avg(m), digits).alias(m) for m in SCORES]
    )


def best_per_metric(table: DataFrame, key: str = "baseline") -> DataFrame:
    """Long form of a score table with the best value per metric flagged; ties are all best."""
    long = table.unpivot([key], list(SCORES), "metric", "value")
    best = long.groupBy("metric").agg(
        F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.min("value")).otherwise(F.max("value")).alias("best")
    )
    return long.join(best, "metric").select(key, "metric", "value", (F.col("value") == F.col("best")).alias("is_best"))


def percent_table(table: DataFrame, label: str = "label") -> DataFrame:
    """Scores in percent with one decimal and the part of the label before the colon."""
    return table.select(
        F.substring_index(label, ":", 1).alias("name"),
        F.col(label).alias("full_label"),
        *[F.round(F.col(m) * 100, 1).alias(m) for m in SCORES],
    )


def slice_report(scored: DataFrame, axes: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean metrics per value of each axis, all axes in one pass over the rows."""
    sets = [[F.col(a)] for a in axes]
    axis = F.element_at(
        F.filter(
            F.array(*[F.when(F.grouping(a) == 0, F.lit(a)) for a in axes]),
            lambda a: a.isNotNull(),
        ),
        1,
    )
    return scored.groupingSets(sets, *axes).agg(
        axis.alias("axis"),
        F.coalesce(*[F.col(a).cast("string") for a in axes]).alias("value"),
        *[F.avg(m).alias(m) for m in metrics],
        F.count(F.lit(1)).alias("samples"),
    ).drop(*axes)


def classification_report(df: DataFrame, label: str, prediction: str, digits: int = 3) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    The rows shrink to one count per (label, prediction) pair before anything else.
    """
    cells = df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").cast("string").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("pred").cast("string").alias("class"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        )
    )
    totals = sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    per_class = totals.select(
        "class",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "hit",
    )
    means = per_class.agg(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("class"),
                        *[value(m).alias(m) for m in ("precision", "recall", "f1")],
                        F.sum("support").alias("support"),
                    )
                    for name, value in (
                        ("accuracy", lambda m: F.sum("hit") / F.sum("support")),
                        ("macro avg", lambda m: F.avg(m)),
                        ("weighted avg", lambda m: F.sum(F.col(m) * F.col("support")) / F.sum("support")),
                    )
                ]
            )
        )
    )
    return per_class.drop("hit").unionByName(means).select(
        "class", *[F.round(m, digits).alias(m) for m in ("precision", "recall", "f1")], "support"
    )


def wer_series(scored: DataFrame, key: str, baseline: str, systems: Sequence[str], value: str = "wer") -> DataFrame:
    """One row per sample, one error-rate column per system."""
    return scored.groupBy(key).pivot(baseline, list(systems)).agg(F.first(value))


def redaction_counts(redacted: DataFrame) -> DataFrame:
    """Number of redactions and of log entries per label; two stages share the label SSN."""
    return (
        redacted.select(F.inline_outer("redactions"))
        .where(F.col("type").isNotNull())
        .groupBy("type")
        .agg(F.sum("count").alias("redactions"), F.count(F.lit(1)).alias("log_entries"))
    )


def inventory(df: DataFrame) -> DataFrame:
    """Distinct baselines and conditions with their number of rows, in one pass."""
    pair = F.inline(
        F.array(
            F.struct(F.lit("baseline").alias("kind"), F.col("baseline_name").alias("value")),
            F.struct(F.lit("condition").alias("kind"), F.col("condition").alias("value")),
        )
    )
    return df.select(pair).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("samples"))
