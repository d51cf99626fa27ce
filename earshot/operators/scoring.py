"""Row-level scoring of prediction rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import metrics as M
from earshot.functions.longtext import pair_distances

METRICS = ("WER", "CER", "KeywordAcc", "NumericAcc", "NegationAcc")
SCORES = ("wer", "cer", "keyword_acc", "numeric_acc", "negation_acc")


def with_error_rates(df: DataFrame, wer: str | None = "WER", cer: str | None = "CER") -> DataFrame:
    """Add word and character error rate of ``reference_text`` and ``predicted_text``.

    Both come from one pass over the pairs, which compares near texts side by side and others bit by bit.
    """
    ref, hyp = M.text_or_empty(F.col("reference_text")), M.text_or_empty(F.col("predicted_text"))
    found, rates = F.col("_distances"), {}
    if wer:
        rates[wer] = found["words"] / F.greatest(F.lit(1), found["count"])
    if cer:
        rates[cer] = found["chars"] / F.greatest(F.lit(1), F.length(ref))
    told = df.withColumn("_distances", pair_distances(ref, hyp, bool(wer), bool(cer)))
    return told.withColumns(rates).select(*df.columns, *rates)


def score_predictions(
    df: DataFrame, legacy_numeric: bool = False, legacy_negation: bool = False, float32_compat: bool = False
) -> DataFrame:
    """Add the five pairwise metrics to every prediction row."""
    ref, hyp = F.col("reference_text"), F.col("predicted_text")
    scored = with_error_rates(df).withColumns(
        {
            "KeywordAcc": M.keyword_accuracy(ref, hyp),
            "NumericAcc": M.numeric_accuracy(ref, hyp, legacy_numeric),
            "NegationAcc": M.negation_accuracy(ref, hyp, legacy_negation),
        }
    )
    if float32_compat:
        scored = scored.withColumns({name: F.col(name).cast("float") for name in METRICS})
    return scored


def error_patterns(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Rows whose word or character error rate is above the threshold."""
    return scored.where(is_error(threshold))


def is_error(threshold: float) -> Column:
    return (F.col("WER") > threshold) | (F.col("CER") > threshold)


def score_targets(
    df: DataFrame,
    keywords: str = "target_keywords",
    numerics: str = "target_numerics",
    negations: str = "target_negations",
) -> DataFrame:
    """Add the scored record's fields, accuracies taken on target lists."""
    hyp = F.col("predicted_text")
    return with_error_rates(df, "wer", "cer").withColumns(
        {
            "keyword_acc": M.domain_keyword_accuracy(F.col(keywords), hyp),
            "numeric_acc": M.target_numeric_accuracy(F.col(numerics), hyp),
            "negation_acc": M.target_negation_accuracy(F.col(negations), hyp),
            "hypothesis": M.text_or_empty(hyp),
        }
    )


def evaluate_pairs(df: DataFrame) -> DataFrame:
    """Error rates of single pairs with the real accuracies in place of zeros."""
    scored = score_predictions(df)
    return scored.select(
        *[c for c in df.columns if c not in ("reference_text", "predicted_text")],
        F.col("WER").alias("wer"),
        F.col("CER").alias("cer"),
        F.col("KeywordAcc").alias("keyword_accuracy"),
        F.col("NumericAcc").alias("numeric_accuracy"),
        F.col("NegationAcc").alias("negation_accuracy"),
        F.struct(F.col("reference_text").alias("reference"), F.col("predicted_text").alias("hypothesis")).alias(
            "details"
        ),
    )


def variants(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """One row per variant of a transcript: ``baseline`` and its ``hypothesis``.

    The variants are unrolled in place from one array, without a shuffle.
    """
    rows = F.array(
        *[F.struct(F.lit(name).alias("baseline"), value.alias("hypothesis")) for name, value in texts.items()]
    )
    return df.select("*", F.inline(rows))


def route_condition(accent: Column, audio_condition: Column) -> Column:
    """The folder a recording belongs to."""
    condition = F.coalesce(audio_condition, F.lit("clean"))
    return (
        F.when(F.coalesce(accent, F.lit("general_american")) != "general_american", "accented")
        .when(condition == "clean", "clean")
        .when(condition == "telephony_8khz", "telephony")
        .otherwise("noisy")
    )


def audio_path(base: str, folder: Column, sample_id: Column) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/"), folder, F.lit("/"), sample_id, F.lit(".wav"))


def improvement(scored: DataFrame, key: str, baseline: str, raw: str, corrected: str) -> DataFrame:
    """Gains of one baseline over another: errors raw - corrected, accuracies corrected - raw."""

    def of(name: str, metric: str) -> Column:
        return F.max(F.when(F.col(baseline) == name, F.col(metric)))

    gains = [
        ((of(raw, m) - of(corrected, m)) if m in ("wer", "cer") else (of(corrected, m) - of(raw, m))).alias(
            m.removesuffix("_acc") + "_gain"
        )
        for m in SCORES
    ]
    return scored.groupBy(key).agg(*gains)


def safety_critical_error_rate(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of rows that lose an expected number or an expected negation."""
    unsafe = (F.col("numeric_acc") < 1.0) | (F.col("negation_acc") < 1.0)
    return scored.groupBy(*by).agg(
        F.avg(F.when(unsafe, 1.0).otherwise(0.0)).alias("safety_critical_error_rate"),
        F.count(F.lit(1)).alias("samples"),
    )
