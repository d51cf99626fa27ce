"""Evaluation jobs end to end: prediction files to reports, and the engine's own four baselines to scored records."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.text import normalize
from earshot.operators import correction as K
from earshot.operators import gate as G
from earshot.operators import reports as R
from earshot.operators import scoring as S
from earshot.operators.truth import join_truth
from earshot.schemas import CORRECTION
from earshot.session import via_table
from earshot.sources import files

BASELINES = ("baseline_0_raw", "baseline_1_normalized", "baseline_2_retrieval", "baseline_3_gated_retrieval")


def batch_evaluation(spark: SparkSession, predictions: str, report: str, errors: str, threshold: float = 0.3) -> DataFrame:
    """Read, validate and score a file of predictions; write the summary and the error rows. Gives the summary.

    Rows are scored once, into a table that both sinks read. Only the error rows keep their texts there: no sink reads those of others.
    """
    rows = files.require_rows(files.read_predictions(spark, predictions))
    wrong = S.is_error(threshold)
    texts = {c: F.when(wrong, F.col(c)).alias(c) for c in ("reference_text", "predicted_text")}
    told = S.score_predictions(rows)
    scored = via_table(told.select(*(texts.get(c, F.col(c)) for c in told.columns)), "scored")
    summary = R.summary(scored)
    files.write_report(summary, report)
    files.write_rows(S.error_patterns(scored, threshold), errors)
    return summary


def baselines(df: DataFrame, index: DataFrame, key: str, text: str,
              gate: G.Coefficients | PipelineModel = G.DEFAULT) -> DataFrame:
    """Each text as heard, normalised, corrected by retrieval and by gated retrieval, with the corrections made.

    One row per text and baseline: ``baseline, predicted_text, corrections``. Forms are looked up and judged once for both.
    """
    none = F.array().cast(T.ArrayType(CORRECTION))
    both = K.correct_both(df, index, key, text, gate)
    texts = [
        (F.col(text), none), (normalize(F.col(text)), none),
        (F.col("ungated_text"), F.col("ungated_corrections")), (F.col("gated_text"), F.col("gated_corrections")),
    ]
    rows = F.array(*(
        F.struct(F.lit(name).alias("baseline"), t.alias("predicted_text"), c.alias("corrections"))
        for name, (t, c) in zip(BASELINES, texts)
    ))
    return both.select(*df.columns, F.inline(rows))


def evaluate_baselines(samples: DataFrame, truth: DataFrame, index: DataFrame, text: str = "text",
                       key: str = "sample_id") -> DataFrame:
    """Scored rows of all four baselines: samples paired with their truth, scored against it and the samples' target lists.

    ``samples`` hold the heard ``text`` and the target lists; a sample without truth is left out, as there is nothing to score.
    """
    paired = join_truth(samples, truth.select(key, "reference_transcript"), key)
    rows = baselines(paired, index, key, text).withColumnRenamed("reference_transcript", "reference_text")
    return S.score_targets(rows)


def nested_records(scored: DataFrame, key: str = "sample_id") -> DataFrame:
    """One record per sample, as published: the reference, a field per baseline with its scores and
    hypothesis, and the corrections of the two correcting baselines as lists of their own.
    """
    record = F.struct(*S.SCORES, "hypothesis")

    def of(baseline: str, value: Column) -> Column:
        return F.first(F.when(F.col("baseline") == baseline, value), True)

    fields = [of(b, record).alias(b) for b in BASELINES]
    lists = [of(b, F.col("corrections")).alias(corrections_field(b)) for b in BASELINES[2:]]
    return scored.groupBy(key).agg(F.first("reference_text", True).alias("reference"), *fields, *lists)


def corrections_field(baseline: str) -> str:
    """The record's field for the corrections of a baseline: ``baseline_2_corrections``."""
    return "_".join(baseline.split("_")[:2]) + "_corrections"
