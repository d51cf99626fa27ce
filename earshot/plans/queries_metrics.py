"""Registered queries: metrics, projections and reports over all utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import entities as E
from earshot.functions import metrics as M
from earshot.functions.text import normalize
from earshot.operators import reports as R
from earshot.operators import scoring as S
from earshot.plans import corpus as C
from earshot.plans.registry import query

SQL_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"


def sql_words(c: str) -> str:
    return f"list_filter(string_split_regex({c}, '{SQL_BLANK}'), lambda x: x <> '')"


def sql_strings(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# Edit distances in SQL: levenshtein counts bytes there, so words (and, in
# texts beyond ASCII, characters) are first spelled as single-byte symbols.
SCORED = rf"""{C.PREDICTIONS}, words AS (
  SELECT *, {sql_words("reference_text")} AS rt, {sql_words("predicted_text")} AS ht,
         regexp_extract_all(reference_text, '(?s).') AS rc, regexp_extract_all(predicted_text, '(?s).') AS hc,
         regexp_extract_all(reference_text, '[0-9]+') AS rn, regexp_extract_all(predicted_text, '[0-9]+') AS hn
  FROM predictions),
symbols AS (SELECT *, list_distinct(list_intersect(rt, ht)) AS sv, list_distinct(list_concat(rc, hc)) AS cv FROM words),
distances AS (
  SELECT *,
    levenshtein(
      array_to_string(list_transform(rt, lambda t: chr(CASE WHEN list_contains(sv, t) THEN list_position(sv, t)::INT + 2 ELSE 1 END)), ''),
      array_to_string(list_transform(ht, lambda t: chr(CASE WHEN list_contains(sv, t) THEN list_position(sv, t)::INT + 2 ELSE 2 END)), '')) AS word_distance,
    CASE WHEN strlen(reference_text) = length(reference_text) AND strlen(predicted_text) = length(predicted_text)
      THEN levenshtein(reference_text, predicted_text)
      ELSE levenshtein(array_to_string(list_transform(rc, lambda t: chr(list_position(cv, t)::INT)), ''),
                       array_to_string(list_transform(hc, lambda t: chr(list_position(cv, t)::INT)), '')) END AS char_distance
  FROM symbols),
scored AS (
  SELECT sample_id, condition, lang, source, baseline_name, reference_text, predicted_text,
    word_distance / greatest(1, len(rt)) AS "WER",
    char_distance / greatest(1, length(reference_text)) AS "CER",
    len(list_distinct(list_intersect(rt, ht))) / greatest(1, len(list_distinct(rt))) AS "KeywordAcc",
    len(list_distinct(list_intersect(rn, hn))) / greatest(1, len(list_distinct(rn))) AS "NumericAcc",
    CASE WHEN contains(reference_text, 'no ') = contains(predicted_text, 'no ') THEN 1.0 ELSE 0.0 END::DOUBLE AS "NegationAcc"
  FROM distances)"""

_LOWER_REF = "lower(reference_text)"
TARGET_SCORED = rf"""{SCORED}, targets AS (
  SELECT *, lower(predicted_text) AS hyp,
    list_filter({sql_strings(E.MEDICATIONS)}, lambda t: contains({_LOWER_REF}, t)) AS target_keywords,
    regexp_extract_all(reference_text, '[0-9]+') AS target_numerics,
    list_filter({sql_strings(E.NEGATIONS)}, lambda t: contains({_LOWER_REF}, t)) AS target_negations
  FROM scored),
target_scored AS (
  SELECT sample_id, condition, lang, source, baseline_name, "WER" AS wer, "CER" AS cer,
    CASE WHEN len(target_keywords) = 0 THEN 1.0 ELSE len(list_filter(target_keywords, lambda t: contains(hyp, lower(t)))) / len(target_keywords) END AS keyword_acc,
    CASE WHEN len(target_numerics) = 0 THEN 1.0 ELSE len(list_filter(target_numerics, lambda t: contains(hyp, t))) / len(target_numerics) END AS numeric_acc,
    CASE WHEN len(target_negations) = 0 THEN 1.0 ELSE len(list_filter(target_negations, lambda t: contains(hyp, lower(t)))) / len(target_negations) END AS negation_acc
  FROM targets)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.predictions(spark, sf_dir)


def with_targets(df: DataFrame) -> DataFrame:
    """Target lists taken from the reference itself."""
    ref = F.lower("reference_text")
    negations = F.array_compact(F.array(*[F.when(F.contains(ref, F.lit(n)), F.lit(n)) for n in E.NEGATIONS]))
    return df.withColumns(
        {
            "target_keywords": E.medications(F.col("reference_text")),
            "target_numerics": F.regexp_extract_all("reference_text", F.lit(r"\d+"), F.lit(0)),
            "target_negations": negations,
        }
    )


def target_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.score_targets(with_targets(pairs(spark, sf_dir)))


def _pair_metric(name: str, metric, column: str) -> None:
    @query(name, f'WITH {SCORED} SELECT sample_id, baseline_name, "{column}" AS {name} FROM scored')
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = metric(F.col("reference_text"), F.col("predicted_text"))
        return pairs(spark, sf_dir).select("sample_id", "baseline_name", value.alias(name))


@query("wer", f'WITH {SCORED} SELECT sample_id, baseline_name, "WER" AS wer FROM scored')
def wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_error_rates(pairs(spark, sf_dir), "wer", None).select("sample_id", "baseline_name", "wer")


@query("cer", f'WITH {SCORED} SELECT sample_id, baseline_name, "CER" AS cer FROM scored')
def cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_error_rates(pairs(spark, sf_dir), None, "cer").select("sample_id", "baseline_name", "cer")


_pair_metric("keyword_accuracy", M.keyword_accuracy, "KeywordAcc")
_pair_metric("numeric_accuracy", M.numeric_accuracy, "NumericAcc")
_pair_metric("negation_accuracy", M.negation_accuracy, "NegationAcc")


def _target_metric(name: str, metric, targets: str, column: str) -> None:
    @query(name, f"WITH {TARGET_SCORED} SELECT sample_id, baseline_name, {column} AS {name} FROM target_scored")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = with_targets(C.predictions(spark, sf_dir))
        return rows.select("sample_id", "baseline_name", metric(F.col(targets), F.col("predicted_text")).alias(name))


_target_metric("domain_keyword_accuracy", M.domain_keyword_accuracy, "target_keywords", "keyword_acc")
_target_metric("target_numeric_accuracy", M.target_numeric_accuracy, "target_numerics", "numeric_acc")
_target_metric("target_negation_accuracy", M.target_negation_accuracy, "target_negations", "negation_acc")


@query(
    "metric_columns",
    f'WITH {SCORED} SELECT sample_id, condition, baseline_name, "WER", "CER", "KeywordAcc", "NumericAcc", "NegationAcc" FROM scored',
)
def metric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.score_predictions(pairs(spark, sf_dir))
    return scored.select("sample_id", "condition", "baseline_name", *S.METRICS)


@query(
    "error_patterns",
    f"""WITH {SCORED} SELECT sample_id, condition, baseline_name, reference_text, predicted_text, "WER", "CER"
        FROM scored WHERE "WER" > 0.3 OR "CER" > 0.3""",
)
def error_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.score_predictions(pairs(spark, sf_dir))
    return S.error_patterns(scored).select(
        "sample_id", "condition", "baseline_name", "reference_text", "predicted_text", "WER", "CER"
    )


@query(
    "evaluate",
    f"""WITH {SCORED} SELECT sample_id, baseline_name, "WER" AS wer, "CER" AS cer, "KeywordAcc" AS keyword_accuracy,
        "NumericAcc" AS numeric_accuracy, "NegationAcc" AS negation_accuracy,
        reference_text AS reference, predicted_text AS hypothesis FROM scored""",
)
def evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pairs(spark, sf_dir).select("sample_id", "baseline_name", "reference_text", "predicted_text")
    return S.evaluate_pairs(rows).select("*", "details.*").drop("details")


@query(
    "score",
    f"""WITH {TARGET_SCORED} SELECT sample_id, baseline_name, wer, cer, keyword_acc, numeric_acc, negation_acc
        FROM target_scored""",
)
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_scores(spark, sf_dir).select("sample_id", "baseline_name", *S.SCORES)


_ROUNDED_SCORES = ", ".join(f"round(avg({m}), 4) AS {m}" for m in S.SCORES)
ABLATION = f"""{TARGET_SCORED}, ablation AS (
  SELECT baseline_name AS baseline, {_ROUNDED_SCORES} FROM target_scored GROUP BY 1)"""


def _gain(score: str, sign: int, name: str) -> str:
    """The difference of one score between the two systems of a sample, in one pass over the scored rows."""
    raw, gated = (f"max({score}) FILTER (baseline_name = '{b}')" for b in ("raw_asr", "gated_retrieval"))
    return f"round({sign} * ({raw} - {gated}), 9) AS {name}"


_GAINS = {"wer": 1, "cer": 1, "keyword_acc": -1, "numeric_acc": -1, "negation_acc": -1}


@query(
    "improvement",
    f"""WITH {TARGET_SCORED} SELECT sample_id, {', '.join(_gain(m, s, m.removesuffix('_acc') + '_gain') for m, s in _GAINS.items())}
        FROM target_scored GROUP BY sample_id HAVING count(DISTINCT baseline_name) = 2""",
)
def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    gains = S.improvement(target_scores(spark, sf_dir), "sample_id", "baseline_name", "raw_asr", "gated_retrieval")
    # Differences of equal accuracies are 0 and not -0 in both engines.
    return gains.select("sample_id", *((F.round(m.removesuffix("_acc") + "_gain", 9) + F.lit(0.0)).alias(m.removesuffix("_acc") + "_gain") for m in _GAINS))


@query(
    "safety_critical_error_rate",
    f"""WITH {TARGET_SCORED} SELECT baseline_name, condition, count(*) AS samples,
        round(avg(CASE WHEN numeric_acc < 1 OR negation_acc < 1 THEN 1.0 ELSE 0.0 END), 6) AS safety_critical_error_rate
        FROM target_scored GROUP BY ALL""",
)
def safety_critical_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_targets(C.predictions(spark, sf_dir))
    hyp = F.col("predicted_text")
    scored = rows.withColumns(
        {
            "numeric_acc": M.target_numeric_accuracy(F.col("target_numerics"), hyp),
            "negation_acc": M.target_negation_accuracy(F.col("target_negations"), hyp),
        }
    )
    rates = S.safety_critical_error_rate(scored, ["baseline_name", "condition"])
    return rates.withColumn("safety_critical_error_rate", F.round("safety_critical_error_rate", 6))


_SUMMARY_MEANS = ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in S.METRICS)


@query(
    "summary",
    f"""WITH {SCORED} SELECT baseline_name, condition, {_SUMMARY_MEANS}, count(sample_id) AS "NumSamples"
        FROM scored GROUP BY ALL""",
)
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = R.summary(S.score_predictions(pairs(spark, sf_dir)))
    return report.withColumns({m: F.round(m, 6) for m in S.METRICS})


@query("ablation", f"WITH {ABLATION} SELECT * FROM ablation")
def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ablation(target_scores(spark, sf_dir), "baseline_name")


@query(
    "best_per_metric",
    f"""WITH {ABLATION}, long AS (UNPIVOT ablation ON wer, cer, keyword_acc, numeric_acc, negation_acc INTO NAME metric VALUE value)
        SELECT baseline, metric, value,
          value = CASE WHEN metric IN ('wer', 'cer') THEN min(value) OVER (PARTITION BY metric)
                       ELSE max(value) OVER (PARTITION BY metric) END AS is_best FROM long""",
)
def best_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_per_metric(ablation(spark, sf_dir))


@query(
    "percent_table",
    f"""WITH {ABLATION} SELECT split_part(label, ':', 1) AS name, label AS full_label, round(wer * 100, 1) AS wer,
        round(cer * 100, 1) AS cer, round(keyword_acc * 100, 1) AS keyword_acc,
        round(numeric_acc * 100, 1) AS numeric_acc, round(negation_acc * 100, 1) AS negation_acc
        FROM (SELECT *, CASE baseline WHEN 'raw_asr' THEN 'B0: raw' ELSE 'B3: gated' END AS label FROM ablation)""",
)
def percent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("baseline") == "raw_asr", "B0: raw").otherwise("B3: gated")
    return R.percent_table(ablation(spark, sf_dir).withColumn("label", label))


@query(
    "slice_report",
    f"""WITH {SCORED}, long AS (SELECT *, unnest([struct_pack(axis := 'lang', value := lang),
            struct_pack(axis := 'source', value := source), struct_pack(axis := 'condition', value := condition)]) AS slice FROM scored)
        SELECT slice.axis AS axis, slice.value AS value, count(*) AS samples, {_SUMMARY_MEANS} FROM long GROUP BY ALL""",
)
def slice_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = R.slice_report(S.score_predictions(pairs(spark, sf_dir)), ["lang", "source", "condition"], S.METRICS)
    return report.withColumns({m: F.round(m, 6) for m in S.METRICS})


@query(
    "classification_report",
    """WITH classes AS (SELECT DISTINCT quality AS c FROM labels UNION SELECT DISTINCT toxic FROM labels),
       counts AS (SELECT c,
           (SELECT count(*) FROM labels WHERE quality = c) AS support,
           (SELECT count(*) FROM labels WHERE toxic = c) AS predicted,
           (SELECT count(*) FROM labels WHERE quality = c AND toxic = c) AS hit FROM classes),
       rates AS (SELECT c, support, hit,
           CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
           CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
           CASE WHEN predicted + support > 0 THEN 2 * hit / (predicted + support) ELSE 0 END AS f1 FROM counts),
       report AS (
         SELECT c::VARCHAR AS class, precision, recall, f1, support FROM rates
         UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM rates
         UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rates
         UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                          sum(f1 * support) / sum(support), sum(support) FROM rates)
       SELECT class, round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1,
              support::BIGINT AS support FROM report""",
)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.classification_report(C.table(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "wer_series",
    f"""WITH {SCORED} SELECT sample_id, max(CASE baseline_name WHEN 'raw_asr' THEN "WER" END) AS raw_asr,
        max(CASE baseline_name WHEN 'gated_retrieval' THEN "WER" END) AS gated_retrieval
        FROM scored GROUP BY sample_id""",
)
def wer_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = S.with_error_rates(pairs(spark, sf_dir), "wer", None)
    return R.wer_series(scored, "sample_id", "baseline_name", ["raw_asr", "gated_retrieval"])


@query(
    "inventory",
    f"""WITH {C.PREDICTIONS} SELECT 'baseline' AS kind, baseline_name AS value, count(*) AS samples FROM predictions GROUP BY ALL
        UNION ALL SELECT 'condition', condition, count(*) FROM predictions GROUP BY ALL""",
)
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.inventory(C.predictions(spark, sf_dir))


_ACCENT = "CASE lang WHEN 'en' THEN 'general_american' WHEN 'fr' THEN 'indian_english' WHEN 'de' THEN NULL ELSE 'british_english' END"
_AUDIO = "CASE doc_id % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'telephony_8khz' WHEN 2 THEN 'telephony_noise' ELSE NULL END"


@query(
    "route_condition",
    f"""WITH d AS (SELECT doc_id, {_ACCENT} AS accent, {_AUDIO} AS audio FROM documents),
        r AS (SELECT doc_id, CASE WHEN accent IS NOT NULL AND accent <> 'general_american' THEN 'accented'
                                  WHEN audio IS NULL OR audio = 'clean' THEN 'clean'
                                  WHEN audio = 'telephony_8khz' THEN 'telephony' ELSE 'noisy' END AS folder FROM d)
        SELECT doc_id, folder, 'audio/' || folder || '/' || doc_id || '.wav' AS path FROM r""",
)
def route_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select(
        "doc_id", F.expr(_ACCENT).alias("accent"), F.expr(_AUDIO).alias("audio")
    )
    folder = S.route_condition(F.col("accent"), F.col("audio"))
    return docs.select("doc_id", folder.alias("folder")).select(
        "doc_id", "folder", S.audio_path("audio", F.col("folder"), F.col("doc_id").cast("string")).alias("path")
    )
