"""Registered queries: files written and read back through the library's sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import entities as E
from earshot.operators import evaluation as N
from earshot.operators import reports as R
from earshot.operators import scoring as S
from earshot.operators import truth as J
from earshot.plans import corpus as C
from earshot.plans.queries_metrics import SCORED, pairs
from earshot.plans.queries_text import ENTITIES
from earshot.plans.registry import query
from earshot.session import fresh_path
from earshot.sources import documents, files

_PREDICTION_COLUMNS = "sample_id, condition, reference_text, predicted_text, baseline_name"


def _prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.predictions(spark, sf_dir).select(*_PREDICTION_COLUMNS.split(", "))


@query("read_predictions_csv", f"WITH {C.PREDICTIONS} SELECT {_PREDICTION_COLUMNS} FROM predictions")
def q_read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "predictions") + ".csv"
    files.write_rows(_prediction_rows(spark, sf_dir), path)
    return files.read_predictions(spark, path)


@query("read_predictions_json", f"WITH {C.PREDICTIONS} SELECT {_PREDICTION_COLUMNS} FROM predictions")
def q_read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "predictions") + ".json"
    files.write_records(_prediction_rows(spark, sf_dir), path)
    return files.read_predictions(spark, path)


# Samples and truth: one keyed object per document, its keys the document's utterances.
TRUTH_ENTITIES = (
    f"{C.UTTERANCES}, u AS (SELECT doc_id, utt, lang, concat(doc_id, '-', utt) AS sample_id, reference_text AS text "
    "FROM utterances), " + ENTITIES.format(source="u")
)


def _truth_value() -> Column:
    return F.struct(
        F.col("reference_text").alias("reference_transcript"),
        F.struct("e.medications", "e.dosages", "e.frequencies", "e.symptoms", "e.negations").alias("entities"),
        F.col("e.intent").alias("intent"),
        F.col("e.risk_flag").alias("risk_flag"),
    )


def truth_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object per document, keyed by sample id; a group is never more than one document."""
    rows = C.utterances(spark, sf_dir).withColumn("e", E.extract_entities(F.col("reference_text")))
    entry = F.struct(F.concat_ws("-", "doc_id", "utt").alias("key"), _truth_value().alias("value"))
    return rows.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).select("value")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "truth")
    truth_documents(spark, sf_dir).write.text(path)
    return files.read_truth(spark, path, whole_file=False)


TRUTH_ROWS = f"""WITH {TRUTH_ENTITIES} SELECT sample_id, text AS reference_transcript, intent, risk_flag,
        array_to_string(medications, '|') AS medications, array_to_string(negations, '|') AS negations FROM entities"""


def _flat_truth(rows: DataFrame) -> DataFrame:
    return rows.select(
        "sample_id", "reference_transcript", "intent", "risk_flag",
        F.array_join("entities.medications", "|").alias("medications"),
        F.array_join("entities.negations", "|").alias("negations"),
    )


@query("read_truth", TRUTH_ROWS)
def q_read_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_truth(truth(spark, sf_dir))


@query("read_truth_objects", TRUTH_ROWS)
def q_read_truth_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth as one large object per file, each file read in splits."""
    path = fresh_path(spark, "truth-objects")
    rows = C.utterances(spark, sf_dir).withColumn("e", E.extract_entities(F.col("reference_text")))
    sample_id = F.concat_ws("-", "doc_id", "utt").alias("sample_id")
    documents.write_json_objects(rows.select(sample_id, _truth_value().alias("v")).select("sample_id", "v.*"), "sample_id", path)
    return _flat_truth(files.read_truth(spark, path))


@query(
    "read_samples",
    f"""WITH {C.UTTERANCES} SELECT concat(doc_id, '-', utt) AS sample_id, doc_id::VARCHAR AS title, reference_text AS text, lang AS accent
        FROM utterances""",
)
def q_read_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as one large array per file, each file read in splits."""
    path = fresh_path(spark, "samples")
    samples = C.utterances(spark, sf_dir).select(
        F.concat_ws("-", "doc_id", "utt").alias("sample_id"), F.col("doc_id").cast("string").alias("title"),
        F.col("reference_text").alias("text"), F.col("lang").alias("accent"),
    )
    documents.write_json_arrays(samples, path)
    return files.read_samples(spark, path).select("sample_id", "title", "text", "accent")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.utterances(spark, sf_dir).select(F.concat_ws("-", "doc_id", "utt").alias("sample_id"), "doc_id", "lang")


@query("join_truth", f"WITH {TRUTH_ENTITIES} SELECT sample_id, lang, intent, risk_flag FROM entities")
def q_join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = J.join_truth(_samples(spark, sf_dir), truth(spark, sf_dir))
    return joined.select("sample_id", "lang", "intent", "risk_flag")


@query(
    "samples_without_truth",
    f"""WITH {C.UTTERANCES}, ids AS (SELECT doc_id, concat(doc_id, '-', utt) AS sample_id FROM utterances)
        SELECT sample_id FROM ids WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def q_without_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = C.table(spark, sf_dir, "labels").select("doc_id")
    return J.without_truth(_samples(spark, sf_dir), labelled, "doc_id").select("sample_id")


_MEANS = ", ".join(f'round(avg("{m}"), 6) AS "{m}"' for m in S.METRICS)


@query(
    "report_csv",
    f"""WITH {SCORED} SELECT baseline_name, condition, {_MEANS}, count(sample_id) AS "NumSamples"
        FROM scored GROUP BY ALL""",
)
def q_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "report")
    files.write_report(R.summary(S.score_predictions(pairs(spark, sf_dir))), path)
    report = spark.read.option("header", True).csv(path)
    return report.select(
        "baseline_name", "condition",
        *[F.round(F.col(m).cast("double"), 6).alias(m) for m in S.METRICS],
        F.col("NumSamples").cast("long").alias("NumSamples"),
    )


@query(
    "records_json",
    f"""WITH {C.CHUNKS}, {ENTITIES.format(source='chunks')}
        SELECT session_id, chunk_index, text, array_to_string(dosages, '|') AS dosages, intent FROM entities""",
)
def q_records_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.chunks(spark, sf_dir).withColumn("extraction", E.extract_entities(F.col("text")))
    path = fresh_path(spark, "records")
    files.write_records(rows, path)
    back = spark.read.schema(rows.schema).json(path)
    return back.select(
        "session_id", "chunk_index", "text",
        F.array_join("extraction.dosages", "|").alias("dosages"), F.col("extraction.intent").alias("intent"),
    )


@query(
    "load_vocabulary",
    r"""SELECT DISTINCT term FROM (SELECT trim(unnest(string_split_regex(text, '[ \n.,]'))) AS term FROM benchmark)
        WHERE term <> ''""",
)
def q_load_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "vocabulary")
    words = C.table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"[ \n.,]")).alias("w")).distinct()
    words.select(F.concat(F.lit("  "), "w", F.lit(" ")).alias("value")).write.text(path)
    return files.read_vocabulary(spark, path)


@query(
    "index_roundtrip",
    "SELECT vec_id::VARCHAR AS term, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS value "
    "FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)",
)
def q_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "index")
    vectors = C.table(spark, sf_dir, "embeddings")
    # One document of parallel arrays per vector, so that no task holds the whole index.
    vectors.select(
        F.array(F.col("vec_id").cast("string")).alias("terms"),
        F.array(F.col("embedding").cast("array<double>")).alias("embeddings"),
    ).write.json(path + "-json")
    files.write_index(files.read_index_document(spark, path + "-json", whole_file=False), path)
    index = files.read_index(spark, path)
    return index.select("term", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "value", F.round("value", 6)
    )


@query(
    "batch_evaluation",
    f"""WITH {SCORED} SELECT 'summary' AS sink, baseline_name, condition, NULL AS sample_id, {', '.join(f'round(avg("{m}"), 6) AS {m.lower()}' for m in S.METRICS)}, count(sample_id) AS n
        FROM scored GROUP BY ALL
        UNION ALL SELECT 'errors', baseline_name, condition, sample_id, {', '.join(f'round("{m}", 6)' for m in S.METRICS)}, 1
        FROM scored WHERE "WER" > 0.3 OR "CER" > 0.3""",
)
def q_batch_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job over a file of predictions: both sinks, read back."""
    path = fresh_path(spark, "batch")
    files.write_packed_rows(_prediction_rows(spark, sf_dir), path + ".csv")
    N.batch_evaluation(spark, path + ".csv", path + "-report", path + "-errors")

    def sink(name: str, n: str) -> DataFrame:
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{path}-{name}")
        sample = F.col("sample_id") if name == "errors" else F.lit(None).cast("string")
        return rows.select(
            F.lit("summary" if name == "report" else name).alias("sink"), "baseline_name", "condition", sample.alias("sample_id"),
            *(F.round(F.col(m).cast("double"), 6).alias(m.lower()) for m in S.METRICS), F.expr(n).cast("long").alias("n"))

    return sink("report", "NumSamples").unionByName(sink("errors", "1"))
