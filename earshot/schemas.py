"""Explicit schemas of the files the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


PREDICTIONS = T.StructType(
    _strings("sample_id", "condition", "reference_text", "predicted_text", "baseline_name")
)

SAMPLES = T.StructType(
    _strings(
        "sample_id", "title", "text", "accent", "audio_condition", "speech_variation",
        "clinical_challenge", "primary_failure_mode", "secondary_failure_mode",
    )
    + [
        T.StructField(n, TEXTS)
        for n in ("target_keywords", "target_medications", "target_numerics", "target_negations")
    ]
)

ENTITY_LISTS = T.StructType(
    [T.StructField(n, TEXTS) for n in ("medications", "dosages", "frequencies", "symptoms", "negations")]
)

TRUTH_VALUE = T.StructType(
    _strings("reference_transcript")
    + [T.StructField("entities", ENTITY_LISTS)]
    + _strings("intent")
    + [T.StructField("risk_flag", T.BooleanType())]
)
TRUTH_DOCUMENT = T.MapType(T.StringType(), TRUTH_VALUE)

FEATURE_NAMES = (
    "semantic_score", "fuzzy_score", "phonetic_score",
    "word_count", "contains_stopword", "contains_digit",
)
FEATURES = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in FEATURE_NAMES[:3]]
    + [T.StructField(n, T.IntegerType()) for n in FEATURE_NAMES[3:]]
)

GATE_TRAINING = T.StructType(
    _strings("span", "candidate") + FEATURES.fields + [T.StructField("should_correct", T.IntegerType())]
)

CORRECTION = T.StructType(
    _strings("type", "original", "clean_span", "corrected")
    + [
        T.StructField(n, T.DoubleType())
        for n in ("retrieval_score", "gate_probability", "semantic_score", "fuzzy_score", "phonetic_score")
    ]
    + [T.StructField("features", FEATURES)]
)

INDEX_DOCUMENT = T.StructType(
    [
        T.StructField("terms", TEXTS),
        T.StructField("embeddings", T.ArrayType(T.ArrayType(T.DoubleType()))),
    ]
)

CHUNKS = T.StructType(
    _strings("session_id")
    + [T.StructField("chunk_index", T.LongType()), T.StructField("ts", T.TimestampType())]
    + _strings("text")
)

CLIPS = T.StructType(
    _strings("clip_id")
    + [T.StructField("sr", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))]
)
