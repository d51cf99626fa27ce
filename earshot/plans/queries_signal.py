"""Registered queries: waveforms. A clip is an embedding vector, in whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import signal as W
from earshot.operators import augment as A
from earshot.plans import corpus as C
from earshot.plans.registry import query

# Clips and noises are whole vectors, some given twice, so that noises are longer, shorter and equal in length.
_CLIP = "CASE WHEN vec_id % 2 = 1 THEN concat(embedding, embedding) ELSE embedding END"
_NOISE = "CASE WHEN vec_id % 3 = 1 THEN concat(embedding, embedding, embedding) ELSE embedding END"
CLIPS = """clips AS (
  SELECT vec_id AS clip_id, list_transform(CASE WHEN vec_id % 2 = 1 THEN list_concat(embedding, embedding)
         ELSE embedding END, lambda v: v::DOUBLE) AS y FROM embeddings),
noises AS (
  SELECT vec_id AS noise_id, list_transform(CASE WHEN vec_id % 3 = 1 THEN flatten([embedding, embedding, embedding])
         ELSE embedding END, lambda v: v::DOUBLE) AS noise FROM embeddings)"""


def sql_hash(key: str, salt: str = "") -> str:
    return f"('0x' || substr(md5(concat({key}, '{salt}')), 1, 8))::BIGINT"


# The dealing of noise: numbers in the order of hash bucket, then id.
DEALT = f"""{CLIPS}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY {sql_hash('noise_id')} % 1024, noise_id) - 1 AS number FROM noises),
dealt AS (
  SELECT clip_id, y, noise_id, noise, [5, 10, 15][{sql_hash('clip_id', 'snr')} % 3 + 1] AS snr_db
  FROM clips JOIN numbered ON number = {sql_hash('clip_id', 'pick')} % (SELECT count(*) FROM noises)),
matched AS (
  SELECT *, CASE WHEN len(noise) >= len(y)
      THEN noise[{sql_hash('clip_id', 'offset')} % greatest(len(noise) - len(y) + 1, 1) + 1 :
                 {sql_hash('clip_id', 'offset')} % greatest(len(noise) - len(y) + 1, 1) + len(y)]
      ELSE flatten([noise, noise])[1:len(y)] END AS fit FROM dealt),
scaled AS (
  SELECT *, sqrt((list_sum(list_transform(y, lambda v: v * v)) / len(y)) /
                 (pow(10.0, snr_db / 10.0) * (list_sum(list_transform(fit, lambda v: v * v)) / len(fit)))) AS k FROM matched),
mixed AS (SELECT *, list_transform(range(1, len(y) + 1), lambda i: y[i] + fit[i] * k) AS m FROM scaled)"""

DIGITS = 8


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("clip_id"), F.expr(_CLIP).alias("samples")
    )


def noises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("noise_id"), F.expr(_NOISE).alias("noise")
    )


def _long(df: DataFrame, samples: Column) -> DataFrame:
    return df.select("clip_id", F.posexplode_outer(samples).alias("pos", "value")).withColumn(
        "value", F.round("value", DIGITS)
    )


def _sql_long(source: str, samples: str) -> str:
    return f"""SELECT clip_id, i - 1 AS pos, round(s[i], {DIGITS}) AS value
               FROM (SELECT clip_id, {samples} AS s FROM {source}), unnest(range(1, len(s) + 1)) AS t(i)"""


_PEAK = "list_max(list_transform({0}, lambda v: abs(v)))"


@query(
    "peak_normalize",
    f"WITH {CLIPS}, peaks AS (SELECT *, {_PEAK.format('y')} AS p FROM clips) "
    + _sql_long("peaks", "list_transform(y, lambda v: v * (0.95::DOUBLE / p))"),
)
def q_peak_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(clips(spark, sf_dir), W.peak_normalize(F.col("samples")))


@query(
    "clip_guard",
    f"WITH {CLIPS}, peaks AS (SELECT *, {_PEAK.format('y')} + 1e-6 AS p FROM clips) "
    + _sql_long("peaks", "list_transform(y, lambda v: v / p)"),
)
def q_clip_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(clips(spark, sf_dir), W.clip_guard(F.col("samples")))


@query("assign_noise", f"WITH {DEALT} SELECT clip_id, noise_id, snr_db FROM dealt")
def q_assign_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.assign_noise(clips(spark, sf_dir), noises(spark, sf_dir)).select("clip_id", "noise_id", "snr_db")


@query("match_length", f"WITH {DEALT} " + _sql_long("matched", "fit"))
def q_match_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = A.assign_noise(clips(spark, sf_dir), noises(spark, sf_dir))
    fit = W.match_length(F.col("noise"), F.size("samples"), F.col("clip_id")).cast("array<double>")
    return _long(dealt, fit)


@query("mix_snr", f"WITH {DEALT} " + _sql_long("mixed", "m"))
def q_mix_snr(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = A.assign_noise(clips(spark, sf_dir), noises(spark, sf_dir))
    fit = W.match_length(F.col("noise"), F.size("samples"), F.col("clip_id"))
    return _long(dealt.withColumn("fit", fit), W.mix_snr(F.col("samples"), F.col("fit"), F.col("snr_db")))


@query(
    "add_noise",
    f"WITH {DEALT}, guarded AS (SELECT *, {_PEAK.format('m')} + 1e-6 AS p FROM mixed) "
    + _sql_long("guarded", "list_transform(m, lambda v: v / p)"),
)
def q_add_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(A.add_noise(clips(spark, sf_dir), noises(spark, sf_dir)), F.col("samples"))


@query("duration", f"WITH {CLIPS} SELECT clip_id, round(len(y) / 16000, 3) AS duration_sec FROM clips")
def q_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips(spark, sf_dir).select(
        "clip_id", W.duration(F.col("samples"), F.lit(16000)).alias("duration_sec")
    )


@query("gaussian_noise")
def q_gaussian_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(clips(spark, sf_dir), W.gaussian_noise(F.col("clip_id"), F.col("samples")))
