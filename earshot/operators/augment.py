"""Noise clips dealt to clean clips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions import signal as W
from earshot.session import salted_join

SNR_CHOICES = (5, 10, 15)
NUMBER_BUCKETS = 1024


def dense_numbers(df: DataFrame, key: str, name: str) -> DataFrame:
    """Number the rows 0, 1, ... without bringing them to one task.

    Rows are numbered within hash buckets; the offsets come from the bucket
    counts, of which there are never more than ``NUMBER_BUCKETS``.
    """
    bucketed = df.withColumn("_bucket", F.pmod(W.hash_number(F.col(key)), F.lit(NUMBER_BUCKETS)))
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(key)) - 1
    return (
        bucketed.withColumn("_place", place)
        .join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_bucket", "_place", "_offset")
    )


def assign_noise(clean: DataFrame, noise: DataFrame, clip: str = "clip_id", noise_key: str = "noise_id") -> DataFrame:
    """Give every clean clip one noise clip and one ratio, both fixed by the clip's id.

    The noise clips are numbered and joined by number. Few noise clips make
    hot numbers, so the join is salted by the clip.
    """
    numbered = dense_numbers(noise, noise_key, "_number")
    total = noise.agg(F.count(F.lit(1)).alias("n")).scalar()
    choices = F.array(*[F.lit(s) for s in SNR_CHOICES])
    pick = F.pmod(W.hash_number(F.col(clip), "snr"), F.lit(len(SNR_CHOICES))).cast("int")
    dealt = clean.withColumns(
        {
            "_number": F.pmod(W.hash_number(F.col(clip), "pick"), total),
            "snr_db": F.get(choices, pick),
        }
    )
    return salted_join(dealt, numbered, "_number", [clip]).drop("_number")


def add_noise(clean: DataFrame, noise: DataFrame) -> DataFrame:
    """Noisy clips from (clip_id, samples) and (noise_id, noise): dealt, matched, mixed, guarded."""
    dealt = assign_noise(clean, noise)
    matched = W.match_length(F.col("noise"), F.size("samples"), F.col("clip_id"))
    mixed = dealt.withColumn("_noise", matched).withColumn(
        "_mixed", W.mix_snr(F.col("samples"), F.col("_noise"), F.col("snr_db"))
    )
    return mixed.select("clip_id", "noise_id", "snr_db", W.clip_guard(F.col("_mixed")).alias("samples"))
