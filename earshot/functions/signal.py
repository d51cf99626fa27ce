"""Waveforms as array columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.text import let

TARGET_PEAK = 0.95
GUARD = 1e-6


def _doubles(y: Column) -> Column:
    return y.cast("array<double>")


def _peak(y: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(y, F.abs)), F.lit(0.0))


def _scaled(y: Column, factor: Column) -> Column:
    return let(factor, lambda k: F.transform(y, lambda v: v * k))


def peak_normalize(y: Column, target: float = TARGET_PEAK) -> Column:
    """Scale so that the largest magnitude is ``target``; silence stays as it is."""
    y = _doubles(y)
    return F.when(_peak(y) == 0, y).otherwise(_scaled(y, F.try_divide(F.lit(target), _peak(y))))


def clip_guard(y: Column) -> Column:
    """Divide by the peak plus a small guard."""
    y = _doubles(y)
    return let(_peak(y) + F.lit(GUARD), lambda k: F.transform(y, lambda v: v / k))


def power(y: Column) -> Column:
    """Mean square of the samples."""
    total = F.aggregate(_doubles(y), F.lit(0.0), lambda acc, v: acc + v * v)
    return F.try_divide(total, F.size(y))


def mix_snr(clean: Column, noise: Column, snr_db: Column) -> Column:
    """Add noise of equal length so that the signal-to-noise ratio is ``snr_db``."""
    ratio = F.pow(F.lit(10.0), snr_db / 10.0)
    scale = F.sqrt(F.try_divide(power(clean), ratio * power(noise)))
    return let(scale, lambda k: F.zip_with(_doubles(clean), _doubles(noise), lambda c, n: c + n * k))


def hash_number(key: Column, salt: str = "") -> Column:
    """A number fixed by the key alone, whatever the partitioning."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")


def match_length(noise: Column, length: Column, key: Column) -> Column:
    """Noise cut to ``length`` from an offset fixed by ``key``, or repeated and cut when shorter."""
    have = F.size(noise)
    offset = F.pmod(hash_number(key, "offset"), F.greatest(have - length + 1, F.lit(1)))
    times = F.ceil(F.try_divide(length, have)).cast("int")
    tiled = F.slice(F.flatten(F.array_repeat(noise, times)), F.lit(1), length)
    return F.when(have >= length, F.slice(noise, (offset + 1).cast("int"), length)).otherwise(tiled)


def duration(y: Column, sr: Column) -> Column:
    """Seconds with three decimals; an unknown rate gives 0."""
    return F.round(F.when(sr > 0, F.size(y) / sr).otherwise(F.lit(0.0)), 3)


def gaussian_noise(key: Column, y: Column, level: float = 0.01) -> Column:
    """Add normal noise drawn from a generator seeded by ``key``."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def noisy(seeds: pd.Series, clips: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if clip is None else clip + np.random.default_rng(int(seed)).normal(0.0, level, len(clip))
                for seed, clip in zip(seeds, clips)
            ]
        )

    return noisy(hash_number(key, "noise"), _doubles(y))
