"""Session settings and the few session-wide decisions the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "earshot", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    On a cluster the folder has to be named. Only a local master gets a
    temporary one, which is then kept in the session for later callers.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.earshot.shared.dir", None)
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # "local-cluster" has executors of its own
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="earshot-")
    spark.conf.set("spark.earshot.shared.dir", folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def via_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, and lets
    several consumers read one result instead of computing it again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Give a CPU-heavy stage at least one partition per core.

    For plans without a shuffle, whose partitions are known before they run.
    A large table already has more splits than cores and is returned as it
    is; only a file with fewer splits than cores is shuffled by ``keys``.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores * 2, *keys)


def salted_join(big: DataFrame, small: DataFrame, key: str, spread_by: list[str],
                how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``big`` to ``small`` (unique on ``key``) when ``big`` may hold hot keys.

    The rows of one key are dealt to ``salts`` tasks by a hash of the
    ``spread_by`` columns, which a re-run task reproduces, and each row of
    ``small`` is given once per salt, by a product with the salts: Spark sizes the rows of a product, those of
    ``explode`` it would size as none and broadcast. When ``small`` turns out to be small at
    run time, adaptive execution switches to a broadcast by its measured size.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.crossJoin(F.broadcast(small.sparkSession.range(0, salts, 1, 1).select(F.col("id").cast("int").alias("_salt"))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


# A written lookup table is broadcast when it has no more rows than this.
BROADCAST_ROWS = 500_000


def written_lookup(small: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """A computed lookup written to the shared folder, and whether it is small enough to broadcast.

    It is computed once that way, and its size is counted instead of guessed.
    """
    table = via_table(small, "lookup")
    return table, table.count() <= limit
