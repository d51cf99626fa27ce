"""Approximate search of the nearest vectors: inverted cells, probed from the nearest on.

Cells are the clusters of at most ``SAMPLE`` vectors of unit length (those with the smallest hash of their id; Spark ML
k-means). Every vector is stored under its cell. A query looks through the vectors of its ``probes``
nearest cells only, so work falls by the share of cells that are not probed. How many that are is measured when the
index is written: the fewest for which queries among a bounded sample find ``RECALL`` of their exact neighbours there (among
more vectors neighbours are nearer, so the whole index finds no less). Scores of what it finds are exact dot
products; only vectors of other cells can be missed, and ``probes`` = the number of cells misses none.

A cell with many vectors is stored in parts of bounded size, which meet a query in different tasks, so a hot
cell is no hot task. Centres go to all tasks as one constant of ``cells`` x dimensions numbers, by default the root of the
number of vectors, and at most ``MAX_CELLS``. The index is two written tables, ``cells`` and ``vectors``, and is read back
from its folder alone. Null vectors are not indexed and queries without a vector find nothing. Zero
vectors have a cell like others and score 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.operators.retrieval import normalized

SAMPLE = 20_000
MAX_CELLS = 4096
# Vectors of one part of a cell, and queries that meet it in one product.
PART_ROWS, BLOCK_QUERIES = 4096, 8192
# Vectors on which the number of cells to probe is measured, and the queries and neighbours of that measurement.
MEASURED, MEASURED_QUERIES, NEIGHBOURS = 4096, 256, 5
RECALL = 0.95


@dataclass(frozen=True)
class VectorIndex:
    """A written index: ``vectors`` (term, cell, part, embedding) and ``cells`` (cell, centre, parts, probes)."""

    vectors: DataFrame
    cells: DataFrame
    term: str


def _cell_of(centres: np.ndarray, probes: int):
    """A column function: the ``probes`` cells whose centres are nearest to each vector, the nearest first."""

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_ordered_cells(centres, np.stack(vectors.to_numpy()))[:, :probes].astype(np.int32)))

    return nearest


def _ordered_cells(centres: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The cells of each row, the one with the nearest centre first."""
    return np.argsort((centres ** 2).sum(axis=1) - 2 * rows @ centres.T, axis=1, kind="stable")


def measured_probes(centres: np.ndarray, rows: np.ndarray, least: float = RECALL) -> int:
    """The fewest cells that hold ``least`` of the exact neighbours of the first rows among all rows."""
    if len(rows) < 2:
        return 1
    cell = _ordered_cells(centres, rows)[:, 0]
    queries = rows[:MEASURED_QUERIES]
    scores = queries @ rows.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf  # finding itself is no merit
    near = np.argsort(-scores, axis=1, kind="stable")[:, :min(NEIGHBOURS, len(rows) - 1)]
    place = np.argsort(_ordered_cells(centres, queries), axis=1)
    needed = np.sort(np.take_along_axis(place, cell[near], axis=1).ravel())
    return int(needed[math.ceil(least * len(needed)) - 1]) + 1


def write_vector_index(vectors: DataFrame, path: str, term: str = "term", cells: int | None = None, seed: int = 1) -> VectorIndex:
    """Fit the cells on a bounded sample and store every vector of ``term, embedding`` under its cell, below ``path``."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("embedding").isNotNull()).select(term, normalized(F.col("embedding").cast("array<double>")).alias("embedding"))
    n = rows.count()
    k = min(MAX_CELLS, cells or max(1, round(math.sqrt(n))))
    sample = rows.orderBy(F.xxhash64(term), term).limit(SAMPLE).select("embedding", array_to_vector("embedding").alias("features"))
    centres = np.stack(KMeans(k=k, seed=seed, maxIter=20).fit(sample).clusterCenters()) if n else np.zeros((0, 0))
    some = [r["embedding"] for r in sample.select("embedding").limit(MEASURED).collect()]
    probes = measured_probes(centres, np.array(some)) if n else 0
    told = rows.withColumn("cell", F.get(_cell_of(centres, 1)("embedding"), F.lit(0)) if n else F.lit(0))
    sizes = told.groupBy("cell").agg(F.count("*").alias("n"))
    parts = sizes.select("cell", F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int").alias("parts"))
    dealt = told.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(term), F.col("parts")).cast("int"))
    dealt.drop("parts").write.parquet(f"{path}/vectors")  # one row per cell is broadcast: at most MAX_CELLS
    table = spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)], "cell int, centre array<double>, probes int")
    counts = spark.read.parquet(f"{path}/vectors").groupBy("cell").agg((F.max("part") + 1).alias("parts"))
    table.join(counts, "cell", "left").select("cell", "centre", F.coalesce("parts", F.lit(0)).alias("parts"), "probes").write.parquet(f"{path}/cells")
    return read_vector_index(spark, path, term)


def read_vector_index(spark: SparkSession, path: str, term: str = "term") -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/cells"), term)


def approximate_topk(queries: DataFrame, index: VectorIndex, k: int = 5, probes: int | None = None, query: str = "query_id") -> DataFrame:
    """The ``k`` best terms by dot product that lie in the ``probes`` nearest cells of each query: ``query, term, semantic_score, place``.

    ``queries``: ``query, embedding``. By default as many cells are probed as the index was measured to need.
    """
    cells = index.cells.orderBy("cell").collect()  # at most MAX_CELLS rows
    term, schema = index.term, T.StructType([queries.schema[query], index.vectors.schema[index.term], T.StructField("semantic_score", T.DoubleType())])
    unit = queries.where(F.col("embedding").isNotNull()).select(query, normalized(F.col("embedding").cast("array<double>")).alias("q"))
    if not cells:
        return queries.sparkSession.createDataFrame([], schema).withColumn("place", F.lit(1))
    probes = min(len(cells), probes or cells[0]["probes"])
    centres = np.array([r["centre"] for r in cells])
    parts = F.array(*(F.lit(r["parts"]) for r in cells))
    near = unit.select(query, "q", F.explode(_cell_of(centres, probes)("q")).alias("cell"))
    blocks = 1 + unit.count() // BLOCK_QUERIES
    # Cells without a vector have no part and are not looked at.
    dealt = near.withColumn("parts", F.get(parts, F.col("cell"))).where(F.col("parts") > 0)
    left = dealt.select(query, "q", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                        F.pmod(F.xxhash64(query), F.lit(blocks)).cast("int").alias("block"))
    right = index.vectors.select(term, F.col("embedding").alias("t"), "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        b = b.sort_values(term, kind="stable")
        scores = np.stack(a["q"].to_numpy()) @ np.stack(b["t"].to_numpy()).T
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(a)), top.shape[1])
        return pd.DataFrame({query: a[query].to_numpy()[rows], term: b[term].to_numpy()[top.ravel()], "semantic_score": scores[rows, top.ravel()]})

    keys = ["cell", "part", "block"]
    local = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(product, schema)
    order = Window.partitionBy(query).orderBy(F.desc("semantic_score"), term)
    return local.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame, query: str = "query_id", term: str = "term") -> float:
    """The share of the exact nearest that were found."""
    both = exact.select(query, term).join(found.select(query, term).withColumn("hit", F.lit(1)), [query, term], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
