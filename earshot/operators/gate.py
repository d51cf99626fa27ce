"""The gate: features of a proposed correction, models that judge it, and the filter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.text import let
from earshot.operators.spans import words_of
from earshot.schemas import FEATURE_NAMES

LABEL = "should_correct"
THRESHOLD = 0.55

# Words that make a span a phrase around a term rather than a mis-heard term.
STOPWORDS = ["taking", "take", "is", "are", "was", "were", "keep", "continue", "needs"]


def features(span: Column, semantic: Column, fuzzy: Column, phonetic: Column) -> Column:
    """The six features of a proposed correction of ``span``."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return let(
        words_of(span),
        lambda ws: F.struct(
            semantic.alias("semantic_score"),
            fuzzy.alias("fuzzy_score"),
            phonetic.alias("phonetic_score"),
            F.size(ws).alias("word_count"),
            F.arrays_overlap(ws, stop).cast("int").alias("contains_stopword"),
            span.rlike(r"(?U)\d").cast("int").alias("contains_digit"),
        ),
    )


@dataclass(frozen=True)
class Coefficients:
    """A fitted logistic gate as plain numbers, scored without leaving the JVM."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float

    def probability(self, record: Column) -> Column:
        z = F.lit(self.intercept)
        for name, m, s, w in zip(FEATURE_NAMES, self.mean, self.scale, self.weight):
            z = z + (record[name] - F.lit(m)) / F.lit(s) * F.lit(w)
        return 1 / (1 + F.exp(-z))


# The optimum of the balanced, L2-regularised fit on the published 16 training
# rows; tests repeat the fit with Spark and compare.
DEFAULT = Coefficients(
    mean=(0.85125, 0.758125, 0.90125, 1.875, 0.3125, 0.0),
    scale=(
        0.09123287510541361, 0.21372349981927585, 0.08320719620321308,
        0.9270248108869579, 0.46351240544347894, 1.0,
    ),
    weight=(
        -0.4182715375920176, -1.253696010823795, 0.25857958676957377,
        -0.2710131429413091, -1.0735008013800647, 0.0,
    ),
    intercept=-0.29193683859259145,
)


def _balanced(training: DataFrame) -> tuple[DataFrame, int]:
    """Rows weighted so that each class counts alike, and the number of rows."""
    counts = training.groupBy(LABEL).agg(F.count(F.lit(1)).alias("_class"))
    sizes = counts.agg(F.sum("_class").alias("n"), F.count(F.lit(1)).alias("classes")).first()
    weighted = training.join(F.broadcast(counts), LABEL).withColumn(
        "_weight", F.lit(float(sizes["n"])) / (F.lit(sizes["classes"]) * F.col("_class"))
    )
    return weighted, sizes["n"]


def fit_logistic(training: DataFrame) -> PipelineModel:
    """Standardised features, balanced classes, unit L2 penalty.

    The scaler divides by the sample deviation; the product after it turns
    that into the population deviation. The penalty is stated per row, hence 1/n.
    """
    weighted, n = _balanced(training)
    population = (n / (n - 1)) ** 0.5
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
            ElementwiseProduct(
                inputCol="_scaled", outputCol="_features", scalingVec=Vectors.dense([population] * len(FEATURE_NAMES))
            ),
            LogisticRegression(
                featuresCol="_features", labelCol=LABEL, weightCol="_weight",
                regParam=1.0 / n, standardization=False, maxIter=1000, tol=1e-12,
            ),
        ]
    ).fit(weighted)


def fit_trees(training: DataFrame, seed: int = 42, rounds: int = 100) -> PipelineModel:
    """Gradient-boosted trees on the same features."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURE_NAMES), outputCol="_features"),
            GBTClassifier(
                featuresCol="_features", labelCol=LABEL, maxIter=rounds, stepSize=0.1, maxDepth=3, seed=seed
            ),
        ]
    ).fit(training)


def coefficients(model: PipelineModel) -> Coefficients:
    """The numbers of a fitted logistic gate."""
    scaler, product, logistic = model.stages[1], model.stages[2], model.stages[3]
    # A constant feature has no deviation; its weight is zero and any scale will do.
    scale = [s / p if s else 1.0 for s, p in zip(scaler.std, product.getScalingVec())]
    return Coefficients(tuple(scaler.mean), tuple(scale), tuple(logistic.coefficients), float(logistic.intercept))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_proba(model: PipelineModel, df: DataFrame, record: str = "features") -> DataFrame:
    """Add ``gate_probability`` by a fitted model; ``record`` holds the six features."""
    kept = df.columns
    flat = df.withColumns({name: F.col(f"{record}.{name}") for name in FEATURE_NAMES})
    scored = model.transform(flat)
    return scored.select(*kept, vector_to_array("probability")[1].alias("gate_probability"))


def gate_filter(
    df: DataFrame, gate: Coefficients | PipelineModel = DEFAULT, threshold: float = THRESHOLD, record: str = "features"
) -> DataFrame:
    """Keep the proposals the gate takes for correct, with their probability."""
    if isinstance(gate, Coefficients):
        scored = df.withColumn("gate_probability", gate.probability(F.col(record)))
    else:
        scored = predict_proba(gate, df, record)
    return scored.where(F.col("gate_probability") >= threshold)
