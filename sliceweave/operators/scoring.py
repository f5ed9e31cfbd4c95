"""Linear heads on frozen features and pluggable batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import labels as L


def fit_heads(features: DataFrame, targets: Sequence[str], vector: str = "features", iterations: int = 20,
              regularisation: float = 0.01) -> dict[str, LogisticRegressionModel]:
    """One weighted linear head per label; missing and neutral labels have no weight.

    The row weight is the confidence, times the label's clipped positive weight for positives.
    """
    ready = features.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    sums = ready.agg(*[F.sum(F.when(L.positive(L.col(t)), L.confidence(L.col(t))).otherwise(0.0)).alias(f"p{i}") for i, t in enumerate(targets)],
                     *[F.sum(F.when(L.negative(L.col(t)), L.confidence(L.col(t))).otherwise(0.0)).alias(f"n{i}") for i, t in enumerate(targets)]).first()
    heads = {}
    for i, target in enumerate(targets):
        value = L.col(target)
        weight = min(max(sums[f"n{i}"] / max(sums[f"p{i}"], 1.0), 1.0), 10.0)
        train = ready.where(L.usable(value)).select(
            "_x", L.positive(value).cast("double").alias("label"),
            (L.confidence(value) * F.when(L.positive(value), weight).otherwise(1.0)).alias("weight"))
        heads[target] = LogisticRegression(featuresCol="_x", weightCol="weight", maxIter=iterations, regParam=regularisation).fit(train)
    return heads


def score_heads(features: DataFrame, heads: dict[str, LogisticRegressionModel], key: str, vector: str = "features") -> DataFrame:
    """Probability per label, JVM-side."""
    scored = features.withColumn("_x", array_to_vector(F.col(vector).cast("array<double>")))
    columns = [key]
    for i, (target, model) in enumerate(heads.items()):
        model = model.setProbabilityCol(f"_p{i}").setRawPredictionCol(f"_r{i}").setPredictionCol(f"_y{i}").setFeaturesCol("_x")
        scored = model.transform(scored)
        columns.append(vector_to_array(f"_p{i}")[1].alias(target))
    return scored.select(*columns)


def score_batches(rows: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs a user scorer over Arrow batches; it sees a bounded batch and never the whole table."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield scorer(batch)
    return rows.mapInPandas(run, schema)


def scored_report(rows: DataFrame, scores: DataFrame, key: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """One row of counts that must all be zero: keys scored twice, not at all, or unasked, and values that are no score."""
    asked = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_asked"))
    bad = ~F.coalesce(F.col(value).between(low, high) & ~F.isnan(value), F.lit(False))
    given = scores.groupBy(key).agg(F.count(F.lit(1)).alias("_given"), F.count_if(bad).alias("_bad"))
    both = asked.join(given, key, "full")
    return both.agg(F.count_if(F.col("_given") > F.coalesce("_asked", F.lit(0))).alias("scored_too_often"), F.count_if(F.col("_given").isNull()).alias("not_scored"),
                    F.count_if(F.col("_asked").isNull()).alias("unasked"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("bad_scores"))
