import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.operators import guards, heads


def table(spark, count=400, seed=4, parts=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(count, 5)) * [1, 3, 0.2, 1, 1] + [0, 5, 0, 0, 0]
    x[:, 4] = 2.5  # no deviation
    rows = []
    for i in range(count):
        p = 1 / (1 + np.exp(-(x[i, 0] - 0.4 * x[i, 1] + 2)))
        values = [float(np.clip(p + rng.normal() * 0.2, 0.01, 0.99)), None if i % 3 else float(rng.integers(0, 2)), 0.5 if i % 2 else 0.9, None]
        rows.append((i, x[i].tolist(), *values))
    return spark.createDataFrame(rows, "uid int, features array<double>, a double, b double, one double, none double").repartition(parts)


def separate(df, target, weight):
    value = L.col(target)
    train = df.where(L.usable(value)).select(
        array_to_vector("features").alias("x"), L.positive(value).cast("double").alias("label"),
        (L.confidence(value) * F.when(L.positive(value), weight).otherwise(1.0)).alias("w"))
    model = LogisticRegression(featuresCol="x", weightCol="w", maxIter=500, tol=1e-14, regParam=0.01).fit(train)
    return model.coefficients.toArray(), model.intercept


def test_joint_heads_equal_separate_fits(spark):
    df = table(spark)
    got = heads.fit_joint(df, ["a", "b", "one", "none"])
    sums = {t: df.agg(F.sum(F.when(L.positive(L.col(t)), L.confidence(L.col(t))).otherwise(0.0)), F.sum(F.when(L.negative(L.col(t)), L.confidence(L.col(t))).otherwise(0.0))).first() for t in "ab"}
    for i, t in enumerate("ab"):
        coefficients, intercept = separate(df, t, min(max(sums[t][1] / max(sums[t][0], 1.0), 1.0), 10.0))
        assert np.allclose(got.coefficients[i], coefficients, atol=1e-6) and abs(got.intercepts[i] - intercept) < 1e-6
        assert got.coefficients[i][4] == 0
    assert np.isposinf(got.intercepts[2]) and list(got.usable) == [True, True, True, False] and got.passes <= 12
    odd = spark.createDataFrame([(1, None), (2, [1.0]), (3, [1.0, None, 0.0, 0.0, 0.0]), (4, [0.0] * 5)], "uid int, features array<double>")
    scores = {r["uid"]: r for r in heads.score_joint(odd, got, "uid").collect()}
    assert [scores[u]["a"] for u in (1, 2, 3)] == [None] * 3 and 0 < scores[4]["a"] < 1 and scores[4]["one"] == 1.0 and scores[4]["none"] is None


def test_passes_do_not_depend_on_partitions_or_rows_left_out(spark):
    df = table(spark)
    plain = heads.fit_joint(df, ["a", "b"])
    more = df.unionByName(spark.createDataFrame([(900, None, 0.9, 0.9, 0.9, None), (901, [1.0, None, 0.0, 0.0, 0.0], 0.9, 0.1, 0.9, None), (902, [float("nan")] + [0.0] * 4, 0.9, 0.1, 0.9, None)], df.schema))
    other = heads.fit_joint(more.repartition(2), ["a", "b"])
    assert np.allclose(plain.coefficients, other.coefficients, atol=1e-9) and plain.passes == other.passes


def test_joint_heads_refuse(spark):
    df = table(spark, 40)
    with pytest.raises(guards.ContractError):
        heads.fit_joint(df.limit(0), ["a"])
    with pytest.raises(guards.ContractError):
        heads.fit_joint(df, ["a"], iterations=1)
    uneven = df.unionByName(spark.createDataFrame([(900, [1.0], 0.9, 0.9, 0.9, None)], df.schema))
    with pytest.raises(Exception, match="different lengths"):
        heads.fit_joint(uneven, ["a"])
