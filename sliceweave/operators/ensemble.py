"""Fold and model predictions: checks, union, mean and submission order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.labels import col, finite
from sliceweave.operators import guards
from sliceweave.operators.reshape import to_wide


def prediction_report(predictions: DataFrame, key: str, targets: Sequence[str], fold: int | None = None) -> DataFrame:
    """One row of counts that must all be zero: duplicates, empty keys, foreign folds, bad values."""
    bad = reduce(lambda a, b: a | b, [~F.coalesce(finite(col(t)).between(0.0, 1.0), F.lit(False)) for t in targets])
    rules = {"bad_values": bad}
    if fold is not None:
        rules["other_fold"] = ~F.col("fold").eqNullSafe(F.lit(fold))
    return guards.contract_summary(predictions, key, rules)


def union_folds(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def checked_union(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union in which every key may occur once."""
    union = union_folds(parts)
    guards.enforce_empty(guards.duplicate_keys(union, keys), "key in more than one part")
    return union


def last_wins(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """One row per key: the one with the highest ordinal."""
    rest = [name for name in df.columns if name not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[col(n) for n in rest]), F.col(ordinal)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.`{n}`").alias(n) for n in rest])


def mean_probability(scores: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Double mean per key as FLOAT, with the source count and the bad values beside it."""
    v = F.col(value)
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sources"), F.count_if(~F.coalesce(finite(v).between(0.0, 1.0), F.lit(False))).alias("bad_values"),
        F.avg(v).cast("float").alias("mean"))


def enforce_mean(mean: DataFrame, sources: int) -> DataFrame:
    """The means, after checking that every key has exactly ``sources`` valid values."""
    wrong = mean.where((F.col("sources") != sources) | (F.col("bad_values") > 0))
    guards.enforce_empty(wrong, f"expected {sources} finite probabilities per key")
    return mean.drop("sources", "bad_values")


def submission(sample: DataFrame, long_scores: DataFrame, key: str, targets: Sequence[str], ordinal: str) -> DataFrame:
    """Predictions in sample order, one column per target; a study without one stays NULL for the guard."""
    wide = to_wide(long_scores, [key], targets, ["mean"])
    return sample.select(key, ordinal).join(wide, key, "left").orderBy(ordinal)
