"""Losses and exact ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.operators.ordering import Sequence


def masked_log_loss(cells: DataFrame, target: str, score: str, weights: DataFrame, groups: Seq[str] = ()) -> DataFrame:
    """Weighted log loss; ``weights`` has one pos_weight per target, so it is broadcast.

    Scores are kept a little away from 0 and 1.
    """
    y, p = L.finite(F.col(target)), F.least(F.greatest(F.col(score), F.lit(1e-7)), F.lit(1 - 1e-7))
    weight = L.confidence(F.col(target))
    loss = -(F.col("pos_weight") * y * F.log(p) + (1 - y) * F.log(1 - p))
    joined = cells.join(F.broadcast(weights.select("target", "pos_weight")), "target")
    total = F.sum(F.when(y.isNotNull(), loss * weight).otherwise(0.0)) / F.greatest(F.sum(weight), F.lit(1.0))
    return joined.groupBy(*groups).agg(total.alias("loss"))


def pair_wins(positives: Column, upto: Column, negatives: Column) -> Column:
    """Twice the pairs that the positives of one score win: all negatives below, and half of those level with them.

    Multiplied as decimals: the product of counts outgrows a long from some 10^9 rows with few distinct scores.
    """
    return positives.cast("decimal(19,0)") * (2 * (upto - negatives) + negatives).cast("decimal(19,0)")


def auc(cells: DataFrame, groups: Seq[str], target: str, score: str) -> DataFrame:
    """Exact ROC AUC per group with ties; NULL when a group has one class only.

    Equal scores are counted together first. The running count of negatives
    over the distinct scores is then split wherever one group is too large.
    """
    y = F.col(target)
    counted = cells.where(L.usable(y) & F.col(score).isNotNull()).groupBy(*groups, score).agg(
        F.count_if(L.positive(y)).alias("_p"), F.count_if(L.negative(y)).alias("_n"))
    ranked = Sequence(counted, groups, [F.col(score)]).running("_upto", "sum", F.col("_n")).df
    sums = ranked.groupBy(*groups).agg(F.sum("_p").alias("positive"), F.sum("_n").alias("negative"),
                                       F.sum(pair_wins(F.col("_p"), F.col("_upto"), F.col("_n"))).alias("_wins"))
    value = F.when((F.col("positive") > 0) & (F.col("negative") > 0),
                   F.col("_wins").cast("double") / (2.0 * F.col("positive").cast("double") * F.col("negative")))
    return sums.select(*groups, "positive", "negative", value.alias("auc"))


def macro_auc(per_label: DataFrame, groups: Seq[str] = ()) -> DataFrame:
    """Mean over labels that have an AUC."""
    return per_label.groupBy(*groups).agg(F.count("auc").alias("labels"), F.avg("auc").alias("macro_auc"))


def efficiency(runs: DataFrame, benchmark: float, limit_seconds: float = 32400.0) -> DataFrame:
    """Score to minimise: AUC over (benchmark - best AUC) plus the used share of the time limit."""
    best = runs.agg(F.max("auc")).scalar()
    score = F.col("auc") / (F.lit(benchmark) - best) + F.col("runtime_seconds") / limit_seconds
    return runs.withColumn("efficiency", F.round(score, 6))


def isolated(wide: DataFrame, targets: Seq[str]) -> Column:
    """Exactly one positive label."""
    return L.positives([L.col(t) for t in targets]) == 1
