"""Wide label columns to long rows and back, in one pass and without a shuffle where possible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.labels import col


def to_long(df: DataFrame, targets: Sequence[str], sources: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns ``source__target`` to rows (keep..., target, source...)."""
    cells = F.array(*[
        F.struct(F.lit(target).alias("target"), *[col(f"{source}__{target}").alias(source) for source in sources])
        for target in targets])
    return df.select(*keep, F.inline(cells))


def melt(df: DataFrame, targets: Sequence[str], keep: Sequence[str], value: str = "value") -> DataFrame:
    """Label columns to rows (keep..., target, value)."""
    return df.unpivot([col(name) for name in keep], [col(name) for name in targets], "target", value)


def to_wide(df: DataFrame, keys: Sequence[str], targets: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Long rows to columns named ``target`` for the first value and ``target__value`` for the others."""
    picks = [F.max(F.when(F.col("target") == target, col(value))).alias(target if i == 0 else f"{target}__{value}")
             for i, value in enumerate(values) for target in targets]
    return df.groupBy(*keys).agg(*picks)
