"""Membership, orphan and alignment joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.text import report_group
from sliceweave.operators.ordering import broadcast_checked


def members(df: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """Rows whose key is on a membership list."""
    return df.join(membership.select(key), key, "left_semi")


def without_known_texts(rows: DataFrame, known: DataFrame, text: str = "report") -> DataFrame:
    """Rows whose normalised text equals no known text."""
    groups = known.select(report_group(F.col(text)).alias("_group")).distinct()
    return rows.withColumn("_group", report_group(F.col(text))).join(groups, "_group", "left_anti").drop("_group")


def pending(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Requests without a stored result."""
    return requests.join(results.select(key).distinct(), key, "left_anti")


def with_metadata(df: DataFrame, metadata: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Attach metadata: broadcast when its counted size allows, shuffled otherwise."""
    return df.join(broadcast_checked(metadata), key, how)


def with_split(report: DataFrame, membership: DataFrame, key: str) -> DataFrame:
    """Attach the split of each study to a report."""
    return report.join(membership.select(key, "split"), key, "left")


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))
