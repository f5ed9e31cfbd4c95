"""Contracts: each guard is one lazy aggregate; ``enforce`` runs it before the main plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: how many rows break each rule."""
    return df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a partner in ``right``."""
    return left.join(right.select(*keys), list(keys), "left_anti")


def key_difference(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by one side only, with the side; empty means equal key sets.

    One shuffle: both sides are tagged, united and counted per key.
    """
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    sides = tagged.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return sides.where(F.col("_l") != F.col("_r")).select(
        *keys, F.when(F.col("_l") == 1, F.lit("left_only")).otherwise(F.lit("right_only")).alias("side"))


def contract_summary(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """One row: row count, surplus duplicate rows of ``key`` and the broken rules."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return per_key.agg(
        F.sum("_rows").alias("rows"),
        F.sum(F.col("_rows") - 1).alias("duplicate_rows"),
        F.sum(F.when(F.col(key).isNull() | (F.col(key).cast("string") == ""), F.col("_rows")).otherwise(0)).alias("empty_keys"),
        *[F.sum(name).alias(name) for name in rules])


def enforce(report: DataFrame, ignore: Sequence[str] = ("rows",)) -> None:
    """Raise when a one-row report holds a non-zero count."""
    row = report.first()
    broken = {name: row[name] for name in report.columns if name not in ignore and row[name]}
    if broken:
        raise ContractError(f"contract broken: {broken}")


def enforce_empty(df: DataFrame, message: str) -> None:
    sample = df.limit(3).collect()
    if sample:
        raise ContractError(f"{message}: {[row.asDict() for row in sample]}")


def require_columns(df: DataFrame, columns: Sequence[str], exact: bool = False) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing or (exact and list(df.columns) != list(columns)):
        raise ContractError(f"columns {df.columns} do not match {list(columns)}")
