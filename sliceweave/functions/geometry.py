"""Slice geometry over array columns: orientation[6], position[3], spacing[2]."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Elements are read with ``get``, which is NULL past the end, and unrolled, so
# the arithmetic stays inside generated code.

def all_finite(values: Column, size: int) -> Column:
    """The first ``size`` elements exist and are finite: zero times each of them is zero."""
    zeros = reduce(lambda a, b: a + b, [F.get(values, F.lit(i)) * 0.0 for i in range(size)])
    return F.coalesce(zeros == 0.0, F.lit(False))


def cross(orientation: Column) -> list[Column]:
    """Cross product of the row and column directions."""
    a = [F.get(orientation, F.lit(i)) for i in range(6)]
    return [a[1] * a[5] - a[2] * a[4], a[2] * a[3] - a[0] * a[5], a[0] * a[4] - a[1] * a[3]]


def dot(left: Column, right: Column) -> Column:
    part = lambda i: F.get(left, F.lit(i)) * F.get(right, F.lit(i))
    return part(0) + part(1) + part(2)


def _length(vector: list[Column]) -> Column:
    return F.sqrt(F.pow(vector[0], F.lit(2)) + F.pow(vector[1], F.lit(2)) + F.pow(vector[2], F.lit(2)))


def valid_geometry(orientation: Column, position: Column) -> Column:
    """Right sizes, finite values and a normal of usable length."""
    shape = (F.size(orientation) == 6) & (F.size(position) == 3)
    sound = shape & all_finite(orientation, 6) & all_finite(position, 3) & (_length(cross(orientation)) >= 1e-6)
    return F.coalesce(sound, F.lit(False))


def with_normal(df: DataFrame, orientation: str, name: str) -> DataFrame:
    """Adds the unit normal of the slice; its elements are NULL for a degenerate orientation.

    Built in steps, so each product is computed once per row.
    """
    staged = df.withColumn("_cross", F.array(*cross(F.col(orientation))))
    staged = staged.withColumn("_norm", _length([F.get("_cross", F.lit(i)) for i in range(3)]))
    size = F.when(F.col("_norm") > 0, F.col("_norm"))
    return staged.withColumn(name, F.array(*[F.get("_cross", F.lit(i)) / size for i in range(3)])).drop("_cross", "_norm")


def dominant_sign(normal: Column) -> Column:
    """-1 when the largest component of the normal (first on ties) is negative, else 1."""
    part = [F.get(normal, F.lit(i)) for i in range(3)]
    size = [F.abs(p) for p in part]
    lead = (F.when((size[0] >= size[1]) & (size[0] >= size[2]), part[0])
            .when(size[1] >= size[2], part[1]).otherwise(part[2]))
    return F.when(lead < 0, -1.0).otherwise(1.0)


def valid_spacing(spacing: Column) -> Column:
    """First two spacing values when both are finite and positive, else NULL."""
    pair = [F.get(spacing, F.lit(i)) for i in range(2)]
    return F.when(all_finite(spacing, 2) & (pair[0] > 0) & (pair[1] > 0), F.array(*pair))


def contrast(te: Column, tr: Column, fat_suppression: Column) -> Column:
    """Contrast class from echo and repetition time; suppressed fat wins."""
    te, tr = F.coalesce(te, F.lit(0.0)), F.coalesce(tr, F.lit(0.0))
    return (F.when(fat_suppression == 1, "PD/T2")
            .when((te <= 0) | (tr <= 0), "unknown")
            .when((tr < 1000) & (te < 30), "T1")
            .when(te < 60, "PD")
            .otherwise("T2"))


def contrast_flags(kind: Column) -> list[Column]:
    """Indicators for T1, PD, T2 and unknown; suppressed fat sets PD and T2."""
    return [(kind == "T1").cast("double"), kind.isin("PD", "PD/T2").cast("double"),
            kind.isin("T2", "PD/T2").cast("double"), (kind == "unknown").cast("double")]


def feature_vector(fluid: Column, fat: Column, te: Column, tr: Column, mean_pixel_spacing: Column,
                   slice_spacing: Column, coverage: Column) -> Column:
    """Eleven scaled numbers of a series, in fixed order."""
    te, tr = F.coalesce(te, F.lit(0.0)), F.coalesce(tr, F.lit(0.0))
    zero = lambda value: F.coalesce(value.cast("double"), F.lit(0.0))
    return F.array(zero(fluid), zero(fat), *contrast_flags(contrast(te, tr, fat)), te / 100, tr / 5000,
                   mean_pixel_spacing, zero(slice_spacing) / 10, zero(coverage) / 200)


def depth(position: Column, first: Column, last: Column) -> Column:
    """Position scaled to [-1, 1]; 0 in a flat series."""
    return F.when(last > first, 2 * (position - first) / (last - first) - 1).otherwise(0.0)
