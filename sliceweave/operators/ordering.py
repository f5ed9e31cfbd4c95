"""Ordered work inside groups that survives a group of any size.

A window gives each group to one task. ``Sequence`` keeps that plan while every
group is small; a group above the limit is cut into value ranges, each range is
windowed on its own, and one small total per range is carried forward.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.session import broadcast_rows, hot_rows, materialize

SPLIT = "_split"


def _columns(names: Seq[str]) -> list[Column]:
    return [F.col(f"`{name}`") for name in names]


def match_groups(left: DataFrame, right: DataFrame, keys: Seq[str], how: str = "inner") -> DataFrame:
    """Join on group keys where NULL is a group like any other."""
    named = right.select(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(keys)],
                         *[F.col(f"`{c}`") for c in right.columns if c not in keys])
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return left.join(named, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def broadcast_checked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Broadcast only after counting; a larger side keeps the shuffle join."""
    limit = broadcast_rows(df.sparkSession) if limit is None else limit
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_groups(df: DataFrame, keys: Seq[str], limit: int | None = None, check: DataFrame | None = None) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None. At most rows/limit of them exist.

    ``check`` is a cheaper frame with at least as many rows; when it has the
    keys, its groups must be at least as large as those of ``df``.
    """
    limit = hot_rows(df.sparkSession) if limit is None else limit
    probe = df if check is None else check
    if probe.count() <= limit:
        return None
    counted = (probe if set(keys) <= set(probe.columns) else df).select(*_columns(keys))
    hot = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > limit)
    hot = materialize(hot)
    return None if hot.isEmpty() else hot


def top_k(df: DataFrame, keys: Seq[str], order: Seq[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group; every map task keeps k per group before the shuffle."""
    window = Window.partitionBy(*_columns(keys)).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def first_per_group(df: DataFrame, keys: Seq[str], order: Column, largest: bool = False) -> DataFrame:
    """One row per group by a unique order value, as a map-side combined aggregate."""
    payload = [name for name in df.columns if name not in keys]
    pick = F.max_by if largest else F.min_by
    kinds = [field.dataType for field in df.select(*_columns(payload), order).schema]
    if all(isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) for kind in kinds):
        # Plain values in the buffer need no sort before the aggregate; every column sees the same order values, so all come from one row.
        return df.groupBy(*_columns(keys)).agg(*[pick(F.col(f"`{name}`"), order).alias(name) for name in payload])
    best = df.groupBy(*_columns(keys)).agg(pick(F.struct(*_columns(payload)), order).alias("_best"))
    return best.select(*_columns(keys), *[F.col(f"_best.`{name}`").alias(name) for name in payload])


class Sequence:
    """Rows of ``df`` ordered by ``order`` inside ``keys``; the order must be total.

    ``check`` may name a cheaper frame whose groups are at least as large, so
    that the size check does not run the plan behind ``df`` a second time.
    ``hot`` takes the answer of ``hot_groups`` where several sequences share it.
    """

    def __init__(self, df: DataFrame, keys: Seq[str], order: Seq[Column], check: DataFrame | None = None,
                 limit: int | None = None, hot: DataFrame | None | bool = False):
        self._whole = not keys
        if self._whole:
            df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
            check = None if check is None else check.withColumn("_all", F.lit(0))
        self.keys, self.order = list(keys), list(order)
        limit = hot_rows(df.sparkSession) if limit is None else limit
        hot = hot_groups(df, self.keys, limit, check) if hot is False else hot
        self.split = hot is not None
        if self.split:
            total = hot.agg(F.sum("_rows")).first()[0]
            parts = max(2, -(-2 * total // limit))
            hot_keys = F.broadcast(hot.select(*_columns(self.keys)))
            cold = match_groups(df, hot_keys, self.keys, "left_anti").withColumn(SPLIT, F.lit(0))
            ranged = (
                match_groups(df, hot_keys, self.keys, "left_semi")
                .repartitionByRange(int(parts), *_columns(self.keys), *self.order)
                .withColumn(SPLIT, F.spark_partition_id() + 1)
            )
            df = cold.unionByName(materialize(ranged))
        self.rows = df

    @property
    def df(self) -> DataFrame:
        return self.rows.drop(SPLIT, "_all") if self._whole else self.rows.drop(SPLIT)

    def _parts(self) -> list[Column]:
        return _columns(self.keys) + ([F.col(SPLIT)] if self.split else [])

    def _window(self):
        return Window.partitionBy(*self._parts()).orderBy(*self.order)

    def _carry(self, rows: DataFrame, value: Column, position: Column, forward: bool, fold) -> DataFrame:
        """Per split its closing value, folded over the splits before (or after) it."""
        pick = F.max_by if forward else F.min_by
        totals = (
            rows.where(F.col(SPLIT) > 0).groupBy(*_columns(self.keys), SPLIT)
            .agg(pick(F.struct(value.alias("v")), position).alias("_closing"))
        )
        order = F.col(SPLIT).asc() if forward else F.col(SPLIT).desc()
        over = Window.partitionBy(*_columns(self.keys)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        # One row per split of a hot key, a few times rows/limit at most.
        return F.broadcast(totals.select(*_columns(self.keys), SPLIT, fold(F.col("_closing"), over).alias("_carry")))

    def size(self, name: str = "n") -> "Sequence":
        """Rows of the group beside each row."""
        if not self.split:
            self.rows = self.rows.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*_columns(self.keys))))
            return self
        sizes = self.rows.groupBy(*_columns(self.keys)).agg(F.count(F.lit(1)).alias(name))
        self.rows = match_groups(self.rows, sizes, self.keys)
        return self

    def row_number(self, name: str = "rn") -> "Sequence":
        return self.running(name, "sum", F.lit(1))

    def running(self, name: str, kind: str, value: Column, reverse: bool = False) -> "Sequence":
        """Inclusive running ``sum``, ``min``, ``max`` or ``last`` non-null value.

        ``reverse`` runs from the end; ``last`` then means the next non-null value.
        """
        window, rows = self._window(), self.rows
        # Frames grow from their start only. Backwards, the rows are numbered and
        # walked in descending order, since a frame that shrinks costs a rescan per row.
        if reverse or self.split:
            rows = rows.withColumn("_at", F.row_number().over(window))
        if reverse:
            window = Window.partitionBy(*self._parts()).orderBy(F.col("_at").desc())
        frame = window.rowsBetween(Window.unboundedPreceding, 0)
        local = {
            "sum": lambda: F.sum(value).over(frame),
            "min": lambda: F.min(value).over(frame),
            "max": lambda: F.max(value).over(frame),
            "last": lambda: F.last(value, ignorenulls=True).over(frame),
        }[kind]()
        if not self.split:
            self.rows = rows.withColumn(name, local).drop("_at")
            return self
        rows = rows.withColumn("_local", local)
        closing = {
            "sum": lambda c, w: F.sum(c["v"]).over(w),
            "min": lambda c, w: F.min(c["v"]).over(w),
            "max": lambda c, w: F.max(c["v"]).over(w),
            "last": lambda c, w: F.last(c["v"], ignorenulls=True).over(w),
        }[kind]
        carry = self._carry(rows, F.col("_local"), F.col("_at"), not reverse, closing)
        both = {
            "sum": F.coalesce(F.col("_local") + F.col("_carry"), F.col("_local"), F.col("_carry")),
            "min": F.least("_local", "_carry"),
            "max": F.greatest("_local", "_carry"),
            "last": F.coalesce("_local", "_carry"),
        }[kind]
        joined = match_groups(rows, carry, [*self.keys, SPLIT], "left").withColumn(name, both)
        self.rows = joined.drop("_local", "_carry", "_at")
        return self

    def neighbour(self, name: str, value: Column, ahead: bool = False) -> "Sequence":
        """Value of the previous (or next) row, NULL at the edge of the group."""
        window = self._window()
        step = F.lead if ahead else F.lag
        if not self.split:
            self.rows = self.rows.withColumn(name, step(value).over(window))
            return self
        rows = self.rows.withColumn("_local", step(F.struct(value.alias("v"))).over(window))
        rows = rows.withColumn("_at", F.row_number().over(window)).withColumn("_value", value)
        carry = self._carry(rows, F.col("_value"), F.col("_at"), not ahead, lambda c, w: F.last(c).over(w))
        joined = match_groups(rows, carry, [*self.keys, SPLIT], "left")
        self.rows = joined.withColumn(name, F.coalesce("_local", "_carry")["v"]).drop("_local", "_carry", "_at", "_value")
        return self


def group_summary(df: DataFrame, keys: Seq[str], quantiles: Mapping[str, Mapping[str, float]], aggregates: Seq[Column] = (),
                  check: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Aggregates and exact, linearly interpolated quantiles (column to name to level) per group.

    One aggregate while groups are small. The exact quantile of a large group
    comes from its counted distinct values and their running count instead.
    """
    if not keys:
        one = group_summary(df.withColumn("_all", F.lit(0)), ["_all"], quantiles, aggregates,
                            None if check is None else check.withColumn("_all", F.lit(0)), limit)
        return one.drop("_all")
    if hot_groups(df, keys, limit, check) is None:
        exact = [F.percentile(column, q).alias(name) for column, levels in quantiles.items() for name, q in levels.items()]
        return df.groupBy(*_columns(keys)).agg(*aggregates, *exact)
    df = materialize(df)
    result = df.groupBy(*_columns(keys)).agg(*(aggregates or [F.count(F.lit(1)).alias("_rows")]))
    for column, levels in quantiles.items():
        result = match_groups(result, _counted_quantiles(df, keys, column, levels, limit), keys, "left")
    return result if aggregates else result.drop("_rows")


def group_quantiles(df: DataFrame, keys: Seq[str], value: str, quantiles: Mapping[str, float],
                    check: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    return group_summary(df, keys, {value: quantiles}, check=check, limit=limit)


def _counted_quantiles(df: DataFrame, keys: Seq[str], value: str, quantiles: Mapping[str, float], limit: int | None) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(*_columns(keys), value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = Sequence(counts, keys, [F.col(value)], limit=limit).running("_upto", "sum", F.col("_n")).df
    sizes = counts.groupBy(*_columns(keys)).agg(F.sum("_n").alias("_total"))
    ranked = match_groups(ranked, sizes, keys)

    def at(rank: Column) -> Column:
        inside = (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
        return F.max(F.when(inside, F.col(value)))

    parts, out = [], []
    for name, q in quantiles.items():
        position = F.lit(float(q)) * (F.col("_total") - 1)
        parts += [at(F.floor(position)).alias(f"{name}_lo"), at(F.ceil(position)).alias(f"{name}_hi"),
                  F.max(position - F.floor(position)).alias(f"{name}_f")]
        low, high, part = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_f")
        out.append(((1 - part) * low + part * high).alias(name))
    return ranked.groupBy(*_columns(keys)).agg(*parts).select(*_columns(keys), *out)
