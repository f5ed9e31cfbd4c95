"""Windows over ordered rows: neighbours, groups of three, moving means and picks per key."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.labels import finite
from sliceweave.operators.ordering import Sequence, group_summary, top_k


def adjacent_triples(ordered: DataFrame) -> DataFrame:
    """Index before and after each row of an ordered group; the edges repeat themselves."""
    return ordered.withColumn("prev_idx", F.greatest(F.col("idx") - 1, F.lit(0))).withColumn(
        "next_idx", F.least(F.col("idx") + 1, F.col("n") - 1))


def needed_slices(triples: DataFrame, keys: Seq[str]) -> DataFrame:
    """Distinct slices shared by overlapping windows."""
    return triples.select(*keys, F.explode(F.array("prev_idx", "idx", "next_idx")).alias("idx")).distinct()


def groups_of_three(ordered: DataFrame, keys: Seq[str], position: str) -> DataFrame:
    """Non-overlapping groups of three; a short last group repeats its final index, its centre uses real members."""
    grouped = ordered.withColumn("grp", F.floor(F.col("idx") / 3)).groupBy(*keys, "grp").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.col(position).cast("double"))).alias("_members"))
    return grouped.select(*keys, "grp", F.transform(F.array(*map(F.lit, range(3))), lambda i: F.least(F.col("first_idx") + i, F.col("last_idx"))).alias("indices"),
                          (F.aggregate("_members", F.lit(0.0), lambda a, x: a + x) / F.size("_members")).alias("centre"))


def position_gaps(slices: DataFrame, keys: Seq[str], position: str, check: DataFrame | None = None) -> DataFrame:
    """Gap between consecutive distinct positions."""
    distinct = slices.select(*keys, position).distinct()
    seq = Sequence(distinct, keys, [F.col(position)], check=check).neighbour("_before", F.col(position))
    return seq.df.where(F.col("_before").isNotNull()).select(*keys, position, (F.col(position) - F.col("_before")).alias("gap"))


def trimmed(ordered: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Rows inside the index range low..high of their group, never fewer than one."""
    first = F.floor(F.col("n") * low)
    last = F.greatest(first, F.floor(F.col("n") * high) - 1)
    return ordered.where(F.col("idx").between(first, last))


def moving_mean(df: DataFrame, keys: Seq[str], order: Seq[Column], value: str, width: int, check: DataFrame | None = None) -> DataFrame:
    """Mean of the last ``width`` rows where the frame is full.

    Built on running sums and positions, so a long series is not one task. The sums are exact to twenty decimals, as
    far as a double reaches for values from 10^-4 on.
    """
    seq = Sequence(df, keys, order, check=check).row_number("_rn").running("_sum", "sum", F.col(value).cast("decimal(38,20)"))
    rows = seq.df
    earlier = rows.select(*keys, (F.col("_rn") + width).alias("_rn"), F.col("_sum").alias("_base"))
    full = rows.where(F.col("_rn") >= width).join(earlier, [*keys, "_rn"], "left")
    total = (F.col("_sum") - F.coalesce("_base", F.lit(0))).cast("double")
    return full.withColumn("moving_mean", total / width).withColumn("step", F.col("_rn")).drop("_rn", "_sum", "_base")


def top_epochs(history: DataFrame, run: Seq[str], metric: str, k: int = 3) -> DataFrame:
    """Best k epochs per run; ties keep the earlier epoch, non-finite values drop out."""
    good = history.withColumn(metric, finite(F.col(metric))).where(F.col(metric).isNotNull())
    return top_k(good, run, [F.col(metric).desc(), F.col("epoch").asc()], k)


def best_epoch(history: DataFrame, run: Seq[str], metric: str) -> DataFrame:
    """First epoch that reaches the best value of each run."""
    value = finite(F.col(metric))
    best = F.max_by(F.struct("epoch", F.col(metric).alias("value")), F.when(value.isNotNull(), F.struct(value, -F.col("epoch"))))
    return history.groupBy(*run).agg(best.alias("_b")).select(*run, F.col("_b.epoch").alias("epoch"), F.col("_b.value").alias(metric))


def latest(df: DataFrame, key: str, ordinal: Column, columns: Seq[str]) -> DataFrame:
    """Last row per key by a unique ordinal, combined on the map side."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), ordinal).alias("_last")).select(key, *[F.col(f"_last.{c}").alias(c) for c in columns])


def largest_disagreements(df: DataFrame, delta: Column, keys: Seq[str], tie: Seq[str], k: int) -> DataFrame:
    """Rows with the largest absolute difference per key."""
    rows = df.withColumn("delta", delta).where(F.col("delta").isNotNull())
    return top_k(rows, keys, [F.abs("delta").desc(), *[F.col(c).asc() for c in tie]], k)


def average_ranks(df: DataFrame, keys: Seq[str], value: str, check: DataFrame | None = None) -> DataFrame:
    """Average rank of each distinct value inside its group, with its row count."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("ties"))
    seq = Sequence(counts, keys, [F.col(value)], check=check).running("_upto", "sum", F.col("ties"))
    return seq.df.select(*keys, value, "ties", (F.col("_upto") - (F.col("ties") - 1) / 2).alias("average_rank"))


def offset_report(offsets: DataFrame, slot: str, columns: Seq[str], changed: str, check: DataFrame | None = None) -> DataFrame:
    """Offset quantiles and changed share per slot and overall (slot NULL)."""
    levels = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    both = offsets.select(F.explode(F.array(F.col(slot), F.lit(None))).alias(slot), *columns, changed)
    doubled = None if check is None else check.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("_copy"))
    report = group_summary(both, [slot], {c: {f"{c}_{name}": q for name, q in levels.items()} for c in columns},
                           [F.count(F.lit(1)).alias("windows"), F.sum(changed).alias("changed_windows")], check=doubled)
    return report.withColumn("changed_fraction", F.col("changed_windows") / F.col("windows"))


def cumulative_share(counts: DataFrame, order: Seq[Column], value: str) -> DataFrame:
    """Running share of ``value`` over the whole table in the given total order."""
    total = counts.agg(F.sum(value)).scalar()
    rows = Sequence(counts, [], order).running("_upto", "sum", F.col(value)).df
    return rows.withColumn("cumulative_share", F.col("_upto") / total).drop("_upto")

