"""Nearest-position matches inside a group, without pairing rows of the group."""

from __future__ import annotations

from collections.abc import Sequence as Seq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.operators.guards import enforce_empty
from sliceweave.operators.ordering import Sequence, hot_groups, match_groups
from sliceweave.session import hot_rows

TOLERANCE_MM = 1e-4
#: Rows of whole groups that are searched together in one call.
BUCKET_ROWS = 250_000


def evenly_spaced(ordered: DataFrame, keys: Seq[str], position: str, count: int) -> DataFrame:
    """Row nearest to each of ``count`` evenly spaced targets per group; ties take the lower row.

    ``ordered`` carries ``idx`` in spatial order. Each row falls in one cell
    between two targets. A cell keeps its lowest and highest row, so a group
    shrinks to ``count`` rows before anything is compared.
    """
    span = ordered.groupBy(*keys).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / (count - 1) if count > 1 else F.lit(0.0)

    def target(i: Column) -> Column:
        if count == 1:
            return F.col("_lo")
        return F.when(i >= count - 1, F.col("_hi")).otherwise(i * step + F.col("_lo"))

    guess = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(position) - F.col("_lo")) / step)).otherwise(0).cast("int") if count > 1 else F.lit(0)
    rows = ordered.join(span, list(keys)).withColumn("_cell", F.least(F.greatest(guess, F.lit(0)), F.lit(count - 1)))
    # The division may round across a boundary; compare with the targets themselves.
    down, up = F.col(position) < target(F.col("_cell")), (F.col("_cell") < count - 1) & (F.col(position) >= target(F.col("_cell") + 1))
    rows = rows.withColumn("_cell", F.when(down, F.col("_cell") - 1).when(up, F.col("_cell") + 1).otherwise(F.col("_cell")))
    low, high = F.struct(F.col(position).alias("pos"), F.col("idx").alias("idx")), F.struct(F.col(position).alias("pos"), (-F.col("idx")).alias("back"))
    # (pos, -idx) makes the lowest of equal positions the largest entry.
    cells = rows.groupBy(*keys, "_cell").agg(F.min(low).alias("low"), F.max(high).alias("high"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    packed = cells.groupBy(*keys).agg(F.collect_list(F.struct(F.col("_cell").alias("cell"), "low", "high")).alias("_cells"),
                                      F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    each = packed.withColumn("j", F.explode(F.array(*[F.lit(i) for i in range(count)])))
    each = each.withColumn("target", target(F.col("j")))
    before = F.array_max(F.transform(F.filter("_cells", lambda c: c["cell"] < F.col("j")), lambda c: c["high"]))
    after = F.array_min(F.transform(F.filter("_cells", lambda c: c["cell"] >= F.col("j")), lambda c: c["low"]))
    each = each.withColumn("_before", before).withColumn("_after", after)
    take_before = F.col("_after").isNull() | (
        F.abs(F.col("_before.pos") - F.col("target")) <= F.abs(F.col("_after.pos") - F.col("target")))
    use_before = F.coalesce(take_before, F.lit(False)) & F.col("_before").isNotNull()
    return each.select(*keys, "j", "target", F.when(use_before, -F.col("_before.back")).otherwise(F.col("_after.idx")).alias("idx"))


def physical_neighbours(ordered: DataFrame, keys: Seq[str], position: str, distance_mm: float,
                        check: DataFrame | None = None) -> DataFrame:
    """For each row the rows nearest to position -d and +d, with their positions.

    Errors within 1e-4 tie; ties go to the row closer to the anchor, then to the
    nearer index, then to the lower index. Either the anchor itself is within
    tolerance of the best error and wins, or every tied row lies on the asked
    side and the one next to the anchor wins.

    Whole groups are dealt into buckets of bounded size, once and with three
    columns beside the keys, and searched there. A group above the limit is
    ordered in value ranges instead.
    """
    # Each row of a split group brings two probes, so a group counts as hot at a third of the limit.
    limit = max(1, hot_rows(ordered.sparkSession) // 3)
    hot = hot_groups(ordered, keys, limit, check)
    buckets = (ordered if check is None else check).count() // BUCKET_ROWS + 1
    if hot is None:
        return _search_buckets(ordered, keys, position, distance_mm, buckets)
    hot_keys = F.broadcast(hot.select(*keys))
    cold = _search_buckets(match_groups(ordered, hot_keys, keys, "left_anti"), keys, position, distance_mm, buckets)
    return cold.unionByName(_search_ranges(match_groups(ordered, hot_keys, keys, "left_semi"), keys, position, distance_mm, hot, limit))


def _search_buckets(ordered: DataFrame, keys: Seq[str], position: str, distance_mm: float, buckets: int) -> DataFrame:
    """``physical_neighbours`` of groups that each fit into one bucket."""
    rows = ordered.select(*keys, F.col("idx").cast("long").alias("idx"), F.col(position).cast("double").alias(position))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)))
    kinds = [("prev_idx", T.LongType()), ("next_idx", T.LongType()), ("prev_pos", T.DoubleType()), ("next_pos", T.DoubleType())]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, kind) for name, kind in kinds]])

    def run(bucket: pa.Table) -> pa.Table:
        return _nearest_in(bucket, list(keys), position, distance_mm)

    return dealt.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(run, schema)


def _nearest_in(bucket: pa.Table, keys: Seq[str], position: str, distance_mm: float) -> pa.Table:
    """Binary search of both targets of every row among the distinct positions of its group, all rows in step."""
    group = np.zeros(len(bucket), np.int64)
    for key in keys:
        codes = pc.dictionary_encode(bucket[key].combine_chunks(), null_encoding="encode").indices.to_numpy()
        group = np.unique(group * (len(bucket) + 1) + codes, return_inverse=True)[1]
    z, idx = bucket[position].to_numpy(), bucket["idx"].to_numpy()
    real = np.flatnonzero(np.isfinite(z))
    order = real[np.lexsort((idx[real], z[real], group[real]))]
    group, own, row = group[order], z[order], idx[order]
    new = np.ones(len(order), bool)
    new[1:] = (group[1:] != group[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    pos, low, high, owner = own[first], row[first], row[np.append(first[1:], len(order)) - 1], group[first]
    begin, end = np.searchsorted(owner, group, "left"), np.searchsorted(owner, group, "right")

    def after(target: np.ndarray) -> np.ndarray:
        """First position of the group behind the target."""
        lower, upper = begin.copy(), end.copy()
        while (open_ := lower < upper).any():
            middle = (lower + upper) // 2
            passed = open_ & (pos[np.minimum(middle, len(pos) - 1)] <= target)
            lower, upper = np.where(passed, middle + 1, lower), np.where(open_ & ~passed, middle, upper)
        return lower

    out = bucket.select([*keys, "idx", position])
    # Without a number there is no distance: null has no neighbours, other such positions have themselves.
    found = {}
    for side, name in ((-1, "prev"), (1, "next")):
        target = own + side * distance_mm
        error = lambda at: np.where((at >= begin) & (at < end), np.abs(pos[np.clip(at, 0, len(pos) - 1)] - target), np.inf)
        at = after(target)
        reach = np.minimum(error(at - 1), error(at)) + TOLERANCE_MM
        rim = after(target - side * reach)
        best = np.full(len(order), -1)
        for step in ((1, 0, -1, -2) if side > 0 else (-2, -1, 0, 1)):  # the last one within reach is next to the anchor
            best = np.where(error(rim + step) <= reach, rim + step, best)
        alone, none = np.abs(own - target) <= reach, best < 0
        for part, values, mine, edge in (("idx", idx, row, high if side < 0 else low), ("pos", z, own, pos)):
            filled, missing = values.copy(), bucket[position].is_null().to_numpy().copy()
            if len(order):
                filled[order] = np.where(alone, mine, edge[best])
                missing[order] = ~alone & none
            found[f"{name}_{part}"] = pa.array(filled, mask=missing)
    for name in ("prev_idx", "next_idx", "prev_pos", "next_pos"):
        out = out.append_column(name, found[name])
    return out


def _search_ranges(ordered: DataFrame, keys: Seq[str], position: str, distance_mm: float, hot: DataFrame, limit: int) -> DataFrame:
    """``physical_neighbours`` of groups of any size.

    Positions and the two probes of every row form one ordered sequence. A
    first pass finds the best error of each probe; a second moves the probe to
    the rim of its tied positions. The positions around the rim are then tested
    with the exact error, from the anchor's side. Both passes keep the
    partitioning by key.
    """
    z, idx = F.col(position).cast("double"), F.col("idx").cast("long")
    bare = F.struct("pos", "lo", "hi")
    points = ordered.groupBy(*keys, z.alias("pos")).agg(F.min(idx).alias("lo"), F.max(idx).alias("hi"))
    points = Sequence(points, keys, [F.col("pos")], limit=limit, hot=hot).neighbour("before", bare).neighbour("after", bare, ahead=True).df
    kind = "struct<pos:double,lo:bigint,hi:bigint>"
    point_type = f"struct<pos:double,lo:bigint,hi:bigint,before:{kind},after:{kind}>"
    points = points.select(*keys, "pos", F.lit(0).alias("side"), F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("double").alias("z"),
                           F.struct("pos", "lo", "hi", "before", "after").alias("point"))
    probe = lambda side: F.struct((z + side * distance_mm).alias("pos"), F.lit(side).alias("side"), idx.alias("anchor"), z.alias("z"))
    probes = ordered.select(*keys, F.inline(F.array(probe(-1), probe(1)))).withColumn("point", F.lit(None).cast(point_type))
    # A probe follows the rows at its own position.
    seq = Sequence(points.unionByName(probes), keys, [F.col("pos"), F.col("side") != 0, F.col("side"), F.col("anchor")], limit=limit, hot=hot)
    near = seq.running("_below", "last", F.col("point")).running("_above", "last", F.col("point"), reverse=True).df
    error = lambda place: F.abs(place - F.col("target"))
    near = near.withColumn("target", F.col("pos")).withColumn(
        "reach", F.least(error(F.col("_below.pos")), error(F.col("_above.pos"))) + TOLERANCE_MM)
    rim = F.when(F.col("side") == 0, F.col("pos")).otherwise(F.col("target") - F.col("side") * F.col("reach"))
    moved = near.select(*keys, rim.alias("pos"), "side", "anchor", "z", "point", "target", "reach")
    seq = Sequence(moved, keys, [F.col("pos"), F.col("side") != 0, F.col("side"), F.col("anchor")], limit=limit, hot=hot)
    found = seq.running("_below", "last", F.col("point")).running("_above", "last", F.col("point"), reverse=True).df.where("side <> 0")
    flat = lambda name: F.struct(*[F.col(f"{name}.{part}").alias(part) for part in ("pos", "lo", "hi")])
    around = [F.col("_below.before"), flat("_below"), flat("_above"), F.col("_above.after")]
    tied = lambda order: F.filter(F.array(*order), lambda p: F.coalesce(error(p["pos"]) <= F.col("reach"), F.lit(False)))
    low, high = F.get(tied(around), F.lit(0)), F.get(tied(around[::-1]), F.lit(0))
    own = error(F.col("z")) <= F.col("reach")
    pick = (F.when(own, F.struct(F.col("z").alias("pos"), F.col("anchor").alias("idx")))
            .when(F.col("side") < 0, F.struct(high["pos"].alias("pos"), high["hi"].alias("idx")))
            .otherwise(F.struct(low["pos"].alias("pos"), low["lo"].alias("idx"))))
    both = found.groupBy(*keys, "anchor").agg(F.first("z").alias(position), F.max(F.when(F.col("side") < 0, pick)).alias("_prev"),
                                              F.max(F.when(F.col("side") > 0, pick)).alias("_next"))
    return both.select(*keys, F.col("anchor").alias("idx"), position, F.col("_prev.idx").alias("prev_idx"), F.col("_next.idx").alias("next_idx"),
                       F.col("_prev.pos").alias("prev_pos"), F.col("_next.pos").alias("next_pos"))


def short_groups(ordered: DataFrame, keys: Seq[str], count: int) -> DataFrame:
    """Groups with fewer than ``count`` rows, with their size."""
    return ordered.groupBy(*keys).agg(F.max("n").alias("rows")).where(F.col("rows") < count)


def unique_anchors(ordered: DataFrame, keys: Seq[str], position: str, count: int) -> DataFrame:
    """Strictly increasing distinct rows nearest to evenly spaced targets.

    Target i may only use rows after the previous pick and must leave enough
    rows for the rest, so each step depends on the one before. A pick is the
    row after the last pick, the first of the equal rows next to the target, or
    the first equal to the last allowed row; so it lies at most ``count`` rows
    behind one of a few base rows. Only those rows enter the fold. A group with fewer than ``count`` rows has no
    answer and is an error; ``short_groups`` lists them.
    """
    enforce_empty(short_groups(ordered, keys, count), f"groups with fewer than {count} rows")
    span = ordered.groupBy(*keys).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"), F.max("n").alias("_n"))
    flat = F.col("_hi") == F.col("_lo")
    step = (F.col("_hi") - F.col("_lo")) / max(count - 1, 1)

    def target(i: Column) -> Column:
        if count == 1:
            return (F.col("_lo") + F.col("_hi")) / 2
        return F.when(i >= count - 1, F.col("_hi")).otherwise(i * step + F.col("_lo"))

    groups = span
    even = F.lit(0) if count == 1 else F.rint(F.col("j") * (F.col("_n") - 1) / (count - 1)).cast("long")
    if count == 1:
        even = F.floor(F.col("_n") / 2)
    level = groups.where(flat).withColumn("j", F.explode(F.array(*map(F.lit, range(count)))))
    level = level.select(*keys, "j", even.cast("long").alias("idx"))

    starts = ordered.groupBy(*keys, position).agg(F.min("idx").alias("_start"))
    rows = ordered.join(groups.where(~flat), list(keys)).join(starts, [*keys, position])
    points = [target(F.lit(j)) for j in range(count)]
    bases = rows.groupBy(*keys).agg(
        *[F.count_if(F.col(position) < point).alias(f"_b{j}") for j, point in enumerate(points)],
        *[F.max(F.when(F.col(position) < point, F.struct(F.col(position), -F.col("idx")))).alias(f"_s{j}") for j, point in enumerate(points)],
        F.collect_list(F.when(F.col("idx") >= F.col("_n") - count, F.col("_start"))).alias("_ends"))
    own = F.array(F.lit(0).cast("long"), *[F.col(f"_b{j}") for j in range(count)],
                  *[F.coalesce(-F.col(f"_s{j}")["col2"], F.lit(0)).cast("long") for j in range(count)])
    bases = bases.select(*keys, F.array_distinct(F.concat(own, F.transform("_ends", lambda v: v.cast("long")))).alias("_bases"))
    near = rows.join(bases, list(keys)).where(F.exists("_bases", lambda b: F.col("idx").between(b, b + count)))
    shelf = near.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), F.col(position).alias("pos")))).alias("_shelf"),
        F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_n").alias("_n"))

    def choose(state: Column, i: Column) -> Column:
        lower = F.when(F.size(state) == 0, F.lit(0).cast("long")).otherwise(F.element_at(F.concat(F.array(F.lit(-1).cast("long")), state), -1) + 1)
        upper = F.col("_n") - (count - i)
        open_rows = F.filter("_shelf", lambda r: r["idx"].between(lower, upper))
        ranked = F.transform(open_rows, lambda r: F.struct(F.abs(r["pos"] - target(i)).alias("d"), r["idx"].alias("idx")))
        return F.concat(state, F.array(F.array_min(ranked)["idx"]))

    picks = F.aggregate(F.array(*map(F.lit, range(count))), F.array().cast("array<bigint>"), choose)
    spread = shelf.select(*keys, F.posexplode(picks).alias("j", "idx"))
    return level.unionByName(spread)
