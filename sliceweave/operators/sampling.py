"""Reproducible samples and quotas. Order comes from a digest of the seed and the row key,
so a sample does not depend on partitioning, row order or the number of workers."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.labels import col, strict_gold
from sliceweave.functions.text import report_group, seeded
from sliceweave.operators.guards import ContractError, enforce_empty
from sliceweave.operators.ordering import Sequence, first_per_group, group_quantiles, hot_groups, top_k
from sliceweave.schemas import SLOT_WEIGHTS
from sliceweave.session import hot_rows, materialize

#: Windows of a group that one array may hold, and windows that one task may group.
SMALL_GROUP, TASK_ROWS = 1000, 500_000


def sample_studies(eligible: DataFrame, key: str, limit: int, seed) -> DataFrame:
    """First ``limit`` rows in seeded order (0 = all); too few rows is an error."""
    if limit == 0:
        return eligible
    if eligible.limit(limit).count() < limit:
        raise ContractError(f"fewer than {limit} eligible studies")
    return eligible.orderBy(seeded(seed, F.col(key)), F.col(key)).limit(limit)


def sample_windows(windows: DataFrame, study: str, group: str, item: Seq[str], count: int, seed, epoch: int = 0) -> DataFrame:
    """``count`` windows per study: one per group first, then the rest, then repeats when short.

    Both steps are top-k per group, so no study is ordered as a whole. A study with more groups than ``count`` is an
    error, since one of them would go without a window; ``crowded_studies`` lists them.
    """
    enforce_empty(crowded_studies(windows, study, group, count), f"studies with more than {count} groups")
    order = seeded(f"{seed}|{epoch}", F.col(study), *[F.col(c) for c in item])
    tie = [F.col(c).asc() for c in item]
    rows = windows.withColumn("_h", order)
    inside = top_k(rows, [study, group], [F.col("_h").asc(), *tie], count, "_in")
    first = F.when(F.col("_in") == 1, 0).otherwise(1)
    chosen = top_k(inside, [study], [first.asc(), F.col("_h").asc(), *tie], count, "draw")
    chosen = materialize(chosen.select(study, "draw", group, *[c for c in item if c != group]))  # read four times below
    held = chosen.groupBy(study).agg(F.max("draw").alias("_held"))
    chosen = chosen.join(held, study)
    # Fewer windows than asked for: every further draw picks one of those held.
    missing = F.when(F.col("_held") < count, F.sequence(F.col("_held") + 1, F.lit(count))).otherwise(F.array().cast("array<int>"))
    short = chosen.where((F.col("draw") == 1) & (F.col("_held") < count)).select(study, "_held", F.explode(missing).alias("draw"))
    pick = F.conv(F.substring(seeded(f"{seed}|{epoch}|extra", F.col(study), F.col("draw")), 1, 12), 16, 10).cast("long") % F.col("_held") + 1
    extra = short.withColumn("_pick", pick).join(
        chosen.select(study, F.col("draw").alias("_pick"), group, *[c for c in item if c != group]), [study, "_pick"])
    columns = [study, "draw", group, *[c for c in item if c != group]]
    return chosen.select(*columns).unionByName(extra.select(*columns))


def crowded_studies(windows: DataFrame, study: str, group: str, count: int) -> DataFrame:
    """Studies with more groups than draws."""
    groups = windows.select(study, group).distinct().groupBy(study).agg(F.count(F.lit(1)).alias("groups"))
    return groups.where(F.col("groups") > count)


def slot_quotas(capacities: DataFrame, study: str, slot: str, capacity: str, count: int, weight: Column, proportional: bool = False) -> DataFrame:
    """Splits a budget over the slots of a study by weight, at least one and at most its capacity each.

    Handing one unit at a time to the largest deficit is the same as sorting
    all further units of a study by their deficit; a slot has at most ``count``.
    """
    totals = capacities.groupBy(study).agg(
        F.count(F.lit(1)).alias("_slots"), F.sum(capacity).alias("_room"), F.sum(weight.cast("double")).alias("_weights"))
    rows = capacities.join(totals, study)
    goal = F.least(F.lit(count), F.col("_room"))
    ideal = (weight / F.col("_weights") * goal) if proportional else (goal * weight / F.col("_weights"))
    rows = rows.withColumn("_goal", goal).withColumn("_ideal", ideal)
    units = rows.withColumn("_unit", F.explode(F.sequence(F.lit(1), F.least(F.col(capacity), F.lit(count)).cast("int"))))
    further = units.where("_unit > 1").withColumn("_deficit", F.col("_ideal") - (F.col("_unit") - 1))
    given = top_k(further, [study], [F.col("_deficit").desc(), F.col(slot).asc(), F.col("_unit").asc()], count, "_order")
    given = given.where(F.col("_order") <= F.col("_goal") - F.col("_slots")).groupBy(study, slot).agg(F.count(F.lit(1)).alias("_more"))
    return rows.join(given, [study, slot], "left").select(study, slot, capacity, (1 + F.coalesce("_more", F.lit(0))).alias("quota"))


def slot_weight(slot: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in SLOT_WEIGHTS]), slot.cast("int") + 1)


def distinct_anchors(windows: DataFrame, study: str, slot: str, anchor: str, order: Column) -> DataFrame:
    """First window of every anchor inside a slot."""
    return first_per_group(windows, [study, slot, anchor], order)


def round_robin(capacities: DataFrame, slot: Seq[str], series: str, capacity: str, budget: int) -> DataFrame:
    """Windows per series when series take turns until the budget or their slices run out.

    A slot with more series than budget is an error, since a series would go without a window; ``overfull_slots`` lists them.
    """
    enforce_empty(overfull_slots(capacities, slot, budget), f"slots with more than {budget} series")
    units = capacities.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.least(F.col(capacity), F.lit(budget)).cast("int"))))
    taken = top_k(units, slot, [F.col("_turn").asc(), F.col(series).asc()], budget, "_order")
    return taken.groupBy(*slot, series).agg(F.count(F.lit(1)).alias("windows"))


def overfull_slots(capacities: DataFrame, slot: Seq[str], budget: int) -> DataFrame:
    """Slots that hold more series than the budget can serve."""
    return capacities.groupBy(*slot).agg(F.count(F.lit(1)).alias("series")).where(F.col("series") > budget)


def proportional_subset(windows: DataFrame, study: str, slot: str, order: Seq[Column], limit: int, check: DataFrame | None = None) -> DataFrame:
    """Deterministic subset of ``limit`` windows per study: proportional slot quotas, cell midpoints inside a slot."""
    counts = windows.groupBy(study, slot).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(study).agg(F.sum("_n").alias("_all"))
    quotas = slot_quotas(counts, study, slot, "_n", limit, F.col("_n"), proportional=True).join(totals, study)
    quotas = quotas.withColumn("quota", F.when(F.col("_all") <= limit, F.col("_n")).otherwise(F.col("quota")))
    points = quotas.where(F.col("_all") > limit).select(
        study, slot, F.explode(F.transform(F.sequence(F.lit(0), (F.col("quota") - 1).cast("int")),
                                           lambda j: F.floor((j + 0.5) * F.col("_n") / F.col("quota")))).alias("_at"))
    ranked = Sequence(windows, [study, slot], order, check=check).row_number("_rn").df.withColumn("_at", F.col("_rn") - 1)
    whole = ranked.join(quotas.where(F.col("_all") <= limit).select(study, slot), [study, slot], "left_semi")
    part = ranked.join(points, [study, slot, "_at"], "left_semi")
    return part.select(*windows.columns).unionByName(whole.select(*windows.columns))


def stratified_by_depth(windows: DataFrame, keys: Seq[str], position: str, item: str, quota: int | str, seed, most: int | None = None,
                        check: DataFrame | None = None) -> DataFrame:
    """``quota`` windows per group, one per equal-width depth bin; empty bins take the nearest unused window.

    ``quota`` is a number or a column that is constant in its group and at most ``most``.
    Only the windows at the rim of a bin (at most ``most`` from either end) can fill an empty bin. Where all positions
    are equal, the bins are parts of equal count in item order instead. A group of few windows is shuffled once and
    stratified as one array; a larger one is cut down to its bins' rims first. ``check`` may name a cheaper frame
    whose groups are at least as large.
    """
    most = quota if most is None else most
    large = hot_groups(windows, keys, _small(windows), check)
    rows = (windows if check is None else check).count()
    return _stratified(windows, keys, position, item, quota, seed, most, large, rows)


def _small(df: DataFrame) -> int:
    return min(SMALL_GROUP, hot_rows(df.sparkSession))


def _stratified(windows: DataFrame, keys: Seq[str], position: str, item: str, quota: int | str, seed, most: int, large: DataFrame | None, rows: int) -> DataFrame:
    """``stratified_by_depth`` of ``rows`` windows; ``large`` holds the keys of the groups that no array should hold."""
    if large is None:
        return _in_arrays(windows, keys, position, item, quota, seed, most, rows)
    large = large.select(*keys)
    few = _in_arrays(windows.join(large, list(keys), "left_anti"), keys, position, item, quota, seed, most, rows)
    return few.unionByName(_by_rims(windows.join(large, list(keys), "left_semi"), keys, position, item, quota, seed, most))


def _filled(held: DataFrame, keys: Seq[str], position: str, item: str) -> DataFrame:
    """The ``_taken`` windows of a group, and for each bin without one the nearest unused window of its ``_pool``."""
    filled = F.transform("_taken", lambda e: e["bin"])
    empty = F.filter(F.sequence(F.lit(0), F.col("_q") - 1), lambda i: ~F.array_contains(filled, i))

    def fill(chosen, bucket):
        centre = F.col("_lo") + (bucket + 0.5) * (F.col("_hi") - F.col("_lo")) / F.col("_q")
        rest = F.filter("_pool", lambda e: ~F.exists(chosen, lambda c: c["item"] == e["item"]))
        nearest = F.array_min(F.transform(rest, lambda e: F.struct(F.abs(e["pos"] - centre).alias("d"), e.alias("e"))))["e"]
        return F.concat(chosen, F.array_compact(F.array(nearest)))

    return held.select(*keys, F.explode(F.aggregate(empty, F.col("_taken"), fill)).alias("_e")).select(
        *keys, F.col("_e.item").alias(item), F.col("_e.pos").alias(position))


def _in_arrays(windows: DataFrame, keys: Seq[str], position: str, item: str, quota: int | str, seed, most: int, rows: int) -> DataFrame:
    """One array per group, which holds at most ``SMALL_GROUP`` windows."""
    given = F.lit(quota) if isinstance(quota, int) else F.col(quota)
    parts = max(int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_ROWS + 1)
    dealt = windows.dropna(subset=list(keys)).select(*keys, position, item, given.cast("int").alias("_given")).repartition(parts, *keys)
    entry = F.struct(F.col(item).alias("item"), F.col(position).alias("pos"))
    whole = dealt.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_all"), F.min(position).alias("_lo"), F.max(position).alias("_hi"),
                                     F.max("_given").alias("_q")).where(F.col("_lo").isNotNull())
    inner = F.filter(F.sequence(F.lit(0), F.col("_q") - 1), lambda i: i > 0)
    edges = F.transform(inner, lambda i: i * ((F.col("_hi") - F.col("_lo")) / F.col("_q")) + F.col("_lo"))

    def placed(e, i):
        part = F.floor(i * F.col("_q") / F.size("_all")).cast("int")
        place = F.when(F.col("_lo") == F.col("_hi"), part).otherwise(F.size(F.filter(edges, lambda edge: edge <= e["pos"])))
        return F.struct(seeded(seed, *[F.col(k) for k in keys], e["item"]).alias("h"), e["item"].alias("item"), e["pos"].alias("pos"), place.alias("bin"))

    held = whole.select(*keys, "_lo", "_hi", "_q", F.transform("_all", placed).alias("_rows"))
    bins = F.sequence(F.lit(0), F.col("_q") - 1)
    inside = lambda b: F.filter("_rows", lambda e: e["bin"] == b)
    first = lambda b, *order: F.transform(F.slice(F.array_sort(F.transform(
        inside(b), lambda e: F.struct(*[o(e).alias(f"o{i}") for i, o in enumerate(order)], e["item"].alias("item"), e.alias("e")))), 1, most + 1), lambda x: x["e"])
    rim = lambda b: F.concat(first(b, lambda e: e["pos"]), first(b, lambda e: e["pos"].isNull(), lambda e: -e["pos"]))
    pool = F.when(F.size("_rows") <= most + 1, F.col("_rows")).otherwise(F.flatten(F.transform(bins, rim)))
    taken = F.array_compact(F.transform(bins, lambda b: F.array_min(inside(b))))
    return _filled(held.select(*keys, "_lo", "_hi", "_q", taken.alias("_taken"), F.array_distinct(pool).alias("_pool")), keys, position, item)


def _by_rims(windows: DataFrame, keys: Seq[str], position: str, item: str, quota: int | str, seed, most: int) -> DataFrame:
    """Bins choose by digest on the map side, so a group is down to a few hundred rows before the fill runs."""
    given = F.lit(quota) if isinstance(quota, int) else F.col(quota)
    span = windows.groupBy(*keys).agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"), F.max(given).cast("int").alias("_q"))
    rows = windows.join(span, list(keys)).withColumn("_h", seeded(seed, *[F.col(k) for k in keys], F.col(item)))
    width = (F.col("_hi") - F.col("_lo")) / F.col("_q")
    inner = F.filter(F.sequence(F.lit(0), F.col("_q") - 1), lambda i: i > 0)
    edges = F.transform(inner, lambda i: i * width + F.col("_lo"))
    rows = rows.withColumn("_bin", F.size(F.filter(edges, lambda e: e <= F.col(position))))
    level = Sequence(rows.where(F.col("_lo") == F.col("_hi")), list(keys), [F.col(item)]).row_number("_nth").size("_size").df
    part = F.floor((F.col("_nth") - 1) * F.col("_q") / F.col("_size")).cast("int")
    level = level.withColumn("_bin", part).drop("_nth", "_size")
    rows = rows.where(F.col("_lo") != F.col("_hi")).unionByName(level)
    best = top_k(rows, [*keys, "_bin"], [F.col("_h"), F.col(item)], 1, "_r").drop("_r").withColumn("_picked", F.lit(True))
    low = top_k(rows, [*keys, "_bin"], [F.col(position).asc(), F.col(item)], most + 1, "_r").drop("_r")
    high = top_k(rows, [*keys, "_bin"], [F.col(position).desc(), F.col(item)], most + 1, "_r").drop("_r")
    columns = [*keys, position, item, "_bin", "_h", "_lo", "_hi", "_q"]
    marked = lambda df, picked: df.select(*columns, F.lit(picked).alias("_picked"))
    pool = marked(low, 0).unionByName(marked(high, 0)).unionByName(marked(best, 1))
    pool = pool.groupBy(*columns).agg(F.max("_picked").alias("_picked"))
    entry = F.struct(F.col("_h").alias("h"), F.col(item).alias("item"), F.col(position).alias("pos"), F.col("_bin").alias("bin"), F.col("_picked").alias("picked"))
    held = pool.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_pool"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"), F.first("_q").alias("_q"))
    held = held.withColumn("_taken", F.filter("_pool", lambda e: e["picked"] == 1))
    return _filled(held, keys, position, item)


def sample_by_depth(windows: DataFrame, study: str, slot: str, position: str, anchor: str, order: Column, count: int, seed) -> DataFrame:
    """``count`` windows per study: distinct anchors, weighted slot quotas, then depth strata inside each slot.

    A study with fewer anchors than ``count`` repeats some; the repeats go to the slots
    furthest below their share, whose capacity no longer matters.
    """
    narrow = windows.select(study, slot, anchor, position, order.alias("_order"))
    distinct = materialize(distinct_anchors(narrow, study, slot, anchor, F.col("_order")).drop("_order"))
    capacities = distinct.groupBy(study, slot).agg(F.count(F.lit(1)).alias("_cap"))
    quotas = slot_quotas(capacities, study, slot, "_cap", count, slot_weight(F.col(slot)))
    quotas = materialize(quotas.select(study, slot, "_cap", "quota").dropna(subset=[study, slot]))
    rows = distinct.join(quotas, [study, slot])
    capacities = quotas.select(study, slot, "_cap")
    large = quotas.where(F.col("_cap") > _small(windows)).select(study, slot)
    picks = _stratified(rows, [study, slot], position, anchor, "quota", seed, count, None if large.isEmpty() else large, distinct.count())
    totals = capacities.groupBy(study).agg(F.sum("_cap").alias("_held"), F.sum(slot_weight(F.col(slot))).alias("_weights")).where(F.col("_held") < count)
    short = capacities.join(totals, study)
    units = short.withColumn("_unit", F.explode(F.sequence(F.col("_cap") + 1, F.lit(count).cast("long"))))
    units = units.withColumn("_deficit", count * slot_weight(F.col(slot)) / F.col("_weights") - (F.col("_unit") - 1))
    extra = top_k(units, [study], [F.col("_deficit").desc(), F.col(slot).asc(), F.col("_unit").asc()], count, "_o").where(F.col("_o") <= count - F.col("_held"))
    pick = F.conv(F.substring(seeded(f"{seed}|extra", F.col(study), F.col(slot), F.col("_unit")), 1, 12), 16, 10).cast("long") % F.col("_cap") + 1
    ranked = top_k(rows.join(totals.select(study), study, "left_semi"), [study, slot], [F.col(position), F.col(anchor)], count, "_pick")
    repeats = extra.withColumn("_pick", pick).join(ranked.select(study, slot, "_pick", anchor, position), [study, slot, "_pick"])
    return picks.select(study, slot, anchor, position).unionByName(repeats.select(study, slot, anchor, position))


def cover_examples(rows: DataFrame, key: str, text: str, targets: Seq[str], count: int, seed) -> DataFrame:
    """Greedy examples that cover every (label, value) pair; positives count double, texts never repeat.

    Rows with the same labels score the same, so only the first few distinct
    texts of each label pattern can ever be chosen. Those (patterns x count
    rows, a bound set by the label list) are what the greedy loop looks at.
    """
    # Only 0 and 1 are gold; a soft label is none.
    gold = rows.withColumn("_gold", strict_gold([col(t) for t in targets])).where(F.col("_gold").isNotNull())
    gold = gold.withColumn("_pattern", F.array_join(F.transform("_gold", lambda v: v.cast("string")), ""))
    gold = gold.withColumn("_group", report_group(col(text))).withColumn("_h", seeded(seed, col(key)))
    per_text = first_per_group(gold.select(key, "_pattern", "_group", "_h"), ["_pattern", "_group"], F.struct("_h", key))
    shelf = top_k(per_text, ["_pattern"], [F.col("_h").asc(), F.col(key).asc()], count, "_r").orderBy("_h", key).collect()
    chosen, covered, used = [], set(), set()
    for _ in range(count):
        best, score = None, -1
        for row in shelf:
            pairs = {(i, v) for i, v in enumerate(row["_pattern"])}
            value = sum(2 if v == "1" else 1 for i, v in pairs - covered)
            if row["_group"] not in used and value > score:
                best, score = row, value
        if best is None:
            raise ContractError(f"fewer than {count} different texts have gold labels for all targets")
        chosen.append((best[key], len(chosen) + 1, score))
        covered |= {(i, v) for i, v in enumerate(best["_pattern"])}
        used.add(best["_group"])
    kind = rows.schema[key].dataType.simpleString()
    picks = rows.sparkSession.createDataFrame(chosen, f"{key} {kind}, example int, gain int")
    return rows.join(F.broadcast(picks), key)


def audit_sample(rows: DataFrame, key: str, strata: Seq[str], length: str, tiles: int, per_stratum: int, seed,
                 high_risk: Column, high_risk_count: int) -> DataFrame:
    """Sample by language and length band, plus rows with high-risk wording; overlaps count once.

    Length bands are cut at exact quantiles per stratum, so no window runs over a stratum.
    """
    cuts = {f"_q{i}": i / tiles for i in range(1, tiles)}
    bounds = group_quantiles(rows.select(*strata, length), strata, length, cuts)
    banded = rows.join(bounds, list(strata))
    band = sum((F.when(F.col(length) > F.col(name), 1).otherwise(0) for name in cuts), F.lit(0))
    banded = banded.withColumn("length_band", band).withColumn("_h", seeded(seed, F.col(key)))
    regular = top_k(banded, [*strata, "length_band"], [F.col("_h"), F.col(key)], per_stratum, "_r")
    risky = banded.where(high_risk).orderBy("_h", key).limit(high_risk_count)
    columns = [key, *strata, "length_band"]
    both = regular.select(*columns, F.lit(1).alias("_s"), F.lit(0).alias("_k")).unionByName(
        risky.select(*columns, F.lit(0).alias("_s"), F.lit(1).alias("_k")))
    return both.groupBy(*columns).agg(F.max("_s").alias("stratified"), F.max("_k").alias("high_risk"))


def canonical_order(windows: DataFrame, study: str) -> DataFrame:
    return windows.orderBy(study, "slot", "position", "idx")


def representative_case(rows: DataFrame, accept: Column, order: Seq[Column]) -> DataFrame:
    """First accepted row in the given total order."""
    return rows.where(accept).orderBy(*order).limit(1)

