"""Ranked selection of series into ordered slots.

Planes do not compete for a series, and a plane has at most two slots, so a
slot needs only its first few candidates. They come from per-group top-k, which
keeps k rows per study in every map task, so no study is ever sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.operators.ordering import Sequence, top_k
from sliceweave.schemas import SLOTS

QUALITY = ["usable", "coverage_mm", "fov_mm", "pixel_spacing_mm", "slice_spacing_mm", "unique_slices"]


def slot_table(spark) -> DataFrame:
    return spark.createDataFrame([row[:3] for row in SLOTS], "slot int, plane string, preference int")


def best_by_flag(series: DataFrame, study: str, slot: Column) -> DataFrame:
    """One series per study and slot: flagged first, then most slices, then the lower ordinal."""
    keyed = series.where(F.col("num_slices") > 0).withColumn("slot", slot)
    order = F.struct(-F.coalesce("fluid", F.lit(-1)), -F.col("num_slices"), F.col("ordinal"))
    return keyed.groupBy(study, "slot").agg(F.min_by("series", order).alias("series"))


def _with_slots(series: DataFrame) -> DataFrame:
    """Every series beside each slot of its plane (two at most); the slot table has five rows."""
    rows = series.where(F.col("num_slices") > 0).join(F.broadcast(slot_table(series.sparkSession)), "plane")
    match = F.when(F.col("preference").isNull() | (F.col("fluid") == F.col("preference")), 1).otherwise(0)
    return rows.withColumn("match", match)


def quality_order(crop_mm: float, image_size: int) -> list[Column]:
    """Capped coverage and field, then resolution, spacing and slices; only usable series are compared."""
    usable = F.col("usable") == 1
    coverage = F.when(F.col("threshold") > 0, F.least(F.col("coverage_mm") / F.col("threshold"), F.lit(1.0))).otherwise(1.0)
    only = lambda value: F.when(usable, value)
    return [
        F.coalesce(usable, F.lit(False)).desc(),
        only(coverage).desc(),
        only(F.least(F.col("fov_mm") / crop_mm, F.lit(1.0))).desc(),
        only(F.greatest(F.col("pixel_spacing_mm"), F.lit(crop_mm / image_size))).asc(),
        only(F.col("slice_spacing_mm")).asc(),
        only(F.col("unique_slices")).desc(),
    ]


def _pick_first(rows: DataFrame, study: str, order: Seq[Column], payload: Seq[str]) -> DataFrame:
    """First candidate per slot; the second slot of a plane skips the series of the first."""
    ranked = top_k(rows, [study, "slot"], [F.col("match").desc(), *order, F.col("ordinal").asc()], 2)
    item = F.struct("rank", "series", *payload)
    held = ranked.groupBy(study, "plane").agg(
        *[F.max(F.when((F.col("slot") % 2 == parity) & (F.col("rank") == place), item)).alias(f"c{parity}{place}")
          for parity in (0, 1) for place in (1, 2)])
    same = F.col("c11.series") == F.col("c01.series")
    second = F.when(F.coalesce(same, F.lit(False)), F.col("c12")).otherwise(F.col("c11"))
    base = F.when(F.col("plane") == "Sagittal", 0).when(F.col("plane") == "Coronal", 2).otherwise(4)
    pair = F.array(F.struct(base.alias("slot"), F.col("c01").alias("pick")), F.struct((base + 1).alias("slot"), second.alias("pick")))
    slots = held.select(study, F.inline(pair)).where("slot < 5 AND pick IS NOT NULL")
    return slots.select(study, "slot", F.col("pick.series").alias("series"), *[F.col(f"pick.{c}").alias(c) for c in payload])


def select_slots(series: DataFrame, study: str, payload: Seq[str] = ()) -> DataFrame:
    """First series per slot in catalogue order, with contrast fallback and no reuse."""
    return _pick_first(_with_slots(series), study, [], payload)


def select_slots_by_quality(series: DataFrame, study: str, thresholds: DataFrame, crop_mm: float = 140.0,
                            image_size: int = 336, payload: Seq[str] = ()) -> DataFrame:
    """Same candidates ranked by geometry quality; without a usable one the catalogue order decides.

    ``thresholds`` has one row per plane, so its broadcast cannot grow.
    """
    rows = _with_slots(series).join(F.broadcast(thresholds), "plane")
    return _pick_first(rows, study, quality_order(crop_mm, image_size), payload)


def qualified(crop_mm: float) -> Column:
    """Usable, enough coverage for the plane and a field at least as large as the crop."""
    return F.coalesce((F.col("usable") == 1) & (F.col("coverage_mm") >= F.col("threshold")) & (F.col("fov_mm") >= crop_mm), F.lit(False))


def select_two_per_slot(series: DataFrame, study: str, thresholds: DataFrame, crop_mm: float = 140.0, image_size: int = 336) -> DataFrame:
    """Adds a second qualified series to each slot whose first is qualified.

    All firsts are reserved before any second. Contrast narrows the candidates
    before used series leave, so a second never crosses contrast. At most three
    series of a plane are taken by others, so four candidates per slot suffice.
    """
    rows = _with_slots(series).join(F.broadcast(thresholds), "plane").withColumn("ok", qualified(crop_mm))
    firsts = select_slots_by_quality(series, study, thresholds, crop_mm, image_size, payload=QUALITY)
    firsts = (firsts.join(F.broadcast(slot_table(series.sparkSession).select("slot", "plane")), "slot")
              .join(F.broadcast(thresholds), "plane").withColumn("ok", qualified(crop_mm)))
    order = [F.col("match").desc(), F.col("ok").desc(), *quality_order(crop_mm, image_size), F.col("ordinal").asc()]
    ranked = top_k(rows, [study, "slot"], order, 4)
    first = firsts.groupBy(study, "plane").agg(*[
        F.max(F.when(F.col("slot") % 2 == parity, F.struct("series", "ok"))).alias(f"f{parity}") for parity in (0, 1)])
    shelves = ranked.groupBy(study, "plane").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("slot") % 2 == parity, F.struct("rank", "series", "match", "ok")))).alias(f"s{parity}")
        for parity in (0, 1)])

    def free(shelf_name: str, gate: Column, taken: Seq[Column]) -> Column:
        head = F.col(shelf_name)[0]["match"]
        keep = F.filter(shelf_name, lambda c: (c["match"] == head) & c["ok"] & ~F.coalesce(
            F.array_contains(F.filter(F.array(*taken), lambda t: t.isNotNull()), c["series"]), F.lit(False)))
        return F.when(F.coalesce(gate, F.lit(False)), F.get(keep, F.lit(0))["series"])

    f0, f1 = F.col("f0.series"), F.col("f1.series")
    both = first.join(shelves, [study, "plane"])
    both = both.withColumn("t0", free("s0", F.col("f0.ok"), [f0, f1]))
    both = both.withColumn("t1", free("s1", F.col("f1.ok"), [f0, f1, F.col("t0")]))
    base = F.when(F.col("plane") == "Sagittal", 0).when(F.col("plane") == "Coronal", 2).otherwise(4)
    picks = F.array(*[F.struct((base + parity).alias("slot"), F.lit(place).alias("place"), pick.alias("series"))
                      for parity, place, pick in [(0, 1, f0), (1, 1, f1), (0, 2, F.col("t0")), (1, 2, F.col("t1"))]])
    return both.select(study, F.inline(picks)).where(F.col("series").isNotNull())


def slot_budgets(picks: DataFrame, study: str) -> DataFrame:
    """Window budget of each picked series: the full slot budget for firsts, the smaller one for seconds."""
    budgets = picks.sparkSession.createDataFrame(
        [(slot, place, budget) for slot, _, _, one, two in SLOTS for place, budget in ((1, one), (2, two))],
        "slot int, place int, budget int")
    return picks.join(F.broadcast(budgets), ["slot", "place"]).select(study, "slot", "place", "series", "budget")


def selection_report(old: DataFrame, new: DataFrame, studies: DataFrame, study: str, payload: Seq[str] = ()) -> DataFrame:
    """Old and new series of every study slot (five fixed slots each), with a changed flag."""
    slots = F.array(*[F.lit(row[0]) for row in SLOTS])
    frame = studies.select(study).distinct().select(study, F.explode(slots).alias("slot"))
    side = lambda df, prefix: df.select(study, "slot", F.col("series").alias(f"{prefix}_series"),
                                        *[F.col(c).alias(f"{prefix}_{c}") for c in payload])
    joined = frame.join(side(old, "original"), [study, "slot"], "left").join(side(new, "selected"), [study, "slot"], "left")
    return joined.withColumn("changed", (~F.col("original_series").eqNullSafe(F.col("selected_series"))).cast("int"))


def change_summary(report: DataFrame, study: str) -> DataFrame:
    """Changed slots per slot and overall (slot NULL), with the studies touched."""
    return report.groupingSets([[], [F.col("slot")]], "slot").agg(
        F.count(F.lit(1)).alias("slots"), F.sum("changed").alias("changed_slots"),
        F.count_distinct(F.when(F.col("changed") == 1, F.col(study))).alias("changed_studies"))


def repeat_causes(series: DataFrame, study: str, check: DataFrame | None = None) -> DataFrame:
    """Why a study repeats a series type: each repeat against the one before it.

    Rules in order: echo or repetition time differs by more than 15 %, derived
    image, normal turned by more than 5 degrees, other grid, otherwise a rescan.
    Consecutive repeats keep the work linear in the group.
    """
    fields = ["series", "te", "tr", "derived", "normal", "pixel_spacing_mm", "slice_spacing_mm", "unique_slices"]
    seq = Sequence(series, [study, "type"], [F.col("ordinal")], check=check).neighbour("before", F.struct(*fields))
    pairs = seq.df.where(F.col("before").isNotNull())
    off = lambda name: F.coalesce(F.abs(F.col(name) - F.col(f"before.{name}"))
                                  > 0.15 * F.greatest(F.col(name), F.col(f"before.{name}")), F.lit(False))
    cosine = sum((F.col("normal")[i] * F.col("before.normal")[i] for i in range(1, 3)), F.col("normal")[0] * F.col("before.normal")[0])
    angle = F.degrees(F.acos(F.least(F.abs(cosine), F.lit(1.0))))
    grid = F.lit(False)
    for name in ("pixel_spacing_mm", "unique_slices", "slice_spacing_mm"):
        grid = grid | ~F.col(name).eqNullSafe(F.col(f"before.{name}"))
    cause = (F.when(off("te") | off("tr"), "contrast").when(F.col("derived") | F.col("before.derived"), "reconstruction")
             .when(angle > 5, "angle").when(grid, "grid").otherwise("rescan"))
    return pairs.select(study, "type", F.col("before.series").alias("first_series"), F.col("series").alias("second_series"),
                        cause.alias("cause"), F.round(angle, 2).alias("angle"))
