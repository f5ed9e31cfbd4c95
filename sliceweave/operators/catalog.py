"""Catalogue of study, series and slice: geometry quality, profiles and integrity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence as Seq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sliceweave.functions import geometry
from sliceweave.operators.ordering import Sequence, group_quantiles, group_summary, hot_groups
from sliceweave.schemas import PLANES


def slice_counts(listing: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Files per folder from a listing of paths; ``pattern`` captures the folder key."""
    return (listing.select(F.regexp_extract(path, pattern, 1).alias("folder")).where("folder <> ''")
            .groupBy("folder").agg(F.count(F.lit(1)).alias("num_slices")))


def attach_slice_counts(series: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Slice count per series, 0 for a series without a file."""
    return series.join(counts, key, "left").withColumn("num_slices", F.coalesce("num_slices", F.lit(0)))


def header_flags(headers: DataFrame, unreadable: Column, orientation: str = "orientation", location: str = "location") -> DataFrame:
    """``header_error`` and ``geometry_error`` per header; an unreadable header has no geometry to judge."""
    unreadable = F.coalesce(unreadable, F.lit(False))
    sound = geometry.valid_geometry(F.col(orientation), F.col(location))
    return headers.withColumn("header_error", unreadable).withColumn("geometry_error", ~unreadable & ~sound)


def header_scan(headers: DataFrame, series: str, unreadable: Column) -> DataFrame:
    """Files, unreadable headers and bad geometries per series, counted apart."""
    return header_flags(headers, unreadable).groupBy(series).agg(
        F.count(F.lit(1)).alias("files"), F.count_if("header_error").alias("header_errors"),
        F.count_if("geometry_error").alias("geometry_errors"))


def order_slices(slices: DataFrame, keys: Seq[str], position: str, tie: Seq[str], check: DataFrame | None = None,
                 hot: DataFrame | None | bool = False) -> DataFrame:
    """Zero-based ``idx`` in spatial order and the group size ``n``."""
    seq = Sequence(slices, keys, [F.col(position), *[F.col(name) for name in tie]], check=check, hot=hot).row_number("_rn").size("n")
    return seq.df.withColumn("idx", F.col("_rn") - 1).drop("_rn")


def spatial_position(headers: DataFrame, orientation: str = "orientation", location: str = "location") -> DataFrame:
    """Position along the slice normal whose dominant axis is positive."""
    placed = geometry.with_normal(headers, orientation, "_normal")
    along = geometry.dot(F.col(location), F.col("_normal")) * geometry.dominant_sign(F.col("_normal"))
    return placed.withColumn("position", along).drop("_normal")


def middle_reference(ordered: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Valid value nearest the middle row of each group; ties take the lower row.

    ``ordered`` carries idx (from 0) and n.
    """
    middle = F.floor(F.col("n") / 2)
    valid = ordered.withColumn("_value", value).where(F.col("_value").isNotNull())
    return valid.groupBy(key).agg(
        F.min_by("_value", F.struct(F.abs(F.col("idx") - middle), F.col("idx"))).alias(name))


def series_quality(headers: DataFrame, series: str, file_order: Seq[str], unreadable: Column,
                   check: DataFrame | None = None, hot: DataFrame | None | bool = False) -> DataFrame:
    """Geometry quality per series from its slice headers.

    The normal of the first valid header places every slice; equal positions
    (4 decimals) count once. Spacing and field of view come from the middle.
    Unless a series is large, rows that are partitioned by series, and sorted by
    ``file_order`` in it, are not shuffled or sorted for the first normal again.
    """
    flagged = header_flags(headers, unreadable).withColumn("_ok", ~F.col("header_error") & ~F.col("geometry_error"))
    flagged = geometry.with_normal(flagged, "orientation", "_normal")
    hot = hot_groups(flagged, [series], check=check) if hot is False else hot
    if hot is None:
        whole = Window.partitionBy(series).orderBy(*file_order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        first = F.first(F.when(F.col("_ok"), F.col("_normal")), ignorenulls=True)
        first_known = flagged.where(F.col(series).isNotNull()).withColumn("_first", first.over(whole)).withColumn("_n", F.count_if("_ok").over(whole))
    else:
        first = F.min_by("_normal", F.when(F.col("_ok"), F.struct(*file_order)))
        first_known = flagged.join(flagged.groupBy(series).agg(first.alias("_first"), F.count_if("_ok").alias("_n")), series)
    # Faulty headers stay in, behind the valid ones, so a series without any valid header is still reported.
    placed = first_known.select(
        series, *file_order, "_ok", "_n", "header_error", "geometry_error",
        F.when(F.col("_ok"), F.struct("rows", "columns")).alias("_matrix"),
        F.when(F.col("_ok"), geometry.valid_spacing(F.col("pixel_spacing"))).alias("_spacing"),
        F.when(F.col("_ok"), F.abs(geometry.dot(F.col("_normal"), F.col("_first")))).alias("_cosine"),
        F.when(F.col("_ok"), F.bround(geometry.dot(F.col("location"), F.col("_first")), 4)).alias("_pos"))
    seq = Sequence(placed, [series], [F.col("_ok").desc(), F.col("_pos"), *[F.col(c) for c in file_order]], check=check, hot=hot)
    rows = seq.row_number("_rn").neighbour("_before", F.col("_pos")).df
    new = F.col("_ok") & ((F.col("_rn") == 1) | (F.col("_pos") != F.col("_before")))
    rows = rows.withColumn("_new", new).withColumn("_gap", F.when(F.col("_new") & (F.col("_rn") > 1), F.col("_pos") - F.col("_before")))
    middle, idx = F.floor(F.col("_n") / 2), F.col("_rn") - 1
    median = [] if seq.split else [F.percentile("_gap", 0.5).alias("slice_spacing_mm")]
    shape = rows.groupBy(series).agg(
        F.count_if("header_error").alias("header_errors"), F.count_if("geometry_error").alias("_bad"),
        F.count_if("_new").alias("unique_slices"), (F.max("_pos") - F.min("_pos")).alias("coverage_mm"), F.min("_cosine").alias("_cosine"),
        F.max(F.when(idx == middle, F.col("_matrix"))).alias("_matrix"),
        F.min_by("_spacing", F.when(F.col("_spacing").isNotNull(), F.struct(F.abs(idx - middle), idx))).alias("_spacing"), *median)
    if seq.split:
        shape = shape.join(group_quantiles(rows.select(series, "_gap"), [series], "_gap", {"slice_spacing_mm": 0.5}, check=check), series, "left")

    spacing = [F.get("_spacing", F.lit(i)).cast("float") for i in range(2)]
    height, width = F.col("_matrix.rows"), F.col("_matrix.columns")
    fov = F.when((height > 0) & (width > 0),
                 F.least(height.cast("float") * spacing[0], width.cast("float") * spacing[1]).cast("double"))
    shape = shape.withColumn("fov_mm", fov).withColumn("pixel_spacing_mm", F.greatest(spacing[0], spacing[1]).cast("double"))
    no_view = (F.col("unique_slices") > 0) & F.col("fov_mm").isNull()
    usable = ((F.col("unique_slices") >= 2) & (F.col("_cosine") >= 0.999) & (F.col("header_errors") == 0)
              & (F.col("_bad") == 0) & F.col("fov_mm").isNotNull())
    return shape.select(
        series, "header_errors", (F.col("_bad") + F.when(no_view, 1).otherwise(0)).alias("geometry_errors"), "unique_slices",
        "coverage_mm", "slice_spacing_mm", "pixel_spacing_mm", "fov_mm", F.coalesce(usable, F.lit(False)).cast("int").alias("usable"))


def coverage_thresholds(rows: DataFrame, quantile: float = 0.2, check: DataFrame | None = None) -> DataFrame:
    """Coverage quantile per plane over usable series; 0 where a plane has none. Always three rows."""
    good = rows.where((F.col("usable") == 1) & (F.col("coverage_mm") > 0) & F.col("plane").isin(*PLANES))
    fitted = group_quantiles(good.select("plane", "coverage_mm"), ["plane"], "coverage_mm", {"threshold": quantile}, check=check)
    planes = rows.sparkSession.createDataFrame([(p,) for p in PLANES], "plane string")
    return planes.join(fitted, "plane", "left").select("plane", F.coalesce("threshold", F.lit(0.0)).alias("threshold"))


def series_type(plane: Column, fat: Column) -> Column:
    return F.concat_ws("_", plane, F.when(fat == 1, "FS").otherwise("nonFS"))


def children_profile(parents: DataFrame, children: DataFrame, key: str, level: str) -> DataFrame:
    """Children per parent: parents, children, childless parents and the spread."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("children"))
    joined = parents.select(key).join(counts, key, "left").withColumn("children", F.coalesce("children", F.lit(0)))
    whole = [F.count(F.lit(1)).alias("parents"), F.sum("children").alias("children"), F.count_if(F.col("children") == 0).alias("childless"),
             F.min("children").alias("min_children"), F.max("children").alias("max_children")]
    return group_summary(joined, [], {"children": {"median_children": 0.5}}, whole).select(F.lit(level).alias("level"), "*")


def type_presence(series: DataFrame, study: str) -> DataFrame:
    """Per series type: share of studies that have it, share that repeat it, most in one study, median slices."""
    typed = series.withColumn("type", series_type(F.col("plane"), F.col("fat")))
    per_study = typed.groupBy(study, "type").agg(F.count(F.lit(1)).alias("n"))
    studies = series.agg(F.count_distinct(study)).scalar()
    shares = per_study.groupBy("type").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("n") > 1).alias("repeated"),
                                           F.max("n").alias("max_per_study"))
    medians = group_quantiles(typed.select("type", "num_slices"), ["type"], "num_slices", {"median_slices": 0.5})
    return shares.join(F.broadcast(medians), "type", "left").select(
        "type", (F.col("present") / studies).alias("presence_rate"),
        (F.col("repeated") / F.col("present")).alias("repeat_rate"), "max_per_study", "median_slices")


def layouts(series: DataFrame, study: str) -> DataFrame:
    """Series-type combination of each study, its frequency and the running share.

    A signature lists each type with its count, so it is as short as the list
    of types however many series a study holds.
    """
    per_type = series.groupBy(study, series_type(F.col("plane"), F.col("fat")).alias("type")).agg(F.count(F.lit(1)).alias("n"))
    signature = per_type.groupBy(study).agg(F.array_join(F.sort_array(F.collect_list(
        F.concat_ws("x", "type", F.col("n").cast("string")))), " + ").alias("layout"))
    counts = signature.groupBy("layout").agg(F.count(F.lit(1)).alias("studies"))
    running = Sequence(counts, [], [F.desc("studies"), F.col("layout")]).running("upto", "sum", F.col("studies")).df
    total = counts.agg(F.sum("studies")).scalar()
    return running.select("layout", "studies", (F.col("studies") / total).alias("share"), (F.col("upto") / total).alias("cumulative_share"))


def contrast_mix(series: DataFrame) -> DataFrame:
    """Contrast classes inside each series type, as counts and shares."""
    typed = series.select(series_type(F.col("plane"), F.col("fat")).alias("type"),
                          geometry.contrast(F.col("te"), F.col("tr"), F.col("fat")).alias("contrast"))
    counts = typed.groupBy("type").agg(F.count(F.lit(1)).alias("series"), *[
        F.count_if(F.col("contrast") == kind).alias(name)
        for kind, name in [("T1", "t1"), ("PD", "pd"), ("T2", "t2"), ("PD/T2", "pd_t2"), ("unknown", "unknown")]])
    return counts.select("*", *[(F.col(name) / F.col("series")).alias(f"{name}_share") for name in ["t1", "pd", "t2", "pd_t2", "unknown"]])


def geometry_medians(series: DataFrame, columns: Mapping[str, str], check: DataFrame | None = None) -> DataFrame:
    """Median of each geometry column per series type, and the depth to pixel ratio."""
    typed = series.withColumn("type", series_type(F.col("plane"), F.col("fat"))).select("type", *columns.values())
    result = group_summary(typed, ["type"], {column: {name: 0.5} for name, column in columns.items()}, check=check)
    return result.withColumn("depth_pixel_ratio", F.col("median_slice_spacing") / F.col("median_pixel_spacing"))


def device_mix(rows: DataFrame, device: str, field: Column) -> DataFrame:
    """Share of each device and how often it fills a field."""
    counts = rows.groupBy(device).agg(F.count(F.lit(1)).alias("rows"), F.count_if(field.isNotNull()).alias("filled"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.select(device, "rows", (F.col("rows") / total).alias("share"), (F.col("filled") / F.col("rows")).alias("coverage"))


def numbering_direction(slices: DataFrame, series: str, number: Column, position: Column) -> DataFrame:
    """1 when file numbers run against the spatial order, 0 with it, NULL when flat."""
    slope = F.round(F.covar_samp(number, position), 6)
    return slices.groupBy(series).agg(F.when(slope < 0, 1).when(slope > 0, 0).alias("reversed"))


def work_budget(studies: int, series_per_study: float, slices_per_series: float, hours: float) -> tuple[float, float]:
    """Milliseconds per slice and seconds per study within a time limit."""
    seconds = hours * 3600
    return seconds * 1000 / (studies * series_per_study * slices_per_series), seconds / studies


def budget_report(series: DataFrame, study: str, hours: float = 9.0) -> DataFrame:
    """Work of a run over all slices within ``hours``."""
    totals = series.groupBy(study).agg(F.count(F.lit(1)).alias("series"), F.sum("num_slices").alias("slices"))
    return totals.agg(F.count(F.lit(1)).alias("studies"), F.sum("series").alias("series"), F.sum("slices").alias("slices")).select(
        "*", (hours * 3600 * 1000 / F.col("slices")).alias("ms_per_slice"), (hours * 3600 / F.col("studies")).alias("seconds_per_study"))


def integrity(checks: Mapping[str, DataFrame]) -> DataFrame:
    """One row per named check with the number of offending rows."""
    rows = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("offenders")) for name, df in checks.items()]
    result = rows[0]
    for row in rows[1:]:
        result = result.unionByName(row)
    return result


def shared_children(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Children that belong to more than one parent."""
    return df.select(child, parent).distinct().groupBy(child).agg(F.count(F.lit(1)).alias("parents")).where("parents > 1")


def middle_slice(ordered: DataFrame, key: str, columns: Seq[str]) -> DataFrame:
    """The middle row of each ordered group."""
    return ordered.where(F.col("idx") == F.floor(F.col("n") / 2)).select(key, "idx", *columns)
