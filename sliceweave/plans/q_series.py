"""Catalogue profiles, series selection, slice windows and nearest positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sliceweave.functions import geometry
from sliceweave.functions import labels as L
from sliceweave.operators import catalog, joins, neighbors, selection, windows
from sliceweave.operators.ordering import Sequence, group_summary
from sliceweave.plans import models as m
from sliceweave.plans.models import CROP_MM, FILE_ORDER, IMAGE_SIZE, sql
from sliceweave.plans.registry import query
from sliceweave.session import materialize
from sliceweave.sources.tables import table


def _keys(spark, d):
    """Series keys straight from the scan, for the group size check."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("series"))


# Projections over slices

_CONTRAST = """CASE WHEN fat = 1 THEN 'PD/T2' WHEN te <= 0 OR tr <= 0 THEN 'unknown' WHEN tr < 1000 AND te < 30 THEN 'T1' WHEN te < 60 THEN 'PD' ELSE 'T2' END"""


def _slices_with_flags(spark, d):
    flags = m.series(spark, d).select("series", "study", "plane", "fluid", "fat")
    return m.slices(spark, d).join(flags, "series")


@query("p12_contrast", sql(f"SELECT {_CONTRAST} AS contrast, count(*) AS slices FROM slices JOIN series USING (series) GROUP BY 1", "slices", "series"))
def contrast(spark, d):
    kind = geometry.contrast(F.col("te"), F.col("tr"), F.col("fat"))
    return _slices_with_flags(spark, d).groupBy(kind.alias("contrast")).agg(F.count(F.lit(1)).alias("slices"))


_FEATURES = ["fluid", "fat", "t1", "pd", "t2", "unknown", "te", "tr", "pixel", "spacing", "coverage"]


@query("p14_feature_vector", sql(f"""
    SELECT series, CAST(coalesce(fluid, 0) AS DOUBLE) AS fluid, CAST(fat AS DOUBLE) AS fat, CAST(c = 'T1' AS DOUBLE) AS t1, CAST(c IN ('PD', 'PD/T2') AS DOUBLE) AS pd,
           CAST(c IN ('T2', 'PD/T2') AS DOUBLE) AS t2, CAST(c = 'unknown' AS DOUBLE) AS unknown, round(te / 100, 6) AS te, round(tr / 5000, 6) AS tr,
           round(pixel_spacing_mm, 6) AS pixel, round(coalesce(slice_spacing_mm, 0) / 10, 8) AS spacing, round(coverage_mm / 200, 8) AS coverage
    FROM (SELECT c.*, te, tr, {_CONTRAST} AS c FROM candidates c JOIN (SELECT series, te, tr FROM ordered_slices WHERE idx = n // 2) s ON c.series = s.series
          WHERE c.coverage_mm IS NOT NULL)""", "candidates", "ordered_slices"))
def feature_vector(spark, d):
    middle = catalog.middle_slice(m.ordered_slices(spark, d), "series", ["te", "tr"])
    rows = m.candidates(spark, d).where(F.col("coverage_mm").isNotNull()).join(middle, "series")
    vector = geometry.feature_vector(F.col("fluid"), F.col("fat"), F.col("te"), F.col("tr"), F.col("pixel_spacing_mm"), F.col("slice_spacing_mm"), F.col("coverage_mm"))
    return rows.select("series", vector.alias("v")).select("series", *[F.round(F.col("v")[i], {"spacing": 8, "coverage": 8}.get(name, 6)).alias(name) for i, name in enumerate(_FEATURES)])


@query("p15_spatial_position", sql("""
    SELECT series, line, part, supp, round(CASE WHEN abs(nx) >= abs(ny) AND abs(nx) >= abs(nz) THEN CASE WHEN nx < 0 THEN -p ELSE p END
           WHEN abs(ny) >= abs(nz) THEN CASE WHEN ny < 0 THEN -p ELSE p END ELSE CASE WHEN nz < 0 THEN -p ELSE p END END, 6) AS position
    FROM (SELECT *, location[1] * nx + location[2] * ny + location[3] * nz AS p FROM oriented)""", "oriented"))
def spatial_position(spark, d):
    flagged = catalog.header_flags(m.headers(spark, d), F.col("unreadable")).where(~F.col("header_error") & ~F.col("geometry_error"))
    return catalog.spatial_position(flagged).select("series", *FILE_ORDER, F.round("position", 6).alias("position"))


@query("p16_degenerate_geometry", sql("SELECT supp % 41 = 0 AS degenerate, count(*) AS headers FROM headers GROUP BY 1", "headers"))
def degenerate_geometry(spark, d):
    bad = ~geometry.valid_geometry(F.col("orientation"), F.col("location"))
    return m.headers(spark, d).groupBy(bad.alias("degenerate")).agg(F.count(F.lit(1)).alias("headers"))


@query("p19_depth", sql("""
    SELECT series, idx, round(CASE WHEN hi > lo THEN 2 * (position - lo) / (hi - lo) - 1 ELSE 0 END, 6) AS depth
    FROM (SELECT *, min(position) OVER w AS lo, max(position) OVER w AS hi FROM ordered_slices WINDOW w AS (PARTITION BY series))""", "ordered_slices"))
def depth(spark, d):
    span = m.slices(spark, d).groupBy("series").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    rows = m.ordered_slices(spark, d).join(span, "series")
    return rows.select("series", "idx", F.round(geometry.depth(F.col("position"), F.col("lo"), F.col("hi")), 6).alias("depth"))


@query("p20_trimmed_range", sql("""
    SELECT series, idx FROM ordered_slices WHERE idx BETWEEN floor(n * 0.1::DOUBLE) AND greatest(floor(n * 0.1::DOUBLE), floor(n * 0.9::DOUBLE) - 1)""", "ordered_slices"))
def trimmed_range(spark, d):
    return windows.trimmed(m.ordered_slices(spark, d), 0.1, 0.9).select("series", "idx")


@query("p21_quality_gate", sql(f"""
    SELECT c.plane, count(*) AS series, count(*) FILTER (usable = 1 AND coverage_mm >= threshold AND fov_mm >= {CROP_MM}) AS qualified
    FROM candidates c JOIN thresholds t ON c.plane = t.plane GROUP BY 1""", "candidates", "thresholds"))
def quality_gate(spark, d):
    rows = materialize(m.candidates(spark, d))
    joined = rows.join(F.broadcast(m.train_thresholds(spark, d, rows)), "plane")
    return joined.groupBy("plane").agg(F.count(F.lit(1)).alias("series"), F.count_if(selection.qualified(CROP_MM)).alias("qualified"))


# Quality and profiles

@query("a01_series_quality", sql("SELECT * FROM quality", "quality"))
def series_quality(spark, d):
    return m.quality(spark, d)


@query("a02_middle_reference", sql("""
    SELECT series, arg_min(te, abs(idx - n // 2) * 1000000 + idx) AS te FROM ordered_slices WHERE te > 10 GROUP BY 1""", "ordered_slices"))
def middle_reference(spark, d):
    return catalog.middle_reference(m.ordered_slices(spark, d), "series", F.when(F.col("te") > 10, F.col("te")), "te")


@query("a03_coverage_thresholds", sql("SELECT plane, threshold FROM thresholds", "thresholds"))
def coverage_thresholds(spark, d):
    return m.train_thresholds(spark, d, materialize(m.candidates(spark, d)))


def _profile_sql(level, parents, pk, children, ck):
    return f"""SELECT '{level}' AS level, count(*) AS parents, CAST(sum(k) AS BIGINT) AS children, count(*) FILTER (k = 0) AS childless, min(k) AS min_children,
        max(k) AS max_children, quantile_cont(k, 0.5) AS median_children
        FROM (SELECT p.{pk}, count(c.{ck}) AS k FROM {parents} p LEFT JOIN {children} c ON p.{pk} = c.{ck} GROUP BY 1)"""


@query("a22_hierarchy", _profile_sql("study", "customer", "c_custkey", "orders", "o_custkey") + " UNION ALL " +
       _profile_sql("series", "orders", "o_orderkey", "lineitem", "l_orderkey"))
def hierarchy(spark, d):
    orders = table(spark, d, "orders")
    study = catalog.children_profile(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), orders.select(F.col("o_custkey").alias("k")), "k", "study")
    series = catalog.children_profile(orders.select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k", "series")
    return study.unionByName(series)


@query("a23_integrity", """
    SELECT 'labels without series' AS "check", count(*) AS offenders FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT 'series of unknown study', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'duplicate study', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'series in two studies', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) > 1)
    UNION ALL SELECT 'splits overlap', count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT item_id FROM benchmark)
    UNION ALL SELECT 'study with two patients', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(DISTINCT c_name) > 1)
    UNION ALL SELECT 'patient with two studies', count(*) FROM (SELECT c_name FROM customer GROUP BY 1 HAVING count(DISTINCT c_custkey) > 1)
    UNION ALL SELECT 'series without slices', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'slice in two series', count(*) FROM (SELECT l_partkey, l_suppkey, l_linenumber FROM lineitem GROUP BY 1, 2, 3 HAVING count(DISTINCT l_orderkey) > 1)
    UNION ALL SELECT 'slice of unknown series', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def integrity(spark, d):
    customer, orders, lines = (table(spark, d, name) for name in ("customer", "orders", "lineitem"))
    study, series = customer.select(F.col("c_custkey").alias("study"), "c_name"), orders.select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("series"))
    slices = lines.select(F.col("l_orderkey").alias("series"), F.struct("l_partkey", "l_suppkey", "l_linenumber").alias("slice"))
    from sliceweave.operators import guards

    ids = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return catalog.integrity({
        "labels without series": guards.missing_from(study, series, ["study"]),
        "series of unknown study": guards.missing_from(series, study, ["study"]),
        "duplicate study": guards.duplicate_keys(study, ["study"]),
        "series in two studies": catalog.shared_children(series, "series", "study"),
        "splits overlap": joins.overlap(ids, table(spark, d, "benchmark").select(F.col("item_id").alias("id")), ["id"]),
        "study with two patients": catalog.shared_children(study, "study", "c_name"),
        "patient with two studies": catalog.shared_children(study, "c_name", "study"),
        "series without slices": guards.missing_from(series, slices, ["series"]),
        "slice in two series": catalog.shared_children(slices, "slice", "series"),
        "slice of unknown series": guards.missing_from(slices, series, ["series"]),
    })


_TYPE = "plane || '_' || CASE WHEN fat = 1 THEN 'FS' ELSE 'nonFS' END"


@query("a24_type_presence", sql(f"""
    SELECT t.type, round(count(*) / (SELECT count(DISTINCT study) FROM series), 6) AS presence_rate, round(count(*) FILTER (k > 1) / count(*), 6) AS repeat_rate,
           max(k) AS max_per_study, any_value(med) AS median_slices
    FROM (SELECT study, {_TYPE} AS type, count(*) AS k FROM series GROUP BY 1, 2) t
    JOIN (SELECT {_TYPE} AS type, quantile_cont(num_slices, 0.5) AS med FROM series GROUP BY 1) q ON t.type = q.type GROUP BY 1""", "series"))
def type_presence(spark, d):
    rows = catalog.type_presence(m.series(spark, d), "study")
    return rows.withColumn("presence_rate", F.round("presence_rate", 6)).withColumn("repeat_rate", F.round("repeat_rate", 6))


_LAYOUT = f"""SELECT layout, count(*) AS studies FROM (SELECT study, string_agg(t, ' + ' ORDER BY t) AS layout FROM (
    SELECT study, {_TYPE} || 'x' || count(*) AS t FROM series GROUP BY study, {_TYPE}) GROUP BY 1) GROUP BY 1"""


@query("a25_layouts", sql(f"""
    SELECT layout, studies, round(studies / sum(studies) OVER (), 6) AS share,
           round(sum(studies) OVER (ORDER BY studies DESC, layout ROWS UNBOUNDED PRECEDING) / sum(studies) OVER (), 6) AS cumulative_share FROM ({_LAYOUT})""", "series"))
def layouts(spark, d):
    rows = catalog.layouts(m.series(spark, d), "study")
    return rows.select("layout", "studies", F.round("share", 6).alias("share"), F.round("cumulative_share", 6).alias("cumulative_share"))


@query("w15_cumulative_share", """
    SELECT p_brand, parts, round(sum(parts) OVER (ORDER BY parts DESC, p_brand ROWS UNBOUNDED PRECEDING) / sum(parts) OVER (), 6) AS cumulative_share
    FROM (SELECT p_brand, count(*) AS parts FROM part GROUP BY 1)""")
def cumulative_share(spark, d):
    counts = table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("parts"))
    return windows.cumulative_share(counts, [F.desc("parts"), F.col("p_brand")], "parts").withColumn("cumulative_share", F.round("cumulative_share", 6))


@query("a26_contrast_mix", sql(f"""
    SELECT *, round(t1 / series, 6) AS t1_share, round(pd / series, 6) AS pd_share, round(t2 / series, 6) AS t2_share, round(pd_t2 / series, 6) AS pd_t2_share, round(unknown / series, 6) AS unknown_share
    FROM (SELECT {_TYPE} AS type, count(*) AS series, count(*) FILTER ({_CONTRAST} = 'T1') AS t1, count(*) FILTER ({_CONTRAST} = 'PD') AS pd,
          count(*) FILTER ({_CONTRAST} = 'T2') AS t2, count(*) FILTER ({_CONTRAST} = 'PD/T2') AS pd_t2, count(*) FILTER ({_CONTRAST} = 'unknown') AS unknown
          FROM series JOIN (SELECT series, te, tr FROM ordered_slices WHERE idx = n // 2) USING (series) GROUP BY 1)""", "series", "ordered_slices"))
def contrast_mix(spark, d):
    middle = catalog.middle_slice(m.ordered_slices(spark, d), "series", ["te", "tr"])
    rows = catalog.contrast_mix(m.series(spark, d).join(middle, "series"))
    return rows.select(*[F.round(c, 6).alias(c) if c.endswith("_share") else F.col(c) for c in rows.columns])


@query("a27_geometry_medians", sql(f"""
    SELECT *, round(median_slice_spacing / median_pixel_spacing, 4) AS depth_pixel_ratio FROM (
    SELECT {_TYPE} AS type, quantile_cont(unique_slices, 0.5) AS median_slices, round(quantile_cont(pixel_spacing_mm, 0.5), 6) AS median_pixel_spacing,
           round(quantile_cont(slice_spacing_mm, 0.5), 6) AS median_slice_spacing, round(quantile_cont(coverage_mm, 0.5), 6) AS median_coverage FROM candidates GROUP BY 1)""", "candidates"))
def geometry_medians(spark, d):
    rows = catalog.geometry_medians(m.candidates(spark, d), {
        "median_slices": "unique_slices", "median_pixel_spacing": "pixel_spacing_mm", "median_slice_spacing": "slice_spacing_mm", "median_coverage": "coverage_mm"},
        check=table(spark, d, "orders").select("o_orderkey"))
    return rows.select("type", "median_slices", *[F.round(c, 6).alias(c) for c in ("median_pixel_spacing", "median_slice_spacing", "median_coverage")],
                       F.round("depth_pixel_ratio", 4).alias("depth_pixel_ratio"))


@query("a28_device_mix", """
    SELECT source, count(*) AS rows, round(count(*) / (SELECT count(*) FROM documents), 6) AS share, round(count(quality) / count(*), 6) AS coverage
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def device_mix(spark, d):
    rows = catalog.device_mix(m.studies(spark, d), "source", F.col("quality"))
    return rows.select("source", "rows", F.round("share", 6).alias("share"), F.round("coverage", 6).alias("coverage"))


@query("a29_numbering_direction", sql("""
    SELECT count(*) AS series, count(*) FILTER (c < 0) AS reversed, count(*) FILTER (c > 0) AS forward
    FROM (SELECT series, round(covar_samp(line, position), 6) AS c FROM slices GROUP BY 1)""", "slices"))
def numbering_direction(spark, d):
    rows = catalog.numbering_direction(m.slices(spark, d), "series", F.col("line"), F.col("position"))
    return rows.agg(F.count(F.lit(1)).alias("series"), F.count_if(F.col("reversed") == 1).alias("reversed"), F.count_if(F.col("reversed") == 0).alias("forward"))


@query("a30_work_budget", sql("""
    SELECT count(DISTINCT study) AS studies, count(*) AS series, CAST(sum(num_slices) AS BIGINT) AS slices, round(9 * 3600 * 1000 / sum(num_slices), 6) AS ms_per_slice,
           round(9 * 3600 / count(DISTINCT study), 6) AS seconds_per_study FROM series""", "series"))
def work_budget(spark, d):
    rows = catalog.budget_report(m.series(spark, d), "study")
    return rows.select("studies", "series", "slices", F.round("ms_per_slice", 6).alias("ms_per_slice"), F.round("seconds_per_study", 6).alias("seconds_per_study"))


# Orphans and membership

@query("j05_membership", sql("SELECT study, series FROM series WHERE study IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", "series"))
def membership(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("study"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("series"))
    return joins.members(orders, chosen, "study")


@query("j14_selection_with_split", sql("SELECT s.series, s.plane, m.split FROM series s LEFT JOIN members m ON s.series = m.uid", "series", "members"))
def selection_with_split(spark, d):
    split = m.members(spark, d).withColumnRenamed("uid", "series")
    return joins.with_split(m.series(spark, d).select("series", "plane"), split, "series")


@query("j16_orphans", "SELECT o_orderkey AS series FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphans(spark, d):
    from sliceweave.operators import guards

    return guards.missing_from(table(spark, d, "orders").select(F.col("o_orderkey").alias("series")), _keys(spark, d), ["series"])


# Selection

_SLOT = "(VALUES (0, 'Sagittal', 1), (1, 'Sagittal', 0), (2, 'Coronal', 1), (3, 'Coronal', 0), (4, 'Axial', NULL)) slots(slot, plane, preference)"
_QORDER = f"""CASE WHEN usable = 1 THEN 1 ELSE 0 END DESC, CASE WHEN usable = 1 THEN CASE WHEN threshold > 0 THEN least(coverage_mm / threshold, 1) ELSE 1 END END DESC NULLS LAST,
    CASE WHEN usable = 1 THEN least(fov_mm / {CROP_MM}, 1) END DESC NULLS LAST, CASE WHEN usable = 1 THEN greatest(pixel_spacing_mm, {CROP_MM}::DOUBLE / {IMAGE_SIZE}) END ASC NULLS FIRST,
    CASE WHEN usable = 1 THEN slice_spacing_mm END ASC NULLS FIRST, CASE WHEN usable = 1 THEN unique_slices END DESC NULLS LAST, ordinal"""
_MATCH = "CASE WHEN preference IS NULL OR fluid = preference THEN 1 ELSE 0 END"


def _picks_sql(order, name):
    """First picks as expressions: slot 0/2/4 first, then 1/3 among the rest."""
    return f"""{name}_open AS (SELECT s.*, slots.slot, preference, {_MATCH} AS match FROM rated s JOIN {_SLOT} ON s.plane = slots.plane WHERE num_slices > 0),
        {name}_first AS (SELECT study, plane, slot, series FROM {name}_open WHERE slot % 2 = 0 QUALIFY row_number() OVER (PARTITION BY study, slot ORDER BY match DESC, {order}) = 1),
        {name}_second AS (SELECT o.study, o.plane, o.slot, o.series FROM {name}_open o LEFT JOIN {name}_first f ON o.study = f.study AND o.plane = f.plane
            WHERE o.slot % 2 = 1 AND o.series IS DISTINCT FROM f.series QUALIFY row_number() OVER (PARTITION BY o.study, o.slot ORDER BY match DESC, {order}) = 1),
        {name} AS (SELECT study, slot, series FROM {name}_first UNION ALL SELECT study, slot, series FROM {name}_second)"""


_RATED = "WITH rated AS (SELECT c.*, threshold FROM candidates c JOIN thresholds t ON c.plane = t.plane)"


@query("w02_best_by_flag", sql("""
    SELECT study, plane || '_' || CASE WHEN fat = 1 THEN 'FS' ELSE 'nonFS' END AS slot, series FROM series WHERE num_slices > 0
    QUALIFY row_number() OVER (PARTITION BY study, plane, fat ORDER BY coalesce(fluid, -1) DESC, num_slices DESC, ordinal) = 1""", "series"))
def best_by_flag(spark, d):
    return selection.best_by_flag(m.series(spark, d), "study", catalog.series_type(F.col("plane"), F.col("fat")))


@query("w03_slots_in_order", sql(f"""
    WITH rated AS (SELECT * FROM series), {_picks_sql('ordinal', 'picks')} SELECT study, slot, series FROM picks""", "series"))
def slots_in_order(spark, d):
    return selection.select_slots(m.series(spark, d), "study")


def _rated(spark, d):
    """Rated series, written once: thresholds and both picks read them again."""
    rows = materialize(m.candidates(spark, d))
    return rows, m.train_thresholds(spark, d, rows)


@query("w04_slots_by_quality", sql(f"{_RATED}, {_picks_sql(_QORDER, 'picks')} SELECT study, slot, series FROM picks", "candidates", "thresholds"))
def slots_by_quality(spark, d):
    rows, thresholds = _rated(spark, d)
    return selection.select_slots_by_quality(rows, "study", thresholds, CROP_MM, IMAGE_SIZE)


_OK = f"usable = 1 AND coverage_mm >= threshold AND fov_mm >= {CROP_MM}"
_TWO = f"""{_RATED}, {_picks_sql(_QORDER, 'picks')},
    narrowed AS (SELECT *, max(match) OVER (PARTITION BY study, slot) AS best_match FROM picks_open),
    pool AS (SELECT * FROM narrowed n WHERE match = best_match AND {_OK} AND NOT EXISTS (SELECT 1 FROM picks p WHERE p.study = n.study AND p.series = n.series)
             AND EXISTS (SELECT 1 FROM picks p JOIN rated r ON p.series = r.series WHERE p.study = n.study AND p.slot = n.slot AND {_OK})),
    extra0 AS (SELECT study, plane, slot, series FROM pool WHERE slot % 2 = 0 QUALIFY row_number() OVER (PARTITION BY study, slot ORDER BY {_QORDER}) = 1),
    extra1 AS (SELECT q.study, q.plane, q.slot, q.series FROM pool q LEFT JOIN extra0 e ON q.study = e.study AND q.plane = e.plane
               WHERE q.slot % 2 = 1 AND q.series IS DISTINCT FROM e.series QUALIFY row_number() OVER (PARTITION BY q.study, q.slot ORDER BY {_QORDER}) = 1),
    two AS (SELECT study, slot, 1 AS place, series FROM picks UNION ALL SELECT study, slot, 2, series FROM extra0 UNION ALL SELECT study, slot, 2, series FROM extra1)"""


@query("w05_two_per_slot", sql(f"{_TWO} SELECT study, slot, place, series FROM two", "candidates", "thresholds"))
def two_per_slot(spark, d):
    rows, thresholds = _rated(spark, d)
    return selection.select_two_per_slot(rows, "study", thresholds, CROP_MM, IMAGE_SIZE)


@query("w05_slot_budgets", sql(f"""{_TWO} SELECT slot, place, count(*) AS picks, CAST(sum(list_extract(
    CASE place WHEN 1 THEN [23, 17, 15, 10, 15] ELSE [12, 8, 8, 5, 7] END, slot + 1)) AS BIGINT) AS windows FROM two GROUP BY 1, 2""", "candidates", "thresholds"))
def slot_budgets(spark, d):
    rows, thresholds = _rated(spark, d)
    picks = selection.select_two_per_slot(rows, "study", thresholds, CROP_MM, IMAGE_SIZE)
    return selection.slot_budgets(picks, "study").groupBy("slot", "place").agg(F.count(F.lit(1)).alias("picks"), F.sum("budget").alias("windows"))


_REPORT = f"""{_RATED}, {_picks_sql('ordinal', 'older')}, {_picks_sql(_QORDER, 'newer')},
    report AS (SELECT b.study, b.slot, o.series AS original_series, n.series AS selected_series, CAST(o.series IS DISTINCT FROM n.series AS INTEGER) AS changed
    FROM (SELECT study, slot FROM (SELECT DISTINCT study FROM series), {_SLOT}) b
    LEFT JOIN older o ON b.study = o.study AND b.slot = o.slot LEFT JOIN newer n ON b.study = n.study AND b.slot = n.slot)"""


def _selection_report(spark, d):
    rows, thresholds = _rated(spark, d)
    old = selection.select_slots(rows, "study")
    new = selection.select_slots_by_quality(rows, "study", thresholds, CROP_MM, IMAGE_SIZE)
    studies = table(spark, d, "orders").select(F.col("o_custkey").alias("study"))
    return selection.selection_report(old, new, studies, "study")


@query("w06_selection_report", sql(f"{_REPORT} SELECT * FROM report", "candidates", "thresholds"))
def selection_report(spark, d):
    return _selection_report(spark, d)


@query("a32_change_summary", sql(f"""{_REPORT} SELECT slot, count(*) AS slots, CAST(sum(changed) AS BIGINT) AS changed_slots,
    count(DISTINCT CASE WHEN changed = 1 THEN study END) AS changed_studies FROM report GROUP BY GROUPING SETS ((), (slot))""", "candidates", "thresholds"))
def change_summary(spark, d):
    return selection.change_summary(_selection_report(spark, d), "study")


_REPEAT = f"""SELECT c.*, {_TYPE} AS type, te, tr, part % 10 = 0 AS derived, CASE (c.series % 3 + CASE WHEN supp % 7 = 0 THEN 1 ELSE 0 END) % 3
    WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS axis FROM candidates c JOIN (SELECT * FROM ordered_slices WHERE idx = n // 2) s ON c.series = s.series"""


def _off(c):
    return f"abs({c} - b_{c}) > 0.15 * greatest({c}, b_{c})"


@query("j12_repeat_causes", sql(f"""
    SELECT cause, count(*) AS repeats, round(quantile_cont(angle, 0.5), 2) AS median_angle FROM (
    SELECT CASE WHEN {_off('te')} OR {_off('tr')} THEN 'contrast' WHEN derived OR b_derived THEN 'reconstruction' WHEN axis <> b_axis THEN 'angle'
           WHEN pixel_spacing_mm IS DISTINCT FROM b_pixel_spacing_mm OR unique_slices IS DISTINCT FROM b_unique_slices OR slice_spacing_mm IS DISTINCT FROM b_slice_spacing_mm THEN 'grid'
           ELSE 'rescan' END AS cause, CASE WHEN axis = b_axis THEN 0.0 ELSE 90.0 END AS angle
    FROM (SELECT *, {', '.join(f'lag({c}) OVER w AS b_{c}' for c in ['series', 'te', 'tr', 'derived', 'axis', 'pixel_spacing_mm', 'unique_slices', 'slice_spacing_mm'])}
          FROM ({_REPEAT}) WINDOW w AS (PARTITION BY study, type ORDER BY ordinal)) WHERE b_series IS NOT NULL) GROUP BY 1""", "candidates", "ordered_slices"))
def repeat_causes(spark, d):
    middle = catalog.middle_slice(m.ordered_slices(spark, d), "series", ["te", "tr", "part", "supp"])
    axis = (F.col("series") % 3 + F.when(F.col("supp") % 7 == 0, 1).otherwise(0)) % 3
    unit = lambda i: F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(3)])
    rows = m.candidates(spark, d).join(middle, "series").withColumn("type", catalog.series_type(F.col("plane"), F.col("fat")))
    rows = rows.withColumn("derived", F.col("part") % 10 == 0).withColumn("normal", F.when(axis == 0, unit(0)).when(axis == 1, unit(1)).otherwise(unit(2)))
    causes = selection.repeat_causes(rows, "study", check=m.series(spark, d).withColumn("type", catalog.series_type(F.col("plane"), F.col("fat"))).select("study", "type"))
    report = group_summary(causes, ["cause"], {"angle": {"median_angle": 0.5}}, [F.count(F.lit(1)).alias("repeats")], check=table(spark, d, "orders").select("o_orderkey"))
    return report.select("cause", "repeats", F.round("median_angle", 2).alias("median_angle"))


# Slice windows

@query("w01_spatial_order", sql("SELECT series, line, part, supp, idx, n FROM ordered_slices", "ordered_slices"))
def spatial_order(spark, d):
    return m.ordered_slices(spark, d).select("series", *FILE_ORDER, "idx", "n")


_TRIPLES = "SELECT series, idx, greatest(idx - 1, 0) AS prev_idx, least(idx + 1, n - 1) AS next_idx FROM ordered_slices"


@query("w07_adjacent_triples", sql(_TRIPLES, "ordered_slices"))
def adjacent_triples(spark, d):
    return windows.adjacent_triples(m.ordered_slices(spark, d)).select("series", "idx", "prev_idx", "next_idx")


@query("w07_conversation_turns", """
    SELECT conv_id, turn, coalesce(lag(role) OVER w, role) AS before, coalesce(lead(role) OVER w, role) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_turns(spark, d):
    seq = Sequence(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.col("turn")])
    rows = seq.neighbour("_b", F.col("role")).neighbour("_a", F.col("role"), ahead=True).df
    return rows.select("conv_id", "turn", F.coalesce("_b", "role").alias("before"), F.coalesce("_a", "role").alias("after"))


@query("u06_needed_slices", sql(f"SELECT DISTINCT series, unnest([prev_idx, idx, next_idx]) AS idx FROM ({_TRIPLES})", "ordered_slices"))
def needed_slices(spark, d):
    triples = windows.adjacent_triples(m.ordered_slices(spark, d))
    return windows.needed_slices(triples, ["series"])


@query("w08_groups_of_three", sql("""
    SELECT series, grp, first_idx || ',' || least(first_idx + 1, last_idx) || ',' || least(first_idx + 2, last_idx) AS indices, round(centre, 6) AS centre FROM (
    SELECT series, idx // 3 AS grp, min(idx) AS first_idx, max(idx) AS last_idx, avg(position) AS centre FROM ordered_slices GROUP BY 1, 2)""", "ordered_slices"))
def groups_of_three(spark, d):
    rows = windows.groups_of_three(m.ordered_slices(spark, d), ["series"], "position")
    return rows.select("series", "grp", F.array_join(F.transform("indices", lambda i: i.cast("string")), ",").alias("indices"), F.round("centre", 6).alias("centre"))


@query("w09_position_gaps", sql("""
    SELECT series, position, round(position - lag(position) OVER (PARTITION BY series ORDER BY position), 6) AS gap FROM (SELECT DISTINCT series, position FROM slices)
    QUALIFY gap IS NOT NULL""", "slices"))
def position_gaps(spark, d):
    rows = windows.position_gaps(m.slices(spark, d), ["series"], "position", check=_keys(spark, d))
    return rows.withColumn("gap", F.round("gap", 6))


@query("w10_moving_mean", """
    SELECT user_id, event_id, step, round(mean, 6) AS moving_mean FROM (
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
           avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 19 PRECEDING) AS mean FROM events) WHERE step >= 20""")
def moving_mean(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "value")
    rows = windows.moving_mean(events, ["user_id"], [F.col("ts"), F.col("event_id")], "value", 20)
    return rows.select("user_id", "event_id", "step", F.round("moving_mean", 6).alias("moving_mean"))


def _history(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.when(F.col("event_id") % 13 != 0, F.col("value")).alias("auc"))


_HISTORY = "(SELECT user_id AS run, event_id AS epoch, CASE WHEN event_id % 13 <> 0 THEN value END AS auc FROM events)"


@query("w11_top_epochs", f"""
    SELECT run, epoch, auc, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY auc DESC, epoch) AS rank FROM {_HISTORY} WHERE auc IS NOT NULL) WHERE rank <= 3""")
def top_epochs(spark, d):
    return windows.top_epochs(_history(spark, d), ["run"], "auc", 3)


@query("w12_best_epoch", f"""
    SELECT run, epoch, auc FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY auc DESC, epoch) AS rank FROM {_HISTORY} WHERE auc IS NOT NULL) WHERE rank = 1""")
def best_epoch(spark, d):
    return windows.best_epoch(_history(spark, d), ["run"], "auc")


# Nearest positions

@query("j09_nearest_position", sql("""
    WITH span AS (SELECT series, min(position) AS lo, max(position) AS hi FROM slices GROUP BY 1),
    targets AS (SELECT series, j, CASE WHEN j = 5 THEN hi ELSE j * ((hi - lo) / 5) + lo END AS target FROM span, range(6) r(j))
    SELECT t.series, CAST(t.j AS INTEGER) AS j, CAST(arg_min(o.idx, (abs(o.position - t.target), o.idx)) AS BIGINT) AS idx
    FROM targets t JOIN ordered_slices o ON t.series = o.series GROUP BY 1, 2""", "ordered_slices"))
def nearest_position(spark, d):
    return neighbors.evenly_spaced(m.ordered_slices(spark, d), ["series"], "position", 6).select("series", "j", F.col("idx").cast("long").alias("idx"))


def _near(side, offset):
    return f"""(SELECT series, anchor, arg_min(idx, (abs(idx - anchor), idx)) AS {side}_idx FROM (
        SELECT *, min(dist) OVER (PARTITION BY series, anchor) AS best FROM (
        SELECT a.series, a.idx AS anchor, o.idx, abs(o.position - a.position) AS dist, abs(o.position - (a.position + {offset})) AS err,
               min(abs(o.position - (a.position + {offset}))) OVER (PARTITION BY a.series, a.idx) AS least_err
        FROM ordered_slices a JOIN ordered_slices o ON a.series = o.series) WHERE err <= least_err + 1e-4) WHERE dist <= best + 1e-4 GROUP BY 1, 2)"""


@query("j10_physical_neighbours", sql(f"""
    SELECT p.series, p.anchor AS idx, prev_idx, next_idx FROM {_near('prev', -60.0)} p JOIN {_near('next', 60.0)} n ON p.series = n.series AND p.anchor = n.anchor""", "ordered_slices"))
def physical_neighbours(spark, d):
    rows = neighbors.physical_neighbours(m.ordered_slices(spark, d), ["series"], "position", 60.0, check=_keys(spark, d))
    return rows.select("series", "idx", "prev_idx", "next_idx")


@query("a31_offset_report", sql(f"""
    WITH moved AS (SELECT plane AS slot, o2.position - o1.position AS negative, o3.position - o1.position AS positive,
                          CAST(prev_idx <> greatest(p.anchor - 1, 0) OR next_idx <> least(p.anchor + 1, o1.n - 1) AS INTEGER) AS changed
        FROM {_near('prev', -60.0)} p JOIN {_near('next', 60.0)} n ON p.series = n.series AND p.anchor = n.anchor JOIN series s ON s.series = p.series
        JOIN ordered_slices o1 ON o1.series = p.series AND o1.idx = p.anchor JOIN ordered_slices o2 ON o2.series = p.series AND o2.idx = prev_idx
        JOIN ordered_slices o3 ON o3.series = p.series AND o3.idx = next_idx)
    SELECT slot, count(*) AS windows, CAST(sum(changed) AS BIGINT) AS changed_windows, round(sum(changed) / count(*), 6) AS changed_fraction, """ + ", ".join(
    f"round(quantile_cont({c}, {q}), 4) AS {c}_{n}" for c in ("negative", "positive") for n, q in (("p0", 0), ("p10", .1), ("p50", .5), ("p90", .9), ("p100", 1))) +
    " FROM moved GROUP BY GROUPING SETS ((), (slot))", "ordered_slices", "series"))
def offset_report(spark, d):
    near = neighbors.physical_neighbours(m.ordered_slices(spark, d), ["series"], "position", 60.0, check=_keys(spark, d))
    rows = near.withColumn("negative", F.col("prev_pos") - F.col("position")).withColumn("positive", F.col("next_pos") - F.col("position"))
    sizes = _keys(spark, d).groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(sizes, "series").join(m.series(spark, d).select("series", F.col("plane").alias("slot")), "series")
    moved = (F.col("prev_idx") != F.greatest(F.col("idx") - 1, F.lit(0))) | (F.col("next_idx") != F.least(F.col("idx") + 1, F.col("n") - 1))
    report = windows.offset_report(rows.withColumn("changed", moved.cast("int")), "slot", ["negative", "positive"], "changed", check=_keys(spark, d))
    return report.select(*[F.round(c, 4).alias(c) if "_p" in c else (F.round(c, 6).alias(c) if c == "changed_fraction" else F.col(c)) for c in report.columns])


def _anchor_sql(count):
    """One step per pick: the nearest row behind the last pick that leaves enough rows for the rest."""
    steps = [f"p0 AS (SELECT series, CAST(-1 AS BIGINT) AS last FROM span WHERE n >= {count} AND hi > lo)"]
    for j in range(count):
        target = "hi" if j == count - 1 else f"{j} * ((hi - lo) / {count - 1}) + lo"
        steps.append(f"""p{j + 1} AS (SELECT p.series, arg_min(o.idx, (abs(o.position - ({target})), o.idx)) AS last FROM p{j} p JOIN span s ON p.series = s.series
            JOIN ordered_slices o ON o.series = p.series AND o.idx > p.last AND o.idx <= s.n - {count - j} GROUP BY p.series)""")
    picks = " UNION ALL ".join(f"SELECT series, {j} AS j, last AS idx, 'spread' AS state FROM p{j + 1}" for j in range(count))
    return f"""span AS (SELECT series, min(position) AS lo, max(position) AS hi, count(*) AS n FROM ordered_slices GROUP BY 1), {', '.join(steps)}
        SELECT series, CAST(j AS INTEGER) AS j, CAST(idx AS BIGINT) AS idx, state FROM ({picks}
        UNION ALL SELECT series, j, CAST(round_even(j * (n - 1) / {count - 1}, 0) AS BIGINT), 'flat' FROM span, range({count}) t(j) WHERE n >= {count} AND hi = lo
        UNION ALL SELECT series, NULL, NULL, 'short' FROM span WHERE n < {count})"""


@query("j11_unique_anchors", sql("WITH " + _anchor_sql(3), "ordered_slices"))
def unique_anchors(spark, d):
    """Three anchors per series; a series with fewer slices stays in the result with its state."""
    ordered = stored_slices(spark, d)
    facts = ordered.groupBy("series").agg(F.max("n").alias("_rows"), (F.min("position") == F.max("position")).alias("_flat"))
    state = F.when(F.col("_rows") < 3, "short").when(F.col("_flat"), "flat").otherwise("spread")
    enough = ordered.where(F.col("n") >= 3)
    picks = neighbors.unique_anchors(enough, ["series"], "position", 3)
    return facts.select("series", state.alias("state")).join(picks, "series", "left").select(
        "series", F.col("j").cast("int").alias("j"), F.col("idx").cast("long").alias("idx"), "state")


def stored_slices(spark, d):
    """The ordered slices, written once since the anchors read them several times."""
    return materialize(m.ordered_slices(spark, d).select("series", "idx", "n", "position"))
