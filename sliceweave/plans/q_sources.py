"""Scans and sinks: tables pass through files in the shared folder and come back under a contract."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceweave.functions.text import report_group
from sliceweave.operators import catalog, ensemble, extraction, guards
from sliceweave.plans import models as m
from sliceweave.plans.models import TARGETS, sql
from sliceweave.plans.registry import query
from sliceweave.schemas import ATTEMPT, SERIES, prediction_schema
from sliceweave.session import scratch_path
from sliceweave.sources import readers, sinks, snapshots
from sliceweave.sources.tables import table
from pyspark.sql import types as T

# White space as the Unicode property, spelled out for the SQL side.
SPACE = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def group_sql(column: str) -> str:
    return f"sha256(trim(lower(regexp_replace({column}, '{SPACE}', ' ', 'g'))))"


def _study_csv(spark, d):
    path = scratch_path(spark, "studies")
    rows = m.studies(spark, d).select(F.col("uid").cast("string").alias("StudyInstanceUID"), F.col("report").alias("Report"),
                                      F.col("quality").cast("int").cast("string").alias("quality"), F.col("toxic").cast("int").cast("string").alias("toxic"))
    sinks.write_csv(rows, path, per_file=sinks.TEXT_ROWS)
    return path


@query("s01_study_scan", """
    SELECT CAST(doc_id AS VARCHAR) AS uid, sha256(text) AS digest, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic
    FROM documents LEFT JOIN labels USING (doc_id)""")
def study_scan(spark, d):
    rows = readers.read_studies(spark, _study_csv(spark, d), ["quality", "toxic"])
    return rows.select(F.col("StudyInstanceUID").alias("uid"), F.sha2("Report", 256).alias("digest"), "quality", "toxic")


@query("s01_study_contract", """
    SELECT count(*) AS rows, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS empty_keys,
           count(*) FILTER (trim(text) = '') AS blank_reports FROM documents""")
def study_contract(spark, d):
    return readers.study_contract(table(spark, d, "documents"), "doc_id", "text")


@query("s02_series_table", sql("""
    SELECT CAST(series AS VARCHAR) AS series, CAST(study AS VARCHAR) AS study, fluid, fat, plane FROM series""", "series"))
def series_table(spark, d):
    path = scratch_path(spark, "series")
    rows = m.series(spark, d).select(F.col("study").cast("string").alias("StudyInstanceUID"), F.col("series").cast("string").alias("SeriesInstanceUID"),
                                     F.col("fluid").alias("Fluid_Sensitive"), F.col("fat").alias("Fat_Suppression"), F.col("plane").alias("Anatomical_Plane"))
    sinks.write_csv(rows, path)
    return readers.read_csv(spark, path, SERIES).toDF("study", "series", "fluid", "fat", "plane")


@query("s03_slice_counts", r"""
    SELECT folder, count(*) AS num_slices FROM (SELECT regexp_extract(url, '^https?://([^/]+/[^/?]+)', 1) AS folder FROM pages)
    WHERE folder <> '' GROUP BY 1""")
def slice_counts(spark, d):
    return catalog.slice_counts(table(spark, d, "pages"), r"^https?://([^/]+/[^/?]+)", "url")


@query("s03_series_with_counts", sql("SELECT study, series, num_slices FROM series", "series"))
def series_with_counts(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("series")).agg(F.count(F.lit(1)).alias("num_slices"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("study"), F.col("o_orderkey").alias("series"))
    return catalog.attach_slice_counts(orders, counts, "series")


@query("s04_header_scan", sql("""
    SELECT series, count(*) AS files, count(*) FILTER (unreadable) AS header_errors,
           count(*) FILTER (NOT unreadable AND supp % 41 = 0) AS geometry_errors FROM headers GROUP BY 1""", "headers"))
def header_scan(spark, d):
    return catalog.header_scan(m.headers(spark, d), "series", F.col("unreadable"))


def _log(spark, d):
    rows = m.attempts(spark, d)
    usage = F.struct("input_tokens", "output_tokens", "total_tokens", F.lit(None).cast("long").alias("cached_input_tokens"),
                     F.lit(None).cast("long").alias("reasoning_tokens"))
    return rows.select(F.col("uid").cast("string").alias("uid"), "attempt", "started_at", F.col("elapsed").alias("elapsed_seconds"), "status",
                       "http_status", F.lit(None).cast("string").alias("error"), usage.alias("usage"))


@query("s05_strict_log", sql("""
    SELECT CAST(uid AS VARCHAR) AS uid, attempt, status, total_tokens, elapsed FROM attempts""", "attempts"))
def strict_log(spark, d):
    path = scratch_path(spark, "log")
    sinks.write_json(_log(spark, d), path)
    return readers.read_jsonl(spark, path, ATTEMPT).select("uid", "attempt", "status", "usage.total_tokens", F.col("elapsed_seconds").alias("elapsed"))


@query("s05_bad_lines", """SELECT sha256(url) AS line, count(*) AS lines FROM pages GROUP BY 1""")
def bad_lines(spark, d):
    path = scratch_path(spark, "mixed")
    pages = table(spark, d, "pages").select("url")
    good = pages.select(F.to_json(F.struct(F.col("url").alias("uid"))).alias("value"))
    good.unionByName(pages.select(F.col("url").alias("value"))).write.text(path)
    bad = readers.bad_json_lines(spark, path, ATTEMPT)
    return bad.groupBy(F.sha2("_bad", 256).alias("line")).agg(F.count(F.lit(1)).alias("lines"))


@query("s06_unique_read", "SELECT CAST(doc_id AS VARCHAR) AS uid, quality, toxic FROM labels")
def unique_read(spark, d):
    path = scratch_path(spark, "index")
    sinks.write_csv(table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("uid"), "quality", "toxic"), path)
    schema = T.StructType([T.StructField("uid", T.StringType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
    return readers.read_unique(spark, path, schema, "uid")


def _prediction_table(spark, d):
    rows = m.label_sources(spark, d)
    return rows.select(F.col("uid").cast("string").alias("StudyInstanceUID"), "fold", *[F.col(f"p1__{t}").alias(t) for t in TARGETS])


@query("s07_fold_predictions", sql("""
    SELECT CAST(uid AS VARCHAR) AS "StudyInstanceUID", fold, max(p1) FILTER (target = 'discount') AS discount, max(p1) FILTER (target = 'tax') AS tax,
           max(p1) FILTER (target = 'quantity') AS quantity, max(p1) FILTER (target = 'returned') AS returned FROM cells GROUP BY 1, 2""", "cells"))
def fold_predictions(spark, d):
    root = scratch_path(spark, "predictions")
    rows = _prediction_table(spark, d)
    rows.withColumn("part", F.col("fold")).write.partitionBy("part").options(header="true").csv(root)
    parts = []
    for fold in range(5):
        expected = rows.where(F.col("fold") == fold).select("StudyInstanceUID")
        parts.append(readers.read_predictions(spark, f"{root}/part={fold}", expected, fold, TARGETS))
    return ensemble.checked_union(parts, ["StudyInstanceUID"])


@query("s07_prediction_report", sql("""
    SELECT count(DISTINCT uid) AS rows, CAST(0 AS BIGINT) AS duplicate_rows, CAST(0 AS BIGINT) AS empty_keys, CAST(0 AS BIGINT) AS bad_values,
           count(DISTINCT uid) FILTER (fold <> 0) AS other_fold FROM cells""", "cells"))
def prediction_report(spark, d):
    return ensemble.prediction_report(_prediction_table(spark, d), "StudyInstanceUID", TARGETS, fold=0)


@query("s05_bad_line_numbers", """
    SELECT part, CAST(line AS BIGINT) AS line, bad FROM (
        SELECT doc_id % 8 AS part, row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) AS line, doc_id, '{"uid": "' || doc_id || '", ' AS bad FROM documents) WHERE doc_id % 13 = 5""")
def bad_line_numbers(spark, d):
    """Eight logs with broken lines; each is found by file and number."""
    path, uid = scratch_path(spark, "broken"), F.col("doc_id").cast("string")
    good = F.to_json(F.struct(uid.alias("uid"), F.lit(1).alias("attempt")))
    text = F.when(F.col("doc_id") % 13 == 5, F.concat(F.lit('{"uid": "'), uid, F.lit('", '))).otherwise(good)
    logs = table(spark, d, "documents").select((F.col("doc_id") % 8).alias("part"), "doc_id", text.alias("value"))
    logs.repartition(8, "part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    rows = readers.bad_json_lines(spark, path, ATTEMPT)
    return rows.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "line", F.col("_bad").alias("bad"))


@query("s08_append_log", sql("SELECT status, count(*) AS attempts, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM attempts GROUP BY 1", "attempts"))
def append_log(spark, d):
    path = scratch_path(spark, "appended")
    rows = _log(spark, d)
    sinks.append_jsonl(rows.where("status = 'SUCCESS'"), path)
    sinks.append_jsonl(rows.where("status <> 'SUCCESS'"), path)
    return readers.read_jsonl(spark, path, ATTEMPT).groupBy("status").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum("usage.total_tokens").alias("total_tokens"))


@query("s09_json_sink", sql("SELECT uid, target, old, new FROM cells", "cells"))
def json_sink(spark, d):
    path = scratch_path(spark, "cells")
    rows = m.cells(spark, d).select("uid", "target", "old", "new")
    sinks.write_json(rows, path)
    return readers.read_jsonl(spark, path, rows.schema)


@query("s09_versioned_sink", sql("SELECT uid, target, new AS value FROM cells", "cells"))
def versioned_sink(spark, d):
    """The second version replaces the first; a job that fails after it changes nothing."""
    root = scratch_path(spark, "versions")
    rows = m.cells(spark, d).select("uid", "target", F.col("old").alias("value"), "new")
    sinks.replace_json(rows.drop("new"), root)
    latest = rows.select("uid", "target", F.col("new").alias("value"))
    sinks.replace_json(latest, root)
    try:
        sinks.replace_json(latest.withColumn("value", F.raise_error(F.lit("a task fails")).cast("double")), root)
    except PySparkException:
        pass
    return readers.read_jsonl(spark, snapshots.current(spark, root), latest.schema)


@query("s11_submission", sql("SELECT CAST(uid AS VARCHAR) AS uid, " + ", ".join(
    f"max(CAST((p0 + p1 + p2) / 3 AS FLOAT)) FILTER (target = '{t}') AS {t}" for t in TARGETS) + " FROM cells GROUP BY 1", "cells"))
def submission(spark, d):
    rows = m.cells(spark, d).select(F.col("uid").cast("string").alias("uid"), "target", F.explode(F.array("p0", "p1", "p2")).alias("p"))
    mean = ensemble.enforce_mean(ensemble.mean_probability(rows, ["uid", "target"], "p"), 3)
    sample = m.members(spark, d).select(F.col("uid").cast("string").alias("uid"), F.col("uid").alias("ordinal"))
    path = scratch_path(spark, "submission")
    sinks.write_submission(ensemble.submission(sample, mean, "uid", TARGETS, "ordinal"), path, "uid", TARGETS, "ordinal")
    return readers.read_csv(spark, path, T.StructType([T.StructField("uid", T.StringType()), *[T.StructField(t, T.FloatType()) for t in TARGETS]]))


@query("s12_split_export", sql("SELECT uid, fold, split FROM members", "members"))
def split_export(spark, d):
    from sliceweave.operators import splits

    root = scratch_path(spark, "split")
    rows = m.members(spark, d)
    manifest = splits.manifest(rows, m.wide(spark, d, "new"), "uid", TARGETS, "given", 42, 5)
    sinks.write_split(rows, manifest, root)
    sinks.write_split(rows, manifest, root)
    return spark.read.parquet(f"{root}/folds").select("uid", "fold", "split")


@query("s12_whole_export", sql("""
    SELECT 'folds' AS output, count(*) AS n, false AS refused FROM members UNION ALL SELECT 'targets', (SELECT count(DISTINCT uid) FROM cells), false
    UNION ALL SELECT 'distribution', (SELECT count(*) FROM (SELECT DISTINCT members.fold, target FROM cells JOIN members USING (uid))), false
    UNION ALL SELECT 'manifest', 1, false UNION ALL SELECT 'rival', 0, true""", "members", "cells"))
def whole_export(spark, d):
    """All four outputs of a split, read back; a rival with another seed is refused."""
    from sliceweave.operators import splits
    from sliceweave.operators.reshape import melt

    root = scratch_path(spark, "split")
    rows, wide = m.members(spark, d), m.wide(spark, d, "new")
    counts = splits.distribution(melt(wide, TARGETS, ["uid"]), rows, "uid", "value")
    refused = False
    for seed in (42, 42, 43):
        try:
            snapshots.export_split(root, rows, wide, counts, splits.manifest(rows, wide, "uid", TARGETS, "given", seed, 5))
        except guards.ContractError:
            refused = seed == 43
    sizes = [df.agg(F.lit(name).alias("output"), F.count(F.lit(1)).alias("n"), F.lit(False).alias("refused")) for name, df in snapshots.read_split(spark, root).items()]
    rival = spark.range(1).select(F.lit("rival").alias("output"), F.lit(0).cast("long").alias("n"), F.lit(refused).alias("refused"))
    return reduce(DataFrame.union, [*sizes, rival])


@query("s13_report_manifest", f"""
    SELECT doc_id AS uid, sha256(text) AS report_hash, {group_sql('text')} AS report_group, lang, 'READY' AS input_state FROM documents""")
def report_manifest(spark, d):
    return extraction.report_manifest(m.studies(spark, d), report_group(F.col("report")))
