"""Readers with fixed schemas and contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sliceweave.functions.labels import col
from sliceweave.operators import guards
from sliceweave.operators.ensemble import prediction_report
from sliceweave.schemas import SERIES, TARGETS, prediction_schema, study_schema

CSV = {"header": "true", "quote": '"', "escape": '"', "charToEscapeQuoteEscaping": '"', "encoding": "UTF-8", "mode": "FAILFAST",
       "enforceSchema": "false", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """CSV; a header that differs from the schema fails. Only a table with line breaks inside quotes needs
    ``multi_line``, which keeps each of its files in one task (``sinks.write_csv`` bounds the files by ``per_file``)."""
    return spark.read.options(**CSV, multiLine=str(multi_line).lower()).schema(schema).csv(path)


def file_order() -> Column:
    """Sorts rows as their files hold them: by file, part of the file, and row, however parts are dealt to tasks."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def study_contract(studies: DataFrame, key: str = "StudyInstanceUID", report: str = "Report") -> DataFrame:
    """One row: rows, duplicate and empty keys, blank reports."""
    blank = F.col(report).isNull() | (F.regexp_replace(F.col(report), r"(?U)\s+", "") == "")
    return guards.contract_summary(studies, key, {"blank_reports": blank})


def read_studies(spark: SparkSession, path: str, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Study table after its contract held: unique keys and no empty report."""
    studies = read_csv(spark, path, study_schema(targets), multi_line=True)
    guards.enforce(study_contract(studies))
    return studies


def read_catalogue(spark: SparkSession, root: str, targets: Sequence[str] = TARGETS) -> dict[str, DataFrame]:
    """The five catalogue tables, each with its fixed schema and an explicit file order for series."""
    key = T.StructType([T.StructField("StudyInstanceUID", T.StringType())])
    ordinal = lambda df: df.withColumn("ordinal", file_order())
    return {
        "train": read_csv(spark, f"{root}/train.csv", study_schema(targets), multi_line=True),
        "train_series": ordinal(read_csv(spark, f"{root}/train_series.csv", SERIES)),
        "test": read_csv(spark, f"{root}/test.csv", key),
        "test_series": ordinal(read_csv(spark, f"{root}/test_series.csv", SERIES)),
        "sample_submission": ordinal(read_csv(spark, f"{root}/sample_submission.csv", prediction_schema(targets, fold=False))),
    }


def read_listing(spark: SparkSession, root: str, glob: str = "*.dcm") -> DataFrame:
    """Path, size and change time of every file below ``root``; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select("path", "length", "modificationTime")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Strict JSON lines: one bad line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """File, line number (from 1) and text of every line that is not valid JSON of the schema.

    A file is read in blocks by many tasks. One pass counts the lines of each block and notes its bad ones by their place;
    the number of a line is its place plus the lines of the blocks before it in the file, one row per block.
    """
    audit = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("id"), "value")
    parsed = F.from_json("value", audit, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = lines.withColumn("_bad", parsed["_bad"])
    # A block is read by one task, so the ids of its lines follow each other.
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("id").alias("first"),
        F.collect_list(F.when(F.col("_bad").isNotNull(), F.struct("id", "_bad"))).alias("found"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocks.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    each = numbered.select("file", "before", "first", F.explode("found").alias("bad"))
    return each.select("file", (F.col("before") + F.col("bad.id") - F.col("first") + 1).alias("line"), F.col("bad._bad").alias("_bad"))


def read_unique(spark: SparkSession, path: str, schema: T.StructType, key: str = "StudyInstanceUID") -> DataFrame:
    """CSV whose key must be unique."""
    rows = read_csv(spark, path, schema)
    guards.enforce_empty(guards.duplicate_keys(rows, [key]), f"duplicate {key} in {path}")
    return rows


def read_predictions(spark: SparkSession, path: str, expected: DataFrame, fold: int, targets: Sequence[str] = TARGETS) -> DataFrame:
    """Fold predictions: exact columns, one row per expected study, finite values in [0, 1]."""
    rows = read_csv(spark, path, prediction_schema(targets))
    guards.enforce(prediction_report(rows, "StudyInstanceUID", targets, fold))
    guards.enforce_empty(guards.key_difference(rows, expected, ["StudyInstanceUID"]), "prediction studies differ from the fold")
    return rows.select("StudyInstanceUID", "fold", *[col(t) for t in targets])
