"""Fixed schemas and fixed values. Every read names its schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# The label columns, in their export order.
TARGETS = ["ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Medial OA", "Lateral OA", "PF OA",
           "Effusion", "Synovitis", "Baker's", "Contusion", "Fracture"]
# Label groups by cause.
TARGET_GROUPS = {
    "any_trauma": ["ACL", "MCL", "Contusion", "Fracture"],
    "any_oa": ["Medial OA", "Lateral OA", "PF OA"],
    "any_fluid": ["Effusion", "Synovitis", "Baker's"],
}
# Text forms of a tri-state label.
LABEL_WORDS = {"YES": 1.0, "Y": 1.0, "TRUE": 1.0, "NO": 0.0, "N": 0.0, "FALSE": 0.0, "UNK": 0.5, "UNKNOWN": 0.5}
# Training weight of each evidence strength.
EVIDENCE_WEIGHTS = {"DIRECT": 1.0, "PARTIAL": 0.35, "CONFLICTING": 0.1, "INSUFFICIENT": 0.0}
# States of a finding in a report, and scopes of a report.
STATES = ["PRESENT", "ABSENT", "UNCERTAIN", "NOT_MENTIONED"]
SCOPES = ["KNEE", "OTHER", "UNCLEAR"]
# Slots in order, with plane, preferred flag and window budgets.
SLOTS = [(0, "Sagittal", 1, 23, 12), (1, "Sagittal", 0, 17, 8), (2, "Coronal", 1, 15, 8),
         (3, "Coronal", 0, 10, 5), (4, "Axial", None, 15, 7)]
PLANES = ["Sagittal", "Coronal", "Axial"]
# Sampling weight of each slot.
SLOT_WEIGHTS = [7.0, 5.0, 5.0, 3.0, 4.0]

SERIES = T.StructType([
    T.StructField("StudyInstanceUID", T.StringType()),
    T.StructField("SeriesInstanceUID", T.StringType()),
    T.StructField("Fluid_Sensitive", T.IntegerType()),
    T.StructField("Fat_Suppression", T.IntegerType()),
    T.StructField("Anatomical_Plane", T.StringType()),
])

HEADER = T.StructType([
    T.StructField("series", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("orientation", T.ArrayType(T.DoubleType())),
    T.StructField("position", T.ArrayType(T.DoubleType())),
    T.StructField("pixel_spacing", T.ArrayType(T.DoubleType())),
    T.StructField("rows", T.IntegerType()),
    T.StructField("columns", T.IntegerType()),
    T.StructField("te", T.DoubleType()),
    T.StructField("tr", T.DoubleType()),
])

USAGE = T.StructType([T.StructField(name, T.LongType()) for name in
                      ["input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "reasoning_tokens"]])

ATTEMPT = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("attempt", T.LongType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("status", T.StringType()),
    T.StructField("http_status", T.IntegerType()),
    T.StructField("error", T.StringType()),
    T.StructField("usage", USAGE),
])

FINDING = T.StructType([
    T.StructField("report_status", T.StringType()),
    T.StructField("label", T.DoubleType()),
    T.StructField("evidence_strength", T.StringType()),
    T.StructField("evidence", T.ArrayType(T.StringType())),
    T.StructField("score_reason", T.StringType()),
    T.StructField("uncertainty_reason", T.StringType()),
])

RESPONSE = T.StructType([
    T.StructField("uid", T.StringType()),
    T.StructField("report_scope", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), FINDING)),
])


def study_schema(targets: Sequence[str] = TARGETS) -> T.StructType:
    return T.StructType([T.StructField("StudyInstanceUID", T.StringType()), T.StructField("Report", T.StringType()),
                         *[T.StructField(name, T.StringType()) for name in targets]])


def prediction_schema(targets: Sequence[str] = TARGETS, fold: bool = True) -> T.StructType:
    return T.StructType([T.StructField("StudyInstanceUID", T.StringType()),
                         *([T.StructField("fold", T.IntegerType())] if fold else []),
                         *[T.StructField(name, T.DoubleType()) for name in targets]])
