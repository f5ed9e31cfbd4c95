"""Structured answers about reports: schema check, evidence check, masking and exports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.functions.text import digest
from sliceweave.operators.reshape import to_wide
from sliceweave.schemas import EVIDENCE_WEIGHTS, RESPONSE, SCOPES, STATES

# Issue codes of the evidence check and the default reason text.
NOT_VERBATIM = "EVIDENCE_NOT_VERBATIM"
UNMENTIONED_EVIDENCE = "NOT_MENTIONED_WITH_EVIDENCE"
MISSING_EVIDENCE = "MISSING_EVIDENCE"
UNMENTIONED_SCORE = "UNMENTIONED_WITH_SCORE"
ABSENT_POSITIVE = "ABSENT_WITH_POSITIVE_SCORE"
WRONG_SCOPE = "NON_KNEE_OR_UNCLEAR_SCOPE"
DOWNWEIGHTED = "UNCERTAIN_DIRECT_DOWNWEIGHTED"
DEFAULT_REASON = "报告未提及或证据不足"

FIELDS = [field.name for field in RESPONSE["labels"].dataType.valueType.fields]


def requests(rows: DataFrame, uid: str = "uid", report: str = "report") -> DataFrame:
    """What leaves the system: the key and the report, never a label column."""
    return rows.select(F.col(uid).alias("uid"), F.col(report).alias("report"))


def _every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def parse_responses(rows: DataFrame, targets: Sequence[str], response: str = "response") -> DataFrame:
    """Adds the parsed ``answer`` and ``rejected``: a reason, or NULL for an acceptable answer.

    Required keys, no extra keys, known states, strengths and scopes, a label
    that is null or in [0.001, 0.999], no empty quote, and an echoed uid.
    """
    raw = F.from_json(F.col(response), "uid string, report_scope string, labels map<string, string>")
    outer = F.json_object_keys(F.col(response))
    # One row in, one row out: the optimizer does not copy what a generator makes into later expressions, so a text is parsed once.
    parsed = rows.select("*", F.inline(F.array(F.struct(F.from_json(F.col(response), RESPONSE).alias("answer"), raw.alias("_raw"), outer.alias("_outer")))))
    expected, fields = sorted(targets), sorted(FIELDS)
    same = lambda keys, names: F.coalesce(F.sort_array(keys) == F.array(*map(F.lit, names)), F.lit(False))
    findings, texts = F.map_values("answer.labels"), F.map_values("_raw.labels")

    def good(item: Column) -> Column:
        label = item["label"]
        return F.coalesce(_every([
            item["report_status"].isin(STATES), item["evidence_strength"].isin(list(EVIDENCE_WEIGHTS)),
            label.isNull() | ((label >= 0.001) & (label <= 0.999)), item["evidence"].isNotNull(),
            F.forall(item["evidence"], lambda quote: F.coalesce(F.length(quote) >= 1, F.lit(False))),
            item["score_reason"].isNotNull(), item["uncertainty_reason"].isNotNull()]), F.lit(False))

    # A quoted quote is escaped inside JSON text, so this only meets the key itself.
    typed = lambda text: ~text.rlike(r'"label"\s*:\s*["\[{tf]')
    shape = (same(F.col("_outer"), ["labels", "report_scope", "uid"]) & same(F.map_keys("answer.labels"), expected)
             & F.coalesce(F.forall(texts, lambda text: same(F.json_object_keys(text), fields) & typed(text)), F.lit(False)))
    reason = (F.when(F.col("answer").isNull() | F.col("_outer").isNull(), "not JSON").when(~shape, "keys")
              .when(~F.coalesce(F.col("answer.report_scope").isin(SCOPES), F.lit(False)), "scope")
              .when(~F.coalesce(F.forall(findings, good), F.lit(False)), "finding")
              .when(~F.col("answer.uid").eqNullSafe(F.col("uid")), "uid"))
    return parsed.withColumn("rejected", reason).drop("_raw", "_outer")


def findings(parsed: DataFrame) -> DataFrame:
    """Accepted answers as one row per target."""
    return parsed.where(F.col("rejected").isNull()).select(
        "uid", "report", F.col("answer.report_scope").alias("scope"), F.explode("answer.labels").alias("target", "f")).select(
        "uid", "report", "scope", "target", *[F.col(f"f.{name}").alias(name) for name in FIELDS])


def issue_list(report: Column, scope: Column, status: Column, label: Column, evidence: Column) -> Column:
    """Issue codes of one finding, in fixed order."""
    empty = F.size(evidence) == 0
    found = F.array(
        F.when(~F.forall(evidence, lambda quote: F.contains(report, quote)), NOT_VERBATIM),
        F.when((status == "NOT_MENTIONED") & ~empty, UNMENTIONED_EVIDENCE),
        F.when((status != "NOT_MENTIONED") & empty, MISSING_EVIDENCE),
        F.when((status == "NOT_MENTIONED") & label.isNotNull(), UNMENTIONED_SCORE),
        F.when((status == "ABSENT") & F.coalesce(label > 0.5, F.lit(False)), ABSENT_POSITIVE),
        F.when(scope != "KNEE", WRONG_SCOPE))
    return F.array_compact(found)


def validate_findings(rows: DataFrame) -> DataFrame:
    """Masks findings with issues, lowers unsure direct evidence and fills blank reasons."""
    c = F.col
    rows = rows.withColumn("issues", issue_list(c("report"), c("scope"), c("report_status"), c("label"), c("evidence")))
    faulty = F.size("issues") > 0
    strength = F.when(faulty, "INSUFFICIENT").otherwise(c("evidence_strength"))
    reasons = F.filter(F.concat(F.array("uncertainty_reason"), c("issues")), lambda text: text != "")
    rows = rows.withColumn("uncertainty_reason", F.when(faulty, F.array_join(reasons, "; ")).otherwise(c("uncertainty_reason")))
    masked = faulty | (c("report_status") == "NOT_MENTIONED") | (strength == "INSUFFICIENT")
    rows = rows.withColumn("_strength", strength).withColumn("label", F.when(~masked, c("label")))
    lowered = c("label").isNotNull() & (c("report_status") == "UNCERTAIN") & (c("_strength") == "DIRECT")
    final = F.when(c("label").isNull(), "INSUFFICIENT").when(lowered, "PARTIAL").otherwise(c("_strength"))
    rows = rows.withColumn("downweighted", lowered).withColumn("evidence_strength", final).drop("_strength")
    blank = (c("evidence_strength") != "DIRECT") & (F.trim("uncertainty_reason") == "")
    rows = rows.withColumn("uncertainty_reason", F.when(blank, DEFAULT_REASON).otherwise(c("uncertainty_reason")))
    return rows.withColumn("weight", L.evidence_weight(c("evidence_strength"), c("label"))).withColumn("mask", c("label").isNotNull().cast("int"))


def warnings(validated: DataFrame) -> DataFrame:
    """One row per finding that was masked or lowered."""
    lowered = F.when(F.col("downweighted"), F.array(F.lit(DOWNWEIGHTED))).otherwise(F.array().cast("array<string>"))
    all_issues = F.concat(F.col("issues"), lowered)
    return validated.select("uid", "target", all_issues.alias("issues")).where(F.size("issues") > 0)


def evidence_offsets(rows: DataFrame) -> DataFrame:
    """Start and end of every quote that occurs in its report."""
    spans = F.transform("evidence", lambda quote: F.struct(
        quote.alias("text"), (F.position(quote, F.col("report")) - 1).alias("start")))
    kept = F.filter(spans, lambda s: s["start"] >= 0)
    return rows.withColumn("spans", F.transform(kept, lambda s: F.struct(
        s["text"].alias("text"), s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"))))


def wide_labels(validated: DataFrame, targets: Sequence[str], state: DataFrame | None = None) -> DataFrame:
    """One row per study: label, mask and weight per target; ``state`` adds studies without a result."""
    wide = to_wide(validated, ["uid"], targets, ["label", "mask", "weight"])
    if state is None:
        return wide
    joined = state.select("uid", "extraction_status").join(wide, "uid", "left")
    fill = {f"{t}__mask": 0 for t in targets} | {f"{t}__weight": 0.0 for t in targets}
    return joined.select("uid", "extraction_status", *[L.col(t) for t in targets],
                         *[F.coalesce(L.col(name), F.lit(value)).alias(name) for name, value in fill.items()])


def detail_rows(validated: DataFrame) -> DataFrame:
    """Long export: evidence as JSON with offsets."""
    return evidence_offsets(validated).select(
        "uid", "target", "label", "report_status", F.to_json("spans").alias("evidence"), "evidence_strength", "weight",
        "score_reason", "uncertainty_reason", F.lit("SUCCESS").alias("extraction_status"))


def study_state(requested: DataFrame, results: DataFrame, attempts: DataFrame) -> DataFrame:
    """SUCCESS with a result, else the status of the latest attempt, else PENDING."""
    done = results.select("uid", F.lit("SUCCESS").alias("_done")).distinct()
    last = attempts.groupBy("uid").agg(F.max_by("status", "attempt").alias("_last"))
    return requested.select("uid").join(done, "uid", "left").join(last, "uid", "left").select(
        "uid", F.coalesce("_done", "_last", F.lit("PENDING")).alias("extraction_status"))


def classify_attempts(attempts: DataFrame) -> DataFrame:
    """Whether a failed attempt may be tried again: no code, 408, 409, 429 or a server error."""
    code = F.col("http_status")
    again = code.isNull() | code.isin(408, 409, 429) | (code >= 500)
    return attempts.withColumn("retryable", F.when(F.col("status") != "SUCCESS", again).otherwise(False))


def retry_queue(attempts: DataFrame) -> DataFrame:
    """Keys without a success whose latest attempt may be repeated."""
    last = classify_attempts(attempts).groupBy("uid").agg(
        F.max_by("retryable", "attempt").alias("_again"), F.max((F.col("status") == "SUCCESS").cast("int")).alias("_done"),
        F.count(F.lit(1)).alias("attempts"))
    return last.where("_again AND _done = 0").select("uid", "attempts")


def usage_summary(attempts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Totals over all attempts, failed ones too; a field nobody reported stays NULL."""
    ok = F.col("status") == "SUCCESS"
    return attempts.agg(
        F.count(F.lit(1)).alias("attempts"), *[F.sum(name).alias(name) for name in fields],
        F.count_if(F.col("total_tokens").isNull()).alias("attempts_without_usage"),
        F.round(F.sum("elapsed"), 3).alias("elapsed_seconds"),
        F.round(F.avg(F.when(ok, F.col("elapsed"))), 3).alias("mean_success_seconds"),
        F.avg(F.when(ok, F.col("total_tokens"))).alias("mean_success_tokens"))


def score_distribution(validated: DataFrame) -> DataFrame:
    return validated.groupBy("target").agg(
        F.count("label").alias("count"), F.avg("label").alias("mean"), F.min("label").alias("min"), F.max("label").alias("max"))


def extraction_coverage(state: DataFrame, validated: DataFrame, target_count: int) -> DataFrame:
    """Studies by outcome, and scored and masked labels over all requested studies."""
    studies = state.agg(F.count(F.lit(1)).alias("selected"), F.count_if(F.col("extraction_status") == "SUCCESS").alias("successful"))
    scored = validated.agg(F.count("label")).scalar()
    return studies.withColumn("scored_labels", scored).select(
        "selected", "successful", (F.col("selected") - F.col("successful")).alias("pending_or_failed"), "scored_labels",
        (F.col("selected") * target_count - F.col("scored_labels")).alias("masked_labels"))


def report_manifest(studies: DataFrame, group: Column) -> DataFrame:
    """Raw digest, report group, language and input state of every report."""
    text = F.col("report")
    state = F.when(text.isNull() | (F.trim(text) == ""), "EMPTY").otherwise("READY")
    return studies.select("uid", digest(text).alias("report_hash"), group.alias("report_group"), "lang", state.alias("input_state"))
