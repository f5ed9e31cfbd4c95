import json

import pytest
from pyspark.sql import functions as F

from sliceweave.operators import extraction

NAMES = ["A", "B"]
REPORT = "Knee report: partial tear seen. No effusion."


def item(status="PRESENT", label=0.9, strength="DIRECT", evidence=("partial tear",), reason="", why="x"):
    return {"report_status": status, "label": label, "evidence_strength": strength, "evidence": list(evidence), "score_reason": why, "uncertainty_reason": reason}


def answer(a, scope="KNEE", uid="u", b=None, **extra):
    return json.dumps({"uid": uid, "report_scope": scope, "labels": {"A": a, "B": b or item("ABSENT", 0.1, evidence=["No effusion"])}} | extra)


def parse(spark, text):
    return extraction.parse_responses(spark.createDataFrame([("u", REPORT, text)], "uid string, report string, response string"), NAMES)


def check(spark, a, scope="KNEE"):
    rows = extraction.validate_findings(extraction.findings(parse(spark, answer(a, scope))))
    return rows, {r["target"]: r for r in rows.collect()}


def test_good_answer(spark):
    _, got = check(spark, item())
    assert (got["A"]["label"], got["A"]["weight"], got["A"]["mask"], got["A"]["issues"]) == (0.9, 1.0, 1, [])


@pytest.mark.parametrize("a, issues", [
    (item(evidence=["complete tear"]), ["EVIDENCE_NOT_VERBATIM"]),
    (item("ABSENT", 0.93), ["ABSENT_WITH_POSITIVE_SCORE"]),
    (item("NOT_MENTIONED", None), ["NOT_MENTIONED_WITH_EVIDENCE"]),
    (item("NOT_MENTIONED", 0.4, evidence=[]), ["UNMENTIONED_WITH_SCORE"]),
    (item(evidence=[]), ["MISSING_EVIDENCE"]),
])
def test_issues_mask_the_label(spark, a, issues):
    rows, got = check(spark, a)
    assert got["A"]["issues"] == issues
    assert (got["A"]["label"], got["A"]["evidence_strength"], got["A"]["weight"]) == (None, "INSUFFICIENT", 0.0)
    assert got["A"]["uncertainty_reason"] == "; ".join(issues)
    assert [r["target"] for r in extraction.warnings(rows).collect()] == ["A"]


def test_wrong_scope_masks_everything(spark):
    rows, got = check(spark, item(), scope="OTHER")
    assert all(r["label"] is None for r in got.values()) and extraction.warnings(rows).count() == 2


def test_partial_and_uncertain_evidence(spark):
    _, got = check(spark, item("UNCERTAIN", 0.63, "PARTIAL"))
    assert (got["A"]["label"], got["A"]["mask"], got["A"]["weight"]) == (0.63, 1, 0.35)
    rows, got = check(spark, item("UNCERTAIN", 0.63, "DIRECT"))
    assert got["A"]["evidence_strength"] == "PARTIAL" and got["A"]["uncertainty_reason"] == extraction.DEFAULT_REASON
    assert extraction.warnings(rows).first()["issues"] == ["UNCERTAIN_DIRECT_DOWNWEIGHTED"]


@pytest.mark.parametrize("text, reason", [
    ("{", "not JSON"), (answer(item(), uid="v"), "uid"), (answer(item(), scope="HIP"), "scope"), (answer(item(label=0)), "finding"), (answer(item(label=1)), "finding"),
    (answer(item(label=-0.1)), "finding"), (answer(item(label=1.1)), "finding"), (answer(item(label="0.5")), "keys"), (answer(item(status="MAYBE")), "finding"),
    (answer(item(evidence=[""])), "finding"), (answer(item(), extra=1), "keys"), (answer(item() | {"more": 1}), "keys"),
    (json.dumps({"uid": "u", "report_scope": "KNEE", "labels": {"A": item()}}), "keys"), (answer({k: v for k, v in item().items() if k != "label"}), "keys"),
])
def test_rejected_answers(spark, text, reason):
    assert parse(spark, text).first()["rejected"] == reason


def test_accepts_null_label(spark):
    assert parse(spark, answer(item("NOT_MENTIONED", None, "INSUFFICIENT", []))).first()["rejected"] is None


def test_usage_counts_failed_attempts_and_keeps_unknown(spark):
    schema = "uid string, attempt int, status string, elapsed double, http_status int, total_tokens bigint, cached bigint, reasoning bigint"
    rows = [("u", 1, "ERROR", 1.0, 503, 150, 40, None), ("u", 2, "SUCCESS", 2.0, None, 150, None, None), ("v", 3, "ERROR", 1.0, 400, None, None, None)]
    log = spark.createDataFrame(rows, schema)
    got = extraction.usage_summary(log, ["total_tokens", "cached", "reasoning"]).first()
    assert (got["total_tokens"], got["cached"], got["reasoning"], got["attempts_without_usage"], got["mean_success_seconds"]) == (300, 40, None, 1, 2.0)
    assert extraction.retry_queue(log).count() == 0
    assert [r["uid"] for r in extraction.retry_queue(log.where("attempt = 1")).collect()] == ["u"]
    wanted = spark.createDataFrame([("u",), ("v",), ("w",)], "uid string")
    state = extraction.study_state(wanted, wanted.where("uid = 'u'"), log)
    assert {r["uid"]: r["extraction_status"] for r in state.collect()} == {"u": "SUCCESS", "v": "ERROR", "w": "PENDING"}


def test_exports(spark):
    rows, _ = check(spark, item())
    detail = {r["target"]: r for r in extraction.detail_rows(rows).collect()}
    assert json.loads(detail["A"]["evidence"]) == [{"text": "partial tear", "start": 13, "end": 25}]
    state = spark.createDataFrame([("u", "SUCCESS"), ("w", "PENDING")], "uid string, extraction_status string")
    wide = {r["uid"]: r for r in extraction.wide_labels(rows, NAMES, state).collect()}
    assert (wide["u"]["A"], wide["u"]["B__weight"], wide["w"]["A"], wide["w"]["A__mask"], wide["w"]["B__weight"]) == (0.9, 1.0, None, 0, 0.0)
    assert extraction.requests(rows.select("uid", "report", F.lit(1).alias("A"))).columns == ["uid", "report"]
