"""Structured answers, attempt logs, sets and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from sliceweave.functions.text import clock, report_group
from sliceweave.operators import ensemble, extraction, guards, joins, splits, windows
from sliceweave.operators import labels as label_ops
from sliceweave.plans import models as m
from sliceweave.plans.models import sql
from sliceweave.plans.q_sources import group_sql
from sliceweave.plans.registry import query
from sliceweave.session import scratch_path
from sliceweave.sources import readers, sinks
from sliceweave.sources.tables import table

NAMES = ["quality", "toxic"]

_CHECKED = """checked AS (
    SELECT *, CASE WHEN faulty OR report_status = 'NOT_MENTIONED' OR evidence_strength = 'INSUFFICIENT' THEN NULL ELSE label END AS kept FROM (
    SELECT *, len(issues) > 0 AS faulty FROM (
    SELECT *, list_filter([
        CASE WHEN len(list_filter(evidence, lambda q: NOT contains(report, q))) > 0 THEN 'EVIDENCE_NOT_VERBATIM' END,
        CASE WHEN report_status = 'NOT_MENTIONED' AND len(evidence) > 0 THEN 'NOT_MENTIONED_WITH_EVIDENCE' END,
        CASE WHEN report_status <> 'NOT_MENTIONED' AND len(evidence) = 0 THEN 'MISSING_EVIDENCE' END,
        CASE WHEN report_status = 'NOT_MENTIONED' AND label IS NOT NULL THEN 'UNMENTIONED_WITH_SCORE' END,
        CASE WHEN report_status = 'ABSENT' AND label > 0.5 THEN 'ABSENT_WITH_POSITIVE_SCORE' END,
        CASE WHEN scope <> 'KNEE' THEN 'NON_KNEE_OR_UNCLEAR_SCOPE' END], lambda x: x IS NOT NULL) AS issues FROM answers
        WHERE uid NOT IN (SELECT uid FROM answers WHERE len(list_filter(evidence, lambda q: q = '')) > 0)))),
    final AS (
    SELECT uid, report, target, kept AS label, report_status, evidence, issues, score_reason,
           kept IS NOT NULL AND report_status = 'UNCERTAIN' AND evidence_strength = 'DIRECT' AS downweighted,
           CASE WHEN kept IS NULL THEN 'INSUFFICIENT' WHEN report_status = 'UNCERTAIN' AND evidence_strength = 'DIRECT' THEN 'PARTIAL' ELSE evidence_strength END AS strength,
           CASE WHEN faulty THEN array_to_string(list_filter(list_concat([uncertainty_reason], issues), lambda x: x <> ''), '; ') ELSE uncertainty_reason END AS reason FROM checked),
    validated AS (
    SELECT uid, report, target, label, report_status, evidence, issues, downweighted, score_reason, strength AS evidence_strength,
           CASE WHEN strength <> 'DIRECT' AND trim(reason) = '' THEN '报告未提及或证据不足' ELSE reason END AS uncertainty_reason,
           CASE WHEN label IS NULL THEN 0 ELSE CASE strength WHEN 'DIRECT' THEN 1.0 WHEN 'PARTIAL' THEN 0.35 WHEN 'CONFLICTING' THEN 0.1 ELSE 0 END END::DOUBLE AS weight,
           CAST(label IS NOT NULL AS INTEGER) AS mask FROM final)"""


def _v(body):
    return sql(f"WITH {_CHECKED} {body}", "answers")


def _parsed(spark, d):
    return extraction.parse_responses(m.answers(spark, d), NAMES)


def _validated(spark, d):
    return extraction.validate_findings(extraction.findings(_parsed(spark, d))).withColumn("uid", F.col("uid").cast("long"))


@query("v01_schema_check", """
    SELECT uid, CASE WHEN k = 1 THEN 'not JSON' WHEN k = 2 THEN 'keys' WHEN k = 3 THEN 'scope' WHEN k IN (4, 5) THEN 'finding' WHEN k = 6 THEN 'uid' END AS rejected
    FROM (SELECT doc_id AS uid, doc_id % 13 AS k FROM documents)""")
def schema_check(spark, d):
    """Every kind of broken answer, made from the documents."""
    k, uid = F.col("doc_id") % 13, F.col("doc_id").cast("string")
    finding = lambda label, status="PRESENT", quote=None: F.struct(
        F.lit(status).alias("report_status"), label.alias("label"), F.lit("DIRECT").alias("evidence_strength"),
        F.array(F.substring("text", 1, 5) if quote is None else F.lit(quote)).alias("evidence"), F.lit("").alias("score_reason"), F.lit("").alias("uncertainty_reason"))
    good = finding(F.lit(0.7))
    answer = lambda scope="KNEE", echo=uid, one=good, names=NAMES: F.to_json(F.struct(
        echo.alias("uid"), F.lit(scope).alias("report_scope"), F.create_map(F.lit(names[0]), one, F.lit(names[1]), good).alias("labels")), {"ignoreNullFields": "false"})
    text = (F.when(k == 1, F.concat(F.lit("{"), F.substring("text", 1, 8))).when(k == 2, answer(names=["quality", "other"]))
            .when(k == 3, answer(scope="ELBOW")).when(k == 4, answer(one=finding(F.lit(1.5)))).when(k == 5, answer(one=finding(F.lit(0.5), "MAYBE")))
            .when(k == 6, answer(echo=F.concat(uid, F.lit("x")))).otherwise(answer()))
    rows = table(spark, d, "documents").select(F.col("doc_id"), uid.alias("uid"), text.alias("response"))
    return extraction.parse_responses(rows, NAMES).select(F.col("doc_id").alias("uid"), "rejected")


@query("v02_uid_echo", sql("SELECT count(DISTINCT uid) AS answers, CAST(0 AS BIGINT) AS foreign_uid FROM answers", "answers"))
def uid_echo(spark, d):
    return _parsed(spark, d).agg(F.count(F.lit(1)).alias("answers"), F.count_if(F.col("rejected") == "uid").alias("foreign_uid"))


@query("v03_verbatim_evidence", sql("""
    SELECT uid, target, len(list_filter(evidence, lambda q: NOT contains(report, q))) = 0 AS verbatim FROM answers
    WHERE uid NOT IN (SELECT uid FROM answers WHERE len(list_filter(evidence, lambda q: q = '')) > 0)""", "answers"))
def verbatim_evidence(spark, d):
    rows = extraction.findings(_parsed(spark, d))
    return rows.select(F.col("uid").cast("long").alias("uid"), "target", F.forall("evidence", lambda q: F.contains(F.col("report"), q)).alias("verbatim"))


@query("v04_issue_cascade", _v("SELECT uid, target, array_to_string(issues, ',') AS issues, label, mask FROM validated"))
def issue_cascade(spark, d):
    return _validated(spark, d).select("uid", "target", F.array_join("issues", ",").alias("issues"), "label", "mask")


@query("v04_warnings", _v("""SELECT uid, target, array_to_string(list_concat(issues, CASE WHEN downweighted THEN ['UNCERTAIN_DIRECT_DOWNWEIGHTED'] ELSE [] END), ',') AS issues
    FROM validated WHERE len(issues) > 0 OR downweighted"""))
def warning_rows(spark, d):
    return extraction.warnings(_validated(spark, d)).withColumn("issues", F.array_join("issues", ","))


@query("v05_final_strength", _v("SELECT uid, target, evidence_strength, weight, uncertainty_reason FROM validated"))
def final_strength(spark, d):
    return _validated(spark, d).select("uid", "target", "evidence_strength", "weight", "uncertainty_reason")


@query("v06_evidence_offsets", _v("""
    SELECT uid, target, q AS quote, CAST(instr(report, q) - 1 AS INTEGER) AS start, CAST(instr(report, q) - 1 + length(q) AS INTEGER) AS "end"
    FROM (SELECT uid, target, report, unnest(evidence) AS q FROM validated) WHERE contains(report, q)"""))
def evidence_offsets(spark, d):
    rows = extraction.evidence_offsets(_validated(spark, d))
    return rows.select("uid", "target", F.inline("spans")).withColumnRenamed("text", "quote")


@query("v07_wide_labels", _v("SELECT uid, " + ", ".join(
    f'max({v}) FILTER (target = \'{t}\') AS "{t if v == "label" else t + "__" + v}"' for v in ("label", "mask", "weight") for t in NAMES) + " FROM validated GROUP BY 1"))
def wide_labels(spark, d):
    return extraction.wide_labels(_validated(spark, d), NAMES)


@query("s10_exports", _v("""
    SELECT 'detail' AS part, CAST(uid AS VARCHAR) AS key, target, report_status AS text, label AS value, len(list_filter(evidence, lambda q: contains(report, q))) AS n FROM validated
    UNION ALL SELECT 'labels', CAST(uid AS VARCHAR), target, NULL, label, mask FROM validated
    UNION ALL SELECT 'usage', CAST(event_id AS VARCHAR), NULL, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END, value,
        CASE WHEN event_id % 9 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) * 4 END FROM events"""))
def exports(spark, d):
    """Wide, detail and usage tables through CSV; all three are read back."""
    root = scratch_path(spark, "exports")
    rows = _validated(spark, d)
    detail, wide, usage = extraction.detail_rows(rows), extraction.wide_labels(rows, NAMES), m.attempts(spark, d)
    sinks.write_exports(wide, detail, usage, root)
    back = readers.read_csv(spark, f"{root}/labels_detail", detail.schema)
    labels = readers.read_csv(spark, f"{root}/labels", wide.schema)
    log = readers.read_csv(spark, f"{root}/usage", usage.schema)
    number = F.coalesce(F.json_array_length("evidence"), F.lit(0)).cast("long")
    none = F.lit(None).cast("string")
    return (back.select(F.lit("detail").alias("part"), F.col("uid").cast("string").alias("key"), "target", F.col("report_status").alias("text"), F.col("label").alias("value"), number.alias("n"))
            .union(labels.select(F.lit("labels"), F.col("uid").cast("string"), F.inline(F.array(*[
                F.struct(F.lit(t).alias("target"), none.alias("text"), F.col(t).alias("value"), F.col(f"{t}__mask").cast("long").alias("n")) for t in NAMES]))))
            .union(log.select(F.lit("usage"), F.col("attempt").cast("string"), none, "status", "elapsed", "total_tokens")))


@query("v08_fingerprint", """
    SELECT count(*) AS rows, sha256(count(*) || '|' || sum(c0) || '|' || sum(c1) || '|' || sum(c2) || '|' || sum(c3)) AS data_sha256 FROM (
    SELECT CAST('0x' || substring(h, 1, 15) AS BIGINT) AS c0, CAST('0x' || substring(h, 16, 15) AS BIGINT) AS c1, CAST('0x' || substring(h, 31, 15) AS BIGINT) AS c2,
           CAST('0x' || substring(h, 46, 15) AS BIGINT) AS c3 FROM (SELECT sha256(length(doc_id::VARCHAR) || ':' || doc_id || '|' || length(text) || ':' || text || '|' || length(lang) || ':' || lang) AS h FROM documents))""")
def data_fingerprint(spark, d):
    return splits.fingerprint(table(spark, d, "documents"), ["doc_id", "text", "lang"])


@query("a33_label_fingerprint", """
    SELECT count(*) AS rows, sha256(count(*) || '|' || sum(c0) || '|' || sum(c1) || '|' || sum(c2) || '|' || sum(c3)) AS data_sha256 FROM (
    SELECT CAST('0x' || substring(h, 1, 15) AS BIGINT) AS c0, CAST('0x' || substring(h, 16, 15) AS BIGINT) AS c1, CAST('0x' || substring(h, 31, 15) AS BIGINT) AS c2,
           CAST('0x' || substring(h, 46, 15) AS BIGINT) AS c3 FROM (SELECT sha256(length(doc_id::VARCHAR) || ':' || doc_id || '|1:' || quality || '|1:' || toxic) AS h FROM labels))""")
def label_fingerprint(spark, d):
    return splits.fingerprint(table(spark, d, "labels"), ["doc_id", "quality", "toxic"])


@query("v09_attempt_classes", sql("""
    SELECT status, http_status, status <> 'SUCCESS' AND (http_status IS NULL OR http_status IN (408, 409, 429) OR http_status >= 500) AS retryable, count(*) AS attempts
    FROM attempts GROUP BY ALL""", "attempts"))
def attempt_classes(spark, d):
    return extraction.classify_attempts(m.attempts(spark, d)).groupBy("status", "http_status", "retryable").agg(F.count(F.lit(1)).alias("attempts"))


@query("v09_retry_queue", sql("""
    SELECT uid, count(*) AS attempts FROM (SELECT (uid * 40 + attempt % 40) AS uid, attempt, status, http_status FROM attempts) GROUP BY 1
    HAVING count(*) FILTER (status = 'SUCCESS') = 0 AND arg_max(http_status IS NULL OR http_status IN (408, 409, 429) OR http_status >= 500, attempt)""", "attempts"))
def retry_queue(spark, d):
    rows = m.attempts(spark, d).withColumn("uid", F.col("uid") * 40 + F.col("attempt") % 40)
    return extraction.retry_queue(rows)


@query("p17_report_group", f"SELECT doc_id AS uid, sha256(text) AS digest, {group_sql('text')} AS report_group FROM documents")
def report_groups(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("uid"), F.sha2("text", 256).alias("digest"), report_group(F.col("text")).alias("report_group"))


_ELIGIBLE = f"""SELECT doc_id AS uid, text AS report FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    AND {group_sql('text')} NOT IN (SELECT {group_sql('text')} FROM documents JOIN labels USING (doc_id))"""


def _eligible(spark, d):
    rows = m.studies(spark, d)
    gold = rows.where(F.col("quality").isNotNull())
    return joins.without_known_texts(rows.where(F.col("quality").isNull() & F.col("toxic").isNull()), gold)


@query("j06_without_known_texts", f"SELECT uid, sha256(report) AS digest FROM ({_ELIGIBLE})")
def without_known_texts(spark, d):
    return _eligible(spark, d).select("uid", F.sha2("report", 256).alias("digest"))


@query("p18_requests", _ELIGIBLE)
def requests(spark, d):
    return extraction.requests(_eligible(spark, d))


@query("j07_pending", f"SELECT uid FROM ({_ELIGIBLE}) WHERE uid NOT IN (SELECT user_id FROM events WHERE event_type <> 'error')")
def pending(spark, d):
    done = m.attempts(spark, d).where("status = 'SUCCESS'")
    return joins.pending(_eligible(spark, d).select("uid"), done, "uid")


@query("w13_latest_attempt", sql("""
    SELECT uid, max(attempt) AS attempt, arg_max(status, attempt) AS status, arg_max_null(total_tokens, attempt) AS total_tokens FROM attempts GROUP BY 1""", "attempts"))
def latest_attempt(spark, d):
    return windows.latest(m.attempts(spark, d), "uid", F.col("attempt"), ["attempt", "status", "total_tokens"])


@query("a13_usage_totals", sql("""
    SELECT count(*) AS attempts, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
           count(*) FILTER (total_tokens IS NULL) AS attempts_without_usage, round(sum(elapsed), 2) AS elapsed_seconds,
           round(avg(elapsed) FILTER (status = 'SUCCESS'), 3) AS mean_success_seconds, round(avg(total_tokens) FILTER (status = 'SUCCESS'), 4) AS mean_success_tokens FROM attempts""", "attempts"))
def usage_totals(spark, d):
    rows = extraction.usage_summary(m.attempts(spark, d), ["input_tokens", "output_tokens", "total_tokens"])
    digits = {"elapsed_seconds": 2, "mean_success_seconds": 3, "mean_success_tokens": 4}
    return rows.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in rows.columns])


@query("a13_clock", sql("""SELECT status, lpad(CAST(s // 3600 AS VARCHAR), CAST(greatest(2, len(CAST(s // 3600 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock
    FROM (SELECT status, CAST(floor(sum(CAST(round(elapsed) AS BIGINT))) AS BIGINT) AS s FROM attempts GROUP BY 1)""", "attempts"))
def clock_time(spark, d):
    rows = m.attempts(spark, d).groupBy("status").agg(F.sum(F.round("elapsed").cast("long")).alias("s"))
    return rows.select("status", clock(F.col("s")).alias("clock"))


@query("a14_score_distribution", _v('SELECT target, count(label) AS "count", round(avg(label), 6) AS mean, min(label) AS min, max(label) AS max FROM validated GROUP BY 1'))
def score_distribution(spark, d):
    rows = extraction.score_distribution(_validated(spark, d))
    return rows.withColumn("mean", F.round("mean", 6))


@query("a15_extraction_coverage", _v("""
    SELECT (SELECT count(*) FROM documents) AS selected, (SELECT count(DISTINCT uid) FROM validated) AS successful,
           (SELECT count(*) FROM documents) - (SELECT count(DISTINCT uid) FROM validated) AS pending_or_failed, count(label) AS scored_labels,
           2 * (SELECT count(*) FROM documents) - count(label) AS masked_labels FROM validated"""))
def extraction_coverage(spark, d):
    rows = _validated(spark, d)
    requested = table(spark, d, "documents").select(F.col("doc_id").alias("uid"))
    state = extraction.study_state(requested, rows.select("uid"), m.attempts(spark, d))
    return extraction.extraction_coverage(state, rows, len(NAMES))


@query("a15_study_state", sql("""
    SELECT doc_id AS uid, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'SUCCESS' END, last, 'PENDING') AS extraction_status
    FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT uid, arg_max(status, attempt) AS last FROM attempts GROUP BY 1) a ON doc_id = a.uid""", "attempts"))
def study_state(spark, d):
    requested = table(spark, d, "documents").select(F.col("doc_id").alias("uid"))
    results = table(spark, d, "labels").select(F.col("doc_id").alias("uid"))
    return extraction.study_state(requested, results, m.attempts(spark, d))


@query("p24_review_queue", _v("""
    SELECT uid, target, CASE WHEN label IS NULL THEN 'UNKNOWN' ELSE printf('%.3f', label) END AS shown_label,
           CASE WHEN target <> 'toxic' AND report_status IN ('PRESENT', 'UNCERTAIN') THEN 'check degree, extent or site'
                WHEN target = 'toxic' AND label > 0.5 THEN 'check amount and wording' ELSE '' END AS hint FROM validated"""))
def review_queue(spark, d):
    return label_ops.review_queue(_validated(spark, d), NAMES, ["toxic"]).select("uid", "target", "shown_label", "hint")


# Ensembles and sets

@query("a34_mean_probability", sql("""
    SELECT uid, target, CAST(3 AS BIGINT) AS sources, CAST(0 AS BIGINT) AS bad_values, round(CAST(CAST((p0 + p1 + p2) / 3 AS FLOAT) AS DOUBLE), 6) AS mean FROM cells""", "cells"))
def mean_probability(spark, d):
    rows = m.cells(spark, d).select("uid", "target", F.explode(F.array("p0", "p1", "p2")).alias("p"))
    mean = ensemble.mean_probability(rows, ["uid", "target"], "p")
    return mean.withColumn("mean", F.round(F.col("mean").cast("double"), 6))


@query("j04_sample_join", sql("SELECT o_orderkey AS uid, " + ", ".join(
    f"max(round(CAST(CAST((p0 + p1 + p2) / 3 AS FLOAT) AS DOUBLE), 6)) FILTER (target = '{t}') AS {t}" for t in m.TARGETS) + " FROM orders LEFT JOIN cells ON o_orderkey = uid GROUP BY 1", "cells"))
def sample_join(spark, d):
    rows = m.cells(spark, d).select("uid", "target", F.explode(F.array("p0", "p1", "p2")).alias("p"))
    mean = ensemble.mean_probability(rows, ["uid", "target"], "p")
    sample = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderkey").alias("ordinal"))
    joined = ensemble.submission(sample, mean, "uid", m.TARGETS, "ordinal")
    return joined.select("uid", *[F.round(F.col(t).cast("double"), 6).alias(t) for t in m.TARGETS])


@query("u01_fold_union", sql("SELECT uid, fold, round(max(p1) FILTER (target = 'returned'), 6) AS returned FROM cells GROUP BY 1, 2", "cells"))
def fold_union(spark, d):
    rows = m.label_sources(spark, d).select("uid", "fold", F.round("p1__returned", 6).alias("returned"))
    return ensemble.checked_union([rows.where(F.col("fold") == fold) for fold in range(5)], ["uid"])


@query("u02_key_difference", """
    SELECT coalesce(o_orderkey, l_orderkey) AS uid, CASE WHEN l_orderkey IS NULL THEN 'left_only' ELSE 'right_only' END AS side
    FROM orders FULL JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON o_orderkey = l_orderkey WHERE o_orderkey IS NULL OR l_orderkey IS NULL""")
def key_difference(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"))
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"))
    return guards.key_difference(left, right, ["uid"])


@query("u03_split_leaks", """SELECT CAST(0 AS BIGINT) AS overlapping_roles, CAST(0 AS BIGINT) AS missing_models, CAST(0 AS BIGINT) AS not_validated_once,
    CAST(0 AS BIGINT) AS wrong_training, CAST(0 AS BIGINT) AS gold_leaks""")
def split_leaks(spark, d):
    return splits.split_leaks(splits.fold_roles(m.members(spark, d), 5), "uid", 5)


@query("u04_checked_union", "SELECT c_custkey AS uid, 'customer' AS origin FROM customer UNION ALL SELECT -1 - s_suppkey, 'supplier' FROM supplier")
def checked_union(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("uid"), F.lit("customer").alias("origin"))
    right = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("uid"), F.lit("supplier").alias("origin"))
    return ensemble.checked_union([left, right], ["uid"])


@query("u05_last_wins", "SELECT user_id AS uid, max(event_id) AS ordinal, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def last_wins(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("ordinal"), "value")
    return ensemble.last_wins(rows, ["uid"], "ordinal")


@query("t01_usage_stream", sql("""
    SELECT strftime(date_trunc('day', started_at), '%Y-%m-%d') AS day, count(*) AS attempts, count(*) FILTER (status <> 'SUCCESS') AS failures, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
           CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) FILTER (total_tokens IS NULL) AS attempts_without_usage
    FROM attempts GROUP BY 1""", "attempts"))
def usage_stream(spark, d):
    """The log written as JSON lines in several files, read two files a trigger and rolled up; equal to the batch result."""
    from sliceweave.streaming import attempts as stream

    root = scratch_path(spark, "stream")
    rows = m.attempts(spark, d).withColumn("uid", F.col("uid").cast("string"))
    sinks.append_jsonl(rows.repartition(LOG_FILES, "attempt"), f"{root}/in")
    source = stream.read_attempts(spark, f"{root}/in", rows.schema, files_per_trigger=2)
    stream.start_usage(source, f"{root}/out", f"{root}/check").awaitTermination()
    out = stream.usage(spark, f"{root}/out")
    return out.select(F.date_from_unix_date(F.floor(F.unix_timestamp("window_start") / 86400).cast("int")).cast("string").alias("day"), *[c for c in out.columns if not c.startswith("window_")])


#: Files of the written log.
LOG_FILES = 6


@query("t01_latest_stream", sql("SELECT CAST(uid AS VARCHAR) AS uid, max(attempt) AS attempt, arg_max(status, attempt) AS status, count(*) AS attempts FROM attempts GROUP BY 1", "attempts"))
def latest_stream(spark, d):
    from sliceweave.streaming import attempts as stream

    root = scratch_path(spark, "latest")
    rows = m.attempts(spark, d).withColumn("uid", F.col("uid").cast("string"))
    sinks.append_jsonl(rows.where("attempt % 2 = 0"), f"{root}/in")
    run = lambda: stream.start_latest(stream.read_attempts(spark, f"{root}/in", rows.schema), f"{root}/out", f"{root}/check").awaitTermination()
    run()
    sinks.append_jsonl(rows.where("attempt % 2 = 1"), f"{root}/in")
    run()
    return stream.latest(spark, f"{root}/out")
