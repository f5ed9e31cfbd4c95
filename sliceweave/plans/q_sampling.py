"""Samples, quotas, splits, near duplicates and scoring."""

from __future__ import annotations

from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import functions as F

from sliceweave.functions.text import report_group
from sliceweave.operators import guards, heads, metrics, neardup, sampling, scoring, splits, stratify
from sliceweave.operators.reshape import melt
from sliceweave.plans import models as m
from sliceweave.plans.models import TARGETS, sql
from sliceweave.plans.q_labels import USE, conf, neg, pos
from sliceweave.plans.q_sources import SPACE, group_sql
from sliceweave.plans.registry import query
from sliceweave.session import materialize
from sliceweave.sources.tables import table


@query("k01_seeded_sample", "SELECT doc_id AS uid, lang FROM documents ORDER BY sha256('7|' || doc_id), doc_id LIMIT 100")
def seeded_sample(spark, d):
    return sampling.sample_studies(m.studies(spark, d).select("uid", "lang"), "uid", 100, 7)


def _sample_sql(group, least):
    count = "(SELECT c FROM most)"
    return sql(f"""
    WITH most AS (SELECT greatest({least}, max(g)) AS c FROM (SELECT count(DISTINCT {group}) AS g FROM windows GROUP BY study)),
    hashed AS (SELECT study, slot, series, idx, sha256('11|0|' || study || '|' || series || '|' || idx) AS h FROM windows),
    ins AS (SELECT *, row_number() OVER (PARTITION BY study, {group} ORDER BY h, series, idx) AS r FROM hashed),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, h, series, idx) AS draw FROM ins QUALIFY draw <= {count}),
    held AS (SELECT study, max(draw) AS held FROM drawn GROUP BY 1),
    extra AS (SELECT study, CAST(draw AS BIGINT) AS draw, CAST('0x' || substring(sha256('11|0|extra|' || study || '|' || draw), 1, 12) AS BIGINT) % held + 1 AS pick
              FROM held, (SELECT unnest(range(1, {count} + 1)) AS draw) WHERE draw > held)
    SELECT study, CAST(draw AS INTEGER) AS draw, slot, series, idx FROM drawn
    UNION ALL SELECT e.study, e.draw, slot, series, idx FROM extra e JOIN drawn d ON e.study = d.study AND e.pick = d.draw""", "windows")


def _draws(windows, group, least):
    """Draws per study that leave no group of any study without a window."""
    most = windows.groupBy("study").agg(F.count_distinct(group).alias("g")).agg(F.max("g")).first()[0]
    return max(least, most or 0)


@query("k02_sample_per_slot", _sample_sql("slot", 12))
def sample_per_slot(spark, d):
    windows = m.windows(spark, d).drop("position")
    rows = sampling.sample_windows(windows, "study", "slot", ["series", "idx"], _draws(windows, "slot", 12), 11)
    return rows.select("study", "draw", "slot", "series", "idx")


@query("k03_sample_per_series", _sample_sql("series", 30))
def sample_per_series(spark, d):
    windows = m.windows(spark, d).select("study", "series", "idx")
    rows = sampling.sample_windows(windows, "study", "series", ["series", "idx"], _draws(windows, "series", 30), 11)
    slots = m.windows(spark, d).select("series", "slot").distinct()
    return rows.join(slots, "series").select("study", "draw", "slot", "series", "idx")


def _quota_sql(ideal, goal, count):
    return f"""caps AS (SELECT study, slot, count(*) AS cap FROM windows GROUP BY 1, 2),
    tot AS (SELECT *, list_extract([7.0, 5.0, 5.0, 3.0, 4.0]::DOUBLE[], slot + 1) AS w, {goal} AS goal, count(*) OVER (PARTITION BY study) AS slots FROM caps),
    units AS (SELECT *, {ideal} - (u - 1) AS deficit FROM (SELECT *, sum(w) OVER (PARTITION BY study) AS ws FROM tot), range(2, {count} + 1) t(u) WHERE u <= cap),
    given AS (SELECT study, slot, count(*) AS more FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY deficit DESC, slot, u) AS r FROM units) WHERE r <= goal - slots GROUP BY 1, 2),
    quotas AS (SELECT t.study, t.slot, t.cap, 1 + coalesce(more, 0) AS quota FROM tot t LEFT JOIN given g ON t.study = g.study AND t.slot = g.slot)"""


@query("k04_slot_quotas", sql("WITH " + _quota_sql("goal * w / ws", "least(16, sum(cap) OVER (PARTITION BY study))", 16) + " SELECT study, slot, cap, quota FROM quotas", "windows"))
def slot_quotas(spark, d):
    caps = m.windows(spark, d).groupBy("study", "slot").agg(F.count(F.lit(1)).alias("cap"))
    return sampling.slot_quotas(caps, "study", "slot", "cap", 16, sampling.slot_weight(F.col("slot")))


@query("k05_depth_stratified")
def depth_stratified(spark, d):
    return sampling.stratified_by_depth(m.windows(spark, d).select("series", "idx", "position"), ["series"], "position", "idx", 4, 5,
                                        check=table(spark, d, "lineitem").select(F.col("l_orderkey").alias("series")))


@query("k05_sample_by_depth", sql("SELECT DISTINCT study, CAST(16 AS BIGINT) AS drawn FROM windows", "windows"))
def sample_by_depth(spark, d):
    """Distinct anchors, slot quotas and depth strata together; every study draws the full count."""
    rows = m.windows(spark, d).withColumn("anchor", F.col("series") * 100 + F.col("idx"))
    drawn = sampling.sample_by_depth(rows, "study", "slot", "position", "anchor", F.col("series"), 16, 5)
    return drawn.groupBy("study").agg(F.count(F.lit(1)).alias("drawn"))


@query("k06_distinct_anchors", sql("SELECT study, slot, idx, min(series) AS series FROM windows GROUP BY 1, 2, 3", "windows"))
def distinct_anchors(spark, d):
    return sampling.distinct_anchors(m.windows(spark, d).select("study", "slot", "idx", "series"), "study", "slot", "idx", F.col("series"))


@query("k07_round_robin", sql("""
    WITH most AS (SELECT greatest(8, max(c)) AS b FROM (SELECT count(*) AS c FROM series WHERE num_slices > 0 GROUP BY study, plane))
    SELECT study, plane, series, count(*) AS windows FROM (
    SELECT study, plane, series, row_number() OVER (PARTITION BY study, plane ORDER BY turn, series) AS r FROM series, (SELECT unnest(range(1, b + 1)) AS turn FROM most) WHERE turn <= num_slices)
    WHERE r <= (SELECT b FROM most) GROUP BY 1, 2, 3""", "series"))
def round_robin(spark, d):
    """The budget is 8, or as many as the fullest slot has series, so that every series gets a window."""
    caps = m.series(spark, d).where("num_slices > 0").select("study", "plane", "series", "num_slices")
    most = caps.groupBy("study", "plane").count().agg(F.max("count")).first()[0]
    return sampling.round_robin(caps, ["study", "plane"], "series", "num_slices", max(8, most or 0))


@query("k07_overfull_slots", sql("SELECT study, plane, count(*) AS series FROM series WHERE num_slices > 0 GROUP BY 1, 2 HAVING count(*) > 8", "series"))
def overfull_slots(spark, d):
    return sampling.overfull_slots(m.series(spark, d).where("num_slices > 0"), ["study", "plane"], 8)


@query("k08_proportional_subset", sql("WITH " + _quota_sql("cap / allcap * goal", "least(10, sum(cap) OVER (PARTITION BY study))", 10).replace(
    "sum(w) OVER (PARTITION BY study) AS ws", "sum(cap) OVER (PARTITION BY study) AS allcap") + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY study, slot ORDER BY position, series, idx) - 1 AS r, count(*) OVER (PARTITION BY study) AS total FROM windows)
    SELECT r.study, r.slot, r.series, r.idx FROM ranked r WHERE total <= 10
    UNION ALL SELECT r.study, r.slot, r.series, r.idx FROM ranked r JOIN quotas q ON r.study = q.study AND r.slot = q.slot
    JOIN range(10) t(j) ON j < quota AND r.r = floor((j + 0.5::DOUBLE) * cap / quota) WHERE total > 10""", "windows"))
def proportional_subset(spark, d):
    rows = sampling.proportional_subset(m.windows(spark, d), "study", "slot", [F.col("position"), F.col("series"), F.col("idx")], 10)
    return rows.select("study", "slot", "series", "idx")


@query("k09_cover_examples")
def cover_examples(spark, d):
    rows = sampling.cover_examples(m.studies(spark, d), "uid", "report", ["quality", "toxic"], 6, 3)
    return rows.select("uid", "quality", "toxic", "example", "gain")


@query("k10_audit_sample", """
    WITH cuts AS (SELECT lang, quantile_cont(n_chars, 1 / 3) AS a, quantile_cont(n_chars, 2 / 3) AS b FROM documents GROUP BY 1),
    banded AS (SELECT doc_id AS uid, d.lang, text, CASE WHEN n_chars > a THEN 1 ELSE 0 END + CASE WHEN n_chars > b THEN 1 ELSE 0 END AS length_band, sha256('5|' || doc_id) AS h
               FROM documents d JOIN cuts c ON d.lang = c.lang),
    s AS (SELECT uid FROM banded QUALIFY row_number() OVER (PARTITION BY lang, length_band ORDER BY h, uid) <= 8),
    k AS (SELECT uid FROM banded WHERE contains(text, '@') ORDER BY h, uid LIMIT 40)
    SELECT uid, lang, length_band, CAST(uid IN (SELECT uid FROM s) AS INTEGER) AS stratified, CAST(uid IN (SELECT uid FROM k) AS INTEGER) AS high_risk
    FROM banded WHERE uid IN (SELECT uid FROM s) OR uid IN (SELECT uid FROM k)""")
def audit_sample(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "lang", "n_chars", "text")
    return sampling.audit_sample(rows, "uid", ["lang"], "n_chars", 3, 8, 5, F.contains("text", F.lit("@")), 40)


@query("k11_canonical_order", sql("SELECT study, slot, position, series, idx FROM windows ORDER BY study, slot, position, idx", "windows"))
def canonical_order(spark, d):
    return sampling.canonical_order(m.windows(spark, d), "study").select("study", "slot", "position", "series", "idx")


@query("k12_representative_case", """
    SELECT doc_id AS uid, source, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE lang = 'en' ORDER BY quality + toxic DESC, n_chars DESC, doc_id LIMIT 1""")
def representative_case(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "lang", "source", "n_chars")
    rows = docs.join(table(spark, d, "labels").withColumnRenamed("doc_id", "uid"), "uid")
    best = sampling.representative_case(rows, F.col("lang") == "en", [(F.col("quality") + F.col("toxic")).desc(), F.col("n_chars").desc(), F.col("uid")])
    return best.select("uid", "source", "quality", "toxic")


# Splits

@query("x01_gold_holdout", sql("SELECT DISTINCT uid, CASE WHEN gold IS NOT NULL THEN 'valid' ELSE 'train' END AS split FROM cells", "cells"))
def gold_holdout(spark, d):
    return splits.gold_holdout(m.wide_with_gold(spark, d), TARGETS).select("uid", "split")


@query("x02_random_split", """
    SELECT o_orderkey AS uid, CASE WHEN row_number() OVER (ORDER BY sha256('42|' || o_orderkey), o_orderkey) <= ceil(0.1::DOUBLE * count(*) OVER ()) THEN 'valid' ELSE 'train' END AS split FROM orders""")
def random_split(spark, d):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"))
    return splits.random_split(keys, "uid", 42, 0.1)


def _fold_members(spark, d):
    return splits.membership(m.wide_with_gold(spark, d), "uid", TARGETS, 5, 42)


@query("x03_fold_sizes", sql("""
    WITH s AS (SELECT count(DISTINCT uid) FILTER (gold IS NULL) AS weak, count(DISTINCT uid) FILTER (gold IS NOT NULL) AS held FROM cells)
    SELECT CAST(f AS INTEGER) AS fold, weak // 5 + CASE WHEN f < weak % 5 THEN 1 ELSE 0 END AS studies FROM s, range(5) t(f) UNION ALL SELECT -1, held FROM s""", "cells"))
def fold_sizes(spark, d):
    return _fold_members(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("studies"))


def _fold_sql():
    """The dealing order in SQL: positive flags first, then the others, by rarity; their running parity as text, then the digest of the key."""
    lists = ", ".join(f"CAST(coalesce({flag}, false) AS INTEGER)" for flag in _tri_sql())
    return f"""
    flags AS (SELECT uid, [{lists}] AS f FROM wide_new WHERE uid IN (SELECT uid FROM cells WHERE gold IS NULL)),
    counts AS (SELECT i, sum(f[i]) AS c FROM flags, range(1, {len(_tri_sql())} + 1) t(i) GROUP BY 1 HAVING sum(f[i]) > 0),
    ranked AS (SELECT list(i ORDER BY i > {len(TARGETS)}, c, i) AS o FROM counts),
    placed AS (SELECT uid, array_to_string(list_transform(range(1, len(o) + 1), lambda k: list_sum(list_transform(o[1:k], lambda i: f[i])) % 2), '') AS place FROM flags, ranked),
    folds AS (SELECT uid, CAST((row_number() OVER (ORDER BY place, sha256('42|' || uid), uid) - 1) % 5 AS INTEGER) AS fold FROM placed)"""


def _tri_sql():
    return [pos(t) for t in TARGETS] + [neg(t) for t in TARGETS] + [f"NOT {USE.format(t)}" for t in TARGETS]


@query("x03_membership", sql("WITH " + _fold_sql() + """
    SELECT uid, fold, 'weak' AS split FROM folds UNION ALL SELECT DISTINCT uid, -1, 'gold_holdout' FROM cells WHERE gold IS NOT NULL""", "wide_new", "cells"))
def fold_membership(spark, d):
    return _fold_members(spark, d)


@query("x03_stratified_folds", sql("WITH " + _fold_sql() + f"""
    , everyone AS (SELECT uid, fold FROM folds UNION ALL SELECT DISTINCT uid, -1 FROM cells WHERE gold IS NOT NULL)
    SELECT e.fold AS split_fold, target, count(*) AS studies, count(*) FILTER ({pos('new')}) AS positive, count(*) FILTER ({neg('new')}) AS negative,
           count(*) FILTER (NOT {USE.format('new')}) AS excluded FROM cells c JOIN everyone e ON c.uid = e.uid GROUP BY 1, 2""", "wide_new", "cells"))
def stratified_folds(spark, d):
    members = materialize(_fold_members(spark, d))
    cells = melt(m.wide(spark, d, "new"), TARGETS, ["uid"])
    return splits.distribution(cells, members, "uid", "value")


def _need_sql(folds: int = 5) -> str:
    """Dealing by remaining need in SQL: rounds by recursion over patterns, then round by round all places of all folds
    in the order of their needs beside the carriers in the order of their digests."""
    lists = ", ".join(f"CAST(coalesce({flag}, false) AS BIGINT)" for flag in _tri_sql())
    width = len(_tri_sql())
    room = ", ".join(f"n // {folds} + CASE WHEN {f} < n % {folds} THEN 1 ELSE 0 END" for f in range(folds))
    taken = ", ".join(f"room[{f + 1}] - count(*) FILTER (fold = {f})" for f in range(folds))
    given = ", ".join(f"got[{f * width + i}] + CAST(coalesce(sum(f[{i}]) FILTER (fold = {f}), 0) AS BIGINT)" for f in range(folds) for i in range(1, width + 1))
    places = f"""
        SELECT k, room, got, fold, row_number() OVER (PARTITION BY k ORDER BY cap[fold + 1] * total[done[k + 1]] - n * (got[fold * {width} + done[k + 1]] + j) DESC, room[fold + 1] - j DESC, fold) AS rn
        FROM state, whole, places WHERE k < len(done) AND j < room[fold + 1]"""
    return f"""
    flags AS (SELECT uid, [{lists}] AS f FROM wide_new WHERE uid IN (SELECT uid FROM cells WHERE gold IS NULL)),
    patterns AS (SELECT f, count(*) AS c FROM flags GROUP BY 1),
    rounds AS (
        SELECT 0 AS k, CAST([] AS BIGINT[]) AS done
        UNION ALL
        SELECT k + 1, list_append(any_value(done), arg_min(i, c * {width + 1} + i)) FROM (
            SELECT k, done, i, sum(c * f[i]) AS c FROM rounds, patterns, range(1, {width + 1}) t(i)
            WHERE len(list_filter(done, lambda d: f[d] = 1)) = 0 GROUP BY ALL) WHERE c > 0 GROUP BY k),
    final AS (SELECT done FROM rounds ORDER BY k DESC LIMIT 1),
    whole AS (SELECT done, n, [{room}] AS cap, total FROM final, (SELECT count(*) AS n FROM flags),
        (SELECT list(t ORDER BY i) AS total FROM (SELECT i, CAST(sum(f[i]) AS BIGINT) AS t FROM flags, range(1, {width + 1}) t(i) GROUP BY 1))),
    ranked AS (SELECT uid, f, r, row_number() OVER (PARTITION BY r ORDER BY sha256('42|' || uid), uid) AS rn FROM (
        SELECT uid, f, list_min(list_filter(range(1, len(done) + 1), lambda k: f[done[k]] = 1)) AS r FROM flags, final)),
    places AS (SELECT fold, j FROM range({folds}) t(fold), (SELECT row_number() OVER () - 1 AS j FROM flags) WHERE {folds} * j < (SELECT n FROM whole) + {folds}),
    state AS (
        SELECT CAST(0 AS BIGINT) AS k, cap AS room, CAST(list_transform(range({folds * width}), lambda i: 0) AS BIGINT[]) AS got FROM whole
        UNION ALL
        SELECT p.k + 1, [{taken}], [{given}] FROM ({places}) p JOIN ranked q ON q.r = p.k + 1 AND q.rn = p.rn GROUP BY p.k, p.room, p.got),
    dealt AS (SELECT uid, CAST(fold AS INTEGER) AS fold FROM ({places}) p JOIN ranked q ON q.r = p.k + 1 AND q.rn = p.rn)"""


def _iterative(spark, d):
    gold = [F.col(f"gold__{t}").isNotNull() for t in TARGETS]
    return stratify.iterative_folds(m.wide_with_gold(spark, d).where(~reduce(and_, gold)), "uid", TARGETS, 5, 42)


@query("x03_iterative_folds", sql("WITH " + _need_sql() + " SELECT uid, fold FROM dealt", "wide_new", "cells").replace("WITH ", "WITH RECURSIVE ", 1))
def iterative_folds(spark, d):
    return _iterative(spark, d)


@query("x03_iterative_balance", sql("WITH " + _need_sql() + f"""
    SELECT e.fold AS split_fold, target, count(*) AS studies, count(*) FILTER ({pos('new')}) AS positive, count(*) FILTER ({neg('new')}) AS negative,
           count(*) FILTER (NOT {USE.format('new')}) AS excluded FROM cells c JOIN dealt e ON c.uid = e.uid GROUP BY 1, 2""", "wide_new", "cells").replace("WITH ", "WITH RECURSIVE ", 1))
def iterative_balance(spark, d):
    """Positive, negative and excluded studies per fold and label."""
    return splits.distribution(melt(m.wide(spark, d, "new"), TARGETS, ["uid"]), _iterative(spark, d), "uid", "value")


def _quota(spark, d):
    """The label table, written once since it is read several times, and its quota split."""
    wide = materialize(m.wide(spark, d, "new"))
    size = -(-wide.count() // 10)
    locked = wide.where(F.col("uid") % 170 == 0).select("uid")
    return wide, splits.quota_validation(wide, "uid", TARGETS, size, 42, locked)


@query("x04_quota_sizes", sql("""
    SELECT split, n, locked FROM (SELECT 'valid' AS split, CAST(ceil(count(DISTINCT uid) / 10) AS BIGINT) AS n, count(DISTINCT uid) FILTER (uid % 170 = 0) AS locked FROM cells
    UNION ALL SELECT 'train', CAST(count(DISTINCT uid) - ceil(count(DISTINCT uid) / 10) AS BIGINT), 0 FROM cells)""", "cells"))
def quota_sizes(spark, d):
    _, chosen = _quota(spark, d)
    return chosen.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("uid") % 170 == 0).alias("locked"))


@query("x04_quota_positives", sql(f"""
    SELECT target, true AS within_one FROM (SELECT DISTINCT target FROM cells WHERE {pos('new')})""", "cells"))
def quota_positives(spark, d):
    """Positives of every label in the validation part lie within one of their quota."""
    wide, chosen = _quota(spark, d)
    cells = melt(wide.join(chosen, "uid"), TARGETS, ["uid", "split"])
    counts = cells.groupBy("target").agg(
        F.count_if(F.col("value") > 0.5).alias("all"), F.count_if((F.col("value") > 0.5) & (F.col("split") == "valid")).alias("valid"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("split") == "valid").alias("v"))
    goal = F.rint(F.col("all") * F.col("v") / F.col("n"))
    return counts.where("all > 0").select("target", (F.abs(F.col("valid") - goal) <= 1).alias("within_one"))


@query("x04_quota_membership", sql("""
    SELECT count(DISTINCT uid) AS studies, CAST(ceil(count(DISTINCT uid) / 10) AS BIGINT) AS valid, count(DISTINCT uid) AS distinct_studies,
           count(DISTINCT uid) FILTER (uid % 170 = 0) AS locked_valid, CAST(0 AS BIGINT) AS locked_train, CAST(0 AS BIGINT) AS unknown FROM cells""", "cells"))
def quota_membership(spark, d):
    """Every study is in exactly one part, the size is exact and locked studies validate."""
    wide, chosen = _quota(spark, d)
    rows = chosen.join(wide.select(F.col("uid").alias("_uid")), F.col("uid") == F.col("_uid"), "full")
    locked = F.col("uid") % 170 == 0
    return rows.agg(F.count(F.lit(1)).alias("studies"), F.count_if(F.col("split") == "valid").alias("valid"), F.count_distinct("uid").alias("distinct_studies"),
                    F.count_if(locked & (F.col("split") == "valid")).alias("locked_valid"), F.count_if(locked & (F.col("split") == "train")).alias("locked_train"),
                    F.count_if(F.col("split").isNull() | F.col("_uid").isNull()).alias("unknown"))


@query("x04_quota_validation")
def quota_validation(spark, d):
    wide, chosen = _quota(spark, d)
    return splits.feature_report(wide.join(chosen, "uid"), F.col("split") == "valid", TARGETS)


def _features_sql():
    rows = {f"positive:{t}": pos(t) for t in TARGETS} | {f"negative:{t}": neg(t) for t in TARGETS} | {f"excluded:{t}": f"NOT {USE.format(t)}" for t in TARGETS}
    for side, test in (("positive", pos), ("negative", neg)):
        for level, low, high in (("low", -1, 0.4), ("medium", 0.4, 0.8), ("high", 0.8, 9)):
            rows |= {f"{side}_{level}:{t}": f"({test(t)} AND {conf(t)} >= {low} AND {conf(t)} < {high})" for t in TARGETS}
    count = " + ".join(f"CAST({pos(t)} AS INTEGER)" for t in TARGETS)
    rows |= {f"case_positive_count:{name}": f"({count}) BETWEEN {lo} AND {hi}" for name, lo, hi in (("0", 0, 0), ("1", 1, 1), ("2", 2, 2), ("3-4", 3, 4), ("5+", 5, 99))}
    rows |= {f"pair:{a}+{b}": f"({pos(a)} AND {pos(b)})" for i, a in enumerate(TARGETS) for b in TARGETS[i + 1:]}
    parts = [f"SELECT '{name}' AS feature, count(*) FILTER ({test}) AS full_count, count(*) FILTER ({test} AND uid % 10 = 0) AS valid_count, count(*) AS n, count(*) FILTER (uid % 10 = 0) AS v FROM wide_new"
             for name, test in rows.items()]
    return f"""SELECT feature, full_count, valid_count, round(full_count * v / n, 6) AS target_count, round(valid_count - full_count * v / n, 6) AS deviation,
        round(full_count / n, 6) AS full_fraction, round(valid_count / v, 6) AS valid_fraction FROM ({' UNION ALL '.join(parts)}) WHERE NOT (feature LIKE 'pair:%' AND full_count = 0)"""


@query("a10_feature_report", sql(_features_sql(), "wide_new"))
def feature_report(spark, d):
    return splits.feature_report(m.wide(spark, d, "new"), F.col("uid") % 10 == 0, TARGETS)


@query("x05_manifest", sql("""
    SELECT 'given' AS method, '42' AS seed, 5 AS folds, count(*) FILTER (split = 'gold_holdout') AS gold, """ + ", ".join(
    f"count(*) FILTER (fold = {f}) AS fold_{f}" for f in range(5)) + """,
    sha256(count(*) || '|' || sum(CAST('0x' || substring(h, 1, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substring(h, 16, 15) AS BIGINT)) || '|' ||
           sum(CAST('0x' || substring(h, 31, 15) AS BIGINT)) || '|' || sum(CAST('0x' || substring(h, 46, 15) AS BIGINT))) AS membership_sha256, true AS data_digest_differs
    FROM (SELECT *, sha256(length(uid::VARCHAR) || ':' || uid || '|' || length(fold::VARCHAR) || ':' || fold || '|' || length(split) || ':' || split) AS h FROM members)""", "members"))
def manifest(spark, d):
    """The digest of the membership is the real one; that of the data must change with a single label."""
    members, wide = materialize(m.members(spark, d)), materialize(m.wide(spark, d, "new"))
    changed = wide.withColumn(TARGETS[0], F.when(F.col("uid") == wide.agg(F.min("uid")).first()[0], 0.123).otherwise(F.col(TARGETS[0])))
    rows = splits.manifest(members, wide, "uid", TARGETS, "given", 42, 5)
    other = splits.fingerprint(changed, ["uid", *TARGETS], "digest").first()["digest"]
    return rows.select("method", "seed", "folds", "gold", *[f"fold_{f}" for f in range(5)], "membership_sha256", (F.col("data_sha256") != other).alias("data_digest_differs"))


@query("x06_fold_leaks", """SELECT CAST(0 AS BIGINT) AS overlapping_roles, CAST(0 AS BIGINT) AS missing_models, CAST(0 AS BIGINT) AS not_validated_once,
    CAST(0 AS BIGINT) AS wrong_training, CAST(0 AS BIGINT) AS gold_leaks""")
def fold_leaks(spark, d):
    return splits.split_leaks(splits.fold_roles(_fold_members(spark, d), 5), "uid", 5)


@query("x07_group_folds", f"SELECT count(DISTINCT {group_sql('text')}) AS text_groups, CAST(0 AS BIGINT) AS split_groups, count(*) AS studies FROM documents")
def group_folds(spark, d):
    rows = m.studies(spark, d).withColumn("report_group", report_group(F.col("report")))
    folds = splits.group_folds(rows, "uid", "report_group", ["quality", "toxic"], 5, 42)
    per = folds.groupBy("report_group").agg(F.count_distinct("fold").alias("folds"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("text_groups"), F.count_if(F.col("folds") > 1).alias("split_groups"), F.sum("n").alias("studies"))


def _bands_sql():
    prime = neardup.PRIME
    mins = ", ".join(f"min((n * {(i * 1_000_003 + 7_919) % prime} + {(i * 15_485_863 + 104_729) % prime}) % {prime}) AS m{i}" for i in range(50))
    keys = ", ".join("'{}:' || ".format(b) + " || ':' || ".join(f"m{b * 5 + i}" for i in range(5)) for b in range(10))
    return f"""
    WITH keyed AS (SELECT doc_id AS uid, text, {group_sql('text')} AS report_group FROM documents),
    texts AS (SELECT report_group, string_split(trim(lower(regexp_replace(arg_min(text, uid), '{SPACE}', ' ', 'g'))), ' ') AS w FROM keyed GROUP BY 1),
    shingles AS (SELECT report_group, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS s FROM texts),
    hashed AS (SELECT report_group, {mins} FROM (SELECT report_group, CAST('0x' || substring(md5(s), 1, 7) AS BIGINT) AS n FROM shingles) GROUP BY 1),
    bands AS (SELECT report_group, unnest([{keys}]) AS band FROM hashed)"""


def _minhash_sql():
    return _bands_sql() + """,
    flags AS (SELECT report_group, count(*) AS shared FROM bands WHERE band IN (SELECT band FROM bands GROUP BY 1 HAVING count(*) > 1) GROUP BY 1)
    SELECT uid, k.report_group, coalesce(shared, 0) AS shared_bands, CAST(coalesce(shared, 0) > 0 AS INTEGER) AS near_duplicate
    FROM keyed k LEFT JOIN flags f ON k.report_group = f.report_group"""


def _verified_sql(similarity: float = 0.8):
    return _bands_sql() + f""",
    firsts AS (SELECT band, min(report_group) AS a FROM bands GROUP BY 1 HAVING count(*) > 1),
    pairs AS (SELECT DISTINCT a, report_group AS b FROM bands b JOIN firsts f ON b.band = f.band WHERE a <> report_group),
    distinct_shingles AS (SELECT DISTINCT report_group, s FROM shingles),
    sizes AS (SELECT report_group, count(*) AS n FROM distinct_shingles GROUP BY 1),
    common AS (SELECT a, b, count(*) AS c FROM pairs JOIN distinct_shingles x ON x.report_group = a JOIN distinct_shingles y ON y.report_group = b AND y.s = x.s GROUP BY 1, 2),
    found AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM common JOIN sizes x ON x.report_group = a JOIN sizes y ON y.report_group = b WHERE c / (x.n + y.n - c) >= {similarity}::DOUBLE),
    ends AS (SELECT a AS g, b AS other, similarity FROM found UNION ALL SELECT b, a, similarity FROM found),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY similarity DESC, other) AS rn, min(other) OVER (PARTITION BY g) AS smallest FROM ends)
    SELECT uid, k.report_group, other AS partner, round(similarity, 9) AS similarity, least(k.report_group, smallest) AS representative, CAST(g IS NOT NULL AS INTEGER) AS near_duplicate
    FROM keyed k LEFT JOIN ranked r ON k.report_group = r.g AND rn = 1"""


@query("x08_near_duplicates", _minhash_sql())
def near_duplicates(spark, d):
    return neardup.near_duplicates(m.studies(spark, d))


@query("x08_verified_near_duplicates", _verified_sql())
def verified_near_duplicates(spark, d):
    """Partner, similarity and representative of every flagged text."""
    return neardup.verified_near_duplicates(m.studies(spark, d)).withColumn("similarity", F.round("similarity", 9))


# Scoring

HEADS = [f"label_{i}" for i in range(10)]


def _head_rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("features"), *[
        F.when(F.col("label") == i, 0.95).otherwise(0.05).alias(name) for i, name in enumerate(HEADS)])


@query("m01_linear_heads")
def linear_heads(spark, d):
    """Heads on the embeddings from one joint fit, judged by their AUC per label."""
    rows = _head_rows(spark, d)
    scores = melt(heads.score_joint(rows, heads.fit_joint(rows, HEADS), "vec_id"), HEADS, ["vec_id"], "score")
    cells = melt(rows, HEADS, ["vec_id"], "truth").join(scores, ["vec_id", "target"])
    return metrics.auc(cells, ["target"], "truth", "score").select("target", "positive", "negative", F.round("auc", 6).alias("auc"))


@query("m01_first_step", """
    WITH rows AS (SELECT vec_id, label, list_append(list_transform(embedding, lambda v: CAST(v AS DOUBLE)), 1.0::DOUBLE) AS x FROM embeddings),
    heads AS (SELECT l, count(*) FILTER (label = l) AS p, count(*) FILTER (coalesce(label <> l, true)) AS q FROM rows, range(10) t(l) GROUP BY 1),
    weighted AS (SELECT l, coalesce(label = l, false) AS y, 0.9::DOUBLE * CASE WHEN label = l THEN least(greatest(0.9 * q / greatest(0.9 * p, 1), 1), 10) ELSE 1 END AS w, x FROM rows, heads),
    cells AS (SELECT l, y, w, x, i, x[i] AS v FROM weighted, range(1, 66) t(i) WHERE i <= len(x)),
    slopes AS (SELECT l, i, sum(w * (0.5 - CAST(y AS INTEGER)) * v) AS gradient FROM cells GROUP BY 1, 2),
    curves AS (SELECT l, i, j, sum(w * 0.25 * v * x[j]) AS curvature FROM cells, range(1, 66) t(j) WHERE j >= i GROUP BY 1, 2, 3)
    SELECT 'label_' || c.l AS target, CAST(c.i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j, round(gradient, 4) AS gradient, round(curvature, 4) AS curvature
    FROM curves c JOIN slopes s ON c.l = s.l AND c.i = s.i""")
def first_step(spark, d):
    """Gradient (of row i) and upper triangle of the curvature of each head at the start of the joint fit."""
    gradient, curvature = heads.first_step(_head_rows(spark, d), HEADS)
    rows = spark.createDataFrame(list(zip(HEADS, gradient.tolist(), curvature.tolist())), "target string, g array<double>, c array<array<double>>")
    lines = rows.select("target", "g", F.posexplode("c").alias("i", "line"))
    cells = lines.select("target", "i", F.col("g")[F.col("i")].alias("gradient"), F.posexplode("line").alias("j", "curvature")).where("j >= i")
    return cells.select("target", "i", "j", F.round("gradient", 4).alias("gradient"), F.round("curvature", 4).alias("curvature"))


@query("m02_batch_scoring", """
    SELECT vec_id, round(1 / (1 + exp(-list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))))), 6) AS score FROM embeddings""")
def batch_scoring(spark, d):
    def scorer(batch: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        total = np.stack(batch["embedding"]).astype(float).sum(axis=1)
        return pd.DataFrame({"vec_id": batch["vec_id"], "score": 1 / (1 + np.exp(-total))})

    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    scores = materialize(scoring.score_batches(rows, scorer, "vec_id bigint, score double"))
    guards.enforce(scoring.scored_report(rows, scores, "vec_id", "score"), ignore=())
    return scores.withColumn("score", F.round("score", 6))
