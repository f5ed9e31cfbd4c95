"""Label parsing, evidence, comparison of sources and label statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.operators import catalog, joins, metrics
from sliceweave.operators import labels as ops
from sliceweave.operators import windows
from sliceweave.operators.reshape import melt
from sliceweave.plans import models as m
from sliceweave.plans.models import TARGETS, sql
from sliceweave.plans.registry import query
from sliceweave.session import materialize
from sliceweave.sources.tables import table

POS, NEG, USE = "coalesce(({0}) > 0.5, false)", "coalesce(({0}) < 0.5, false)", "coalesce(({0}) <> 0.5, false)"


def pos(c):
    return POS.format(c)


def neg(c):
    return NEG.format(c)


def conf(c):
    return f"coalesce(2 * abs({c} - 0.5), 0)"


_LABEL_TEXT = """CASE o_orderkey % 9 WHEN 0 THEN ' yes ' WHEN 1 THEN 'No' WHEN 2 THEN 'unk' WHEN 3 THEN 'nan' WHEN 4 THEN '' WHEN 5 THEN '1.7'
    WHEN 6 THEN 'maybe' ELSE CASE WHEN o_orderkey % 101 = 100 THEN '1.00' ELSE '0.' || lpad(CAST(o_orderkey % 101 AS VARCHAR), 2, '0') END END"""


@query("p01_parse_label", """
    SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 9 = 0 THEN 1.0 WHEN o_orderkey % 9 = 1 THEN 0.0 WHEN o_orderkey % 9 = 2 THEN 0.5
           WHEN o_orderkey % 9 <= 6 THEN NULL ELSE round(CAST(CAST((o_orderkey % 101) / 100 AS FLOAT) AS DOUBLE), 6) END::DOUBLE AS label FROM orders""")
def parse_label(spark, d):
    key = F.col("o_orderkey")
    number = F.when(key % 101 == 100, "1.00").otherwise(F.concat(F.lit("0."), F.lpad((key % 101).cast("string"), 2, "0")))
    text = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in (0, " yes ", 1, "No", 2, "unk", 3, "nan", 4, "", 5, "1.7", 6, "maybe")]),
                                   (key % 9).cast("int")), number)
    return table(spark, d, "orders").select(key.alias("uid"), F.round(L.parse_label(text).cast("double"), 6).alias("label"))


@query("p02_strict_gold", """
    SELECT d.doc_id AS uid, CASE WHEN quality IS NOT NULL THEN CAST(quality AS VARCHAR) || CAST(toxic AS VARCHAR) END AS gold
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def strict_gold(spark, d):
    gold = L.strict_gold([F.col("quality"), F.col("toxic")])
    return m.studies(spark, d).select("uid", F.array_join(F.transform(gold, lambda v: v.cast("string")), "").alias("gold"))


@query("p03_gold_flags", """
    SELECT lang, count(*) FILTER (l.doc_id IS NOT NULL) AS gold, count(*) FILTER (l.doc_id IS NULL) AS weak, CAST(0 AS BIGINT) AS partial_gold
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def gold_flags(spark, d):
    values = [F.col("quality"), F.col("toxic")]
    return m.studies(spark, d).groupBy("lang").agg(
        F.count_if(L.is_gold(values)).alias("gold"), F.count_if(~L.is_gold(values)).alias("weak"), F.count_if(L.is_partial_gold(values)).alias("partial_gold"))


def _merged(spark, d, how):
    official, weak = m.wide(spark, d, "gold"), m.wide(spark, d, "new")
    return ops.merge_gold(official, weak, "uid", TARGETS, how)


_MERGED = "SELECT w.uid, " + ", ".join(
    f"round(CAST(CAST(coalesce(g.{t}, w.{t}) AS FLOAT) AS DOUBLE), 6) AS {t}" for t in TARGETS) + " FROM wide_new w JOIN wide_gold g ON w.uid = g.uid"


@query("p04_gold_override", sql(_MERGED, "wide_new", "wide_gold"))
def gold_override(spark, d):
    return _merged(spark, d, "left").select("uid", *[F.round(F.col(t).cast("double"), 6).alias(t) for t in TARGETS])


@query("p05_drop_unlabelled", """
    SELECT d.doc_id AS uid, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def drop_unlabelled(spark, d):
    return ops.drop_unlabelled(m.studies(spark, d), ["quality", "toxic"]).select("uid", "quality", "toxic")


@query("p06_evidence_flags", sql(f"""
    SELECT uid, target, {pos('new')} AS positive, {neg('new')} AS negative, NOT {USE.format('new')} AS excluded FROM cells""", "cells"))
def evidence_flags(spark, d):
    v = F.col("new")
    return m.cells(spark, d).select("uid", "target", L.positive(v).alias("positive"), L.negative(v).alias("negative"), L.excluded(v).alias("excluded"))


@query("p07_confidence", sql(f"""
    SELECT uid, target, round({conf('new')}, 6) AS confidence, CAST(new IS NOT NULL AS INTEGER) AS mask FROM cells""", "cells"))
def confidence(spark, d):
    return m.cells(spark, d).select("uid", "target", F.round(L.confidence(F.col("new")), 6).alias("confidence"), L.label_mask(F.col("new")).alias("mask"))


@query("p08_confidence_bands", sql(f"""
    SELECT target, CASE WHEN {pos('new')} THEN 'positive_' WHEN {neg('new')} THEN 'negative_' END ||
           CASE WHEN {conf('new')} < 0.4 THEN 'low' WHEN {conf('new')} < 0.8 THEN 'medium' ELSE 'high' END AS band, count(*) AS cells
    FROM cells GROUP BY 1, 2""", "cells"))
def confidence_bands(spark, d):
    return m.cells(spark, d).groupBy("target", L.band(F.col("new")).alias("band")).agg(F.count(F.lit(1)).alias("cells"))


@query("p09_case_mix", sql(f"""
    SELECT bucket, count(*) AS studies FROM (SELECT CASE WHEN k <= 2 THEN CAST(k AS VARCHAR) WHEN k <= 4 THEN '3-4' ELSE '5+' END AS bucket
    FROM (SELECT uid, count(*) FILTER ({pos('new')}) AS k FROM cells GROUP BY 1)) GROUP BY 1""", "cells"))
def case_mix(spark, d):
    rows = m.wide(spark, d, "new").select(L.case_mix([F.col(t) for t in TARGETS]).alias("bucket"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("studies"))


@query("p10_row_quality", sql("SELECT uid, round((" + " + ".join(conf(t) for t in TARGETS) + ") / 4 * ((" + " + ".join(
    f"CAST({USE.format(t)} AS INTEGER)" for t in TARGETS) + ") / 4), 6) AS quality FROM wide_new", "wide_new"))
def row_quality(spark, d):
    return m.wide(spark, d, "new").select("uid", F.round(L.row_quality([F.col(t) for t in TARGETS]), 6).alias("quality"))


@query("p11_series_type", sql("""
    SELECT plane || '_' || CASE WHEN fat = 1 THEN 'FS' ELSE 'nonFS' END AS type, count(*) AS series FROM series GROUP BY 1""", "series"))
def series_type(spark, d):
    return m.series(spark, d).groupBy(catalog.series_type(F.col("plane"), F.col("fat")).alias("type")).agg(F.count(F.lit(1)).alias("series"))


@query("p13_binary_flag", """
    SELECT o_orderkey AS uid, CASE WHEN o_orderkey % 5 IN (0, 1) THEN CAST(o_orderkey % 5 AS INTEGER) END AS flag FROM orders""")
def binary_flag(spark, d):
    text = F.when(F.col("o_orderkey") % 5 == 4, "x").otherwise((F.col("o_orderkey") % 5).cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), L.binary_flag(text).alias("flag"))


@query("p22_pair_differences", sql("""
    SELECT uid, target, round(new - old, 6) AS delta, CAST((old >= 0.5) <> (new >= 0.5) AS INTEGER) AS crossed FROM cells""", "cells"))
def pair_differences(spark, d):
    rows = _comparison(spark, d)
    return rows.select("uid", "target", F.round("delta", 6).alias("delta"), F.col("direction_disagreement").alias("crossed"))


@query("p23_blend", sql("""
    SELECT uid, target, round(0.8 * new + 0.2 * old, 6) AS blend, round(new, 6) AS recovered FROM cells""", "cells"))
def blend(spark, d):
    mixed = L.blend(F.col("new"), F.col("old"))
    return m.cells(spark, d).select("uid", "target", F.round(mixed, 6).alias("blend"), F.round(L.unblend(mixed, F.col("old")), 6).alias("recovered"))


@query("p25_first_mapping", sql("""
    SELECT uid, target, CASE report_status WHEN 'PRESENT' THEN 0.95 WHEN 'ABSENT' THEN 0.05 WHEN 'UNCERTAIN' THEN label END::DOUBLE AS score,
           CASE report_status WHEN 'PRESENT' THEN 1.0 WHEN 'ABSENT' THEN 1.0 WHEN 'UNCERTAIN' THEN 0.25 ELSE 0.0 END::DOUBLE AS weight,
           CAST(report_status IN ('PRESENT', 'ABSENT') OR (report_status = 'UNCERTAIN' AND label IS NOT NULL) AS INTEGER) AS mask FROM answers""", "answers"))
def first_mapping(spark, d):
    from sliceweave.operators import extraction

    rows = extraction.findings(extraction.parse_responses(m.answers(spark, d), ["quality", "toxic"]))
    rows = rows.withColumn("_m", L.first_version_mapping(F.col("report_status"), F.col("label")))
    return rows.select(F.col("uid").cast("long").alias("uid"), "target", F.col("_m.target").alias("score"), F.col("_m.weight"), F.col("_m.mask"))


def _flag(cols):
    return "CASE WHEN " + " OR ".join(USE.format(c) for c in cols) + " THEN CAST(" + " OR ".join(pos(c) for c in cols) + " AS INTEGER) END"


@query("p26_group_flags", sql(f"""
    SELECT uid, {_flag(['discount', 'tax'])} AS any_price, {_flag(['quantity', 'returned'])} AS any_goods FROM wide_new""", "wide_new"))
def group_flags(spark, d):
    return ops.group_flags(m.wide(spark, d, "new"), "uid", {"any_price": ["discount", "tax"], "any_goods": ["quantity", "returned"]})


# Joins of label sources

@query("j01_inner_labels", """
    SELECT d.doc_id AS uid, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def inner_labels(spark, d):
    gold = table(spark, d, "labels").withColumnRenamed("doc_id", "uid")
    return m.studies(spark, d).select("uid", "lang").join(gold, "uid", "inner")


@query("j02_one_to_one", """
    SELECT d.doc_id AS uid, source, quality, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def one_to_one(spark, d):
    gold = table(spark, d, "labels").withColumnRenamed("doc_id", "uid")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uid"), "source")
    return ops.one_to_one(docs, gold, "uid")


@query("j03_left_labels", """
    SELECT d.doc_id AS uid, d.lang, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def left_labels(spark, d):
    return m.studies(spark, d).select("uid", "lang", "quality", "toxic")


@query("j03_coverage_audit", """
    SELECT count(*) FILTER (a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS both, count(*) FILTER (b.doc_id IS NULL) AS official_only,
           count(*) FILTER (a.doc_id IS NULL) AS weak_only FROM documents a FULL JOIN labels b ON a.doc_id = b.doc_id""")
def coverage_audit(spark, d):
    return ops.coverage_audit(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id")


def _comparison(spark, d):
    rows = materialize(m.cells(spark, d).select("uid", "target", "old", "new"))  # three sides and their guards read it
    old = rows.select("uid", "target", F.col("old").alias("old_score"))
    blended = rows.select("uid", "target", L.blend(F.col("new"), F.col("old")).alias("blend_score"))
    new = rows.select("uid", "target", F.col("new").alias("new_score"))
    return ops.comparison_rows(old, blended, new, ["uid", "target"])


@query("j08_three_way_alignment", sql("""
    SELECT uid, target, round(old, 6) AS old_score, round(0.8 * new + 0.2 * old, 6) AS blend_score, round(new, 6) AS new_score FROM cells""", "cells"))
def three_way(spark, d):
    rows = _comparison(spark, d)
    return rows.select("uid", "target", *[F.round(c, 6).alias(c) for c in ("old_score", "blend_score", "new_score")])


@query("j13_checked_broadcast", """
    SELECT l_orderkey AS uid, count(*) AS lines, max(o_orderpriority) AS priority FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def checked_broadcast(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("uid")).agg(F.count(F.lit(1)).alias("lines"))
    meta = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderpriority").alias("priority"))
    return joins.with_metadata(lines, meta, "uid", "inner")


# Label statistics

@query("a04_positive_weight", sql(f"""
    SELECT target, round(p, 6) AS pos, round(n, 6) AS neg, round(least(greatest(n / greatest(p, 1), 1), 10), 6) AS pos_weight FROM (
    SELECT target, sum(CASE WHEN {pos('new')} THEN {conf('new')} ELSE 0 END) AS p, sum(CASE WHEN {pos('new')} THEN 0 ELSE {conf('new')} END) AS n
    FROM cells WHERE gold IS NULL GROUP BY 1)""", "cells"))
def positive_weight(spark, d):
    rows = ops.positive_weight(m.cells(spark, d).where(F.col("gold").isNull()), "new")
    return rows.select("target", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "pos_weight")])


@query("a08_fold_distribution", sql(f"""
    SELECT m.fold AS split_fold, target, count(*) AS studies, count(*) FILTER ({pos('new')}) AS positive, count(*) FILTER ({neg('new')}) AS negative,
           count(*) FILTER (NOT {USE.format('new')}) AS excluded FROM cells c JOIN members m ON c.uid = m.uid GROUP BY 1, 2""", "cells", "members"))
def fold_distribution(spark, d):
    from sliceweave.operators import splits

    return splits.distribution(m.cells(spark, d), m.members(spark, d), "uid", "new")


@query("a09_label_summary", """
    SELECT target, lang, count(*) AS cells, count(*) FILTER (v = 1) AS positive, count(*) FILTER (v = 0) AS negative, count(*) FILTER (v IS NULL) AS excluded,
           count(*) FILTER (v = 1) > 0 AND count(*) FILTER (v = 0) > 0 AS auc_available
    FROM (SELECT lang, 'quality' AS target, quality AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
          UNION ALL SELECT lang, 'toxic', toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1, 2""")
def label_summary(spark, d):
    """Study scan, left join with gold, evidence and a label summary per language."""
    cells = melt(m.studies(spark, d), ["quality", "toxic"], ["uid", "lang"])
    return ops.evidence_counts(cells, ["target", "lang"], "value")


@query("a11_comparison_metrics", sql("""
    SELECT target, count(*) AS total_items, count(new) AS paired, count(*) - count(new) AS masked,
           CAST(sum(CAST((old >= 0.5) <> (new >= 0.5) AS INTEGER)) AS BIGINT) AS disagreements, round(avg(abs(new - old)), 6) AS mean_absolute_difference
    FROM cells GROUP BY GROUPING SETS ((), (target))""", "cells"))
def comparison_metrics(spark, d):
    return ops.comparison_metrics(_comparison(spark, d))


@query("a12_gold_disagreements", sql("""
    SELECT target, count(*) AS cells, count(*) FILTER ((gold >= 0.5) <> (old >= 0.5)) AS disagreements FROM cells WHERE gold IS NOT NULL AND old IS NOT NULL GROUP BY 1""", "cells"))
def gold_disagreements(spark, d):
    return ops.gold_disagreements(m.cells(spark, d), "old", "gold")


_UP, _DOWN = f"({neg('old')} AND {pos('new')})", f"({pos('old')} AND {neg('new')})"


def _weight_sql(c):
    part = f"sum(CASE WHEN {pos(c)} THEN {{}} ELSE {{}} END)"
    return f"round(least(greatest({part.format(0, conf(c))} / greatest({part.format(conf(c), 0)}, 1), 1), 10), 6)"


@query("a16_flip_statistics", sql(f"""
    SELECT target, count(*) FILTER ({USE.format('old')} AND {USE.format('new')}) AS comparable, count(*) FILTER ({_UP}) AS neg_to_pos, count(*) FILTER ({_DOWN}) AS pos_to_neg,
           round(count(*) FILTER ({_UP} OR {_DOWN}) / count(*) FILTER ({USE.format('old')} AND {USE.format('new')}), 6) AS flip_rate,
           round(avg(CAST({pos('old')} AS INTEGER)), 6) AS old_positive_rate, round(avg(CAST({pos('new')} AS INTEGER)), 6) AS new_positive_rate,
           round(avg(old), 6) AS old_mean, round(avg(new), 6) AS new_mean, round(sum({conf('old')}), 4) AS old_weight, round(sum({conf('new')}), 4) AS new_weight,
           count(*) FILTER (old = 0.5) AS old_neutral, count(*) FILTER (new = 0.5) AS new_neutral, {_weight_sql('old')} AS old_pos_weight, {_weight_sql('new')} AS new_pos_weight
    FROM cells WHERE gold IS NULL GROUP BY 1""", "cells"))
def flip_statistics(spark, d):
    return ops.flip_statistics(m.cells(spark, d).where(F.col("gold").isNull()), "old", "new")


@query("a17_flip_cube", sql(f"""
    SELECT o_orderstatus AS lang, target, count(*) AS cells, count(*) FILTER ({_UP} OR {_DOWN}) AS flips, round(count(*) FILTER ({_UP} OR {_DOWN}) / count(*), 6) AS flip_rate,
           round(avg(CAST({pos('new')} AS INTEGER)), 6) AS positive_rate FROM cells JOIN orders ON uid = o_orderkey GROUP BY CUBE (o_orderstatus, target)""", "cells"))
def flip_cube(spark, d):
    lang = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.col("o_orderstatus").alias("lang"))
    return ops.flip_cube(m.cells(spark, d).join(lang, "uid"), "old", "new", "lang")


@query("a18_tri_state", sql(f"""
    SELECT *, round(yes / cells, 6) AS yes_share, round(no / cells, 6) AS no_share, round(unk / cells, 6) AS unk_share FROM (
    SELECT target, count(*) AS cells, count(*) FILTER ({pos('new')}) AS yes, count(*) FILTER ({neg('new')}) AS no, count(*) FILTER (NOT {USE.format('new')}) AS unk
    FROM cells GROUP BY 1)""", "cells"))
def tri_state(spark, d):
    return ops.tri_state_distribution(m.cells(spark, d), "new")


def _ctg(side, w):
    cond = {"yes": pos("new"), "no": neg("new"), "unk": f"NOT {USE.format('new')}"}[w]
    return f"count(*) FILTER ({cond} AND gold {'>' if side == 'positive' else '<='} 0.5) AS {side}_{w}"


@query("a19_gold_contingency", sql("SELECT target, count(*) AS gold, count(*) FILTER (gold > 0.5) AS gold_positive, " + ", ".join(
    _ctg(s, w) for s in ("positive", "negative") for w in ("yes", "no", "unk")) + " FROM cells WHERE gold IS NOT NULL GROUP BY 1", "cells"))
def gold_contingency(spark, d):
    return ops.gold_contingency(m.cells(spark, d), "new", "gold")


_PAIRS = sql(f"""
    SELECT a.target AS label_a, b.target AS label_b, coalesce(any_value(together), 0) AS together, a.k AS count_a, b.k AS count_b, n,
           CASE WHEN a.k * b.k > 0 THEN round(n * coalesce(any_value(together), 0) / (a.k * b.k), 6) END AS lift
    FROM (SELECT target, count(*) FILTER ({pos('new')}) AS k, count(*) AS n FROM cells GROUP BY 1) a
    JOIN (SELECT target, count(*) FILTER ({pos('new')}) AS k FROM cells GROUP BY 1) b
      ON list_position(['discount', 'tax', 'quantity', 'returned'], a.target) < list_position(['discount', 'tax', 'quantity', 'returned'], b.target)
    LEFT JOIN (SELECT x.target AS ta, y.target AS tb, count(*) AS together FROM cells x JOIN cells y ON x.uid = y.uid
               WHERE x.new > 0.5 AND y.new > 0.5 GROUP BY 1, 2) t ON t.ta = a.target AND t.tb = b.target
    GROUP BY a.target, b.target, a.k, b.k, n""", "cells")


@query("j15_cooccurrence_pairs", _PAIRS)
def cooccurrence_pairs(spark, d):
    return ops.cooccurrence(m.wide(spark, d, "new"), TARGETS)


@query("a20_top_lift", f"SELECT label_a, label_b, together, lift FROM ({_PAIRS}) ORDER BY lift DESC, label_a, label_b LIMIT 10")
def top_lift(spark, d):
    rows = ops.cooccurrence(m.wide(spark, d, "new"), TARGETS)
    return rows.orderBy(F.desc("lift"), "label_a", "label_b").limit(10).select("label_a", "label_b", "together", "lift")


@query("a21_positives_per_study", sql(f"""
    SELECT count(*) AS studies, round(avg(CAST(k >= 2 AS INTEGER)), 6) AS two_or_more, round(avg(CAST(k = 0 AS INTEGER)), 6) AS none, round(avg(k), 6) AS mean_positives
    FROM (SELECT uid, count(*) FILTER ({pos('new')}) AS k FROM cells GROUP BY 1)""", "cells"))
def positives_per_study(spark, d):
    return ops.positives_per_study(m.wide(spark, d, "new"), TARGETS)


@query("w14_largest_disagreements", sql("""
    SELECT target, uid, round(new - old, 6) AS delta, CAST(rank AS INTEGER) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY abs(new - old) DESC, uid) AS rank FROM cells WHERE new IS NOT NULL) WHERE rank <= 10""", "cells"))
def largest_disagreements(spark, d):
    rows = windows.largest_disagreements(m.cells(spark, d), F.col("new") - F.col("old"), ["target"], ["uid"], 10)
    return rows.select("target", "uid", F.round("delta", 6).alias("delta"), "rank")


# Metrics

@query("a05_masked_loss", sql(f"""
    SELECT c.target, round(sum(CASE WHEN new IS NOT NULL THEN -(w * new * ln(p) + (1 - new) * ln(1 - p)) * {conf('new')} ELSE 0 END) / greatest(sum({conf('new')}), 1), 4) AS loss
    FROM (SELECT *, least(greatest(p1, 1e-7), 1 - 1e-7) AS p FROM cells WHERE gold IS NULL) c
    JOIN (SELECT target, least(greatest(n / greatest(p, 1), 1), 10) AS w FROM (
          SELECT target, sum(CASE WHEN {pos('new')} THEN {conf('new')} ELSE 0 END) AS p, sum(CASE WHEN {pos('new')} THEN 0 ELSE {conf('new')} END) AS n
          FROM cells WHERE gold IS NULL GROUP BY 1)) pw ON c.target = pw.target GROUP BY 1""", "cells"))
def masked_loss(spark, d):
    train = m.cells(spark, d).where(F.col("gold").isNull())
    loss = metrics.masked_log_loss(train, "new", "p1", ops.positive_weight(train, "new"), ["target"])
    return loss.select("target", F.round("loss", 4).alias("loss"))


def auc_sql(groups, target="new", score="p1", source="cells", where="true"):
    keys = ", ".join(groups)
    return f"""SELECT {keys}, CAST(sum(y) AS BIGINT) AS positive, CAST(count(*) - sum(y) AS BIGINT) AS negative,
        CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 9) END AS auc
        FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2 AS r
              FROM (SELECT *, CAST({target} > 0.5 AS INTEGER) AS y FROM {source} WHERE {target} <> 0.5 AND {where})) GROUP BY {keys}"""


def _auc(df, groups, target="new", score="p1"):
    return metrics.auc(df, groups, target, score).withColumn("auc", F.round("auc", 9))


@query("a06_auc", sql(auc_sql(["target"]), "cells"))
def auc(spark, d):
    return _auc(m.cells(spark, d), ["target"])


@query("a06_fold_auc", sql(auc_sql(["fold", "target"]), "cells"))
def fold_auc(spark, d):
    return _auc(m.cells(spark, d), ["fold", "target"])


@query("a07_macro_auc", sql(f"SELECT count(auc) AS labels, round(avg(auc), 6) AS macro_auc FROM ({auc_sql(['target'])})", "cells"))
def macro_auc(spark, d):
    macro = metrics.macro_auc(metrics.auc(m.cells(spark, d), ["target"], "new", "p1"))
    return macro.select("labels", F.round("macro_auc", 6).alias("macro_auc"))


@query("a35_subgroup_auc", sql(auc_sql(["o_orderpriority", "target"], source="cells JOIN orders ON uid = o_orderkey"), "cells"))
def subgroup_auc(spark, d):
    groups = table(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), "o_orderpriority")
    return _auc(m.cells(spark, d).join(groups, "uid"), ["o_orderpriority", "target"])


@query("a35_isolated_auc", sql(auc_sql(
    ["isolated", "target"], source=f"(SELECT c.*, k = 1 AS isolated FROM cells c JOIN (SELECT uid, count(*) FILTER ({pos('new')}) AS k FROM cells GROUP BY 1) p ON c.uid = p.uid)"), "cells"))
def isolated_auc(spark, d):
    wide = m.label_sources(spark, d)
    flag = L.positives([F.col(f"new__{t}") for t in TARGETS]) == 1
    from sliceweave.operators.reshape import to_long

    rows = to_long(wide.withColumn("isolated", flag), TARGETS, ["new", "p1"], ["uid", "isolated"])
    return _auc(rows, ["isolated", "target"])


@query("w16_average_rank", sql("""
    SELECT target, round(p1, 9) AS score, count(*) AS ties, round(avg(r), 3) AS average_rank FROM (
    SELECT target, p1, row_number() OVER (PARTITION BY target ORDER BY p1) AS r FROM cells) GROUP BY target, p1""", "cells"))
def average_rank(spark, d):
    rows = windows.average_ranks(m.cells(spark, d), ["target"], "p1")
    return rows.select("target", F.round("p1", 9).alias("score"), "ties", F.round("average_rank", 3).alias("average_rank"))


@query("a36_efficiency", """
    SELECT user_id AS run, round(auc / (0.4 - max(auc) OVER ()) + runtime / 32400, 6) AS efficiency
    FROM (SELECT user_id, count(*) FILTER (event_type = 'click') / count(*) AS auc, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100 AS runtime FROM events GROUP BY 1)""")
def efficiency(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(
        (F.count_if(F.col("event_type") == "click") / F.count(F.lit(1))).alias("auc"),
        (F.sum(F.round(F.col("value") * 100).cast("long")).cast("double") / 100).alias("runtime_seconds"))
    return metrics.efficiency(runs, 0.4).select("run", "efficiency")
