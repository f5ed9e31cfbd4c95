"""Label aggregates and comparisons of label sources over long rows (uid, target, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.operators.guards import ContractError, duplicate_keys, enforce_empty, missing_from


def merge_gold(official: DataFrame, weak: DataFrame, key: str, targets: Sequence[str], how: str = "left") -> DataFrame:
    """Official table with weak labels; a gold cell overrides its weak cell.

    ``left`` keeps gold studies without weak labels, ``inner`` drops them.
    """
    gold = official.select(key, *[L.col(t).cast("float").alias(f"gold__{t}") for t in targets])
    joined = gold.join(weak.select(key, *[L.parse_label(L.col(t)).alias(t) for t in targets]), key, how)
    return joined.select(key, *[L.col(f"gold__{t}") for t in targets],
                         *[F.coalesce(L.col(f"gold__{t}"), L.col(t)).alias(t) for t in targets])


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join that refuses duplicate keys on either side."""
    for side in (left, right):
        enforce_empty(duplicate_keys(side, [key]), f"duplicate {key}")
    return left.join(right, key, how)


def coverage_audit(official: DataFrame, weak: DataFrame, key: str) -> DataFrame:
    """Rows with both sources or with one only."""
    sides = official.select(key, F.lit(1).alias("_o"), F.lit(0).alias("_w")).unionByName(
        weak.select(key, F.lit(0).alias("_o"), F.lit(1).alias("_w")))
    sides = sides.groupBy(key).agg(F.max("_o").alias("_o"), F.max("_w").alias("_w"))
    return sides.agg(F.count_if(F.expr("_o = 1 AND _w = 1")).alias("both"), F.count_if(F.expr("_o = 1 AND _w = 0")).alias("official_only"),
                     F.count_if(F.expr("_o = 0 AND _w = 1")).alias("weak_only"))


def drop_unlabelled(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    return df.dropna(how="all", subset=list(targets))


def evidence_counts(cells: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Positive, negative and excluded cells per group, and whether an AUC exists."""
    v = F.col(value)
    return cells.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(L.positive(v)).alias("positive"), F.count_if(L.negative(v)).alias("negative"),
        F.count_if(L.excluded(v)).alias("excluded"),
    ).withColumn("auc_available", (F.col("positive") > 0) & (F.col("negative") > 0))


def positive_weight(cells: DataFrame, value: str) -> DataFrame:
    """Confidence-weighted negative to positive ratio per target, clipped to [1, 10]."""
    c, v = L.confidence(F.col(value)), F.col(value)
    sums = cells.groupBy("target").agg(
        F.sum(F.when(L.positive(v), c).otherwise(0.0)).alias("pos"), F.sum(F.when(L.positive(v), 0.0).otherwise(c)).alias("neg"))
    return sums.select("target", "pos", "neg", weight_ratio(F.col("pos"), F.col("neg")).alias("pos_weight"))


def weight_ratio(pos: Column, neg: Column) -> Column:
    return F.least(F.greatest(neg / F.greatest(pos, F.lit(1.0)), F.lit(1.0)), F.lit(10.0))


def comparison_rows(old: DataFrame, blend: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old, blended and new scores aligned by key; every key of ``new`` must be in both others."""
    for other in (old, blend):
        enforce_empty(missing_from(new, other, keys), "new labels without a partner to compare with")
    joined = new.join(old, list(keys), "left").join(blend, list(keys), "left")
    delta = F.col("new_score") - F.col("old_score")
    crossed = (F.col("old_score") >= 0.5) != (F.col("new_score") >= 0.5)
    return joined.withColumn("delta", delta).withColumn("direction_disagreement", crossed.cast("int"))


def comparison_metrics(rows: DataFrame) -> DataFrame:
    """Paired, masked and crossing cells and the mean absolute difference, per target and overall (target NULL)."""
    paired = F.col("new_score").isNotNull()
    return rows.groupingSets([[], [F.col("target")]], "target").agg(
        F.count(F.lit(1)).alias("total_items"), F.count_if(paired).alias("paired"), F.count_if(~paired).alias("masked"),
        F.sum("direction_disagreement").alias("disagreements"),
        F.round(F.avg(F.when(paired, F.abs("delta"))), 6).alias("mean_absolute_difference"))


def gold_disagreements(cells: DataFrame, source: str, gold: str) -> DataFrame:
    """Cells where a source and the gold label lie on different sides of 0.5."""
    both = cells.where(F.col(gold).isNotNull() & F.col(source).isNotNull())
    return both.groupBy("target").agg(F.count(F.lit(1)).alias("cells"),
                                      F.count_if((F.col(gold) >= 0.5) != (F.col(source) >= 0.5)).alias("disagreements"))


def flip_statistics(cells: DataFrame, old: str, new: str, groups: Sequence[str] = ("target",)) -> DataFrame:
    """How labels moved between two sources; a flip needs a direction on both sides."""
    o, n = F.col(old), F.col(new)
    up, down = L.negative(o) & L.positive(n), L.positive(o) & L.negative(n)
    both = L.usable(o) & L.usable(n)
    co, cn = L.confidence(o), L.confidence(n)
    return cells.groupBy(*groups).agg(
        F.count_if(both).alias("comparable"), F.count_if(up).alias("neg_to_pos"), F.count_if(down).alias("pos_to_neg"),
        F.round(F.count_if(up | down) / F.count_if(both), 6).alias("flip_rate"),
        F.round(F.avg(L.positive(o).cast("double")), 6).alias("old_positive_rate"),
        F.round(F.avg(L.positive(n).cast("double")), 6).alias("new_positive_rate"),
        F.round(F.avg(o), 6).alias("old_mean"), F.round(F.avg(n), 6).alias("new_mean"),
        F.round(F.sum(co), 4).alias("old_weight"), F.round(F.sum(cn), 4).alias("new_weight"),
        F.count_if(o == 0.5).alias("old_neutral"), F.count_if(n == 0.5).alias("new_neutral"),
        *[F.round(weight_ratio(F.sum(F.when(L.positive(v), c).otherwise(0.0)), F.sum(F.when(L.positive(v), 0.0).otherwise(c))), 6).alias(f"{name}_pos_weight")
          for name, v, c in (("old", o, co), ("new", n, cn))])


def flip_cube(cells: DataFrame, old: str, new: str, first: str, second: str = "target") -> DataFrame:
    """Flip and positive rates over every combination of two dimensions (NULL = all)."""
    o, n = F.col(old), F.col(new)
    flip = (L.negative(o) & L.positive(n)) | (L.positive(o) & L.negative(n))
    return cells.cube(first, second).agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(flip).alias("flips"),
        F.round(F.count_if(flip) / F.count(F.lit(1)), 6).alias("flip_rate"),
        F.round(F.avg(L.positive(n).cast("double")), 6).alias("positive_rate"))


def tri_state_distribution(cells: DataFrame, value: str) -> DataFrame:
    """YES, NO and UNK counts and shares per target."""
    v = F.col(value)
    counts = cells.groupBy("target").agg(
        F.count(F.lit(1)).alias("cells"), *[F.count_if(L.word(v) == w).alias(w.lower()) for w in ("YES", "NO", "UNK")])
    return counts.select("*", *[F.round(F.col(w) / F.col("cells"), 6).alias(f"{w}_share") for w in ("yes", "no", "unk")])


def gold_contingency(cells: DataFrame, value: str, gold: str) -> DataFrame:
    """Gold positives and negatives split by what the other source says."""
    v, g = F.col(value), F.col(gold)
    return cells.where(g.isNotNull()).groupBy("target").agg(
        F.count(F.lit(1)).alias("gold"), F.count_if(g > 0.5).alias("gold_positive"),
        *[F.count_if((L.word(v) == w) & ((g > 0.5) if side == "positive" else ~(g > 0.5))).alias(f"{side}_{w.lower()}")
          for side in ("positive", "negative") for w in ("YES", "NO", "UNK")])


def pair_lift(n: Column, together: Column, count_a: Column, count_b: Column) -> Column:
    """Joint share over the product of single shares; in doubles, since products of counts outgrow a long."""
    n, together, a, b = (c.cast("double") for c in (n, together, count_a, count_b))
    return F.when((a > 0) & (b > 0), n * together / (a * b))


def cooccurrence(wide: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Joint positives and lift of every label pair, in one pass over the studies.

    The number of pairs follows from the label list, not from the data, so each
    pair is one conditional count and no rows are ever paired.
    """
    flags = {t: L.positive(L.col(t)) for t in targets}
    pairs = list(combinations(targets, 2))
    counted = wide.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(flag).alias(f"one_{i}") for i, flag in enumerate(flags.values())],
                       *[F.count_if(flags[a] & flags[b]).alias(f"two_{i}") for i, (a, b) in enumerate(pairs)])
    order = list(targets)
    rows = F.array(*[F.struct(F.lit(a).alias("label_a"), F.lit(b).alias("label_b"), F.col(f"two_{i}").alias("together"),
                              F.col(f"one_{order.index(a)}").alias("count_a"), F.col(f"one_{order.index(b)}").alias("count_b"), F.col("n"))
                     for i, (a, b) in enumerate(pairs)])
    lift = pair_lift(F.col("n"), F.col("together"), F.col("count_a"), F.col("count_b"))
    return counted.select(F.inline(rows)).withColumn("lift", F.round(lift, 6))


def positives_per_study(wide: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Share of studies with two or more positives and with none, and the mean."""
    count = L.positives([L.col(t) for t in targets])
    return wide.select(count.alias("k")).agg(
        F.count(F.lit(1)).alias("studies"), F.round(F.avg((F.col("k") >= 2).cast("double")), 6).alias("two_or_more"),
        F.round(F.avg((F.col("k") == 0).cast("double")), 6).alias("none"), F.round(F.avg("k"), 6).alias("mean_positives"))


def group_flags(wide: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    return wide.select(key, *[L.any_positive([L.col(t) for t in members]).alias(name) for name, members in groups.items()])


def review_queue(findings: DataFrame, focus: Sequence[str], score_focus: Sequence[str]) -> DataFrame:
    """Findings of the focus targets with a hint on what to check; a missing label shows as unknown."""
    hint = (F.when(~F.col("target").isin(*score_focus) & F.col("report_status").isin("PRESENT", "UNCERTAIN"), "check degree, extent or site")
            .when(F.col("target").isin(*score_focus) & (F.col("label") > 0.5), "check amount and wording").otherwise(""))
    return findings.where(F.col("target").isin(*focus)).withColumn("hint", hint).withColumn(
        "shown_label", F.coalesce(F.format_number("label", 3), F.lit("UNKNOWN")))


def require_no_partial_gold(wide: DataFrame, targets: Sequence[str]) -> None:
    bad = wide.where(L.is_partial_gold([L.col(f"gold__{t}") for t in targets]))
    if not bad.isEmpty():
        raise ContractError("a study has some gold labels but not all; say first where it belongs")
