import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.operators import guards, labels, metrics, neardup, splits

TARGETS = ["common", "rare", "missing", "unsure"]


def studies(count=500, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(count):
        out.append((f"u{i:04d}", 0.9 if rng.random() < 0.4 else 0.1, 0.8 if rng.random() < 0.08 else 0.2,
                    None if rng.random() < 0.5 else rng.choice([0.0, 1.0]), rng.choice([0.45, 0.5, 0.55, 0.95])))
    return out


def frame(spark, rows=None, shuffled=False):
    rows = list(rows or studies())
    if shuffled:
        random.Random(8).shuffle(rows)
    df = spark.createDataFrame(rows, "uid string, " + ", ".join(f"{t} double" for t in TARGETS))
    return df.repartition(5) if shuffled else df


def assigned(df):
    return {r[0]: r[1] for r in df.collect()}


def test_folds_are_even_stratified_and_stable(spark):
    rows = studies()
    got = assigned(splits.assign_folds(frame(spark), "uid", TARGETS, 5, 42))
    assert got == assigned(splits.assign_folds(frame(spark, shuffled=True), "uid", TARGETS, 5, 42))
    assert len(got) == 500 and max(np.bincount(list(got.values()))) - min(np.bincount(list(got.values()))) <= 1
    for i in range(4):
        positives = np.bincount([got[r[0]] for r in rows if r[1 + i] is not None and r[1 + i] > 0.5], minlength=5)
        assert positives.max() - positives.min() <= 3, positives


def test_folds_refuse_bad_input(spark):
    df = frame(spark, studies(30))
    with pytest.raises(guards.ContractError):
        splits.assign_folds(df.limit(3), "uid", TARGETS, 5, 42)
    for bad in (df.union(df.limit(1)), df.union(df.limit(1).withColumn("uid", F.lit(None).cast("string")))):
        with pytest.raises(guards.ContractError):
            splits.assign_folds(bad, "uid", TARGETS, 5, 42)
        with pytest.raises(guards.ContractError):
            splits.quota_validation(bad, "uid", TARGETS, 5)
    partial = df.select("*", F.lit(1.0).alias("gold__common"), *[F.lit(None).cast("double").alias(f"gold__{t}") for t in TARGETS[1:]])
    with pytest.raises(guards.ContractError):
        splits.membership(partial, "uid", TARGETS, 5, 42)


def test_locked_studies_must_exist(spark):
    locked = spark.createDataFrame([("nobody",)], "uid string")
    with pytest.raises(guards.ContractError):
        splits.quota_validation(frame(spark), "uid", TARGETS, 50, 1, locked)


def test_counts_beyond_a_long_product(spark):
    many = 4 * 10**9
    row = spark.createDataFrame([(many, many)], "a bigint, b bigint")
    assert row.agg(F.sum(metrics.pair_wins(F.col("a"), F.col("b"), F.lit(0)))).first()[0] == 2 * many**2
    assert row.select(labels.pair_lift(*[F.col("a")] * 4)).first()[0] == 1.0


def test_gold_stays_out_of_weak_folds(spark):
    rows = studies(78)
    df = frame(spark, rows).withColumn("gold", F.col("uid") < "u0058")
    wide = df.select("uid", *TARGETS, *[F.when(F.col("gold"), 1.0).alias(f"gold__{t}") for t in TARGETS])
    members = splits.membership(wide, "uid", TARGETS, 5, 42)
    counts = {r["fold"]: r["count"] for r in members.groupBy("fold").count().collect()}
    assert counts == {-1: 58, 0: 4, 1: 4, 2: 4, 3: 4, 4: 4}
    guards.enforce(splits.split_leaks(splits.fold_roles(members, 5), "uid", 5), ignore=())
    leaked = splits.fold_roles(members, 5).unionByName(splits.fold_roles(members, 5).where("role = 'gold' AND model = 0").withColumn("role", F.lit("train")))
    with pytest.raises(guards.ContractError):
        guards.enforce(splits.split_leaks(leaked, "uid", 5), ignore=())
    assert splits.gold_holdout(wide, TARGETS, 58).where("split = 'valid'").count() == 58
    with pytest.raises(guards.ContractError):
        splits.gold_holdout(wide, TARGETS, 57)


@pytest.mark.parametrize("locked_count", [0, 12])
def test_quota_validation(spark, locked_count):
    rows = studies()
    locked = None if not locked_count else spark.createDataFrame([(r[0],) for r in rows[:locked_count]], "uid string")
    got = assigned(splits.quota_validation(frame(spark), "uid", TARGETS, 50, 1, locked))
    assert got == assigned(splits.quota_validation(frame(spark, shuffled=True), "uid", TARGETS, 50, 1, locked))
    valid = {u for u, s in got.items() if s == "valid"}
    assert len(got) == 500 and len(valid) == 50
    assert {r[0] for r in rows[:locked_count]} <= valid
    for i in range(4):
        positive = [r[0] for r in rows if r[1 + i] is not None and r[1 + i] > 0.5]
        assert abs(len(valid & set(positive)) - round(len(positive) / 10)) <= 1, TARGETS[i]


def test_quota_orders_only_parted_patterns(spark, monkeypatch):
    """Patterns that give all their studies, or locked ones only, are not sorted, and studies are not shuffled to the locked ones."""
    rows = studies()
    df, sorted_rows, sequence = frame(spark), [], splits.Sequence
    monkeypatch.setattr(splits, "Sequence", lambda df, keys, *args, **more: (sorted_rows.append((keys, df.count())), sequence(df, keys, *args, **more))[1])
    locked = spark.createDataFrame([(r[0],) for r in rows[:12]], "uid string")
    got = splits.quota_validation(df, "uid", TARGETS, 50, 1, locked)
    assert got.where("split = 'valid'").count() == 50 and got.count() == 500
    ordered = [n for keys, n in sorted_rows if keys == ["pattern"]]
    assert len(ordered) == 1 and ordered[0] < 500


def test_quota_validation_rejects_bad_sizes(spark):
    for size in (0, 500):
        with pytest.raises(guards.ContractError):
            splits.quota_validation(frame(spark), "uid", TARGETS, size)
    constant = frame(spark).select("uid", *[F.lit(1.0).alias(t) for t in TARGETS])
    assert splits.quota_validation(constant, "uid", TARGETS, 50).where("split = 'valid'").count() == 50


def test_fingerprint(spark):
    first = splits.fingerprint(frame(spark), ["uid", *TARGETS]).first()
    assert first == splits.fingerprint(frame(spark, shuffled=True), ["uid", *TARGETS]).first()
    changed = studies()
    changed[7] = (changed[7][0], 0.91, *changed[7][2:])
    assert first != splits.fingerprint(frame(spark, changed), ["uid", *TARGETS]).first()
    assert first != splits.fingerprint(frame(spark, studies() + studies()[:1]), ["uid", *TARGETS]).first()


def test_equal_texts_share_a_fold(spark):
    rows = frame(spark).withColumn("report_group", F.expr("int(substring(uid, 2)) % 90"))
    folds = splits.group_folds(rows, "uid", "report_group", TARGETS, 5, 1)
    assert folds.groupBy("report_group").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0 and folds.count() == 500


def test_near_duplicates_find_small_edits_only(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(20)]
    rows = [(i, " ".join(t)) for i, t in enumerate(base)]
    rows += [(100 + i, " ".join([*t[:60], "edited", *t[61:]])) for i, t in enumerate(base[:5])]
    rows += [(200, rows[10][1].upper().replace(" ", "\n"))]
    got = {r["uid"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "uid int, report string")).collect()}
    assert {u for u, r in got.items() if r["near_duplicate"]} == {*range(5), *range(100, 105)}
    assert got[200]["report_group"] == got[10]["report_group"] and len(got) == 26


def test_bands(spark):
    df = spark.createDataFrame([(0.69,), (0.7,), (0.9,), (0.05,), (0.5,), (None,)], "v double")
    assert [r[0] for r in df.select(L.band(F.col("v"))).collect()] == ["positive_low", "positive_medium" if 2 * abs(0.7 - 0.5) >= 0.4 else "positive_low",
                                                                      "positive_high", "negative_high", None, None]


@pytest.mark.parametrize("seed", range(4))
def test_frontier_ends_where_no_swap_helps(seed):
    rng = np.random.default_rng(seed)
    flags, quality = rng.integers(0, 2, (30, 12)).astype(float), rng.random(30)
    take, full = rng.integers(1, 4, 30), np.full(30, 9)
    scale, gaps = rng.random(12) + 0.1, rng.integers(-9, 9, 12).astype(float)

    def rows(sign):
        room = full - take if sign > 0 else take
        cost = flags @ (scale * (2 * sign * gaps + 1)) - sign * 0.01 * quality
        return [{"pattern": f"p{i}", "flags": flags[i].tolist(), "room": int(room[i]), "cost": cost[i]} for i in range(30) if room[i] > 0]

    def objective(t):
        return float((scale * (gaps + (t - take) @ flags) ** 2).sum() - 0.01 * t @ quality)

    front = splits.Frontier(rows(-1), rows(1), scale, gaps)
    front.improve()
    after = take + np.array([front.moved.get(f"p{i}", 0) for i in range(30)])
    assert after.sum() == take.sum() and (after >= 0).all() and (after <= full).all()
    assert np.allclose(front.gaps, gaps + (after - take) @ flags) and objective(after) < objective(take)
    for i in range(30):
        for j in range(30):
            if i != j and after[i] > 0 and after[j] < full[j]:
                step = np.zeros(30, int)
                step[i], step[j] = -1, 1
                assert objective(after + step) >= objective(after) - 1e-5
    assert front.rest_is_worse(None, None) and not front.rest_is_worse(-1e9, None) and front.rest_is_worse(1e9, 1e9)


def test_quota_of_many_patterns_does_not_depend_on_the_frontier_cut(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"u{i:05d}", *[rng.choice([None, 0.05, 0.3, 0.6, 0.75, 0.95]) for _ in TARGETS]) for i in range(1500)]
    got = {}
    for frontier, widest in ((1000, 4000), (40, 4000), (40, 40)):
        monkeypatch.setattr(splits, "FRONTIER", frontier)
        monkeypatch.setattr(splits, "WIDEST", widest)
        valid = {u for u, s in assigned(splits.quota_validation(frame(spark, rows), "uid", TARGETS, 150, 1)).items() if s == "valid"}
        got[frontier, widest] = [sum(v is not None and v > 0.5 for u, *vs in rows if u in valid for v in vs[i:i + 1]) for i in range(4)]
        assert len(valid) == 150
        for i in range(4):
            everyone = sum(r[1 + i] is not None and r[1 + i] > 0.5 for r in rows)
            assert abs(got[frontier, widest][i] - round(everyone / 10)) <= 1


def test_leaks_count_every_fold_without_a_row_per_fold(spark):
    """Folds in reach of a bit are not told apart by grouping; others, repeated and missing ones still count."""
    rows = [("a", f, "valid" if f == 0 else "train") for f in (0, 1, 1)] + [("b", f, "gold") for f in (0, 1, 2)] + [
        ("c", f, "train") for f in (0, 99, -1, 99)] + [(None, 0, "valid"), (None, 2, "train"), ("d", None, "train")]
    roles = spark.createDataFrame(rows, "uid string, model int, role string")
    leaks = splits.split_leaks(roles, "uid", 3)
    assert leaks.first().asDict() == {"overlapping_roles": 3, "missing_models": 3, "not_validated_once": 2, "wrong_training": 3, "gold_leaks": 0}
    grouped = re.findall(r"keys=\[uid#\w+, model#\w+\], functions=\[(.*?)\]", leaks._jdf.queryExecution().executedPlan().toString())
    assert not any(grouped)


def test_many_studies_move_at_once(monkeypatch):
    """The number of single swaps does not grow with the studies, and none that helps is left."""
    rng = np.random.default_rng(4)
    flags, quality = rng.integers(0, 2, (60, 6)).astype(float), rng.random(60)
    taken, full = rng.integers(0, 40_000, 60), rng.integers(50_000, 90_000, 60)
    goals = flags.T @ full * (taken.sum() / full.sum())
    scale = 3.0 / goals
    gaps = flags.T @ taken - goals
    row = lambda i, sign, room: {"pattern": f"p{i:02d}", "flags": list(flags[i]), "room": int(room), "cost": float(flags[i] @ (scale * (2 * sign * gaps + 1)) - sign * 0.01 * quality[i])}
    front = splits.Frontier([row(i, -1, taken[i]) for i in range(60)], [row(i, 1, full[i] - taken[i]) for i in range(60)], scale, gaps)
    swaps, swap = [], front.swap
    monkeypatch.setattr(front, "swap", lambda i, j: (swaps.append((i, j)), swap(i, j)))
    front.shift()
    front.improve()
    after = taken + np.array([front.moved.get(f"p{i:02d}", 0) for i in range(60)])
    assert after.sum() == taken.sum() and (after >= 0).all() and (after <= full).all() and len(swaps) < 300
    assert np.allclose(front.gaps, flags.T @ after - goals) and np.array_equal(front.room[0], after) and np.array_equal(front.room[1], full - after)
    objective = lambda take: scale @ (flags.T @ take - goals) ** 2 - 0.01 * quality @ take
    assert np.abs(after - taken).sum() > 10_000 and objective(after) < objective(taken)
    for i in range(60):
        for j in range(60):
            if i != j and after[i] > 0 and after[j] < full[j]:
                step = np.zeros(60, int)
                step[i], step[j] = -1, 1
                assert objective(after + step) >= objective(after) - 1e-5


@pytest.mark.parametrize("seed", range(6))
def test_bulk_moves_reach_the_optimum_of_uneven_scales(seed):
    """Rare features weigh a million times what common ones do; the bulk move is near the optimum, few single swaps are left."""
    rng = np.random.default_rng(seed)
    letters = np.array(np.meshgrid(*[range(7)] * 3)).reshape(3, -1).T
    kinds = ((1, 2, 3), (4, 5, 6), (0,), (1,), (2,), (3,), (4,), (5,), (6,))
    positive = np.isin(letters, (1, 2, 3)).sum(axis=1)
    flags = np.array([np.isin(letters[:, k], codes) for k in range(3) for codes in kinds] + [positive == n for n in range(4)]).T.astype(float)
    full = rng.integers(1, 100_000, len(letters))
    full[rng.random(len(letters)) < 0.3] = rng.integers(1, 20)
    taken = (full * rng.random(len(letters))).astype(int)
    scale = np.array(([12 / 1000] + [3 / 8e5] * 2 + [1 / 4e5] * 6) * 3 + [3 / 8e5] * 4)
    scale[rng.integers(0, len(scale))] = 3.0
    cost = -0.01 * rng.random(len(letters))
    objective = lambda step: cost @ step + scale @ (flags.T @ step) ** 2
    best = splits.box_optimum(cost, flags, scale, -taken, full - taken)
    assert abs(best.sum()) < 1e-3 and (best >= -taken).all() and (best <= full - taken).all() and objective(best) < -1000
    rows = lambda sign, room: [{"pattern": f"p{i:03d}", "flags": flags[i], "room": room[i], "cost": scale @ flags[i] + sign * cost[i]} for i in range(len(letters)) if room[i] > 0]
    front = splits.Frontier(rows(-1, taken), rows(1, full - taken), scale, np.zeros(len(scale)))
    swaps, swap = [], front.swap
    front.swap = lambda i, j: (swaps.append((i, j)), swap(i, j))
    front.shift()
    front.improve()
    step = np.array([front.moved.get(f"p{i:03d}", 0) for i in range(len(letters))])
    assert step.sum() == 0 and (step >= -taken).all() and (step <= full - taken).all() and np.allclose(front.gaps, flags.T @ step)
    assert len(swaps) < 300 and objective(step) <= objective(best) * (1 - 1e-4)


def test_quality_never_outweighs_a_quota_of_positives(spark):
    rows = [(f"{a}{b}", 1_000_000 + 7 * i, 0, 100_000, 0.9 if a == "p" else 0.1 * (i % 3)) for i, (a, b) in enumerate((a, b) for a in "pn" for b in "pnx")]
    patterns = spark.createDataFrame(rows, "pattern string, n long, locked long, take long, quality double")
    flags = [F.col("pattern").substr(1, 1) == "p", F.col("pattern").substr(2, 1) == "p", F.col("pattern").substr(2, 1) == "n"]
    total = sum(r[1] for r in rows)
    got = {r.pattern: r.take for r in splits._refine(patterns, flags, [12.0, 12.0, 3.0], 600_000, total).collect()}
    assert sum(got.values()) == 600_000
    for at in (0, 1):
        goal = round(sum(r[1] for r in rows if r[0][at] == "p") * 600_000 / total)
        assert abs(sum(n for name, n in got.items() if name[at] == "p") - goal) <= 1
