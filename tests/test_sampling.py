import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sliceweave.operators import guards, sampling


def check_quotas(quotas, capacities, shares, total):
    """Every slot has one to its capacity, they add up, and no unit could move to a slot that lacks more of its share."""
    assert all(1 <= q <= c for q, c in zip(quotas, capacities)) and sum(quotas) == total
    for i, q in enumerate(quotas):
        for j, other in enumerate(quotas):
            if i != j and q > 1 and other < capacities[j]:
                assert shares[i] - (q - 1) >= shares[j] - other - 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_slot_quotas_follow_the_weights(spark, seed):
    rng = random.Random(seed)
    caps = {study: {s: rng.randrange(1, 15) for s in rng.sample(range(5), rng.randrange(1, 6))} for study in range(40)}
    rows = [(study, s, c) for study, slots in caps.items() for s, c in slots.items()]
    got = defaultdict(dict)
    for r in sampling.slot_quotas(spark.createDataFrame(rows, "study int, slot int, cap int"), "study", "slot", "cap", 16, sampling.slot_weight(F.col("slot"))).collect():
        got[r["study"]][r["slot"]] = r["quota"]
    for study, slots in caps.items():
        total, weights = min(16, sum(slots.values())), {s: [7.0, 5.0, 5.0, 3.0, 4.0][s] for s in slots}
        order = sorted(slots)
        check_quotas([got[study][s] for s in order], [slots[s] for s in order], [total * weights[s] / sum(weights.values()) for s in order], total)


def test_proportional_subset(spark):
    rng = random.Random(4)
    rows = [(study, rng.randrange(3), rng.randrange(20), i) for study in range(12) for i in range(rng.choice([4, 30, 80]))]
    got = defaultdict(set)
    df = spark.createDataFrame(rows, "study int, slot int, position int, idx int")
    for r in sampling.proportional_subset(df.repartition(5), "study", "slot", [F.col("position"), F.col("idx")], 10).collect():
        got[r["study"]].add(r["idx"])
    for study in range(12):
        mine = [r for r in rows if r[0] == study]
        if len(mine) <= 10:
            assert got[study] == {r[3] for r in mine}
            continue
        by_slot = {s: sorted((r[2], r[3]) for r in mine if r[1] == s) for s in sorted({r[1] for r in mine})}
        quotas = [sum(i in got[study] for _, i in order) for order in by_slot.values()]
        check_quotas(quotas, [len(o) for o in by_slot.values()], [10 * len(o) / len(mine) for o in by_slot.values()], 10)
        for order, quota in zip(by_slot.values(), quotas):  # one row in the middle of each of ``quota`` equal parts
            assert [i for _, i in order if i in got[study]] == [order[(2 * j + 1) * len(order) // (2 * quota)][1] for j in range(quota)]


def test_samples_do_not_depend_on_partitioning(spark):
    rows = [(s, s * 10 + g, i) for s in range(5) for g in range(3) for i in range(2 + s * 3)]
    df = spark.createDataFrame(rows, "study int, series int, idx int")
    draw = lambda d: sorted(map(tuple, sampling.sample_windows(d, "study", "series", ["series", "idx"], 12, 3).collect()))
    first = draw(df)
    assert first == draw(df.orderBy(F.desc("idx")).repartition(7))
    assert first != sorted(map(tuple, sampling.sample_windows(df, "study", "series", ["series", "idx"], 12, 4).collect()))
    size, series = Counter(r[0] for r in first), defaultdict(set)
    for r in first:
        series[r[0]].add(r[2])
    assert set(size.values()) == {12} and all(len(s) == 3 for s in series.values())
    distinct = Counter(r[0] for r in set((r[0], r[2], r[3]) for r in first))
    assert all(distinct[s] == min(12, 3 * (2 + s * 3)) for s in range(5))


def test_seeded_sample_needs_enough_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "uid")
    assert sampling.sample_studies(df, "uid", 0, 1).count() == 10
    assert {r[0] for r in sampling.sample_studies(df, "uid", 4, 1).collect()} == {r[0] for r in sampling.sample_studies(df.repartition(6), "uid", 4, 1).collect()}
    with pytest.raises(guards.ContractError):
        sampling.sample_studies(df, "uid", 11, 1)


def test_too_few_draws_are_refused(spark):
    df = spark.createDataFrame([("s", g, i) for g in range(5) for i in range(2)], "study string, series int, idx int")
    assert [tuple(r) for r in sampling.crowded_studies(df, "study", "series", 3).collect()] == [("s", 5)]
    with pytest.raises(guards.ContractError):
        sampling.sample_windows(df, "study", "series", ["series", "idx"], 3, 1)
    assert {r["series"] for r in sampling.sample_windows(df, "study", "series", ["series", "idx"], 5, 1).collect()} == set(range(5))


def test_round_robin(spark):
    caps = spark.createDataFrame([("s", "a", 2), ("s", "b", 9), ("s", "c", 4), ("t", "x", 1)], "slot string, series string, n int")
    got = {(r["slot"], r["series"]): r["windows"] for r in sampling.round_robin(caps, ["slot"], "series", "n", 10).collect()}
    assert got == {("s", "a"): 2, ("s", "b"): 4, ("s", "c"): 4, ("t", "x"): 1}
    assert [r["slot"] for r in sampling.overfull_slots(caps, ["slot"], 2).collect()] == ["s"]
    with pytest.raises(guards.ContractError):
        sampling.round_robin(caps, ["slot"], "series", "n", 2)


@pytest.mark.parametrize("quota", [1, 3, 6])
def test_depth_strata(spark, quota):
    rng = random.Random(9)
    groups = {f"g{i}": [rng.choice([rng.uniform(0, 10), rng.uniform(0, 1)]) for _ in range(rng.randrange(1, 30))] for i in range(25)} | {"flat": [2.0] * 9}
    rows = [(g, p, i) for g, positions in groups.items() for i, p in enumerate(positions)]
    df = spark.createDataFrame(rows, "series string, position double, idx int")
    got = defaultdict(list)
    for r in sampling.stratified_by_depth(df.repartition(3), ["series"], "position", "idx", quota, 1).collect():
        got[r["series"]].append(r["idx"])
    for name, positions in groups.items():
        chosen, low, high = got[name], min(positions), max(positions)
        assert len(chosen) == len(set(chosen)) == min(quota, len(positions))
        if low == high:  # parts of equal count in item order
            part = lambda i: i * quota // len(positions)
            assert quota > len(positions) or sorted(map(part, chosen)) == list(range(quota))
            continue
        borders = [low + k * (high - low) / quota for k in range(1, quota)]
        depth = lambda i: sum(b <= positions[i] for b in borders)
        taken = Counter(map(depth, chosen))
        held = Counter(map(depth, range(len(positions))))
        assert set(taken) == set(held)  # no bin with windows goes without
        empty = [k for k in range(quota) if not held[k]]
        if len(empty) == 1 and len(positions) > quota:  # its stand-in is the nearest window that no bin chose
            middle = low + (empty[0] + 0.5) * (high - low) / quota
            spare = min(abs(positions[i] - middle) for i in chosen if taken[depth(i)] > 1)
            assert spare <= min(abs(p - middle) for i, p in enumerate(positions) if i not in chosen) + 1e-9


def test_sample_by_depth_quotas_and_repeats(spark):
    rng = random.Random(12)
    rows = [(study, slot, rng.uniform(0, 9), rng.randrange(40), i) for study in range(20) for slot in rng.sample(range(5), rng.randrange(1, 6))
            for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "study int, slot int, position double, anchor int, i int")
    got = defaultdict(list)
    for r in sampling.sample_by_depth(df.repartition(5), "study", "slot", "position", "anchor", F.col("i"), 16, 3).collect():
        got[r["study"]].append((r["slot"], r["anchor"]))
    weights = [7.0, 5.0, 5.0, 3.0, 4.0]
    for study in range(20):
        anchors = {(r[1], r[3]) for r in rows if r[0] == study}
        slots = sorted({s for s, _ in anchors})
        caps = [sum(a[0] == s for a in anchors) for s in slots]
        goal, whole = min(16, sum(caps)), sum(weights[s] for s in slots)
        quotas = [sum(s == slot for s, _ in got[study]) for slot in slots]
        if sum(caps) >= 16:
            check_quotas(quotas, caps, [16 * weights[s] / whole for s in slots], 16)
        else:  # all anchors, and repeats where most of the share is lacking
            assert all(q >= c for q, c in zip(quotas, caps))
            check_quotas([q - c + 1 for q, c in zip(quotas, caps)], [17] * len(caps), [16 * weights[s] / whole - c + 1 for s, c in zip(slots, caps)], 16 - sum(caps) + len(caps))
        assert len(set(got[study])) == goal and set(got[study]) <= anchors


def test_cover_examples(spark):
    rng = random.Random(2)
    rows = [(i, f"Report  {rng.randrange(12)}", rng.choice([0, 1, None]), rng.choice([0, 1]), rng.choice([0, 1])) for i in range(60)]
    df = spark.createDataFrame(rows, "uid int, report string, a int, b int, c int")
    picks = sorted(sampling.cover_examples(df.repartition(4), "uid", "report", ["a", "b", "c"], 5, 8).collect(), key=lambda r: r["example"])
    assert len({r["report"] for r in picks}) == 5
    gold, covered, used = [r for r in rows if r[2] is not None], set(), set()
    for pick in picks:
        gain = lambda r: sum(2 if v else 1 for i, v in enumerate(r[2:]) if (i, v) not in covered)
        mine = next(r for r in rows if r[0] == pick["uid"])
        assert pick["gain"] == gain(mine) == max(gain(r) for r in gold if r[1] not in used)
        covered |= set(enumerate(mine[2:]))
        used.add(mine[1])
    with pytest.raises(guards.ContractError):
        sampling.cover_examples(df, "uid", "report", ["a", "b", "c"], 40, 8)


def test_soft_labels_are_no_examples(spark):
    df = spark.createDataFrame([(1, "one", 0.95, 0.1), (2, "two", 1.0, 0.0), (3, "three", 0.0, 1.0)], "uid int, report string, a double, b double")
    assert {r["uid"] for r in sampling.cover_examples(df, "uid", "report", ["a", "b"], 2, 1).collect()} == {2, 3}


def test_depth_strata_of_small_groups_take_one_shuffle(spark):
    """Small groups become one array each, without windows, and give the same picks as the plan for large groups."""
    rng = random.Random(6)
    rows = [(f"g{g}", i, float(rng.choice([rng.randrange(6), rng.uniform(0, 9)]))) for g in range(40) for i in range(rng.randrange(1, 60))]
    rows += [("flat", i, 2.0) for i in range(11)] + [("twice", i // 2, float(i // 2)) for i in range(20)] + [("holes", i, None if i % 3 else float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "series string, idx int, position double")
    whole = sampling.stratified_by_depth(df, ["series"], "position", "idx", 4, 5)
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()
    picks = lambda frame: sorted((r["series"], r["idx"], str(r["position"])) for r in frame.collect())
    assert picks(whole) == picks(sampling._by_rims(df, ["series"], "position", "idx", 4, 5, 4))


def test_large_groups_are_not_held_as_arrays(spark, hot):
    df = spark.createDataFrame([("big" if i else "small", i, float(i % 37)) for i in range(200)], "series string, idx int, position double")
    rows = sampling.stratified_by_depth(df, ["series"], "position", "idx", 5, 5).collect()
    assert sorted(r["series"] for r in rows) == ["big"] * 5 + ["small"]


def test_first_per_group_needs_no_sort(spark):
    from sliceweave.operators.ordering import first_per_group

    df = spark.createDataFrame([(1, 3, 0.5, 7), (1, 2, None, 8), (2, 5, 1.5, 9)], "k int, o int, x double, y int")
    first = first_per_group(df, ["k"], F.col("o"))
    assert "SortAggregate" not in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(first.collect()) == [(1, 2, None, 8), (2, 5, 1.5, 9)]
