import random

import numpy as np
import pytest

from sliceweave.operators.catalog import order_slices
from sliceweave.operators.guards import ContractError
from sliceweave.operators.neighbors import evenly_spaced, physical_neighbours, short_groups, unique_anchors
from sliceweave.operators.windows import groups_of_three


def frame(spark, groups):
    rows = [(name, float(p), i) for name, positions in groups.items() for i, p in enumerate(positions)]
    return order_slices(spark.createDataFrame(rows, "series string, position double, file int"), ["series"], "position", ["file"])


def neighbours(spark, groups, mm=3.0):
    rows = physical_neighbours(frame(spark, groups), ["series"], "position", mm).collect()
    return {(r["series"], r["idx"]): [r["prev_idx"], r["idx"], r["next_idx"]] for r in rows}


def test_known_triples(spark):
    groups = {f"s{step}": [i * step for i in range(13)] for step in (1, 2, 3, 4, 6, 7)}
    groups |= {"edge": [0, 1, 2], "odd": [-10, -6, -1, 0, 4, 9], "twins": [0, 3, 3, 6, 6, 9], "flat": [0, 0, 0]}
    got = neighbours(spark, groups)
    assert [got[f"s{step}", 6] for step in (1, 2, 3, 4, 7, 6)] == [[3, 6, 9], [5, 6, 7], [5, 6, 7], [5, 6, 7], [6, 6, 6], [6, 6, 6]]
    assert got["edge", 0] == [0, 0, 2] and got["edge", 2] == [0, 2, 2]
    assert got["odd", 3] == [2, 3, 4] and got["twins", 2] == [0, 2, 3] and got["flat", 1] == [1, 1, 1]


def full_ranking(positions, at, mm):
    """Best partner on each side: every row ranked by the whole rule, written as one sort key per row.

    Distances to the wanted place count in steps of the tolerance above the least one: all within it are level.
    """
    own, found = positions[at], []
    for wanted in (own - mm, own + mm):
        least = min(abs(p - wanted) for p in positions)
        level = [(abs(p - own), abs(i - at), i) for i, p in enumerate(positions) if abs(p - wanted) <= least + 1e-4]
        closest = min(level)[0]
        found.append(min(rest for d, *rest in level if d <= closest + 1e-4)[1])
    return [found[0], at, found[1]]


def random_groups(seed, count=60):
    rng = random.Random(seed)
    groups = {}
    for g in range(count):
        n = rng.randrange(1, 25)
        kind = rng.choice([lambda: rng.uniform(0, 30), lambda: rng.randrange(12), lambda: rng.randrange(10) + rng.choice([0, 5e-5, 1e-4]), lambda: 4.0])
        groups[f"g{g}"] = sorted(kind() for _ in range(n))
    return groups


def test_neighbours_against_brute_force(spark):
    groups = random_groups(3)
    got = neighbours(spark, groups, 3.0)
    for name, positions in groups.items():
        assert [got[name, i] for i in range(len(positions))] == [full_ranking(positions, i, 3.0) for i in range(len(positions))], positions


def test_neighbours_in_split_groups(spark, hot):
    positions = sorted(random.Random(5).uniform(0, 200) for _ in range(150))
    got = neighbours(spark, {"big": positions, "small": [0, 3, 6]}, 3.0)
    assert [got["big", i] for i in range(150)] == [full_ranking(positions, i, 3.0) for i in range(150)]


@pytest.mark.parametrize("count", [1, 2, 5])
def test_evenly_spaced_against_brute_force(spark, count):
    groups = random_groups(7)
    got = {(r["series"], r["j"]): r["idx"] for r in evenly_spaced(frame(spark, groups), ["series"], "position", count).collect()}
    for name, positions in groups.items():
        p = np.array(positions)
        assert [got[name, j] for j in range(count)] == [int(np.abs(p - t).argmin()) for t in np.linspace(p[0], p[-1], count)], positions


ANCHORS = {  # positions, count: expected rows
    "even": ([0, 1, 2, 3, 4, 5, 6, 7, 8], 3, [0, 4, 8]),
    "one of many": ([0, 1, 2, 10], 1, [2]),
    "flat": ([4, 4, 4, 4, 4], 3, [0, 2, 4]),
    "flat, one": ([4, 4, 4, 4, 4], 1, [2]),
    "clump at the start": ([0] * 12 + [5] * 9 + [9], 4, [0, 12, 13, 21]),
    "clump at the end": ([0, 1] + [7] * 15, 4, [0, 1, 2, 3]),
    "just enough": ([0, 9, 9.5], 3, [0, 1, 2]),
    "tie goes to the first": ([0, 4, 6, 10], 3, [0, 1, 3]),
}


@pytest.mark.parametrize("name", ANCHORS)
def test_anchor_rows(spark, name):
    positions, count, expected = ANCHORS[name]
    rows = unique_anchors(frame(spark, {"s": positions}), ["series"], "position", count).orderBy("j").collect()
    assert [r["idx"] for r in rows] == expected


@pytest.mark.parametrize("count", [2, 4, 7])
def test_anchors_rise_and_can_not_be_improved(spark, count):
    groups = {k: v for k, v in random_groups(11).items() if len(v) >= count}
    got = {}
    for r in unique_anchors(frame(spark, groups), ["series"], "position", count).orderBy("j").collect():
        got.setdefault(r["series"], []).append(r["idx"])
    for name, positions in groups.items():
        rows, n = got[name], len(positions)
        assert len(rows) == count and all(a < b for a, b in zip([-1, *rows], [*rows, n]))
        if positions[0] == positions[-1]:
            continue
        for j, row in enumerate(rows):  # no row that was still free lies nearer to the target, nor as near and before it
            wanted = positions[0] + j * (positions[-1] - positions[0]) / (count - 1)
            free = range(rows[j - 1] + 1 if j else 0, n - (count - j) + 1)
            assert row == min(free, key=lambda i: (round(abs(positions[i] - wanted), 9), i))


def test_short_groups_are_refused(spark):
    df = frame(spark, {"long": [0, 1, 2], "short": [0, 1]})
    assert [r["series"] for r in short_groups(df, ["series"], 3).collect()] == ["short"]
    with pytest.raises(ContractError):
        unique_anchors(df, ["series"], "position", 3)


def test_groups_of_three_pad_the_last(spark):
    rows = groups_of_three(frame(spark, {"s": [0, 1, 2, 3, 5]}), ["series"], "position").orderBy("grp").collect()
    assert [r["indices"] for r in rows] == [[0, 1, 2], [3, 4, 4]]
    assert [r["centre"] for r in rows] == [1.0, 4.0]


def test_neighbours_cost_one_narrow_shuffle(spark):
    """No probes beside the rows: the plan neither unites nor orders them again, and buckets hold whole groups."""
    ordered = frame(spark, random_groups(4))
    plan = physical_neighbours(ordered, ["series"], "position", 3.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("Window") <= ordered._jdf.queryExecution().optimizedPlan().toString().count("Window")


def test_neighbours_over_many_buckets_and_odd_rows(spark, monkeypatch):
    from sliceweave.operators import neighbors as module

    monkeypatch.setattr(module, "BUCKET_ROWS", 50)
    groups = random_groups(8)
    got = neighbours(spark, groups, 3.0)
    assert len(got) == sum(map(len, groups.values()))
    assert all(got[name, i] == full_ranking(positions, i, 3.0) for name, positions in groups.items() for i in range(len(positions)))
    rows = spark.createDataFrame([(None, 0, 1.0), (None, 1, 4.0), ("a", 0, None), ("a", 1, 2.0)], "series string, idx int, position double")
    found = {(r["series"], r["idx"]): (r["prev_idx"], r["next_idx"], r["next_pos"]) for r in physical_neighbours(rows, ["series"], "position", 3.0).collect()}
    assert found == {(None, 0): (0, 1, 4.0), (None, 1): (0, 1, 4.0), ("a", 0): (None, None, None), ("a", 1): (1, 1, 2.0)}
