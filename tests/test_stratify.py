import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sliceweave.functions.text import seeded
from sliceweave.operators import guards, splits, stratify
from test_splits import TARGETS, assigned, frame, studies


def one_by_one(need, room, unit, total):
    need, room, out = list(need), list(room), []
    for _ in range(total):
        fold = max((f for f in range(len(room)) if room[f]), key=lambda f: (need[f], room[f], -f))
        need[fold] -= unit
        room[fold] -= 1
        out.append(fold)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(-40, 40), st.integers(0, 12)), min_size=1, max_size=6), st.integers(1, 9), st.data())
def test_turns_equal_single_steps(folds, unit, data):
    need, room = [a for a, _ in folds], [b for _, b in folds]
    total = data.draw(st.integers(0, sum(room)))
    stretches = stratify.turns(need, room, unit, total)
    got = []
    for i in range(total):
        start, leaders = [s for s in stretches if s[0] <= i][-1]
        got.append(leaders[(i - start) % len(leaders)])
    assert got == one_by_one(need, room, unit, total) and len(stretches) <= 2 * len(folds)


def flags_of(rows):
    kinds = [lambda v: v is not None and v > 0.5, lambda v: v is not None and v < 0.5, lambda v: v is None or v == 0.5]
    return np.array([[kind(v) for kind in kinds for v in row[1:]] for row in rows])


def study_by_study(rows, order, folds):
    """The rule on one machine: every study on its own, needs of all features kept up to date after each."""
    flags, count = flags_of(rows).astype(int), len(rows)
    room = np.array([count // folds + (f < count % folds) for f in range(folds)])
    need, free, out = room[:, None] * flags.sum(axis=0), set(range(count)), {}
    while free:
        left = flags[sorted(free)].sum(axis=0)
        carried = [i for i in range(flags.shape[1]) if left[i]]
        feature = min(carried, key=lambda i: left[i])
        for s in [s for s in order if s in free and flags[s, feature]]:
            fold = max((f for f in range(folds) if room[f]), key=lambda f: (need[f, feature], room[f], -f))
            room[fold] -= 1
            need[fold] -= count * flags[s]
            free.discard(s)
            out[rows[s][0]] = fold
    return out


def spread(rows, folds_of, folds=5):
    """Largest distance of a fold's share of each feature from an even one."""
    flags = flags_of(rows)
    per = np.array([flags[[folds_of[r[0]] == f for r in rows]].sum(axis=0) for f in range(folds)])
    return np.abs(per - flags.sum(axis=0) / folds).max(axis=0)


@pytest.mark.parametrize("size", [5, 37, 500])
def test_folds_equal_dealing_study_by_study(spark, size):
    rows = studies(size)
    df = frame(spark, rows)
    order = {r["uid"]: r["h"] for r in df.select("uid", seeded(42, F.col("uid")).alias("h")).collect()}
    expected = study_by_study(rows, sorted(range(size), key=lambda i: (order[rows[i][0]], rows[i][0])), 5)
    got = assigned(stratify.iterative_folds(df, "uid", TARGETS, 5, 42))
    assert got == expected == assigned(stratify.iterative_folds(frame(spark, rows, shuffled=True), "uid", TARGETS, 5, 42))
    sizes = np.bincount(list(got.values()), minlength=5)
    assert sizes.max() - sizes.min() <= 1


def test_folds_are_as_even_as_random_ties(spark):
    """No worse than the rule with ties and order left to chance, and than one order dealt in turn."""
    rows = studies(600, seed=9)
    got = spread(rows, assigned(stratify.iterative_folds(frame(spark, rows), "uid", TARGETS, 5, 42)))
    chance = [spread(rows, study_by_study(rows, random.Random(s).sample(range(600), 600), 5)) for s in range(20)]
    assert got.sum() <= np.max([c.sum() for c in chance]) and got.max() <= np.max(chance)
    assert got.sum() < spread(rows, assigned(splits.assign_folds(frame(spark, rows), "uid", TARGETS, 5, 42))).sum()


def test_hot_round_and_odd_input(spark, hot):
    rows = studies(300)
    df = frame(spark, rows)
    spark.conf.unset("spark.sliceweave.hotRows")
    plain = assigned(stratify.iterative_folds(df, "uid", TARGETS, 3, 1))
    spark.conf.set("spark.sliceweave.hotRows", "40")
    assert assigned(stratify.iterative_folds(df, "uid", TARGETS, 3, 1)) == plain
    bare = assigned(stratify.iterative_folds(df.select("uid"), "uid", [], 4, 1))
    assert sorted(np.bincount(list(bare.values()))) == [75, 75, 75, 75]
    clash = df.select(F.col("uid").alias("p0"), *TARGETS, F.lit(1).alias("_round"), F.lit("x").alias("fold"))
    assert {u: f for u, f in assigned(stratify.iterative_folds(clash, "p0", TARGETS, 3, 1)).items()} == plain
    for bad in (df.limit(2), df.union(df.limit(1)), df.union(df.limit(1).withColumn("uid", F.lit(None).cast("string"))), df.limit(0)):
        with pytest.raises(guards.ContractError):
            stratify.iterative_folds(bad, "uid", TARGETS, 3, 1)
