import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sliceweave.operators.ordering import Sequence, group_summary, hot_groups, top_k


def skewed(spark, seed=1):
    rng = random.Random(seed)
    rows = [(None if rng.random() < 0.05 else ("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}"), rng.randrange(50), i,
             None if rng.random() < 0.3 else rng.randrange(1000)) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "k string, pos int, id int, v int")


@pytest.mark.parametrize("limit", [10, 100, 10_000])
def test_running_values(spark, limit):
    rows, df = skewed(spark)
    seq = Sequence(df.repartition(7), ["k"], [F.col("pos"), F.col("id")], limit=limit)
    assert seq.split == (limit < 1000)
    got = (seq.row_number("rn").size("n").running("s", "sum", F.col("v")).running("lo", "min", F.col("v")).running("hi", "max", F.col("v"))
           .running("last", "last", F.col("v")).running("next", "last", F.col("v"), reverse=True).neighbour("before", F.col("v"))
           .neighbour("after", F.col("v"), ahead=True)).df
    assert set(got.columns) == {"k", "pos", "id", "v", "rn", "n", "s", "lo", "hi", "last", "next", "before", "after"}
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    frame = pd.DataFrame(rows, columns=["k", "pos", "id", "v"])
    for _, group in frame.groupby("k", dropna=False):
        group = group.sort_values(["pos", "id"])
        values = [None if pd.isna(v) else int(v) for v in group["v"]]
        for i, id_ in enumerate(group["id"]):
            seen, rest = [v for v in values[:i + 1] if v is not None], [v for v in values[i:] if v is not None]
            row = found[id_]
            assert (row["rn"], row["n"]) == (i + 1, len(values))
            assert row["s"] == (sum(seen) if seen else None)
            assert row["lo"] == (min(seen) if seen else None) and row["hi"] == (max(seen) if seen else None)
            assert row["last"] == (seen[-1] if seen else None) and row["next"] == (rest[0] if rest else None)
            assert row["before"] == (values[i - 1] if i else None)
            assert row["after"] == (values[i + 1] if i + 1 < len(values) else None)


@pytest.mark.parametrize("limit", [20, 10_000])
def test_quantiles(spark, limit):
    rows, df = skewed(spark, 2)
    got = group_summary(df, ["k"], {"v": {"a": 0.2, "b": 0.5, "c": 1.0}}, [F.count(F.lit(1)).alias("n")], limit=limit).collect()
    frame = pd.DataFrame(rows, columns=["k", "pos", "id", "v"])
    expected = {(None if pd.isna(k) else k): g for k, g in frame.groupby("k", dropna=False)}
    assert {r["k"] for r in got} == set(expected)
    for r in got:
        group = expected[r["k"]]
        assert r["n"] == len(group)
        for name, q in (("a", 0.2), ("b", 0.5), ("c", 1.0)):
            assert r[name] == pytest.approx(group["v"].quantile(q))


def test_hot_groups_are_found_and_null_is_a_group(spark):
    rows, df = skewed(spark)
    assert {r["k"] for r in hot_groups(df, ["k"], 60).collect()} >= {"hot", None}
    assert hot_groups(df, ["k"], 10_000) is None


def test_top_k_limits_before_the_shuffle(spark):
    _, df = skewed(spark)
    plan = top_k(df, ["k"], [F.col("pos"), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > plan.index("Exchange")
