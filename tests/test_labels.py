import pytest
from pyspark.sql import functions as F

from sliceweave.functions import labels as L
from sliceweave.functions import text
from sliceweave.operators import ensemble, guards, labels, metrics
from sliceweave.schemas import TARGETS


def test_parse_label(spark):
    cases = {" yes ": 1.0, "N": 0.0, "Unknown": 0.5, "0.25": 0.25, "1e-1": 0.1, "1.0": 1.0, "1.01": None, "-0.1": None, "nan": None, "": None, "1d": None, "maybe": None,
             "inf": None, "\tno\n": 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", L.parse_label(F.col("t")).cast("double").alias("v")).collect()}
    for key, value in cases.items():
        assert got[key] == (None if value is None else pytest.approx(value, abs=1e-7)), key


def test_missing_is_not_negative(spark):
    df = spark.createDataFrame([(0.5,), (0.7,), (0.2,), (None,), (float("nan"),)], "v double")
    v = F.col("v")
    rows = df.select(L.positive(v), L.negative(v), L.excluded(v), F.round(L.confidence(v), 6), L.label_mask(v)).collect()
    assert [tuple(r) for r in rows] == [(False, False, True, 0.0, 1), (True, False, False, 0.4, 1), (False, True, False, 0.6, 1), (False, False, True, 0.0, 0),
                                        (False, False, True, 0.0, 0)]


def test_quoted_target_names(spark):
    assert len(TARGETS) == 12
    official = spark.createDataFrame([("u", *[None] * 11, 1.0)], "uid string, " + ", ".join(f"`{t}` double" for t in TARGETS))
    weak = spark.createDataFrame([("u", *["YES"] * 6, *["0.3"] * 6)], "uid string, " + ", ".join(f"`{t}` string" for t in TARGETS))
    row = labels.merge_gold(official, weak, "uid", TARGETS).first()
    assert row["ACL"] == 1.0 and row["Baker's"] == pytest.approx(0.3) and row["Fracture"] == 1.0
    with pytest.raises(guards.ContractError):
        labels.require_no_partial_gold(labels.merge_gold(official, weak, "uid", TARGETS), TARGETS)


def test_guards(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "uid string, x int")
    with pytest.raises(guards.ContractError):
        labels.one_to_one(twice, twice, "uid")
    with pytest.raises(guards.ContractError):
        ensemble.checked_union([twice, twice], ["uid"])
    sides = guards.key_difference(twice, spark.createDataFrame([("b",)], "uid string"), ["uid"])
    assert {(r["uid"], r["side"]) for r in sides.collect()} == {("a", "left_only"), ("b", "right_only")}


def test_normalised_groups_ignore_case_and_space(spark):
    df = spark.createDataFrame([("No  Tear.\n",), (" no tear. ",), ("no tear.",), ("no tear",)], "t string")
    groups = [r[0] for r in df.select(text.report_group(F.col("t"))).collect()]
    assert groups[0] == groups[1] == groups[2] != groups[3]


def test_mean_of_five_constant_folds(spark):
    rows = [("u", "t", i / 4) for i in range(5)]
    mean = ensemble.mean_probability(spark.createDataFrame(rows, "uid string, target string, p double"), ["uid", "target"], "p")
    assert ensemble.enforce_mean(mean, 5).first()["mean"] == 0.5
    with pytest.raises(guards.ContractError):
        ensemble.enforce_mean(mean, 4)
    bad = spark.createDataFrame([("u", "t", float("nan"))], "uid string, target string, p double")
    with pytest.raises(guards.ContractError):
        ensemble.enforce_mean(ensemble.mean_probability(bad, ["uid", "target"], "p"), 1)


def test_auc_with_ties_and_one_class(spark):
    rows = [("a", 1.0, 0.5), ("a", 0.0, 0.5), ("a", 1.0, 0.9), ("a", 0.0, 0.1), ("a", 0.5, 0.2), ("a", None, 0.3), ("b", 1.0, 0.2)]
    df = spark.createDataFrame(rows, "target string, y double, p double")
    got = {r["target"]: r["auc"] for r in metrics.auc(df, ["target"], "y", "p").collect()}
    assert got == {"a": 0.875, "b": None}
    assert metrics.macro_auc(metrics.auc(df, ["target"], "y", "p")).first()["macro_auc"] == 0.875
