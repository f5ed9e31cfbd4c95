import pytest
from pyspark.sql import functions as F

from sliceweave.operators import selection

SCHEMA = ("study string, series string, plane string, fluid int, num_slices int, ordinal int, usable int, coverage_mm double, fov_mm double, "
          "pixel_spacing_mm double, slice_spacing_mm double, unique_slices int")


def row(series, plane, fluid, ordinal, pixel=0.5, coverage=60.0, fov=160.0, usable=1, study="s", slices=20):
    return (study, series, plane, fluid, slices, ordinal, usable, coverage, fov, pixel, 3.0, 20)


def thresholds(spark, value=40.0):
    return spark.createDataFrame([(p, value) for p in ("Sagittal", "Coronal", "Axial")], "plane string, threshold double")


def full(change=lambda slot, i: {}):
    slots = [("Sagittal", 1), ("Sagittal", 0), ("Coronal", 1), ("Coronal", 0), ("Axial", 1)]
    return [row(f"{s}_{i}", plane, fluid, s * 3 + i, **({"pixel": 0.5 + i / 10} | change(s, i)))
            for s, (plane, fluid) in enumerate(slots) for i in range(3)]


def two(spark, rows):
    got = selection.select_two_per_slot(spark.createDataFrame(rows, SCHEMA), "study", thresholds(spark)).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["slot"], r["place"])):
        out.setdefault(r["slot"], []).append(r["series"])
    return out


def test_two_per_slot(spark):
    assert two(spark, full()) == {s: [f"{s}_0", f"{s}_1"] for s in range(5)}


@pytest.mark.parametrize("bad", [{"coverage": 20.0}, {"fov": 100.0}, {"usable": 0}])
def test_gate_closes(spark, bad):
    got = two(spark, full(lambda s, i: bad if s == 1 and i else {}))
    assert got[1] == ["1_0"] and got[0] == ["0_0", "0_1"]


def test_firsts_are_reserved_before_seconds(spark):
    got = two(spark, [row(f"0_{i}", "Sagittal", 1, i, pixel=0.5 + i / 10) for i in range(3)])
    assert got == {0: ["0_0", "0_2"], 1: ["0_1"]}


def test_second_never_crosses_contrast(spark):
    rows = [row("f0", "Coronal", 1, 0), row("n0", "Coronal", 0, 1), row("n1", "Coronal", 0, 2, pixel=0.6)]
    assert two(spark, rows) == {2: ["f0"], 3: ["n0", "n1"]}


def test_budgets(spark):
    picks = selection.select_two_per_slot(spark.createDataFrame(full(), SCHEMA), "study", thresholds(spark))
    rows = selection.slot_budgets(picks, "study").orderBy("slot", "place").collect()
    assert [[r["budget"] for r in rows if r["slot"] == s] for s in range(5)] == [[23, 12], [17, 8], [15, 8], [10, 5], [15, 7]]


def test_catalogue_order_and_quality(spark):
    rows = [row("a", "Axial", None, 0, usable=0), row("b", "Axial", 0, 1, pixel=0.9), row("c", "Axial", 1, 2, pixel=0.5),
            row("d", "Sagittal", 0, 3), row("e", "Coronal", 1, 4, slices=0)]
    df = spark.createDataFrame(rows, SCHEMA)
    pick = lambda got: {r["slot"]: r["series"] for r in got.collect()}
    assert pick(selection.select_slots(df, "study")) == {0: "d", 4: "a"}
    assert pick(selection.select_slots_by_quality(df, "study", thresholds(spark))) == {0: "d", 4: "c"}
    worse = df.withColumn("usable", F.lit(0))
    assert pick(selection.select_slots_by_quality(worse, "study", thresholds(spark))) == {0: "d", 4: "a"}
    report = selection.selection_report(selection.select_slots(df, "study"), selection.select_slots_by_quality(df, "study", thresholds(spark)), df, "study")
    assert {r["slot"]: r["changed"] for r in report.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}
