"""Versioned outputs under failing and rival writers."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sliceweave.operators import guards, splits
from sliceweave.sources import sinks, snapshots


def numbers(spark, n):
    return spark.range(0, n, 1, 4).toDF("x")


def test_a_failed_task_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "out")
    assert snapshots.current(spark, root) is None
    sinks.replace_csv(numbers(spark, 10), root)
    with pytest.raises(Exception, match="USER_RAISED|broken"):
        sinks.replace_csv(numbers(spark, 20).withColumn("x", F.when(F.col("x") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("x"))), root)
    assert spark.read.option("header", True).csv(snapshots.current(spark, root)).count() == 10
    assert len(list((tmp_path / "out").glob("v-*"))) == 1
    open_reader = spark.read.option("header", True).csv(snapshots.current(spark, root))
    sinks.replace_csv(numbers(spark, 30), root)
    assert open_reader.count() == 10  # a reader of the version before it still ends
    assert snapshots.remove_old(spark, root) == 1
    assert spark.read.option("header", True).csv(snapshots.current(spark, root)).count() == 30
    with pytest.raises(PySparkException):
        spark.read.csv(f"{root}/v-missing")


def outputs(spark, seed, rows=60):
    members = spark.range(rows).select(F.concat(F.lit("u"), F.col("id")).alias("uid"), (F.col("id") % 5).cast("int").alias("fold"), F.lit("weak").alias("split"))
    targets = members.select("uid", F.lit(0.5).alias("x"))
    cells = targets.select("uid", F.lit("x").alias("target"), F.col("x").alias("value"))
    return members, targets, splits.distribution(cells, members, "uid", "value"), splits.manifest(members, targets, "uid", ["x"], "m", seed, 5)


def test_split_is_exported_once_and_whole(spark, tmp_path):
    root = str(tmp_path / "split")
    for _ in range(2):
        snapshots.export_split(root, *outputs(spark, 1))
    with pytest.raises(guards.ContractError):
        snapshots.export_split(root, *outputs(spark, 2))
    held = snapshots.read_split(spark, root)
    assert {name: df.count() for name, df in held.items()} == {"folds": 60, "targets": 60, "distribution": 5, "manifest": 1}


def test_rival_writers_leave_one_whole_split(spark, tmp_path):
    root = str(tmp_path / "rivals")

    def run(seed):
        try:
            snapshots.export_split(root, *outputs(spark, seed))
            return seed
        except guards.ContractError:
            return None

    with ThreadPoolExecutor(4) as pool:
        done = [x for x in pool.map(run, range(4)) if x is not None]
    held = snapshots.read_split(spark, root)
    assert len(done) == 1 and held["manifest"].first()["seed"] == str(done[0]) and held["folds"].count() == 60
    assert len(list((tmp_path / "rivals").glob("v-*"))) == 1


def test_a_failed_export_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "failed")
    folds, targets, distribution, manifest = outputs(spark, 1)
    with pytest.raises(Exception, match="USER_RAISED|broken"):
        snapshots.export_split(root, folds, targets.withColumn("x", F.raise_error(F.lit("broken")).cast("double")), distribution, manifest)
    assert snapshots.current(spark, root) is None and not list((tmp_path / "failed").glob("v-*"))
    snapshots.export_split(root, folds, targets, distribution, manifest)
    assert snapshots.read_split(spark, root)["targets"].count() == 60
