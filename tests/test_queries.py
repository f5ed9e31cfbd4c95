"""Every registered query against its SQL, with plain and with split groups."""

import pytest
from conftest import DATA
from oracle import compare, connect

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
ORDERED = ["a01_series_quality", "a06_auc", "a06_fold_auc", "a24_type_presence", "a25_layouts", "a27_geometry_medians", "a31_offset_report", "k08_proportional_subset",
           "k10_audit_sample", "p20_trimmed_range", "w01_spatial_order", "w04_slots_by_quality", "w07_conversation_turns", "w09_position_gaps",
           "w10_moving_mean", "w15_cumulative_share", "w16_average_rank", "x02_random_split", "x03_fold_sizes", "x04_quota_positives", "j09_nearest_position",
           "j10_physical_neighbours", "j12_repeat_causes"]


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], DATA) is None


@pytest.mark.parametrize("name", ORDERED)
def test_split_groups_match_sql(spark, duck, hot, name):
    assert compare(spark, duck, QUERIES[name], ORACLES[name], DATA) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_quality_shuffles_plain_columns_once(spark, monkeypatch, hot):
    """Headers are made behind the shuffle by series, which also serves the first normal; large series give the same rows."""
    from sliceweave.plans import models
    from sliceweave.session import HOT_ROWS_CONF

    rows = [(s, line, part, supp, 100.0 * (part % 13), 5.0) for s in (1, 2, 3, None) for line in (1, 2, 3, 4, 5) for part, supp in ((97, 41), (98 + line, 41 if s == 2 else 43 + line))]
    rows += [(4, line, 100 + line, 7, 10.0 * line, 5.0) for line in range(1, 50)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double")
    monkeypatch.setattr(models, "table", lambda *_: lines)
    cut = sorted(map(str, models.quality(spark, "").collect()))
    spark.conf.unset(HOT_ROWS_CONF)
    whole = models.quality(spark, "")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, whole.collect())) == cut and len(cut) == 4
    assert plan.count("Exchange hashpartitioning(series") == 1 and "min_by(_normal" not in plan


def test_tasks_order_a_bounded_number_of_slices(spark, monkeypatch):
    """Partitions grow with the slices, whatever the session's number of shuffle partitions is."""
    from sliceweave.plans import models

    monkeypatch.setattr(models, "SERIES_ROWS", 200)
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    for found in (models.ordered_slices(spark, DATA), models.quality(spark, DATA)):
        assert found.rdd.getNumPartitions() == -(-rows // 200)
