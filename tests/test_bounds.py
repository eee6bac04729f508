"""Bounds of the session that hold for tables of any size."""

import pytest

from voxarbor.plans import load
from voxarbor.session import Rounds, size_setting
from voxarbor.sources.tables import table
from tests.conftest import SF

BROADCAST, ADVISED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@pytest.fixture
def settings(spark):
    held = {k: spark.conf.get(k) for k in (BROADCAST, ADVISED)}
    yield spark.conf
    for k, v in held.items():
        spark.conf.set(k, v)


def test_sizes_as_the_session_states_them():
    assert [size_setting(v) for v in ("10485760b", "64MB", "256k", "-1", "7", "1g")] == [10 << 20, 64 << 20, 256 << 10, -1, 7, 1 << 30]


def test_a_written_table_of_many_rows_is_not_broadcast(spark, settings):
    settings.set(BROADCAST, "10m")
    many, _ = Rounds(spark, "many").save(spark.range(1_000_000).selectExpr("id", "id % 2 = 0 AS kept"))
    plan = many.join(many.selectExpr("id + 1 AS id", "kept AS next"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_smaller_settings_and_a_switched_off_broadcast_stay(spark, settings):
    for key, before, after in ((BROADCAST, "-1", -1), (BROADCAST, "64k", 64 << 10), (BROADCAST, "10m", 256 << 10)):
        settings.set(key, before)
        table(spark, SF, "nation")
        assert size_setting(settings.get(key)) == after


@pytest.mark.parametrize("name", ["cap_contacts", "trunk_end_caps", "patch_origins"])
def test_plans_do_not_multiply(spark, name):
    """What several parts of a query name is written, so its last plan reads a few tables and never the input again."""
    plan = load().QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan and plan.count("Relation [") <= 12


def test_display_rows_read_the_findings_once(spark):
    plan = load().QUERIES["scene_table"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_slices_are_not_merged_into_few_tasks(spark):
    plan = load().QUERIES["mixed_grid_resample"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
