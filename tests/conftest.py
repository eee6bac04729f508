import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from voxarbor.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "3g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("rounds"))})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def cells(spark):
    """Rows (z, y, x, value) of one case to a voxel relation with ids."""
    def make(rows, shape=(64, 64, 64), case=1, kind="double"):
        data = [(case, int(r[0]), int(r[1]), int(r[2]), float(r[3]) if len(r) > 3 else 0.0) for r in rows]
        return spark.createDataFrame(data, "case_id long, z int, y int, x int, v double").selectExpr(
            "*", f"cast(case_id * {shape[0] * shape[1] * shape[2]} + (z * {shape[1]} + y) * {shape[2]} + x AS bigint) AS gid")
    return make
