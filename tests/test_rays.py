"""Depth along rays against the registered statement."""

import duckdb

from voxarbor.plans import load


def test_ray_level_is_rounded_as_the_statement_does(spark, tmp_path):
    # the trunk's median is 5000001.5, which the statement rounds to 5000002: the topmost cell is not bone and blocks nothing
    lines = [(1, 1.0, 0.0, 0.0, 50000.01), (1, 6.0, 0.02, 0.0, 50000.02), (1, 46.0, 0.04, 0.0, 65000.02), (1, 36.0, 0.04, 0.0, 50500.00),
             (1, 16.0, 0.04, 0.0, 52000.00)]
    df = spark.createDataFrame(lines, "l_suppkey long, l_quantity double, l_discount double, l_tax double, l_extendedprice double")
    df.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    plans = load()
    got = sorted(tuple(r) for r in plans.QUERIES["ray_depth_pick"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(db.execute(plans.ORACLES["ray_depth_pick"]).fetchall())
    assert got == want
