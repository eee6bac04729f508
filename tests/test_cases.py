"""A phantom with two branches, from voxels to a validated record."""

import math
import os

import pytest
from pyspark.sql import functions as F

from voxarbor import schema
from voxarbor.plans import cases
from voxarbor.sources import phantom


@pytest.mark.skipif(not os.environ.get("VOXARBOR_SLOW"), reason="minutes long; set VOXARBOR_SLOW=1")
def test_two_branches_are_found(spark):
    p = phantom.Phantom("1", size_mm=(34, 34, 34), trunk_radius=4.0, trunk_z=(4, 30), branches=((12, 0, 2.0, 9.0), (22, 180, 2.0, 9.0)))
    nz, ny, nx = p.shape
    vox = phantom.voxels(spark, p).selectExpr("cast(case_id AS bigint) AS case_id", "z", "y", "x",
                                              f"cast(case_id AS bigint) * {nz * ny * nx} + vid AS gid", "cast(hu AS double) AS hu", "in_mask")
    s = cases.Settings(spacing=p.spacing, budget=12.0, searches=1)
    feats = cases.analyse(vox, s).cache()
    found = feats.collect()
    print([(r.id, round(r.x, 1), round(r.y, 1), round(r.z, 1), r.radius_at_seed_mm, r.traced_length_mm, r.truncated_by) for r in found])
    assert len(found) == 2
    for want in p.daughters():
        got = min(found, key=lambda r: math.dist((r.x, r.y, r.z), want["ostium_xyz_mm"]))
        assert math.dist((got.x, got.y, got.z), want["ostium_xyz_mm"]) < 2.5
        assert abs(got.radius_at_seed_mm - 2.0) < 0.6
        assert sum(a * b for a, b in zip((got.ax, got.ay, got.az), want["direction_xyz"])) > 0.95
        assert got.angle_to_centerline_deg > 70
    out = cases.report(feats, spark.range(1, 3).withColumnRenamed("id", "case_id"), s)
    rows = {r.case_id: r for r in schema.validate(out).collect()}
    assert rows["1"].problem is None and len(rows["1"].daughters) == 2
    assert rows["2"].daughters == []


def test_report_scores_folds_and_numbers(spark):
    base = dict(traced_length_mm=9.0, reached_seed_distance=1.0, mean_hu_relative_to_lumen=0.0, radius_at_seed_mm=1.5,
                origin_radius_mm=1.5, origin_radius_uncertainty_mm=0.3, nearby_aortic_radius_mm=8.0, radius_consistency_cv=0.1,
                cross_section_flatness=1.1, angle_to_centerline_deg=80.0, ostium_max_disagreement_mm=1.0, ostium_flare_ratio=1.2,
                leak_margin=1.0, touches_cap=0.0, cap_radius_ratio=0.0, case_flood_leaking=0.0, shares_vessel_with_count=0.0,
                sx=5.0, sy=0.0, sz=0.0, ax=1.0, ay=0.0, az=0.0, y=0.0, z=0.0)
    rows = [dict(base, case_id=1, id=1, component_label=1, x=0.0), dict(base, case_id=1, id=2, component_label=2, x=1.0, leak_margin=0.2),
            dict(base, case_id=1, id=3, component_label=1, x=2.0, leak_margin=0.1),
            dict(base, case_id=1, id=4, component_label=3, x=0.5, traced_length_mm=3.0)]
    from pyspark.sql import Row

    feats = spark.createDataFrame([Row(**r) for r in rows]).selectExpr("*", "map(1L, 2D) AS vessel_join_mm", "array(1L, 2L, 3L, 4L) AS partners")
    out = cases.report(feats, spark.range(1, 3).withColumnRenamed("id", "case_id"))
    got = {r.case_id: r for r in schema.validate(out).collect()}
    # 2 folds into 1 (another component, close by), 3 shares the component of 1 and stays, 4 is too short
    assert [d.ostium_xyz_mm[0] for d in got["1"].daughters] == [0.0, 2.0] and got["1"].problem is None
    assert got["2"].daughters == []
    apart = feats.withColumn("partners", F.expr("cast(array() AS array<bigint>)"))
    lone = cases.report(apart, spark.range(1, 2).withColumnRenamed("id", "case_id")).first()
    assert len(lone.daughters) == 3


def test_lumen_and_trunk_geometry(spark):
    p = phantom.Phantom("1", size_mm=(24, 24, 30), trunk_radius=5.0, trunk_z=(3, 26))
    nz, ny, nx = p.shape
    vox = phantom.voxels(spark, p).selectExpr("1L AS case_id", "z", "y", "x", "vid AS gid", "cast(hu AS double) AS hu", "in_mask")
    s = cases.lumen(vox).first()
    assert s.median == 400.0 and s.mad == 0.0 and s.ref == 400.0 and 60 < s.section < 90
    from voxarbor.operators import centerline

    trunk = centerline.trunk_parts(vox.where("in_mask").select("case_id", "z", "y", "x", "gid"), 1.0).where("kept").cache()
    line = centerline.centreline(trunk.selectExpr("case_id", "label", "cast(x AS double) AS x", "cast(y AS double) AS y",
                                                  "cast(z AS double) AS z"), 1.0).orderBy("seq").collect()
    assert all(abs(r.x - 12) < 0.2 and abs(r.y - 12) < 0.2 and abs(abs(r.tz) - 1) < 0.01 for r in line)
    length = centerline.line_lengths(spark.createDataFrame(line)).first().length
    assert 26 < length < 34


def bone_contact(spark, with_cortex):
    """A trunk, a bright stub, a dim branch and a block beside the stub's end that only a low threshold opens; with a
    cortex of high values the block is bone, without it tissue."""
    shape = (18, 22, 40)
    cortex = "WHEN z BETWEEN 3 AND 14 AND y BETWEEN 5 AND 16 AND x BETWEEN 22 AND 37 AND NOT (z BETWEEN 5 AND 12 AND y BETWEEN 7 AND 14 AND x BETWEEN 24 AND 35) THEN 900" if with_cortex else ""
    return spark.range(shape[0] * shape[1] * shape[2]).selectExpr(
        "1L AS case_id", f"cast(id div {shape[1] * shape[2]} AS int) AS z", f"cast((id div {shape[2]}) % {shape[1]} AS int) AS y",
        f"cast(id % {shape[2]} AS int) AS x", "id AS gid").selectExpr(
        "*", f"""cast(CASE WHEN z BETWEEN 2 AND 15 AND (y - 11) * (y - 11) + (x - 11) * (x - 11) <= 16 THEN 300
            WHEN z BETWEEN 8 AND 10 AND y BETWEEN 10 AND 12 AND x BETWEEN 15 AND 19 THEN 300
            WHEN z BETWEEN 8 AND 10 AND y BETWEEN 10 AND 12 AND x BETWEEN 20 AND 21 THEN 160
            {cortex} WHEN z BETWEEN 3 AND 14 AND y BETWEEN 5 AND 16 AND x BETWEEN 22 AND 37 THEN 160
            WHEN z BETWEEN 8 AND 10 AND y BETWEEN 10 AND 12 AND x BETWEEN 2 AND 6 THEN 130 ELSE 0 END AS double) AS hu""",
        "z BETWEEN 2 AND 15 AND (y - 11) * (y - 11) + (x - 11) * (x - 11) <= 16 AS in_mask")


@pytest.mark.parametrize("with_cortex", [True, pytest.param(False, marks=pytest.mark.skipif(
    not os.environ.get("VOXARBOR_SLOW"), reason="minutes long; set VOXARBOR_SLOW=1"))])
def test_bone_is_cut_and_tissue_stops_the_descent(spark, with_cortex):
    vox = bone_contact(spark, with_cortex).cache()
    s = cases.Settings(spacing=(1.0, 1.0, 1.0), budget=10.0, searches=1, low=0.40, high=0.70, step=0.13)
    stats = cases.lumen(vox).cache()
    assert stats.first().ceiling == 300.0
    cells, chosen, _ = cases.search_threshold(vox, stats, s)
    got = chosen.first()
    assert not got.leak
    reached = {(r.z, r.y, r.x) for r in cells.collect()}
    assert (9, 11, 18) in reached and (9, 11, 30) not in reached
    assert ((9, 11, 5) in reached) == with_cortex
    assert (got.f < 130 / 300) == with_cortex and (got.f > 160 / 300) != with_cortex
