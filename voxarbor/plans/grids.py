"""Lattices whose cases have spacings and shapes of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.operators import grids
from voxarbor.plans.registry import query
from voxarbor.sources.tables import NX, NY, NZ, VOXELS_SQL, table, voxels

# Spacing (x, y, z) of a case by its number's remainder; the last one is the working grid itself.
SPACINGS = ((1.0, 1.5, 0.5), (1.5, 0.5, 1.0), (0.75, 0.75, 0.75))
WORKING = 0.75


def supplier_grids(spark, sf):
    """One grid per supplier: its spacing, an origin of its own and axes turned by a quarter for odd ones."""
    pick = "CASE s_suppkey % 3 " + " ".join(f"WHEN {k} THEN array({', '.join(f'{v!r}D' for v in s)})" for k, s in enumerate(SPACINGS)) + " END"
    return table(spark, sf, "supplier").selectExpr(
        "s_suppkey AS case_id", f"{pick} AS spacing", "array(s_suppkey * 1D, 2D, s_nationkey * 1D) AS origin",
        "CASE WHEN s_suppkey % 2 = 1 THEN array(0D, -1D, 0D, 1D, 0D, 0D, 0D, 0D, 1D) ELSE array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) END AS direction",
        f"array({NX}, {NY}, {NZ}) AS size")


GRIDS = f"""gr AS (SELECT s_suppkey AS case_id, s_suppkey::DOUBLE AS ox, 2.0::DOUBLE AS oy, s_nationkey::DOUBLE AS oz, s_suppkey % 2 = 1 AS turned,
  {", ".join("CASE s_suppkey % 3 " + " ".join(f"WHEN {k} THEN {s[i]!r}::DOUBLE" for k, s in enumerate(SPACINGS)) + f" END AS s{a}" for i, a in enumerate("xyz"))}
  FROM supplier)"""


@query("mixed_grid_resample", f"""
WITH {VOXELS_SQL}, {GRIDS},
pl AS (SELECT gr.*, lo, {", ".join(f"greatest(1, round_even({n} * s{a} / {WORKING}, 0))::INT AS m{a}, {WORKING} / s{a} AS t{a}" for a, n in (("x", NX), ("y", NY), ("z", NZ)))}
       FROM gr JOIN (SELECT case_id, min(hu) AS lo FROM vox GROUP BY 1) USING (case_id)),
g AS (SELECT pl.*, z, y, x, z * tz AS rz, y * ty AS ry, x * tx AS rx FROM pl, range(40) a(z), range(40) b(y), range(40) c(x)
      WHERE z < mz AND y < my AND x < mx),
p AS (SELECT *, rz <= {NZ - 0.5} AND ry <= {NY - 0.5} AND rx <= {NX - 0.5} AS inside,
        least(rz, {NZ - 1}) AS pz, least(ry, {NY - 1}) AS py, least(rx, {NX - 1}) AS px FROM g),
c AS (SELECT p.*, i, floor(pz) + i // 4 AS cz, floor(py) + i // 2 % 2 AS cy, floor(px) + i % 2 AS cx FROM p, range(8) r(i)),
w AS (SELECT *, (1 - abs(pz - cz)) * (1 - abs(py - cy)) * (1 - abs(px - cx)) AS w FROM c),
s AS (SELECT w.case_id, w.z, w.y, w.x, any_value(inside) AS inside, any_value(lo) AS lo, sum(w * coalesce(hu, lo)) AS v
      FROM w LEFT JOIN vox ON vox.case_id = w.case_id AND vox.z = cz AND vox.y = cy AND vox.x = cx GROUP BY ALL),
m AS (SELECT p.case_id, p.z, p.y, p.x, coalesce(bool_or(in_mask), false) AND any_value(inside) AS in_mask FROM p LEFT JOIN vox ON vox.case_id = p.case_id
      AND vox.z = least({NZ - 1}, floor(pz + 0.5)) AND vox.y = least({NY - 1}, floor(py + 0.5)) AND vox.x = least({NX - 1}, floor(px + 0.5)) GROUP BY ALL)
SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CASE WHEN inside THEN v ELSE lo END AS sample, in_mask
FROM s JOIN m USING (case_id, z, y, x)""")
def mixed_grid_resample(spark, sf):
    """Every lattice on one working grid: cases of three spacings in one plan, no new cell left out."""
    out = grids.resample_cases(voxels(spark, sf), supplier_grids(spark, sf), WORKING)
    return out.selectExpr("case_id", "z", "y", "x", "hu AS sample", "in_mask")


@query("mask_crop_grids", f"""
WITH {VOXELS_SQL}, {GRIDS},
hot AS (SELECT *, in_mask AND hu > 3000000 AS own FROM vox),
b AS (SELECT case_id, {", ".join(f"min({a}) AS n{a}, max({a}) AS m{a}" for a in "xyz")} FROM hot WHERE own GROUP BY 1),
c AS (SELECT gr.*, {", ".join(f"greatest(0, n{a} - w{a}) AS l{a}, least({n - 1}, m{a} + w{a}) AS h{a}" for a, n in (("x", NX), ("y", NY), ("z", NZ)))}
      FROM (SELECT *, {", ".join(f"greatest(1, round_even(1.0 / s{a}, 0))::INT AS w{a}" for a in "xyz")} FROM gr) gr JOIN b USING (case_id)),
k AS (SELECT c.case_id, count(*) AS cells, sum(hu) AS total, CAST(min(z - lz) AS INT) AS first_z, CAST(max(x - lx) AS INT) AS last_x FROM c JOIN hot USING (case_id)
      WHERE {" AND ".join(f"hot.{a} BETWEEN l{a} AND h{a}" for a in "xyz")} GROUP BY 1),
o AS (SELECT *, (hx - lx + 1)::BIGINT * (hy - ly + 1) * (hz - lz + 1) AS dense FROM c)
SELECT o.case_id, ox + CASE WHEN turned THEN -ly * sy ELSE lx * sx END AS origin_x, oy + CASE WHEN turned THEN lx * sx ELSE ly * sy END AS origin_y,
  oz + lz * sz AS origin_z, CAST(coalesce(sum(dense) OVER (ORDER BY o.case_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first,
  CAST(row_number() OVER (ORDER BY o.case_id) AS BIGINT) AS number, cells, CAST(total AS BIGINT) AS total, first_z, last_x
FROM o JOIN k USING (case_id)""")
def mask_crop_grids(spark, sf):
    """Lattices cropped to the bright part of their trunk with a millimetre around it: new origins, cells and numbers."""
    vox = voxels(spark, sf).withColumn("in_mask", F.expr("in_mask AND hu > 3000000"))
    cut, new = grids.crop_to_mask(vox, supplier_grids(spark, sf), 1.0)
    per = cut.groupBy("case_id").agg(F.expr("count(1) AS cells"), F.expr("sum(hu) AS total"), F.expr("min(z) AS first_z"), F.expr("max(x) AS last_x"))
    one = grids.numbered(new).selectExpr("name AS case_id", *[f"origin[{i}] AS origin_{a}" for i, a in enumerate("xyz")], "first", "case_id AS number")
    return one.join(per, "case_id")
