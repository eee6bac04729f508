"""Grid, band, drift and tracing measures on the per-supplier lattices, orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor import schema
from voxarbor.functions import scalar
from voxarbor.operators import distance, lattice, matching, sequence, studies, trace
from voxarbor.plans import detection as det
from voxarbor.plans.points import order_points
from voxarbor.plans.registry import query
from voxarbor.plans.volumes import bright, bright_sql, flood_sql, near_sql, trunk_flood
from voxarbor.sources.predictions import write_predictions
from voxarbor.session import Rounds
from voxarbor.sources.tables import NX, NY, NZ, VOXELS_SQL, table, voxels

# A grid of its own for each case: spacing, origin and a quarter turn for odd cases.
GRID = ("array(0.5D + (case_id % 3) * 0.25D, 1.0D, 1.5D) AS spacing", "array(cast(case_id AS double), -case_id / 2D, 10.0D) AS origin",
        "CASE WHEN case_id % 2 = 1 THEN array(0D, -1D, 0D, 1D, 0D, 0D, 0D, 0D, 1D) "
        "ELSE array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D) END AS direction")


@query("grid_positions", f"""
WITH {VOXELS_SQL},
g AS (SELECT gid, case_id, x * (0.5 + (case_id % 3) * 0.25) AS ax, y * 1.0 AS ay, z * 1.5 AS az, x, y, z FROM vox)
SELECT gid, round(CASE WHEN case_id % 2 = 1 THEN case_id - ay ELSE case_id + ax END, 6)::DOUBLE AS px,
  round(CASE WHEN case_id % 2 = 1 THEN -case_id / 2.0 + ax ELSE -case_id / 2.0 + ay END, 6)::DOUBLE AS py,
  round(10.0 + az, 6)::DOUBLE AS pz, x::DOUBLE AS ix, y::DOUBLE AS iy, z::DOUBLE AS iz FROM g""")
def grid_positions(spark, sf):
    """Cells in patient space under a grid of each case, and back to index positions."""
    v = voxels(spark, sf).selectExpr("gid", "case_id", "x", "y", "z", *GRID)
    grid = [F.col(c) for c in ("spacing", "origin", "direction")]
    there = scalar.index_to_physical([F.col(c) for c in "xyz"], *grid)
    v = v.select("*", *[c.alias(f"p{a}") for a, c in zip("xyz", there)])
    back = scalar.physical_to_index([F.col(f"p{a}") for a in "xyz"], *grid)
    return v.select("gid", *[F.round(f"p{a}", 6).alias(f"p{a}") for a in "xyz"],
                    *[F.round(c, 6).alias(f"i{a}") for a, c in zip("xyz", back)])


@query("grid_units", f"""
WITH {VOXELS_SQL},
c AS (SELECT s_suppkey AS case_id, 0.5 + (s_suppkey % 3) * 0.25 AS sx FROM supplier),
t AS (SELECT case_id, 0.4 * (case_id % 9) AS mm, sx::DOUBLE AS sx FROM c)
SELECT case_id, CAST(greatest(1, round_even(mm / sx, 0)) AS INT) AS radius, round(sx * 1.5, 6) AS volume,
  round(sqrt(sx * sx + 1.0 + 2.25), 6) AS edge, round(1.0 + (sx + 2.5) / 6, 6) AS floor_mm, 'aniso' AS tag,
  format('branch_{{:03d}}', case_id) AS name, k.cells, k.last_z, k.last_y, k.last_x
FROM t LEFT JOIN (SELECT case_id, count(*) AS cells, CAST(max(vid) // {NX * NY} AS INT) AS last_z,
  CAST(max(vid) // {NX} % {NY} AS INT) AS last_y, CAST(max(vid) % {NX} AS INT) AS last_x FROM vox GROUP BY 1) k USING (case_id)""")
def grid_units(spark, sf):
    """Voxel radius, volume, longest edge, peak floor and names of every case's grid; its last cell unfolded."""
    cases = table(spark, sf, "supplier").selectExpr("s_suppkey AS case_id").selectExpr("*", GRID[0])
    s = F.col("spacing")
    cases = cases.select(
        "case_id", scalar.voxel_radius(F.expr("0.4D * (case_id % 9)"), s[0]).alias("radius"),
        F.round(scalar.voxel_volume(s), 6).alias("volume"), F.round(scalar.longest_edge(s), 6).alias("edge"),
        F.round(scalar.peak_floor(s), 6).alias("floor_mm"), scalar.spacing_tag(s).alias("tag"),
        scalar.branch_id(F.col("case_id")).alias("name"))
    cells = voxels(spark, sf).select("case_id", scalar.flat_id(F.col("z"), F.col("y"), F.col("x"), NY, NX).alias("v"))
    cells = cells.groupBy("case_id").agg(F.count("*").alias("cells"), F.max("v").alias("top"))
    cells = cells.select("case_id", "cells", *[c.alias(f"last_{a}") for a, c in zip("zyx", scalar.unflatten("top", NY, NX))])
    return cases.join(cells, "case_id", "left")


@query("perpendicular_frames", f"""
WITH {VOXELS_SQL},
d AS (SELECT gid, (x + 1) / sqrt((x+1)*(x+1) + y*y + z*z) AS dx, y / sqrt((x+1)*(x+1) + y*y + z*z) AS dy,
             z / sqrt((x+1)*(x+1) + y*y + z*z) AS dz FROM vox),
f AS (SELECT *, CASE WHEN abs(dx) > 0.9 THEN -dz ELSE 0.0 END AS ux, CASE WHEN abs(dx) > 0.9 THEN 0.0 ELSE dz END AS uy,
             CASE WHEN abs(dx) > 0.9 THEN dx ELSE -dy END AS uz FROM d),
n AS (SELECT *, sqrt(ux*ux + uy*uy + uz*uz) AS len FROM f),
u AS (SELECT *, CASE WHEN len > 0 THEN ux / len ELSE 0 END AS ax, CASE WHEN len > 0 THEN uy / len ELSE 0 END AS ay,
             CASE WHEN len > 0 THEN uz / len ELSE 0 END AS az FROM n)
SELECT gid, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay, round(az, 6) + 0.0 AS az,
       round(dy * az - dz * ay, 6) + 0.0 AS bx, round(dz * ax - dx * az, 6) + 0.0 AS by_, round(dx * ay - dy * ax, 6) + 0.0 AS bz FROM u""")
def perpendicular_frames(spark, sf):
    """Two unit vectors across the direction of every cell from a corner."""
    d = voxels(spark, sf).selectExpr("gid", "cast(x + 1 AS double) AS dx", "cast(y AS double) AS dy", "cast(z AS double) AS dz")
    unit = scalar.unit3([F.col(c) for c in ("dx", "dy", "dz")])
    d = d.select("gid", *[c.alias(n) for c, n in zip(unit, ("ux", "uy", "uz"))])
    a, b = scalar.perpendicular_pair([F.col(c) for c in ("ux", "uy", "uz")])
    return d.select("gid", *[(F.round(c, 6) + F.lit(0.0)).alias(n) for c, n in zip([*a, *b], ("ax", "ay", "az", "bx", "by_", "bz"))])


CASE_LIGHT = f"""{VOXELS_SQL},
st AS (SELECT case_id, quantile_cont(hu, 0.25) / 1e6 AS p25, quantile_cont(hu, 0.5) / 1e6 AS p50, quantile_cont(hu, 0.75) / 1e6 AS p75,
         min(hu) / 1e6 AS lo, max(hu) / 1e6 AS hi FROM vox GROUP BY 1)"""


def case_light(spark, sf):
    """Quartiles and range of the brightness per case; a lattice case has at most 300 cells."""
    return voxels(spark, sf).groupBy("case_id").agg(
        *[F.expr(f"percentile(hu, {p}) / 1e6D AS p{int(p * 100)}") for p in (0.25, 0.5, 0.75)],
        F.expr("min(hu) / 1e6D AS lo"), F.expr("max(hu) / 1e6D AS hi"))


@query("adaptive_bands", f"""
WITH {CASE_LIGHT},
m AS (SELECT case_id, (p75 - p25) / greatest(hi - lo, 1e-6) AS ratio, (p75 - p25 * 0.8) / greatest(abs(p75), 1e-6) AS margin FROM st),
t AS (SELECT case_id, greatest(greatest(0.0, least(1.0, (ratio - 0.20) / 0.40)), greatest(0.0, least(1.0, 1.0 - margin * 2))) AS t FROM m)
SELECT case_id, round(t, 6) AS tightening, round(0.35 + 0.25 * t, 6) AS k0, round(0.60 + 0.25 * t, 6) AS k1, 1.35::DOUBLE AS k2, 2.00::DOUBLE AS k3 FROM t""")
def adaptive_bands(spark, sf):
    """Brightness band of every case, raised for noisy tissue and thin margins."""
    c = case_light(spark, sf)
    tight, knots = scalar.adaptive_band(F.expr("p75 - p25"), F.expr("hi - lo"), F.col("p75"), F.expr("p25 * 0.8D"))
    return c.select("case_id", F.round(tight, 6).alias("tightening"), *[F.round(k, 6).alias(f"k{i}") for i, k in enumerate(knots)])


@query("leak_margins", f"""
WITH {CASE_LIGHT}
SELECT case_id, round(greatest(0.0, least(2.0, (p50 - p25) / greatest((CASE WHEN p75 - p25 > 3 THEN p75 ELSE p50 END) - p25, 1e-6))), 6) AS margin,
       round(CASE WHEN p75 - p25 > 3 THEN p75 ELSE p50 END, 6) AS reference FROM st""")
def leak_margins(spark, sf):
    """How far a case's median stands above a threshold on the way to its reference."""
    ref = scalar.lumen_reference(F.col("p50"), F.col("p25"), F.col("p75"), 3.0)
    c = case_light(spark, sf).withColumn("ref", ref)
    return c.select("case_id", F.round(scalar.leak_margin(F.col("p50"), F.col("p25"), F.col("ref")), 6).alias("margin"),
                    F.round("ref", 6).alias("reference"))


@query("drift_fates", """
WITH b AS (SELECT o_custkey AS case_id, o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'),
o AS (SELECT case_id, id, (id % 7) * 0.7 AS d FROM b WHERE id % 5 <> 0)
SELECT b.case_id, b.id, o.id IS NOT NULL AND d <= 3.5 AS present, coalesce(d > 2.0 AND d <= 3.5, false) AS moved, false AS appeared
FROM b LEFT JOIN o USING (case_id, id)
UNION ALL SELECT case_id, id, true, false, true FROM o WHERE d > 3.5""")
def drift_fates(spark, sf):
    """What a change does to every finished order's point: kept, moved or gone, and what appears instead."""
    base = order_points(spark, sf).where("kind = 'F'")
    other = base.where("id % 5 <> 0").selectExpr("case_id", "id", "x + (id % 7) * 0.7D AS x", "y", "z")
    pairs = base.join(other.selectExpr("case_id", "id", "x AS x2"), ["case_id", "id"]).selectExpr(
        "case_id", "id AS pred_id", "id AS ref_id", "abs(round(x2 - x, 6)) AS distance").where("distance <= 3.5D")
    return matching.drift(base, other, pairs).select("case_id", "id", "present", "moved", "appeared")


@query("cell_depth", f"""
WITH {bright_sql(1.1)},
ring AS (SELECT DISTINCT a.case_id, a.z + o.dz AS z, a.y + o.dy AS y, a.x + o.dx AS x FROM br a, off o
         WHERE NOT EXISTS (SELECT 1 FROM br b WHERE b.case_id = a.case_id AND b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx))
SELECT br.gid, round(sqrt(min((br.z-r.z)*(br.z-r.z)*2.25 + (br.y-r.y)*(br.y-r.y) + (br.x-r.x)*(br.x-r.x)*0.25)), 6) AS depth
FROM br JOIN ring r USING (case_id) GROUP BY 1""")
def cell_depth(spark, sf):
    """Distance transform: every bright cell's way to the nearest cell outside, on uneven spacing."""
    place = ["x * 0.5D AS x", "cast(y AS double) AS y", "z * 1.5D AS z"]
    br = bright(spark, sf, 1.1)
    ring = lattice.rim(br.select(*lattice.CELL)).selectExpr("case_id AS instance_id", "xxhash64(z, y, x) AS id", *place)
    own = br.selectExpr("case_id AS instance_id", "gid AS id", *place)
    return trace.depths(own, ring, 1.0).selectExpr("id AS gid", "round(depth, 6) AS depth")


@query("signed_distance", f"""
WITH {bright_sql(1.1)},
box AS (SELECT c.case_id, z.z, y.y, x.x FROM (SELECT DISTINCT case_id FROM vox) c, range({NZ}) z(z), range({NY}) y(y), range({NX}) x(x)),
g AS (SELECT box.*, br.gid IS NOT NULL AS inside FROM box LEFT JOIN br USING (case_id, z, y, x)),
edge AS (SELECT DISTINCT a.case_id, a.z, a.y, a.x FROM {near_sql('g', 'g', 'off')} WHERE o.s = 1 AND a.inside AND NOT b.inside)
SELECT CAST(g.case_id * {NZ * NY * NX} + (g.z * {NY} + g.y) * {NX} + g.x AS BIGINT) AS gid,
  round(CASE WHEN any_value(inside) THEN 1 ELSE -1 END * sqrt(min((g.z-e.z)*(g.z-e.z)*2.25 + (g.y-e.y)*(g.y-e.y) + (g.x-e.x)*(g.x-e.x)*0.25)), 6) + 0.0 AS signed
FROM g LEFT JOIN edge e USING (case_id) GROUP BY g.case_id, g.z, g.y, g.x""")
def signed_distance(spark, sf):
    """Signed distance to the border of the bright cells, for every cell of every lattice, on uneven spacing."""
    vox = voxels(spark, sf)
    grid = vox.select("case_id").distinct().selectExpr("case_id", f"explode(sequence(0, {NZ * NY * NX - 1})) AS v").selectExpr(
        "case_id", f"cast(v div {NY * NX} AS int) AS z", f"cast((v div {NX}) % {NY} AS int) AS y", f"cast(v % {NX} AS int) AS x",
        f"cast(case_id * {NZ * NY * NX} + v AS bigint) AS gid")
    lit = bright(spark, sf, 1.1).selectExpr("gid", "true AS lit")
    marked = grid.join(lit, "gid", "left").selectExpr(*lattice.CELL, "gid", "coalesce(lit, false) AS inside")
    return distance.signed_distances(marked, "inside", (0.5, 1.0, 1.5)).selectExpr("gid", "round(signed, 6) + 0D AS signed")


@query("trace_limits", f"""
WITH {flood_sql(1.1, 60)},
f AS (SELECT case_id, dist / 10.0 AS d FROM fl JOIN vox USING (gid) WHERE dist > 0),
m AS (SELECT case_id, max(d) AS vessel_end, sqrt(count(*) FILTER (WHERE d >= 1.0 AND d < 3.0) * 0.75 / (2.0 * pi())) AS radius FROM f GROUP BY 1),
k AS (SELECT *, CASE WHEN case_id % 3 = 0 THEN case_id % 5 + 0.5 END AS fork FROM m)
SELECT case_id, round(least(vessel_end, least(4.0, coalesce(fork, 4.0)))::DOUBLE, 6) AS stop, round(radius, 6) AS radius,
  CASE WHEN vessel_end <= least(4.0, coalesce(fork, 4.0)) THEN 'vessel_end' WHEN fork < 4.0 THEN 'bifurcation' ELSE 'max_length' END AS truncated_by
FROM k""")
def trace_limits(spark, sf):
    """Where the trace of every case would end and why, and the radius of its front around two millimetres."""
    far = trunk_flood(spark, sf, 1.1, 60).where("dist > 0").selectExpr("case_id AS instance_id", "dist / 10D AS dist")
    forks = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").selectExpr(
        "s_suppkey AS instance_id", "s_suppkey % 5 + 0.5D AS distance")
    radius = far.groupBy("instance_id").agg(trace.radius_in_band(2.0, 2.0, 0.75).alias("radius"))
    return trace.limits(far, forks, 4.0).join(radius, "instance_id").selectExpr(
        "instance_id AS case_id", "round(limit, 6) AS stop", "round(radius, 6) AS radius", "truncated_by")


@query("front_bifurcations", f"""
WITH {flood_sql(1.1, 60)},
c AS (SELECT case_id, z, y, x, v.gid, dist / 10.0 AS d FROM fl JOIN vox v USING (gid) WHERE dist > 0),
top AS (SELECT case_id, max(d) AS top FROM c GROUP BY 1),
sl AS (SELECT c.*, k FROM c JOIN top USING (case_id), range(12) t(k) WHERE 1.0 + 0.5 * k < top AND d >= 1.0 + 0.5 * k AND d < 2.0 + 0.5 * k),
near AS (SELECT a.k, a.gid AS src, b.gid AS dst FROM sl a JOIN off o ON true JOIN sl b
         ON b.k = a.k AND b.case_id = a.case_id AND b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
reach AS (SELECT k, gid AS id, gid AS lab FROM sl UNION SELECT r.k, near.dst, r.lab FROM reach r JOIN near ON near.k = r.k AND near.src = r.id),
lab AS (SELECT case_id, sl.k, gid, min(lab) AS lab FROM reach JOIN sl ON sl.gid = reach.id AND sl.k = reach.k GROUP BY ALL),
bl AS (SELECT case_id, k, lab, count(*) AS n FROM lab GROUP BY ALL),
sp AS (SELECT case_id, k, count(*) AS blobs FROM (SELECT *, max(n) OVER (PARTITION BY case_id, k) AS most FROM bl)
       WHERE n >= 4 AND n >= 0.25 * most GROUP BY ALL HAVING count(*) >= 2),
run AS (SELECT *, k - row_number() OVER (PARTITION BY case_id ORDER BY k) AS g FROM sp),
held AS (SELECT case_id, g, min(k) AS k, arg_min(blobs, k) AS blobs FROM run GROUP BY ALL HAVING count(*) >= 2)
SELECT case_id, round(min(1.0 + 0.5 * k)::DOUBLE, 6) AS distance, arg_min(blobs, k) AS blobs FROM held GROUP BY 1""")
def front_bifurcations(spark, sf):
    """First distance at which the front of a case's flood divides into lasting parts of some size."""
    far = trunk_flood(spark, sf, 1.1, 60).where("dist > 0").selectExpr(
        *lattice.CELL, "gid", "case_id AS instance_id", "dist / 10D AS dist")
    return trace.bifurcations(far, 0.0, 1.0).selectExpr("instance_id AS case_id", "round(distance, 6) AS distance", "blobs")


BUDGETS = [30.0 * f for f in studies.BUDGET_FRACTIONS]


@query("budget_sweep", f"""
WITH {flood_sql(1.1, 60)},
b AS (SELECT unnest({BUDGETS})::DOUBLE AS budget),
n AS (SELECT budget, case_id, count(*) FILTER (WHERE dist > 0 AND dist <= budget) AS n FROM fl JOIN vox USING (gid), b GROUP BY ALL)
SELECT budget, CAST(sum(n) AS BIGINT) AS total_n, round(avg(n), 6) AS mean_n, count(*) FILTER (WHERE n = 0) AS empty FROM n GROUP BY 1""")
def budget_sweep(spark, sf):
    """Reached cells for every flood budget of the grid, from one flood at the largest."""
    far = trunk_flood(spark, sf, 1.1, int(max(BUDGETS))).select("case_id", "dist", F.expr(studies.rows_of("budget", BUDGETS)))
    per = far.groupBy("budget", "case_id").agg(F.expr("count_if(dist > 0 AND dist <= budget) AS n"))
    return per.groupBy("budget").agg(F.expr("sum(n) AS total_n"), F.expr("round(avg(n), 6) AS mean_n"), F.expr("count_if(n = 0) AS empty"))


@query("path_walk_back", f"""
WITH RECURSIVE {bright_sql(1.2)},
up AS (SELECT a.gid AS id, min(b.gid) AS parent FROM {near_sql('br', 'br', 'off')} WHERE b.gid < a.gid GROUP BY 1),
w AS (SELECT gid AS trace_id, 0 AS back, gid FROM br WHERE gid NOT IN (SELECT parent FROM up)
      UNION ALL SELECT w.trace_id, w.back + 1, up.parent FROM w JOIN up ON up.id = w.gid)
SELECT trace_id, CAST(max(back) OVER (PARTITION BY trace_id) - back AS INT) AS seq, gid FROM w""")
def path_walk_back(spark, sf):
    """Cells from the end of the pointers to every true end, a cell no other one points to."""
    br = bright(spark, sf, 1.2)
    links = lattice.edges(br).groupBy(F.expr("dst AS gid")).agg(F.expr("min(src) AS parent"))
    ends = br.select("gid").join(links.selectExpr("parent AS gid"), "gid", "left_anti")
    return trace.walk_back(ends.selectExpr("gid AS trace_id", "gid"), links)


LINE = """ln AS (SELECT user_id AS trace_id, CAST(row_number() OVER w - 1 AS INT) AS seq, value / 10.0 AS x,
  (event_id % 13)::DOUBLE AS y, (event_id % 7)::DOUBLE AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
sg AS (SELECT *, sqrt((x - lag(x) OVER o) * (x - lag(x) OVER o) + (y - lag(y) OVER o) * (y - lag(y) OVER o)
  + (z - lag(z) OVER o) * (z - lag(z) OVER o)) AS step FROM ln WINDOW o AS (PARTITION BY trace_id ORDER BY seq)),
ar AS (SELECT *, sum(coalesce(step, 0)) OVER (PARTITION BY trace_id ORDER BY seq) AS arc FROM sg),
tt AS (SELECT *, max(arc) OVER (PARTITION BY trace_id) AS total, lead(arc) OVER o AS arc1, lead(x) OVER o AS x1, lead(y) OVER o AS y1,
  lead(z) OVER o AS z1 FROM ar WINDOW o AS (PARTITION BY trace_id ORDER BY arc, seq))"""


def event_lines(spark, sf):
    """One line per user through its events in time order, numbered in blocks of an hour."""
    ev = table(spark, sf, "events").selectExpr("user_id AS trace_id", "ts", "event_id", "value / 10D AS x",
                                               "cast(event_id % 13 AS double) AS y", "cast(event_id % 7 AS double) AS z")
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', cast(ts AS timestamp_ntz))")
    numbered = sequence.running(ev, ["trace_id"], ["ts", "event_id"], {"n": F.lit(1)}, hour)
    return Rounds(spark, "lines").save(numbered.selectExpr("trace_id", "cast(n - 1 AS int) AS seq", "x", "y", "z"))[0]


@query("arc_positions", f"""
WITH {LINE},
q AS (SELECT *, unnest([0, 1, 2]) AS k, unnest([0.0, total / 2, total]) AS want FROM tt),
h AS (SELECT *, CASE WHEN arc1 > arc THEN greatest(0.0, least(1.0, (want - arc) / (arc1 - arc))) ELSE 0 END AS t FROM q
      WHERE (want >= arc OR seq = 0) AND (want < arc1 OR arc1 IS NULL))
SELECT trace_id, CAST(k AS INT) AS k, round(want, 4) AS want, round(x + coalesce(x1 - x, 0) * t, 4) AS x,
  round(y + coalesce(y1 - y, 0) * t, 4) AS y, round(z + coalesce(z1 - z, 0) * t, 4) AS z FROM h""")
def arc_positions(spark, sf):
    """Points at the start, the middle and the end of every line by its length."""
    at = trace.at_arcs_of_long(event_lines(spark, sf), "array(0D, total / 2, total)")
    return at.selectExpr("trace_id", "k", *[f"round({c}, 4) AS {c}" for c in ("want", "x", "y", "z")])


@query("prediction_files", f"""
WITH RECURSIVE {det.kept_sql()}
SELECT CAST(c.c_custkey AS VARCHAR) AS case_id, coalesce(r.n, 0) AS n, round(coalesce(r.x, 0), 6) AS x_sum,
       round(coalesce(r.radius, 0), 6) AS radius_sum
FROM customer c LEFT JOIN (SELECT case_id, count(*) AS n, sum(x) AS x, sum(radius_at_seed_mm) AS radius FROM rp GROUP BY 1) r
  ON r.case_id = c.c_custkey""")
def prediction_files(spark, sf):
    """Predictions written as documents and read again: counts and sums per case."""
    cases = table(spark, sf, "customer").selectExpr("c_custkey AS case_id")
    made = schema.public_fields(schema.assemble(det.daughters(spark, sf), cases))
    folder = Rounds(spark, "documents").root
    write_predictions(made, folder)
    back = spark.read.schema(schema.PREDICTION).json(folder)
    return back.selectExpr(
        "case_id", "cast(size(daughters) AS bigint) AS n",
        "round(aggregate(daughters, 0D, (s, d) -> s + d.ostium_xyz_mm[0]), 6) AS x_sum",
        "round(aggregate(daughters, 0D, (s, d) -> s + d.radius_mm), 6) AS radius_sum")
