"""Morphology, component and flood queries over the per-supplier lattices."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.operators import graph, lattice
from voxarbor.operators.quantiles import small_quantile
from voxarbor.operators.sequence import dense_counts
from voxarbor.plans.registry import query
from voxarbor.session import Rounds
from voxarbor.sources.tables import NX, NY, NZ, VOXELS_SQL, voxels

SHAPE = (NZ, NY, NX)
GOOD = f"z BETWEEN 0 AND {NZ - 1} AND y BETWEEN 0 AND {NY - 1} AND x BETWEEN 0 AND {NX - 1}"


def with_reference(vox):
    """Add the per-case brightness reference: the median over the trunk (at most 90 cells)."""
    ref = vox.where("in_mask").groupBy("case_id").agg(small_quantile("hu", 0.5).alias("ref"))
    return vox.join(ref, "case_id")


def written_cells(spark, sf):
    """Cells with the reference of their case, written once for a plan that names them several times."""
    return Rounds(spark, "cells").save(with_reference(voxels(spark, sf)).select(*lattice.CELL, "gid", "hu", "ref", "in_mask"))[0]


def bright(spark, sf, fraction: float):
    return with_reference(voxels(spark, sf)).where(f"hu >= {fraction}D * ref")


def bright_sql(fraction: float) -> str:
    return f"""{VOXELS_SQL},
ref AS (SELECT case_id, median(hu) AS ref FROM vox WHERE in_mask GROUP BY 1),
br AS (SELECT v.*, ref FROM vox v JOIN ref USING (case_id) WHERE hu >= {fraction}::DOUBLE * ref),
o3 AS (SELECT unnest([-1, 0, 1]) AS o),
off AS (SELECT a.o AS dz, b.o AS dy, c.o AS dx, abs(a.o) + abs(b.o) + abs(c.o) AS s
        FROM o3 a, o3 b, o3 c WHERE abs(a.o) + abs(b.o) + abs(c.o) > 0)"""


def near_sql(a: str, b: str, offs: str) -> str:
    """FROM-list of a joined to its neighbours in b."""
    return (f"{a} a JOIN {offs} o ON true JOIN {b} b ON b.case_id = a.case_id AND b.z = a.z + o.dz "
            f"AND b.y = a.y + o.dy AND b.x = a.x + o.dx")


@query("neighbour_edges", f"""
WITH {bright_sql(1.4)}
SELECT a.case_id, a.gid AS src, b.gid AS dst, CAST(o.s AS INT) AS axes
FROM {near_sql('br', 'br', 'off')} WHERE (o.dz, o.dy, o.dx) > (0, 0, 0)""")
def neighbour_edges(spark, sf):
    return lattice.edges(bright(spark, sf, 1.4), weight=lambda a, b, c: abs(a) + abs(b) + abs(c)).select(
        "case_id", "src", "dst", F.col("w").alias("axes"))


ERODED = """er AS (SELECT a.case_id, a.z, a.y, a.x FROM {near} WHERE o.s = 1 GROUP BY ALL HAVING count(*) = 6)"""


@query("erosion", f"""
WITH {bright_sql(0.6)}, {ERODED.format(near=near_sql('br', 'br', 'off'))}
SELECT * FROM er""")
def erosion(spark, sf):
    return lattice.erode(bright(spark, sf, 0.6))


@query("dilation", f"""
WITH {bright_sql(1.5)}
SELECT DISTINCT a.case_id, CAST(a.z + o.dz AS INT) AS z, CAST(a.y + o.dy AS INT) AS y, CAST(a.x + o.dx AS INT) AS x
FROM br a, (SELECT dz, dy, dx FROM off WHERE s = 1 UNION ALL SELECT 0, 0, 0) o
WHERE a.z + o.dz BETWEEN 0 AND {NZ - 1} AND a.y + o.dy BETWEEN 0 AND {NY - 1} AND a.x + o.dx BETWEEN 0 AND {NX - 1}""")
def dilation(spark, sf):
    return lattice.dilate(bright(spark, sf, 1.5), shape=SHAPE)


@query("opening", f"""
WITH {bright_sql(0.6)}, {ERODED.format(near=near_sql('br', 'br', 'off'))}
SELECT DISTINCT a.case_id, CAST(a.z + o.dz AS INT) AS z, CAST(a.y + o.dy AS INT) AS y, CAST(a.x + o.dx AS INT) AS x
FROM er a, (SELECT dz, dy, dx FROM off WHERE s = 1 UNION ALL SELECT 0, 0, 0) o""")
def opening(spark, sf):
    return lattice.opening(bright(spark, sf, 0.6))


@query("surface_shell", f"""
WITH {bright_sql(0.6)},
c AS (SELECT a.gid, count(*) AS n FROM {near_sql('br', 'br', 'off')} WHERE o.s = 1 GROUP BY 1)
SELECT case_id, z, y, x, coalesce(c.n, 0) AS n FROM br LEFT JOIN c USING (gid) WHERE coalesce(c.n, 0) < 6""")
def surface_shell(spark, sf):
    """Mask cells with an exposed face and the number of their member neighbours."""
    return lattice.surface(bright(spark, sf, 0.6))


@query("rim_suppression", f"""
WITH {bright_sql(1.0)},
hot AS (SELECT * FROM br WHERE hu >= 1.6 * ref),
ring AS (SELECT DISTINCT b.gid FROM {near_sql('hot', 'vox', 'off')} WHERE b.gid NOT IN (SELECT gid FROM hot))
SELECT gid, hu FROM br WHERE gid NOT IN (SELECT gid FROM ring)""")
def rim_suppression(spark, sf):
    """Bright cells without the one-cell ring around very bright ones; the latter stay."""
    br = bright(spark, sf, 1.0)
    ring = lattice.rim(br.where("hu >= 1.6D * ref"))
    return lattice.without(br, ring).select("gid", "hu")


@query("standoff_shell", f"""
WITH {bright_sql(1.6)},
b3 AS (SELECT unnest(range(-2, 3)) AS o),
ballo AS (SELECT a.o AS dz, b.o AS dy, c.o AS dx, a.o*a.o + b.o*b.o + c.o*c.o AS r FROM b3 a, b3 b, b3 c),
t AS (SELECT a.case_id, a.z + o.dz AS z, a.y + o.dy AS y, a.x + o.dx AS x, min(r) AS r
      FROM br a, ballo o WHERE r <= 4 GROUP BY ALL)
SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM t WHERE r > 1 AND {GOOD}""")
def standoff_shell(spark, sf):
    """Cells between one and two steps away from a set."""
    return lattice.shell(bright(spark, sf, 1.6), lattice.ball(1.0), lattice.ball(2.0), SHAPE)


@query("surface_gradient", f"""
WITH {bright_sql(0.6)},
nb AS (SELECT a.gid, o.dz, o.dy, o.dx, b.hu FROM {near_sql('br', 'br', 'off')} WHERE o.s = 1),
w AS (SELECT gid, {", ".join(f"max(hu) FILTER (WHERE d{a} = {d}) AS {a}{s}" for a in "zyx" for s, d in (("p", 1), ("m", -1)))}
      FROM nb GROUP BY 1),
f AS (SELECT br.case_id, br.z, br.y, br.x, hu AS v, w.* EXCLUDE (gid) FROM br LEFT JOIN w ON w.gid = br.gid)
SELECT case_id, z, y, x, {", ".join(f"round(CASE WHEN {a}p IS NULL AND {a}m IS NULL THEN 0 ELSE (coalesce({a}p, v) - coalesce({a}m, v))::DOUBLE / (CAST({a}p IS NOT NULL AS INT) + CAST({a}m IS NOT NULL AS INT)) END, 4) AS g{a}" for a in "zyx")}
FROM f""")
def surface_gradient(spark, sf):
    """Brightness gradient at unit spacing."""
    g = lattice.gradient(bright(spark, sf, 0.6), "cast(hu AS double)")
    return g.selectExpr(*lattice.CELL, *[f"round(g{a}, 4) AS g{a}" for a in "zyx"])


@query("outward_normals", f"""
WITH {bright_sql(0.6)},
p AS (SELECT a.gid, count(*) FILTER (WHERE o.s = 1) AS faces, sum(-o.dz) AS sz, sum(-o.dy) AS sy, sum(-o.dx) AS sx
      FROM {near_sql('br', 'br', 'off')} GROUP BY 1),
q AS (SELECT br.gid, coalesce(faces, 0) AS faces, coalesce(sz, 0) AS sz, coalesce(sy, 0) AS sy, coalesce(sx, 0) AS sx
      FROM br LEFT JOIN p ON p.gid = br.gid),
l AS (SELECT *, sqrt((sz*sz + sy*sy + sx*sx)::DOUBLE) AS len FROM q WHERE faces < 6)
SELECT gid, {", ".join(f"round(CASE WHEN len > 0 THEN s{a} / len ELSE 0 END, 6) AS n{a}" for a in "zyx")} FROM l""")
def outward_normals(spark, sf):
    n = lattice.outward_normals(bright(spark, sf, 0.6))
    gid = f"cast(case_id * {NZ * NY * NX} + (z * {NY} + y) * {NX} + x AS bigint) AS gid"
    return n.selectExpr(gid, *[f"round(n{a}, 6) AS n{a}" for a in "zyx"])


# --- components -------------------------------------------------------------------------------

def components_sql(fraction: float, faces: int) -> str:
    # pairs travel as one number, label * 10^9 + id: with two columns the checking engine's recursive union
    # fails now and then on an internal dictionary cache
    return f"""RECURSIVE {bright_sql(fraction)},
e AS (SELECT a.gid AS src, b.gid AS dst FROM {near_sql('br', 'br', 'off')} WHERE o.s <= {faces}),
reach AS (SELECT gid * 1000000000 + gid AS code FROM br
          UNION SELECT reach.code + (e.dst - e.src) FROM reach JOIN e ON e.src = reach.code % 1000000000),
cc AS (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS label FROM reach GROUP BY 1)"""


@query("connected_components", f"""
WITH {components_sql(1.4, 3)}
SELECT case_id, gid, label FROM cc JOIN br USING (gid)""")
def connected_components(spark, sf):
    return graph.label_cells(bright(spark, sf, 1.4)).select("case_id", "gid", "label")


@query("face_components", f"""
WITH {components_sql(1.2, 1)}
SELECT label, count(*) AS size, CAST(min(z) AS INT) AS z0, CAST(max(z) AS INT) AS z1
FROM cc JOIN br USING (gid) GROUP BY 1""")
def face_components(spark, sf):
    """Face-connected parts with their size and height range."""
    lab = graph.label_cells(bright(spark, sf, 1.2), graph.FACE_FORWARD)
    return lab.groupBy("label").agg(F.expr("count(1) AS size"), F.expr("min(z) AS z0"), F.expr("max(z) AS z1"))


@query("component_filter_share", f"""
WITH {components_sql(1.4, 3)},
s AS (SELECT case_id, label, count(*) AS size, CAST(sum(hu) AS BIGINT) AS mass FROM cc JOIN br USING (gid) GROUP BY ALL),
m AS (SELECT case_id, max(size) AS top FROM s GROUP BY 1)
SELECT case_id, label, size, mass FROM s JOIN m USING (case_id) WHERE size >= 0.25 * top""")
def component_filter_share(spark, sf):
    """Parts at least a quarter as large as the largest of their case."""
    lab = graph.label_cells(bright(spark, sf, 1.4))
    size = lab.groupBy("case_id", "label").agg(F.expr("count(1) AS size"), F.expr("sum(hu) AS mass"))
    top = size.groupBy("case_id").agg(F.expr("max(size) AS top"))
    return size.join(top, "case_id").where("size >= 0.25D * top").drop("top")


@query("bright_share_components", f"""
WITH {components_sql(1.4, 3)}
SELECT label, count(*) AS size, round(avg(CAST(hu >= 1.7 * ref AS INT)), 6) AS share
FROM cc JOIN br USING (gid) GROUP BY 1
HAVING count(*) >= 4 AND avg(CAST(hu >= 1.7 * ref AS INT)) >= 0.10""")
def bright_share_components(spark, sf):
    """Parts large enough whose very bright share marks them as bone-like."""
    lab = graph.label_cells(bright(spark, sf, 1.4))
    return (lab.groupBy("label").agg(F.expr("count(1) AS size"), F.expr("avg(cast(hu >= 1.7D * ref AS int)) AS share"))
            .where("size >= 4 AND share >= 0.10D").selectExpr("label", "size", "round(share, 6) AS share"))


@query("seeded_components", f"""
WITH {components_sql(1.3, 3)}
SELECT gid, label FROM (SELECT gid, label, min(z) OVER (PARTITION BY label) AS z0 FROM cc JOIN br USING (gid))
WHERE z0 = 0""")
def seeded_components(spark, sf):
    """Only the parts that contain a seed."""
    lab = graph.label_cells(bright(spark, sf, 1.3))
    return lab.join(lab.where("z = 0").select("label").distinct(), "label", "left_semi").select("gid", "label")


@query("hole_fill", f"""
WITH RECURSIVE {bright_sql(0.7)},
box AS (SELECT c.case_id, z.z, y.y, x.x, c.case_id * {NZ * NY * NX} + (z.z * {NY} + y.y) * {NX} + x.x AS gid
        FROM (SELECT DISTINCT case_id FROM vox) c, range({NZ}) z(z), range({NY}) y(y), range({NX}) x(x)),
gap AS (SELECT * FROM box WHERE gid NOT IN (SELECT gid FROM br)),
out AS (SELECT case_id, z, y, x, gid FROM gap WHERE z IN (0, {NZ - 1}) OR y IN (0, {NY - 1}) OR x IN (0, {NX - 1})
        UNION
        SELECT b.case_id, b.z, b.y, b.x, b.gid FROM {near_sql('out', 'gap', 'off')} WHERE o.s = 1)
SELECT CAST(case_id AS BIGINT) AS case_id, CAST(gid AS BIGINT) AS gid FROM gap WHERE gid NOT IN (SELECT gid FROM out)""")
def hole_fill(spark, sf):
    """Background pockets that no face-connected way joins to the border."""
    vox = voxels(spark, sf)
    grid = vox.select("case_id").distinct().selectExpr(
        "case_id", f"explode(sequence(0, {NZ * NY * NX - 1})) AS v").selectExpr(
        "case_id", f"cast(v div {NY * NX} AS int) AS z", f"cast((v div {NX}) % {NY} AS int) AS y",
        f"cast(v % {NX} AS int) AS x", f"cast(case_id * {NZ * NY * NX} + v AS bigint) AS gid")
    gap = lattice.without(grid, bright(spark, sf, 0.7).select(*lattice.CELL))
    lab = graph.label_cells(gap, graph.FACE_FORWARD)
    border = f"z IN (0, {NZ - 1}) OR y IN (0, {NY - 1}) OR x IN (0, {NX - 1})"
    return lab.join(lab.where(border).select("label").distinct(), "label", "left_anti").select("case_id", "gid")


# --- floods -----------------------------------------------------------------------------------

STEP = {1: 10, 2: 14, 3: 17}  # whole-number lengths of face, edge and corner steps


def step_weight(dz, dy, dx):
    return STEP[abs(dz) + abs(dy) + abs(dx)]


def flood_from_trunk(vox, fraction: float, budget: int):
    return graph.flood(vox.where(f"hu >= {fraction}D * ref"), vox.where("in_mask"), budget, step_weight, distance="int")


def trunk_flood(spark, sf, fraction: float, budget: int):
    return flood_from_trunk(written_cells(spark, sf), fraction, budget)


def flood_sql(fraction: float, budget: int) -> str:
    return f"""RECURSIVE {bright_sql(fraction)},
e AS (SELECT a.gid AS src, b.gid AS dst, CASE o.s WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 17 END AS w
      FROM {near_sql('vox', 'br', 'off')} WHERE NOT b.in_mask),
walk AS (SELECT gid AS id, 0 AS d FROM vox WHERE in_mask
         UNION SELECT e.dst, walk.d + e.w FROM walk JOIN e ON e.src = walk.id WHERE walk.d + e.w <= {budget}),
fl AS (SELECT id AS gid, CAST(min(d) AS INT) AS dist FROM walk GROUP BY 1)"""


@query("geodesic_budget", f"""
WITH {flood_sql(1.2, 60)}
SELECT gid, dist FROM fl""")
def geodesic_budget(spark, sf):
    return trunk_flood(spark, sf, 1.2, 60).select("gid", "dist")


@query("flood_frontier", f"""
WITH {flood_sql(1.1, 50)}
SELECT case_id, CAST(least(9, dist // 6) AS INT) AS band, count(*) AS n
FROM fl JOIN vox USING (gid) WHERE dist > 0 GROUP BY ALL""")
def flood_frontier(spark, sf):
    """Reached cells per band of the way from the trunk; the last band takes the rest."""
    fl = trunk_flood(spark, sf, 1.1, 50).where("dist > 0")
    h = fl.groupBy("case_id").agg(dense_counts("dist div 6", 10).alias("h"))
    return h.select("case_id", F.posexplode("h").alias("band", "n")).where("n > 0")


@query("reachable_core", f"""
WITH {flood_sql(1.2, 60)}
SELECT case_id, count(*) FILTER (WHERE dist <= 20) AS neck, count(*) FILTER (WHERE dist > 20) AS core,
       max(dist) AS reach FROM fl JOIN vox USING (gid) WHERE NOT in_mask GROUP BY 1""")
def reachable_core(spark, sf):
    """Reached cells outside the trunk, split at the neck distance."""
    fl = trunk_flood(spark, sf, 1.2, 60).where("dist > 0")
    return fl.groupBy("case_id").agg(F.expr("count_if(dist <= 20) AS neck"), F.expr("count_if(dist > 20) AS core"),
                                     F.expr("max(dist) AS reach"))


@query("pointer_jump_roots", f"""
WITH RECURSIVE {bright_sql(1.2)},
up AS (SELECT a.gid AS id, min(b.gid) AS parent FROM {near_sql('br', 'br', 'off')} WHERE b.gid < a.gid GROUP BY 1),
r AS (SELECT br.gid AS id, br.gid AS cur FROM br
      UNION SELECT r.id, up.parent FROM r JOIN up ON up.id = r.cur)
SELECT id AS gid, min(cur) AS root FROM r GROUP BY 1""")
def pointer_jump_roots(spark, sf):
    """Every cell points to its smallest smaller neighbour; follow the pointers to the end."""
    br = bright(spark, sf, 1.2)
    links = lattice.edges(br).groupBy(F.expr("dst AS id")).agg(F.expr("min(src) AS parent"))
    links = br.select(F.col("gid").alias("id")).join(links, "id", "left")
    return graph.roots(links).selectExpr("id AS gid", "root")


@query("exit_origin_lookup", f"""
WITH {flood_sql(1.2, 60)},
face AS (SELECT DISTINCT b.gid FROM {near_sql('vox', 'br', 'off')} WHERE a.in_mask AND NOT b.in_mask)
SELECT fl.gid, CAST(coalesce(face.gid % 7, 0) AS INT) AS origin
FROM fl LEFT JOIN face USING (gid)""")
def exit_origin_lookup(spark, sf):
    """Look up each reached cell in the table of cells that touch the trunk, 0 when absent."""
    vox = written_cells(spark, sf)
    face = (lattice.announce(vox.where("in_mask"), lattice.FULL).distinct()
            .join(vox.where("hu >= 1.2D * ref AND NOT in_mask"), lattice.CELL).selectExpr("gid", "cast(gid % 7 AS int) AS origin"))
    return (flood_from_trunk(vox, 1.2, 60).select("gid").join(face, "gid", "left")
            .selectExpr("gid", "coalesce(origin, 0) AS origin"))


LEVELS = [1.0, 1.1, 1.2, 1.3, 1.4]


@query("leak_search", f"""
WITH RECURSIVE {bright_sql(0.0)},
fr AS (SELECT unnest([{", ".join(map(str, range(len(LEVELS))))}]) AS k, unnest({LEVELS})::DOUBLE AS f),
ok AS (SELECT k, gid FROM br, fr WHERE NOT in_mask AND hu >= f * ref),
e AS (SELECT a.gid AS src, b.gid AS dst, CASE o.s WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 17 END AS w
      FROM {near_sql('vox', 'vox', 'off')} WHERE NOT b.in_mask),
walk AS (SELECT k, gid AS id, 0 AS d FROM vox, fr WHERE in_mask
         UNION SELECT walk.k, e.dst, walk.d + e.w FROM walk JOIN e ON e.src = walk.id
               JOIN ok ON ok.k = walk.k AND ok.gid = e.dst WHERE walk.d + e.w <= 59),
fl AS (SELECT k, id AS gid, min(d) AS d FROM walk GROUP BY ALL),
g AS (SELECT case_id, k, coalesce(sum(CAST(d BETWEEN 10 AND 19 AS INT)), 0) AS early,
             coalesce(sum(CAST(d BETWEEN 40 AND 59 AS INT)), 0) AS late, count(*) AS reached
      FROM fl JOIN vox USING (gid) GROUP BY ALL),
l AS (SELECT *, late >= 1.3 * early AND late > 0 AS leak FROM g)
SELECT case_id, CAST(min(k) FILTER (WHERE NOT leak) AS INT) AS chosen,
       count(*) FILTER (WHERE leak) AS leaking, CAST(sum(reached) AS BIGINT) AS visited
FROM l GROUP BY 1""")
def leak_search(spark, sf):
    """Flood every case at a grid of thresholds at once and keep the lowest that does not leak."""
    vox = written_cells(spark, sf)
    levels = "inline(array(" + ", ".join(f"struct({k} AS k, {f}D AS f)" for k, f in enumerate(LEVELS)) + "))"
    many = vox.selectExpr("*", levels).selectExpr(
        f"case_id * {len(LEVELS)} + k AS case_id", "z", "y", "x", f"gid * {len(LEVELS)} + k AS gid",
        "hu >= f * ref AS open", "in_mask")
    fl = graph.flood(many.where("open"), many.where("in_mask"), 59, step_weight, distance="int")
    per = fl.groupBy("case_id").agg(F.expr("count_if(dist BETWEEN 10 AND 19) AS early"),
                                    F.expr("count_if(dist BETWEEN 40 AND 59) AS late"), F.expr("count(1) AS reached"))
    n = len(LEVELS)
    return per.selectExpr(
        f"case_id div {n} AS case_id", f"cast(case_id % {n} AS int) AS k", "reached",
        "late >= 1.3D * early AND late > 0 AS leak").groupBy("case_id").agg(
        F.expr("min(CASE WHEN NOT leak THEN k END) AS chosen"), F.expr("count_if(leak) AS leaking"),
        F.expr("sum(reached) AS visited"))


@query("tube_stems", f"""
WITH RECURSIVE {bright_sql(1.2)},
e AS (SELECT a.gid AS src, b.gid AS dst, CASE o.s WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 17 END AS w
      FROM {near_sql('vox', 'br', 'off')} WHERE NOT b.in_mask),
walk AS (SELECT gid AS id, 0 AS d FROM vox WHERE in_mask
         UNION SELECT e.dst, walk.d + e.w FROM walk JOIN e ON e.src = walk.id WHERE walk.d + e.w <= 60),
fl AS (SELECT id AS gid, min(d) AS dist FROM walk GROUP BY 1),
neck AS (SELECT gid FROM fl WHERE dist > 0 AND dist <= 24), core AS (SELECT gid FROM fl WHERE dist > 24),
face AS (SELECT DISTINCT e.dst AS gid FROM e JOIN neck n ON n.gid = e.src JOIN core c ON c.gid = e.dst),
back AS (SELECT gid AS id, 0 AS d, gid AS src FROM face
         UNION SELECT e.dst, back.d + e.w, back.src FROM back JOIN e ON e.src = back.id
               JOIN neck n ON n.gid = e.dst WHERE back.d + e.w <= 40),
b1 AS (SELECT id AS gid, min(d) AS d FROM back GROUP BY 1),
b2 AS (SELECT b1.gid, b1.d, min(back.src) AS src FROM b1 JOIN back ON back.id = b1.gid AND back.d = b1.d GROUP BY ALL)
SELECT b2.gid, b2.src AS label FROM b2 JOIN neck USING (gid) JOIN fl ON fl.gid = b2.gid JOIN fl g ON g.gid = b2.src
WHERE fl.dist + b2.d - g.dist <= 17""")
def tube_stems(spark, sf):
    """Neck cells on a nearly shortest way to a core cell that touches the neck."""
    fl = trunk_flood(spark, sf, 1.2, 60)
    cells = [*lattice.CELL, "gid"]
    neck = fl.where("dist > 0 AND dist <= 24").select(*cells)
    core = fl.where("dist > 24").selectExpr(*cells, "gid AS label")
    return graph.tube_stems(neck, core, fl, step_weight, 17, 40, distance="int")


@query("territory_join_min", f"""
WITH {flood_sql(1.1, 60)},
t AS (SELECT v.case_id, v.z, v.y, v.x, v.gid, dist, (v.y // 2) * 10 + v.x // 2 AS label
      FROM fl JOIN vox v USING (gid) WHERE dist > 0)
SELECT a.case_id, CAST(a.label AS INT) AS a, CAST(b.label AS INT) AS b, min(greatest(a.dist, b.dist)) AS join_mm
FROM {near_sql('t', 't', 'off')} WHERE a.label < b.label GROUP BY ALL""")
def territory_join_min(spark, sf):
    """Lowest pass between territories that touch."""
    fl = trunk_flood(spark, sf, 1.1, 60).where("dist > 0").selectExpr(
        "*", "cast((y div 2) * 10 + x div 2 AS int) AS label")
    return graph.territory_joins(fl)


@query("boundary_faces", f"""
WITH {bright_sql(1.2)}
SELECT a.gid, CAST(o.dz AS INT) AS nz, CAST(o.dy AS INT) AS ny, CAST(o.dx AS INT) AS nx
FROM br a JOIN off o ON o.s = 1 WHERE NOT EXISTS (SELECT 1 FROM br b WHERE b.case_id = a.case_id
  AND b.z = a.z + o.dz AND b.y = a.y + o.dy AND b.x = a.x + o.dx)""")
def boundary_faces(spark, sf):
    """Exposed faces of bright cells with their outward normal, the relational part of a surface mesh."""
    from voxarbor.sources.scene import exposed_faces

    gid = f"cast(case_id * {NZ * NY * NX} + (z * {NY} + y) * {NX} + x AS bigint) AS gid"
    return exposed_faces(bright(spark, sf, 1.2)).selectExpr(gid, "nz", "ny", "nx")
