"""Watershed and instance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.operators import descent, graph, lattice, split
from voxarbor.plans.registry import query
from voxarbor.plans.volumes import SHAPE, bright, bright_sql, flood_sql, near_sql, step_weight, trunk_flood, written_cells
from voxarbor.session import Rounds
from voxarbor.sources.tables import CELLS, NX, NY, NZ, voxels


# one step of the walk per cell, from the brightest down: of the basins that meet there, every lower one joins the highest
@query("watershed_basins", f"""
WITH RECURSIVE {bright_sql(1.1)},
up AS (SELECT a.gid, arg_max(b.gid, ROW(b.hu, -b.gid)) AS parent, max(ROW(b.hu, -b.gid)) AS s
       FROM {near_sql('br', 'br', '(SELECT dz, dy, dx FROM off UNION ALL SELECT 0, 0, 0)')} GROUP BY 1),
climb AS (SELECT gid, gid AS cur FROM up UNION ALL SELECT c.gid, up.parent FROM climb c JOIN up ON up.gid = c.cur WHERE up.parent <> c.cur),
top AS (SELECT c.gid, c.cur AS basin FROM climb c JOIN up ON up.gid = c.cur WHERE up.parent = c.cur),
met AS (SELECT a.case_id, a.gid, a.hu / 1000000.0 AS h, list(DISTINCT t.basin) AS b
        FROM {near_sql('br', 'br', 'off')} JOIN top t ON t.gid = b.gid WHERE (b.hu, -b.gid) > (a.hu, -a.gid)
        GROUP BY ALL HAVING count(DISTINCT t.basin) > 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY h DESC, gid) AS k FROM met),
walk AS (SELECT br.case_id, 0::BIGINT AS k, list(struct_pack(b := br.gid, r := br.gid, p := br.hu / 1000000.0)) AS st
         FROM br JOIN top ON top.gid = br.gid AND top.basin = br.gid GROUP BY 1
   UNION ALL
   SELECT case_id, k, list_transform(st, lambda s: CASE WHEN s.r <> hi.r AND list_contains(here, s.r)
              AND (s.p < 4.0 OR s.p - h < greatest(1.0, 0.2 * s.p)) THEN struct_pack(b := s.b, r := hi.r, p := -hi.p) ELSE s END)
   FROM (SELECT *, list_transform(m, lambda s: s.r) AS here, list_sort(list_transform(m, lambda s: struct_pack(p := -s.p, r := s.r)))[1] AS hi
         FROM (SELECT w.case_id, q.k, q.h, w.st, list_filter(w.st, lambda s: list_contains(q.b, s.b)) AS m
               FROM walk w JOIN seq q ON q.case_id = w.case_id AND q.k = w.k + 1))),
fin AS (SELECT case_id, unnest(arg_max(st, k)) AS s FROM walk GROUP BY 1)
SELECT br.case_id, s.r AS basin, count(*) AS cells, max(br.hu / 1000000.0) AS peak
FROM br JOIN top USING (gid) JOIN fin ON s.b = top.basin GROUP BY ALL""")
def watershed_basins(spark, sf):
    """Basins of the brightness field of each case after merging the shallow ones."""
    field = bright(spark, sf, 1.1).selectExpr("case_id", "z", "y", "x", "gid", "hu / 1000000D AS height")
    out = split.watershed(field, "height", min_peak=4.0, min_depth=1.0)
    return out.groupBy("case_id", "basin").agg(F.expr("count(1) AS cells"), F.expr("max(height) AS peak"))


@query("split_instances")
def split_instances(spark, sf):
    """Instances that leave the trunk of each case, what they absorbed and what they touch."""
    fl = trunk_flood(spark, sf, 1.1, 60)
    patch = fl.where("dist BETWEEN 1 AND 17").join(voxels(spark, sf).selectExpr("gid", "hu"), "gid").selectExpr(
        "gid", "case_id * 100 + (y div 2) * 10 + x div 2 AS origin", "hu / 5000000D AS peak")
    return split.instances(fl, patch, 24)[0].selectExpr(
        "case_id", "instance_id", "n_cells", "max_distance", "n_absorbed", "cast(size(vessel_join_mm) AS int) AS n_shared")


# --- descent below a settled threshold ----------------------------------------------------------

START, STEP, LOW, CUTS, BONE, PART, SHARE = 1.5, 0.25, 1.0, 2, 1.75, 3, 0.25


def _leak(d: str) -> str:
    early, late = (f"count(*) FILTER (WHERE {d} BETWEEN {a} AND {b})" for a, b in ((10, 19), (40, 59)))
    return f"{late} >= 1.2 * {early} AND {late} > 0"


def _attempt_sql(n: str, cases: str, f: float, cut: str) -> str:
    """Flood ``f{n}`` of the cases at a share without the cut cells, and whether it leaks, ``l{n}``."""
    return f"""
w{n} AS (SELECT gid AS id, 0 AS d FROM vox WHERE in_mask AND case_id IN (SELECT case_id FROM {cases})
   UNION SELECT e.dst, w.d + e.w FROM w{n} w JOIN e ON e.src = w.id WHERE w.d + e.w <= 59 AND e.hu >= {f!r}::DOUBLE * e.ref
     AND e.dst NOT IN (SELECT gid FROM {cut})),
f{n} AS (SELECT case_id, gid, min(d) AS d FROM w{n} JOIN vox ON gid = id GROUP BY ALL),
l{n} AS (SELECT case_id, {_leak('d')} AS leak FROM f{n} GROUP BY 1)"""


def _bone_sql(n: str, good: str) -> str:
    """Bone-like parts ``b{n}`` of what the leaking floods ``f{n}`` reached beyond the last good ones."""
    return f"""
n{n} AS (SELECT v.* FROM f{n} JOIN br v USING (gid) JOIN l{n} ON l{n}.case_id = v.case_id AND leak
         WHERE NOT v.in_mask AND gid NOT IN (SELECT gid FROM {good})),
p{n} AS (SELECT gid * 1000000000 + gid AS code FROM n{n}
   UNION SELECT p.code + (e.dst - e.src) FROM p{n} p JOIN e ON e.src = p.code % 1000000000 WHERE e.dst IN (SELECT gid FROM n{n})),
c{n} AS (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS label FROM p{n} GROUP BY 1),
b{n} AS (SELECT case_id, gid, label FROM c{n} JOIN br USING (gid) WHERE label IN (
   SELECT label FROM c{n} JOIN br USING (gid) GROUP BY 1
   HAVING count(*) >= {PART} AND count(*) FILTER (WHERE hu > {BONE}::DOUBLE * ref) >= {SHARE} * count(*)))"""


def _descent_sql() -> str:
    """Every step and cut written out one after the other; the checking engine has no loop around recursive relations."""
    out = [f"""WITH RECURSIVE {bright_sql(0.0)},
e AS (SELECT a.gid AS src, b.gid AS dst, b.hu, b.ref, CASE o.s WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 17 END AS w
      FROM {near_sql('br', 'br', 'off')} WHERE NOT b.in_mask),
every AS (SELECT DISTINCT case_id FROM vox WHERE in_mask), none AS (SELECT 0::BIGINT AS case_id, 0::BIGINT AS gid, 0::BIGINT AS label WHERE false)""",
           _attempt_sql("0", "every", START, "none"),
           f"""
a1 AS (SELECT case_id FROM l0 WHERE NOT leak),
g0 AS (SELECT f0.* FROM f0 JOIN a1 USING (case_id)), x1 AS (SELECT * FROM none), s0 AS (SELECT case_id, {START}::DOUBLE AS f, 0 AS tries FROM a1)"""]
    f, k = START - STEP, 0
    while f >= LOW - 1e-9:
        k, cases, cut, tries = k + 1, f"a{k + 1}", f"x{k + 1}", []
        for j in range(CUTS + 1):
            n = f"{k}{'abcdef'[j]}"
            out.append(_attempt_sql(n, cases, f, cut))
            tries.append((n, cut, cases))
            if j < CUTS:
                out.append(_bone_sql(n, f"g{k - 1}"))
                out.append(f"""
q{n} AS (SELECT DISTINCT case_id FROM b{n}), y{n} AS (SELECT * FROM {cut} UNION ALL SELECT * FROM b{n})""")
                cases, cut = f"q{n}", f"y{n}"
        passed = " UNION ALL ".join(f"SELECT case_id FROM l{n} WHERE NOT leak" for n, _, _ in tries)
        reach = " UNION ALL ".join(f"SELECT f{n}.* FROM f{n} JOIN l{n} USING (case_id) WHERE NOT leak" for n, _, _ in tries)
        gone = " UNION ALL ".join(f"SELECT c.* FROM {c} c JOIN l{n} USING (case_id) WHERE NOT leak" for n, c, _ in tries)
        count = " + ".join(f"CAST(case_id IN (SELECT case_id FROM {c}) AS INT)" for _, _, c in tries)
        out.append(f"""
a{k + 1} AS ({passed}),
g{k} AS ({reach} UNION ALL SELECT * FROM g{k - 1} WHERE case_id NOT IN (SELECT case_id FROM a{k + 1})),
x{k + 1} AS ({gone} UNION ALL SELECT * FROM x{k} WHERE case_id NOT IN (SELECT case_id FROM a{k + 1})),
s{k} AS (SELECT case_id, CASE WHEN case_id IN (SELECT case_id FROM a{k + 1}) THEN {f!r}::DOUBLE ELSE f END AS f, tries + {count} AS tries FROM s{k - 1})""")
        f -= STEP
    return ",".join(out) + f"""
SELECT case_id, f, CAST(tries AS INT) AS attempts, (SELECT count(*) FROM g{k} WHERE g{k}.case_id = s.case_id AND d > 0) AS reached,
       (SELECT count(*) FROM x{k + 1} c WHERE c.case_id = s.case_id) AS excised,
       (SELECT count(DISTINCT label) FROM x{k + 1} c WHERE c.case_id = s.case_id) AS parts
FROM s{k} s"""


@query("bone_descent", _descent_sql())
def bone_descent(spark, sf):
    """Lowest share that each case's flood reaches without a leak once bone-like parts are cut out, and what that took."""
    vox = written_cells(spark, sf)

    def attempt(wanted, cut):
        here = vox.join(wanted.select("case_id", "f"), "case_id")
        opened = here.where("NOT in_mask AND hu >= f * ref").join(cut.select("gid"), "gid", "left_anti")
        cells = graph.flood(opened, here.where("in_mask"), 59, step_weight, distance="int")
        leak = cells.groupBy("case_id").agg(F.expr("count_if(dist BETWEEN 10 AND 19) AS early"), F.expr(
            "count_if(dist BETWEEN 40 AND 59) AS late")).selectExpr("case_id", "late >= 1.2D * early AND late > 0 AS leak")
        return cells, leak, opened.select("case_id", "gid")

    every = vox.where("in_mask").selectExpr("case_id", f"{BONE}D * ref AS ceiling", f"{START}D AS f").distinct()
    first, leak, opened = attempt(every, every.selectExpr("case_id", "0L AS gid").limit(0))
    settled = every.join(leak.where("NOT leak"), "case_id").drop("leak")
    good, _, state, cut = descent.descend(
        settled, first.join(settled.select("case_id"), "case_id", "left_semi"), opened, vox, attempt, LOW, PART, STEP, CUTS, SHARE)
    reach = good.groupBy("case_id").agg(F.expr("count_if(dist > 0) AS reached"))
    gone = cut.groupBy("case_id").agg(F.expr("count(1) AS excised"), F.expr("count(DISTINCT label) AS parts"))
    return state.join(reach, "case_id").join(gone, "case_id", "left").fillna(0, ["excised", "parts"])


# --- origins on the contact patches -------------------------------------------------------------

PEAK, DEPTH = 14.0, 4.0

# the cell of a patch is numbered label * cells + place; components travel as one number, as in components_sql
PATCH_SQL = f"""
WITH {flood_sql(1.1, 60)},
r AS (SELECT v.* FROM fl JOIN vox v USING (gid) WHERE dist > 0),
re AS (SELECT a.gid AS src, b.gid AS dst FROM {near_sql('r', 'r', 'off')}),
rw AS (SELECT gid * 1000000000 + gid AS code FROM r UNION SELECT rw.code + (re.dst - re.src) FROM rw JOIN re ON re.src = rw.code % 1000000000),
lab AS (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS label FROM rw GROUP BY 1),
shell AS (SELECT DISTINCT a.case_id, a.z + o.dz AS z, a.y + o.dy AS y, a.x + o.dx AS x FROM vox a, off o WHERE a.in_mask
   AND a.z + o.dz BETWEEN 0 AND {NZ - 1} AND a.y + o.dy BETWEEN 0 AND {NY - 1} AND a.x + o.dx BETWEEN 0 AND {NX - 1}
   AND NOT EXISTS (SELECT 1 FROM vox m WHERE m.in_mask AND m.case_id = a.case_id AND m.z = a.z + o.dz AND m.y = a.y + o.dy AND m.x = a.x + o.dx)),
patch AS (SELECT r.case_id, label, r.z, r.y, r.x FROM r JOIN lab USING (gid) JOIN shell s ON s.case_id = r.case_id AND s.z = r.z AND s.y = r.y AND s.x = r.x),
box AS (SELECT case_id, label, {", ".join(f"greatest(min({c}) - 3, 0) AS {c}0, least(max({c}) + 3, {n - 1}) AS {c}1" for c, n in zip("zyx", SHAPE))}
        FROM patch GROUP BY ALL),
crop AS (SELECT b.case_id AS volume, b.label AS case_id, s.z, s.y, s.x, b.label * {CELLS} + (s.z * {NY} + s.y) * {NX} + s.x AS gid,
   s.z IN (z0, z1) OR s.y IN (y0, y1) OR s.x IN (x0, x1) AS edge, p.label IS NOT NULL AS own
   FROM shell s JOIN box b ON b.case_id = s.case_id AND s.z BETWEEN z0 AND z1 AND s.y BETWEEN y0 AND y1 AND s.x BETWEEN x0 AND x1
   LEFT JOIN patch p ON p.label = b.label AND p.z = s.z AND p.y = s.y AND p.x = s.x),
ce AS (SELECT a.gid AS src, b.gid AS dst, CASE o.s WHEN 1 THEN 10 WHEN 2 THEN 14 ELSE 17 END AS w, a.own AS oa, b.own AS ob
       FROM {near_sql('crop', 'crop', 'off')}),
ow AS (SELECT gid * 1000000000 + gid AS code FROM crop WHERE NOT own
   UNION SELECT ow.code + (ce.dst - ce.src) FROM ow JOIN ce ON ce.src = ow.code % 1000000000 AND NOT oa AND NOT ob),
ol AS (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS pocket FROM ow GROUP BY 1),
rim AS (SELECT gid FROM ol WHERE pocket IN (SELECT pocket FROM ol JOIN crop USING (gid) WHERE edge)),
closed AS (SELECT *, NOT own AS filled FROM crop WHERE gid NOT IN (SELECT gid FROM rim)),
hw AS (SELECT gid AS id, 0 AS d FROM rim
   UNION SELECT ce.dst, hw.d + ce.w FROM hw JOIN ce ON ce.src = hw.id WHERE hw.d + ce.w <= 500 AND ce.dst IN (SELECT gid FROM closed)),
hh AS (SELECT id AS gid, min(d) AS d FROM hw GROUP BY 1),
cl AS (SELECT c.*, coalesce(hh.d, 500)::DOUBLE AS h FROM closed c LEFT JOIN hh USING (gid)
       WHERE c.case_id IN (SELECT case_id FROM crop JOIN rim USING (gid))),
pw AS (SELECT gid * 1000000000 + gid AS code FROM cl
   UNION SELECT pw.code + (ce.dst - ce.src) FROM pw JOIN ce ON ce.src = pw.code % 1000000000 WHERE ce.dst IN (SELECT gid FROM cl)),
pc AS (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS piece FROM pw GROUP BY 1),
up AS (SELECT a.gid, arg_max(b.gid, ROW(b.h, -b.gid)) AS parent FROM {near_sql('cl', 'cl', '(SELECT dz, dy, dx FROM off UNION ALL SELECT 0, 0, 0)')} GROUP BY 1),
climb AS (SELECT gid, gid AS cur FROM up UNION ALL SELECT c.gid, up.parent FROM climb c JOIN up ON up.gid = c.cur WHERE up.parent <> c.cur),
top AS (SELECT c.gid, c.cur AS basin FROM climb c JOIN up ON up.gid = c.cur WHERE up.parent = c.cur),
met AS (SELECT a.case_id, a.gid, a.h, list(DISTINCT t.basin) AS b FROM {near_sql('cl', 'cl', 'off')} JOIN top t ON t.gid = b.gid
        WHERE (b.h, -b.gid) > (a.h, -a.gid) GROUP BY ALL HAVING count(DISTINCT t.basin) > 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY h DESC, gid) AS k FROM met),
merge AS (SELECT cl.case_id, 0::BIGINT AS k, list(struct_pack(b := cl.gid, r := cl.gid, p := cl.h)) AS st
         FROM cl JOIN top ON top.gid = cl.gid AND top.basin = cl.gid GROUP BY 1
   UNION ALL
   SELECT case_id, k, list_transform(st, lambda s: CASE WHEN s.r <> hi.r AND list_contains(here, s.r)
              AND (s.p < {PEAK} OR s.p - h < greatest({DEPTH}, 0.2 * s.p)) THEN struct_pack(b := s.b, r := hi.r, p := -hi.p) ELSE s END)
   FROM (SELECT *, list_transform(m, lambda s: s.r) AS here, list_sort(list_transform(m, lambda s: struct_pack(p := -s.p, r := s.r)))[1] AS hi
         FROM (SELECT w.case_id, q.k, q.h, w.st, list_filter(w.st, lambda s: list_contains(q.b, s.b)) AS m
               FROM merge w JOIN seq q ON q.case_id = w.case_id AND q.k = w.k + 1))),
fin AS (SELECT case_id, s.b AS basin, s.r AS origin, s.p AS peak FROM (SELECT case_id, unnest(arg_max(st, k)) AS s FROM merge GROUP BY 1)),
cells AS (SELECT cl.*, fin.origin, fin.peak, pc.piece FROM cl JOIN top USING (gid) JOIN fin USING (basin) JOIN pc USING (gid)),
sad AS (SELECT origin, max(h) AS saddle FROM (
   SELECT a.gid, b.origin, a.h, row_number() OVER (PARTITION BY a.gid ORDER BY max(b.peak) DESC, b.origin) AS k
   FROM {near_sql('cells', 'cells', 'off')} WHERE (b.h, -b.gid) > (a.h, -a.gid) GROUP BY a.gid, b.origin, a.h) WHERE k > 1 GROUP BY 1)
SELECT volume AS case_id, case_id AS label, volume * {CELLS} + origin % {CELLS} AS origin, volume * {CELLS} + piece % {CELLS} AS piece,
       any_value(cells.peak) AS peak, any_value(saddle) AS saddle, count(*) AS cells, count(*) FILTER (WHERE filled) AS filled
FROM cells LEFT JOIN sad USING (origin) GROUP BY ALL
UNION ALL SELECT volume, case_id, volume * {CELLS} + min(gid) % {CELLS}, volume * {CELLS} + min(gid) % {CELLS}, NULL, NULL, count(*), count(*) FILTER (WHERE filled)
FROM closed WHERE case_id NOT IN (SELECT case_id FROM cl) GROUP BY volume, case_id"""


@query("patch_origins", PATCH_SQL)
def patch_origins(spark, sf):
    """Origins of every reached part on its contact patch, with holes filled and heights along the trunk's shell."""
    fl = trunk_flood(spark, sf, 1.1, 60).where("dist > 0").select(*lattice.CELL, "gid")
    parts = graph.label_cells(fl)
    rounds = Rounds(spark, "contact-patches")  # what several parts of the plan name is written
    shell, _ = rounds.save(lattice.rim(voxels(spark, sf).where("in_mask").select(*lattice.CELL), lattice.FULL, SHAPE))
    patch, _ = rounds.save(parts.join(shell, lattice.CELL).select("case_id", "label", "z", "y", "x"))
    cells, origins = split.patch_origins(split.patch_field(patch, shell, SHAPE, step_weight, 500, distance="int"), PEAK, DEPTH)
    place = cells.selectExpr("gid", f"cast(case_id * {CELLS} + (z * {NY} + y) * {NX} + x AS bigint) AS at")
    size = cells.groupBy("origin").agg(F.expr("count(1) AS cells"), F.expr("count_if(filled) AS filled"))
    return (origins.join(size, "origin").join(place.selectExpr("gid AS origin", "at AS o"), "origin")
            .join(place.selectExpr("gid AS piece", "at AS p"), "piece")
            .selectExpr("case_id", "label", "o AS origin", "p AS piece", "peak", "saddle", "cells", "filled"))
