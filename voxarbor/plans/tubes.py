"""Tubular response and end caps of the trunk."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.operators import centerline, graph, lattice, trace, vesselness
from voxarbor.plans.registry import query
from voxarbor.plans.volumes import SHAPE, bright, bright_sql, components_sql, flood_sql, near_sql, trunk_flood, with_reference
from voxarbor.session import Rounds
from voxarbor.sources.tables import voxels

SCALES = (0.8, 1.2)
UNIT = (1.0, 1.0, 1.0)


def _axis_sql(axis: str, source: str, fields: list[tuple], wanted: list[tuple]) -> str:
    """Relations ``s{axis}`` (smoothed fields) and ``d{axis}`` (their differences) after one axis."""
    name = lambda o: "f" + "".join(map(str, o))
    line = " AND ".join(f"b.{c} = a.{c}" for c in ("case_id", "z", "y", "x") if c != axis)
    scale = "a.k = b.k AND " if axis != "x" else ""
    weight = f"exp(-0.5::DOUBLE * pow((a.{axis} - b.{axis}) / sigma, 2))"
    smooth = ", ".join(f"sum(b.{name(o)} * {weight}) / sum({weight}) AS {name(o)}" for o in fields)
    diff = {0: "c.{0}", 1: "(coalesce(n.{0}, c.{0}) - coalesce(p.{0}, c.{0})) / 2", 2: "coalesce(n.{0}, c.{0}) - 2 * c.{0} + coalesce(p.{0}, c.{0})"}
    made = ", ".join(f"{diff[o[-1]].format(name(o[:-1]))} AS {name(o)}" for o in wanted)
    beside = lambda t, d: (f"LEFT JOIN s{axis} {t} ON {t}.k = c.k AND {t}.{axis} = c.{axis} + {d} AND "
                           + " AND ".join(f"{t}.{c} = c.{c}" for c in ("case_id", "z", "y", "x") if c != axis))
    return f"""
s{axis} AS (SELECT a.case_id, a.z, a.y, a.x, sg.k, {smooth} FROM {source} a JOIN {source} b ON {scale}{line}
   JOIN sg ON {"true" if axis == "x" else "sg.k = a.k"} WHERE abs(a.{axis} - b.{axis}) <= floor(4 * sigma + 0.5) GROUP BY ALL),
d{axis} AS (SELECT c.case_id, c.z, c.y, c.x, c.k, {made} FROM s{axis} c {beside("n", 1)} {beside("p", -1)})"""


@query("tubular_response", f"""
WITH {bright_sql(0.0)},
sg AS (SELECT * FROM (VALUES {", ".join(f"({k}, {s!r}::DOUBLE)" for k, s in enumerate(SCALES))}) t(k, sigma)),
v AS (SELECT case_id, z, y, x, greatest(-0.2::DOUBLE, least(1::DOUBLE, hu / greatest(1.5 * ref, 1::DOUBLE))) AS f FROM br),
{_axis_sql("x", "v", [()], vesselness.AFTER["x"])},{_axis_sql("y", "dx", vesselness.AFTER["x"], vesselness.AFTER["y"])},{
_axis_sql("z", "dy", vesselness.AFTER["y"], vesselness.AFTER["z"])},
h AS (SELECT case_id, z, y, x, sigma, f002 AS zz, f011 AS zy, f020 AS yy, f101 AS zx, f110 AS yx, f200 AS xx,
      (f002 + f020 + f200) / 3 AS q, f011 * f011 + f101 * f101 + f110 * f110 AS off FROM dz JOIN sg USING (k)),
p AS (SELECT *, sqrt(((zz - q) * (zz - q) + (yy - q) * (yy - q) + (xx - q) * (xx - q) + 2 * off) / 6) AS p FROM h),
t AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - zy * zy)
      - yx * (yx * (zz - q) - zy * zx) + zx * (yx * zy - (yy - q) * zx)) / (2 * p * p * p)))) / 3 ELSE 0 END AS phi FROM p),
e AS (SELECT *, list_sort(list_transform([q + 2 * p * cos(phi), q + 2 * p * cos(phi + 2 * pi() / 3), q + 2 * p * cos(phi - 2 * pi() / 3)],
      lambda i: struct_pack(m := abs(i), e := i))) AS s FROM t),
r AS (SELECT case_id, z, y, x, sigma, CASE WHEN s[2].e < 0 AND s[3].e < 0 THEN
      (1 - exp(-2 * pow(s[2].m / s[3].m, 2))) * exp(-2 * s[1].m * s[1].m / (s[2].m * s[3].m))
      * (1 - exp(-0.02 * (s[1].m * s[1].m + s[2].m * s[2].m + s[3].m * s[3].m))) * s[3].m * sigma * sigma ELSE 0 END AS v FROM e),
b AS (SELECT case_id, z, y, x, max(v) AS v, arg_min(sigma, struct_pack(v := -v, sigma := sigma)) AS sigma FROM r GROUP BY ALL)
SELECT case_id, z, y, x, round(v, 7) AS response, CASE WHEN round(v, 7) > 0 THEN sigma ELSE 0 END AS sigma FROM b""")
def tubular_response(spark, sf):
    """Best tubular response of every cell over two scales, relative to one and a half times the trunk's brightness."""
    out = vesselness.vesselness(with_reference(voxels(spark, sf)).selectExpr(*lattice.CELL, "hu", "1.5D * ref AS ref"), UNIT, "ref", sigmas=SCALES)
    return out.selectExpr(*lattice.CELL, "round(response, 7) AS response", "CASE WHEN round(response, 7) > 0 THEN sigma ELSE 0D END AS sigma")


# --- end caps -----------------------------------------------------------------------------------

def _ends_sql(cells: str, inward: int) -> str:
    """End faces of the parts of a relation ``case_id, label, z``: ``per``, ``ends`` and ``radii``."""
    return f"""
per AS (SELECT case_id, label, z, sqrt(count(*) / pi()) AS r FROM {cells} GROUP BY ALL),
span AS (SELECT case_id, label, min(z) AS z0, max(z) AS z1 FROM per GROUP BY ALL),
lo AS (SELECT case_id, label, 'low' AS side, z0 AS a, least(z0 + 1, z1) AS b, least(z0 + 2, z1) AS i0, z1 FROM span),
hi AS (SELECT case_id, label, 'high' AS side, greatest(z1 - 1, z0) AS a, z1 AS b, greatest(greatest(z1 - 1, z0) - 1, z0) AS i1, z0 FROM span),
ends AS (SELECT case_id, label, side, a, b, i0, least(i0 + {inward} - 1, z1) AS i1 FROM lo
   UNION ALL SELECT case_id, label, side, a, b, least(i1, greatest(i1 - {inward} + 1, z0)), i1 FROM hi),
radii AS (SELECT case_id, label, side, a, b, avg(r) FILTER (WHERE z BETWEEN a AND b) AS end_radius, avg(r) FILTER (WHERE z BETWEEN i0 AND i1) AS local_radius
          FROM ends JOIN per USING (case_id, label) GROUP BY ALL)"""


def _caps(trunk, inward: float):
    """End caps of a trunk at unit spacing; its line runs through the middles of the slices."""
    o = "OVER (PARTITION BY case_id, label ORDER BY z)"
    mid = trunk.groupBy("case_id", "label", "z").agg(F.expr("avg(y) AS y"), F.expr("avg(x) AS x"))
    way = mid.selectExpr("case_id", "label", "z", *[f"cast(coalesce(lead({c}) {o}, {c}) - coalesce(lag({c}) {o}, {c}) AS double) AS d{c}" for c in "xyz"])
    norm = "sqrt(dx*dx + dy*dy + dz*dz)"
    line = way.selectExpr("case_id", "label", "z AS seq", *[f"CASE WHEN {norm} > 0 THEN d{c} / {norm} ELSE 0D END AS t{c}" for c in "xyz"])
    wall = lattice.outward_normals(trunk).join(trunk.select(*lattice.CELL, "gid"), lattice.CELL).selectExpr(
        "case_id", "gid AS id", *[f"cast({c} AS double) AS {c}" for c in "xyz"], "nx", "ny", "nz")
    cells = trunk.selectExpr("case_id", "label", "z", "gid", *[f"cast({c} AS double) AS p{c}" for c in "xyz"])
    return centerline.end_caps(cells, wall, line, 1.0, 1.0, 2.0, inward)


@query("trunk_end_caps", f"""
WITH {components_sql(1.0, 3)},
sz AS (SELECT case_id, label, count(*) AS size FROM cc JOIN br USING (gid) GROUP BY ALL),
tr AS (SELECT br.*, label FROM br JOIN cc USING (gid) JOIN sz USING (case_id, label) JOIN (SELECT case_id, max(size) AS top FROM sz GROUP BY 1) USING (case_id)
       WHERE size >= 0.01 * top),{_ends_sql("tr", 3)},
nb AS (SELECT a.gid, count(*) FILTER (WHERE o.s = 1) AS faces, sum(-o.dz) AS sz, sum(-o.dy) AS sy, sum(-o.dx) AS sx FROM {near_sql('tr', 'tr', 'off')} GROUP BY 1),
q AS (SELECT tr.case_id, tr.gid, z, y, x, coalesce(sz, 0)::DOUBLE AS sz, coalesce(sy, 0)::DOUBLE AS sy, coalesce(sx, 0)::DOUBLE AS sx
      FROM tr LEFT JOIN nb USING (gid) WHERE coalesce(faces, 0) < 6),
wall AS (SELECT *, sqrt(sz * sz + sy * sy + sx * sx) AS len FROM q),
face AS (SELECT r.case_id, r.label, side, tr.gid, tr.z, tr.y, tr.x FROM radii r JOIN tr ON tr.case_id = r.case_id AND tr.label = r.label AND tr.z BETWEEN a AND b),
nn AS (SELECT f.case_id, f.label, side, arg_min(struct_pack(z := CASE WHEN len > 0 THEN sz / len ELSE 0 END, y := CASE WHEN len > 0 THEN sy / len ELSE 0 END,
       x := CASE WHEN len > 0 THEN sx / len ELSE 0 END),
       ROW((f.z - w.z) ** 2 + (f.y - w.y) ** 2 + (f.x - w.x) ** 2, w.gid)) AS n FROM face f JOIN wall w USING (case_id) GROUP BY f.case_id, f.label, side, f.gid),
nm AS (SELECT case_id, label, side, avg(n.z) AS nz, avg(n.y) AS ny, avg(n.x) AS nx FROM nn GROUP BY ALL),
mid AS (SELECT case_id, label, z, avg(y) AS y, avg(x) AS x FROM tr GROUP BY ALL),
way AS (SELECT case_id, label, z, {", ".join(f"coalesce(lead({c}) OVER w, {c}) - coalesce(lag({c}) OVER w, {c}) AS d{c}" for c in "zyx")}
        FROM mid WINDOW w AS (PARTITION BY case_id, label ORDER BY z)),
tip AS (SELECT way.case_id, way.label, side, dz, dy, dx, sqrt(dz * dz + dy * dy + dx * dx) AS dn FROM way JOIN radii r
        ON r.case_id = way.case_id AND r.label = way.label AND way.z = CASE side WHEN 'low' THEN a ELSE b END),
ang AS (SELECT case_id, label, side, degrees(acos(least(1, abs(nz * dz + ny * dy + nx * dx) / (sqrt(nz * nz + ny * ny + nx * nx) * dn)))) AS angle
        FROM nm JOIN tip USING (case_id, label, side) WHERE sqrt(nz * nz + ny * ny + nx * nx) > 0 AND dn > 0)
SELECT case_id, label, side, CAST(a AS INT) AS z_from, CAST(b AS INT) AS z_to, round(end_radius, 6) AS end_radius, round(local_radius, 6) AS local_radius,
       round(end_radius / local_radius, 6) AS ratio, round(angle, 3) AS angle,
       end_radius / local_radius > 0.4 AND coalesce(round(angle, 3) <= 25, false) AS flagged
FROM radii LEFT JOIN ang USING (case_id, label, side)""")
def trunk_end_caps(spark, sf):
    """Both end faces of every kept part of the bright cells: radii, tilt against the line, and whether the part goes on there."""
    lit = bright(spark, sf, 1.0).select(*lattice.CELL, "gid")
    trunk, _ = Rounds(spark, "trunk").save(centerline.trunk_parts(lit, 1.0).where("kept").select(*lattice.CELL, "gid", "label"))
    out = _caps(trunk, 3.0)
    return out.selectExpr("case_id", "label", "side", "z_from", "z_to", *[f"round({c}, 6) AS {c}" for c in ("end_radius", "local_radius", "ratio")],
                          "round(angle, 3) AS angle", "ratio > 0.4D AND coalesce(round(angle, 3) <= 25, false) AS flagged")


NECK, LENGTH, WINDOW, STEP = 10, 40, 20, 5
SPOTS = range(NECK + WINDOW // 2, LENGTH + 1, STEP)


@query("cap_contacts", f"""
WITH {flood_sql(1.1, 60)},
m AS (SELECT * FROM vox WHERE in_mask),
me AS (SELECT a.gid AS src, b.gid AS dst FROM {near_sql('m', 'm', 'off')}),
mw AS (SELECT gid * 1000000000 + gid AS code FROM m UNION SELECT mw.code + (me.dst - me.src) FROM mw JOIN me ON me.src = mw.code % 1000000000),
mc AS (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS label FROM mw GROUP BY 1),
ms AS (SELECT case_id, label, count(*) AS size FROM mc JOIN m USING (gid) GROUP BY ALL),
tr AS (SELECT m.*, label FROM m JOIN mc USING (gid) JOIN ms USING (case_id, label) JOIN (SELECT case_id, max(size) AS top FROM ms GROUP BY 1) USING (case_id)
       WHERE size >= 0.01 * top),{_ends_sql("tr", 2)},
r AS (SELECT v.*, dist FROM fl JOIN vox v USING (gid) WHERE dist > 0),
re AS (SELECT a.gid AS src, b.gid AS dst FROM {near_sql('r', 'r', 'off')}),
rw AS (SELECT gid * 1000000000 + gid AS code FROM r UNION SELECT rw.code + (re.dst - re.src) FROM rw JOIN re ON re.src = rw.code % 1000000000),
part AS (SELECT r.*, label FROM (SELECT code % 1000000000 AS gid, min(code // 1000000000) AS label FROM rw GROUP BY 1) JOIN r USING (gid)),
patch AS (SELECT DISTINCT p.case_id, p.label, p.z, p.y, p.x FROM part p JOIN m ON m.case_id = p.case_id AND greatest(abs(m.z - p.z), abs(m.y - p.y), abs(m.x - p.x)) = 1),
cap AS (SELECT row_number() OVER (ORDER BY case_id, label, CASE side WHEN 'low' THEN 0 ELSE 1 END) AS c, * FROM radii),
hit AS (SELECT DISTINCT p.case_id, p.label, p.z, p.y, p.x, c FROM patch p JOIN cap ON cap.case_id = p.case_id JOIN tr ON tr.case_id = p.case_id
        AND tr.label = cap.label AND tr.z BETWEEN a AND b AND (tr.z - p.z) ** 2 + (tr.y - p.y) ** 2 + (tr.x - p.x) ** 2 <= 4),
best AS (SELECT case_id, label, arg_min(c, ROW(-k, c)) AS c, max(k) AS k FROM (SELECT case_id, label, c, count(*) AS k FROM hit GROUP BY ALL) GROUP BY ALL),
con AS (SELECT p.case_id, p.label, cap.label AS trunk, side, local_radius, k / count(*) AS touched,
        count(*) FILTER (WHERE CASE side WHEN 'low' THEN p.z < a ELSE p.z > b END) / count(*) AS face
        FROM patch p JOIN best USING (case_id, label) JOIN cap USING (c) GROUP BY p.case_id, p.label, cap.label, side, local_radius, k),
far AS (SELECT label, max(dist) AS far FROM part GROUP BY 1),
slab AS (SELECT part.label, s, sqrt(count(*) FILTER (WHERE dist >= s - {WINDOW // 2} AND dist < s + {WINDOW // 2} AND dist > {NECK}) / ({WINDOW} * pi())) AS r
         FROM part JOIN far USING (label), (SELECT unnest([{", ".join(map(str, SPOTS))}]) AS s) WHERE s <= far - {WINDOW // 2} GROUP BY ALL),
short AS (SELECT label, sqrt(count(*) FILTER (WHERE dist < far) / ((far - {NECK}) * pi())) AS r FROM part JOIN far USING (label)
          WHERE dist > {NECK} AND label NOT IN (SELECT label FROM slab) GROUP BY label, far),
rad AS (SELECT label, median(r) AS radius FROM slab GROUP BY 1 UNION ALL SELECT label, r FROM short)
SELECT case_id, con.label, trunk, side, round(touched, 6) AS touched, round(face, 6) AS face, round(local_radius, 6) AS local_radius, round(radius, 6) AS radius,
       round(radius / local_radius, 6) AS ratio FROM con LEFT JOIN rad ON rad.label = con.label""")
def cap_contacts(spark, sf):
    """Which end of the trunk the patch of every reached part touches, how much of it lies beyond, and how wide the part is beside the trunk."""
    rounds = Rounds(spark, "cap-contacts")  # what several parts of the plan name is written
    mask, _ = rounds.save(voxels(spark, sf).where("in_mask").select(*lattice.CELL, "gid"))
    trunk, _ = rounds.save(centerline.trunk_parts(mask, 1.0).where("kept").select(*lattice.CELL, "gid", "label"))
    caps = _caps(trunk, 2.0)
    parts = graph.label_cells(trunk_flood(spark, sf, 1.1, 60).where("dist > 0").select(*lattice.CELL, "gid", "dist"))
    shell = lattice.rim(mask.select(*lattice.CELL), lattice.FULL, SHAPE)
    patch, _ = rounds.save(parts.join(shell, lattice.CELL).selectExpr("case_id", "label AS id", "z", "y", "x"))
    wide = trace.first_radius(parts, NECK, LENGTH, 1.0, WINDOW, STEP)
    hit = centerline.cap_contact(patch, centerline.cap_cells(trunk, caps, 2.0, UNIT), caps)
    return hit.withColumnRenamed("label", "trunk").join(wide.withColumnRenamed("label", "id"), "id", "left").selectExpr(
        "case_id", "id AS label", "trunk", "side", *[f"round({c}, 6) AS {c}" for c in ("touched", "face", "local_radius", "radius")],
        "round(radius / local_radius, 6) AS ratio")
