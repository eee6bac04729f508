"""Trunk geometry: components, centreline, end caps and lookups against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.operators import graph, lattice, nearest, trace
from voxarbor.session import Rounds

# Fixed values of the end caps.
CAP_RATIO, CAP_ANGLE, CAP_INWARD = 0.4, 25.0, 8.0
MIN_SHARE = 0.01


def trunk_parts(mask: DataFrame, volume: float, share: float = MIN_SHARE) -> DataFrame:
    """Mask cells with ``label, volume, kept``: a part is kept from a share of the largest of its case on."""
    lab = graph.label_cells(mask)
    size = lab.groupBy("case_id", "label").agg(F.expr(f"count(1) * {volume}D AS volume"))
    top = size.groupBy("case_id").agg(F.expr("max(volume) AS top"))
    return lab.join(size.join(top, "case_id").selectExpr("case_id", "label", "volume", f"volume >= {share}D * top AS kept"),
                    ["case_id", "label"])


def binned_centroids(cells: DataFrame, width: float) -> DataFrame:
    """Centroids of bins along the main axis of each part: ``case_id, label, seq, x, y, z, n``.

    ``cells``: ``case_id, label, x, y, z`` in millimetres. The last bin includes its upper edge.
    """
    keys = ["case_id", "label"]
    axis = trace.principal_axis(cells, keys)
    along = cells.join(axis, keys).selectExpr(*keys, "x", "y", "z", "(x - mx) * ax + (y - my) * ay + (z - mz) * az AS t")
    span = along.groupBy(*keys).agg(F.expr("min(t) AS t0"), F.expr("max(t) AS t1")).selectExpr(
        "*", f"greatest(2, cast(bround((t1 - t0) / {width}D) AS int) + 1) AS bins")
    put = along.join(span, keys).selectExpr("*", "cast(least(bins - 1, CASE WHEN t1 > t0 THEN floor((t - t0) / ((t1 - t0) / bins)) ELSE 0 END) AS int) AS bin")
    mid = put.groupBy(*keys, "bin").agg(*[F.expr(f"avg({c}) AS {c}") for c in "xyzt"], F.expr("count(1) AS n"))
    return mid.selectExpr(*keys, "cast(row_number() OVER (PARTITION BY case_id, label ORDER BY t) - 1 AS int) AS seq", "x", "y", "z", "n")


def _smooth_line(pdf):
    """Smoothest line whose squared residual stays below the number of points (second-difference penalty)."""
    import numpy as np

    pdf = pdf.sort_values("seq")
    pts = pdf[["x", "y", "z"]].to_numpy(float)
    n = len(pts)
    if n >= 4:
        rough = np.diff(np.eye(n), 2, axis=0)
        value, vec = np.linalg.eigh(rough.T @ rough)
        part = vec.T @ pts
        fit = lambda lam: part / (1 + lam * np.clip(value, 0, None))[:, None]
        lo, hi = -6.0, 9.0
        for _ in range(60):
            mid = (lo + hi) / 2
            if ((part - fit(10.0 ** mid)) ** 2).sum() <= n:
                lo = mid
            else:
                hi = mid
        pts = vec @ fit(10.0 ** lo)
    pdf[["x", "y", "z"]] = pts
    return pdf[["case_id", "label", "seq", "x", "y", "z"]]


def centreline(cells: DataFrame, width: float) -> DataFrame:
    """Smoothed centre line with unit tangents: ``case_id, label, seq, x, y, z, tx, ty, tz``.

    A part has one row per bin of its length by then, which is what the smoothing sees.
    """
    mid = binned_centroids(cells, width)
    kinds = dict(mid.dtypes)
    line = mid.drop("n").groupBy("case_id", "label").applyInPandas(
        _smooth_line, f"case_id {kinds['case_id']}, label {kinds['label']}, seq int, x double, y double, z double")
    o = "OVER (PARTITION BY case_id, label ORDER BY seq)"
    ends = line.selectExpr("*", *[f"coalesce(lead({c}) {o}, {c}) - coalesce(lag({c}) {o}, {c}) AS d{c}" for c in "xyz"])
    norm = "sqrt(dx*dx + dy*dy + dz*dz)"
    return ends.selectExpr("case_id", "label", "seq", "x", "y", "z",
                           *[f"CASE WHEN {norm} > 0 THEN d{c} / {norm} ELSE 0D END AS t{c}" for c in "xyz"])


def line_lengths(line: DataFrame) -> DataFrame:
    """Centreline length per case over all its parts: ``case_id, length``."""
    o = "OVER (PARTITION BY case_id, label ORDER BY seq)"
    step = "sqrt(" + " + ".join(f"power({c} - lag({c}) {o}, 2)" for c in "xyz") + ")"
    return line.selectExpr("case_id", f"coalesce({step}, 0D) AS step").groupBy("case_id").agg(F.expr("sum(step) AS length"))


def on_centreline(points: DataFrame, line: DataFrame, size: float) -> DataFrame:
    """Nearest centreline row of each point: ``case_id, id, tx, ty, tz, position`` (0..1 along its part)."""
    o = "OVER (PARTITION BY case_id, label ORDER BY seq)"
    step = "sqrt(" + " + ".join(f"power({c} - lag({c}) {o}, 2)" for c in "xyz") + ")"
    arc = line.selectExpr("*", f"coalesce({step}, 0D) AS step").selectExpr(
        "*", f"sum(step) {o} AS arc", "sum(step) OVER (PARTITION BY case_id, label) AS total")
    arc = arc.selectExpr("*", "row_number() OVER (PARTITION BY case_id ORDER BY label, seq) AS rid")
    hit = nearest.nearest(points, arc.selectExpr("case_id", "rid AS id", "x", "y", "z"), ["case_id"], size)
    return hit.join(arc.selectExpr("case_id", "rid AS nn", "tx", "ty", "tz", "CASE WHEN total > 0 THEN arc / total ELSE 0.5D END AS position"),
                    ["case_id", "nn"], "left").selectExpr("case_id", "id", "tx", "ty", "tz", "coalesce(position, 0.5D) AS position")


def end_caps(cells: DataFrame, surface: DataFrame, line: DataFrame, area: float, thickness: float,
             size: float, inward: float = CAP_INWARD, slices: int = 2) -> DataFrame:
    """Both end faces of every kept part, at most two rows per part.

    ``cells``: ``case_id, label, z, gid`` and millimetres ``px, py, pz``; ``surface``: ``case_id, id, x, y, z`` with unit
    normals ``nx, ny, nz``; ``line``: the centreline. The end radius is the mean over the outermost slices, the
    local radius the mean over ``inward`` mm next to them. A cap at nearly full caliber that is cut squarely
    across is flagged: the trunk probably goes on behind it. Caps and what they are made of are written: each of them
    is named several times, and plans would multiply.
    """
    rounds = Rounds(cells.sparkSession, "end-caps")
    cells, _ = rounds.save(cells)
    surface, _ = rounds.save(surface)
    per = cells.groupBy("case_id", "label", "z").agg(F.expr(f"sqrt(count(1) * {area}D / pi()) AS r"))
    span = per.groupBy("case_id", "label").agg(F.expr("min(z) AS z0"), F.expr("max(z) AS z1"))
    n = max(1, round(inward / thickness))
    low = f"struct('low' AS side, z0 AS a, least(z0 + {slices}, z1 + 1) AS b, least(z0 + {slices}, z1 + 1, z1) AS c)"
    high = f"struct('high' AS side, greatest(z1 - {slices - 1}, z0) AS a, z1 + 1 AS b, greatest(z1 - {slices - 1}, z0 + 1) AS c)"
    ends = span.selectExpr("case_id", "label", "z0", "z1", f"inline(array({low}, {high}))").selectExpr(
        "case_id", "label", "side", "a", "b", f"CASE WHEN side = 'low' THEN c ELSE greatest(c - {n}, z0) END AS i0",
        f"CASE WHEN side = 'low' THEN greatest(least(c + {n}, z1 + 1), c + 1) ELSE greatest(c, greatest(c - {n}, z0) + 1) END AS i1")
    keys = ["case_id", "label", "side"]
    radii, _ = rounds.save(ends.join(per, ["case_id", "label"]).groupBy(*keys, "a", "b").agg(
        F.expr("avg(CASE WHEN z >= a AND z < b THEN r END) AS end_radius"),
        F.expr("avg(CASE WHEN z >= i0 AND z < i1 THEN r END) AS local_radius")))
    faces, _ = rounds.save(cells.join(radii.select(*keys, "a", "b"), ["case_id", "label"]).where("z >= a AND z < b").selectExpr(
        *keys, "gid AS id", "px AS x", "py AS y", "pz AS z"))
    hit = nearest.nearest(faces, surface.select("case_id", "id", "x", "y", "z"), ["case_id"], size)
    mean = hit.join(surface.selectExpr("case_id", "id AS nn", "nx", "ny", "nz"), ["case_id", "nn"]).groupBy(*keys).agg(
        *[F.expr(f"avg(n{c}) AS n{c}") for c in "xyz"])
    tips = line.groupBy("case_id", "label").agg(F.expr("min_by(struct(tx, ty, tz), seq) AS low"), F.expr("max_by(struct(tx, ty, tz), seq) AS high"))
    tips = tips.selectExpr("case_id", "label", "inline(array(struct('low' AS side, low AS t), struct('high' AS side, high AS t)))")
    norm = "sqrt(nx*nx + ny*ny + nz*nz) * sqrt(t.tx*t.tx + t.ty*t.ty + t.tz*t.tz)"
    tilt = mean.join(tips, keys).selectExpr(*keys, f"CASE WHEN {norm} > 0 THEN degrees(acos(least(1D, abs("
                                            f"nx * t.tx + ny * t.ty + nz * t.tz) / ({norm})))) END AS angle")
    ratio = "CASE WHEN local_radius > 0 THEN end_radius / local_radius ELSE 0D END"
    caps, _ = rounds.save(radii.join(tilt, keys, "left").selectExpr(
        *keys, "a AS z_from", "b - 1 AS z_to", "end_radius", "local_radius", f"{ratio} AS ratio", "angle",
        f"{ratio} > {CAP_RATIO}D AND coalesce(angle <= {CAP_ANGLE}D, false) AS flagged"))
    for table in (cells, surface, radii, faces):
        rounds.retire(table)
    return caps


def cap_cells(cells: DataFrame, caps: DataFrame, reach: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Cells of every cap grown by ``reach`` mm: ``case_id, label, side, z, y, x``."""
    own = cells.join(caps.select("case_id", "label", "side", "z_from", "z_to"), ["case_id", "label"]).where(
        "z BETWEEN z_from AND z_to").selectExpr("struct(case_id, label, side) AS case_id", "z", "y", "x")
    return lattice.dilate(own, lattice.ball(reach, spacing)).selectExpr("case_id.*", "z", "y", "x")


def cap_contact(patch: DataFrame, grown: DataFrame, caps: DataFrame) -> DataFrame:
    """Cap that holds most of each patch: ``case_id, id, label, side, touched, face, local_radius``; the first cap wins a tie.

    ``patch``: ``case_id, id, z, y, x``; ``touched`` is the share of the patch in the grown cap, ``face`` the share that
    lies beyond the trunk's last slice on that side. A patch away from every cap has no row.
    """
    keys = ["case_id", "id"]
    hit = patch.join(grown, lattice.CELL).groupBy(*keys, "label", "side").agg(F.expr("count(1) AS k"))
    best = hit.groupBy(*keys).agg(F.expr("min_by(struct(label, side, k), struct(-k, label, CASE side WHEN 'low' THEN 0 ELSE 1 END)) AS m"))
    known = best.selectExpr(*keys, "m.label AS label", "m.side AS side", "m.k AS k").join(
        caps.select("case_id", "label", "side", "z_from", "z_to", "local_radius"), ["case_id", "label", "side"])
    facing = patch.select(*keys, "z").join(known, keys).groupBy(*keys, "label", "side", "k", "local_radius").agg(
        F.expr("count(1) AS n"), F.expr("count_if(CASE side WHEN 'low' THEN z < z_from ELSE z > z_to END) AS beyond"))
    return facing.selectExpr(*keys, "label", "side", "k / cast(n AS double) AS touched", "beyond / cast(n AS double) AS face", "local_radius")
