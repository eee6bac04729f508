"""Cross-sections: sampling planes through a volume and measuring the blob at their centre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.functions.scalar import perpendicular_pair, physical_to_index
from voxarbor.operators import graph, sampling
from voxarbor.operators.quantiles import axis_ratio


def plane_points(stations: DataFrame, extent: float, step: float) -> DataFrame:
    """Square sample grid normal to a direction.

    ``stations``: ``case_id, plane_id, x, y, z, dx, dy, dz`` and the grid struct ``grid``. Returns index
    positions ``pz, py, px`` with the in-plane row and column ``i, j`` and offsets ``u, v``.
    """
    n = int(extent / step + 1e-9)
    u, v = perpendicular_pair([F.col(f"d{c}") for c in "xyz"])
    base = stations.select("case_id", "plane_id", "x", "y", "z", "grid", F.array(*u).alias("a"), F.array(*v).alias("b"))
    grid = base.selectExpr("*", f"explode(sequence({-n}, {n})) AS i").selectExpr("*", f"explode(sequence({-n}, {n})) AS j")
    at = grid.selectExpr("*", f"i * {step}D AS u", f"j * {step}D AS v").selectExpr(
        "*", *[f"{c} + u * a[{k}] + v * b[{k}] AS q{c}" for k, c in enumerate("xyz")])
    index = physical_to_index([F.col(f"q{c}") for c in "xyz"], F.col("grid.spacing"), F.col("grid.origin"), F.col("grid.direction"))
    return at.select("case_id", "plane_id", "i", "j", "u", "v",
                     F.expr(f"plane_id * {(2 * n + 1) ** 2} + (i + {n}) * {2 * n + 1} + (j + {n})").alias("id"),
                     *[c.alias(f"p{a}") for c, a in zip(index, "xyz")])


def central_blobs(points: DataFrame, vox: DataFrame) -> DataFrame:
    """Samples of the lumen blob at the plane centre: ``plane_id, i, j, u, v, hu``.

    ``vox``: ``case_id, z, y, x, hu, lumen`` (lumen outside the trunk). Without lumen at the centre the nearest
    blob counts, the first in row order on a tie.
    """
    inside = sampling.nearest_cell(points, vox.where("lumen"), "1D").where("sample > 0").drop("sample")
    hu = sampling.trilinear(inside, vox, "cast(hu AS double)", -1e4).withColumnRenamed("sample", "hu")
    flat = hu.selectExpr("plane_id AS case_id", "0 AS z", "i AS y", "j AS x", "id AS gid", "u", "v", "hu")
    lab = graph.label_cells(flat, graph.FACE_FORWARD)
    pick = lab.groupBy("case_id").agg(F.expr("min_by(label, struct(y * y + x * x AS d, y, x)) AS label"))
    return lab.join(pick, ["case_id", "label"]).selectExpr("case_id AS plane_id", "y AS i", "x AS j", "u", "v", "hu")


def recentre(stations: DataFrame, vox: DataFrame, extent: float = 5.0, step: float = 0.25) -> DataFrame:
    """Intensity-weighted centre and area of the blob of each plane: ``plane_id, cx, cy, cz, area, found``.

    ``stations`` also carries ``threshold`` and ``ceiling``; weights are clipped at the ceiling, and a blob
    without weight uses the plain mean.
    """
    blob = central_blobs(plane_points(stations, extent, step), vox)
    lim = stations.selectExpr("plane_id", "threshold", "ceiling")
    w = blob.join(lim, "plane_id").selectExpr(
        "plane_id", "u", "v", "greatest(0D, least(hu - threshold, greatest(ceiling - threshold, 1D))) AS w")
    mid = w.groupBy("plane_id").agg(*[F.expr(
        f"CASE WHEN sum(w) > 0 THEN sum(w * {c}) / sum(w) ELSE avg({c}) END AS m{c}") for c in "uv"],
        F.expr(f"count(1) * {step * step}D AS area"))
    a, b = perpendicular_pair([F.col(f"d{c}") for c in "xyz"])
    frame = stations.select("plane_id", "x", "y", "z", F.array(*a).alias("a"), F.array(*b).alias("b"))
    return frame.join(mid, "plane_id", "left").selectExpr(
        "plane_id", *[f"{c} + coalesce(mu * a[{k}] + mv * b[{k}], 0D) AS c{c}" for k, c in enumerate("xyz")],
        "coalesce(area, 0D) AS area", "area IS NOT NULL AS found")


def flatness(stations: DataFrame, vox: DataFrame, extent: float = 5.0, step: float = 0.4) -> DataFrame:
    """Major over minor semi-axis of the blob of each plane, 1 for an empty or tiny one: ``plane_id, flatness``."""
    blob = central_blobs(plane_points(stations, extent, step), vox)
    ratio = blob.groupBy("plane_id").agg(axis_ratio("u", "v").alias("flatness"))
    return stations.select("plane_id").join(ratio, "plane_id", "left").selectExpr("plane_id", "coalesce(flatness, 1D) AS flatness")
