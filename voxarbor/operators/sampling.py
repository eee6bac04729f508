"""Sampling a voxel relation at arbitrary index positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trilinear(points: DataFrame, vox: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Linear sample at ``case_id, id, pz, py, px`` (index units): points with ``sample``.

    The eight corners of a point are looked up by cell; a missing corner counts as ``fill``.
    """
    corners = points.selectExpr("*", "explode(sequence(0, 7)) AS k").selectExpr(
        "case_id", "id",
        *[f"cast(floor(p{a}) AS int) + cast(k div {d} % 2 AS int) AS {a}" for a, d in (("z", 4), ("y", 2), ("x", 1))],
        " * ".join(f"abs(1 - cast(k div {d} % 2 AS int) - (p{a} - floor(p{a})))" for a, d in
                   (("z", 4), ("y", 2), ("x", 1))) + " AS w")
    cells = vox.select("case_id", "z", "y", "x", F.expr(value).alias("v"))
    got = corners.where("w > 0").join(cells, ["case_id", "z", "y", "x"], "left")
    total = got.groupBy("case_id", "id").agg(F.expr(f"sum(w * coalesce(v, {fill}D)) AS sample"))
    return points.join(total, ["case_id", "id"])


def nearest_cell(points: DataFrame, vox: DataFrame, value: str, fill: float = 0.0) -> DataFrame:
    """Value of the cell a point rounds to, ``fill`` outside."""
    cells = vox.select("case_id", "z", "y", "x", F.expr(value).alias("sample"))
    at = points.selectExpr("*", *[f"cast(floor(p{a} + 0.5D) AS int) AS {a}" for a in "zyx"])
    out = at.join(cells, ["case_id", "z", "y", "x"], "left")
    return out.selectExpr(*points.columns, f"coalesce(sample, {fill}D) AS sample")


def resampled_shape(shape: tuple[int, int, int], spacing: tuple[float, float, float],
                    target: float) -> tuple[int, int, int]:
    """Size of the new grid, (z, y, x); spacing is (x, y, z). Halves round to even."""
    return tuple(max(1, round(n * s / target)) for n, s in zip(shape, reversed(spacing)))


def resample(vox: DataFrame, value: str, spacing: tuple[float, float, float], target: float,
             shape: tuple[int, int, int], linear: bool = True, fill: float = 0.0) -> DataFrame:
    """Values of dense volumes on an isotropic grid of ``target`` mm.

    Every source cell emits the target points between it and the next cell, so the new grid is made
    where the data is. Up to half a cell past the last centre the border value holds, then ``fill``.
    """
    size = resampled_shape(shape, spacing, target)
    axes = [(a, target / s, n, m) for a, s, n, m in zip("zyx", reversed(spacing), shape, size)]
    out = vox.select("case_id", "z", "y", "x")
    for a, step, n, m in axes:
        out = out.selectExpr(
            "*", f"cast(ceil({a} / {step!r}D) AS int) AS lo",
            f"cast(CASE WHEN {a} = {n - 1} THEN {m - 1} ELSE least({m - 1}, ceil(({a} + 1) / {step!r}D) - 1) END AS int) AS hi",
        ).where("lo <= hi").selectExpr(*out.columns, f"explode(sequence(lo, hi)) AS t{a}")
    pts = out.selectExpr(
        "case_id", f"(cast(tz AS bigint) * {size[1]} + ty) * {size[2]} + tx AS id", "tz", "ty", "tx",
        *[f"least(t{a} * {step!r}D, {n - 1}D) AS p{a}" for a, step, n, _ in axes],
        " AND ".join(f"t{a} * {step!r}D <= {n - 0.5}D" for a, step, n, _ in axes) + " AS inside")
    got = (trilinear if linear else nearest_cell)(pts, vox, value, fill)
    return got.selectExpr("case_id", "tz AS z", "ty AS y", "tx AS x",
                          f"CASE WHEN inside THEN sample ELSE {fill}D END AS sample")
