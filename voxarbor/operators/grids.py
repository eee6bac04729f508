"""Volumes on grids of their own: cropping to the trunk, one working grid for all, numbers for cells.

A grid is a row per case: ``case_id`` and the arrays ``spacing, origin, size`` in (x, y, z) order and ``direction``
(row-major 3 x 3). Volumes are relations of cells, so cases of any shape and spacing share one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.functions.scalar import index_to_physical

MARGIN, TARGET = 15.0, 0.8  # fixed values, millimetres
TASK_CELLS = 250_000  # target cells that one task lays out
AXES = tuple(enumerate("xyz"))


def crop_to_mask(vox: DataFrame, grids: DataFrame, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """Cells in the box of each case's mask, widened by ``margin`` mm (a cell at least) and cut at the border.

    ``vox``: ``case_id, z, y, x, in_mask`` and any values. Cells count from the box's corner, and the grids that come
    back have its size and origin. A case whose mask is empty has no box and leaves both results.
    """
    box = vox.where("in_mask").groupBy("case_id").agg(
        *[F.expr(f"{f}({a}) AS {f}_{a}") for a in "xyz" for f in ("min", "max")])
    wide = {a: f"cast(greatest(1, bround({margin}D / spacing[{i}])) AS int)" for i, a in AXES}
    cut = grids.join(box, "case_id").selectExpr(
        "case_id", "spacing", "origin", "direction",
        *[f"greatest(0, min_{a} - {wide[a]}) AS lo_{a}" for a in "xyz"],
        *[f"least(size[{i}] - 1, max_{a} + {wide[a]}) AS hi_{a}" for i, a in AXES])
    corner = index_to_physical([F.col(f"lo_{a}").cast("double") for a in "xyz"], F.col("spacing"), F.col("origin"), F.col("direction"))
    new = cut.withColumn("origin", F.array(*corner)).selectExpr(
        "case_id", "spacing", "origin", "direction", f"array({', '.join(f'hi_{a} - lo_{a} + 1' for a in 'xyz')}) AS size")
    kept = vox.join(cut.select("case_id", *[f"{s}_{a}" for s in ("lo", "hi") for a in "xyz"]), "case_id").where(
        " AND ".join(f"{a} BETWEEN lo_{a} AND hi_{a}" for a in "xyz"))
    return kept.selectExpr(*[f"{c} - lo_{c} AS {c}" if c in "xyz" else c for c in vox.columns]), new


def target_grids(grids: DataFrame, target: float = TARGET) -> DataFrame:
    """Grids of the same origin and axes with cubic cells of ``target`` mm; halves of a size round to even."""
    size = ", ".join(f"greatest(1, cast(bround(size[{i}] * spacing[{i}] / {target}D) AS int))" for i, _ in AXES)
    return grids.selectExpr("case_id", f"array({', '.join([f'{target}D'] * 3)}) AS spacing", "origin", "direction", f"array({size}) AS size")


def resample_cases(vox: DataFrame, grids: DataFrame, target: float = TARGET, values: Sequence[str] = ("hu",),
                   labels: Sequence[str] = ("in_mask",)) -> DataFrame:
    """Every cell of every case's target grid: ``case_id, z, y, x``, values by linear, labels by nearest sampling.

    Absent cells and places more than half a cell past the last centre count as the case's lowest value, labels
    there are false; on the last half cell the border value holds. Each source cell adds its weighted value to the
    target cells around it, and the empty target grid joins the same aggregation, spread by slice: one shuffle with
    map-side sums, no join of corners, and no task that holds a case.
    """
    plan = grids.join(vox.groupBy("case_id").agg(*[F.expr(f"min({v}) AS low_{v}") for v in values]), "case_id").selectExpr(
        "case_id", *[f"low_{v}" for v in values], *[f"size[{i}] AS n_{a}" for i, a in AXES],
        *[f"{target}D / spacing[{i}] AS step_{a}" for i, a in AXES],
        *[f"greatest(1, cast(bround(size[{i}] * spacing[{i}] / {target}D) AS int)) AS m_{a}" for i, a in AXES])
    inside = " AND ".join(f"t_{a} * step_{a} <= n_{a} - 0.5D" for a in "xyz")
    # slices are small rows that become many cells, so their number, not their size, says how many tasks share them
    shape = " * ".join(f"greatest(1, bround(size[{i}] * spacing[{i}] / {target}D))" for i, _ in AXES)
    cells = grids.agg(F.expr(f"cast(sum({shape}) AS bigint) AS n")).first()["n"] or 0
    parts = max(int(vox.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells // TASK_CELLS + 1)
    ground = plan.selectExpr("*", "explode(sequence(0, m_z - 1)) AS t_z").repartition(parts, "case_id", "t_z")
    for a in "yx":
        ground = ground.selectExpr("*", f"explode(sequence(0, m_{a} - 1)) AS t_{a}")
    ground = ground.selectExpr("case_id", "t_z", "t_y", "t_x", f"{inside} AS inside", "0D AS w", *[f"low_{v}" for v in values],
                               *[f"0D AS {v}" for v in values], *[f"false AS {b}" for b in labels])
    near = vox.select(*["case_id", "z", "y", "x"], *values, *labels).join(plan.drop(*[f"low_{v}" for v in values]), "case_id")
    for a in "zyx":
        reach = f"CASE WHEN {a} = n_{a} - 1 THEN n_{a} - 0.5D ELSE {a} + 1 END"
        near = near.selectExpr("*", f"cast(greatest(0, ceil(({a} - 1) / step_{a})) AS int) AS _lo",
                               f"cast(least(m_{a} - 1, floor(({reach}) / step_{a})) AS int) AS _hi").where("_lo <= _hi").selectExpr(
            *near.columns, f"explode(sequence(_lo, _hi)) AS t_{a}").where(
            f"t_{a} * step_{a} <= n_{a} - 0.5D AND abs(least(t_{a} * step_{a}, n_{a} - 1) - {a}) < 1")
    weight = " * ".join(f"(1 - abs(least(t_{a} * step_{a}, n_{a} - 1) - {a}))" for a in "zyx")
    same = " AND ".join(f"{a} = least(n_{a} - 1, floor(t_{a} * step_{a} + 0.5D))" for a in "zyx")
    near = near.selectExpr("*", f"{weight} AS w").selectExpr(
        "case_id", "t_z", "t_y", "t_x", "true AS inside", "w", *[f"cast(NULL AS {dict(plan.dtypes)[f'low_{v}']}) AS low_{v}" for v in values],
        *[f"w * {v} AS {v}" for v in values], *[f"{same} AND coalesce({b}, false) AS {b}" for b in labels])
    met = ground.unionByName(near).groupBy("case_id", "t_z", "t_y", "t_x").agg(
        F.expr("bool_or(inside) AS inside"), F.expr("sum(w) AS w"), *[F.expr(f"sum({v}) AS {v}") for v in values],
        *[F.expr(f"max(low_{v}) AS low_{v}") for v in values], *[F.expr(f"bool_or({b}) AS {b}") for b in labels])
    return met.selectExpr("case_id", *[f"t_{a} AS {a}" for a in "zyx"],
                          *[f"CASE WHEN inside THEN {v} + (1 - w) * low_{v} ELSE cast(low_{v} AS double) END AS {v}" for v in values], *labels)


def numbered(grids: DataFrame) -> DataFrame:
    """Grids with a number per case, ``name`` for the old key and ``first``, the number of its first cell.

    Cells are numbered through all cases. The window runs over one row per case, never over cells.
    """
    cells = grids.selectExpr("case_id AS name", "* EXCEPT (case_id)", "cast(size[0] AS bigint) * size[1] * size[2] AS cells")
    return cells.selectExpr("row_number() OVER (ORDER BY name) AS number", "*",
                            "coalesce(sum(cells) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first").selectExpr(
        "cast(number AS bigint) AS case_id", "name", "spacing", "origin", "direction", "size", "cells", "first")


def with_numbers(vox: DataFrame, cases: DataFrame) -> DataFrame:
    """``vox`` with the numbers of ``numbered`` as ``case_id`` and ``gid``, a cell's number over all cases."""
    own = cases.selectExpr("name", "case_id AS number", "size", "first")
    return vox.withColumnRenamed("case_id", "name").join(own, "name").selectExpr(
        "number AS case_id", "first + (cast(z AS bigint) * size[1] + y) * size[0] + x AS gid", *[c for c in vox.columns if c != "case_id"])
