"""Exact Euclidean distance transforms on lattices, axis by axis."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxarbor.operators import lattice

BLOCK = 256  # positions of a line that look at the whole line at once


def _envelope(step: float):
    """Lowest of the parabolas that stand on a line's cells, at each of its cells."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def lowest(places: pd.Series, heights: pd.Series) -> pd.Series:
        out = []
        for p, h in zip(places, heights):
            at, base = np.asarray(p, float) * step, np.asarray(h, float)
            stand = np.isfinite(base)
            feet, base = at[stand], base[stand]
            if not len(feet):
                out.append(np.full(len(at), np.inf))
                continue
            out.append(np.concatenate([((at[k:k + BLOCK, None] - feet) ** 2 + base).min(axis=1) for k in range(0, len(at), BLOCK)]))
        return pd.Series(out)

    return lowest


def squared_distances(grid: DataFrame, near: str, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Squared distance of every cell to the nearest cell for which ``near`` holds: input with ``d2``.

    ``grid`` holds every cell of a box per case, ``case_id, z, y, x`` and more columns; spacing is (x, y, z) and a
    case without such a cell has NULL. One shuffle per axis, whatever the size: along a line the distance
    is the lower envelope of parabolas standing on what the axes before have left, so a task holds single lines.
    """
    rest = [c for c in grid.columns if c not in lattice.CELL]
    now = grid.withColumn("d2", F.expr(f"CASE WHEN {near} THEN 0D ELSE double('infinity') END"))
    for axis, step in zip("xyz", spacing):
        others = [c for c in lattice.CELL if c != axis]
        line = now.groupBy(*others).agg(F.expr(f"collect_list(struct({', '.join([axis, 'd2', *rest])})) AS line"))
        line = line.withColumn("low", _envelope(step)(F.col(f"line.{axis}"), F.col("line.d2")))
        now = line.select(*others, F.expr("inline(arrays_zip(line, low))")).select(
            *others, F.col(f"line.{axis}").alias(axis), F.col("low").alias("d2"), *[F.col(f"line.{c}").alias(c) for c in rest])
    return now.select(*grid.columns, F.expr("CASE WHEN d2 < double('infinity') THEN d2 END AS d2"))


def contour(grid: DataFrame, inside: str, offsets=lattice.FACE) -> DataFrame:
    """Input with ``border``: members that have a cell of the grid beside them which is none."""
    told = lattice.announce(grid.where(f"NOT ({inside})"), offsets).distinct().withColumn("_told", F.lit(True))
    return grid.join(told, lattice.CELL, "left").withColumn("border", F.expr(f"coalesce(_told, false) AND ({inside})")).drop("_told")


def signed_distances(grid: DataFrame, inside: str, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Distance of every cell to the border of the members, negative outside: input with ``signed``.

    The border are the members beside a cell that is none, at distance 0; a case without border has NULL.
    """
    far = squared_distances(contour(grid, inside), "border", spacing)
    return far.selectExpr(*grid.columns, f"CASE WHEN {inside} THEN sqrt(d2) ELSE -sqrt(d2) END AS signed")


def half_steps(grid: DataFrame, value: str, level: str, closed: str = "false") -> DataFrame:
    """The grid at half its steps: ``case_id, z, y, x`` doubled, ``inside`` where ``value`` between the cells reaches ``level``.

    ``value`` is taken linearly between cells; cells for which ``closed`` holds close what is nearest to them (of two, the further one along the axis). Only
    places whose neighbours all exist are made.
    """
    # a cell at (z, y, x) speaks at its own doubled place and, half a step off, at the places it shares with others
    spread = grid.selectExpr(*lattice.CELL, f"cast({value} AS double) AS v", f"cast({level} AS double) AS level", f"({closed}) AS shut",
                             "explode(array(-1, 0, 1)) AS dz").selectExpr("*", "explode(array(-1, 0, 1)) AS dy").selectExpr(
        "*", "explode(array(-1, 0, 1)) AS dx").selectExpr(
        "case_id", "2 * z + dz AS z", "2 * y + dy AS y", "2 * x + dx AS x", "v", "level",
        "shut AND dz <= 0 AND dy <= 0 AND dx <= 0 AS shut", "cast(pow(2, abs(dz) + abs(dy) + abs(dx)) AS int) AS wanted")
    return spread.groupBy(*lattice.CELL).agg(F.expr("avg(v) AS v"), F.expr("max(level) AS level"), F.expr("bool_or(shut) AS shut"),
                                             F.expr("count(1) = max(wanted) AS full")).where("full").selectExpr(
        *lattice.CELL, "v >= level AND NOT shut AS inside")
