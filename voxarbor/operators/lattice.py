"""Morphology on a relation of lattice cells ``case_id, z, y, x``.

A cell announces itself to its neighbours by exploding a fixed offset list, and one aggregation per
target cell sees who announced. That is one shuffle per operation, with map-side combining, and no
join. Offsets are applied to coordinates, never to flat ids, so rows do not wrap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Offset = tuple[int, int, int]
CELL = ["case_id", "z", "y", "x"]

FULL: list[Offset] = [o for o in product((-1, 0, 1), repeat=3) if any(o)]
FACE: list[Offset] = [o for o in FULL if sum(map(abs, o)) == 1]
FORWARD: list[Offset] = [o for o in FULL if o > (0, 0, 0)]


def ball(radius: float, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> list[Offset]:
    """Offsets (dz, dy, dx), centre excluded, within ``radius``; spacing is (x, y, z)."""
    sx, sy, sz = spacing
    n = [int(radius // s) for s in (sz, sy, sx)]
    return [o for o in product(*(range(-k, k + 1) for k in n))
            if any(o) and (o[0] * sz) ** 2 + (o[1] * sy) ** 2 + (o[2] * sx) ** 2 <= radius ** 2 + 1e-9]


def _structs(offsets: Sequence[Offset], weight=None) -> str:
    rows = []
    for dz, dy, dx in offsets:
        extra = f", 'w', {weight(dz, dy, dx)}" if weight else ""
        rows.append(f"named_struct('dz', {dz}, 'dy', {dy}, 'dx', {dx}{extra})")
    return f"array({', '.join(rows)})"


def announce(vox: DataFrame, offsets: Sequence[Offset], carry: Sequence[str] = (),
             weight=None) -> DataFrame:
    """Neighbour cells of every row: target ``z, y, x``, carried expressions and the weight ``w``."""
    keep = [f"o.w AS w"] if weight else []
    return (vox.selectExpr("*", f"explode({_structs(offsets, weight)}) AS o")
            .selectExpr("case_id", "cast(z + o.dz AS int) AS z", "cast(y + o.dy AS int) AS y",
                        "cast(x + o.dx AS int) AS x", *keep, *carry))


def within(df: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    nz, ny, nx = shape
    return df.where(f"z BETWEEN 0 AND {nz - 1} AND y BETWEEN 0 AND {ny - 1} AND x BETWEEN 0 AND {nx - 1}")


def neighbour_counts(vox: DataFrame, offsets: Sequence[Offset]) -> DataFrame:
    """Member cells with the number of their neighbours that are members too."""
    told = announce(vox, offsets, ["0 AS own"])
    return (told.union(vox.selectExpr(*CELL, "1 AS own")).groupBy(*CELL)
            .agg(F.expr("max(own) AS own"), F.expr("count_if(own = 0) AS n"))
            .where("own = 1").drop("own"))


def erode(vox: DataFrame, offsets: Sequence[Offset] = FACE) -> DataFrame:
    """Cells all of whose neighbours are members; outside the lattice counts as background."""
    return neighbour_counts(vox, offsets).where(f"n = {len(offsets)}").drop("n")


def surface(vox: DataFrame, offsets: Sequence[Offset] = FACE) -> DataFrame:
    return neighbour_counts(vox, offsets).where(f"n < {len(offsets)}")


def dilate(vox: DataFrame, offsets: Sequence[Offset] = FACE,
           shape: tuple[int, int, int] | None = None) -> DataFrame:
    grown = announce(vox, [(0, 0, 0), *offsets])
    return (within(grown, shape) if shape else grown).distinct()


def opening(vox: DataFrame, offsets: Sequence[Offset] = FACE) -> DataFrame:
    """Erosion then dilation: bridges one voxel wide disappear, blocks keep their size."""
    return dilate(erode(vox, offsets), offsets)


def shell(vox: DataFrame, inner: Sequence[Offset], outer: Sequence[Offset],
          shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Cells reached by the outer offsets but neither members nor reached by the inner ones."""
    far = announce(vox, outer, ["0 AS near"])
    near = announce(vox, [(0, 0, 0), *inner], ["1 AS near"])
    both = far.union(near)
    both = within(both, shape) if shape else both
    return both.groupBy(*CELL).agg(F.expr("max(near) AS near")).where("near = 0").drop("near")


def rim(vox: DataFrame, offsets: Sequence[Offset] = FULL,
        shape: tuple[int, int, int] | None = None) -> DataFrame:
    """The ring one step around a set, the set itself left out."""
    return shell(vox, [], offsets, shape)


def without(vox: DataFrame, cells: DataFrame) -> DataFrame:
    return vox.join(cells, CELL, "left_anti")


def edges(vox: DataFrame, ident: str = "gid", offsets: Sequence[Offset] = FORWARD,
          carry: Sequence[str] = (), weight=None) -> DataFrame:
    """Each neighbouring pair once: ``src, dst`` and ``src_<c>`` / ``dst_<c>`` for carried columns."""
    left = announce(vox, offsets, [f"{ident} AS src", *[f"{c} AS src_{c}" for c in carry]], weight)
    right = vox.selectExpr(*CELL, f"{ident} AS dst", *[f"{c} AS dst_{c}" for c in carry])
    keep = ["w"] if weight else []
    return left.join(right, CELL).select("case_id", "src", "dst", *keep,
                                         *[f"src_{c}" for c in carry], *[f"dst_{c}" for c in carry])


def millimetres(spacing: Sequence[float]):
    """Edge length of an offset for spacing (x, y, z), as a SQL double."""
    sx, sy, sz = spacing
    return lambda dz, dy, dx: repr(math.sqrt((dz * sz) ** 2 + (dy * sy) ** 2 + (dx * sx) ** 2)) + "D"


def gradient(vox: DataFrame, value: str, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Central differences ``gz, gy, gx``, one-sided where a neighbour is missing, 0 where both are."""
    sx, sy, sz = spacing
    told = announce(vox, FACE, [f"{value} AS v", "-o.dz AS dz", "-o.dy AS dy", "-o.dx AS dx"])
    own = vox.selectExpr(*CELL, f"{value} AS v", "0 AS dz", "0 AS dy", "0 AS dx")
    pick = {f"{a}{s}": f"max(CASE WHEN d{a} = {d} THEN v END) AS {a}{s}"
            for a in "zyx" for s, d in (("p", 1), ("m", -1))}
    wide = told.union(own).groupBy(*CELL).agg(
        F.expr("max(CASE WHEN dz = 0 AND dy = 0 AND dx = 0 THEN v END) AS v"),
        *[F.expr(e) for e in pick.values()]).where("v IS NOT NULL")
    step = {"z": sz, "y": sy, "x": sx}
    return wide.selectExpr(*CELL, "v", *[
        f"(coalesce({a}p, v) - coalesce({a}m, v)) / "
        f"((cast({a}p IS NOT NULL AS int) + cast({a}m IS NOT NULL AS int)"
        f" + cast({a}p IS NULL AND {a}m IS NULL AS int)) * {step[a]}D) AS g{a}" for a in "zyx"])


def outward_normals(vox: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Surface cells with the unit vector away from their member neighbours, zero where it cancels."""
    sx, sy, sz = spacing
    told = announce(vox, FULL, ["0 AS own", "o.dz AS dz", "o.dy AS dy", "o.dx AS dx"])
    own = vox.selectExpr(*CELL, "1 AS own", "0 AS dz", "0 AS dy", "0 AS dx")
    face = "own = 0 AND abs(dz) + abs(dy) + abs(dx) = 1"
    pull = (told.union(own).groupBy(*CELL).agg(
        F.expr("max(own) AS own"), F.expr(f"count_if({face}) AS faces"),
        F.expr(f"sum(dz) * {sz}D AS sz"), F.expr(f"sum(dy) * {sy}D AS sy"), F.expr(f"sum(dx) * {sx}D AS sx"))
        .where("own = 1 AND faces < 6").selectExpr(*CELL, "sz", "sy", "sx", "sqrt(sz*sz + sy*sy + sx*sx) AS len"))
    return pull.selectExpr(*CELL, *[f"CASE WHEN len > 0 THEN s{a} / len ELSE 0.0D END AS n{a}" for a in "zyx"])
