"""Exact nearest-neighbour joins in three dimensions without cross joins.

Points are bucketed into cubic cells; a point looks into the 27 cells around it. A hit no farther than
the cell size is final, the rest descend through cells that halve from level to level and keep those that may
still hold something as near as the nearest position they have met. Copies of one position are collapsed first,
and the cell size is chosen so that no cell holds many positions, so a crowded place costs what a sparse one does
and a point far from all others does not meet them all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.session import Rounds

XYZ = ["x", "y", "z"]
CROWD = 64  # positions per cell accepted at the first cell size
MEETING = 256  # points that meet one copy of a cell's row on average, so a popular cell is met in many tasks
MOST_COPIES = 1024
_CUBE = "array(-1, 0, 1)"


def _cells(df: DataFrame, size: float) -> DataFrame:
    return df.selectExpr("*", *[f"cast(floor({c} / {size!r}D) AS bigint) AS c{c}" for c in XYZ])


def _around(df: DataFrame) -> DataFrame:
    """Repeat each row for the 27 cells around its own."""
    out = df
    for c in XYZ:
        out = out.selectExpr("*", f"explode({_CUBE}) AS d{c}")
    keep = [n for n in df.columns if n not in ("cx", "cy", "cz")]
    return out.selectExpr(*keep, *[f"c{c} + d{c} AS c{c}" for c in XYZ])


def first_size(points: DataFrame, keys: Sequence[str]) -> float:
    """Largest trial cell size at which no cell holds more than ``CROWD`` positions."""
    box = points.agg(*[F.expr(f"max({c}) - min({c}) AS s{c}") for c in XYZ], F.expr("count(1) AS n")).first()
    extent = max([box[f"s{c}"] or 0.0 for c in XYZ])
    if not box["n"] or extent <= 0:
        return 1.0
    coarse = max(extent / max(box["n"], 1) ** (1 / 3), extent * 1e-6)
    trials = [coarse * 4 ** -k for k in range(6)]
    sizes = "explode(array(" + ", ".join(f"{s!r}D" for s in trials) + ")) AS size"
    full = (points.selectExpr(*keys, *XYZ, sizes)
            .groupBy(*keys, "size", *[F.expr(f"floor({c} / size)").alias(f"c{c}") for c in XYZ])
            .agg(F.expr("count(1) AS n")).groupBy("size").agg(F.expr("max(n) AS n")).collect())
    fit = [r["size"] for r in full if r["n"] <= CROWD]
    return max(fit) if fit else min(trials)


def _levels(spots: DataFrame, keys: list[str], size: float, rounds: Rounds) -> list[tuple[DataFrame, int]]:
    """Cells of the positions from ``size`` on, each level twice as wide, up to about eight cells per key: tables and their rows.

    A cell has its place ``c``, its parent's ``p``, the box of its positions, one of them and how many there are.
    """
    place, up = [f"c{c}" for c in XYZ], [f"floor(c{c} / 2) AS p{c}" for c in XYZ]
    some = [F.expr("min(one) AS one"), F.expr("sum(n) AS n"), *[F.expr(f"{f}({f}{c}) AS {f}{c}") for c in XYZ for f in ("min", "max")]]
    cells = _cells(spots, size).selectExpr(
        *keys, *place, f"struct(nn, {', '.join(XYZ)}) AS one", "1L AS n", *[f"{c} AS {f}{c}" for c in XYZ for f in ("min", "max")])
    groups = spots.select(*keys).distinct().count() if keys else 1
    found = []
    while True:
        cells, now = rounds.save(cells.groupBy(*keys, *place).agg(*some).selectExpr("*", *up), n=F.expr("count(1)"))
        found.append((cells, now["n"]))
        if now["n"] <= 8 * groups:
            return found
        cells = cells.drop(*place).selectExpr("*", *[f"p{c} AS c{c}" for c in XYZ]).drop(*[f"p{c}" for c in XYZ])


def _meet(asked: DataFrame, n: int, cells: DataFrame, m: int, on: list[str]) -> DataFrame:
    """Join of points with cells; few cells are copied, so the points of one cell are spread over tasks."""
    copies = min(MOST_COPIES, n // (MEETING * max(m, 1)) + 1)
    return asked.withColumn("copy", F.expr(f"pmod(xxhash64({', '.join(XYZ)}), {copies}L)")).join(
        cells.withColumn("copy", F.expr(f"explode(sequence(0L, {copies - 1}L))")), [*on, "copy"]).drop("copy")


def _descend(todo: DataFrame, n: int, spots: DataFrame, keys: list[str], size: float, rounds: Rounds) -> DataFrame:
    """Nearest position of every point from the widest cells down: ``keys, x, y, z, d2, nn``.

    ``todo``: ``keys, x, y, z, m``, the nearest position met so far as ``struct(d2, nn)`` or NULL. Every cell met offers one
    of its positions; a cell whose box is farther than the nearest offer is left, and so is a cell of one position.
    The box of a position is as far as itself in rounded arithmetic too, so ties are kept.
    """
    levels = _levels(spots, keys, size, rounds)
    own, up = [*keys, *XYZ], [f"p{c}" for c in XYZ]
    offer = " + ".join(f"({c} - one.{c}) * ({c} - one.{c})" for c in XYZ)
    least = " + ".join(f"{g} * {g}" for g in (f"greatest(min{c} - {c}, {c} - max{c}, 0D)" for c in XYZ))
    kept = "struct(" + ", ".join(["low", *[f"c{c} AS p{c}" for c in XYZ]]) + ")"
    asked, on, offers = todo, keys, todo
    for cells, m in reversed(levels):
        met = _meet(asked, n, cells if on != keys else cells.drop(*up), m, on).selectExpr(
            *own, "m", f"{least} AS low", f"struct({offer} AS d2, one.nn AS nn) AS here", *[f"c{c}" for c in XYZ], "n").where("m IS NULL OR low <= m.d2")
        best = met.groupBy(*own).agg(F.expr("least(min(m), min(here)) AS m"), F.expr(f"collect_list(CASE WHEN n > 1 THEN {kept} END) AS cells"))
        rows, now = rounds.save(best.selectExpr(*own, "m", "filter(cells, c -> c.low <= m.d2) AS cells"), n=F.expr("sum(size(cells))"))
        offers = offers.unionByName(rows.select(*own, "m"))
        asked, on, n = rows.selectExpr(*own, "m", "inline(cells)").drop("low"), [*keys, *up], now["n"]
        if not n:
            break
    else:
        there = _cells(spots, size).selectExpr(*keys, "nn", *[f"{c} AS r{c}" for c in XYZ], *[f"c{c} AS p{c}" for c in XYZ])
        square = " + ".join(f"({c} - r{c}) * ({c} - r{c})" for c in XYZ)
        last = _meet(asked, n, there, m, on).groupBy(*own).agg(F.expr(f"min(struct({square} AS d2, nn)) AS m"))
        offers = offers.unionByName(last)
    return offers.groupBy(*own).agg(F.expr("min(m) AS m")).selectExpr(*own, "m.d2 AS d2", "m.nn AS nn")


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str] = (), size: float | None = None,
            default: float | None = None) -> DataFrame:
    """Nearest ``right`` point of every ``left`` point with the same keys: left columns, ``nn``, ``dist``.

    Both sides hold ``id, x, y, z`` and the keys. The smaller id wins a tie. Left rows whose keys are
    absent on the right get NULL, and ``default`` as their distance.
    """
    keys = list(keys)
    rounds = Rounds(left.sparkSession, "nearest")
    placed = " AND ".join(f"{c} IS NOT NULL" for c in XYZ)
    spots, _ = rounds.save(right.where(placed).groupBy(*keys, *XYZ).agg(F.expr("min(id) AS nn")))
    asked = left.where(placed).select(*keys, *XYZ).distinct()
    if keys:
        asked = asked.join(spots.select(*keys).distinct(), keys, "left_semi")
    todo, state = rounds.save(asked, n=F.expr("count(1)"))
    size = size or first_size(spots, keys)
    square = " + ".join(f"({c} - r{c}) * ({c} - r{c})" for c in XYZ)
    target = spots.selectExpr(*keys, "nn", *[f"{c} AS r{c}" for c in XYZ], *XYZ)
    found = None
    if state["n"] and spots.head(1):
        there = _cells(target, size).drop(*XYZ)
        best = (_around(_cells(todo, size)).join(there, [*keys, "cx", "cy", "cz"])
                .groupBy(*keys, *XYZ).agg(F.expr(f"min(struct({square} AS d2, nn)) AS m")))
        tried, state = rounds.save(todo.join(best, [*keys, *XYZ], "left").selectExpr(
            *keys, *XYZ, "m", f"coalesce(m.d2 <= {size * size!r}D, false) AS final"), n=F.expr("count_if(NOT final)"))
        found = tried.where("final").selectExpr(*keys, *XYZ, "m.d2 AS d2", "m.nn AS nn")
        if state["n"]:
            far = _descend(tried.where("NOT final").drop("final"), state["n"], spots, keys, size, rounds)
            found = found.unionByName(rounds.save(far)[0])
    if found is None:
        return left.selectExpr("*", "cast(NULL AS bigint) AS nn", f"cast({'NULL' if default is None else default} AS double) AS dist")
    dist = "sqrt(d2)" if default is None else f"coalesce(sqrt(d2), {default}D)"
    return left.join(found, [*keys, *XYZ], "left").selectExpr(*left.columns, "nn", f"{dist} AS dist")


def set_gap(left: DataFrame, right: DataFrame, keys: Sequence[str], size: float | None = None) -> DataFrame:
    """Smallest distance between two point sets per key; a key absent on one side has no row."""
    return (nearest(left, right, keys, size).where("dist IS NOT NULL")
            .groupBy(*keys).agg(F.expr("min(dist) AS gap")))


def within_distance(left: DataFrame, right: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """All pairs no farther apart than ``reach``: keys, ``id``, ``other``, ``dist``."""
    keys = list(keys)
    there = _cells(right, reach).selectExpr(*keys, "cx", "cy", "cz", "id AS other", *[f"{c} AS r{c}" for c in XYZ])
    square = " + ".join(f"({c} - r{c}) * ({c} - r{c})" for c in XYZ)
    near = _around(_cells(left.select(*keys, "id", *XYZ), reach)).join(there, [*keys, "cx", "cy", "cz"])
    return near.selectExpr(*keys, "id", "other", f"sqrt({square}) AS dist").where(f"dist <= {reach!r}D")
