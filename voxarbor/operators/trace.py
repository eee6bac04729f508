"""Tracing an instance from the trunk outwards and measuring it along the way.

A trace is at most a few dozen points long (its length is capped in millimetres), so windows per
trace are short; ``at_arcs_of_long`` serves lines of any length in blocks. Relations are keyed by ``trace_id``.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxarbor.operators import graph, nearest, sequence
from voxarbor.session import Rounds

# Fixed values of the trace.
MAX_LENGTH, SEED_AT, STEP, BAND = 10.0, 5.0, 0.5, 0.5
SMOOTHING, FIT_LENGTH, REFINE_FROM, MAX_SHIFT = 2.5, 8.0, 2.5, 2.0
BLOB_SHARE, BLOB_CELLS, PERSIST = 0.25, 4, 2


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def main_axis(cov: pd.Series) -> pd.Series:
    """Unit eigenvector of the largest eigenvalue of symmetric matrices xx, yy, zz, xy, xz, yz."""
    import numpy as np

    m = np.stack(cov.to_numpy()).astype(float) if len(cov) else np.zeros((0, 6))
    full = m[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
    return pd.Series(list(np.linalg.eigh(full)[1][:, :, 2]))


def principal_axis(points: DataFrame, keys: Sequence[str], outward: Sequence[str] | None = None) -> DataFrame:
    """Line direction through points per key: ``keys, ax, ay, az`` and the mean ``mx, my, mz``.

    ``outward`` names three columns (constant per key) the axis must point along. The six sums are ordinary
    aggregates; only the 3 by 3 eigenproblem is Python.
    """
    pairs = ("x,x", "y,y", "z,z", "x,y", "x,z", "y,z")
    extra = [F.expr(f"first({c}) AS o{i}") for i, c in enumerate(outward or [])]
    sums = points.groupBy(*keys).agg(
        F.array(*[F.expr(f"covar_samp({p})") for p in pairs]).alias("cov"), F.expr("count(1) AS n"),
        *[F.expr(f"avg({c}) AS m{c}") for c in "xyz"], *extra).where("n >= 2")
    axis = sums.withColumn("axis", main_axis("cov"))
    side = "axis[0] * o0 + axis[1] * o1 + axis[2] * o2" if outward else "1"
    return axis.selectExpr(*keys, "mx", "my", "mz", *[
        f"CASE WHEN {side} < 0 THEN -axis[{i}] ELSE axis[{i}] END AS a{c}" for i, c in enumerate("xyz")])


def bifurcations(cells: DataFrame, neck: float, longest_edge: float) -> DataFrame:
    """First distance at which the front through an instance divides: ``instance_id, distance, blobs``.

    ``cells``: ``case_id, z, y, x, gid, instance_id, dist``. Every slab of every instance is labelled in one go:
    a cell is copied into the few slabs that cover it, slabs do not touch each other, and every copy has an id
    of its own.
    """
    slab = max(BAND, longest_edge)
    start = neck + slab
    top = cells.groupBy("instance_id").agg(F.expr("max(dist) AS top"))
    at = f"{start}D + k * {BAND}D"
    copies = cells.join(top, "instance_id").selectExpr(
        "*", f"explode(sequence(cast(greatest(0, floor((dist - {start + slab}D) / {BAND}D)) AS int), "
        f"cast(greatest(0, ceil((dist - {start}D) / {BAND}D)) AS int))) AS k").where(
        f"{at} < top AND dist >= {at} AND dist < {at} + {slab}D")
    # a slab is a volume of its own
    solo, _ = Rounds(cells.sparkSession, "slabs").save(copies.selectExpr(
        "struct(instance_id, k) AS case_id", "z", "y", "x", "monotonically_increasing_id() AS gid", "instance_id", "k"))
    blobs = graph.label_cells(solo).groupBy("instance_id", "k", "label").agg(F.expr("count(1) AS n"))
    big = blobs.selectExpr("*", "max(n) OVER (PARTITION BY instance_id, k) AS most").where(
        f"n >= {BLOB_CELLS} AND n >= {BLOB_SHARE}D * most")
    split = big.groupBy("instance_id", "k").agg(F.expr("count(1) AS blobs")).where("blobs >= 2")
    run = split.selectExpr("*", "k - row_number() OVER (PARTITION BY instance_id ORDER BY k) AS g")
    held = run.groupBy("instance_id", "g").agg(F.expr("min(k) AS k"), F.expr("count(1) AS n"), F.expr("min_by(blobs, k) AS blobs"))
    return held.where(f"n >= {PERSIST}").groupBy("instance_id").agg(
        F.expr(f"min({at}) AS distance"), F.expr("min_by(blobs, k) AS blobs"))


def limits(cells: DataFrame, forks: DataFrame, max_length: float = MAX_LENGTH) -> DataFrame:
    """Where each trace ends and why: ``instance_id, limit, truncated_by``."""
    ends = cells.groupBy("instance_id").agg(F.expr("max(dist) AS vessel_end")).join(forks, "instance_id", "left")
    ends = ends.selectExpr("instance_id", "vessel_end", f"coalesce(distance < {max_length}, false) AS forks",
                           f"least({max_length}D, coalesce(distance, {max_length}D)) AS cap")
    return ends.selectExpr("instance_id", "least(cap, vessel_end) AS limit", "CASE WHEN vessel_end <= cap THEN 'vessel_end' "
                           "WHEN forks THEN 'bifurcation' ELSE 'max_length' END AS truncated_by")


def end_cells(cells: DataFrame, lim: DataFrame) -> DataFrame:
    """Deepest cell within one band of the farthest reached: ``instance_id, gid``. ``cells`` carries ``depth``."""
    within = cells.join(lim, "instance_id").where("dist <= limit")
    far = within.groupBy("instance_id").agg(F.expr("max(dist) AS far"))
    return within.join(far, "instance_id").where(f"dist >= far - {BAND}D").groupBy("instance_id").agg(
        F.expr("min_by(gid, struct(-depth, gid)) AS gid"))


def depths(cells: DataFrame, ring: DataFrame, size: float) -> DataFrame:
    """Distance of every cell to the nearest outside cell: adds ``depth``. Both hold ``instance_id, id, x, y, z``."""
    return nearest.nearest(cells, ring, ["instance_id"], size).drop("nn").withColumnRenamed("dist", "depth")


def walk_back(ends: DataFrame, parents: DataFrame, hops: int = 4) -> DataFrame:
    """Cells from the trunk to each end: ``trace_id, seq, gid`` with ``seq`` 0 at the trunk.

    ``ends``: ``trace_id, gid``; ``parents``: ``gid, parent``. Only the heads of the traces move, several hops per job.
    """
    rounds = Rounds(ends.sparkSession, "walk")
    links, _ = rounds.save(parents.where("parent IS NOT NULL").select("gid", "parent"))
    every, now = rounds.save(ends.selectExpr("trace_id", "0 AS back", "gid"), n=F.expr("count(1)"))
    head, step = every, 0
    while now["n"]:
        steps = None
        for _ in range(hops):
            step += 1
            head = head.join(links, "gid").selectExpr("trace_id", f"{step} AS back", "parent AS gid")
            steps = head if steps is None else steps.unionByName(head)
        walked, now = rounds.save(steps, n=F.expr(f"count_if(back = {step})"))
        every, head = every.unionByName(walked), walked.where(f"back = {step}")
    return every.selectExpr("trace_id", "cast(max(back) OVER (PARTITION BY trace_id) - back AS int) AS seq", "gid")


def smooth_paths(path: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """Gaussian smoothing of ``trace_id, seq, dist, x, y, z`` along the path, whose mean step sets the width.

    Both ends continue straight for three widths and then stay level; paths of two points stay as they are.
    """
    w = "OVER (PARTITION BY trace_id)"
    o = "OVER (PARTITION BY trace_id ORDER BY seq)"
    one = path.selectExpr(
        "*", f"count(1) {w} AS n", f"greatest((max(dist) {w} - min(dist) {w}) / greatest(count(1) {w} - 1, 1), 1e-6D) AS mean_step",
        *[f"lag({c}) {o} AS l{c}" for c in "xyz"], *[f"lead({c}) {o} AS r{c}" for c in "xyz"])
    one = one.selectExpr("*", f"{smoothing}D / mean_step AS sigma").selectExpr(
        "*", "cast(floor(4 * sigma + 0.5D) AS int) AS radius", "cast(ceil(3 * sigma) AS int) AS pad")
    own = "array(struct(seq AS at, x AS x, y AS y, z AS z))"

    def grown(side, sign):  # straight for `pad` samples, level up to twice the kernel radius
        at = f"seq {sign} k AS at"
        move = ", ".join(f"{c} + coalesce({c} - {side}{c}, 0D) * least(k, pad) AS {c}" for c in "xyz")
        return f"transform(sequence(1, radius), k -> struct({at}, {move}))"

    none = "cast(array() AS array<struct<at:int,x:double,y:double,z:double>>)"
    samples = one.where("n > 2 AND radius > 0").selectExpr(
        "trace_id", "sigma", "radius", "n", f"explode(concat({own}, CASE WHEN lx IS NULL THEN {grown('r', '-')} ELSE {none} END, "
        f"CASE WHEN rx IS NULL THEN {grown('l', '+')} ELSE {none} END)) AS s")
    spread = samples.selectExpr("*", "explode(sequence(-radius, radius)) AS o").selectExpr(
        "trace_id", "s.at + o AS seq", "n", "s.x AS x", "s.y AS y", "s.z AS z", "exp(-0.5D * (o / sigma) * (o / sigma)) AS w")
    soft = spread.where("seq BETWEEN 0 AND n - 1").groupBy("trace_id", "seq").agg(
        *[F.expr(f"sum(w * {c}) / sum(w) AS {c}") for c in "xyz"])
    return soft.unionByName(one.where("NOT (n > 2 AND radius > 0)").select("trace_id", "seq", "x", "y", "z"))


def with_arc(points: DataFrame) -> DataFrame:
    """Add the cumulative length ``arc`` of ``trace_id, seq, x, y, z``."""
    o = "OVER (PARTITION BY trace_id ORDER BY seq)"
    move = " + ".join(f"({c} - lag({c}) {o}) * ({c} - lag({c}) {o})" for c in "xyz")
    return points.selectExpr("*", f"coalesce(sqrt({move}), 0D) AS step").selectExpr(
        *points.columns, f"sum(step) {o} AS arc")


def at_arcs(line: DataFrame, wanted: str) -> DataFrame:
    """Interpolated points at arc positions: ``trace_id, k, want, reached, x, y, z``.

    ``line`` carries ``arc``; ``wanted`` is SQL for an array of positions per row, over ``total`` (the length of the
    trace). Positions beyond the ends are clamped.
    """
    o = "OVER (PARTITION BY trace_id ORDER BY arc, seq)"
    seg = line.selectExpr("*", "max(arc) OVER (PARTITION BY trace_id) AS total", f"lead(arc) {o} AS arc1",
                          f"lag(arc) {o} AS arc0", *[f"lead({c}) {o} AS {c}1" for c in "xyz"])
    asked = seg.selectExpr("*", f"posexplode({wanted}) AS (k, want)")
    hit = asked.where("(want >= arc OR arc0 IS NULL) AND (want < arc1 OR arc1 IS NULL)")
    t = "CASE WHEN arc1 > arc THEN greatest(0D, least(1D, (want - arc) / (arc1 - arc))) ELSE 0D END"
    return hit.selectExpr("trace_id", "k", "want", "want <= total + 1e-9D AS reached",
                          *[f"{c} + coalesce({c}1 - {c}, 0D) * {t} AS {c}" for c in "xyz"])


def at_arcs_of_long(points: DataFrame, wanted: str, block: int = 4096) -> DataFrame:
    """``with_arc`` and ``at_arcs`` for lines of any length: no task holds more of a line than ``block`` points.

    ``points``: ``trace_id, seq, x, y, z`` with ``seq`` counting from 0. Only one row per block is ordered per line. The
    segment of a position is the last one that begins at or before it, found by a combined aggregation.
    """
    rounds, keys, order = Rounds(points.sparkSession, "arcs"), ["trace_id"], ["seq"]
    part = sequence.block_of("seq", block)
    move = F.expr("sqrt(" + " + ".join(f"({c} - prev_{c}) * ({c} - prev_{c})" for c in "xyz") + ")")
    line, _ = rounds.save(sequence.arc_length(points, keys, order, move, list("xyz"), part).select(
        "trace_id", "seq", "x", "y", "z", "arc", part.alias("part")))
    seg = sequence.neighbours(line, keys, order, ["arc", "x", "y", "z"], F.col("part"))
    tops = line.groupBy("trace_id", "part").agg(F.expr("max(arc) AS top")).selectExpr(
        "trace_id", "part", "max(top) OVER (PARTITION BY trace_id) AS total")
    asked = seg.join(tops, ["trace_id", "part"]).selectExpr("*", f"posexplode({wanted}) AS (k, want)").where(
        "want >= arc OR prev_arc IS NULL")
    hit = asked.groupBy("trace_id", "k").agg(F.expr(
        "max_by(struct(want, total, arc, x, y, z, next_arc, next_x, next_y, next_z), seq) AS s")).select("trace_id", "k", "s.*")
    t = "CASE WHEN next_arc > arc THEN greatest(0D, least(1D, (want - arc) / (next_arc - arc))) ELSE 0D END"
    return hit.selectExpr("trace_id", "k", "want", "want <= total + 1e-9D AS reached",
                          *[f"{c} + coalesce(next_{c} - {c}, 0D) * {t} AS {c}" for c in "xyz"])


def resample(line: DataFrame, step: float = STEP) -> DataFrame:
    """Points every ``step`` of the length: ``trace_id, seq, arc, x, y, z``."""
    grid = f"transform(sequence(0, cast(floor((total + 1e-9D) / {step}D) AS int)), k -> k * {step}D)"
    return at_arcs(line, grid).selectExpr("trace_id", "k AS seq", "want AS arc", "x", "y", "z")


def tangents(line: DataFrame, positions: str, half: float = 1.0) -> DataFrame:
    """Unit secant over plus and minus ``half`` at arc positions: ``trace_id, k, tx, ty, tz``; NULL where it has no length."""
    ends = (f"flatten(transform({positions}, p -> array(greatest(p - {half}D, 0D), least(p + {half}D, total))))")
    pts = at_arcs(line, ends)
    pair = pts.groupBy("trace_id", F.expr("cast(k div 2 AS int) AS k")).agg(*[
        F.expr(f"max(CASE WHEN k % 2 = 1 THEN {c} END) - max(CASE WHEN k % 2 = 0 THEN {c} END) AS d{c}") for c in "xyz"])
    return pair.selectExpr("trace_id", "k", *[f"CASE WHEN dx*dx + dy*dy + dz*dz > 0 THEN d{c} / sqrt(dx*dx + dy*dy + dz*dz) END AS t{c}"
                                              for c in "xyz"])


def refine(line: DataFrame, ostia: DataFrame, centres: DataFrame, max_length: float = MAX_LENGTH) -> DataFrame:
    """Proximal path: lumen centres beyond the first stretch, the ostium in front, cut at ``max_length``.

    ``centres``: ``trace_id, seq, cx, cy, cz, found``; ``ostia``: ``trace_id, x, y, z``. A centre that would move a point
    by more than the allowed shift is ignored.
    """
    shift = "sqrt((cx-x)*(cx-x) + (cy-y)*(cy-y) + (cz-z)*(cz-z))"
    moved = line.join(centres, ["trace_id", "seq"], "left").selectExpr(
        "trace_id", "seq", "arc", f"coalesce(found AND arc >= {REFINE_FROM}D AND {shift} <= {MAX_SHIFT}D, false) AS use",
        "x", "y", "z", "cx", "cy", "cz", "max(arc) OVER (PARTITION BY trace_id) AS total")
    tail = moved.where(f"arc >= least({REFINE_FROM}D, total)").selectExpr(
        "trace_id", "seq + 1 AS seq", *[f"CASE WHEN use THEN c{c} ELSE {c} END AS {c}" for c in "xyz"])
    full = ostia.selectExpr("trace_id", "0 AS seq", "x", "y", "z").unionByName(tail)
    o = "OVER (PARTITION BY trace_id ORDER BY seq)"
    gap = " + ".join(f"power({c} - lag({c}) {o}, 2)" for c in "xyz")
    kept = full.selectExpr("*", f"coalesce(sqrt({gap}), 1D) AS gap").where("gap > 1e-8D").drop("gap")
    arced = with_arc(kept)
    stop = at_arcs(arced, f"array({max_length}D)").where("reached").selectExpr("trace_id", "1000000 AS seq", "x", "y", "z")
    return with_arc(arced.where(f"arc < {max_length}D").drop("arc").unionByName(stop))


def ostium_estimates(patches: DataFrame, line: DataFrame, opening: DataFrame, surface: DataFrame,
                     size: float) -> DataFrame:
    """Three ostium estimates per trace and how far they disagree.

    ``patches``: ``trace_id, case_id, x, y, z`` patch centroids; ``line``: resampled trace; ``opening``: ``trace_id, x, y,
    z`` where the front narrows fastest; ``surface``: ``case_id, id, x, y, z``. Returns the centroid on the surface
    (the ostium), the disagreement and the mean disagreement.
    """
    spots = surface.selectExpr("id AS nn", "x AS sx", "y AS sy", "z AS sz")

    def onto(points):
        return nearest.nearest(points, surface, ["case_id"], size).join(spots, "nn")

    first = onto(patches.selectExpr("case_id", "trace_id AS id", "x", "y", "z")).selectExpr("id AS trace_id", "sx AS x", "sy AS y", "sz AS z")
    ends = line.groupBy("trace_id").agg(*[F.expr(f"max_by({c}, seq) - min_by({c}, seq) AS o{c}") for c in "xyz"],
                                        *[F.expr(f"min_by({c}, seq) AS f{c}") for c in "xyz"])
    early = line.where("arc <= 3D").join(ends, "trace_id")
    axis = principal_axis(early, ["trace_id"], ["ox", "oy", "oz"])
    last = early.groupBy("trace_id").agg(*[F.expr(f"max_by({c}, seq) AS {c}") for c in "xyz"])
    walk = ends.join(last, "trace_id").join(axis, "trace_id", "left").selectExpr("*", "explode(sequence(0, 24)) AS k").selectExpr(
        "trace_id", "k", *[f"CASE WHEN ax IS NULL THEN f{c} ELSE {c} - k * 0.25D * a{c} END AS {c}" for c in "xyz"])
    near = onto(walk.join(patches.select("trace_id", "case_id"), "trace_id").selectExpr("case_id", "trace_id * 25 + k AS id", "x", "y", "z"))
    second = near.groupBy(F.expr("id div 25 AS trace_id")).agg(F.expr("min_by(struct(sx AS x, sy AS y, sz AS z), struct(dist, id)) AS p"))
    joined = first.join(second.selectExpr("trace_id", "p"), "trace_id").join(
        opening.selectExpr("trace_id", "x AS gx", "y AS gy", "z AS gz"), "trace_id")
    d = lambda a, b: "sqrt(" + " + ".join(f"power({p} - {q}, 2)" for p, q in zip(a, b)) + ")"
    a, b, c = ("x", "y", "z"), ("p.x", "p.y", "p.z"), ("gx", "gy", "gz")
    return joined.selectExpr("trace_id", "x", "y", "z", f"array({d(a, b)}, {d(a, c)}, {d(b, c)}) AS gaps").selectExpr(
        "trace_id", "x", "y", "z", "array_max(gaps) AS max_disagreement", "aggregate(gaps, 0D, (s, g) -> s + g) / 3 AS mean_disagreement")


def radius_in_band(at: float | str, window: float, volume: float) -> Column:
    """Aggregate: radius of the disc that holds the cells with ``dist`` in the half-open window around ``at``."""
    return F.expr(f"sqrt(count_if(dist >= {at} - {window / 2}D AND dist < {at} + {window / 2}D) * {volume}D / ({window}D * pi()))")


def first_radius(cells: DataFrame, neck: float, length: float, volume: float, window: float = 2.0, step: float = 0.5) -> DataFrame:
    """Median front radius of every part over its first stretch past the neck, up to ``length``: ``label, radius``.

    ``cells``: ``label, dist``. A part too short for one window is taken as one slab from the neck to its end.
    """
    half = window / 2
    spots = [neck + half + k * step for k in range(int((length - neck - half + 1e-9) / step) + 1)]
    held = lambda at: F.expr(f"coalesce(sum(CASE WHEN dist >= {at - half}D AND dist < {at + half}D THEN n END), 0) AS n{spots.index(at)}")
    disc = lambda n, w: f"sqrt({n} * {volume}D / ({w} * pi()))"
    per = cells.where(f"dist > {neck}").groupBy("label", "dist").agg(F.expr("count(1) AS n")).groupBy("label").agg(
        F.expr("cast(max(dist) AS double) AS far"), F.expr("sum(n) - max_by(n, dist) AS inside"), *[held(at) for at in spots])
    rs = ", ".join(f"CASE WHEN {at}D <= far - {half}D + 1e-9D THEN {disc(f'n{i}', f'{window}D')} END" for i, at in enumerate(spots))
    return per.selectExpr("label", "inside", "far", f"array_sort(filter(array({rs}), r -> r IS NOT NULL)) AS rs").selectExpr(
        "label", f"CASE WHEN size(rs) = 0 THEN {disc('inside', f'greatest(far - {neck}D, 1e-6D)')} "
        "ELSE (get(rs, (size(rs) - 1) div 2) + get(rs, size(rs) div 2)) / 2 END AS radius")


def radius_check(distance_radius: Column, front_radius: Column, limit: float = 0.5) -> tuple[Column, Column]:
    """Relative disagreement of two radius readings and whether it is flagged."""
    most = F.greatest(distance_radius, front_radius)
    off = F.when(most > 0, F.abs(distance_radius - front_radius) / most).otherwise(F.lit(0.0))
    return off, off > limit
