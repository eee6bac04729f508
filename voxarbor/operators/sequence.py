"""Ordered-sequence operators that split a long sequence into blocks.

A window over one key would put all rows of that key into one task. Here a sequence is cut into
blocks (an hour of events, a run of sequence numbers): windows run inside ``(key, block)``, and only
one summary row per block is ordered per key to carry values across block borders.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"


def block_of(seq: str | Column, width: float) -> Column:
    col = F.col(seq) if isinstance(seq, str) else seq
    return F.floor(col / F.lit(width)).cast("bigint")


def neighbours(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
               block: Column, prev: bool = True, next: bool = True) -> DataFrame:
    """Add ``prev_<c>`` / ``next_<c>`` from the adjacent row of the sequence, NULL at its ends."""
    part = [*keys, BLOCK]
    rows = df.withColumn(BLOCK, block)
    payload, rank = F.struct(*cols), F.struct(*order)
    edges = rows.groupBy(*part).agg(F.min_by(payload, rank).alias("_first"),
                                    F.max_by(payload, rank).alias("_last"))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    edges = edges.select(*part, F.lag("_last").over(across).alias("_before"),
                         F.lead("_first").over(across).alias("_after"))
    inside = Window.partitionBy(*part).orderBy(*order)
    out = rows
    if prev:
        out = out.withColumn("_p", F.lag(payload).over(inside))
    if next:
        out = out.withColumn("_n", F.lead(payload).over(inside))
    out = out.join(edges, part)
    for c in cols:
        if prev:
            out = out.withColumn(f"prev_{c}", F.coalesce(F.col("_p"), F.col("_before"))[c])
        if next:
            out = out.withColumn(f"next_{c}", F.coalesce(F.col("_n"), F.col("_after"))[c])
    return out.drop("_p", "_n", "_before", "_after", BLOCK)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
            block: Column) -> DataFrame:
    """Add running sums (this row included): block totals first, then the rows of each block."""
    part = [*keys, BLOCK]
    rows = df.withColumn(BLOCK, block)
    totals = rows.groupBy(*part).agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*part, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for n, e in sums.items():
        out = out.withColumn(f"_i_{n}", F.sum(e).over(inside))
    out = out.join(totals, part)
    return out.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def arc_length(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Column,
               cols: Sequence[str], block: Column, name: str = "arc") -> DataFrame:
    """Cumulative polyline length; ``step`` is the length from the previous point (``prev_*``)."""
    near = neighbours(df, keys, order, cols, block, next=False)
    near = near.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return running(near, keys, order, {name: F.col("step")}, block)


def central_gradient(value: str, seq: str) -> Column:
    """Second-order central difference on uneven spacing, one-sided at both ends."""
    v, pv, nv = F.col(value), F.col(f"prev_{value}"), F.col(f"next_{value}")
    h0, h1 = F.col(seq) - F.col(f"prev_{seq}"), F.col(f"next_{seq}") - F.col(seq)
    inner = (h0 * h0 * nv + (h1 * h1 - h0 * h0) * v - h1 * h1 * pv) / (h0 * h1 * (h0 + h1))
    return (F.when(pv.isNull() & nv.isNull(), F.lit(None).cast("double"))
            .when(pv.isNull(), (nv - v) / h1).when(nv.isNull(), (v - pv) / h0).otherwise(inner))


def resample(df: DataFrame, keys: Sequence[str], order: Sequence[str], seq: str,
             cols: Sequence[str], block: Column, step: int, offsets: Sequence[int] = (0,),
             lo: int = 0, hi: int | None = None) -> DataFrame:
    """Linear interpolation at every multiple of ``step`` in ``[lo, hi]``, clamped at the ends.

    Without ``hi`` the grid of each key ends at the first point at or after its last row; offsets are then
    no longer than a step. ``seq`` holds whole numbers. Each segment between two rows emits the grid points it contains, so
    no range join is needed. Output: keys, ``at``, ``offset``, interpolated ``cols``.
    """
    near = neighbours(df, keys, order, [seq, *cols], block)
    s = F.col(seq).cast("bigint")
    off = near.withColumn("offset", F.explode(F.array(*[F.lit(int(o)) for o in offsets])))
    begin = F.when(F.col(f"prev_{seq}").isNull(), F.lit(lo)).otherwise(
        F.greatest(F.lit(lo), F.ceil((s - F.col("offset")) / F.lit(step)) * step))
    last = F.lit(hi) if hi is not None else F.ceil(s / F.lit(step)) * step
    inner = F.ceil((F.col(f"next_{seq}") - F.col("offset")) / F.lit(step)) * step - step
    end = F.when(F.col(f"next_{seq}").isNull(), last).otherwise(
        inner if hi is None else F.least(F.lit(hi), inner))
    grid = (off.withColumn("_a", begin.cast("bigint")).withColumn("_b", end.cast("bigint"))
            .where(F.col("_a") <= F.col("_b"))
            .withColumn("at", F.explode(F.sequence("_a", "_b", F.lit(step).cast("bigint")))))
    where = F.col("at") + F.col("offset")
    span = F.col(f"next_{seq}") - s
    t = F.when(span.isNull() | (span == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (where - s) / span)))
    return grid.select(*keys, "at", "offset", *[
        (F.col(c) + F.coalesce(F.col(f"next_{c}") - F.col(c), F.lit(0.0)) * t).alias(c) for c in cols])


def streaks(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, first: str,
            block: Column, persist: int = 2) -> DataFrame:
    """Maximal runs of consecutive flagged rows at least ``persist`` long: keys, start, length."""
    hit = F.when(flag, 1).otherwise(0)
    run = running(df.withColumn("_hit", hit), keys, order,
                  {"_rn": F.lit(1), "_hits": F.col("_hit")}, block)
    return (run.where(F.col("_hit") == 1)
            .groupBy(*keys, (F.col("_rn") - F.col("_hits")).alias("_gap"))
            .agg(F.min(first).alias("start"), F.count(F.lit(1)).alias("length"))
            .where(F.col("length") >= persist).drop("_gap"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    import math

    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def smooth(df: DataFrame, keys: Sequence[str], seq: str, value: str, weights: Sequence[float],
           block: Column, out: str = "smooth", straight: int | None = None) -> DataFrame:
    """Weighted moving sum on a dense whole-number sequence, extended linearly past both ends.

    The extension runs straight for ``straight`` samples and stays level after that. Every row adds its share to the rows in reach; the sums meet in one aggregation.
    """
    r = len(weights) // 2
    reach = r if straight is None else straight
    near = neighbours(df.select(*keys, seq, value), keys, [seq], [value], block)
    here, v = F.col(seq), F.col(value)
    pad = lambda slope, sign: F.transform(
        F.sequence(F.lit(1), F.lit(r)),
        lambda k: F.struct((here + sign * k).cast("bigint").alias("at"), (v + slope * F.least(k, F.lit(reach))).alias("v")))
    own = F.array(F.struct(here.cast("bigint").alias("at"), v.cast("double").alias("v")))
    none = F.array().cast("array<struct<at:bigint,v:double>>")
    left = F.when(F.col(f"prev_{value}").isNull(),
                  pad(F.coalesce(v - F.col(f"next_{value}"), F.lit(0.0)), -1)).otherwise(none)
    right = F.when(F.col(f"next_{value}").isNull(),
                   pad(F.coalesce(v - F.col(f"prev_{value}"), F.lit(0.0)), 1)).otherwise(none)
    samples = near.select(*keys, F.explode(F.concat(own, left, right)).alias("_s"))
    kernel = F.array(*[F.struct(F.lit(k - r).alias("o"), F.lit(float(w)).alias("w"))
                       for k, w in enumerate(weights)])
    spread = samples.select(*keys, "_s", F.explode(kernel).alias("_k"))
    total = (spread.groupBy(*keys, (F.col("_s.at") + F.col("_k.o")).alias(seq))
             .agg(F.sum(F.col("_s.v") * F.col("_k.w")).alias(out),
                  F.count(F.lit(1)).alias("_full")))
    # positions outside the original range never see every weight
    return total.where(F.col("_full") == len(weights)).drop("_full")


# --- profiles held as short arrays -----------------------------------------------------------

def dense_counts(band: str, n_bands: int, weight: str = "1") -> Column:
    """Aggregate to an array with one total per band; the last band takes everything beyond."""
    last = n_bands - 1
    totals = [f"sum(CASE WHEN {band} {'=' if i < last else '>='} {i} THEN {weight} ELSE 0 END)"
              for i in range(n_bands)]
    return F.expr(f"cast(array({', '.join(totals)}) AS array<bigint>)")


def array_median(a: str) -> str:
    """SQL for the median of a short array, NULL when it is empty."""
    return (f"(get(array_sort({a}), cast((size({a}) - 1) div 2 AS int))"
            f" + get(array_sort({a}), cast(size({a}) div 2 AS int))) / 2.0D")


def leak_report(frontier: str, cross_section: str, visited: str | None = None,
                mask_voxels: str | None = None, *, n_bands: int = 30, band: float = 0.5,
                sleeve: float = 2.0, explosion: float = 8.0, section_share: float = 0.5,
                strong: float = 2.0, weak: float = 1.25, early: tuple[float, float] = (3.0, 6.0),
                late: float = 3.0, visited_ratio: float = 40.0) -> Column:
    """Struct ``leak, reason, band_index, growth, early_frontier, late_frontier, floor``.

    Explosion outranks growth, which outranks the visited guard. ``growth`` is NULL when the profile
    is too short for both windows and infinite when nothing was reached early. All arguments are SQL
    expressions over the row; the profile is an array of ``n_bands`` counts.
    """
    first = -int(-sleeve // band)
    floor = f"({cross_section}) * {section_share}D"
    burst = "cast(NULL AS int)"
    if n_bands > first + 2:
        before = array_median(f"slice({frontier}, {first + 1}, b - {first})")
        burst = (f"get(filter(sequence({first + 2}, {n_bands - 1}), b -> get({frontier}, b) > "
                 f"greatest(({before}) * {explosion}D, {floor})), 0)")
    e0, e1, l0 = round(early[0] / band), round(early[1] / band), n_bands - round(late / band)
    e_med = l_med = growth = "cast(NULL AS double)"
    grows = "false"
    if e0 >= first and l0 >= e1 > e0:
        e_med = array_median(f"slice({frontier}, {e0 + 1}, {e1 - e0})")
        l_med = array_median(f"slice({frontier}, {l0 + 1}, {n_bands - l0})")
        growth = (f"CASE WHEN {e_med} > 0 THEN ({l_med}) / ({e_med}) "
                  f"WHEN {l_med} > 0 THEN double('infinity') ELSE 0.0D END")
        grows = f"(({growth}) >= {strong}D OR (({growth}) >= {weak}D AND ({l_med}) > {floor}))"
    over = "false"
    if visited is not None and mask_voxels is not None:
        over = f"({mask_voxels} > 0 AND {visited} > {mask_voxels} * {visited_ratio}D)"
    fired = f"({burst}) IS NOT NULL"
    return F.expr(f"""named_struct(
        'leak', {fired} OR {grows} OR {over},
        'reason', CASE WHEN {fired} THEN 'explosion' WHEN {grows} THEN 'growth' WHEN {over} THEN 'visited' END,
        'band_index', cast(CASE WHEN {fired} THEN {burst} WHEN {grows} THEN {l0} END AS int),
        'growth', {growth}, 'early_frontier', {e_med}, 'late_frontier', {l_med}, 'floor', {floor})""")
