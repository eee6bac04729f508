"""From voxels to scored findings: the whole analysis of a set of cases as one chain of relations.

All cases run together and every relation is keyed by cell or instance, so a large case is spread over the
cluster like many small ones. Positions are millimetres in the grid's own axes until the last step.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor import schema
from voxarbor.functions.rules import Limits, explain, rejection_reason
from voxarbor.operators import centerline, dedupe, descent, graph, grids, lattice, nearest, planes, quantiles, sequence, split, studies, trace, vesselness
from voxarbor.session import Rounds, Stages
from voxarbor.sources import volumes

CELL = lattice.CELL


@dataclass(frozen=True)
class Settings:
    spacing: tuple[float, float, float] = (0.8, 0.8, 0.8)
    budget: float = 15.0
    band: float = 0.5
    low: float = 0.40
    high: float = 0.90
    searches: int = 5
    step: float = descent.STEP
    neck: float = 2.0
    contrast: float = 80.0
    merge: float = 3.0
    gap: float = 1.5
    per_case: int | None = 40  # findings a case reports at most, largest parts first; None: all
    hops: int = 2
    limits: Limits = Limits()

    @property
    def bands(self) -> int:
        return int(round(self.budget / self.band))

    @property
    def volume(self) -> float:
        sx, sy, sz = self.spacing
        return sx * sy * sz

    @property
    def edge(self) -> float:
        return sum(s * s for s in self.spacing) ** 0.5

    def mm(self) -> list[str]:
        return [f"{c} * {s}D AS p{c}" for c, s in zip("xyz", self.spacing)]


def lumen(vox: DataFrame) -> DataFrame:
    """Brightness of the trunk away from its wall: ``case_id, median, mad, p25, p75, n, ref, section, mask_n, ceiling``.

    A trunk too thin to be eroded counts whole. ``ceiling`` is the 99th percentile: no vessel is brighter than that.
    """
    mask = vox.where("in_mask")
    inner = lattice.erode(mask).withColumn("inner", F.lit(True))
    rows = mask.join(inner, CELL, "left").selectExpr("case_id", "z", "hu", "coalesce(inner, false) AS inner")
    any_ = rows.groupBy("case_id").agg(F.expr("bool_or(inner) AS some"), F.expr("count(1) AS mask_n"))
    rows = rows.join(any_, "case_id")
    core = rows.where("inner OR NOT some")
    stats = quantiles.robust_stats(core, ["case_id"], "hu").join(
        quantiles.exact_quantiles(core, ["case_id"], "hu", {"ceiling": 0.99}).select("case_id", "ceiling"), "case_id")
    per = rows.groupBy("case_id", "z", "mask_n").agg(F.expr("count(1) AS area"))  # one row per slice
    section = per.groupBy("case_id", "mask_n").agg(F.expr("median(area) AS section"))
    return stats.join(section, "case_id").selectExpr("*", "CASE WHEN p75 - p25 > 150 THEN p75 ELSE median END AS ref")


def flood_at(vox: DataFrame, wanted: DataFrame, s: Settings, cut: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Flood every case at its own threshold: cells, leak report per case, traversal cells.

    ``wanted``: ``case_id, f, ref, section, mask_n``; ``cut``: cells ``gid`` that are closed.
    """
    rounds = Rounds(vox.sparkSession, "attempt")
    bright = vox.join(wanted.select("case_id", "f", "ref"), "case_id").where("hu >= f * ref")
    opened = lattice.opening(bright).join(vox.select(*CELL, "gid", "in_mask"), CELL)
    opened, _ = rounds.save(opened if cut is None else opened.join(cut.select("gid"), "gid", "left_anti").select(*opened.columns))
    mask = vox.join(wanted.select("case_id"), "case_id", "left_semi").where("in_mask")
    inner = lattice.erode(mask).withColumn("seed", F.lit(True))
    marked = mask.select(*CELL).join(inner, CELL, "left")
    has = marked.groupBy("case_id").agg(F.expr("bool_or(coalesce(seed, false)) AS some"))
    seeds = marked.join(has, "case_id").where("seed OR NOT some").select(*CELL)
    parts = graph.label_cells(opened.where("in_mask"))
    seeded = parts.join(seeds, CELL, "left_semi").select("label").distinct()
    sources = parts.join(seeded, "label", "left_semi").select(*CELL, "gid")
    cells = graph.flood(opened.where("NOT in_mask"), sources, s.budget, lattice.millimetres(s.spacing), hops=s.hops)
    front = cells.where("dist > 0").groupBy("case_id").agg(
        sequence.dense_counts(f"cast(floor(dist / {s.band}D) AS int)", s.bands).alias("frontier"), F.expr("count(1) AS visited"))
    zero = f"array_repeat(0L, {s.bands})"
    report = wanted.join(front, "case_id", "left").withColumn("frontier", F.expr(f"coalesce(frontier, {zero})")).withColumn(
        "r", sequence.leak_report("frontier", "section", "coalesce(visited, 0)", "mask_n", n_bands=s.bands, band=s.band))
    return cells, report.selectExpr("case_id", "f", "r.leak AS leak", "r.reason AS reason"), opened


def search_threshold(vox: DataFrame, stats: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lowest threshold share at which the flood of a case does not leak: flood, ``case_id, f, leak``, traversal.

    All undecided cases try their next value together: the low end, then bisections, and the high end for
    cases that leaked throughout. Cases that settled above a leak then go on below it, with bone-like parts of the
    leak cut out (``descent.descend``).
    """
    rounds = Rounds(vox.sparkSession, "search")
    state, _ = rounds.save(stats.selectExpr("case_id", "ref", "section", "mask_n", f"{s.low}D AS lo", f"{s.high}D AS hi", f"{s.low}D AS f",
                                            "cast(NULL AS double) AS best", "false AS done"))
    tries = []
    for step in range(s.searches + 2):
        last = step == s.searches + 1
        todo = state.where("NOT done" + (" AND best IS NULL" if last else ""))
        if todo.isEmpty():
            break
        if last:
            todo = todo.withColumn("f", F.lit(s.high))
        cells, report, opened = flood_at(vox, todo, s)
        report, _ = rounds.save(report)
        tries.append((cells, report, opened))
        passed = "NOT leak" if step == 0 else "false"
        state, _ = rounds.save(state.join(report.selectExpr("case_id", "leak"), "case_id", "left").selectExpr(
            "case_id", "ref", "section", "mask_n",
            "CASE WHEN leak THEN f ELSE lo END AS lo", "CASE WHEN leak = false THEN f ELSE hi END AS hi",
            "CASE WHEN leak = false THEN f ELSE best END AS best", f"done OR coalesce({passed}, false) AS done").selectExpr(
            "*", "(lo + hi) / 2 AS f"))
    # the lowest passing attempt, otherwise the last one
    log = None
    for i, (_, report, _) in enumerate(tries):
        one = report.selectExpr("case_id", "f", "leak", f"{i} AS attempt")
        log = one if log is None else log.unionByName(one)
    chosen, _ = rounds.save(log.groupBy("case_id").agg(F.expr(
        "min_by(struct(f, leak, attempt), struct(leak, CASE WHEN leak THEN -f ELSE f END)) AS m")).selectExpr("case_id", "m.*"))

    def pick(at):
        out = None
        for i, one in enumerate(tries):
            part = one[at].join(chosen.where(f"attempt = {i}").select("case_id"), "case_id", "left_semi")
            out = part if out is None else out.unionByName(part)
        return out

    below = log.where("leak").join(chosen.where("NOT leak").selectExpr("case_id", "f AS top"), "case_id").where(
        "f < top").select("case_id").distinct()
    settled, todo = rounds.save(chosen.select("case_id", "f").join(below, "case_id").join(
        stats.select("case_id", "ref", "section", "mask_n", "ceiling"), "case_id"), n=F.expr("count(1)"))
    if not todo["n"]:
        return pick(0), chosen.select("case_id", "f", "leak"), pick(2)
    cells, opened, state, _ = descent.descend(
        settled, pick(0), pick(2), vox, lambda wanted, cut: flood_at(vox, wanted, s, cut), s.low,
        descent.MIN_MM3 / s.volume, s.step)
    chosen = chosen.join(state.selectExpr("case_id", "f AS lower"), "case_id", "left").selectExpr(
        "case_id", "coalesce(lower, f) AS f", "leak")
    return cells, chosen, opened


def components(fl: DataFrame, s: Settings) -> DataFrame:
    """Reached cells beyond the neck by part, with the neck cells that lead to each: ``..., label``."""
    reached = fl.where("dist > 0")
    core = graph.label_cells(reached.where(f"dist > {s.neck}")).select(*CELL, "gid", "label")
    neck = reached.where(f"dist <= {s.neck}").select(*CELL, "gid")
    stems = graph.tube_stems(neck, core, fl.select("gid", "dist"), lattice.millimetres(s.spacing), s.edge, s.budget, hops=s.hops)
    return reached.join(core.select("gid", "label").unionByName(stems), "gid")


def patches(members: DataFrame, vox: DataFrame, fl: DataFrame, s: Settings) -> DataFrame:
    """Contact patch cells and their origin: ``case_id, z, y, x, gid, label, origin, peak``.

    The patch of a part is where its ways leave the trunk. Its pieces, and the basins of the width measured along the
    trunk's shell, are the origins (``split.patch_field``, ``split.patch_origins``).
    """
    way = split.exits(fl).join(members.select("gid", "label"), "gid").select("label", F.col("exit").alias("gid")).distinct()
    spots, _ = Rounds(vox.sparkSession, "patches").save(fl.select(*CELL, "gid").join(way, "gid"))
    shell = lattice.rim(vox.where("in_mask").select(*CELL), lattice.FULL)
    shape = vox.agg(*[F.expr(f"max({c}) + 1 AS {c}") for c in "zyx"]).first()
    field = split.patch_field(spots.select("case_id", "label", "z", "y", "x"), shell, tuple(shape), lattice.millimetres(s.spacing))
    cells, origins = split.patch_origins(field, split.MIN_PEAK + 0.5 * sum(s.spacing) / 3)
    own = cells.where("NOT filled").select("label", "z", "y", "x", "origin")
    return spots.join(own, ["label", "z", "y", "x"]).join(origins.select("origin", "peak"), "origin").select(
        *CELL, "gid", "label", "origin", "peak")


def analyse(vox: DataFrame, s: Settings = Settings(), run: Stages | None = None) -> DataFrame:
    """Features of every traced instance. ``vox``: ``case_id BIGINT, z, y, x, gid, hu, in_mask``; ids unique over cases.

    With ``run`` finished stages of an earlier call under the same folder are taken from there.
    """
    run = run or Stages.fresh(vox.sparkSession, "cases")
    return run.one("features", lambda: _analysed(vox, s, run))


def _analysed(vox: DataFrame, s: Settings, run: Stages) -> DataFrame:
    stats = run.one("lumen", lambda: lumen(vox))
    lit_ = stats.where(f"ref >= {s.contrast}")

    def searched():
        fl, chosen, opened = search_threshold(vox.join(lit_.select("case_id"), "case_id", "left_semi"), lit_, s)
        return fl, chosen.join(lit_.select("case_id", "ref"), "case_id"), opened

    fl, chosen, opened = run.save(["flood", "chosen", "opened"], searched)
    members = run.one("components", lambda: components(fl, s))
    patch = run.one("patches", lambda: patches(members, vox, fl, s))

    # trunk geometry
    trunk = run.one("trunk", lambda: centerline.trunk_parts(vox.where("in_mask").select(*CELL, "gid"), s.volume).where("kept").selectExpr(
        "case_id", "z", "y", "x", "gid", "label", *s.mm()))
    line = run.one("line", lambda: centerline.centreline(trunk.selectExpr("case_id", "label", "px AS x", "py AS y", "pz AS z"), min(s.spacing)))
    wall = run.one("wall", lambda: lattice.outward_normals(trunk, s.spacing).join(trunk.select(*CELL, "gid"), CELL).selectExpr(
        "case_id", "z AS cz", "gid AS id", *[f"{c} * {step}D AS {c}" for c, step in zip("xyz", s.spacing)], "nx", "ny", "nz"))
    caps = run.one("caps", lambda: centerline.end_caps(trunk, wall, line, s.spacing[0] * s.spacing[1], s.spacing[2], 2 * s.edge))
    grown = run.one("cap_cells", lambda: centerline.cap_cells(trunk, caps, 2.5, s.spacing))

    # reject whole parts, then split the rest
    size = members.groupBy("case_id", "label").agg(F.expr("max(dist) AS max_distance_mm"), F.expr("count(1) AS n"))
    first = trace.first_radius(members, s.neck, s.limits.min_length, s.volume)
    facing = centerline.cap_contact(patch.selectExpr("case_id", "label AS id", "z", "y", "x"), grown, caps).selectExpr(
        "case_id", "id AS label", "face AS cap_face_fraction", "local_radius", "touched").join(first, "label", "left").selectExpr(
        "case_id", "label", "cap_face_fraction", "local_radius", "touched", "CASE WHEN local_radius > 0 THEN radius / local_radius END AS radius_ratio")
    n_patch = patch.groupBy("case_id", "label").agg(F.expr("count(1) AS n_patch_voxels"))
    lead = members.selectExpr("case_id", "label", "dist", *s.mm()).selectExpr("case_id", "label", "dist", "px AS x", "py AS y", "pz AS z")
    tips = lead.groupBy("case_id", "label").agg(*[F.expr(f"max_by({c}, dist) - min_by({c}, dist) AS o{c}") for c in "xyz"],
                                                *[F.expr(f"min_by({c}, dist) AS f{c}") for c in "xyz"])
    axis = trace.principal_axis(lead.where("dist <= 10").join(tips, ["case_id", "label"]), ["case_id", "label"], ["ox", "oy", "oz"])
    beside = centerline.on_centreline(tips.selectExpr("case_id", "label AS id", "fx AS x", "fy AS y", "fz AS z"), line, 8.0)
    tilt = axis.join(beside.withColumnRenamed("id", "label"), ["case_id", "label"]).selectExpr(
        "case_id", "label", "degrees(acos(least(1D, abs(ax * tx + ay * ty + az * tz)))) AS angle_to_centerline_deg")
    judging = (size.join(n_patch, ["case_id", "label"], "left").join(facing, ["case_id", "label"], "left").join(tilt, ["case_id", "label"], "left")
              .selectExpr("*", "touched IS NOT NULL AS touches_cap").fillna({"n_patch_voxels": 0, "cap_face_fraction": 0.0})
              .withColumn("reason", rejection_reason(s.limits)))
    judged = run.one("judged", lambda: judging)
    fit = judged.where("reason IS NULL").select("label")
    kept = members.join(fit, "label", "left_semi")

    def parted():
        table, cells = split.instances(kept.select(*CELL, "gid", "dist", "parent").unionByName(
            fl.where("dist = 0").select(*CELL, "gid", "dist", "parent")), patch.join(fit, "label", "left_semi"), s.limits.min_length,
            split.MIN_PEAK + 0.5 * sum(s.spacing) / 3)
        part = members.groupBy("label").agg(F.expr("count(1) AS part_cells"))
        owner = cells.select("gid", "instance_id").join(members.select("gid", "label"), "gid").select("instance_id", "label").distinct()
        table = table.join(owner, "instance_id").join(part, "label")
        if s.per_case is not None:
            table = dedupe.first_per_case(table, "part_cells DESC, label, instance_id", s.per_case)
        return table.drop("label", "part_cells"), cells

    table, all_cells = run.save(["instances", "instance_cells"], parted)
    cells = run.one("traced_cells", lambda: all_cells.join(table.select("instance_id"), "instance_id", "left_semi").selectExpr(
        "*", *s.mm()).join(vox.select("gid", "hu"), "gid").join(members.select("gid", "label"), "gid"))
    tubes = run.one("tubularity", lambda: vesselness.tubularity(
        kept.select("case_id", "label", "z", "y", "x", "dist"), vox.select(*CELL, "hu").join(chosen.select("case_id", "ref"), "case_id"), s.spacing, s.neck))
    return measure(vox, s, Rounds(vox.sparkSession, "measure"), stats, fl, chosen, opened, trunk, line, wall, judged, tubes, grown, table, cells)


def measure(vox, s, rounds, stats, fl, chosen, opened, trunk, line, wall, judged, tubes, grown, table, cells) -> DataFrame:
    """Trace the instances and put their features side by side."""
    inst = cells.select("instance_id", "case_id", "label").distinct()
    forks = trace.bifurcations(cells.select(*CELL, "gid", "instance_id", "dist"), s.neck, s.edge)
    lim, _ = rounds.save(trace.limits(cells, forks))
    solo = cells.selectExpr("instance_id AS case_id", "z", "y", "x")
    ring = lattice.rim(solo).selectExpr("case_id AS instance_id", "xxhash64(z, y, x) AS id",
                                        *[f"{c} * {step}D AS {c}" for c, step in zip("xyz", s.spacing)])
    deep = trace.depths(cells.selectExpr("instance_id", "gid AS id", "px AS x", "py AS y", "pz AS z"), ring, 2 * s.edge)
    ends = trace.end_cells(cells.join(deep.selectExpr("id AS gid", "depth"), "gid").select("instance_id", "gid", "dist", "depth"), lim)
    path = trace.walk_back(ends.selectExpr("instance_id AS trace_id", "gid"), fl.select("gid", "parent"))
    path = path.join(fl.selectExpr("gid", "dist", *s.mm()), "gid").selectExpr("trace_id", "seq", "dist", "px AS x", "py AS y", "pz AS z")
    raw, _ = rounds.save(trace.with_arc(trace.smooth_paths(path)))
    lines, _ = rounds.save(trace.resample(raw))
    full = raw.groupBy("trace_id").agg(F.expr("max(arc) AS trace_length"))

    spots = cells.where("gid = exit")
    mid = spots.groupBy("instance_id", "case_id").agg(*[F.expr(f"avg(p{c}) AS {c}") for c in "xyz"],
                                                      F.expr(f"count(1) * {s.volume / max(s.spacing)}D AS patch_area"))
    # where the front narrows fastest within the first stretch
    bands = cells.join(full.selectExpr("trace_id AS instance_id", "least(6D, trace_length) AS stop"), "instance_id").selectExpr(
        "instance_id", "stop", "dist", "explode(sequence(0, 11)) AS k").where("0.5D + 0.5D * k <= stop + 1e-9D")
    area = bands.groupBy("instance_id", "k").agg(F.expr("count_if(dist >= 0.5D * k AND dist < 0.5D * k + 1) AS a"))
    o = "OVER (PARTITION BY instance_id ORDER BY k)"
    slope = area.selectExpr("instance_id", "k", f"count(1) OVER (PARTITION BY instance_id) AS n", f"(coalesce(lead(a) {o}, a) - coalesce(lag(a) {o}, a)) / "
                            f"(CASE WHEN lead(a) {o} IS NULL OR lag(a) {o} IS NULL THEN 1D ELSE 2D END) AS g")
    mouth = slope.groupBy("instance_id").agg(F.expr("CASE WHEN max(n) >= 3 THEN 0.5D + 0.5D * min_by(k, struct(g, k)) ELSE 0D END AS at"))
    opening = trace.at_arcs(lines.join(mouth.withColumnRenamed("instance_id", "trace_id"), "trace_id"), "array(at)")
    ost, _ = rounds.save(trace.ostium_estimates(mid.selectExpr("instance_id AS trace_id", "case_id", "x", "y", "z"), lines, opening,
                                                wall.select("case_id", "id", "x", "y", "z"), 2 * s.edge))

    # lumen centres along the trace
    lum = opened.where("NOT in_mask").selectExpr(*CELL, "true AS lumen")
    image = vox.join(chosen.select("case_id"), "case_id", "left_semi").join(lum, CELL, "left").selectExpr(*CELL, "hu", "coalesce(lumen, false) AS lumen")
    sx, sy, sz = s.spacing
    grid = (f"named_struct('spacing', array({sx}D, {sy}D, {sz}D), 'origin', array(0D, 0D, 0D), "
            "'direction', array(1D, 0D, 0D, 0D, 1D, 0D, 0D, 0D, 1D)) AS grid")
    level = inst.join(chosen, "case_id").selectExpr("instance_id AS trace_id", "case_id", "f * ref AS threshold", "ref AS ceiling")
    tan = trace.tangents(lines, "transform(sequence(0, cast(floor((total + 1e-9D) / 0.5D) AS int)), k -> k * 0.5D)").withColumnRenamed("k", "seq")
    st = lines.where(f"arc >= {trace.REFINE_FROM}").join(tan.where("tx IS NOT NULL"), ["trace_id", "seq"]).join(level, "trace_id").selectExpr(
        "case_id", "trace_id", "seq", "monotonically_increasing_id() AS plane_id", "x", "y", "z", "tx AS dx", "ty AS dy", "tz AS dz",
        "threshold", "ceiling", grid)
    st, _ = rounds.save(st)
    mids = planes.recentre(st, image, step=0.5).join(st.select("plane_id", "trace_id", "seq"), "plane_id")
    fine, _ = rounds.save(trace.refine(lines, ost.select("trace_id", "x", "y", "z"), mids.select("trace_id", "seq", "cx", "cy", "cz", "found")))
    seeds = trace.at_arcs(fine, f"array(least({trace.SEED_AT}D, total))").selectExpr(
        "trace_id", "x AS sx", "y AS sy", "z AS sz", f"want >= {trace.SEED_AT} - 1e-9D AS reached", "want AS seed_arc")
    seeds, _ = rounds.save(seeds)
    both = lines.where(f"arc <= {trace.FIT_LENGTH} + 1e-9D").join(seeds, "trace_id").join(
        ost.selectExpr("trace_id", "x AS ex", "y AS ey", "z AS ez"), "trace_id").selectExpr("*", "sx - ex AS ux", "sy - ey AS uy", "sz - ez AS uz")
    way = trace.principal_axis(both, ["trace_id"], ["ux", "uy", "uz"])
    seed_tan = trace.tangents(fine, f"array(least({trace.SEED_AT}D, total))")
    at_seed, _ = rounds.save(seeds.join(seed_tan, "trace_id").join(level, "trace_id").selectExpr(
        "case_id", "trace_id", "monotonically_increasing_id() AS plane_id", "sx AS x", "sy AS y", "sz AS z", "coalesce(tx, 0D) AS dx", "coalesce(ty, 0D) AS dy",
        "coalesce(tz, 1D) AS dz", "threshold", "ceiling", grid))
    section = planes.recentre(at_seed, image).join(at_seed.select("plane_id", "trace_id"), "plane_id").select("trace_id", "area")
    flat = planes.flatness(at_seed, image).join(at_seed.select("plane_id", "trace_id"), "plane_id").select("trace_id", "flatness")

    # radii from the front, brightness, trunk lookups
    r = lambda at, w: trace.radius_in_band(at, w, s.volume)
    front = cells.join(seeds.selectExpr("trace_id AS instance_id", "seed_arc"), "instance_id").groupBy("instance_id").agg(
        r("seed_arc", 2.0).alias("front_radius"), *[r(s.neck + d, 2.0).alias(f"o{i}") for i, d in enumerate((1.0, 1.5, 2.0))],
        r(2.0, 1.0).alias("flare_radius"), *[r(float(d), 2.0).alias(f"c{d}") for d in range(2, 9)], F.expr("max(dist) AS reach"))
    rs = ", ".join(f"c{d}" for d in range(2, 9))
    front = front.selectExpr("*", f"filter(transform(sequence(2, 8), d -> CASE WHEN d <= reach THEN get(array({rs}), d - 2) END), v -> v > 0) AS rs").selectExpr(
        "instance_id", "front_radius", "flare_radius", "get(array_sort(array(o0, o1, o2)), 1) AS origin_radius_mm", "size(rs) AS k",
        "aggregate(rs, 0D, (a, v) -> a + v) / greatest(size(rs), 1) AS m", "rs")
    front = front.selectExpr("*", "CASE WHEN k < 2 OR m = 0 THEN 0D ELSE sqrt(aggregate(rs, 0D, (a, v) -> a + (v - m) * (v - m)) / k) / m END AS radius_consistency_cv")
    # a case may send a third of all cells, so the medians are taken by counting
    core = quantiles.exact_quantiles(cells.where(f"dist > {s.neck}"), ["instance_id"], "hu", {"hu_median": 0.5})
    glow = cells.groupBy("instance_id").agg(F.expr("avg(hu) AS hu_mean"), F.expr("max(hu) AS hu_max"))
    near = centerline.on_centreline(ost.join(inst.selectExpr("instance_id AS trace_id", "case_id"), "trace_id").selectExpr(
        "case_id", "trace_id AS id", "x", "y", "z"), line, 8.0)
    whole = stats.selectExpr("case_id", f"sqrt(section * power({s.volume}D, 2D / 3) / pi()) AS case_radius")
    part = judged.select("label", "touches_cap", "cap_face_fraction", "radius_ratio", "local_radius").join(
        tubes.select("label", "median_response", "median_radius"), "label")
    ends_mm = grown.selectExpr("case_id", "xxhash64(z, y, x) AS id", *[f"{c} * {step}D AS {c}" for c, step in zip("xyz", s.spacing)])
    to_cap = nearest.nearest(ost.join(inst.selectExpr("instance_id AS trace_id", "case_id"), "trace_id").selectExpr(
        "case_id", "trace_id AS id", "x", "y", "z"), ends_mm, ["case_id"], 8.0, default=999.0)

    touching = patch_partners(spots.selectExpr("case_id", "instance_id", "gid AS id", "px AS x", "py AS y", "pz AS z"), s.gap)

    wide = (table.join(inst.select("instance_id", "label"), "instance_id")
            .join(lim, "instance_id").join(mid.select("instance_id", "patch_area"), "instance_id")
            .join(ost.withColumnRenamed("trace_id", "instance_id"), "instance_id")
            .join(seeds.withColumnRenamed("trace_id", "instance_id"), "instance_id")
            .join(way.selectExpr("trace_id AS instance_id", "ax", "ay", "az"), "instance_id", "left")
            .join(section.withColumnRenamed("trace_id", "instance_id"), "instance_id", "left")
            .join(flat.withColumnRenamed("trace_id", "instance_id"), "instance_id", "left")
            .join(fine.groupBy(F.expr("trace_id AS instance_id")).agg(F.expr("max(arc) AS fine_length")), "instance_id")
            .join(full.withColumnRenamed("trace_id", "instance_id"), "instance_id")
            .join(front, "instance_id").join(core.select("instance_id", "hu_median"), "instance_id", "left").join(glow, "instance_id")
            .join(near.selectExpr("id AS instance_id", "tx", "ty", "tz", "position"), "instance_id", "left")
            .join(to_cap.selectExpr("id AS instance_id", "dist AS distance_to_cap_mm"), "instance_id", "left")
            .join(part, "label").join(touching, "instance_id", "left").join(chosen, "case_id").join(whole, "case_id"))
    radius = "CASE WHEN area > 0 THEN sqrt(area / pi()) ELSE front_radius END"
    off, flag = trace.radius_check(F.expr(radius), F.col("front_radius"))
    return wide.withColumns({"off": off, "flag": flag}).selectExpr(
        "case_id", "instance_id AS id", "label AS component_label", "x", "y", "z", "sx", "sy", "sz", "ax", "ay", "az", "vessel_join_mm", "truncated_by",
        "coalesce(partners, cast(array() AS array<bigint>)) AS partners",
        "CASE WHEN truncated_by = 'bifurcation' THEN least(fine_length, trace_length) ELSE fine_length END AS traced_length_mm",
        "cast(truncated_by = 'bifurcation' AS double) AS truncated_by_bifurcation", "cast(truncated_by = 'vessel_end' AS double) AS truncated_by_vessel_end",
        "cast(reached AS double) AS reached_seed_distance", "hu_mean - ref AS mean_hu_relative_to_lumen", "hu_max - ref AS peak_hu_relative_to_lumen",
        f"{radius} AS radius_at_seed_mm", "origin_radius_mm", "0.3D AS origin_radius_uncertainty_mm", "radius_consistency_cv",
        "off AS radius_disagreement", "cast(flag AS double) AS radius_disagreement_flag",
        "CASE WHEN local_radius > 0 THEN local_radius ELSE case_radius END AS nearby_aortic_radius_mm",
        "cast(coalesce(local_radius > 0, false) AS double) AS nearby_aortic_radius_is_local", "patch_area AS patch_area_mm2",
        "CASE WHEN flare_radius > 0 THEN patch_area / (pi() * flare_radius * flare_radius) ELSE 0D END AS ostium_flare_ratio",
        "coalesce(flatness, 1D) AS cross_section_flatness",
        "coalesce(degrees(acos(least(1D, abs(ax * tx + ay * ty + az * tz)))), 90D) AS angle_to_centerline_deg",
        "coalesce(position, 0.5D) AS normalized_position_along_aorta", "distance_to_cap_mm",
        "cast(touches_cap AS double) AS touches_cap", "cap_face_fraction", "coalesce(radius_ratio, 0D) AS cap_radius_ratio",
        "median_response AS vesselness_median_response", "median_radius AS vesselness_median_radius_mm", "max_disagreement AS ostium_max_disagreement_mm",
        "mean_disagreement AS ostium_mean_disagreement_mm", "greatest(0D, least(2D, (coalesce(hu_median, f * ref) - f * ref) / greatest(ref - f * ref, 1e-6D))) AS leak_margin",
        "cast(leak AS double) AS case_flood_leaking", "cast(size(vessel_join_mm) AS double) AS shares_vessel_with_count",
        "cast(n_absorbed AS double) AS n_absorbed_narrow_pieces")


def patch_partners(spots: DataFrame, gap: float) -> DataFrame:
    """Instances of a case whose contact patches come within ``gap``: ``instance_id, partners`` ."""
    near = nearest.within_distance(spots, spots, ["case_id"], gap).select("id", "other").where("id <> other")
    own = spots.select("id", "instance_id")
    pairs = near.join(own, "id").join(own.selectExpr("id AS other", "instance_id AS partner"), "other").where(
        "instance_id <> partner").select("instance_id", "partner").distinct()
    return pairs.groupBy("instance_id").agg(F.expr("collect_set(partner) AS partners"))


def in_patient_space(rows: DataFrame, grids: DataFrame, points: list[str], vectors: list[str]) -> DataFrame:
    """Array columns of ``rows`` from grid axes (index times spacing) to patient axes.

    ``grids``: ``case_id, origin, direction`` (row-major 3 x 3); a case without a grid keeps its axes.
    """
    both = rows.join(grids.selectExpr("case_id", "origin AS _o", "direction AS _d"), "case_id", "left")
    turned = "transform(array(0, 1, 2), i -> {o}_d[3 * i] * {c}[0] + _d[3 * i + 1] * {c}[1] + _d[3 * i + 2] * {c}[2])"
    for names, o in ((points, "_o[i] + "), (vectors, "")):
        for c in names:
            both = both.withColumn(c, F.expr(f"CASE WHEN _d IS NULL THEN {c} ELSE {turned.format(o=o, c=c)} END"))
    return both.drop("_o", "_d")


def report(features: DataFrame, cases: DataFrame, s: Settings = Settings(), grids: DataFrame | None = None) -> DataFrame:
    """Nested predictions: score, accept, fold, number and assemble. ``cases``: ``case_id``; with ``grids``
    (``case_id, origin, direction``) positions and directions are published in patient space.

    Two findings of different components count once when their ostia are close and their contact patches touch.
    """
    rows = explain(features.drop("vessel_join_mm"), s.limits, with_terms=False)  # maps cannot be ordered
    close = f"k.component_label <> x.component_label AND {dedupe.distance()} <= {s.merge} AND array_contains(x.partners, k.id)"
    kept = dedupe.fold(rows, "struct(-confidence AS c, id AS i)", close, s.merge, f"confidence >= {s.limits.threshold}").where("folded_into IS NULL")
    ranked = kept.selectExpr("*", "row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, id) AS position")
    rows = ranked.selectExpr(
        "case_id", "position", "format_string('branch_%03d', position) AS instance_id", "'aorta' AS parent_instance_id",
        "array(x, y, z) AS ostium_xyz_mm", "array(sx, sy, sz) AS seed_xyz_mm", "radius_at_seed_mm AS radius_mm", "array(ax, ay, az) AS direction_xyz")
    if grids is not None:
        rows = in_patient_space(rows, grids, ["ostium_xyz_mm", "seed_xyz_mm"], ["direction_xyz"])
    return schema.assemble(rows, cases, s.per_case)


def prepare(slices: DataFrame, target: float = grids.TARGET, margin: float = grids.MARGIN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decoded files on one working grid: voxels for ``analyse``, cases as ``grids.numbered`` gives them, problems.

    Image and mask of a case must share a grid; cases may differ in shape, spacing and axes. Each is cropped to its
    trunk before it is resampled. Problems (``case_id, problem``) name every case that is left out and why.
    """
    rounds = Rounds(slices.sparkSession, "intake")
    good, bad = volumes.load_pairs(slices)
    vox, _ = rounds.save(volumes.voxels(slices, good).drop("vid"))
    own, _ = rounds.save(good.select("case_id", "grid.*"))
    cut, box = grids.crop_to_mask(vox, own, margin)
    box, _ = rounds.save(box)
    cases, _ = rounds.save(grids.numbered(grids.target_grids(box, target)))
    empty = own.join(box, "case_id", "left_anti").selectExpr("case_id", "'empty mask' AS problem")
    return grids.with_numbers(grids.resample_cases(cut, box, target), cases), cases, bad.unionByName(empty)


def run_key(files: DataFrame, s: Settings, target: float, margin: float) -> str:
    """Name of a run: its settings and the paths, sizes and times of its files, whose contents are not read."""
    seen = files.agg(F.expr("count(1) AS n"), F.expr("bit_xor(xxhash64(path, length, modificationTime)) AS h")).first()
    return hashlib.sha256(repr((s, target, margin, seen.n, seen.h)).encode()).hexdigest()[:32]


def detect(spark: SparkSession, root: str, s: Settings = Settings(), target: float = grids.TARGET, margin: float = grids.MARGIN,
           runs: str | None = None, wanted: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """From files to records: predictions of all cases below ``root`` in patient space, and a problem per case left out.

    With ``runs``, a shared folder, a call that was cut off goes on after its last finished stage as long as files and
    settings are the same.
    """
    s = replace(s, spacing=(target, target, target))
    if runs is None:
        run = Stages.fresh(spark, "detect")
    else:
        run = Stages(spark, os.path.join(runs, run_key(volumes.list_files(spark, root, wanted), s, target, margin)))
    vox, cases, problems = run.save(["voxels", "cases", "problems"], lambda: prepare(
        volumes.read_slices(volumes.list_cases(spark, root, wanted)), target, margin))
    made = report(analyse(vox, s, run), cases.select("case_id"), s, cases.select("case_id", "origin", "direction"))
    named = made.join(cases.selectExpr("cast(case_id AS string) AS case_id", "name"), "case_id")
    return named.select(F.col("name").alias("case_id"), "parent", "daughters"), problems


def perturbed(s: Settings, change: dict) -> Settings:
    """Settings of one run of ``studies.stability_runs``."""
    limits = replace(s.limits, min_length=change["min_length"], threshold=change["threshold"])
    return replace(s, budget=change["budget"], low=change["low"], high=change["high"], limits=limits)


def stability(vox: DataFrame, cases: DataFrame, s: Settings = Settings(), runs: str | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """How findings bear changed parameters and added noise: findings and cases as ``studies`` gives them.

    ``cases``: ``case_id``. Every run analyses all cases together. Runs that differ from an earlier one only in what is
    reported share its features, and with ``runs``, a shared folder named by input and settings, a study that was cut off
    goes on after its last finished stage. Noise is drawn once per level and kept, so a lost task cannot draw it anew.
    """
    spark = vox.sparkSession
    root = runs or Stages.fresh(spark, "stability").root
    base = {"run": 0, "budget": s.budget, "low": s.low, "high": s.high, "min_length": s.limits.min_length,
            "threshold": s.limits.threshold, "sigma": 0.0}
    plan = studies.stability_runs(*[base[k] for k in ("budget", "low", "high", "min_length", "threshold")])
    seen = None
    for one in [base, *plan]:
        setting = perturbed(s, one)
        traced = {k: v for k, v in one.items() if k not in ("run", "name", "threshold")}
        run = Stages(spark, os.path.join(root, hashlib.sha256(repr(sorted(traced.items())).encode()).hexdigest()[:16]))
        own = vox if not one["sigma"] else run.one("voxels", lambda sigma=one["sigma"]: studies.with_noise(vox, "hu", sigma, seed))
        found = schema.explode_daughters(report(analyse(own, setting, run), cases, setting)).selectExpr(
            f"{one['run']} AS run", "case_id", "cast(position AS bigint) AS id", *[f"ostium_xyz_mm[{i}] AS {c}" for i, c in enumerate("xyz")])
        seen = found if seen is None else seen.unionByName(found)
    seen = Stages(spark, root).one("reported", lambda: seen)
    names = [r["name"] for r in plan]
    fates, new = studies.compare_runs(seen.where("run = 0").drop("run"), seen.where("run > 0"), names)
    findings = studies.finding_stability(fates, names)
    return findings, studies.case_stability(cases.selectExpr("cast(case_id AS string) AS case_id"), findings, new, len(names))
