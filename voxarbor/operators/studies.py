"""Cohort studies over scored findings: sweeps, plateaus, stability, plausibility, structural claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.operators import matching
from voxarbor.operators.quantiles import exact_quantiles, modified_z, robust_stats

# Fixed values of the studies.
THRESHOLDS = tuple(round(0.05 * k, 2) for k in range(1, 20))
BUDGET_FRACTIONS = (0.5, 0.7, 0.85, 1.0, 1.3, 1.6, 2.0)
PERTURBATIONS = (-0.20, -0.10, 0.10, 0.20)
NOISE_SIGMAS = (15.0, 30.0, 50.0)
LOCAL_DELTA, STEP_TOLERANCE, STABILITY_FLOOR = 0.02, 0.20, 0.9
SAME_POINT, MOVED = 5.0, 2.0  # millimetres
FRACTION_FLOOR, FRACTION_CEILING = 0.05, 0.95
OUTLIER_Z, PLAUSIBLE_RADIUS = 3.5, (0.5, 15.0)


def rows_of(column: str, values: Sequence[float]) -> str:
    return "inline(array(" + ", ".join(f"named_struct('{column}', {v!r}D)" for v in values) + "))"


def threshold_sweep(kept: DataFrame, cases: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
                    delta: float = LOCAL_DELTA) -> DataFrame:
    """Totals and means per threshold. ``kept``: ``case_id, confidence``; ``cases``: ``case_id, length``.

    A row's fate in the greedy walk depends only on rows above it, so what is kept at a threshold is
    the part of one walk above that threshold: one pass serves the whole grid.
    """
    per = kept.selectExpr("case_id", "confidence", rows_of("threshold", thresholds)).groupBy("case_id", "threshold").agg(
        F.expr("count_if(confidence >= threshold) AS n"),
        F.expr(f"count_if(confidence >= greatest(0D, threshold - {delta}D)) AS lo"),
        F.expr(f"count_if(confidence >= least(1D, threshold + {delta}D)) AS hi"))
    every = cases.selectExpr("case_id", "length", rows_of("threshold", thresholds))
    full = every.join(per, ["case_id", "threshold"], "left").selectExpr(
        "threshold", "coalesce(n, 0) AS n", "length",
        "CASE WHEN coalesce(lo, 0) = 0 THEN 1D ELSE hi / cast(lo AS double) END AS stable")
    return full.groupBy("threshold").agg(
        F.expr("avg(n) AS mean_n"), F.expr("sum(n) AS total_n"),
        F.expr("avg(CASE WHEN length > 0 THEN n / (length / 100D) END) AS mean_density"),
        F.expr("avg(stable) AS mean_stability"))


def plateau(grid: DataFrame, x: str, anchor: float, tolerance: float = STEP_TOLERANCE,
            floor: float = STABILITY_FLOOR) -> DataFrame:
    """Grid points around the anchor reachable by small steps through stable points: with ``in_plateau``.

    ``grid`` is the swept aggregate, one row per grid value, so one window over all of it is bounded by
    the length of the parameter grid.
    """
    one = grid.selectExpr("*", f"row_number() OVER (ORDER BY {x}) AS i",
                          f"lag(total_n) OVER (ORDER BY {x}) AS before", f"lead(total_n) OVER (ORDER BY {x}) AS after",
                          f"first_value({x}) OVER (ORDER BY abs({x} - {anchor}D), {x}) AS _a")

    def ok(a: str, b: str) -> str:
        return (f"(({a} = 0 AND {b} = 0) OR abs({a} - {b}) / cast(greatest({a}, {b}, 1) AS double) <= {tolerance}D)"
                f" AND mean_stability >= {floor}D")

    steps = one.selectExpr(
        "*", f"CASE WHEN {x} < _a THEN NOT coalesce({ok('total_n', 'after')}, false) "
        f"WHEN {x} > _a THEN NOT coalesce({ok('total_n', 'before')}, false) ELSE false END AS stop")
    # no stop between a point and the anchor, the point included
    marked = steps.selectExpr(
        "*", f"CASE WHEN {x} <= _a THEN coalesce(bool_or(stop AND {x} < _a) OVER (ORDER BY {x} DESC), false) "
        f"ELSE coalesce(bool_or(stop AND {x} > _a) OVER (ORDER BY {x}), false) END AS cut")
    return marked.selectExpr(x, "total_n", "mean_stability", "NOT cut AS in_plateau")


def plateau_summary(marked: DataFrame, x: str) -> DataFrame:
    inside = marked.agg(F.expr("count(1) AS points"), *[F.expr(e) for e in (
        f"min(CASE WHEN in_plateau THEN {x} END) AS lower", f"max(CASE WHEN in_plateau THEN {x} END) AS upper",
        "count_if(in_plateau) AS size", "avg(CASE WHEN in_plateau THEN total_n END) AS mean_total",
        "avg(CASE WHEN in_plateau THEN mean_stability END) AS mean_stability")])
    return inside.selectExpr("lower", "upper", "upper - lower AS width", "true AS contains_current_default",
                             "size = 1 AND points > 1 AS on_a_cliff", "mean_total", "mean_stability")


def perturbations(base: dict[str, float], fractions: Sequence[float] = PERTURBATIONS) -> list[dict]:
    """One run per parameter and fraction: ``run``, its name and the value of every parameter."""
    runs = []
    for name in base:
        for f in fractions:
            runs.append({"run": len(runs) + 1, "name": f"{name}{f:+.0%}", **base, name: base[name] * (1 + f)})
    return runs


def stability_runs(budget: float, low: float, high: float, min_length: float, threshold: float,
                   fractions: Sequence[float] = PERTURBATIONS, sigmas: Sequence[float] = NOISE_SIGMAS) -> list[dict]:
    """All runs of a stability study: ``run`` from 1, ``name``, the five parameters and ``sigma`` of the added noise.

    A run changes one parameter by one fraction, both ends of the threshold range together and within fixed limits, or
    none of them and adds noise.
    """
    base = {"budget": budget, "low": low, "high": high, "min_length": min_length, "threshold": threshold, "sigma": 0.0}
    clip = lambda v: min(FRACTION_CEILING, max(FRACTION_FLOOR, v))
    changes = [(f"budget{f:+.0%}", {"budget": budget * (1 + f)}) for f in fractions]
    changes += [(f"range{f:+.0%}", {"low": clip(low * (1 + f)), "high": clip(high * (1 + f))}) for f in fractions]
    changes += [(f"min_length{f:+.0%}", {"min_length": min_length * (1 + f)}) for f in fractions]
    changes += [(f"threshold{f:+.0%}", {"threshold": threshold * (1 + f)}) for f in fractions]
    changes += [(f"noise_{s:g}", {"sigma": float(s)}) for s in sigmas]
    return [{"run": i, "name": name, **base, **change} for i, (name, change) in enumerate(changes, 1)]


def compare_runs(base: DataFrame, other: DataFrame, names: Sequence[str], reach: float = SAME_POINT,
                 moved: float = MOVED) -> tuple[DataFrame, DataFrame]:
    """What every run of a study did to the findings: fates of the baseline, and how many findings were new.

    ``base``: ``case_id, id, x, y, z``; ``other`` the same with ``run``, a position in ``names`` counted from 1. Runs meet the
    baseline by one-to-one assignment within ``reach``; (run, case) is the unit of it, so all runs are one plan. Fates:
    ``case_id, id, run, present, distance, moved``, one row for each finding and run. New: ``case_id, run, appeared``, where any.
    """
    runs = f"explode(sequence(1, {len(names)})) AS run"
    cols = ["named_struct('case_id', case_id, 'run', run) AS case_id", "id", "x", "y", "z"]
    every = base.selectExpr("case_id", "id", "x", "y", "z", runs)
    found = other.selectExpr("case_id", "cast(run AS int) AS run", "id", "x", "y", "z")
    pairs = matching.match(found.selectExpr(*cols), every.selectExpr(*cols), reach).selectExpr("case_id.*", "pred_id", "ref_id", "distance")
    fates = every.selectExpr("case_id", "id", "run").join(
        pairs.selectExpr("case_id", "run", "ref_id AS id", "distance"), ["case_id", "run", "id"], "left").selectExpr(
        "case_id", "id", "run", "distance IS NOT NULL AS present", "distance", f"coalesce(distance > {moved}D, false) AS moved")
    new = found.join(pairs.selectExpr("case_id", "run", "pred_id AS id"), ["case_id", "run", "id"], "left_anti").groupBy(
        "case_id", "run").agg(F.expr("count(1) AS appeared"))
    return fates, new


def finding_stability(fates: DataFrame, names: Sequence[str]) -> DataFrame:
    """``case_id, id, stability`` and the names of the runs in which a finding went or moved, in the order of the runs."""
    listed = ", ".join("'" + n.replace("'", "\\'") + "'" for n in names)

    def where(rule):
        return f"transform(array_sort(collect_list(CASE WHEN {rule} THEN run END)), r -> element_at(array({listed}), r))"

    return fates.groupBy("case_id", "id").agg(
        F.expr(f"count_if(present AND NOT moved) / {float(len(names))}D AS stability"),
        F.expr(f"{where('NOT present')} AS disappeared_in"), F.expr(f"{where('moved')} AS moved_in"))


def case_stability(cases: DataFrame, findings: DataFrame, new: DataFrame, runs: int) -> DataFrame:
    """Per case: findings, their mean stability, runs with new findings; the share of those only where nothing was to be found.

    ``cases``: ``case_id``; ``findings``: ``case_id, stability``; ``new``: ``case_id, run, appeared``.
    """
    mean = findings.groupBy("case_id").agg(F.expr("count(1) AS n"), F.expr("avg(stability) AS mean"))
    events = new.groupBy("case_id").agg(F.expr("count(1) AS events"), F.expr("sum(appeared) AS appeared"))
    return cases.select("case_id").join(mean, "case_id", "left").join(events, "case_id", "left").selectExpr(
        "case_id", "coalesce(n, 0) AS n_baseline", "mean AS case_stability", "coalesce(events, 0) AS appearance_events",
        "coalesce(appeared, 0) AS appeared", f"CASE WHEN n IS NULL THEN coalesce(events, 0) / {float(runs)}D END AS spurious_rate")


def with_noise(vox: DataFrame, value: str, sigma: float, seed: int = 0) -> DataFrame:
    """Add seeded Gaussian noise to a voxel value."""
    return vox.withColumn(value, F.col(value) + F.randn(seed) * float(sigma))


def stability(base: DataFrame, fates: DataFrame, runs: int) -> DataFrame:
    """Share of runs in which each baseline finding stays put: ``case_id, id, stability``.

    ``fates`` holds ``case_id, id`` for every run where the finding is present and has not moved.
    """
    stays = fates.groupBy("case_id", "id").agg(F.expr("count(1) AS n"))
    return base.select("case_id", "id").join(stays, ["case_id", "id"], "left").selectExpr(
        "case_id", "id", f"coalesce(n, 0) / {float(runs)}D AS stability")


def case_density_flags(per_case: DataFrame) -> DataFrame:
    """``case_id, n, density`` to flags: outlying density and empty cases (both may apply)."""
    one = per_case.withColumn("cohort", F.lit(1))
    stats = robust_stats(one.where("density IS NOT NULL"), ["cohort"], "density").select("cohort", "median", "mad")
    z = modified_z(F.col("density"), F.col("median"), F.col("mad"))
    return one.join(F.broadcast(stats), "cohort", "left").withColumn("z", z).selectExpr("case_id", f"""
        inline(filter(array(
            named_struct('reason', 'branch_density_outlier', 'hit', coalesce(abs(z) > {OUTLIER_Z}D, false), 'modified_z', z),
            named_struct('reason', 'zero_detections', 'hit', n = 0, 'modified_z', cast(NULL AS double))), f -> f.hit))
        """).drop("hit")


def radius_flags(found: DataFrame, plausible: tuple[float, float] = PLAUSIBLE_RADIUS, limit: float = OUTLIER_Z) -> DataFrame:
    """Implausible radii first, otherwise outliers in the cohort."""
    one = found.withColumn("cohort", F.lit(1))
    stats = robust_stats(one, ["cohort"], "radius_mm").select("cohort", "median", "mad")
    z = modified_z(F.col("radius_mm"), F.col("median"), F.col("mad"))
    return one.join(F.broadcast(stats), "cohort").withColumn("z", z).selectExpr(
        "case_id", "id", "radius_mm", f"CASE WHEN radius_mm NOT BETWEEN {plausible[0]} AND {plausible[1]} THEN "
        f"'implausible_radius' WHEN abs(z) > {limit}D THEN 'radius_outlier_in_cohort' END AS reason",
        f"CASE WHEN radius_mm BETWEEN {plausible[0]} AND {plausible[1]} THEN z END AS modified_z").where("reason IS NOT NULL")


def plausibility_summary(found: DataFrame) -> DataFrame:
    """Cohort profile of ``radius_mm``, ``angle_to_centerline_deg`` and the share at a cap."""
    one = found.withColumn("cohort", F.lit(1))
    probs = {"median": 0.5, "p05": 0.05, "p95": 0.95}
    out = one.groupBy("cohort").agg(
        F.expr("count(1) AS detections"), F.expr("avg(radius_mm) AS radius_mean"),
        F.expr("avg(angle_to_centerline_deg) AS angle_mean"),
        F.expr("avg(cast(touches_cap > 0.5D AS int)) AS cap_share"))
    for short, column in (("radius", "radius_mm"), ("angle", "angle_to_centerline_deg")):
        q = exact_quantiles(one, ["cohort"], column, probs)
        out = out.join(q.selectExpr("cohort", *[f"{p} AS {short}_{p}" for p in probs]), "cohort", "left")
    return out.drop("cohort")


def claims(probes: DataFrame, near: DataFrame) -> DataFrame:
    """Check count-type claims: ``case_id, claim, kind, passed``.

    ``probes``: ``case_id, id, claim, kind, reach``; ``near``: ``case_id, id, other, dist`` of findings around
    each probe. Kinds: ``none`` (nothing within reach), ``some``, ``one`` (exactly one).
    """
    hits = probes.join(near, ["case_id", "id"], "left").groupBy("case_id", "id", "claim", "kind").agg(
        F.expr("count_if(dist <= reach) AS n"))
    return hits.selectExpr("case_id", "id", "claim", "kind", "n", "CASE kind WHEN 'none' THEN n = 0 "
                           "WHEN 'some' THEN n >= 1 WHEN 'one' THEN n = 1 END AS passed")


def distinct_pair(matches: DataFrame) -> DataFrame:
    """Two probes of a case must each have a match, and not the same one. ``matches``: ``case_id, id, nn``."""
    return matches.groupBy("case_id").agg(
        F.expr("count(1) = 2 AND count(nn) = 2 AND count(DISTINCT nn) = 2 AS passed"))
