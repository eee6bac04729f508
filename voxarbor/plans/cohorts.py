"""Cohort study queries over the scored findings, and queries on keys and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.functions.rules import Limits, explain
from voxarbor.functions.scalar import case_id_from_path
from voxarbor.operators import dedupe, nearest, studies
from voxarbor.plans import detection as det
from voxarbor.plans.points import SIDES, best_sql, order_sides
from voxarbor.plans.registry import query
from voxarbor.sources.tables import NZ, VOXELS_SQL, table, voxels

GRID = ", ".join(f"{t}" for t in studies.THRESHOLDS)


def kept(spark, sf, threshold: float = 0.03):
    rows = det.merged(det.scored(spark, sf), f"{threshold}D").where("folded_into IS NULL")
    return rows.withColumn("confidence", F.round("confidence", 9))


def case_lengths(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey AS case_id", "c_acctbal AS length")


SWEEP = f"""{det.kept_sql(0.03)},
kp AS (SELECT case_id, round(confidence, 9) AS c FROM nm WHERE kept),
tg AS (SELECT unnest([{GRID}])::DOUBLE AS threshold),
pc AS (SELECT cu.c_custkey AS case_id, cu.c_acctbal AS length, tg.threshold, count(kp.c) FILTER (WHERE c >= threshold) AS n,
  count(kp.c) FILTER (WHERE c >= greatest(0.0, threshold - 0.02::DOUBLE)) AS lo,
  count(kp.c) FILTER (WHERE c >= least(1.0, threshold + 0.02::DOUBLE)) AS hi
  FROM customer cu CROSS JOIN tg LEFT JOIN kp ON kp.case_id = cu.c_custkey GROUP BY ALL),
sw AS (SELECT threshold, avg(n) AS mean_n, CAST(sum(n) AS BIGINT) AS total_n,
  avg(CASE WHEN length > 0 THEN n / (length / 100.0) END) AS mean_density,
  avg(CASE WHEN lo = 0 THEN 1.0 ELSE hi / lo::DOUBLE END) AS mean_stability FROM pc GROUP BY 1)"""


@query("param_sweep", f"""
WITH RECURSIVE {SWEEP}
SELECT threshold, total_n, round(mean_n, 6) AS mean_n, round(mean_density, 6) AS mean_density,
       round(mean_stability, 6) AS mean_stability FROM sw""")
def param_sweep(spark, sf):
    """Findings per acceptance threshold and how much a small shift of it changes."""
    out = studies.threshold_sweep(kept(spark, sf), case_lengths(spark, sf))
    return out.selectExpr("threshold", "total_n", *[f"round({c}, 6) AS {c}" for c in ("mean_n", "mean_density", "mean_stability")])


@query("plateau_region", f"""
WITH RECURSIVE {SWEEP},
g AS (SELECT *, row_number() OVER (ORDER BY threshold) AS i, lag(total_n) OVER (ORDER BY threshold) AS b,
             lead(total_n) OVER (ORDER BY threshold) AS a, first_value(threshold) OVER (ORDER BY abs(threshold - 0.65), threshold) AS anc FROM sw),
k AS (SELECT *, CASE WHEN threshold < anc THEN (total_n = 0 AND a = 0) OR abs(total_n - a) / greatest(total_n, a, 1)::DOUBLE <= 0.20
   WHEN threshold > anc THEN (total_n = 0 AND b = 0) OR abs(total_n - b) / greatest(total_n, b, 1)::DOUBLE <= 0.20 ELSE true END
   AND (threshold = anc OR mean_stability >= 0.9) AS ok FROM g),
p AS (SELECT *, CASE WHEN threshold <= anc THEN (SELECT coalesce(bool_and(ok), true) FROM k j WHERE j.threshold >= k.threshold AND j.threshold < anc)
   ELSE (SELECT coalesce(bool_and(ok), true) FROM k j WHERE j.threshold <= k.threshold AND j.threshold > anc) END AS inside FROM k)
SELECT threshold, total_n, inside AS in_plateau FROM p""")
def plateau_region(spark, sf):
    """The part of the threshold grid around the default that can be reached by small, stable steps."""
    sweep = studies.threshold_sweep(kept(spark, sf), case_lengths(spark, sf))
    return studies.plateau(sweep, "threshold", 0.65).select("threshold", "total_n", "in_plateau")


RUNS = studies.perturbations({"threshold": 0.65, "min_length": 5.0, "min_radius": 1.0})


@query("stability_share", f"""
WITH RECURSIVE {det.FINDINGS},
rn AS (SELECT * FROM (VALUES {", ".join(f"({r['run']}, {r['threshold']!r}::DOUBLE, {r['min_length']!r}::DOUBLE, {r['min_radius']!r}::DOUBLE)" for r in [dict(run=0, threshold=0.65, min_length=5.0, min_radius=1.0)] + RUNS)}) t(run, th, ml, mr)),
fr AS (SELECT fe.* REPLACE (case_id * {len(RUNS) + 1} + run AS case_id), th, ml, mr FROM fe, rn),
{det.scored_sql("ml", "mr").split("fe AS (", 1)[1].split("),", 1)[1].split("pe AS", 1)[1].join(["pe AS", ""]).replace("FROM fe)", "FROM fr)")},
ac AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(confidence, 9) DESC, id) AS rk FROM sc WHERE round(confidence, 9) >= th),
{det.kept_sql().split("cf AS", 1)[1].join(["cf AS", ""])},
ba AS (SELECT case_id // {len(RUNS) + 1} AS case_id, id FROM rp WHERE case_id % {len(RUNS) + 1} = 0),
st AS (SELECT case_id // {len(RUNS) + 1} AS case_id, id, count(*) AS n FROM rp WHERE case_id % {len(RUNS) + 1} > 0 GROUP BY ALL)
SELECT CAST(ba.case_id AS BIGINT) AS case_id, ba.id, round(coalesce(n, 0) / {float(len(RUNS))}::DOUBLE, 6) AS stability
FROM ba LEFT JOIN st USING (case_id, id)""")
def stability_share(spark, sf):
    """Share of perturbed runs that still report a baseline finding. All runs go through one job."""
    n = len(RUNS) + 1
    base = dict(run=0, threshold=0.65, min_length=5.0, min_radius=1.0)
    rows = "inline(array(" + ", ".join(
        f"struct({r['run']} AS run, {r['threshold']!r}D AS th, {r['min_length']!r}D AS ml, {r['min_radius']!r}D AS mr)"
        for r in [base] + RUNS) + "))"
    many = det.findings(spark, sf).selectExpr("*", rows).withColumn("case_id", F.expr(f"case_id * {n} + run"))
    lim = Limits(min_length=F.col("ml"), min_radius=F.col("mr"))
    # every column is written thirteen times over: only those that folding reads
    rated = explain(many, lim, with_terms=False).select("case_id", "id", "run", "th", "x", "y", "z", "component_label", "confidence")
    kept = dedupe.fold_runs(rated, det.RANK, det.NEAR, det.MERGE_MM, "round(confidence, 9) >= th", f"case_id div {n}")
    found = kept.where("folded_into IS NULL").selectExpr(
        f"case_id div {n} AS case_id", "id", "run")
    per = found.groupBy("case_id", "id").agg(F.expr("count_if(run > 0) AS n"), F.expr("bool_or(run = 0) AS base"))
    return per.where("base").selectExpr("case_id", "id", f"round(n / {float(len(RUNS))}D, 6) AS stability")


# --- a study whose runs lose, move and add findings: dear orders of a customer ------------------------

STUDY = studies.stability_runs(15.0, 0.40, 0.90, 5.0, 0.65)
STUDY_NAMES = [r["name"] for r in STUDY]
PARAMETERS = ("budget", "low", "high", "min_length", "threshold", "sigma")
BASELINE = {"run": 0, "budget": 15.0, "low": 0.40, "high": 0.90, "min_length": 5.0, "threshold": 0.65, "sigma": 0.0}


def study_points(spark, sf):
    """Every order that a run reports, where the run sees it; run 0 is the baseline. One scan serves all runs."""
    rows = "inline(array(" + ", ".join(
        "struct(" + ", ".join([f"{r['run']} AS run", *[f"{r[p]!r}D AS {p}" for p in PARAMETERS]]) + ")" for r in [BASELINE, *STUDY]) + "))"
    o = table(spark, sf, "orders").selectExpr(
        "o_custkey AS case_id", "o_orderkey AS id", "o_totalprice / 400000.0D AS confidence", "3 + o_orderkey % 9 AS length",
        "10 + o_orderkey % 8 AS way", "(o_orderkey % 100) / 100D AS share", "cast(datediff(o_orderdate, date'1995-01-01') AS double) / 100 AS x",
        "o_totalprice / 25000.0D AS y", "cast(substring(o_orderpriority, 1, 1) AS double) AS z")
    return o.selectExpr("*", rows).where(
        "confidence >= threshold AND length >= min_length AND way <= budget AND share >= low - 0.2D AND share <= high").selectExpr(
        "run", "case_id", "id", "x + sigma / 50D * ((id * run) % 11 - 5) AS x", "y", "z")


def study(spark, sf):
    from voxarbor.session import Rounds

    seen, _ = Rounds(spark, "study").save(study_points(spark, sf))
    return studies.compare_runs(seen.where("run = 0").drop("run"), seen.where("run > 0"), STUDY_NAMES)


STUDY_SIDES = f"""rn(run, {", ".join(PARAMETERS)}) AS (VALUES {", ".join("(" + ", ".join([str(r["run"]), *[f"{r[p]!r}::DOUBLE" for p in PARAMETERS]]) + ")" for r in [BASELINE, *STUDY])}),
sp AS (SELECT run, o_custkey AS cust, o_orderkey AS id,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE / 100 + sigma / 50 * ((o_orderkey * run) % 11 - 5) AS x,
  o_totalprice / 25000.0 AS y, CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS z
  FROM orders, rn WHERE o_totalprice / 400000.0 >= threshold AND 3 + o_orderkey % 9 >= min_length AND 10 + o_orderkey % 8 <= budget
    AND (o_orderkey % 100) / 100.0::DOUBLE >= low - 0.2 AND (o_orderkey % 100) / 100.0::DOUBLE <= high),
ev AS (SELECT b.cust, b.id, n.run, b.cust * 32 + n.run AS case_id, b.x, b.y, b.z FROM sp b, rn n WHERE b.run = 0 AND n.run > 0),
p AS (SELECT cust * 32 + run AS case_id, id, x, y, z, row_number() OVER (PARTITION BY cust, run ORDER BY id) - 1 AS k FROM sp WHERE run > 0),
r AS (SELECT case_id, id, x, y, z, row_number() OVER (PARTITION BY case_id ORDER BY id) - 1 AS k FROM ev),
pt AS (SELECT case_id FROM p UNION ALL SELECT case_id FROM r)"""

STUDY_SQL = f"""{best_sql(STUDY_SIDES, studies.SAME_POINT)},
ft AS (SELECT ev.cust, ev.id, ev.run, hit.distance FROM ev LEFT JOIN hit ON hit.case_id = ev.case_id AND hit.ref_id = ev.id),
nm(run, name) AS (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(STUDY_NAMES, 1))}),
fs AS (SELECT cust AS case_id, id, count(*) FILTER (WHERE distance <= {studies.MOVED}) / {float(len(STUDY))}::DOUBLE AS stability,
  coalesce(string_agg(name, ',' ORDER BY run) FILTER (WHERE distance IS NULL), '') AS disappeared_in,
  coalesce(string_agg(name, ',' ORDER BY run) FILTER (WHERE distance > {studies.MOVED}), '') AS moved_in FROM ft JOIN nm USING (run) GROUP BY ALL)"""


@query("finding_stability", f"""
WITH RECURSIVE {STUDY_SQL}
SELECT case_id, id, round(stability, 6) AS stability, disappeared_in, moved_in FROM fs""")
def finding_stability(spark, sf):
    """Share of nineteen runs in which a finding stays where it was, and the runs in which it went or moved."""
    fates, _ = study(spark, sf)
    return studies.finding_stability(fates, STUDY_NAMES).selectExpr(
        "case_id", "id", "round(stability, 6) AS stability", "array_join(disappeared_in, ',') AS disappeared_in", "array_join(moved_in, ',') AS moved_in")


@query("case_stability", f"""
WITH RECURSIVE {STUDY_SQL},
nw AS (SELECT case_id // 32 AS cust, case_id % 32 AS run, count(*) AS appeared FROM p
       WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.case_id = p.case_id AND hit.pred_id = p.id) GROUP BY ALL),
ne AS (SELECT cust, count(*) AS events, sum(appeared) AS appeared FROM nw GROUP BY 1),
m AS (SELECT case_id, count(*) AS n, avg(stability) AS mean FROM fs GROUP BY 1)
SELECT c_custkey AS case_id, coalesce(n, 0) AS n_baseline, round(mean, 6) AS case_stability, coalesce(events, 0) AS appearance_events,
  CAST(coalesce(appeared, 0) AS BIGINT) AS appeared, round(CASE WHEN n IS NULL THEN coalesce(events, 0) / {float(len(STUDY))}::DOUBLE END, 6) AS spurious_rate
FROM customer LEFT JOIN m ON m.case_id = c_custkey LEFT JOIN ne ON ne.cust = c_custkey""")
def case_stability(spark, sf):
    """Stability of every customer, new findings under the runs, and their share where the baseline was empty."""
    fates, new = study(spark, sf)
    out = studies.case_stability(table(spark, sf, "customer").selectExpr("c_custkey AS case_id"),
                                 studies.finding_stability(fates, STUDY_NAMES), new, len(STUDY))
    return out.selectExpr("case_id", "n_baseline", "round(case_stability, 6) AS case_stability", "appearance_events", "appeared",
                          "round(spurious_rate, 6) AS spurious_rate")


@query("plausibility_flags", f"""
WITH RECURSIVE {det.kept_sql()},
s AS (SELECT median(radius_at_seed_mm) AS med FROM rp),
m AS (SELECT any_value(med) AS med, median(abs(radius_at_seed_mm - med)) AS mad FROM rp, s),
z AS (SELECT case_id, id, radius_at_seed_mm AS r, CASE WHEN mad = 0 THEN 0.0 ELSE 0.6745 * (radius_at_seed_mm - med) / mad END AS z FROM rp, m),
f AS (SELECT *, CASE WHEN r < 1.2 OR r > 4.2 THEN 'implausible_radius' WHEN abs(z) > 1.5 THEN 'radius_outlier_in_cohort' END AS reason FROM z)
SELECT case_id, id, round(r, 6) AS radius_mm, reason, round(CASE WHEN r BETWEEN 1.2 AND 4.2 THEN z END, 6) AS modified_z
FROM f WHERE reason IS NOT NULL""")
def plausibility_flags(spark, sf):
    """Radii outside the plausible range, otherwise far from the cohort."""
    found = kept(spark, sf, 0.65).selectExpr("case_id", "id", "radius_at_seed_mm AS radius_mm")
    return studies.radius_flags(found, (1.2, 4.2), 1.5).selectExpr(
        "case_id", "id", "round(radius_mm, 6) AS radius_mm", "reason", "round(modified_z, 6) AS modified_z")


@query("plausibility_summary", f"""
WITH RECURSIVE {det.kept_sql()}
SELECT count(*) AS detections, round(avg(radius_at_seed_mm), 6) AS radius_mean, round(avg(angle_to_centerline_deg), 6) AS angle_mean,
  round(avg(CAST(touches_cap > 0.5 AS INT)), 6) AS cap_share,
  {", ".join(f"round(quantile_cont({c}, {q}), 6) AS {s}_{n}" for s, c in (("radius", "radius_at_seed_mm"), ("angle", "angle_to_centerline_deg")) for n, q in (("median", 0.5), ("p05", 0.05), ("p95", 0.95)))}
FROM rp""")
def plausibility_summary(spark, sf):
    out = studies.plausibility_summary(kept(spark, sf, 0.65).withColumnRenamed("radius_at_seed_mm", "radius_mm"))
    return out.selectExpr(*[c if c == "detections" else f"round({c}, 6) AS {c}" for c in out.columns])


@query("case_density_flags", """
WITH d AS (SELECT c.c_custkey AS case_id, count(o.o_orderkey) AS n,
             CASE WHEN max(c_acctbal) > 0 THEN count(o.o_orderkey) / (max(c_acctbal) / 100.0) END AS density
           FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' GROUP BY 1),
s AS (SELECT median(density) AS med FROM d), m AS (SELECT any_value(med) AS med, median(abs(density - med)) AS mad FROM d, s WHERE density IS NOT NULL),
z AS (SELECT case_id, n, CASE WHEN mad = 0 THEN 0.0 ELSE 0.6745 * (density - med) / mad END AS z, density FROM d, m)
SELECT case_id, 'branch_density_outlier' AS reason, round(z, 6) AS modified_z FROM z WHERE density IS NOT NULL AND abs(z) > 3.5
UNION ALL SELECT case_id, 'zero_detections', NULL FROM z WHERE n = 0""")
def case_density_flags(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.expr("count(1) AS n"))
    c = table(spark, sf, "customer").join(o, F.expr("c_custkey = o_custkey"), "left").selectExpr(
        "c_custkey AS case_id", "coalesce(n, 0) AS n", "CASE WHEN c_acctbal > 0 THEN coalesce(n, 0) / (c_acctbal / 100D) END AS density")
    return studies.case_density_flags(c).selectExpr("case_id", "reason", "round(modified_z, 6) AS modified_z")


@query("structural_claims", f"""
WITH {SIDES},
pr AS (SELECT * REPLACE (CASE id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'some' ELSE 'one' END AS kind) FROM r),
h AS (SELECT pr.case_id, pr.id, any_value(pr.kind) AS kind,
  count(*) FILTER (WHERE sqrt((p.x - pr.x)*(p.x - pr.x) + (p.y - pr.y)*(p.y - pr.y) + (p.z - pr.z)*(p.z - pr.z)) <= 6) AS n
  FROM pr LEFT JOIN p ON p.case_id = pr.case_id GROUP BY ALL)
SELECT case_id, id, kind, n, CASE kind WHEN 'none' THEN n = 0 WHEN 'some' THEN n >= 1 ELSE n = 1 END AS passed FROM h""")
def structural_claims(spark, sf):
    """Nothing near, something near, exactly one near: checked around every open order."""
    preds, refs = order_sides(spark, sf)
    probes = refs.selectExpr("case_id", "id", "'near' AS claim", "6.0D AS reach",
                             "CASE id % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'some' ELSE 'one' END AS kind")
    near = nearest.within_distance(refs, preds, ["case_id"], 6.0)
    return studies.claims(probes, near).select("case_id", "id", "kind", "n", "passed")


@query("nearest_detection", f"""
WITH {SIDES}
SELECT r.case_id, r.id, arg_min(p.id, ROW(d, p.id)) AS nn, round(min(d), 6) AS dist FROM (
  SELECT r.case_id, r.id, p.id AS pid, sqrt((p.x - r.x)*(p.x - r.x) + (p.y - r.y)*(p.y - r.y) + (p.z - r.z)*(p.z - r.z)) AS d
  FROM r LEFT JOIN p USING (case_id)) q JOIN r ON r.id = q.id LEFT JOIN p ON p.id = q.pid GROUP BY ALL""")
def nearest_detection(spark, sf):
    """Closest reported point of the case for every probe; a case without any gives NULL."""
    preds, refs = order_sides(spark, sf)
    best = nearest.nearest(refs.select("case_id", "id", "x", "y", "z"), preds, ["case_id"])
    return best.selectExpr("case_id", "id", "nn", "round(dist, 6) AS dist")


@query("perturbation_matrix", f"""
SELECT o_orderpriority AS grp, run, count(*) FILTER (WHERE o_totalprice >= 250000 * f) AS n
FROM orders, (SELECT unnest([1, 2, 3, 4]) AS run, unnest([0.8, 0.9, 1.1, 1.2])::DOUBLE AS f) GROUP BY ALL""")
def perturbation_matrix(spark, sf):
    """Every group under every perturbed threshold, from one scan."""
    fs = "inline(array(" + ", ".join(f"struct({i} AS run, {1 + f!r}D AS f)" for i, f in enumerate(studies.PERTURBATIONS, 1)) + "))"
    o = table(spark, sf, "orders").selectExpr("o_orderpriority AS grp", "o_totalprice", fs)
    return o.groupBy("grp", "run").agg(F.expr("count_if(o_totalprice >= 250000 * f) AS n"))


@query("path_case_key", r"""
SELECT page_id, CASE WHEN length(parent) > 0 THEN parent ELSE regexp_replace(stem, '(\.nii\.gz|\.nii|\.[^.]+)$', '') END AS case_id
FROM (SELECT page_id, list_extract(string_split(url, '/'), -2) AS parent, list_extract(string_split(url, '/'), -1) AS stem FROM pages)""")
def path_case_key(spark, sf):
    """Key from a path: parent folder, else the file name without extension."""
    return table(spark, sf, "pages").select("page_id", case_id_from_path(F.col("url")).alias("case_id"))


@query("content_manifest", """
SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS bytes FROM documents""")
def content_manifest(spark, sf):
    """Hash and size of every whole content."""
    return table(spark, sf, "documents").selectExpr(
        "doc_id", "sha2(text, 256) AS sha256", "cast(octet_length(text) AS bigint) AS bytes")


@query("ray_depth_pick", f"""
WITH {VOXELS_SQL},
ref AS (SELECT case_id, CAST(median(hu) AS BIGINT) AS ref FROM vox WHERE in_mask GROUP BY 1),
v AS (SELECT vox.*, ref, hu > ref + 1500000 AS bone, abs(hu - ref) AS off FROM vox JOIN ref USING (case_id)),
b AS (SELECT a.*, EXISTS (SELECT 1 FROM v o WHERE o.case_id = a.case_id AND o.y = a.y AND o.x = a.x AND o.bone AND abs(o.z - a.z) <= 2) AS blocked FROM v a),
m AS (SELECT *, min(CASE WHEN NOT blocked THEN off END) OVER (PARTITION BY case_id, y, x) AS best,
         min(off) OVER (PARTITION BY case_id, y, x) AS any_best FROM b)
SELECT case_id, y, x, CAST(arg_min(z, ROW(abs(z - 4.5), z)) AS INT) AS z FROM m
WHERE CASE WHEN best IS NULL THEN off <= any_best + 20000 ELSE NOT blocked AND off <= best + 20000 END GROUP BY ALL""")
def ray_depth_pick(spark, sf):
    """Along each z ray: the cell closest to the trunk level, away from bone, ties towards the middle.

    A ray has at most NZ cells, so it is folded as one short array.
    """
    vox = voxels(spark, sf)
    ref = vox.where("in_mask").groupBy("case_id").agg(F.expr("cast(rint(percentile(hu, 0.5)) AS bigint) AS ref"))
    v = vox.join(ref, "case_id").selectExpr("case_id", "y", "x", "z", "hu > ref + 1500000 AS bone", "abs(hu - ref) AS off")
    ray = v.groupBy("case_id", "y", "x").agg(F.expr("collect_list(struct(z, bone, off)) AS r"))
    ray = ray.selectExpr("*", "filter(r, c -> NOT exists(r, o -> o.bone AND abs(o.z - c.z) <= 2)) AS free")
    ray = ray.selectExpr("case_id", "y", "x", "CASE WHEN size(free) > 0 THEN free ELSE r END AS c")
    tied = ray.selectExpr("case_id", "y", "x", "filter(c, k -> k.off <= array_min(transform(c, e -> e.off)) + 20000) AS c")
    return tied.selectExpr("case_id", "y", "x", f"get(array_sort(transform(c, k -> struct(abs(k.z - {(NZ - 1) / 2}D) AS d, k.z AS z))), 0).z AS z")


@query("probe_maximum", f"""
WITH {VOXELS_SQL}
SELECT a.gid, max(b.hu) AS brightest FROM vox a JOIN vox b
  ON b.case_id = a.case_id AND b.y = a.y AND b.x = a.x AND b.z BETWEEN a.z AND a.z + 3 GROUP BY 1""")
def probe_maximum(spark, sf):
    """Brightest value on the way of four steps along the normal."""
    vox = voxels(spark, sf)
    from voxarbor.operators import lattice

    told = lattice.announce(vox, [(-d, 0, 0) for d in range(4)], ["hu"])
    best = told.groupBy(*lattice.CELL).agg(F.expr("max(hu) AS brightest"))
    return vox.select(*lattice.CELL, "gid").join(best, lattice.CELL).select("gid", "brightest")


@query("scene_table", f"""
WITH RECURSIVE {det.kept_sql()},
c AS (SELECT (max(x) + min(x)) / 2 AS mx, (max(y) + min(y)) / 2 AS my, (max(z) + min(z)) / 2 AS mz FROM fe)
SELECT sc.case_id, sc.id, round(sc.x - mx, 6) AS x, round(sc.y - my, 6) AS y, round(sc.z - mz, 6) AS z,
  nm.id IS NOT NULL AND nm.kept AS accepted,
  CASE WHEN sc.veto IS NOT NULL THEN sc.veto WHEN nm.id IS NULL THEN 'below_threshold' WHEN NOT nm.kept THEN 'merged' END AS rejected_by
FROM sc CROSS JOIN c LEFT JOIN (SELECT id, kept FROM nm) nm ON nm.id = sc.id""")
def scene_table(spark, sf):
    """Display rows: centred positions, accepted or the reason why not."""
    from voxarbor.sources.scene import scene_rows

    from voxarbor.session import Rounds

    # display, centre and folding read the findings: written once, with the columns these need
    rows, _ = Rounds(spark, "scene").save(det.scored(spark, sf).select("case_id", "id", "x", "y", "z", "component_label", "confidence", "veto"))
    box = rows.agg(*[F.expr(f"(max({c}) + min({c})) / 2 AS m{c}") for c in "xyz"])
    out = scene_rows(rows, det.merged(rows), box)
    return out.selectExpr("case_id", "id", *[f"round({c}, 6) AS {c}" for c in "xyz"], "accepted", "rejected_by")
