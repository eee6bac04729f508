"""Scored detection reports. Cases are customers, findings are their orders.

Features come from whole-number sums over the order lines, so both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor import schema
from voxarbor.functions.rules import Limits, explain, rejection_reason
from voxarbor.operators import dedupe
from voxarbor.plans.points import folded
from voxarbor.plans.registry import query
from voxarbor.sources.tables import table

LIM = Limits()
MERGE_MM, GAP_MM, PER_CASE = 3.0, 1.5, 40  # the last only where a report lists the first findings

# expressions shared by both dialects; s(um) q(uantity) c(ents) d(iscount) t(ax)
FEATURES = {
    "traced_length_mm": "1.5 * n + 1.0",
    "reached_seed_distance": "CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END",
    "mean_hu_relative_to_lumen": "(sc / m - cc / cm) / 10000.0",
    "radius_at_seed_mm": "sq / m / 10.0",
    "origin_radius_mm": "qmin / 10.0 + 0.3",
    "origin_radius_uncertainty_mm": "0.3",
    "nearby_aortic_radius_mm": "6.0",
    "radius_consistency_cv": "sqrt(greatest(sqq / m - (sq / m) * (sq / m), 0.0)) / greatest(sq / m, 1.0)",
    "cross_section_flatness": "1.0 + sd / m / 4.0",
    "angle_to_centerline_deg": "10.0 + st / m * 12.0",
    "ostium_max_disagreement_mm": "(qmax - qmin) / 12.0",
    "ostium_flare_ratio": "0.5 + sd / m / 10.0",
    "leak_margin": "st / m / 8.0",
    "touches_cap": "CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END",
    "cap_radius_ratio": "sd / m / 14.0",
    "case_flood_leaking": "CASE WHEN cn > 60.0 THEN 1.0 ELSE 0.0 END",
    "shares_vessel_with_count": "CASE WHEN n >= 7 THEN 1.0 ELSE 0.0 END",
}
PLACE = {"x": "days / 50.0", "y": "o_totalprice / 25000.0", "z": "prio"}


def _double(sql: str) -> str:
    """Spark reads 1.5 as a decimal; both engines must compute in doubles."""
    import re

    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1D", sql)


def findings(spark, sf) -> DataFrame:
    """``case_id, id``, place, component and the feature columns of every order; one without lines counts nothing."""
    orders = table(spark, sf, "orders").selectExpr(
        "o_custkey AS case_id", "o_orderkey AS id", "o_orderstatus", "o_totalprice",
        "cast(datediff(o_orderdate, date'1995-01-01') AS double) AS days",
        "cast(substring(o_orderpriority, 1, 1) AS double) AS prio")
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS id", "cast(l_quantity AS bigint) AS q", "cast(round(l_extendedprice * 100) AS bigint) AS c",
        "cast(round(l_discount * 100) AS bigint) AS d", "cast(round(l_tax * 100) AS bigint) AS t")
    sums = lines.groupBy("id").agg(*[F.expr(f"cast({e} AS double) AS {n}") for n, e in {
        "n": "count(1)", "sq": "sum(q)", "sqq": "sum(q * q)", "sc": "sum(c)", "sd": "sum(d)", "st": "sum(t)",
        "qmin": "min(q)", "qmax": "max(q)"}.items()])
    own = orders.join(sums, "id", "left").fillna(0.0, ["n", "sq", "sqq", "sc", "sd", "st", "qmin", "qmax"])
    whole = own.groupBy("case_id").agg(F.expr("sum(sc) AS cc"), F.expr("sum(n) AS cn"))
    own = own.join(whole, "case_id").selectExpr("*", "greatest(n, 1D) AS m", "greatest(cn, 1D) AS cm")
    return own.selectExpr(
        "case_id", "id", "n", "sq", "o_orderstatus", "cast(prio AS int) AS component_label",
        *[f"{_double(e)} AS {c}" for c, e in PLACE.items()],
        *[f"cast({_double(e)} AS double) AS {c}" for c, e in FEATURES.items()])


FINDINGS = f"""od AS (SELECT o_custkey AS case_id, o_orderkey AS id, o_orderstatus, o_totalprice,
    date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE AS days,
    CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS prio FROM orders),
ln AS (SELECT l_orderkey AS id, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c,
    CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t FROM lineitem),
sm AS (SELECT id, count(*)::DOUBLE AS n, sum(q)::DOUBLE AS sq, sum(q * q)::DOUBLE AS sqq, sum(c)::DOUBLE AS sc,
    sum(d)::DOUBLE AS sd, sum(t)::DOUBLE AS st, min(q)::DOUBLE AS qmin, max(q)::DOUBLE AS qmax FROM ln GROUP BY 1),
ow AS (SELECT od.*, {", ".join(f"coalesce({c}, 0.0)::DOUBLE AS {c}" for c in ("n", "sq", "sqq", "sc", "sd", "st", "qmin", "qmax"))},
    greatest(coalesce(n, 0), 1.0)::DOUBLE AS m FROM od LEFT JOIN sm USING (id)),
ca AS (SELECT case_id, sum(sc) AS cc, sum(n) AS cn, greatest(sum(n), 1.0)::DOUBLE AS cm FROM ow GROUP BY 1),
fe AS (SELECT case_id, id, n, sq, o_orderstatus, CAST(prio AS INT) AS component_label,
    {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in PLACE.items())},
    {", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in FEATURES.items())}
  FROM ow JOIN ca USING (case_id))"""

_RAMPS = [("angle_to_centerline_deg", 45.0, 15.0, 0.30), ("cross_section_flatness", 1.6, 3.0, 0.20),
          ("-mean_hu_relative_to_lumen", 60.0, 200.0, 0.20), ("ostium_max_disagreement_mm", 2.0, 6.0, 0.15),
          ("radius_at_seed_mm / nearby_aortic_radius_mm", 0.35, 0.70, 0.20), ("ostium_flare_ratio", 1.0, 0.6, 0.15),
          ("radius_consistency_cv", 0.35, 0.90, 0.10), ("leak_margin", 0.5, 0.0, 0.15)]


def scored_sql(length: str = "5.0", radius: str = "1.0") -> str:
    total = ("(CASE WHEN case_flood_leaking > 0.5 THEN 0.15::DOUBLE ELSE 0.0 END + "
             "CASE WHEN shares_vessel_with_count > 0 THEN 0.05::DOUBLE ELSE 0.0 END)")
    for v, onset, full, weight in _RAMPS:
        total += (f" + greatest(0.0, least(1.0, ({v} - {onset}::DOUBLE) / {full - onset!r}::DOUBLE))"
                  f" * {weight}::DOUBLE")
    return f"""{FINDINGS},
pe AS (SELECT *, {total} AS total_penalty,
    CASE WHEN traced_length_mm < {length} THEN 'too_short' WHEN reached_seed_distance < 0.5 THEN 'seed_not_reached'
         WHEN origin_radius_mm + origin_radius_uncertainty_mm + 1e-6 < {radius} THEN 'origin_radius'
         WHEN radius_at_seed_mm <= 0 THEN 'seed_radius'
         WHEN touches_cap > 0.5 AND cap_radius_ratio > 0.4 THEN 'cap_radius'
         WHEN touches_cap > 0.5 AND angle_to_centerline_deg <= 25 THEN 'cap_angle' END AS veto FROM fe),
sc AS (SELECT *, CASE WHEN veto IS NOT NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - total_penalty)) END AS confidence FROM pe)"""


def kept_sql(threshold: float = 0.65) -> str:
    return f"""{scored_sql()},
ac AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(confidence, 9) DESC, id) AS rk
       FROM sc WHERE round(confidence, 9) >= {threshold}),
cf AS (SELECT a.case_id, a.rk, list(b.rk) AS hits FROM ac a JOIN ac b ON a.case_id = b.case_id AND b.rk < a.rk
       AND a.component_label <> b.component_label
       AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= {MERGE_MM}
       AND abs(a.y - b.y) <= {GAP_MM} GROUP BY ALL),
walk AS (SELECT case_id, 0::BIGINT AS rk, []::BIGINT[] AS kept, NULL::BIGINT AS folded FROM ac GROUP BY 1
   UNION ALL
   SELECT w.case_id, a.rk,
     CASE WHEN len(list_intersect(w.kept, coalesce(cf.hits, []))) > 0 THEN w.kept ELSE list_append(w.kept, a.rk) END,
     list_min(list_intersect(w.kept, coalesce(cf.hits, [])))
   FROM walk w JOIN ac a ON a.case_id = w.case_id AND a.rk = w.rk + 1
   LEFT JOIN cf ON cf.case_id = a.case_id AND cf.rk = a.rk),
nm AS (SELECT ac.*, w.folded IS NULL AS kept, t.id AS folded_into FROM ac JOIN walk w USING (case_id, rk)
       LEFT JOIN ac t ON t.case_id = w.case_id AND t.rk = w.folded),
rp AS (SELECT *, CAST(row_number() OVER (PARTITION BY case_id ORDER BY rk) AS INT) AS position FROM nm WHERE kept)"""


def scored(spark, sf, lim: Limits = LIM, with_terms: bool = False) -> DataFrame:
    return explain(findings(spark, sf), lim, with_terms=with_terms)


NEAR = (f"k.component_label <> x.component_label AND {dedupe.distance()} <= {MERGE_MM}D "
        f"AND abs(k.y - x.y) <= {GAP_MM}D")
RANK = "struct(-round(confidence, 9) AS c, id AS i)"


def merged(rows: DataFrame, threshold: float | str = LIM.threshold) -> DataFrame:
    """Accepted findings with ``folded_into``.

    Findings of different components whose ostia and patches are close count once.
    """
    return dedupe.fold(rows, RANK, NEAR, MERGE_MM, f"round(confidence, 9) >= {threshold}")


def numbered(rows: DataFrame) -> DataFrame:
    """Kept findings with their position by descending confidence and the record id."""
    return rows.where("folded_into IS NULL").selectExpr(
        "*", "row_number() OVER (PARTITION BY case_id ORDER BY round(confidence, 9) DESC, id) AS position",
    ).withColumn("instance_id", F.expr("format_string('branch_%03d', position)"))


@query("scored_detection_report", f"""
WITH RECURSIVE {kept_sql()}
SELECT case_id, id, position, printf('branch_%03d', position) AS instance_id, round(confidence, 6) AS confidence,
       round(total_penalty, 6) AS total_penalty, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z,
       round(radius_at_seed_mm, 6) AS radius_mm FROM rp""")
def scored_detection_report(spark, sf):
    """Score every finding, drop the doubtful, fold duplicates, number the rest."""
    return numbered(merged(scored(spark, sf))).selectExpr(
        "case_id", "id", "position", "instance_id", "round(confidence, 6) AS confidence",
        "round(total_penalty, 6) AS total_penalty", "round(x, 6) AS x", "round(y, 6) AS y", "round(z, 6) AS z",
        "round(radius_at_seed_mm, 6) AS radius_mm")


@query("rule_score_explain", f"""
WITH {scored_sql()}
SELECT id, veto, round(total_penalty, 6) AS total_penalty, round(confidence, 6) AS confidence,
  {", ".join(f"round(greatest(0.0, least(1.0, ({v} - {o}::DOUBLE) / {f - o!r}::DOUBLE)) * {w}::DOUBLE, 6) AS term{i}" for i, (v, o, f, w) in enumerate(_RAMPS))}
FROM sc""")
def rule_score_explain(spark, sf):
    """Every finding with its veto and the penalty of each of the eight terms."""
    return scored(spark, sf, with_terms=True).selectExpr(
        "id", "veto", "round(total_penalty, 6) AS total_penalty", "round(confidence, 6) AS confidence",
        *[f"round(terms[{i}].penalty, 6) AS term{i}" for i in range(8)])


@query("veto_summary", f"""
WITH {scored_sql()}
SELECT coalesce(veto, 'none') AS veto, count(*) AS n, count(*) FILTER (WHERE round(confidence, 9) >= 0.65) AS accepted
FROM sc GROUP BY 1""")
def veto_summary(spark, sf):
    return scored(spark, sf).groupBy(F.expr("coalesce(veto, 'none') AS veto")).agg(
        F.expr("count(1) AS n"), F.expr("count_if(round(confidence, 9) >= 0.65D) AS accepted"))


@query("ordered_rejection", f"""
WITH {FINDINGS}
SELECT id, CASE WHEN n <= 1 THEN 'no_contact_patch'
  WHEN touches_cap > 0.5 AND cap_radius_ratio >= 0.5 THEN 'end_cap'
  WHEN touches_cap > 0.5 AND (cap_radius_ratio > 0.4 OR angle_to_centerline_deg <= 25) THEN 'aortic_continuation'
  WHEN traced_length_mm < 5 THEN 'too_short' END AS reason FROM fe""")
def ordered_rejection(spark, sf):
    rows = findings(spark, sf).selectExpr(
        "id", "CASE WHEN n <= 1 THEN 0 ELSE n END AS n_patch_voxels", "touches_cap > 0.5D AS touches_cap",
        "cap_radius_ratio AS cap_face_fraction", "cap_radius_ratio AS radius_ratio", "angle_to_centerline_deg",
        "traced_length_mm AS max_distance_mm")
    return rows.select("id", rejection_reason().alias("reason"))


@query("nms_merge", f"""
WITH RECURSIVE {kept_sql(0.3)}
SELECT case_id, id, kept, folded_into FROM nm""")
def nms_merge(spark, sf):
    """Which accepted findings fold into which kept one, at a low acceptance threshold."""
    return merged(scored(spark, sf), 0.3).selectExpr("case_id", "id", "folded_into IS NULL AS kept", "folded_into")


@query("rank_and_assign_ids", """
WITH f AS (SELECT o_custkey AS case_id, o_orderkey AS id, o_totalprice AS p FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY p DESC, id) AS k FROM f)
SELECT case_id, id, CAST(k AS INT) AS position, printf('branch_%03d', k) AS instance_id FROM r""")
def rank_and_assign_ids(spark, sf):
    """First 40 in list order, then numbered by descending value."""
    f = dedupe.first_per_case(table(spark, sf, "orders").selectExpr(
        "o_custkey AS case_id", "o_orderkey AS id", "o_totalprice AS p"), "id", PER_CASE)
    return f.selectExpr("case_id", "id", "row_number() OVER (PARTITION BY case_id ORDER BY p DESC, id) AS position",
                        ).withColumn("instance_id", F.expr("format_string('branch_%03d', position)"))


@query("finding_status", f"""
WITH RECURSIVE {kept_sql()}
SELECT sc.id, CASE WHEN veto IS NOT NULL THEN 'VETOED' WHEN nm.id IS NULL THEN 'BELOW_THRESHOLD'
  WHEN nm.kept THEN 'KEPT' ELSE 'MERGED' END AS status,
  CASE WHEN veto IS NOT NULL THEN 'veto:' || veto WHEN nm.folded_into IS NOT NULL THEN 'into:' || nm.folded_into END AS note
FROM sc LEFT JOIN (SELECT id, kept, folded_into FROM nm) nm USING (id)""")
def finding_status(spark, sf):
    """What happened to each finding, one line each."""
    rows = scored(spark, sf)
    return status_lines(rows, merged(rows)).select("id", "status", "note")


def status_lines(rows: DataFrame, fate: DataFrame) -> DataFrame:
    fate = fate.selectExpr("id", "folded_into", "true AS accepted")
    return rows.join(fate, "id", "left").selectExpr(
        "case_id", "id", "confidence",
        "CASE WHEN veto IS NOT NULL THEN 'VETOED' WHEN accepted IS NULL THEN 'BELOW_THRESHOLD' "
        "WHEN folded_into IS NULL THEN 'KEPT' ELSE 'MERGED' END AS status",
        "CASE WHEN veto IS NOT NULL THEN concat('veto:', veto) "
        "WHEN folded_into IS NOT NULL THEN concat('into:', folded_into) END AS note")


def daughters(spark, sf) -> DataFrame:
    """Kept findings as published daughter rows; the direction is the unit step from ostium to seed."""
    rows = numbered(merged(scored(spark, sf))).selectExpr("*", "0.5D + n / 4 AS dx", "1.0D AS dy", "sq / 100 AS dz")
    rows = rows.selectExpr("*", "sqrt(dx * dx + dy * dy + dz * dz) AS len")
    return rows.selectExpr(
        "case_id", "position", "instance_id", "'aorta' AS parent_instance_id", "array(x, y, z) AS ostium_xyz_mm",
        "array(x + 5 * dx / len, y + 5 * dy / len, z + 5 * dz / len) AS seed_xyz_mm",
        "radius_at_seed_mm AS radius_mm", "array(dx / len, dy / len, dz / len) AS direction_xyz")


@query("nested_predictions", f"""
WITH RECURSIVE {kept_sql()}
SELECT CAST(c.c_custkey AS VARCHAR) AS case_id, coalesce(r.n, 0) AS n, r.first AS first_id, r.last AS last_id,
       round(coalesce(r.radius, 0), 6) AS radius_sum, true AS valid
FROM customer c LEFT JOIN (SELECT case_id, count(*) AS n, printf('branch_%03d', min(position)) AS first,
    printf('branch_%03d', max(position)) AS last, sum(radius_at_seed_mm) AS radius FROM rp GROUP BY 1) r
  ON r.case_id = c.c_custkey""")
def nested_predictions(spark, sf):
    """One validated nested record per case, also for cases without findings, through JSON and back."""
    cases = table(spark, sf, "customer").selectExpr("c_custkey AS case_id")
    made = schema.public_fields(schema.assemble(daughters(spark, sf), cases))
    text = made.selectExpr("case_id", "to_json(struct(case_id, parent, daughters)) AS doc")
    back = text.selectExpr("case_id AS key", f"from_json(doc, '{schema.PREDICTION}') AS p").selectExpr("key", "p.*")
    return schema.validate(back).selectExpr(
        "key AS case_id", "cast(size(daughters) AS bigint) AS n", "get(daughters, 0).instance_id AS first_id",
        "get(daughters, size(daughters) - 1).instance_id AS last_id",
        "round(aggregate(daughters, 0D, (s, d) -> s + d.radius_mm), 6) AS radius_sum", "problem IS NULL AS valid")


@query("schema_validate", f"""
WITH v AS (SELECT vec_id, label, {folded(0, 1, "DOUBLE")} AS a, {folded(1, 1, "DOUBLE")} AS b, {folded(2, 1, "DOUBLE")} AS c FROM embeddings),
n AS (SELECT *, sqrt(a * a + b * b + c * c) AS len FROM v),
d AS (SELECT vec_id, label, a, b, c,
        CASE WHEN label = 3 THEN -0.5 ELSE 1.5 END AS radius,
        CASE WHEN label = 5 THEN 2.0 WHEN label = 7 THEN -1.0 ELSE 1.0 END AS k,
        CASE WHEN label = 1 THEN 'vessel_1' ELSE 'branch_001' END AS inst,
        CASE WHEN label = 2 THEN 'vein' ELSE 'aorta' END AS par,
        CASE WHEN label = 9 THEN 0 ELSE 1 END AS shift FROM n)
SELECT vec_id, CASE WHEN inst <> 'branch_001' THEN 'instance_id' WHEN par <> 'aorta' THEN 'parent_instance_id'
  WHEN label = 4 THEN 'seed_xyz_mm' WHEN radius <= 0 THEN 'radius_mm' WHEN label = 6 THEN 'direction_xyz'
  WHEN abs(k) <> 1 THEN 'direction_norm' WHEN shift = 0 THEN 'seed_equals_ostium'
  WHEN k < 0 THEN 'direction_inward' END AS problem FROM d""")
def schema_validate(spark, sf):
    """Records built from vectors, each label broken in its own way; the first broken rule is named."""
    v = table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label", *[f"{folded(i, 0, 'double')} AS {c}" for i, c in enumerate("abc")])
    v = v.selectExpr("*", "sqrt(a * a + b * b + c * c) AS len")
    d = v.selectExpr(
        "vec_id", "1 AS position", "CASE WHEN label = 1 THEN 'vessel_1' ELSE 'branch_001' END AS instance_id",
        "CASE WHEN label = 2 THEN 'vein' ELSE 'aorta' END AS parent_instance_id", "array(a, b, c) AS ostium_xyz_mm",
        "CASE WHEN label = 4 THEN array(a, b) WHEN label = 9 THEN array(a, b, c) ELSE array(2 * a, 2 * b, 2 * c) END AS seed_xyz_mm",
        "CASE WHEN label = 3 THEN -0.5D ELSE 1.5D END AS radius_mm",
        "CASE WHEN label = 6 THEN array(a, b, double('nan')) ELSE transform(array(a, b, c), e -> e / len * "
        "CASE WHEN label = 5 THEN 2 WHEN label = 7 THEN -1 ELSE 1 END) END AS direction_xyz")
    return d.selectExpr("vec_id", f"{schema.problem()} AS problem")
