"""Nearest-neighbour, matching, sampling and membership queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.functions.scalar import trapezoid
from voxarbor.operators import matching, nearest, sampling
from voxarbor.plans.registry import query
from voxarbor.plans.volumes import with_reference
from voxarbor.sources.tables import NX, NY, NZ, VOXELS_SQL, table, voxels


def folded(axis: int, first: int, kind: str) -> str:
    """Every third of the 64 vector components added up; ``first`` is the dialect's lowest index."""
    return " + ".join(f"cast(embedding[{i + first}] AS {kind})" for i in range(axis, 64, 3))


def vectors(spark, sf):
    """id, label and the whole embedding folded into a point."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "label", *[f"{folded(i, 0, 'double')} AS {c}" for i, c in enumerate("xyz")])


VEC = f"""v AS (SELECT vec_id AS id, label, {", ".join(f"{folded(i, 1, 'DOUBLE')} AS {c}" for i, c in enumerate("xyz"))} FROM embeddings)"""
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query("knn_embeddings", f"""
WITH {VEC}
SELECT a.id, arg_min(b.id, ROW({D2}, b.id)) AS nn, round(sqrt(min({D2})), 6) AS dist
FROM v a, v b WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY a.id""")
def knn_embeddings(spark, sf):
    v = vectors(spark, sf)
    out = nearest.nearest(v.where("id % 2 = 0"), v.where("id % 2 = 1"))
    return out.selectExpr("id", "nn", "round(dist, 6) AS dist")


@query("nearest_row_payload", f"""
WITH {VEC},
n AS (SELECT a.id, a.label, arg_min(b.id, ROW({D2}, b.id)) AS nn, min({D2}) AS d2
      FROM v a JOIN v b ON a.label = b.label AND b.id % 3 = 0 WHERE a.id % 3 <> 0 GROUP BY ALL)
SELECT n.id, n.label, nn, round(sqrt(d2), 6) AS dist, round(v.z, 6) AS tangent
FROM n JOIN v ON v.id = n.nn""")
def nearest_row_payload(spark, sf):
    """Nearest row of the same group together with a value it carries."""
    v = vectors(spark, sf)
    out = nearest.nearest(v.where("id % 3 <> 0"), v.where("id % 3 = 0"), ["label"])
    carry = v.selectExpr("id AS nn", "round(z, 6) AS tangent")
    return out.join(carry, "nn").selectExpr("id", "label", "nn", "round(dist, 6) AS dist", "tangent")


@query("nearest_of_sets", f"""
WITH {VEC}
SELECT c.id, round(coalesce(min(sqrt({D2.replace('a.', 'c.')})), 999.0), 6) AS dist
FROM (SELECT * FROM v WHERE label >= 2) c LEFT JOIN v b ON b.label < 2 AND b.x > 0.2 AND b.id <> c.id
GROUP BY c.id""")
def nearest_of_sets(spark, sf):
    """Distance to the nearest member of several sets, 999 when all are empty."""
    v = vectors(spark, sf)
    caps = v.where("label < 2 AND x > 0.2")
    return nearest.nearest(v.where("label >= 2"), caps, default=999.0).selectExpr("id", "round(dist, 6) AS dist")


@query("min_set_distance", f"""
WITH {VEC}
SELECT a.label AS a, b.label AS b, round(sqrt(min({D2})), 6) AS gap
FROM v a JOIN v b ON b.label = a.label + 1 GROUP BY ALL""")
def min_set_distance(spark, sf):
    """Smallest distance between the members of a label and those of the next one."""
    v = vectors(spark, sf)
    asked = v.selectExpr("label AS a", "label + 1 AS b", "id", "x", "y", "z")
    out = nearest.nearest(asked, v.withColumnRenamed("label", "b"), ["b"]).where("dist IS NOT NULL")
    return out.groupBy("a", "b").agg(F.expr("round(min(dist), 6) AS gap"))


@query("mutual_nearest_match", f"""
WITH {VEC},
l AS (SELECT a.id, arg_min(b.id, ROW({D2}, b.id)) AS nn, min({D2}) AS d2
      FROM v a, v b WHERE a.id % 2 = 0 AND b.id % 2 = 1 GROUP BY 1),
r AS (SELECT a.id, arg_min(b.id, ROW({D2}, b.id)) AS nn
      FROM v a, v b WHERE a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY 1)
SELECT l.id AS a, r.id AS b, round(sqrt(d2), 6) AS dist FROM l JOIN r ON l.nn = r.id AND r.nn = l.id""")
def mutual_nearest_match(spark, sf):
    v = vectors(spark, sf)
    even, odd = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    there = nearest.nearest(even, odd).selectExpr("id AS a", "nn AS b", "dist")
    back = nearest.nearest(odd, even).selectExpr("id AS b", "nn AS a")
    return there.join(back, ["a", "b"]).selectExpr("a", "b", "round(dist, 6) AS dist")


@query("pairs_within_reach", f"""
WITH {VEC}
SELECT a.id, b.id AS other, round(sqrt({D2}), 6) AS dist
FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE sqrt({D2}) <= 0.5""")
def pairs_within_reach(spark, sf):
    """All pairs of one label no farther apart than a fixed reach."""
    v = vectors(spark, sf)
    out = nearest.within_distance(v, v, ["label"], 0.5).where("id < other")
    return out.selectExpr("id", "other", "round(dist, 6) AS dist")


# --- one-to-one matching: finished and open orders of a customer --------------------------------

def order_points(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_custkey AS case_id", "o_orderkey AS id", "o_orderstatus AS kind",
        "cast(datediff(o_orderdate, date'1995-01-01') AS double) / 100 AS x",
        "o_totalprice / 25000.0D AS y", "cast(substring(o_orderpriority, 1, 1) AS double) AS z")


def order_sides(spark, sf):
    """Predictions: the finished orders of a customer. References: the open ones."""
    o = order_points(spark, sf)
    return o.where("kind = 'F'"), o.where("kind = 'O'")


SIDES = """pt AS (SELECT o_custkey AS case_id, o_orderkey AS id, o_orderstatus AS kind,
  date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::DOUBLE / 100 AS x, o_totalprice / 25000.0 AS y,
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS z FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) - 1 AS k FROM pt WHERE kind = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY id) - 1 AS k FROM pt WHERE kind = 'O')"""


def best_sql(sides: str, gate: float) -> str:
    """Optimum by dynamic programming over subsets of the smaller side."""
    return f"""{sides},
cnt AS (SELECT case_id, (SELECT count(*) FROM p WHERE p.case_id = c.case_id) AS np,
               (SELECT count(*) FROM r WHERE r.case_id = c.case_id) AS nr
        FROM (SELECT DISTINCT case_id FROM pt) c),
cost AS (SELECT p.case_id, p.id AS pid, r.id AS rid,
   CASE WHEN np <= nr THEN r.k ELSE p.k END AS step, CASE WHEN np <= nr THEN p.k ELSE r.k END AS bit,
   least(np, nr) AS need, greatest(np, nr) AS steps,
   sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y) + (p.z - r.z) * (p.z - r.z)) AS d
   FROM p JOIN r USING (case_id) JOIN cnt USING (case_id)),
dp AS (SELECT case_id, 0::BIGINT AS step, 0::BIGINT AS mask, 0.0::DOUBLE AS total, []::BIGINT[] AS pids, []::BIGINT[] AS rids,
              any_value(steps) AS steps, any_value(need) AS need FROM cost GROUP BY case_id
   UNION ALL
   SELECT case_id, step, mask, min(total), arg_min(pids, total), arg_min(rids, total), any_value(steps), any_value(need)
   FROM (SELECT case_id, step + 1 AS step, mask, total, pids, rids, steps, need FROM dp WHERE step < steps
         UNION ALL
         SELECT dp.case_id, dp.step + 1, dp.mask | (1::BIGINT << c.bit), dp.total + c.d, list_append(dp.pids, c.pid),
                list_append(dp.rids, c.rid), dp.steps, dp.need
         FROM dp JOIN cost c ON c.case_id = dp.case_id AND c.step = dp.step
         WHERE dp.step < dp.steps AND (dp.mask & (1::BIGINT << c.bit)) = 0)
   GROUP BY case_id, step, mask),
fin AS (SELECT * FROM dp WHERE step = steps AND mask = (1::BIGINT << need) - 1),
pair AS (SELECT case_id, unnest(pids) AS pred_id, unnest(rids) AS ref_id FROM fin),
hit AS (SELECT pair.*, cost.d AS distance FROM pair JOIN cost ON cost.case_id = pair.case_id AND cost.pid = pred_id AND cost.rid = ref_id WHERE cost.d <= {gate})"""


BEST = best_sql(SIDES, 10)


@query("assignment_match", f"""
WITH RECURSIVE {BEST}
SELECT case_id, pred_id, ref_id, round(distance, 6) AS distance FROM hit""")
def assignment_match(spark, sf):
    preds, refs = order_sides(spark, sf)
    return matching.match(preds, refs, 10.0).selectExpr("case_id", "pred_id", "ref_id", "round(distance, 6) AS distance")


@query("match_scores", f"""
WITH RECURSIVE {BEST},
t AS (SELECT cnt.case_id, np, nr, coalesce(h.n, 0) AS tp FROM cnt
      LEFT JOIN (SELECT case_id, count(*) AS n FROM hit GROUP BY 1) h USING (case_id) WHERE np + nr > 0)
SELECT case_id, tp, np - tp AS fp, nr - tp AS fn,
  round(CASE WHEN np > 0 THEN tp / np::DOUBLE ELSE 0 END, 6) AS precision,
  round(CASE WHEN nr > 0 THEN tp / nr::DOUBLE ELSE 0 END, 6) AS recall,
  round(2 * tp / (np + nr)::DOUBLE, 6) AS f1 FROM t""")
def match_scores(spark, sf):
    """True and false positives and misses per case, with the ratios."""
    preds, refs = order_sides(spark, sf)
    marks = matching.outcome(preds, refs, matching.match(preds, refs, 10.0))
    return matching.case_scores(marks).selectExpr(
        "case_id", "tp", "fp", "fn", *[f"round({c}, 6) AS {c}" for c in ("precision", "recall", "f1")])


@query("unmatched_anti_join", """
SELECT c.c_custkey AS id, 'missed' AS kind FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')
UNION ALL
SELECT DISTINCT o_custkey, 'surplus' FROM orders o WHERE o_orderstatus = 'F'
  AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal >= 0)""")
def unmatched_anti_join(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey AS id").distinct()
    cust = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal")
    missed = cust.select("id").join(done, "id", "left_anti").selectExpr("id", "'missed' AS kind")
    surplus = done.join(cust.where("c_acctbal >= 0"), "id", "left_anti").selectExpr("id", "'surplus' AS kind")
    return missed.unionByName(surplus)


@query("micro_macro_f1", """
WITH m AS (SELECT d.source AS case_id, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp,
                  count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fp,
                  count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fn
           FROM labels JOIN documents d USING (doc_id) GROUP BY 1),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1 FROM m),
t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
             count(*) AS cases, avg(f1) FILTER (WHERE tp + fn > 0) AS macro_f1 FROM f)
SELECT tp, fp, fn, cases, round(macro_f1, 6) AS macro_f1, round(tp / (tp + fp)::DOUBLE, 6) AS precision,
       round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM t""")
def micro_macro_f1(spark, sf):
    """Quality as the prediction, not toxic as the truth, one case per document source."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    marks = table(spark, sf, "labels").join(docs, "doc_id").selectExpr("source AS case_id", """
        CASE WHEN quality = 1 AND toxic = 0 THEN 'tp' WHEN quality = 1 THEN 'fp' WHEN toxic = 0 THEN 'fn' END AS kind""")
    out = matching.cohort_scores(matching.case_scores(marks))
    return out.selectExpr("tp", "fp", "fn", "cases", *[f"round({c}, 6) AS {c}" for c in ("macro_f1", "precision", "recall", "f1")])


# --- sampling and membership --------------------------------------------------------------------

@query("trilinear_sample", f"""
WITH {VOXELS_SQL},
k AS (SELECT range AS k FROM range(8)),
c AS (SELECT a.gid, (CASE WHEN k // 4 % 2 = 1 THEN 0.25 ELSE 0.75 END) * 0.5 *
             (CASE WHEN k % 2 = 1 THEN 0.75 ELSE 0.25 END) * coalesce(b.hu, -1000) AS p
      FROM vox a JOIN k ON true LEFT JOIN vox b ON b.case_id = a.case_id AND b.z = a.z + k // 4 % 2
           AND b.y = a.y + k // 2 % 2 AND b.x = a.x + k % 2)
SELECT gid, round(sum(p::DOUBLE), 3) AS sample FROM c GROUP BY 1""")
def trilinear_sample(spark, sf):
    """Every cell sampled a quarter, a half and three quarters of a step further on."""
    vox = voxels(spark, sf)
    pts = vox.selectExpr("case_id", "gid AS id", "z + 0.25D AS pz", "y + 0.5D AS py", "x + 0.75D AS px")
    return sampling.trilinear(pts, vox, "cast(hu AS double)", -1000.0).selectExpr("id AS gid", "round(sample, 3) AS sample")


@query("nearest_sample", f"""
WITH {VOXELS_SQL}
SELECT a.gid, coalesce(b.hu, 0)::DOUBLE AS sample
FROM vox a LEFT JOIN vox b ON b.case_id = a.case_id AND b.z = a.z + 1 AND b.y = a.y AND b.x = a.x + 1""")
def nearest_sample(spark, sf):
    vox = voxels(spark, sf)
    pts = vox.selectExpr("case_id", "gid AS id", "z + 0.6D AS pz", "y + 0.2D AS py", "x + 0.9D AS px")
    return sampling.nearest_cell(pts, vox, "cast(hu AS double)").selectExpr("id AS gid", "sample")


@query("isotropic_resample", f"""
WITH {VOXELS_SQL},
full_c AS (SELECT case_id FROM vox GROUP BY 1),
g AS (SELECT c.case_id, z.z, y.y, x.x, z.z * 1.5 AS pz, y.y * 1.5 AS py, x.x * 1.5 AS px
      FROM full_c c, range(7) z(z), range(4) y(y), range(3) x(x)),
s AS (SELECT g.case_id, g.z, g.y, g.x, b.z AS bz,
        CASE WHEN b.hu IS NULL THEN 0 ELSE (1 - abs(b.z - pz)) * (1 - abs(b.y - py)) * (1 - abs(b.x - px)) * b.hu END AS p
      FROM g JOIN vox o ON o.case_id = g.case_id AND o.z = floor(g.pz) AND o.y = floor(g.py) AND o.x = floor(g.px)
      LEFT JOIN vox b ON b.case_id = g.case_id AND abs(b.z - pz) < 1 AND abs(b.y - py) < 1 AND abs(b.x - px) < 1)
SELECT case_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(sum(p::DOUBLE), 3) AS sample
FROM s GROUP BY ALL""")
def isotropic_resample(spark, sf):
    """Grid of one and a half steps; new cells whose base cell is empty are absent."""
    out = sampling.resample(voxels(spark, sf), "cast(hu AS double)", (1.0, 1.0, 1.0), 1.5, (NZ, NY, NX))
    return out.selectExpr("case_id", "z", "y", "x", "round(sample, 3) AS sample")


@query("band_membership", f"""
WITH {VOXELS_SQL},
ref AS (SELECT case_id, median(hu) AS ref FROM vox WHERE in_mask GROUP BY 1),
r AS (SELECT gid, hu / ref AS rel FROM vox JOIN ref USING (case_id))
SELECT gid, round(least(greatest(0.0, least(1.0, (rel - 0.35) / (0.60 - 0.35))),
                        greatest(0.0, least(1.0, (2.00 - rel) / (2.00 - 1.35)))), 6) AS likeness
FROM r""")
def band_membership(spark, sf):
    """Trapezoid membership of the brightness relative to the trunk."""
    vox = with_reference(voxels(spark, sf))
    like = trapezoid(F.col("hu") / F.col("ref"), (0.35, 0.60, 1.35, 2.00))
    return vox.select("gid", F.round(like, 6).alias("likeness"))


@query("coordinate_identity_join", f"""
WITH {SIDES},
k AS (SELECT case_id, id, round(x, 3) AS x, round(y, 3) AS y, z FROM p)
SELECT k.id, pt.id AS other FROM k JOIN pt ON pt.case_id = k.case_id AND pt.kind = 'F'
WHERE sqrt((k.x - pt.x)*(k.x - pt.x) + (k.y - pt.y)*(k.y - pt.y) + (k.z - pt.z)*(k.z - pt.z)) <= 0.001""")
def coordinate_identity_join(spark, sf):
    """Find the full record of a reported point again by its rounded coordinates."""
    preds, _ = order_sides(spark, sf)
    reported = preds.selectExpr("case_id", "id", "round(x, 3) AS x", "round(y, 3) AS y", "z")
    full = order_points(spark, sf).where("kind = 'F'")
    return nearest.within_distance(reported, full, ["case_id"], 0.001).select("id", "other")
