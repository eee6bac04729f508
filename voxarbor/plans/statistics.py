"""Aggregation queries: robust statistics, histograms, profiles, projections, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.functions.scalar import band_radius, clip, disc_radius, lumen_reference
from voxarbor.operators.quantiles import (axis_ratio, exact_quantiles, modified_z, robust_stats,
                                          small_quantile, variation)
from voxarbor.operators.sequence import dense_counts
from voxarbor.plans.registry import query
from voxarbor.sources.tables import CELLS, NX, NY, VOXELS_SQL, cents, table, voxels

R = 6  # decimals kept of derived doubles


@query("robust_stats_by_group", """
WITH o AS (SELECT o_orderpriority AS grp, o_totalprice / 1000.0 AS v FROM orders),
s AS (SELECT grp, count(*) AS n, median(v) AS median, quantile_cont(v, 0.25) AS p25,
             quantile_cont(v, 0.75) AS p75 FROM o GROUP BY grp),
m AS (SELECT o.grp, median(abs(o.v - s.median)) AS mad FROM o JOIN s USING (grp) GROUP BY o.grp)
SELECT grp, n, round(median, 6) AS median, round(mad, 6) AS mad, round(p25, 6) AS p25,
       round(p75, 6) AS p75,
       round(CASE WHEN p75 - p25 > 150 THEN p75 ELSE median END, 6) AS reference,
       CASE WHEN p75 - p25 > 150 THEN p75 ELSE median END >= 80 AS enhanced
FROM s JOIN m USING (grp)""")
def robust_stats_by_group(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"),
                                          (F.col("o_totalprice") / 1000.0).alias("v"))
    s = robust_stats(o, ["grp"], "v")
    ref = lumen_reference(F.col("median"), F.col("p25"), F.col("p75"))
    return s.select("grp", "n", *[F.round(c, R).alias(c) for c in ("median", "mad", "p25", "p75")],
                    F.round(ref, R).alias("reference"), (ref >= 80).alias("enhanced"))


@query("modified_zscore_outliers", """
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal AS v FROM customer),
s AS (SELECT c_nationkey, median(v) AS med FROM c GROUP BY 1),
m AS (SELECT c.c_nationkey, median(abs(v - med)) AS mad FROM c JOIN s USING (c_nationkey) GROUP BY 1),
z AS (SELECT c_custkey, c_nationkey, v,
             CASE WHEN mad = 0 THEN 0.0 ELSE 0.6745 * (v - med) / mad END AS z
      FROM c JOIN s USING (c_nationkey) JOIN m USING (c_nationkey))
SELECT c_custkey, c_nationkey, round(z, 6) AS z,
       CASE WHEN v < -900 OR v > 9900 THEN 'implausible'
            WHEN abs(z) > 1.3 THEN 'outlier_in_cohort' END AS flag
FROM z WHERE v < -900 OR v > 9900 OR abs(z) > 1.3""")
def modified_zscore_outliers(spark, sf):
    """The range test outranks the cohort test; the cut is 1.3 because balances are uniform."""
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("v"))
    s = robust_stats(c, ["c_nationkey"], "v").select("c_nationkey", "median", "mad")
    z = modified_z(F.col("v"), F.col("median"), F.col("mad"))
    flag = (F.when((F.col("v") < -900) | (F.col("v") > 9900), F.lit("implausible"))
            .when(F.abs(z) > 1.3, F.lit("outlier_in_cohort")))
    return (c.join(s, "c_nationkey").withColumn("flag", flag).where("flag IS NOT NULL")
            .select("c_custkey", "c_nationkey", F.round(z, R).alias("z"), "flag"))


@query("quantile_profile", """
SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean,
       round(median(p_retailprice), 6) AS median, min(p_retailprice) AS min,
       max(p_retailprice) AS max, round(quantile_cont(p_retailprice, 0.05), 6) AS p05,
       round(quantile_cont(p_retailprice, 0.95), 6) AS p95,
       round(count(*) FILTER (WHERE p_size <= 10) / count(*)::DOUBLE, 6) AS small_share
FROM part GROUP BY p_brand""")
def quantile_profile(spark, sf):
    p = table(spark, sf, "part")
    q = exact_quantiles(p, ["p_brand"], "p_retailprice", {"median": 0.5, "p05": 0.05, "p95": 0.95})
    m = p.groupBy("p_brand").agg(
        F.avg("p_retailprice").alias("mean"), F.min("p_retailprice").alias("min"),
        F.max("p_retailprice").alias("max"),
        F.avg(F.when(F.col("p_size") <= 10, 1.0).otherwise(0.0)).alias("small_share"))
    return q.join(m, "p_brand").select(
        "p_brand", "n", "min", "max",
        *[F.round(c, R).alias(c) for c in ("mean", "median", "p05", "p95", "small_share")])


@query("histogram_bands_dense", """
WITH h AS (SELECT user_id, least(29, CAST(floor(value / 20) AS INT)) AS band, count(*) AS n
           FROM events GROUP BY ALL)
SELECT u.user_id, CAST(g.band AS INT) AS band, coalesce(h.n, 0) AS n
FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN range(30) g(band)
LEFT JOIN h ON h.user_id = u.user_id AND h.band = g.band""")
def histogram_bands_dense(spark, sf):
    h = table(spark, sf, "events").groupBy("user_id").agg(
        dense_counts("cast(floor(value / 20) AS int)", 30).alias("h"))
    return h.select("user_id", F.posexplode("h").alias("band", "n"))


@query("slice_median_cross_section", f"""
WITH {VOXELS_SQL},
per AS (SELECT case_id, z, count(*) AS area FROM vox WHERE in_mask GROUP BY ALL)
SELECT case_id, round(median(area), 6) AS section,
       round(max(sqrt(area / pi())), 6) AS widest_radius
FROM per GROUP BY case_id""")
def slice_median_cross_section(spark, sf):
    # at most NZ slices per case, so the built-in quantile is bounded
    per = voxels(spark, sf).where("in_mask").groupBy("case_id", "z").agg(F.count(F.lit(1)).alias("area"))
    return per.groupBy("case_id").agg(
        F.round(small_quantile("area", 0.5), R).alias("section"),
        F.round(F.max(disc_radius(F.col("area"))), R).alias("widest_radius"))


@query("covariance_axis_ratio", """
WITH m AS (
  SELECT l_suppkey AS grp, count(*) AS n, covar_samp(l_quantity, l_quantity) AS a,
         covar_samp(100 * l_tax, 100 * l_tax) AS b, covar_samp(l_quantity, 100 * l_tax) AS c
  FROM lineitem GROUP BY 1),
e AS (SELECT grp, n, (a + b) / 2 AS mid, sqrt(((a - b) / 2) * ((a - b) / 2) + c * c) AS gap FROM m)
SELECT grp, n, CASE WHEN n < 3 THEN 1.0 ELSE
         round(sqrt(greatest(mid + gap, 1e-9)) / sqrt(greatest(mid - gap, 1e-9)), 6) END AS ratio
FROM e""")
def covariance_axis_ratio(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("grp"), F.col("l_quantity").alias("u"), (F.col("l_tax") * 100).alias("v"))
    return li.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(axis_ratio("u", "v"), R).alias("ratio"))


@query("cv_consistency", """
SELECT o_custkey, count(*) AS n,
       round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(o_totalprice) / avg(o_totalprice) END, 6) AS cv
FROM orders GROUP BY 1""")
def cv_consistency(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(variation("o_totalprice"), R).alias("cv"))


@query("mip_projection", f"""
WITH {VOXELS_SQL}
SELECT case_id, y, x, max(hu) AS brightest, bool_or(in_mask) AS any_mask,
       CAST(max(z) AS INT) AS deepest
FROM vox WHERE z BETWEEN 1 AND 8 GROUP BY ALL""")
def mip_projection(spark, sf):
    return voxels(spark, sf).where("z BETWEEN 1 AND 8").groupBy("case_id", "y", "x").agg(
        F.max("hu").alias("brightest"), F.bool_or("in_mask").alias("any_mask"), F.max("z").alias("deepest"))


@query("grouped_summary_sets", """
SELECT l_returnflag AS flag, l_linestatus AS status, CAST(l_linenumber AS INT) AS line,
       CAST(grouping(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS level,
       count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
       round(avg(l_extendedprice), 4) AS mean_price
FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())""")
def grouped_summary_sets(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_linenumber").alias("line"), "l_quantity", "l_extendedprice")
    return li.groupingSets(
        [[F.col("flag")], [F.col("status")], [F.col("line")], []], "flag", "status", "line",
    ).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))


@query("frontier_radius_windows", """
WITH c AS (
  SELECT user_id, count(*) FILTER (WHERE value >= 40 AND value < 60) AS n, count(*) AS all_n
  FROM events GROUP BY 1)
SELECT user_id, round(sqrt(n * 2.0 / (20.0 * pi())), 6) AS radius, all_n FROM c""")
def frontier_radius_windows(spark, sf):
    """Equivalent radius of a half-open distance window."""
    n = F.count_if((F.col("value") >= 40) & (F.col("value") < 60))
    return table(spark, sf, "events").groupBy("user_id").agg(
        F.round(band_radius(n, 2.0, 20.0), R).alias("radius"), F.count(F.lit(1)).alias("all_n"))


@query("weighted_centroid", f"""
WITH {VOXELS_SQL},
ref AS (SELECT case_id, max(hu) AS top FROM vox GROUP BY 1),
w AS (SELECT case_id, z, y, x, least(greatest(hu * 2.0 / top - 1.0, 0.0), 1.0) AS w
      FROM vox JOIN ref USING (case_id)),
s AS (SELECT case_id, count(*) AS area, sum(w) AS sw, sum(w * z) AS wz, sum(w * y) AS wy,
             sum(w * x) AS wx, avg(z) AS az, avg(y) AS ay, avg(x) AS ax FROM w GROUP BY 1)
SELECT case_id, area, round(CASE WHEN sw > 0 THEN wz / sw ELSE az END, 6) AS cz,
       round(CASE WHEN sw > 0 THEN wy / sw ELSE ay END, 6) AS cy,
       round(CASE WHEN sw > 0 THEN wx / sw ELSE ax END, 6) AS cx FROM s""")
def weighted_centroid(spark, sf):
    """Intensity-weighted centre with clipped weights, plain mean when every weight is zero."""
    vox = voxels(spark, sf)
    top = vox.groupBy("case_id").agg(F.max("hu").alias("top"))
    w = vox.join(top, "case_id").withColumn("w", clip(F.col("hu") * 2.0 / F.col("top") - 1.0, 0.0, 1.0))
    centre = lambda c: F.round(F.when(
        F.sum("w") > 0, F.sum(F.col("w") * F.col(c)) / F.sum("w")).otherwise(F.avg(c)), R)
    return w.groupBy("case_id").agg(F.count(F.lit(1)).alias("area"), centre("z").alias("cz"),
                                    centre("y").alias("cy"), centre("x").alias("cx"))


@query("mask_bounding_box", f"""
WITH {VOXELS_SQL}
SELECT case_id, greatest(min(z) - 2, 0) AS z0, least(max(z) + 2, 9) AS z1,
       greatest(min(y) - 1, 0) AS y0, least(max(y) + 1, 5) AS y1,
       greatest(min(x) - 1, 0) AS x0, least(max(x) + 1, 4) AS x1
FROM vox WHERE in_mask AND hu > 3000000 GROUP BY case_id""")
def mask_bounding_box(spark, sf):
    """Crop box of the mask with a margin of one voxel, two along z, cut at the lattice border."""
    def low(c, m):
        return F.greatest(F.min(c) - m, F.lit(0))

    def high(c, m, top):
        return F.least(F.max(c) + m, F.lit(top))

    return voxels(spark, sf).where("in_mask AND hu > 3000000").groupBy("case_id").agg(
        low("z", 2).alias("z0"), high("z", 2, CELLS // (NY * NX) - 1).alias("z1"),
        low("y", 1).alias("y0"), high("y", 1, NY - 1).alias("y1"),
        low("x", 1).alias("x0"), high("x", 1, NX - 1).alias("x1"))


@query("background_statistics", f"""
WITH {VOXELS_SQL},
lum AS (SELECT case_id, median(hu) AS med, quantile_cont(hu, 0.99) AS p99
        FROM vox WHERE in_mask GROUP BY 1),
ring AS (SELECT v.case_id, v.hu FROM vox v JOIN lum USING (case_id)
         WHERE NOT in_mask AND z <= 6 AND v.hu < med),
bg AS (SELECT case_id, median(hu) AS tissue FROM ring GROUP BY 1),
md AS (SELECT case_id, median(abs(hu - tissue)) AS noise FROM ring JOIN bg USING (case_id) GROUP BY 1)
SELECT case_id, round(med, 4) AS lumen, round(p99, 4) AS p99, round(tissue, 4) AS tissue,
       round(noise, 4) AS noise, round(med - tissue, 4) AS span
FROM lum LEFT JOIN bg USING (case_id) LEFT JOIN md USING (case_id)""")
def background_statistics(spark, sf):
    """Tissue level and noise in the ring around the trunk. A case has at most CELLS voxels."""
    vox = voxels(spark, sf)
    lum = vox.where("in_mask").groupBy("case_id").agg(
        small_quantile("hu", 0.5).alias("med"), small_quantile("hu", 0.99).alias("p99"))
    ring = vox.where("NOT in_mask AND z <= 6").join(lum, "case_id").where("hu < med")
    bg = ring.groupBy("case_id").agg(small_quantile("hu", 0.5).alias("tissue"))
    md = ring.join(bg, "case_id").groupBy("case_id").agg(
        small_quantile(F.abs(F.col("hu") - F.col("tissue")), 0.5).alias("noise"))
    return lum.join(bg, "case_id", "left").join(md, "case_id", "left").select(
        "case_id", F.round("med", 4).alias("lumen"), F.round("p99", 4).alias("p99"),
        F.round("tissue", 4).alias("tissue"), F.round("noise", 4).alias("noise"),
        F.round(F.col("med") - F.col("tissue"), 4).alias("span"))


@query("order_price_report", """
SELECT o_orderstatus AS grp, count(*) AS n,
       CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
       max(o_totalprice) AS max_price, count(*) FILTER (WHERE o_totalprice > 400000) AS over_budget,
       round(median(o_totalprice), 4) AS median
FROM orders GROUP BY 1""")
def order_price_report(spark, sf):
    """Run-report shape: mean-style totals, median, maximum and the number over a limit."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("grp"), "o_totalprice")
    q = exact_quantiles(o, ["grp"], "o_totalprice", {"median": 0.5})
    a = o.groupBy("grp").agg(
        F.sum(cents("o_totalprice")).alias("cents"), F.max("o_totalprice").alias("max_price"),
        F.count_if(F.col("o_totalprice") > 400000).alias("over_budget"))
    return q.join(a, "grp").select("grp", "n", "cents", "max_price", "over_budget",
                                   F.round("median", 4).alias("median"))
