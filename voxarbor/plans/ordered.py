"""Ordered-sequence queries over user event streams and daily frontiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.operators import sequence as seq
from voxarbor.plans.registry import query
from voxarbor.sources.tables import table

DAY_SECONDS = 86_400
DAYS = 30  # the frontier has one band per day, the last one takes everything beyond
EPOCH = 1_704_067_200  # 2024-01-01 UTC
HOUR_BLOCKS = 6 * 3600  # width of a sequence block in seconds


def event_points(spark, sf):
    """user_id, event_id, t (whole seconds), v (value)."""
    return table(spark, sf, "events").select(
        "user_id", "event_id",
        F.expr("timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("t"),
        F.col("value").alias("v"), "event_type")


EV = f"""ev AS (SELECT user_id, event_id, CAST(floor(epoch(ts) - {EPOCH}) AS BIGINT) AS t,
  value AS v, event_type FROM events)"""
ORDER = ["t", "event_id"]


def block():
    return seq.block_of("t", HOUR_BLOCKS)


@query("cumulative_arc_length", f"""
WITH {EV},
d AS (SELECT *, coalesce(sqrt(pow((t - lag(t) OVER w) / 3600.0, 2) + pow(v - lag(v) OVER w, 2)), 0) AS step
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, event_id, round(step, 5) AS step,
       round(sum(step) OVER (PARTITION BY user_id ORDER BY t, event_id
                             ROWS UNBOUNDED PRECEDING), 5) AS arc FROM d""")
def cumulative_arc_length(spark, sf):
    dt, dv = (F.col("t") - F.col("prev_t")) / 3600.0, F.col("v") - F.col("prev_v")
    out = seq.arc_length(event_points(spark, sf), ["user_id"], ORDER, F.sqrt(dt * dt + dv * dv),
                         ["t", "v"], block())
    return out.select("user_id", "event_id", F.round("step", 5).alias("step"), F.round("arc", 5).alias("arc"))


@query("polyline_totals", f"""
WITH {EV},
d AS (SELECT user_id, abs(t - lag(t) OVER w) AS dt,
             abs(CAST(round(v * 100) AS BIGINT) - lag(CAST(round(v * 100) AS BIGINT)) OVER w) AS dc
      FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, CAST(sum(dt) AS BIGINT) AS seconds, CAST(sum(dc) AS BIGINT) AS travel,
       round(count(*) / (sum(dt) / 86400.0), 6) AS per_day FROM d GROUP BY user_id""")
def polyline_totals(spark, sf):
    """Total length and the density of points per unit of length."""
    p = event_points(spark, sf).withColumn("c", F.round(F.col("v") * 100).cast("bigint"))
    near = seq.neighbours(p, ["user_id"], ORDER, ["t", "c"], block(), next=False)
    return near.groupBy("user_id").agg(
        F.sum(F.abs(F.col("t") - F.col("prev_t"))).alias("seconds"),
        F.sum(F.abs(F.col("c") - F.col("prev_c"))).alias("travel"),
        F.round(F.count(F.lit(1)) / (F.sum(F.abs(F.col("t") - F.col("prev_t"))) / 86400.0), 6).alias("per_day"))


@query("central_gradient", f"""
WITH {EV},
p AS (SELECT user_id, t, max(v) AS v FROM (SELECT user_id, t // 3600 AS t, v FROM ev) GROUP BY ALL),
n AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1
      FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id, t, round(CASE WHEN pv IS NULL AND nv IS NULL THEN NULL
  WHEN pv IS NULL THEN (nv - v) / h1 WHEN nv IS NULL THEN (v - pv) / h0
  ELSE (h0 * h0 * nv + (h1 * h1 - h0 * h0) * v - h1 * h1 * pv) / (h0 * h1 * (h0 + h1)) END, 9) AS slope
FROM n""")
def central_gradient(spark, sf):
    p = (event_points(spark, sf).groupBy("user_id", F.expr("t div 3600").alias("t"))
         .agg(F.max("v").alias("v")))
    near = seq.neighbours(p, ["user_id"], ["t"], ["t", "v"], seq.block_of("t", 24))
    return near.select("user_id", "t", F.round(seq.central_gradient("v", "t"), 9).alias("slope"))


@query("interp_at_arc", f"""
WITH {EV},
p AS (SELECT user_id, t, max(v) AS v FROM ev GROUP BY ALL),
s AS (SELECT *, lead(t) OVER w AS nt, lead(v) OVER w AS nv, lag(t) OVER w AS pt
      FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT user_id AS u, unnest(range(0, CAST(ceil(max(t) / 43200.0) AS BIGINT) + 1)) * 43200 AS pos FROM p GROUP BY 1),
o AS (SELECT unnest([-3600, 0, 3600]) AS off),
q AS (SELECT user_id, pos, off,
        CASE WHEN nt IS NULL THEN v
             ELSE v + (nv - v) * greatest(0.0, least(1.0, (pos + off - t) / (nt - t)::DOUBLE)) END AS v
      FROM s, g, o
      WHERE u = user_id AND (pt IS NULL OR pos + off >= t) AND (nt IS NULL OR pos + off < nt))
SELECT user_id, pos, round(max(v) FILTER (WHERE off = 0), 5) AS v,
       round((max(v) FILTER (WHERE off = 3600) - max(v) FILTER (WHERE off = -3600)) / 2, 5) AS secant
FROM q GROUP BY ALL""")
def interp_at_arc(spark, sf):
    """Value at every half day and the secant over plus and minus one hour, clamped at both ends."""
    p = event_points(spark, sf).groupBy("user_id", "t").agg(F.max("v").alias("v"))
    grid = seq.resample(p, ["user_id"], ["t"], "t", ["v"], block(), 43_200,
                        offsets=(-3600, 0, 3600), lo=0)
    pick = lambda o: F.max(F.when(F.col("offset") == o, F.col("v")))
    return grid.groupBy("user_id", F.col("at").alias("pos")).agg(
        F.round(pick(0), 5).alias("v"), F.round((pick(3600) - pick(-3600)) / 2, 5).alias("secant"))


FRONTIER = f"""{EV},
fr AS (SELECT u.user_id, CAST(g.band AS INT) AS band, coalesce(h.n, 0) AS n
  FROM (SELECT DISTINCT user_id FROM ev) u CROSS JOIN range({DAYS}) g(band)
  LEFT JOIN (SELECT user_id, least({DAYS - 1}, t // {DAY_SECONDS}) AS band, count(*) AS n
             FROM ev GROUP BY ALL) h ON h.user_id = u.user_id AND h.band = g.band)"""


def frontiers(spark, sf):
    """One fixed-length profile per user: events per day."""
    return event_points(spark, sf).groupBy("user_id").agg(
        seq.dense_counts(f"t div {DAY_SECONDS}", DAYS).alias("frontier"), F.count(F.lit(1)).alias("visited"))


@query("expanding_median_explosion", f"""
WITH {FRONTIER},
post AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY user_id ORDER BY band
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM fr WHERE band >= 4),
hit AS (SELECT user_id, min(band) AS band FROM post
        WHERE band >= 6 AND n > greatest(2.0 * med, 5.0 * 0.5) GROUP BY 1)
SELECT u.user_id, CAST(hit.band AS INT) AS band FROM (SELECT DISTINCT user_id FROM fr) u
LEFT JOIN hit USING (user_id)""")
def expanding_median_explosion(spark, sf):
    """First day that exceeds twice the median of the days before it."""
    rep = seq.leak_report("frontier", "5.0D", explosion=2.0)
    f = frontiers(spark, sf).withColumn("r", rep)
    return f.select("user_id", F.when(F.col("r.reason") == "explosion", F.col("r.band_index")).alias("band"))


@query("early_late_growth", f"""
WITH {FRONTIER},
m AS (SELECT user_id, median(n) FILTER (WHERE band BETWEEN 6 AND 11) AS early,
             median(n) FILTER (WHERE band >= 24) AS late FROM fr GROUP BY 1)
SELECT user_id, round(early, 6) AS early, round(late, 6) AS late,
       CASE WHEN early > 0 THEN round(late / early, 6) WHEN late > 0 THEN 1e308 ELSE 0 END AS growth
FROM m""")
def early_late_growth(spark, sf):
    f = frontiers(spark, sf).withColumn("r", seq.leak_report("frontier", "5.0D"))
    growth = F.when(F.col("r.growth") == float("inf"), F.lit(1e308)).otherwise(F.round("r.growth", 6))
    return f.select("user_id", F.round("r.early_frontier", 6).alias("early"),
                    F.round("r.late_frontier", 6).alias("late"), growth.alias("growth"))


@query("leak_decision", f"""
WITH {FRONTIER},
vis AS (SELECT user_id, count(*) AS visited FROM ev GROUP BY 1),
post AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY user_id ORDER BY band
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS med FROM fr WHERE band >= 4),
hit AS (SELECT user_id, min(band) AS band FROM post
        WHERE band >= 6 AND n > greatest(3.0 * med, 4.0 * 0.5) GROUP BY 1),
m AS (SELECT user_id, median(n) FILTER (WHERE band BETWEEN 6 AND 11) AS early,
             median(n) FILTER (WHERE band >= 24) AS late FROM fr GROUP BY 1),
g AS (SELECT user_id, late, CASE WHEN early > 0 THEN late / early WHEN late > 0 THEN 'inf'::DOUBLE ELSE 0 END AS growth FROM m),
r AS (SELECT user_id, visited,
        CASE WHEN hit.band IS NOT NULL THEN 'explosion'
             WHEN growth >= 2.0 OR (growth >= 1.25 AND late > 2.0) THEN 'growth'
             WHEN visited > 35 * 2 THEN 'visited' END AS reason, hit.band AS b
      FROM vis JOIN g USING (user_id) LEFT JOIN hit USING (user_id))
SELECT user_id, visited, reason IS NOT NULL AS leak, reason,
       CAST(CASE reason WHEN 'explosion' THEN b WHEN 'growth' THEN 24 END AS INT) AS band FROM r""")
def leak_decision(spark, sf):
    """Explosion before growth before the visited guard."""
    rep = seq.leak_report("frontier", "4.0D", "visited", "2", explosion=3.0,
                          visited_ratio=35.0)
    return frontiers(spark, sf).withColumn("r", rep).select(
        "user_id", "visited", "r.leak", "r.reason", F.col("r.band_index").alias("band"))


@query("run_persistence", f"""
WITH {EV},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id)
      - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY t, event_id) AS gap FROM ev)
SELECT user_id, min(t) AS start, count(*) AS length FROM r WHERE event_type = 'error'
GROUP BY user_id, gap HAVING count(*) >= 2""")
def run_persistence(spark, sf):
    return seq.streaks(event_points(spark, sf), ["user_id"], ORDER, F.col("event_type") == "error", "t",
                       block())


SIGMA = 1.5
_W = seq.gaussian_weights(SIGMA)
_R = len(_W) // 2


@query("gaussian_smooth_seq", f"""
WITH {FRONTIER},
e AS (SELECT user_id, max(n) FILTER (WHERE band = 0) AS a0, max(n) FILTER (WHERE band = 1) AS a1,
             max(n) FILTER (WHERE band = {DAYS - 1}) AS z0, max(n) FILTER (WHERE band = {DAYS - 2}) AS z1
      FROM fr GROUP BY 1),
p AS (SELECT user_id, band, n::DOUBLE AS v FROM fr
      UNION ALL SELECT user_id, -k, a0 - (a1 - a0) * k FROM e, range(1, {_R + 1}) r(k)
      UNION ALL SELECT user_id, {DAYS - 1} + k, z0 + (z0 - z1) * k FROM e, range(1, {_R + 1}) r(k)),
w AS (SELECT unnest([{", ".join(repr(w) for w in _W)}]) AS w, unnest(range(-{_R}, {_R + 1})) AS o)
SELECT user_id, CAST(band + o AS BIGINT) AS band, round(sum(v * w), 5) AS smooth
FROM p, w WHERE band + o BETWEEN 0 AND {DAYS - 1} GROUP BY ALL""")
def gaussian_smooth_seq(spark, sf):
    daily = frontiers(spark, sf).select("user_id", F.posexplode("frontier").alias("band", "n"))
    out = seq.smooth(daily, ["user_id"], "band", "n", _W, seq.block_of("band", 1024))
    return out.select("user_id", "band", F.round("smooth", 5).alias("smooth"))


@query("drop_repeated_points", f"""
WITH {EV},
d AS (SELECT user_id, event_id, event_type, lag(event_type) OVER
        (PARTITION BY user_id ORDER BY t, event_id) AS before FROM ev)
SELECT user_id, event_id, event_type FROM d WHERE before IS DISTINCT FROM event_type""")
def drop_repeated_points(spark, sf):
    near = seq.neighbours(event_points(spark, sf), ["user_id"], ORDER, ["event_type"], block(), next=False)
    return near.where(~F.col("prev_event_type").eqNullSafe(F.col("event_type"))).select(
        "user_id", "event_id", "event_type")


@query("steepest_pick", f"""
WITH {EV},
d AS (SELECT user_id, event_id, CAST(round(v * 100) AS BIGINT)
        - lag(CAST(round(v * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS delta FROM ev)
SELECT user_id, arg_min(event_id, delta * 1000000000 + event_id) AS event_id, min(delta) AS delta
FROM d WHERE delta IS NOT NULL GROUP BY 1""")
def steepest_pick(spark, sf):
    """Steepest narrowing along the sequence; the lower id wins a tie."""
    p = event_points(spark, sf).withColumn("c", F.round(F.col("v") * 100).cast("bigint"))
    near = seq.neighbours(p, ["user_id"], ORDER, ["c"], block(), next=False)
    d = near.select("user_id", "event_id", (F.col("c") - F.col("prev_c")).alias("delta")).where("delta IS NOT NULL")
    return d.groupBy("user_id").agg(
        F.min_by("event_id", F.struct("delta", "event_id")).alias("event_id"), F.min("delta").alias("delta"))
