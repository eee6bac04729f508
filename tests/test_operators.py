"""Kernels and column functions against exact small cases and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxarbor.functions import rules, scalar
from voxarbor.operators import dedupe, lattice, matching, nearest, quantiles, sampling, sequence, studies, trace


def test_assignment_against_permutations(spark):
    rnd = random.Random(1)
    for n, m in [(1, 1), (2, 5), (4, 4), (5, 7), (6, 6)]:
        cost = [[rnd.random() for _ in range(m)] for _ in range(n)]
        got = sum(cost[i][j] for i, j in enumerate(matching.assign(cost)[0]))
        best = min(sum(cost[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert abs(got - best) < 1e-9


def points(spark, rows):
    return spark.createDataFrame(rows, "case_id long, id long, x double, y double, z double")


def test_match_is_not_gated_first(spark):
    # pairing 1-11 alone would be nearer, but the total is smaller with 1-12 and 2-11
    preds = points(spark, [(1, 1, 0.0, 0.0, 0.0), (1, 2, -8.0, 0.0, 0.0), (2, 3, 0.0, 0.0, 0.0)])
    refs = points(spark, [(1, 11, -1.0, 0.0, 0.0), (1, 12, 12.0, 0.0, 0.0), (3, 13, 0.0, 0.0, 0.0)])
    got = {(r.pred_id, r.ref_id) for r in matching.match(preds, refs, 10.0).collect()}
    assert got == {(2, 11)}
    marks = matching.outcome(preds, refs, matching.match(preds, refs, 10.0))
    total = matching.cohort_scores(matching.case_scores(marks)).first()
    assert (total.tp, total.fp, total.fn) == (1, 2, 2)


def test_match_many_references_brute_force(spark):
    rnd = random.Random(4)
    preds = [(1, i, rnd.random(), rnd.random(), rnd.random()) for i in range(3)]
    refs = [(1, 100 + i, rnd.random(), rnd.random(), rnd.random()) for i in range(40)]
    got = sum(r.distance for r in matching.match(points(spark, preds), points(spark, refs), 9.0).collect())
    best = min(sum(math.dist(p[2:], r[2:]) for p, r in zip(preds, c)) for c in itertools.permutations(refs, 3))
    assert abs(got - best) < 1e-9


def test_pair_errors_radius_rule(spark):
    kind = "ostium_error double, seed_error double, direction_error double, radius double, ref_radius double"
    two = matching.pair_errors(spark.createDataFrame([(1.0, 0.0, 0.0, 2.5, 2.0), (2.0, 0.0, 0.0, 1.0, None)], kind)).first()
    assert (two.matched, two.ostium_error, two.radius_n, two.radius_error) == (2, 1.5, 1, 0.5)
    assert matching.pair_errors(spark.createDataFrame([(1.0, 0.0, 0.0, 1.0, None)], kind)).first().radius_error is None
    assert matching.pair_errors(spark.createDataFrame([], kind)).first().radius_error == 0.0


def test_drift(spark):
    base = points(spark, [(1, 1, 0.0, 0.0, 0.0), (1, 2, 50.0, 0.0, 0.0), (1, 3, 90.0, 0.0, 0.0)])
    other = points(spark, [(1, 7, 1.0, 0.0, 0.0), (1, 8, 53.0, 0.0, 0.0), (1, 9, 200.0, 0.0, 0.0)])
    fate = matching.drift(base, other, matching.match(base, other, 5.0)).collect()
    assert {(r.id, r.present, r.moved, r.appeared) for r in fate} == {
        (1, True, False, False), (2, True, True, False), (3, False, False, False), (9, True, False, True)}


@pytest.mark.parametrize("copies", [1, 400])
def test_nearest_brute_force_with_a_crowded_place(spark, copies):
    rnd = random.Random(2)
    right = [(1, i, rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for i in range(60)]
    right += [(1, 1000 + i, 0.5, 0.5, 0.5) for i in range(copies)] + [(2, 5000, 900.0, 0.0, 0.0)]
    left = [(1 + (i % 2), i, rnd.gauss(0, 3), rnd.gauss(0, 3), rnd.gauss(0, 3)) for i in range(40)] + [(3, 99, 0.0, 0.0, 0.0)]
    got = {r.id: (r.nn, r.dist) for r in nearest.nearest(points(spark, left), points(spark, right), ["case_id"], default=999.0).collect()}
    for case, i, *p in left:
        near = [(math.dist(p, r[2:]), r[1]) for r in right if r[0] == case]
        if near:
            assert got[i][0] == min(near)[1] and abs(got[i][1] - min(near)[0]) < 1e-9
        else:
            assert got[i] == (None, 999.0)


def test_set_gap_and_reach(spark):
    a = points(spark, [(1, 1, 0.0, 0.0, 0.0), (1, 2, 3.0, 0.0, 0.0), (2, 3, 0.0, 0.0, 0.0)])
    b = points(spark, [(1, 4, 5.0, 0.0, 0.0), (1, 5, 9.0, 0.0, 0.0)])
    assert [(r.case_id, r.gap) for r in nearest.set_gap(a, b, ["case_id"], 1.0).collect()] == [(1, 2.0)]
    assert {(r.id, r.other) for r in nearest.within_distance(a, b, ["case_id"], 5.0).collect()} == {(1, 4), (2, 4)}


def test_fold_is_sequential(spark):
    # a chain: 2 folds into 1, so 3 conflicts with nobody that was kept
    rows = [(1, 1, 0.9, 0.0), (1, 2, 0.8, 2.0), (1, 3, 0.7, 4.0), (1, 4, 0.6, 4.5), (2, 5, 0.5, 0.0)]
    df = spark.createDataFrame([(*r, 0.0, 0.0) for r in rows], "case_id long, id long, c double, x double, y double, z double")
    got = {r.id: r.folded_into for r in dedupe.fold(df, "struct(-c AS c, id AS i)", "abs(k.x - x.x) <= 3", 3.0).collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_fold_equals_the_walk_in_one_large_case(spark):
    rnd = random.Random(12)
    rows = [(7, i, round(rnd.random(), 3), rnd.random() * 40, rnd.random() * 40, 0.0) for i in range(500)]
    df = spark.createDataFrame(rows, "case_id long, id long, c double, x double, y double, z double")
    got = {r.id: r.folded_into for r in dedupe.fold(
        df, "struct(-c AS c, id AS i)", f"{dedupe.distance()} <= 2", 2.0, "c > 0.1").collect()}
    kept, want = [], {}
    for _, i, c, x, y, _ in sorted((r for r in rows if r[2] > 0.1), key=lambda r: (-r[2], r[1])):
        near = [k for k, kx, ky in kept if math.hypot(kx - x, ky - y) <= 2]
        want[i] = near[0] if near else None
        if not near:
            kept.append((i, x, y))
    assert got == want


def test_potentials_prove_the_assignment():
    rnd = random.Random(13)
    cost = np.array([[rnd.choice([1.0, 2.0, rnd.random() * 5]) for _ in range(70)] for _ in range(60)])
    picks, u = matching.assign(cost.tolist())
    u = np.array(u)
    chosen = np.array([cost[i, j] for i, j in enumerate(picks)])
    v = np.zeros(70)
    v[picks] = chosen - u
    assert (v <= 1e-9).all() and (u[:, None] + v <= cost + 1e-9).all() and len(set(picks)) == 60


def test_assignment_by_place_equals_one_part(spark):
    rnd = random.Random(14)
    at = lambda: (rnd.random() * 60, rnd.random() * 60, rnd.choice([0.0, 1.0, 2.0]))
    preds = [(c, i, *at()) for c, n in ((1, 40), (2, 30), (3, 25)) for i in range(n)] + [(3, 90, 500.0, 0.0, 0.0), (4, 1, 0.0, 0.0, 0.0)]
    refs = [(c, 100 + i, *at()) for c, n in ((1, 40), (2, 50), (3, 20)) for i in range(n)] + [(5, 1, 0.0, 0.0, 0.0)]
    preds += [(1, 200 + i, 7.0, 7.0, 0.0) for i in range(3)]  # repeated points
    refs += [(1, 300 + i, 7.0, 7.0, 0.0) for i in range(2)]
    a, b = points(spark, preds), points(spark, refs)
    for threshold in (4.0, 1000.0):
        one = matching.match(a, b, threshold).groupBy("case_id").agg(F.expr("count(1) AS n"), F.expr("round(sum(distance), 6) AS d")).collect()
        many = matching.match(a, b, threshold, one_part=0).groupBy("case_id").agg(
            F.expr("count(1) AS n"), F.expr("round(sum(distance), 6) AS d")).collect()
        assert sorted(one) == sorted(many) and len(one) == 3


def test_assignment_of_a_large_case(spark):
    """One case of 20,000 points on each side in places of a few: all are found, and none is matched twice."""
    side = lambda first, shift: spark.range(20_000).selectExpr(
        "1L AS case_id", f"id + {first} AS id", f"(id div 4) % 100 * 50D + id % 4 + {shift} AS x", "(id div 400) * 50D AS y", "0D AS z")
    pairs = matching.match(side(0, 0.0), side(100_000, 0.25), 1.0).selectExpr(
        "count(1) AS n", "count(DISTINCT pred_id) AS p", "count(DISTINCT ref_id) AS r", "sum(distance) AS d").first()
    assert (pairs.n, pairs.p, pairs.r) == (20_000, 20_000, 20_000) and abs(pairs.d - 5000) < 1e-6


def test_quantiles_match_numpy(spark):
    import numpy as np

    rnd = random.Random(8)
    data = [(g, v) for g in range(3) for v in [rnd.gauss(0, 10 ** g) for _ in range(200 + g)]] + [(0, 0.0)] * 9 + [(7, 5.0)]
    got = {r.g: r for r in quantiles.exact_quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v",
                                                      {"a": 0.05, "b": 0.5, "c": 0.99}).collect()}
    for g in (0, 1, 2, 7):
        v = [b for a, b in data if a == g]
        assert got[g].n == len(v)
        assert np.allclose([got[g].a, got[g].b, got[g].c], np.percentile(v, [5, 50, 99]))


LEAKS = [
    ([4000, 3000, 2000, 1500] + [40] * 26, 200, False, None, None),
    ([9000] * 4 + [60] * 26, 150, False, None, None),
    ([4000, 3000, 2000, 1500] + [40] * 12 + [900] * 14, 200, True, "explosion", 16),
    ([4000, 3000, 2000, 1500] + [300 + 800 * i / 25 for i in range(26)], 170, True, "growth", 24),
    ([4000, 3000, 2000, 1500] + [30 + 20 * i / 25 for i in range(26)], 400, False, None, None),
    ([4000, 3000, 2000, 1500] + [300 + 200 * i / 25 for i in range(26)], 400, True, "growth", 24),
]


def test_leak_rules(spark):
    df = spark.createDataFrame([(i, [float(v) for v in f], float(s)) for i, (f, s, *_) in enumerate(LEAKS)],
                               "i int, f array<double>, s double")
    got = {r.i: r.r for r in df.select("i", sequence.leak_report("f", "s").alias("r")).collect()}
    for i, (_, _, leak, reason, band) in enumerate(LEAKS):
        assert (got[i].leak, got[i].reason, got[i].band_index) == (leak, reason, band)
    short = spark.createDataFrame([([1.0] * 15, 4.0)], "f array<double>, s double")
    r = short.select(sequence.leak_report("f", "s", "1000", "10", n_bands=15).alias("r")).first().r
    assert r.growth is None and r.reason == "visited"


def test_blocks_do_not_change_sequences(spark):
    rnd = random.Random(6)
    df = spark.createDataFrame([(i % 3, i, rnd.random()) for i in range(90)], "k int, t int, v double").repartition(5)
    one = sequence.neighbours(df, ["k"], ["t"], ["v"], F.lit(0)).orderBy("t").collect()
    many = sequence.neighbours(df, ["k"], ["t"], ["v"], sequence.block_of("t", 7)).orderBy("t").collect()
    assert one == many
    sums = [sequence.running(df, ["k"], ["t"], {"s": F.lit(1)}, b).orderBy("t").collect() for b in (F.lit(0), sequence.block_of("t", 4))]
    assert sums[0] == sums[1]


def test_opening_keeps_blocks_and_cuts_a_bridge(cells):
    block = [(z, y, x) for z in range(3) for y in range(3) for x in range(3)]
    far = [(z, y, x + 4) for z, y, x in block]
    out = {(r.z, r.y, r.x) for r in lattice.opening(cells(block + far + [(1, 1, 3)]), lattice.FACE).collect()}
    assert (1, 1, 3) not in out or (1, 1, 2) in out
    assert {(1, 1, 1), (1, 1, 5)} <= out


def test_band_membership_and_adaptive_band(spark):
    knots = (0.5, 1.0, 1.3, 2.5)
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 1.3, 2.5, 4.0)], "v double")
    assert [r[0] for r in df.select(scalar.trapezoid(F.col("v"), knots)).collect()] == [0, 0, 1, 1, 0, 0]
    cases = spark.createDataFrame([(40.0, 400.0, 450.0, 80.0), (163.0, 146.0, 84.0, 80.0), (20.0, 200.0, 90.0, 80.0),
                                   (5000.0, 10.0, 81.0, 80.0)], "n double, s double, r double, t double")
    tight, band = scalar.adaptive_band(F.col("n"), F.col("s"), F.col("r"), F.col("t"))
    rows = cases.select(tight.alias("t"), F.array(*band).alias("b")).collect()
    assert rows[0].t == 0 and rows[1].t == 1.0 and rows[2].t > 0.5 and rows[3].t <= 1.0
    assert all(a < b for r in rows for a, b in zip(r.b, r.b[1:]))


def test_veto_branches(spark):
    df = spark.createDataFrame([(8.0, 1.0, 0.6, 1.2), (8.0, 1.0, 0.6, 0.6), (8.0, 0.0, 2.0, 2.0), (4.0, 1.0, 2.0, 2.0)],
                               "traced_length_mm double, reached_seed_distance double, radius_at_seed_mm double, origin_radius_mm double")
    extra = {c: 0.0 for c in ("origin_radius_uncertainty_mm", "touches_cap", "cap_radius_ratio", "angle_to_centerline_deg")}
    for c, v in extra.items():
        df = df.withColumn(c, F.lit(0.3 if "uncertainty" in c else v))
    got = [r[0] for r in df.select(rules.veto_reason(rules.Limits())).collect()]
    assert got == [None, "origin_radius", "seed_not_reached", "too_short"]


def test_vector_functions(spark):
    one = spark.range(1)
    u, v = scalar.perpendicular_pair([F.lit(0.6), F.lit(0.0), F.lit(0.8)])
    r = one.select(F.array(*u).alias("u"), F.array(*v).alias("v"),
                   scalar.angle_deg([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(1.0), F.lit(1.0), F.lit(0.0)]).alias("a"),
                   F.array(*scalar.rotate3([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)],
                                           F.lit(math.pi / 2))).alias("r"),
                   scalar.segment_distance([F.lit(0.0), F.lit(3.0), F.lit(0.0)], [F.lit(-1.0), F.lit(0.0), F.lit(0.0)],
                                           [F.lit(1.0), F.lit(0.0), F.lit(0.0)]).alias("d")).first()
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    assert abs(dot(r.u, r.v)) < 1e-12 and abs(dot(r.u, (0.6, 0, 0.8))) < 1e-12 and abs(dot(r.u, r.u) - 1) < 1e-12
    assert abs(r.a - 45) < 1e-9 and abs(r.r[1] - 1) < 1e-12 and r.d == 3.0
    grid = one.selectExpr("array(0.5D, 1D, 2D) AS s", "array(3D, 4D, 5D) AS o", "array(0D, -1D, 0D, 1D, 0D, 0D, 0D, 0D, 1D) AS d")
    phys = scalar.index_to_physical([F.lit(2.0), F.lit(3.0), F.lit(4.0)], F.col("s"), F.col("o"), F.col("d"))
    back = scalar.physical_to_index(phys, F.col("s"), F.col("o"), F.col("d"))
    assert [round(v, 9) for v in grid.select(*back).first()] == [2, 3, 4]


def test_resample_shape_and_values(cells):
    vox = cells([(z, y, x, 10 * z + y + x) for z in range(4) for y in range(4) for x in range(4)])
    assert sampling.resampled_shape((4, 4, 4), (2.0, 1.0, 1.0), 1.0) == (4, 4, 8)
    out = {(r.z, r.y, r.x): r.sample for r in sampling.resample(vox, "v", (2.0, 1.0, 1.0), 1.0, (4, 4, 4), fill=-5.0).collect()}
    assert len(out) == 4 * 4 * 8
    assert out[(1, 2, 3)] == 10 + 2 + 1.5 and out[(0, 0, 7)] == 3.0


def test_trace_arc_resample_and_tangent(spark):
    line = trace.with_arc(spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(7)], "trace_id long, seq int, x double, y double, z double"))
    pts = trace.resample(line).orderBy("seq").collect()
    assert len(pts) == 13 and abs(pts[3].x - 1.5) < 1e-12
    far = trace.at_arcs(line, "array(5D, 9D)").orderBy("k").collect()
    assert [(r.reached, r.x) for r in far] == [(True, 5.0), (False, 6.0)]
    tan = trace.tangents(line, "array(0D, 3D)").orderBy("k").collect()
    assert [round(r.tx, 9) for r in tan] == [1.0, 1.0]
    soft = trace.smooth_paths(line.selectExpr("trace_id", "seq", "arc AS dist", "x", "y", "z")).orderBy("seq").collect()
    assert all(abs(r.x - r.seq) < 0.06 for r in soft)


def test_walk_back_and_refine(spark):
    parents = spark.createDataFrame([(i, i - 1 if i else None) for i in range(10)], "gid long, parent long")
    got = trace.walk_back(spark.createDataFrame([(7, 9)], "trace_id long, gid long"), parents).orderBy("seq").collect()
    assert [(r.seq, r.gid) for r in got] == [(i, i) for i in range(10)]
    line = trace.with_arc(spark.createDataFrame([(1, i, 4.0 * i, 0.0, 0.0) for i in range(4)], "trace_id long, seq int, x double, y double, z double"))
    centres = line.selectExpr("trace_id", "seq", "x AS cx", "y + 1 AS cy", "z AS cz", "seq = 1 AS found")
    ostia = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "trace_id long, x double, y double, z double")
    out = trace.refine(line, ostia, centres).orderBy("arc").collect()
    assert (out[0].x, out[0].arc) == (0.0, 0.0) and abs(out[-1].arc - 10) < 1e-9 and out[1].y == 1.0


def test_bifurcation_needs_persistence(cells):
    stem = [(z, 5, x, z) for z in range(6) for x in range(5, 9)]
    fork = [(z, 5, x, z) for z in range(6, 14) for x in (3, 4, 10, 11)] + [(z, 6, x, z) for z in range(6, 14) for x in (3, 4, 10, 11)]
    c = cells(stem + fork).selectExpr("*", "1L AS instance_id", "v AS dist")
    r = trace.bifurcations(c, 0.0, 1.0).collect()
    assert len(r) == 1 and 5.0 < r[0].distance <= 6.5 and r[0].blobs == 2
    assert trace.bifurcations(cells(stem).selectExpr("*", "1L AS instance_id", "v AS dist"), 0.0, 1.0).count() == 0


def test_principal_axis(spark):
    pts = spark.createDataFrame([(1, t * 0.6, t * 0.0, t * 0.8 + 0.01 * (t % 2), -1.0) for t in range(20)], "k int, x double, y double, z double, o double")
    r = trace.principal_axis(pts, ["k"], ["o", "o", "o"]).first()
    assert r.az < 0 and abs(abs(r.ax) - 0.6) < 0.01 and abs(abs(r.az) - 0.8) < 0.01


def test_plateau_and_perturbations(spark):
    grid = spark.createDataFrame([(0.55, 10, 1.0), (0.6, 100, 0.95), (0.65, 95, 0.5), (0.7, 90, 0.95), (0.75, 89, 0.8)],
                                 "t double, total_n long, mean_stability double")
    got = {r.t: r.in_plateau for r in studies.plateau(grid, "t", 0.65).collect()}
    assert got == {0.55: False, 0.6: True, 0.65: True, 0.7: True, 0.75: False}
    s = studies.plateau_summary(studies.plateau(grid, "t", 0.65), "t").first()
    assert (s.lower, s.upper, s.on_a_cliff) == (0.6, 0.7, False)
    assert len(studies.perturbations({"a": 1.0, "b": 2.0, "c": 3.0, "d": 4.0})) == 16


def test_noise_is_seeded(cells):
    vox = cells([(0, 0, x, 5.0) for x in range(50)])
    a, b = (sorted(r.v for r in studies.with_noise(vox, "v", 15.0, 3).collect()) for _ in range(2))
    assert a == b and a[0] != 5.0


def test_claims_and_distinct_pairs(spark):
    probes = spark.createDataFrame([(1, 1, "a", "none", 5.0), (1, 2, "b", "one", 5.0), (1, 3, "c", "some", 5.0)],
                                   "case_id long, id long, claim string, kind string, reach double")
    near = spark.createDataFrame([(1, 1, 9, 6.0), (1, 2, 9, 1.0), (1, 2, 8, 2.0)], "case_id long, id long, other long, dist double")
    assert {r.claim: r.passed for r in studies.claims(probes, near).collect()} == {"a": True, "b": False, "c": False}
    pair = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 2, 5), (3, 1, None), (3, 2, 4)], "case_id long, id long, nn long")
    assert {r.case_id: r.passed for r in studies.distinct_pair(pair).collect()} == {1: True, 2: False, 3: False}


def test_long_lines_are_placed_in_blocks(spark, monkeypatch):
    rnd = random.Random(8)
    rows = [(t, i, *[float(rnd.randrange(3)) for _ in range(3)]) for t, n in ((1, 700), (2, 1), (3, 64), (4, 65)) for i in range(n)]
    line = spark.createDataFrame(rows, "trace_id long, seq int, x double, y double, z double")
    wanted = "array(0D, total / 3, total / 2, total, total + 1, -1D)"
    key = lambda r: (r.trace_id, r.k)
    got = sorted(trace.at_arcs_of_long(line, wanted, block=16).collect(), key=key)
    want = sorted(trace.at_arcs(trace.with_arc(line), wanted).collect(), key=key)
    assert len(got) == 24 and [key(r) for r in got] == [key(r) for r in want]
    for a, b in zip(got, want):
        assert a.reached == b.reached and [a.want, a.x, a.y, a.z] == pytest.approx([b.want, b.x, b.y, b.z])

    def whole(*_):
        raise AssertionError("a window over a whole line")

    from voxarbor.plans import load

    monkeypatch.setattr(trace, "with_arc", whole)
    monkeypatch.setattr(trace, "at_arcs", whole)
    out = load().QUERIES["arc_positions"](spark, "/root/testdata/sf0.001")
    assert out.count() == 3 * spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id").distinct().count()


def test_distance_transform_against_all_pairs(spark):
    from voxarbor.operators import distance

    rnd = random.Random(21)
    shape, spacing = (7, 9, 600), (0.5, 1.0, 2.0)
    rows = [(c, z, y, x, rnd.random() < 0.002 * c) for c in (0, 1, 2) for z in range(shape[0]) for y in range(shape[1])
            for x in range(shape[2] if c == 2 else 8)]
    grid = spark.createDataFrame(rows, "case_id long, z int, y int, x int, seed boolean")
    got = {(r.case_id, r.z, r.y, r.x): r.d2 for r in distance.squared_distances(grid, "seed", spacing).collect()}
    for c in (0, 1, 2):
        cells = np.array([r[1:4] for r in rows if r[0] == c]) * np.array(spacing[::-1])
        seeds = np.array([r[1:4] for r in rows if r[0] == c and r[4]]).reshape(-1, 3) * np.array(spacing[::-1])
        for r, at in zip((r for r in rows if r[0] == c), cells):
            want = ((seeds - at) ** 2).sum(axis=1).min() if len(seeds) else None
            assert got[r[:4]] == (want if want is None else pytest.approx(want, abs=1e-9))


def test_signed_distance_and_half_steps(spark):
    from voxarbor.operators import distance

    ball = spark.range(15 * 15 * 15).selectExpr(
        "1L AS case_id", "cast(id div 225 AS int) AS z", "cast((id div 15) % 15 AS int) AS y", "cast(id % 15 AS int) AS x").selectExpr(
        "*", "4.6 - sqrt(pow(z - 7, 2) + pow(y - 7, 2) + pow(x - 7, 2)) AS hu", "z > 9 AS trunk")
    at = {(r.z, r.y, r.x): r.signed for r in distance.signed_distances(ball, "hu >= 0").collect()}
    assert at[7, 7, 7] == 4.0 and at[7, 7, 11] == 0.0 and at[7, 7, 14] == -3.0 and at[7, 7, 9] == 2.0
    fine = {(r.z, r.y, r.x): r.inside for r in distance.half_steps(ball, "hu", "0").collect()}
    assert len(fine) == 29 ** 3 and fine[14, 14, 23] and not fine[14, 14, 24]
    shut = {(r.z, r.y, r.x): r.inside for r in distance.half_steps(ball, "hu", "0", "trunk").collect()}
    assert shut[18, 14, 14] and not shut[19, 14, 14] and not shut[20, 14, 14]


def test_far_points_do_not_meet_all_positions(spark, monkeypatch):
    """A crowd and as many points far from it: the work of the descent is that of the few cells facing them, and ties are kept."""
    rnd = random.Random(5)
    right = [(1, i, rnd.random(), rnd.random(), rnd.random()) for i in range(3000)] + [(1, 9000, 40.0, 1.0, 0.0), (1, 9001, 40.0, -1.0, 0.0)]
    left = [(1, i, 100 + 30 * rnd.random(), 30 * rnd.random(), 30 * rnd.random()) for i in range(300)]
    left += [(1, 500 + i, -30 - rnd.random(), 20 * rnd.random(), 0.3) for i in range(300)] + [(1, 900, 39.0, 0.0, 0.0)]
    meets, meet = [], nearest._meet
    monkeypatch.setattr(nearest, "_meet", lambda asked, n, *rest: meets.append(n) or meet(asked, n, *rest))
    got = {r.id: (r.nn, r.dist) for r in nearest.nearest(points(spark, left), points(spark, right), ["case_id"]).collect()}
    assert meets and max(meets) <= 20 * len(left)
    for _, i, *p in left:
        best = min((math.dist(p, r[2:]), r[1]) for r in right)
        assert abs(got[i][1] - best[0]) < 1e-9 and (got[i][0] == best[1] or i != 900)
    assert got[900][0] == 9000 and len(got) == len(left)


def test_runs_meet_once_and_fold_as_on_their_own(spark, monkeypatch):
    rnd = random.Random(3)
    spots = [(c, i, *(6 * rnd.random() for _ in range(3))) for c in (1, 2) for i in range(30)]
    df = spark.createDataFrame([(c * 4 + run, i, run, rnd.random(), *p) for c, i, *p in spots for run in range(4)],
                               "case_id long, id long, run int, c double, x double, y double, z double")
    rule = ("struct(-c AS c, id AS i)", f"{dedupe.distance()} <= 2", 2.0, "c >= run / 10D")
    want = {(r.case_id, r.id): r.folded_into for r in dedupe.fold(df, *rule).collect()}
    met, meet = [], dedupe.conflicts
    monkeypatch.setattr(dedupe, "conflicts", lambda rows, *rest: met.append(rows.count()) or meet(rows, *rest))
    got = {(r.case_id, r.id): r.folded_into for r in dedupe.fold_runs(df, *rule, "case_id div 4").collect()}
    assert got == want and any(got.values()) and met[0] <= len(spots)
