"""Whitening and hard negatives against plain computations on whole tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxarbor.llm import hardneg, whitening
from voxarbor.llm.queries import QUERIES

SCHEMA = ("vec_id long, embedding array<float>, label int, key string, x string, n string, size string, component string, "
          "id string, score string, other string, anchor string, rank string, chunk string")


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], lab, *("x",) * 11)
                                      for i, v, lab in rows], SCHEMA)
    return make


def clouds(n, size, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, size)) * np.linspace(1, 0.2, size) + spread * rng.integers(0, 3, (n, 1))


def grid(v):
    return [math.floor(64 * float(np.float32(e))) + 1_000_000 for e in v]


def check_whitening(rows, got, components=16):
    """Rows (id, vector) against a dense eigendecomposition over the distinct vectors."""
    full = [(i, grid(v)) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    fit = np.array(sorted({tuple(x) for _, x in full}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, vectors_ = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)
    values, vectors_ = values[order], vectors_[:, order]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == k * len(full)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    signs = {}
    wanted = {}
    for i, x in full:
        wanted.setdefault(i, []).append((np.array(x) * n - sums) / n)
    for c, own in by.items():
        # repeated ids have equal vectors in these tests
        want = {i: w[0] @ vectors_[:, c - 1] / math.sqrt(values[c - 1]) for i, w in wanted.items()}
        signs[c] = 1.0 if sum(r.whitened * want[r.vec_id] for r in own) > 0 else -1.0
        for r in own:
            assert abs(r.whitened * signs[c] - want[r.vec_id]) < 1e-8
            assert r.n == n and r.identity_error < 1e-9
            assert abs(r.explained - values[c - 1] / values.sum()) < 1e-10
    for i, x in full:
        dev = sum(int(e) ** 2 for e in np.array(x) * n - sums)
        assert {r.deviation for r in got if r.vec_id == i} == {dev}


def test_whitening_equals_the_dense_one(vectors):
    for n, size in ((300, 12), (40, 64), (500, 20)):
        rows = list(enumerate(clouds(n, size, n)))
        df = whitening.whole_vectors(vectors([(i, v, 0) for i, v in rows]))
        check_whitening(rows, whitening.whiten(df, whitening.fit(df)).collect())


def test_whitening_of_whole_table(spark):
    got = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect()
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    check_whitening([(r.vec_id, r.embedding) for r in table], got)


def test_repeated_values_and_lost_directions():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((200, 10)))
    turn, _ = np.linalg.qr(rng.standard_normal((10, 10)))
    spectrum = np.array([9, 9, 9, 4, 4, 1, 1e-3, 0, 0, 0.0])
    x = q * spectrum @ turn
    right, values = whitening.bidiagonalise(lambda v: (x.T @ (x @ v), float((x @ v) @ (x @ v))), 10, 6)
    assert np.allclose(values[:7], spectrum[:7], atol=1e-9)
    assert np.allclose(right.T @ right, np.eye(right.shape[1]), atol=1e-12)
    assert np.allclose(np.linalg.norm(x @ right, axis=0)[:6], spectrum[:6], atol=1e-9)


def test_stops_when_the_wanted_ones_stand_still():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 80)) * np.array([100.0, 80, 60, *[0.1] * 77])
    calls = []
    right, values = whitening.bidiagonalise(lambda v: calls.append(1) or (x.T @ (x @ v), float((x @ v) @ (x @ v))), 80, 3)
    assert len(calls) < 40
    assert np.allclose(values[:3], np.linalg.svd(x, compute_uv=False)[:3], rtol=1e-12)


def test_whitening_odd_rows(vectors, spark):
    odd = [(1, None), (2, [None, 1.0, 2.0]), (3, [float("nan"), 1.0, 2.0]), (4, [float("inf"), 0.0, 1.0]), (5, []),
           (6, [0.1, 0.2, 0.3]), (6, [0.1, 0.2, 0.3]), (7, [0.5, -0.2, 0.3]), (8, [0.9, 0.2, -0.7]), (9, [0.1, 0.2, 0.3])]
    df = whitening.whole_vectors(vectors([(i, v, 0) for i, v in odd] + [(10, [1.0, 2.0], 1)]))
    check_whitening(odd[5:], whitening.whiten(df, whitening.fit(df)).collect())
    none = whitening.whole_vectors(vectors([]))
    assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    same = whitening.whole_vectors(vectors([(i, [0.5, 0.5], 0) for i in range(4)]))
    assert whitening.whiten(same, whitening.fit(same)).count() == 0
    far = whitening.whole_vectors(vectors([(i, [i * 1e30, 1.0 * i], 0) for i in range(4)]))
    assert whitening.whiten(far, whitening.fit(far)).count() > 0


def brute(rows):
    own = sorted({i: (lab, v) for i, v, lab in sorted(rows, key=lambda r: (r[0], r[2], list(map(float, r[1]))), reverse=True)}.items())
    x = {i: np.array([math.floor(256 * float(np.float32(e))) for e in v], object) for i, (_, v) in own}
    label = {i: lab for i, (lab, _) in own}
    out = []
    for a in (i for i in label if i % 50 == 0):
        scores = sorted((-int(x[a] @ x[b]), b) for b in label if b != a)
        for s, p in [t for t in scores if label[t[1]] == label[a]][:5]:
            p_score = -s
            fit = [(-t, b) for t, b in scores if label[b] != label[a] and 50 * p_score <= -100 * t <= 95 * p_score][:3]
            out += [(a, p, r + 1, b, p_score, t) for r, (t, b) in enumerate(fit)]
    return sorted(out)


def mined(df, **options):
    got = hardneg.mine(hardneg.candidates(df), F.col("id") % 50 == 0, **options)
    return sorted(tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_equal_brute_force(vectors):
    for n, size, seed in ((400, 6, 1), (700, 16, 2)):
        rng = np.random.default_rng(seed)
        rows = [(i, v, int(lab)) for i, (v, lab) in enumerate(zip(clouds(n, size, seed, 0.3), rng.integers(0, 4, n)))]
        want = brute(rows)
        assert len(want) > 20
        assert mined(vectors(rows)) == want
        assert mined(vectors(rows), block_parts=1, chunk_rows=3) == want


def test_hard_negatives_with_ties_and_copies(vectors):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-1, 3, 4) / 2, i % 3) for i in range(300)] + [(i, [0.5, 1, 0.5, 1], i % 2) for i in range(300, 500)]
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(600, [0, 0, 0, 0], 1), (650, [-1, -1, -1, -1], 0), (700, [9e9, -9e9, 1, 2], 2)]
    want = brute([r for r in rows if r[0] != 700])
    assert mined(vectors([r for r in rows if r[0] != 700])) == want
    assert len(mined(vectors(rows))) >= len(want) - 40  # one far vector changes windows, and nothing breaks


def test_threshold_saves_work():
    rng = np.random.default_rng(4)
    x = np.rint(100 * rng.standard_normal((4000, 3))).astype(np.int32)
    lists = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16)
    block = hardneg.Block({"ids": np.arange(4000).tobytes(), "labels": np.zeros(4000, np.int64).tobytes(), "x": x.tobytes(),
                           "lists": np.ascontiguousarray(lists).tobytes()}, 3)
    wish = hardneg.Wish(hardneg.LEAST, -hardneg.LEAST, 5)
    touched = hardneg.descend(block, 7, x[7], 0, [wish], True)
    want = sorted((-int(x[7] @ x[i]), i) for i in range(4000) if i != 7)[:5]
    assert wish.best == want and touched < 2500
    # a window that even the best values of the block cannot reach costs nothing
    assert hardneg.descend(block, 7, x[7], 0, [hardneg.Wish(10**9, 10**10, 3)], True) == 0


def test_hard_negatives_odd_rows(vectors):
    assert mined(vectors([])) == []
    odd = [(0, None, 1), (50, [None, 1.0], 1), (100, [float("nan"), 1.0], 1), (150, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
           (200, [], 1), (250, [1.0], 1)]
    assert mined(vectors(odd)) == []
    rows = [(300, [1.0, 1.0], 1), (301, [1.0, 0.9], 1), (302, [0.8, 0.8], 2), (303, [0.1, 0.1], 2)]
    assert mined(vectors(odd + rows)) == brute(rows) == [(300, 301, 1, 302, brute(rows)[0][4], brute(rows)[0][5])]
