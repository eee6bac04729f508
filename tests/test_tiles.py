"""Floods and parts across tiles against brute force, and the rounds they take."""

import heapq
import random

import pytest

from voxarbor.operators import graph, lattice, tiles
from voxarbor.session import Rounds

STEP = {1: 10, 2: 14, 3: 17}


def weight(dz, dy, dx):
    return STEP[abs(dz) + abs(dy) + abs(dx)]


@pytest.fixture
def saved(monkeypatch):
    names, plain = [], Rounds.save
    monkeypatch.setattr(Rounds, "save", lambda self, df, **m: names.append(self.root) or plain(self, df, **m))
    return names


@pytest.fixture
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "SIDE", 4)


def cloud(seed, shape, share, low=0):
    rnd = random.Random(seed)
    return [(z + low, y + low, x + low) for z in range(shape[0]) for y in range(shape[1]) for x in range(shape[2]) if rnd.random() < share]


def rows(spark, cases):
    data = [(case, *p, case * 100_000 + i) for case, points in cases.items() for i, p in enumerate(points)]
    return spark.createDataFrame(data, "case_id long, z int, y int, x int, gid long")


def by_heap(cells, begin, budget):
    """Nearest source by (dist, source, hop, parent)."""
    at = dict(cells)
    best = {p: (0, at[p], 0, -1) for p in begin}
    heap = [(s, p) for p, s in best.items()]
    heapq.heapify(heap)
    while heap:
        s, p = heapq.heappop(heap)
        if s != best[p]:
            continue
        for o in lattice.FULL:
            q = tuple(a + b for a, b in zip(p, o))
            new = (s[0] + weight(*o), s[1], s[2] + 1, at[p])
            if q in at and q not in begin and new[0] <= budget and (q not in best or new < best[q]):
                best[q] = new
                heapq.heappush(heap, (new, q))
    return {at[p]: (d, source, None if p in begin else parent) for p, (d, source, _, parent) in best.items()}


def test_flood_across_tiles(spark, small_tiles):
    cases = {1: cloud(1, (11, 6, 9), 0.45, -3), 2: cloud(2, (3, 3, 14), 0.6), 7: [(0, 0, 0), (9, 9, 9)]}
    vox = rows(spark, cases)
    got = {r.gid: (r.dist, r.source, r.parent) for r in graph.flood(vox, vox.where("x <= 0"), 95, weight, distance="int").collect()}
    want = {}
    for case, points in cases.items():
        numbered = {p: case * 100_000 + i for i, p in enumerate(points)}
        want |= by_heap(numbered, {p for p in points if p[2] <= 0}, 95)
    assert got == want and len({d for d, _, _ in got.values()}) > 10


def test_parts_across_tiles(spark, small_tiles):
    cases = {1: cloud(3, (9, 7, 10), 0.12, -2), 2: [(0, 0, x) for x in range(30)], 3: [(5, 5, 5)]}
    got = {r.gid: r.label for r in graph.label_cells(rows(spark, cases)).collect()}
    want = {}
    for case, points in cases.items():
        numbered, seen = {p: case * 100_000 + i for i, p in enumerate(points)}, set()
        for p in points:  # in the order of their ids
            stack = [] if p in seen else [p]
            seen.add(p)
            while stack:
                q = stack.pop()
                want[numbered[q]] = numbered[p]
                for o in lattice.FULL:
                    r = tuple(a + b for a, b in zip(q, o))
                    if r in numbered and r not in seen:
                        seen.add(r)
                        stack.append(r)
    assert got == want and len(set(got.values())) > 10


def test_small_lattices_settle_in_one_job(spark, saved):
    vox = rows(spark, {c: [(0, 0, x) for x in range(20)] for c in range(3)})
    assert graph.flood(vox, vox.where("x = 0"), 200, weight, distance="int").count() == 60
    assert len(saved) == 2  # the cells, then all that was reached
    saved.clear()
    assert graph.label_cells(vox).select("label").distinct().count() == 3
    assert len(saved) == 2


def test_cells_without_a_place_and_copies_of_a_cell(spark):
    vox = spark.createDataFrame([(1, 0, 0, 0, 5), (1, 0, 0, 0, 4), (1, 0, 0, 1, 6), (1, 0, None, 0, None), (1, 9, 9, 9, 8), (1, 9, 9, 9, 7)],
                                "case_id long, z int, y int, x int, gid long")
    got = sorted(graph.flood(vox, vox.where("x = 0"), 50, weight, distance="int").collect(), key=lambda r: r.dist)
    assert [(r.gid, r.dist, r.source) for r in got] in ([(4, 0, 4), (None, 0, None), (6, 10, 4)], [(None, 0, None), (4, 0, 4), (6, 10, 4)])
    assert {r.gid: r.label for r in graph.label_cells(vox).collect()} == {4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert graph.flood(vox.limit(0), vox.limit(0), 50, weight).count() == 0 and graph.label_cells(vox.limit(0)).count() == 0
