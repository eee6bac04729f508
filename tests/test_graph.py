"""Components, floods, pointers and watershed against small brute-force versions."""

import heapq
import math
import random

from voxarbor.operators import graph, lattice, split

SHAPE = (64, 64, 64)


def gid(z, y, x, case=1):
    return case * 64 ** 3 + (z * 64 + y) * 64 + x


def brute_components(points):
    points, label = set(points), {}
    for p in sorted(points):
        if p in label:
            continue
        stack, label[p] = [p], p
        while stack:
            q = stack.pop()
            for o in lattice.FULL:
                r = tuple(a + b for a, b in zip(q, o))
                if r in points and r not in label:
                    label[r] = p
                    stack.append(r)
    return label


def test_components_match_search(cells):
    rnd = random.Random(3)
    points = {(rnd.randrange(6), rnd.randrange(6), rnd.randrange(6)) for _ in range(60)}
    got = {r.gid: r.label for r in graph.label_cells(cells(points)).collect()}
    want = brute_components(points)
    assert got == {gid(*p): gid(*q) for p, q in want.items()}


def test_long_chain_is_one_component(cells):
    got = graph.label_cells(cells([(0, 0, x) for x in range(40)])).select("label").distinct().collect()
    assert [r.label for r in got] == [gid(0, 0, 0)]


def test_rows_do_not_wrap(cells):
    got = graph.label_cells(cells([(0, 0, 63), (0, 1, 0)])).select("label").distinct().count()
    assert got == 2


def test_flood_anisotropic_distances(cells):
    row = [(0, 0, x) for x in range(12)] + [(0, 1, 12), (5, 5, 5)]
    vox = cells(row)
    out = graph.flood(vox, vox.where("x = 0 AND z = 0"), 100, lattice.millimetres((2, 1, 0.5)))
    got = {(r.z, r.y, r.x): r.dist for r in out.collect()}
    assert all(abs(got[(0, 0, x)] - 2 * x) < 1e-9 for x in range(12))
    assert abs(got[(0, 1, 12)] - 22 - math.sqrt(5)) < 1e-9
    assert (5, 5, 5) not in got


def test_flood_budget_gap_and_zero_cost_sources(cells):
    vox = cells([(0, 0, x) for x in range(30)])
    out = graph.flood(vox, vox.where("x < 20"), 15, lattice.millimetres((1, 1, 1)))
    got = {r.x: (r.dist, r.parent) for r in out.collect()}
    assert got[19] == (0.0, None) and got[20] == (1.0, gid(0, 0, 19)) and got[25][0] == 6.0
    assert sum(d > 0 for d, _ in got.values()) == 10
    gap = cells([(0, 0, x) for x in range(30) if x != 8])
    cut = graph.flood(gap, gap.where("x = 0"), 15, lattice.millimetres((1, 1, 1)))
    assert max(r.x for r in cut.collect()) == 7


def test_flood_matches_dijkstra(cells):
    rnd = random.Random(5)
    points = {(rnd.randrange(7), rnd.randrange(7), rnd.randrange(7)) for _ in range(170)}
    sources = {p for p in points if p[0] == 0}
    dist, heap = {p: 0.0 for p in sources}, [(0.0, p) for p in sources]
    while heap:
        d, p = heapq.heappop(heap)
        if d > dist[p]:
            continue
        for o in lattice.FULL:
            q = tuple(a + b for a, b in zip(p, o))
            w = d + math.sqrt(sum(c * c for c in o))
            if q in points and w <= 4.5 and w < dist.get(q, 1e9) - 1e-12:
                dist[q] = w
                heapq.heappush(heap, (w, q))
    vox = cells(points)
    got = {(r.z, r.y, r.x): r.dist for r in graph.flood(vox, vox.where("z = 0"), 4.5, lattice.millimetres((1, 1, 1))).collect()}
    assert got.keys() == dist.keys() and all(abs(got[p] - dist[p]) < 1e-9 for p in dist)


def test_roots_follow_chains(spark):
    links = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (4, 3), (5, 4), (9, None)], "id long, parent long")
    assert {r.id: r.root for r in graph.roots(links).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 9: 9}


def test_exits_stop_outside_the_trunk(spark):
    rows = [(0, 0.0, None)] + [(i, float(i), i - 1) for i in range(1, 6)]
    got = split.exits(spark.createDataFrame(rows, "gid long, dist double, parent long")).collect()
    assert {r.gid: r.exit for r in got} == {i: 1 for i in range(1, 6)}


def test_watershed_keeps_deep_and_merges_shallow(cells):
    deep = [1, 2, 3, 2.5, 2, 1.5, 1, 1.5, 2, 2.5, 3, 2, 1]
    shallow = [1, 2, 3, 2.9, 2.8, 2.7, 2.6, 2.7, 2.8, 2.9, 3, 2, 1]
    for profile, n in ((deep, 2), (shallow, 1)):
        out = split.watershed(cells([(0, 0, x, h) for x, h in enumerate(profile)]), "v", offsets=lattice.FULL)
        assert out.select("basin").distinct().count() == n


def brute_roots(height, min_peak, min_depth, share):
    """Sequential flooding from the top with union-find, one node at a time."""
    up = {}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for p in sorted(height, key=lambda q: (-height[q], gid(*q))):
        touching = set()
        for o in lattice.FULL:
            q = tuple(a + b for a, b in zip(p, o))
            if q in up:
                touching.add(find(q))
        up[p] = p
        if not touching:
            continue
        ranked = sorted(touching, key=lambda r: (-height[r], gid(*r)))
        up[p] = ranked[0]
        for low in ranked[1:]:
            if height[low] < min_peak or height[low] - height[p] < max(min_depth, share * height[low]):
                up[low] = ranked[0]
    return {find(p) for p in up}


def test_watershed_roots_match_sequential_flooding(cells):
    rnd = random.Random(11)
    pts = [(z, y, x) for z in range(5) for y in range(7) for x in range(7)]
    heights = [round(0.05 * k, 2) for k in range(1, len(pts) + 1)]
    rnd.shuffle(heights)
    height = dict(zip(pts, heights))
    want = brute_roots(height, 2.0, 1.5, 0.2)
    out = split.watershed(cells([(*p, h) for p, h in height.items()]), "v", 2.0, 1.5, 0.2)
    assert {r.basin for r in out.select("basin").distinct().collect()} == {gid(*p) for p in want}


def test_absorb_lowest_join_first(spark):
    origins = spark.createDataFrame([(1, 3.0), (2, 0.4), (3, 2.0), (4, None), (5, 0.5)], "id long, peak double")
    joins = spark.createDataFrame([(1, 2, 4.0), (2, 3, 2.0), (1, 3, 1.0), (4, 5, 3.0)], "a long, b long, join_mm double")
    got = {r.id: r.root for r in split.absorb(origins, joins).collect()}
    assert got == {1: 1, 2: 3, 3: 3, 4: 4, 5: 4}


def test_patch_holes_waists_and_wrapping(spark):
    """A flat sheet of shell: an enclosed pocket belongs to its patch, a notch does not, a waist parts two mouths, pieces
    are origins of their own, and a patch that covers its whole shell has no peak."""
    from voxarbor.operators import split

    sheet = {(1, y, x) for y in range(20) for x in range(40)}
    hole = {(1, y, x) for y in range(4, 11) for x in range(4, 11)} - {(1, 7, 7)}
    notch = {(1, y, x) for y in range(4, 11) for x in range(18, 25)} - {(1, y, 21) for y in range(4, 7)}
    waist = {(1, y, x) for y in range(12, 17) for x in (*range(4, 9), *range(11, 16))} | {(1, 14, 9), (1, 14, 10)}
    apart = {(1, y, x) for y in range(13, 16) for x in (*range(24, 27), *range(30, 33))}
    patches = {1: hole, 2: notch, 3: waist, 4: apart}
    small = {(1, y, x) for y in range(3) for x in range(3)}
    rows = [(1, k, *c) for k, cells in patches.items() for c in cells] + [(2, 9, *c) for c in small]
    patch = spark.createDataFrame(rows, "case_id long, label long, z int, y int, x int")
    shell = spark.createDataFrame([(1, *c) for c in sheet] + [(2, *c) for c in small], "case_id long, z int, y int, x int")
    field = split.patch_field(patch, shell, (3, 20, 40), lattice.millimetres((1.0, 1.0, 1.0)))
    cells, origins = split.patch_origins(field, min_peak=1.5)
    got = cells.collect()
    assert {(r.z, r.y, r.x) for r in got if r.filled} == {(1, 7, 7)} and len(got) == len(rows) + 1
    found = {}
    for o in origins.collect():
        found.setdefault(o.label, []).append(o)
    assert [len(found[k]) for k in (1, 2, 4, 9)] == [1, 1, 2, 1]
    assert found[1][0].peak == 4.0 and found[1][0].saddle is None
    two = sorted(found[3], key=lambda o: o.saddle is not None)
    assert len(two) == 2 and two[0].saddle is None and two[1].saddle == 1.0 and two[0].piece == two[1].piece
    assert len({o.piece for o in found[4]}) == 2 and {o.peak for o in found[4]} == {2.0}
    assert found[9][0].peak is None and {r.height for r in got if r.label == 9} == {None}
