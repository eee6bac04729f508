"""Iterative graph operators. Every round is one job whose result is written as a table.

Rounds are few: components contract to stars, pointers double, and a flood settles whole tiles at once, so it takes
as many jobs as its ways cross tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxarbor.operators import lattice, tiles
from voxarbor.session import Rounds

STALLED = 70  # pointers double, so a chain of 2^64 settles within fewer rounds


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Label every ``id`` of ``nodes`` with the smallest id it is linked to: ``id, label``.

    ``links`` holds undirected pairs ``a, b``. Alternating large-star and small-star steps; a hub only
    takes part in ``min`` aggregations and in joins with one row per hub, which adaptive skew
    splitting can divide.
    """
    spark = nodes.sparkSession
    rounds = Rounds(spark, "components")
    stars = links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v")
    seen, held = None, None
    while True:
        both = stars.unionByName(stars.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.expr("least(u, min(v)) AS m"))
        large = both.join(low, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        best = large.groupBy("u").agg(F.expr("min(v) AS m"))
        small = large.join(best, "u").selectExpr(
            "inline(array(struct(u AS u, m AS v), struct(v AS u, m AS v)))").where("u <> v").distinct()
        stars, now = rounds.save(small, n=F.expr("count(1)"), h=F.expr("bit_xor(xxhash64(u, v))"))
        rounds.retire(held)
        held = stars
        if now == seen or now["n"] == 0:
            break
        seen = now
    return nodes.join(stars.selectExpr("u AS id", "v"), "id", "left").selectExpr("id", "coalesce(v, id) AS label")


def label_cells(vox: DataFrame, offsets=lattice.FORWARD, ident: str = "gid") -> DataFrame:
    """Connected components of member cells: the input with ``label`` (smallest id of the part).

    Parts are found inside tiles first; only tiles that touch link their parts, so the rounds of ``components`` take
    parts at a tile's faces instead of cells. Input and result are written, so neither is computed again for every
    place of a plan that names it.
    """
    rounds = Rounds(vox.sparkSession, "label-cells")
    names = [ident, *[c for c in vox.columns if c != ident]]
    vox, extent = rounds.save(vox.where(f"{ident} IS NOT NULL").select(*names), **tiles.box())
    tiling = tiles.Tiling(extent, offsets)
    schema = T.StructType([*vox.schema.fields, T.StructField("label", T.LongType())])
    found = tiling.sorted(vox.where(tiles.PLACED)).mapInArrow(tiles.labelled(tiling, ident, names), schema)
    alone = vox.where(f"NOT ({tiles.PLACED})").selectExpr("*", f"cast({ident} AS bigint) AS label")
    out, _ = rounds.save(found.unionByName(alone))
    rounds.retire(vox)
    if tiling.single:
        return out
    faces = out.where(tiling.rim()).selectExpr(*lattice.CELL, "label", *tiling.columns())
    told = lattice.announce(faces, offsets, ["label AS a", *[f"{t} AS from_{t}" for t in tiles.TILE]])
    links = told.join(faces.withColumnRenamed("label", "b"), lattice.CELL).where(
        " OR ".join(f"{t} <> from_{t}" for t in tiles.TILE)).select("a", "b").distinct()
    links, _ = rounds.save(links)
    joined = components(links.selectExpr("explode(array(a, b)) AS id").distinct(), links).selectExpr("id AS label", "label AS part")
    whole, _ = rounds.save(out.join(joined, "label", "left").select(*names, F.expr("coalesce(part, label) AS label")))
    rounds.retire(out)
    return whole


FACE_FORWARD = [o for o in lattice.FACE if o > (0, 0, 0)]


def roots(pointers: DataFrame) -> DataFrame:
    """Follow ``id -> parent`` to the end: ``id, root``. A row without parent points to itself.

    Settled rows leave the loop, so a root that everything points to is not joined again.
    """
    rounds = Rounds(pointers.sparkSession, "roots")
    start = pointers.selectExpr("id", "coalesce(parent, id) AS p")
    ends = start.where("p = id").selectExpr("id AS p", "true AS stop")
    now = start.join(ends, "p", "left").selectExpr("id", "p", "p = id OR coalesce(stop, false) AS done")
    table, state = rounds.save(now, left=F.expr("count_if(NOT done)"))
    for _ in range(STALLED):
        if state["left"] == 0:
            return table.selectExpr("id", "p AS root")
        ahead = table.selectExpr("id AS p", "p AS q", "done AS end")
        moved = table.where("NOT done").join(ahead, "p").selectExpr("id", "q AS p", "end AS done")
        old = table
        table, state = rounds.save(table.where("done").unionByName(moved), left=F.expr("count_if(NOT done)"))
        rounds.retire(old)
    raise RuntimeError("pointers contain a cycle")


def flood(cells: DataFrame, sources: DataFrame, budget: float, weight, offsets=lattice.FULL,
          hops: int = 2, distance: str = "double") -> DataFrame:
    """Shortest distance from the nearest source through ``cells``, at most ``budget``.

    ``cells`` and ``sources`` hold ``case_id, z, y, x, gid``. Sources cost nothing and are never
    entered again, so links between sources drop out. Returns ``case_id, z, y, x, gid, dist, parent,
    source``; unreached cells are absent. Of equally near sources the smallest id counts.

    Tiles settle by themselves and offer what reaches their faces to the tiles beside them; a job settles all tiles that
    have offers, and the flood ends when none is left. A small lattice is one tile and takes one job, a large one
    as many as its ways cross tiles. ``hops`` is kept for callers and has no effect.
    """
    cell = lattice.CELL
    kind = "double" if distance == "double" else "bigint"
    rounds = Rounds(cells.sparkSession, "flood")
    place = ["case_id", *[f"cast({c} AS int) AS {c}" for c in tiles.AXES], "cast(gid AS bigint) AS gid"]
    unset = [f"cast(NULL AS {kind}) AS dist", *[f"cast(NULL AS bigint) AS {c}" for c in tiles.STATE[1:]]]
    begun = [f"cast(0 AS {kind}) AS dist", "cast(gid AS bigint) AS source", "0L AS hop", "cast(NULL AS bigint) AS parent"]
    field, extent = rounds.save(cells.where(f"{tiles.PLACED} AND gid IS NOT NULL").selectExpr(*place, "false AS start", *unset).unionByName(
        sources.selectExpr(*place, "true AS start", *begun)), **tiles.box())
    tiling = tiles.Tiling(extent, offsets)
    weights = [float(str(weight(*o)).rstrip("D")) for o in offsets]
    step = lambda rows, first: tiling.sorted(rows).mapInArrow(
        tiles.relaxed(tiling, weights, budget, distance, first), rows.schema)
    placed = f"{tiles.PLACED} AND gid IS NOT NULL"
    state, now = rounds.save(step(field.where(placed), True), offers=F.expr("count_if(gid IS NULL)"))
    while now["offers"]:
        offers = state.where("gid IS NULL").groupBy(*cell).agg(
            F.expr(f"min(struct({', '.join(tiles.STATE)})) AS s")).selectExpr(*cell, "cast(NULL AS bigint) AS gid", "false AS start", "s.*")
        offers, _ = rounds.save(offers)
        at = offers.selectExpr("case_id", *tiling.columns()).distinct()
        members = state.where("gid IS NOT NULL").selectExpr("*", *tiling.columns())
        on = ["case_id", *tiles.TILE]
        touched = members.join(at, on, "left_semi").select(*state.columns).unionByName(offers)
        rest = members.join(at, on, "left_anti").select(*state.columns)
        old = state
        state, now = rounds.save(step(touched, False).unionByName(rest), offers=F.expr("count_if(gid IS NULL)"))
        rounds.retire(old)
        rounds.retire(offers)
    apart = field.where(f"start AND NOT ({placed})").groupBy(*cell).agg(F.expr("min(gid) AS gid"))  # sources without a place
    return state.where("dist IS NOT NULL").selectExpr(*cell, "gid", f"cast(dist AS {distance}) AS dist", "parent", "source").unionByName(
        apart.selectExpr(*cell, "gid", f"cast(0 AS {distance}) AS dist", "cast(NULL AS bigint) AS parent", "gid AS source"))


def tube_stems(neck: DataFrame, core: DataFrame, dist: DataFrame, weight, slack: float, budget: float,
               hops: int = 2, distance: str = "double") -> DataFrame:
    """Neck cells on a shortest way to a core: ``gid, label`` of the core whose face they lead to.

    ``core`` carries ``label``; ``dist`` holds ``gid, dist`` of the first flood. A cell stays when its
    own distance plus the way to the face exceeds the face distance by at most ``slack``.
    """
    face = lattice.announce(neck, lattice.FULL).distinct().join(core, lattice.CELL)
    back = flood(neck, face, budget, weight, hops=hops, distance=distance)
    at = dist.selectExpr("gid", "dist AS d0")
    goal = face.join(at, "gid").selectExpr("gid AS source", "label", "d0 AS goal")
    return (back.join(neck.select("gid"), "gid", "left_semi").join(at, "gid").join(goal, "source")
            .where(f"d0 + dist - goal <= {slack}").select("gid", "label"))


def territory_joins(cells: DataFrame, label: str = "label", dist: str = "dist") -> DataFrame:
    """Lowest pass between touching territories: ``case_id, a, b, join_mm``."""
    pairs = lattice.edges(cells, "gid", carry=[label, dist]).where(f"src_{label} <> dst_{label}")
    return pairs.groupBy(
        "case_id", F.expr(f"least(src_{label}, dst_{label}) AS a"),
        F.expr(f"greatest(src_{label}, dst_{label}) AS b"),
    ).agg(F.expr(f"min(greatest(src_{dist}, dst_{dist})) AS join_mm"))


def contract(nodes: DataFrame, links: DataFrame, merges: str) -> DataFrame:
    """Visit links in ascending ``rank`` and merge the lower of two clusters into the higher.

    ``nodes``: ``id, peak``; ``links``: ``a, b, rank`` (any orderable type) and ``at`` (a double the
    rule may use). ``merges`` is SQL over ``lo_peak, at``. It must be monotone: once it refuses a lower
    cluster it refuses that cluster later too. Returns ``id, root``.

    A link that is the first one of its lower end can be decided at once: whatever the higher end has
    joined by then is higher still, so the lower end stays the lower one. If several clusters meet at that
    rank, which of them is the highest is known once none of them has an earlier link left. All links so
    decided go in one round, and a hub settles its lower neighbours together. Only a chain that rises with
    its ranks takes a round per link.
    """
    rounds = Rounds(nodes.sparkSession, "contract")
    tops, _ = rounds.save(nodes.selectExpr("id", "peak"))
    ordered = links.selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "rank", "at").where("a <> b")
    live, state = rounds.save(ordered, n=F.expr("count(1)"))
    moves = None
    while True:
        if state["n"] == 0:
            if moves is None:
                return tops.selectExpr("id", "id AS root")
            return roots(tops.select("id").join(moves.selectExpr("old AS id", "new AS parent"), "id", "left"))
        # one link per pair and its peaks; ends with equal peaks: the smaller id is the higher one
        pair = (live.groupBy("a", "b").agg(F.expr("min(struct(rank, at)) AS k"))
                .join(tops.selectExpr("id AS a", "peak AS pa"), "a")
                .join(tops.selectExpr("id AS b", "peak AS pb"), "b")
                .selectExpr("k.rank AS rank", "k.at AS at",
                            "CASE WHEN pa >= pb THEN a ELSE b END AS hi", "CASE WHEN pa >= pb THEN b ELSE a END AS lo",
                            "greatest(pa, pb) AS hi_peak", "least(pa, pb) AS lo_peak"))
        # at equal rank the higher partner comes first
        ends = pair.selectExpr("rank", "struct(-hi_peak AS p, hi, lo) AS k", f"({merges}) AS yes", "inline(array("
                               "struct(lo AS id, hi AS other, true AS low), struct(hi AS id, lo AS other, false AS low)))")
        ends, _ = rounds.save(ends)
        first = ends.groupBy("id").agg(F.expr("min(rank) AS rank"))
        own = ends.join(first, ["id", "rank"]).join(first.selectExpr("id AS other", "rank AS at_first"), "other")
        ready = own.groupBy("id").agg(F.expr("min(CASE WHEN low THEN struct(k, yes) END) AS m"),
                                      F.expr("count(1) = 1 OR bool_and(at_first >= rank) AS sure")).where("m IS NOT NULL AND sure")
        done, _ = rounds.save(ready.selectExpr("m.k.hi AS hi", "m.k.lo AS lo", "m.yes AS yes"))
        made = done.where("yes").selectExpr("lo AS id", "hi AS parent")
        stay = made.selectExpr("parent AS id").distinct().join(made.select("id"), "id", "left_anti").selectExpr("id", "id AS parent")
        step = roots(made.unionByName(stay)).where("id <> root").selectExpr("id AS old", "root AS new")
        moves = step if moves is None else moves.unionByName(step)
        refused = done.where("NOT yes").selectExpr("least(hi, lo) AS a", "greatest(hi, lo) AS b")
        rest = (live.join(refused, ["a", "b"], "left_anti")
                .join(step.selectExpr("old AS a", "new AS na"), "a", "left")
                .join(step.selectExpr("old AS b", "new AS nb"), "b", "left")
                .selectExpr("coalesce(na, a) AS a", "coalesce(nb, b) AS b", "rank", "at").where("a <> b")
                .selectExpr("least(a, b) AS a", "greatest(a, b) AS b", "rank", "at"))
        old = live
        live, state = rounds.save(rest, n=F.expr("count(1)"))
        rounds.retire(old)
