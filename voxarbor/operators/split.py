"""Splitting one flooded component into the instances that leave the trunk separately."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.operators import graph, lattice
from voxarbor.session import Rounds

# Minimum depth of a saddle, as length and as share of the peak, and minimum half width.
MIN_DEPTH, DEPTH_SHARE, MIN_PEAK = 0.8, 0.2, 1.0


def ascend(cells: DataFrame, height: str, offsets=lattice.FULL) -> DataFrame:
    """Local top each cell climbs to: input with ``basin`` (id of the top). The smaller id is higher on a tie."""
    own = cells.selectExpr(*lattice.CELL, "gid AS own", f"struct({height} AS h, -gid AS g) AS s")
    told = lattice.announce(cells, offsets, ["cast(NULL AS bigint) AS own", f"struct({height} AS h, -gid AS g) AS s"])
    up = own.unionByName(told).groupBy(*lattice.CELL).agg(F.expr("max(own) AS id"), F.expr("-max(s).g AS parent"))
    tops = graph.roots(up.where("id IS NOT NULL").select("id", "parent"))
    return cells.join(tops.selectExpr("id AS gid", "root AS basin"), "gid")


def saddles(cells: DataFrame, height: str, offsets=lattice.FULL) -> DataFrame:
    """Links between basins that meet at a cell: ``a, b, rank, at``, highest meeting first.

    A cell sees the basins of its higher neighbours, at most as many as there are offsets.
    """
    told = lattice.announce(cells, offsets, [f"struct({height} AS h, -gid AS g) AS s", "basin"])
    here = cells.selectExpr(*lattice.CELL, "gid", f"{height} AS h")
    met = (told.join(here, lattice.CELL).where("s > struct(h, -gid)").groupBy("gid", "h")
           .agg(F.expr("collect_set(basin) AS b")).where("size(b) > 1"))
    return met.selectExpr("struct(-h AS h, gid AS g) AS rank", "cast(h AS double) AS at", """
        inline(flatten(transform(b, p -> transform(filter(b, q -> q > p), q -> struct(p AS a, q AS b)))))""")


def watershed(cells: DataFrame, height: str = "height", min_peak: float = MIN_PEAK, min_depth: float = MIN_DEPTH,
              depth_share: float = DEPTH_SHARE, offsets=lattice.FULL) -> DataFrame:
    """Basins of a height field after merging the shallow and the narrow ones: input with ``basin``.

    Going down the levels, the lower of two meeting basins joins the higher one when its top is below
    ``min_peak`` or rises less than ``max(min_depth, depth_share * top)`` above the saddle.
    """
    rounds = Rounds(cells.sparkSession, "watershed")
    climbed, _ = rounds.save(ascend(cells, height, offsets))
    tops = climbed.where("gid = basin").selectExpr("gid AS id", f"cast({height} AS double) AS peak")
    rule = f"lo_peak < {min_peak}D OR lo_peak - at < greatest({min_depth}D, {depth_share}D * lo_peak)"
    merged = graph.contract(tops, saddles(climbed, height, offsets), rule)
    return (climbed.join(merged.selectExpr("id AS basin", "root"), "basin").drop("basin")
            .withColumnRenamed("root", "basin"))


def patch_field(patch: DataFrame, shell: DataFrame, shape: tuple[int, int, int], weight, budget: float = 50.0,
                margin: int = 3, distance: str = "double") -> DataFrame:
    """Contact patches with their holes filled, and how wide they are: ``case_id, label, z, y, x, gid, filled, height``.

    ``patch``: ``case_id, label, z, y, x``, labels unique over cases; ``shell``: the cells around the trunk. A patch is a
    curved sheet, so its width is the way along the shell to the nearest shell cell beside the patch. Pockets of
    shell that the patch encloses belong to it (``filled``): within the patch's box, widened by ``margin``, they don't
    reach the border. Cells no way leads to are ``budget`` high; ``height`` is NULL where nothing of the shell is left
    beside the patch. ``gid`` numbers the cells of all patches in order of label and place.
    """
    rounds = Rounds(patch.sparkSession, "patch-field")
    top = dict(zip("zyx", (n - 1 for n in shape)))
    box = patch.groupBy("case_id", "label").agg(
        *[F.expr(f"greatest(min({c}) - {margin}, 0) AS {c}0") for c in "zyx"],
        *[F.expr(f"least(max({c}) + {margin}, {top[c]}) AS {c}1") for c in "zyx"])
    tile = 16  # boxes and shell meet by tiles of this edge
    for c in "zyx":
        box = box.withColumn(f"t{c}", F.explode(F.expr(f"sequence({c}0 div {tile}, {c}1 div {tile})")))
    near = shell.selectExpr(*lattice.CELL, *[f"cast({c} div {tile} AS bigint) AS t{c}" for c in "zyx"]).join(
        box.selectExpr("case_id", "label", *[f"{c}{k}" for c in "zyx" for k in (0, 1)],
                       *[f"cast(t{c} AS bigint) AS t{c}" for c in "zyx"]), ["case_id", "tz", "ty", "tx"]).where(
        " AND ".join(f"{c} BETWEEN {c}0 AND {c}1" for c in "zyx"))
    crop = near.select("case_id", "label", "z", "y", "x", F.expr(
        "z IN (z0, z1) OR y IN (y0, y1) OR x IN (x0, x1) AS edge")).join(
        patch.selectExpr("label", "z", "y", "x", "true AS own"), ["label", "z", "y", "x"], "left")
    order = ["label", "z", "y", "x"]
    crop, _ = rounds.save(crop.repartitionByRange(*order).sortWithinPartitions(*order).selectExpr(
        "case_id AS volume", "label AS case_id", "z", "y", "x", "monotonically_increasing_id() AS gid", "edge",
        "coalesce(own, false) AS own"))
    beside = graph.label_cells(crop.where("NOT own"))
    open_, _ = rounds.save(beside.where("edge").select("label").distinct())
    rim = beside.join(open_, "label", "left_semi")
    holes = beside.join(open_, "label", "left_anti")
    closed, _ = rounds.save(crop.where("own").selectExpr("volume", *lattice.CELL, "gid", "false AS filled").unionByName(
        holes.selectExpr("volume", *lattice.CELL, "gid", "true AS filled")))
    way = graph.flood(closed, rim, budget, weight, distance=distance).select("gid", "dist")
    beaten = rim.select("case_id").distinct().withColumn("some", F.lit(True))
    return closed.join(way, "gid", "left").join(beaten, "case_id", "left").selectExpr(
        "volume AS case_id", "case_id AS label", "z", "y", "x", "gid", "filled",
        f"CASE WHEN some THEN coalesce(dist, cast({budget} AS {distance})) END AS height")


def patch_origins(field: DataFrame, min_peak: float = MIN_PEAK, min_depth: float = MIN_DEPTH,
                  depth_share: float = DEPTH_SHARE) -> tuple[DataFrame, DataFrame]:
    """Origins on the contact patches: one per piece of a patch and per basin of a piece.

    ``field``: as ``patch_field`` returns it. Returns the field's cells with ``origin`` (``gid`` of the basin's top) and
    ``case_id, label, origin, piece, peak, saddle``. A piece is named by its first cell; ``saddle`` is the highest
    meeting with a higher basin, NULL for the highest of a piece. A patch without a rim is one origin without a peak.
    """
    rounds = Rounds(field.sparkSession, "patch-origins")
    rows, _ = rounds.save(field)
    solo = rows.where("height IS NOT NULL").selectExpr("label AS case_id", "z", "y", "x", "gid", "cast(height AS double) AS height")
    pieces = graph.label_cells(solo).selectExpr(*lattice.CELL, "gid", "height", "label AS piece")
    basins, _ = rounds.save(watershed(pieces, "height", min_peak, min_depth, depth_share))
    peaks = basins.groupBy(F.expr("case_id AS label"), F.expr("basin AS origin")).agg(
        F.expr("min(piece) AS piece"), F.expr("max(height) AS peak"))
    met = saddles(basins, "height").join(peaks.selectExpr("origin AS a", "peak AS pa"), "a").join(
        peaks.selectExpr("origin AS b", "peak AS pb"), "b")
    low = met.selectExpr("CASE WHEN pa >= pb THEN b ELSE a END AS origin", "at").groupBy("origin").agg(F.expr("max(at) AS saddle"))
    whole = rows.where("height IS NULL").groupBy("label").agg(F.expr("min(gid) AS origin"))
    origins = peaks.join(low, "origin", "left").select("label", "origin", "piece", "peak", "saddle").unionByName(
        whole.selectExpr("label", "origin", "origin AS piece", "cast(NULL AS double) AS peak", "cast(NULL AS double) AS saddle"))
    cells, _ = rounds.save(rows.join(basins.selectExpr("gid", "basin").unionByName(
        rows.where("height IS NULL").join(whole, "label").selectExpr("gid", "origin AS basin")), "gid").withColumnRenamed("basin", "origin"))
    owner = rows.select("case_id", "label").distinct()
    origins, _ = rounds.save(origins.join(owner, "label").select("case_id", "label", "origin", "piece", "peak", "saddle"))
    return cells, origins


def absorb(origins: DataFrame, joins: DataFrame, min_peak: float = MIN_PEAK) -> DataFrame:
    """Fold narrow origins into what they join first: ``id, root``.

    ``origins``: ``id, peak`` (a missing peak is wide enough); ``joins``: ``a, b, join_mm``. Lowest join first;
    of two origins with a narrow one between them the smaller peak goes into the larger.
    """
    wide = origins.selectExpr("id", "coalesce(peak, double('infinity')) AS peak")
    links = joins.selectExpr("a", "b", "struct(join_mm AS mm, a AS x, b AS y) AS rank", "cast(join_mm AS double) AS at")
    return graph.contract(wide, links, f"lo_peak < {min_peak}D")


def exits(flooded: DataFrame) -> DataFrame:
    """First cell outside the trunk on the way of every reached cell: ``gid, exit``."""
    outside = flooded.where("dist > 0").select("gid", "parent")
    inner = flooded.where("dist = 0").selectExpr("gid AS parent", "true AS trunk")
    chain = outside.join(inner, "parent", "left").selectExpr("gid AS id", "CASE WHEN trunk THEN NULL ELSE parent END AS parent")
    return graph.roots(chain).selectExpr("id AS gid", "root AS exit")


def instances(flooded: DataFrame, patches: DataFrame, min_length: float,
              min_peak: float = MIN_PEAK) -> tuple[DataFrame, DataFrame]:
    """Instances of a flood: territories of the origins on the contact patch, narrow ones absorbed.

    ``flooded``: ``case_id, z, y, x, gid, dist, parent``; ``patches``: patch cells ``gid, origin, peak``. Returns
    ``case_id, instance_id, n_cells, max_distance, n_absorbed, vessel_join_mm`` (map of the instances it touches),
    and the flooded cells with ``instance_id, exit``. An instance must still reach ``min_length`` after the split.
    """
    spark = flooded.sparkSession
    rounds = Rounds(spark, "instances")
    way = exits(flooded).join(patches.selectExpr("gid AS exit", "origin"), "exit")
    cells, _ = rounds.save(flooded.join(way.select("gid", "origin", "exit"), "gid"))
    joins, _ = rounds.save(graph.territory_joins(cells, "origin"))
    tops = patches.groupBy(F.expr("origin AS id")).agg(F.expr("max(peak) AS peak"))
    folded, _ = rounds.save(absorb(tops, joins, min_peak))
    final = cells.join(folded.selectExpr("id AS origin", "root AS instance_id"), "origin")
    size = final.groupBy("case_id", "instance_id").agg(
        F.expr("count(1) AS n_cells"), F.expr("max(dist) AS max_distance"),
        F.expr("cast(count(DISTINCT origin) - 1 AS int) AS n_absorbed")).where(f"max_distance >= {min_length}")
    left = joins.join(folded.selectExpr("id AS a", "root AS ra"), "a").join(folded.selectExpr("id AS b", "root AS rb"), "b")
    both = left.where("ra <> rb").selectExpr("inline(array(struct(ra AS instance_id, rb AS other, join_mm), struct(rb AS instance_id, ra AS other, join_mm)))")
    alive = size.select("instance_id")
    shared = (both.join(alive, "instance_id", "left_semi")
              .join(alive.withColumnRenamed("instance_id", "other"), "other", "left_semi")
              .groupBy("instance_id", "other").agg(F.expr("min(join_mm) AS mm"))
              .groupBy("instance_id").agg(F.expr("map_from_entries(collect_list(struct(other, mm))) AS vessel_join_mm")))
    table = size.join(shared, "instance_id", "left").selectExpr(
        "case_id", "instance_id", "n_cells", "max_distance", "n_absorbed",
        "coalesce(vessel_join_mm, map()) AS vessel_join_mm")
    return table, final.join(alive, "instance_id", "left_semi").drop("origin")
