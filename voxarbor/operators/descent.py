"""Going on below a settled threshold by cutting out what only bone explains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.operators import graph, lattice
from voxarbor.session import Rounds

# Step below the settled share, cuts per step, smallest part and bright share that make a part bone.
STEP, CUTS, MIN_MM3, MIN_SHARE = 0.025, 3, 10.0, 0.10

Attempt = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame, DataFrame]]


def bone_like(cells: DataFrame, ceiling: DataFrame, min_cells: float, min_share: float = MIN_SHARE) -> DataFrame:
    """Cells of the parts that are bone: ``case_id, gid, label``.

    ``cells``: ``case_id, z, y, x, gid, hu``; ``ceiling``: ``case_id, ceiling``. A part (26 neighbours) is bone when it
    has ``min_cells`` and at least ``min_share`` of them are brighter than the case's ceiling.
    """
    parts = graph.label_cells(cells.select(*lattice.CELL, "gid", "hu")).join(ceiling, "case_id")
    bone = parts.groupBy("label").agg(F.expr("count(1) AS n"), F.expr("count_if(hu > ceiling) AS bright")).where(
        f"n >= {min_cells}D AND bright >= {min_share}D * n").select("label")
    return parts.join(bone, "label").select("case_id", "gid", "label")


def descend(settled: DataFrame, cells: DataFrame, traversal: DataFrame, light: DataFrame, attempt: Attempt, low: float,
            min_cells: float, step: float = STEP, cuts: int = CUTS,
            min_share: float = MIN_SHARE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Lower every case's threshold share step by step while its flood can be kept from leaking.

    ``settled``: ``case_id, f, ceiling`` and what ``attempt`` reads; ``cells`` and ``traversal``: the flood and the open
    cells at ``f``; ``light``: ``gid, hu``. ``attempt(wanted, cut)`` floods the wanted cases at their ``f`` without the cut
    cells (``case_id, gid``) and returns cells, ``case_id, leak`` and open cells. A step whose flood leaks cuts the
    bone-like parts of what it newly reached and tries again, at most ``cuts`` times; it stops the case if it still
    leaks or finds no such part, and what the last good step had stays. Nothing reached before is ever cut.

    All cases go through their steps together: one attempt per round floods each open case at its own share with its
    own cuts, so the rounds are those of the longest case. Returns the last good ``cells`` and ``traversal``,
    ``case_id, f, attempts`` and the cut cells ``case_id, gid, label``.
    """
    rounds = Rounds(settled.sparkSession, "descent")
    own = [c for c in settled.columns if c not in ("f", "best", "cuts", "attempts", "open")]
    state, now = rounds.save(settled.selectExpr(
        *own, f"f - {step!r}D AS f", "f AS best", "0 AS cuts", "0 AS attempts", f"f - {step!r}D >= {low - 1e-9!r}D AS open"),
        n=F.expr("count_if(open)"))
    good, _ = rounds.save(cells)
    way, _ = rounds.save(traversal)
    nothing = settled.sparkSession.createDataFrame([], "case_id bigint, gid bigint, label bigint")
    cut, _ = rounds.save(nothing)
    trial = cut
    while now["n"]:
        wanted = state.where("open")
        reached, report, opened = attempt(wanted, trial.select("case_id", "gid"))
        reached, _ = rounds.save(reached)
        opened, _ = rounds.save(opened)
        report, said = rounds.save(report.select("case_id", "leak"), leaks=F.expr("count_if(leak)"))
        fine = report.where("NOT leak").select("case_id")
        bone = nothing
        if said["leaks"]:
            again = wanted.where(f"cuts < {cuts}").join(report.where("leak"), "case_id").select("case_id", "ceiling")
            fresh = (reached.where("dist > 0").join(again.select("case_id"), "case_id", "left_semi")
                     .join(good.select("gid"), "gid", "left_anti").join(light.select("gid", "hu"), "gid"))
            bone, _ = rounds.save(bone_like(fresh, again, min_cells, min_share))

        def after(before: DataFrame, new: DataFrame) -> DataFrame:
            return before.join(fine, "case_id", "left_anti").unionByName(new.join(fine, "case_id", "left_semi"))

        old = [good, way, state, trial, cut]
        good, _ = rounds.save(after(good, reached.select(*good.columns)))
        way, _ = rounds.save(after(way, opened.select(*way.columns)))
        cut, _ = rounds.save(after(cut, trial))
        more = bone.select("case_id").distinct().withColumn("more", F.lit(True))
        going = fine.unionByName(more.select("case_id"))
        trial, _ = rounds.save(trial.join(going, "case_id", "left_semi").unionByName(bone))
        verdict = wanted.select("case_id").join(report, "case_id", "left").join(more, "case_id", "left").selectExpr(
            "case_id", "coalesce(NOT leak, false) AS fine", "coalesce(more, false) AS more", "true AS tried")
        state, now = rounds.save(state.join(verdict, "case_id", "left").selectExpr(
            *own, f"CASE WHEN fine THEN f - {step!r}D ELSE f END AS f", "CASE WHEN fine THEN f ELSE best END AS best",
            "CASE WHEN fine THEN 0 ELSE cuts + cast(coalesce(more, false) AS int) END AS cuts",
            "attempts + cast(coalesce(tried, false) AS int) AS attempts",
            f"open AND coalesce(fine AND f - {step!r}D >= {low - 1e-9!r}D OR more, false) AS open"), n=F.expr("count_if(open)"))
        for table in {id(t): t for t in (*old, reached, opened, report, bone)}.values():
            rounds.retire(table)
    return good, way, state.selectExpr("case_id", "best AS f", "attempts"), cut
