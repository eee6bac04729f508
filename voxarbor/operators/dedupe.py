"""Greedy de-duplication of ranked findings inside a case."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.session import Rounds

KEY = ["case_id", "id"]


def first_per_case(df: DataFrame, order: str, limit: int) -> DataFrame:
    """The first ``limit`` findings of each case in list order, where a report asks for that."""
    return (df.selectExpr("*", f"row_number() OVER (PARTITION BY case_id ORDER BY {order}) AS _k")
            .where(f"_k <= {limit}").drop("_k"))


HALF = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]


def conflicts(rows: DataFrame, conflict: str, reach: float) -> DataFrame:
    """``case_id, id, k_id, k_rank``: every row with the better-ranked rows it conflicts with.

    Only rows in neighbouring cells of ``reach`` meet, whatever the case holds, and each two cells meet once: which
    of two rows is the better one is seen when they have met. Rows travel with what the conflict reads.
    """
    read = dict.fromkeys(["id", "_rank", *re.findall(r"\b[kx]\.(\w+)", conflict)])
    own = rows.select("case_id", F.expr(f"struct({', '.join(read)}) AS r"),
                      *[F.expr(f"cast(floor({c} / {reach!r}D) AS bigint)").alias(f"_{c}") for c in "xyz"])
    moves = ", ".join(f"struct({a} AS a, {b} AS b, {c} AS c)" for a, b, c in HALF)
    told = own.select("case_id", F.col("r").alias("s"), F.explode(F.expr(f"array({moves})")).alias("o"), "_x", "_y", "_z").selectExpr(
        "case_id", "s", "o.a = 0 AND o.b = 0 AND o.c = 0 AS home", "_x + o.a AS _x", "_y + o.b AS _y", "_z + o.c AS _z")
    met = own.join(told, ["case_id", "_x", "_y", "_z"]).where("NOT home OR r._rank < s._rank").selectExpr(
        "case_id", "CASE WHEN r._rank < s._rank THEN r ELSE s END AS k", "CASE WHEN r._rank < s._rank THEN s ELSE r END AS x")
    return met.where(f"k._rank < x._rank AND ({conflict})").selectExpr("case_id", "x.id AS id", "k.id AS k_id", "k._rank AS k_rank")


def fold(df: DataFrame, rank: str, conflict: str, reach: float, accept: str = "true") -> DataFrame:
    """Walk each case from the best rank down and fold a row into the first kept row it conflicts with.

    ``df`` holds ``case_id, id, x, y, z``; ``conflict`` is SQL over ``k`` (a kept row) and ``x`` (the row at hand)
    and holds only within ``reach`` along each axis; ``rank`` is unique in a case. Adds ``folded_into``, NULL for
    kept rows; rows that fail ``accept`` are left out. The result is that of the walk, but rows decide at once: a
    row is kept when all better rows it conflicts with are folded, and folded when one of them is kept.
    """
    rounds = Rounds(df.sparkSession, "fold")
    rows, _ = rounds.save(df.where(accept).withColumn("_rank", F.expr(rank)))
    return _walk(rows, conflicts(rows, conflict, reach), rounds)


def fold_runs(df: DataFrame, rank: str, conflict: str, reach: float, accept: str, case: str) -> DataFrame:
    """``fold`` of rows that several runs rank anew at the same places: ``case`` is SQL for the case of a row's ``case_id``.

    The conflict is symmetric; places and what it reads are the same in every run of a case, so rows meet once, and a pair
    counts in every run that accepts both.
    """
    rounds = Rounds(df.sparkSession, "fold-runs")
    rows, _ = rounds.save(df.where(accept).withColumn("_rank", F.expr(rank)).withColumn("_case", F.expr(case)))
    read = [c for c in dict.fromkeys(["x", "y", "z", *re.findall(r"\b[kx]\.(\w+)", conflict)]) if c != "id"]
    places = rows.groupBy("_case", "id").agg(*[F.expr(f"min({c}) AS {c}") for c in read]).withColumnRenamed("_case", "case_id")
    near = conflicts(places.withColumn("_rank", F.col("id")), conflict, reach).selectExpr("case_id AS _case", "id", "k_id")
    own = rows.selectExpr("_case", "case_id", "id", "_rank")
    met = near.join(own, ["_case", "id"]).join(own.selectExpr("case_id", "id AS k_id", "_rank AS k_rank"), ["case_id", "k_id"])
    low = "k_rank < _rank"
    pairs = met.selectExpr("case_id", f"CASE WHEN {low} THEN id ELSE k_id END AS id", f"CASE WHEN {low} THEN k_id ELSE id END AS k_id",
                           "least(k_rank, _rank) AS k_rank")
    return _walk(rows.drop("_case"), pairs, rounds)


def _walk(rows: DataFrame, pairs: DataFrame, rounds: Rounds) -> DataFrame:
    """Decides the rows of all cases by their conflicts, as ``fold`` says."""
    # decisions read the pairs alone; the other columns come back at the end
    pairs, state = rounds.save(pairs, n=F.expr("count(1)"))
    if not state["n"]:
        return rows.drop("_rank").withColumn("folded_into", F.lit(None).cast(dict(rows.dtypes)["id"]))
    below = pairs.select(*KEY).distinct().withColumn("kept", F.lit(None).cast("boolean"))
    top = pairs.selectExpr("case_id", "k_id AS id").distinct().join(below, KEY, "left_anti").selectExpr(*KEY, "true AS kept")
    now, state = rounds.save(below.unionByName(top), left=F.expr("count_if(kept IS NULL)"))
    while state["left"]:
        step = now
        for _ in range(2):
            told = step.selectExpr("case_id", "id AS k_id", "kept AS k_kept")
            open_ = step.where("kept IS NULL").select(*KEY)
            news = pairs.join(open_, KEY, "left_semi").join(told, ["case_id", "k_id"]).groupBy(*KEY).agg(F.expr(
                "CASE WHEN bool_or(k_kept) THEN false WHEN count(k_kept) = count(1) THEN true END AS kept"))
            step = step.where("kept IS NOT NULL").unionByName(news)
        old = now
        now, state = rounds.save(step, left=F.expr("count_if(kept IS NULL)"))
        rounds.retire(old)
    kept = now.where("kept").selectExpr("case_id", "id AS k_id")
    into = (pairs.join(now.where("NOT kept").select(*KEY), KEY, "left_semi").join(kept, ["case_id", "k_id"], "left_semi")
            .groupBy(*KEY).agg(F.expr("min_by(k_id, k_rank) AS folded_into")))
    return rows.drop("_rank").join(into, KEY, "left").select(*[c for c in rows.columns if c != "_rank"], "folded_into")


def distance(a: str = "k", b: str = "x") -> str:
    return "sqrt(" + " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in "xyz") + ")"
