"""One-to-one matching of predicted and reference points, and the scores that follow from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxarbor.operators import graph, nearest
from voxarbor.session import Rounds

#: Pairs up to which a case is solved as one part; larger cases are taken apart by place.
ONE_PART = 20_000
FAR = 1e12  # stands for a pair that is not at hand


def assign(cost: list[list[float]]) -> tuple[list[int], list[float]]:
    """Column and potential of each row in a cheapest one-to-one assignment; rows must not outnumber columns.

    Rows enter one at a time along a shortest augmenting path under row and column potentials. Column potentials
    are never positive, and zero for columns that stay free. Plain lists: a part is a handful of points, where
    array calls cost more than the arithmetic.
    """
    n, m = len(cost), len(cost[0])
    u, v, owner = [0.0] * n, [0.0] * m, [-1] * m
    for row in range(n):
        short, back, used = [float("inf")] * m, [-1] * m, [False] * m
        at, col = row, -1
        while True:
            line, pu = cost[at], u[at]
            best, nxt = float("inf"), -1
            for j in range(m):
                if not used[j]:
                    d = line[j] - pu - v[j]
                    if d < short[j]:
                        short[j], back[j] = d, col
                    if short[j] < best:
                        best, nxt = short[j], j
            u[row] += best
            for j in range(m):
                if used[j]:
                    u[owner[j]] += best
                    v[j] -= best
                else:
                    short[j] -= best
            used[nxt], col = True, nxt
            if owner[nxt] < 0:
                break
            at = owner[nxt]
        while col >= 0:
            owner[col], col = (owner[back[col]] if back[col] >= 0 else row), back[col]
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out, u


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("u", T.DoubleType())])))
def _cheapest(rows: pd.Series, cols: pd.Series, dist: pd.Series) -> pd.Series:
    """Chosen pairs of each part as positions in its arrays, with the row's potential; empty if a row stays without."""
    out = []
    for r, c, d in zip(rows, cols, dist):
        i, j = ({k: at for at, k in enumerate(dict.fromkeys(side))} for side in (r, c))
        if len(i) > len(j):
            out.append([])
            continue
        cost, where = [[FAR] * len(j) for _ in i], {}
        for at, (a, b, value) in enumerate(zip(r, c, d)):
            cost[i[a]][j[b]] = float(value)
            where[i[a], j[b]] = at
        picks, u = assign(cost)
        whole = all(pair in where for pair in enumerate(picks))
        out.append([{"at": where[pair], "u": u[pair[0]]} for pair in enumerate(picks)] if whole else [])
    return pd.Series(out)


def _solved(pairs: DataFrame, part: list[str]) -> DataFrame:
    """Cheapest pairs of every part: its columns and ``row, col, dist, u`` and whatever else ``pairs`` holds."""
    rest = [c for c in pairs.columns if c not in part]
    return _picked(pairs.groupBy(*part).agg(F.expr(f"collect_list(struct({', '.join(rest)})) AS c")), part)


def _picked(case: DataFrame, part: list[str]) -> DataFrame:
    """As ``_solved``, from parts whose pairs are one array ``c``."""
    pick = case.select(*part, "c", _cheapest("c.row", "c.col", "c.dist").alias("best"))
    return pick.selectExpr(*part, "c", "inline(best)").selectExpr(*part, "c[at] AS k", "u").select(*part, "k.*", "u")


# A lone row takes the nearest column. Where every row lies on one column and no two on the same, no other choice costs nothing.
_SURE = """CASE WHEN n = 1 THEN array(array_min(c)) WHEN size(zero) = n AND size(array_distinct(transform(zero, k -> k.row))) = n
           AND size(array_distinct(transform(zero, k -> k.col))) = n THEN zero END AS sure"""


def _by_place(rows: DataFrame, cols: DataFrame, reach: float) -> DataFrame:
    """Cheapest assignment of large cases: ``case_id, row, col, dist``. Each case has at most as many rows as columns.

    Both sides hold ``case_id, id, x, y, z``. Rows look only as far as their reach, and what these pairs connect is
    solved as a part. A part is final if every row's potential is at most its reach: column potentials are not
    positive, so no pair beyond the reach can be worth more, and the parts' assignments together are a cheapest one
    of the case. The rows of other parts double their reach. A reach across the whole case is always final.
    """
    rounds = Rounds(rows.sparkSession, "match-parts")
    side = lambda df, odd: df.selectExpr("case_id", "id", "x", "y", "z", f"2 * monotonically_increasing_id() + {odd} AS node")
    rows, state = rounds.save(side(rows, 0), n=F.expr("count(1)"))
    cols, _ = rounds.save(side(cols, 1))
    span = rows.select("case_id", "x", "y", "z").unionByName(cols.select("case_id", "x", "y", "z")).groupBy("case_id").agg(F.expr(
        "sqrt(" + " + ".join(f"pow(max({c}) - min({c}), 2)" for c in "xyz") + ") AS span"))
    nodes, _ = rounds.save(rows.select(F.col("node").alias("id")).unionByName(cols.select(F.col("node").alias("id"))))
    targets = cols.selectExpr("case_id", "node AS id", "x", "y", "z")
    changed, pairs, final = rows, None, None
    while state["n"]:
        near = nearest.within_distance(changed.selectExpr("case_id", "node AS id", "x", "y", "z"), targets, ["case_id"], reach).join(
            span, "case_id").selectExpr("case_id", "id AS row", "other AS col", "dist", f"{reach!r}D AS reach", f"span <= {reach!r}D AS whole")
        moved = changed.selectExpr("node AS row")
        old = pairs
        pairs, _ = rounds.save(near if pairs is None else pairs.join(moved, "row", "left_anti").unionByName(near))
        rounds.retire(old)
        label, _ = rounds.save(graph.components(nodes, pairs.selectExpr("row AS a", "col AS b")))
        part = label.withColumnRenamed("id", "row")
        again, _ = rounds.save(part.join(moved, "row").select("label").distinct())
        mine, _ = rounds.save(rows.selectExpr("node AS row").join(part, "row").join(again, "label"))
        solved, _ = rounds.save(_solved(pairs.join(mine, "row"), ["label"]))
        good = solved.groupBy("label").agg(F.expr("bool_and(whole OR u <= reach) AS good")).where("good").select("label")
        kept = solved.join(good, "label").select("case_id", "row", "col", "dist")
        old = final
        final, _ = rounds.save(kept if final is None else final.join(mine.select("row"), "row", "left_anti").unionByName(kept))
        rounds.retire(old)
        changed, state = rounds.save(rows.join(mine.join(good, "label", "left_anti").selectExpr("row AS node"), "node", "left_semi"),
                                     n=F.expr("count(1)"))
        reach *= 2
        for table in (label, again, solved):
            rounds.retire(table)
    if final is None:
        return rows.selectExpr("case_id", "id AS row", "id AS col", "cast(NULL AS double) AS dist").limit(0)
    return final.join(rows.selectExpr("node AS row", "id AS r"), "row").join(cols.selectExpr("node AS col", "id AS c"), "col").selectExpr(
        "case_id", "r AS row", "c AS col", "dist")


def match(preds: DataFrame, refs: DataFrame, threshold: float, one_part: int = ONE_PART) -> DataFrame:
    """Pairs of the cheapest total assignment per case, those beyond ``threshold`` dropped afterwards.

    Both sides hold ``case_id, id, x, y, z``. The gate must not come first: a far pair can displace a
    near one. A case with at most ``one_part`` pairs is solved at once, larger ones by place, part by part
    (``_by_place``), so only what is proven to be bounded or connected meets in a task. The result is written
    once, so scores that use it several times do not assign again.
    """
    count = lambda df, name: df.groupBy("case_id").agg(F.expr(f"count(1) AS {name}"))
    rounds = Rounds(preds.sparkSession, "match")
    sizes, state = rounds.save(count(preds, "np").join(count(refs, "nr"), "case_id"), large=F.expr(f"count_if(np * nr > {one_part})"))
    turned = sizes.selectExpr("case_id", "np > nr AS turned", f"np * nr > {one_part} AS large", "least(np, nr) AS n")
    point = lambda df, name: df.selectExpr("case_id", f"id AS {name}", f"x AS {name}_x", f"y AS {name}_y", f"z AS {name}_z")
    square = " + ".join(f"(p_{c} - r_{c}) * (p_{c} - r_{c})" for c in "xyz")
    few = point(preds, "p").join(turned.where("NOT large"), "case_id").join(point(refs, "r"), "case_id").selectExpr(
        "case_id", "turned", "n", "CASE WHEN turned THEN r ELSE p END AS row", "CASE WHEN turned THEN p ELSE r END AS col",
        f"sqrt({square}) AS dist")
    parts = few.groupBy("case_id", "turned", "n").agg(F.expr("collect_list(struct(dist, row, col)) AS c")).selectExpr(
        "case_id", "turned", "n", "c", "filter(c, k -> k.dist = 0) AS zero")
    parts, _ = rounds.save(parts.selectExpr("case_id", "turned", "c", _SURE))
    out = parts.where("sure IS NOT NULL").selectExpr("case_id", "turned", "inline(sure)").select("case_id", "turned", "row", "col", "dist").unionByName(
        _picked(parts.where("sure IS NULL"), ["case_id", "turned"]).select("case_id", "turned", "row", "col", "dist"))
    if state["large"]:
        big = turned.where("large").select("case_id", "turned")
        pick = lambda a, b: a.join(big.where("NOT turned"), "case_id").unionByName(b.join(big.where("turned"), "case_id")).select(
            "case_id", "id", "x", "y", "z")
        found = _by_place(pick(preds, refs), pick(refs, preds), float(threshold))
        out = out.unionByName(found.join(big, "case_id").select("case_id", "turned", "row", "col", "dist"))
    return rounds.save(out.where(f"dist <= {threshold}").selectExpr(
        "case_id", "CASE WHEN turned THEN col ELSE row END AS pred_id", "CASE WHEN turned THEN row ELSE col END AS ref_id",
        "dist AS distance"))[0]


def outcome(preds: DataFrame, refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per point: ``case_id, kind, pred_id, ref_id, distance`` with kind tp, fp or fn."""
    cols = ["case_id", "kind", "pred_id", "ref_id", "distance"]
    tp = pairs.selectExpr("case_id", "'tp' AS kind", "pred_id", "ref_id", "distance")
    fp = preds.selectExpr("case_id", "id AS pred_id").join(pairs, ["case_id", "pred_id"], "left_anti")
    fn = refs.selectExpr("case_id", "id AS ref_id").join(pairs, ["case_id", "ref_id"], "left_anti")
    return (tp.select(*cols)
            .unionByName(fp.selectExpr("case_id", "'fp' AS kind", "pred_id", "NULL AS ref_id", "NULL AS distance"))
            .unionByName(fn.selectExpr("case_id", "'fn' AS kind", "NULL AS pred_id", "ref_id", "NULL AS distance")))


def rate(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} > 0 THEN ({top}) / cast({bottom} AS double) ELSE 0.0D END"


SCORES = (f"{rate('tp', 'tp + fp')} AS precision", f"{rate('tp', 'tp + fn')} AS recall",
          f"{rate('2 * tp', '2 * tp + fp + fn')} AS f1")


def case_scores(marks: DataFrame) -> DataFrame:
    """Precision, recall and F1 per case; 0 where nothing can be divided."""
    per = marks.groupBy("case_id").agg(*[F.expr(f"count_if(kind = '{k}') AS {k}") for k in ("tp", "fp", "fn")])
    return per.selectExpr("*", *SCORES)


def cohort_scores(per_case: DataFrame) -> DataFrame:
    """Micro scores over all counts and the mean F1 of the cases that have references."""
    total = per_case.agg(*[F.expr(f"sum({k}) AS {k}") for k in ("tp", "fp", "fn")],
                         F.expr("count(1) AS cases"),
                         F.expr("coalesce(avg(CASE WHEN tp + fn > 0 THEN f1 END), 0.0D) AS macro_f1"))
    return total.selectExpr("*", *SCORES)


def pair_errors(pairs: DataFrame) -> DataFrame:
    """Mean errors over matched pairs; 0 without matches, radius NULL when no reference has one.

    ``pairs`` holds ``ostium_error, seed_error, direction_error, radius, ref_radius``.
    """
    return pairs.agg(
        F.expr("count(1) AS matched"),
        *[F.expr(f"coalesce(avg({c}), 0.0D) AS {c}") for c in ("ostium_error", "seed_error", "direction_error")],
        F.expr("count(ref_radius) AS radius_n"),
        F.expr("CASE WHEN count(1) = 0 THEN 0.0D ELSE avg(abs(radius - ref_radius)) END AS radius_error"))


def drift(base: DataFrame, other: DataFrame, pairs: DataFrame, moved: float = 2.0) -> DataFrame:
    """Fate of every baseline point under a change: ``present``, ``moved``; and what appeared."""
    fate = (base.selectExpr("case_id", "id AS pred_id").join(pairs, ["case_id", "pred_id"], "left")
            .selectExpr("case_id", "pred_id AS id", "ref_id IS NOT NULL AS present",
                        f"coalesce(distance > {moved}, false) AS moved", "false AS appeared"))
    new = (other.selectExpr("case_id", "id AS ref_id").join(pairs, ["case_id", "ref_id"], "left_anti")
           .selectExpr("case_id", "ref_id AS id", "true AS present", "false AS moved", "true AS appeared"))
    return fate.unionByName(new)
