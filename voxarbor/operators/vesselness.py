"""Multi-scale tubular response: smoothing and second differences line by line, eigenvalues with the last axis.

One shuffle per axis serves all scales and all derivatives, and a task holds single grid lines, so no volume is ever
held by one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxarbor.operators import lattice
from voxarbor.operators.quantiles import exact_quantiles
from voxarbor.session import Rounds

SIGMAS = (0.8, 1.2, 1.8, 2.6, 3.6)  # fixed values, millimetres
RADIUS_PER_SIGMA = 1.85
REACH = 10.0  # cells of a part up to this far along it are summarised

# Orders of difference along x, y and z of the fields that are left after each axis.
AFTER = {"x": [(0,), (1,), (2,)],
         "y": [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 0)],
         "z": [(0, 0, 2), (0, 1, 1), (0, 2, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0)]}


@lru_cache(maxsize=256)
def _operators(places: bytes, sigma: float, step: float) -> tuple[np.ndarray, ...]:
    """Smoothing, first and second difference of the smoothed line as matrices over a line's present places.

    Weights reach to four sigma and are renormalised over what is present; a missing neighbour repeats the cell.
    """
    at = np.frombuffer(places, np.int64)
    off = np.abs(at[:, None] - at)
    wide = sigma / step
    weight = np.where(off <= int(4 * wide + 0.5), np.exp(-0.5 * (off / wide) ** 2), 0.0)
    smooth = weight / weight.sum(axis=1, keepdims=True)
    n = len(at)
    own, gap = np.arange(n), np.diff(at) == 1
    after = np.where(np.append(gap, False), own + 1, own)
    before = np.where(np.append(False, gap), own - 1, own)
    return (smooth, (smooth[after] - smooth[before]) / (2 * step), (smooth[after] - 2 * smooth + smooth[before]) / step ** 2)


def _along(line: DataFrame, axis: str, fields: int, sigmas: Sequence[float], step: float) -> DataFrame:
    """Fields of every cell after one axis: per line ``places`` and ``out``, one array per cell.

    It holds all scales' fields, after the last axis the answer.
    """
    before = [()] if axis == "x" else AFTER[chr(ord(axis) - 1)]
    plan = [(before.index(o[:-1]), o[-1]) for o in AFTER[axis]]

    def run(batches):
        for pdf in batches:
            alike, out = {}, [None] * len(pdf)  # lines with the same places are worked on together
            for row, (places, values) in enumerate(zip(pdf["places"], pdf["vals"])):
                at = np.asarray(places, np.int64)
                order = np.argsort(at)
                alike.setdefault((at[order] - at[order[0]]).tobytes(), []).append((row, order, np.stack(values)[order]))
            for places, lines in alike.items():
                held = np.stack([values for _, _, values in lines], axis=1)  # place, line, field
                made = np.empty((*held.shape[:2], len(sigmas) * len(plan)))
                for k, sigma in enumerate(sigmas):
                    ops = _operators(places, sigma, step)
                    base = 0 if axis == "x" else k * fields
                    for m, (i, d) in enumerate(plan):
                        made[:, :, k * len(plan) + m] = ops[d] @ held[:, :, base + i]
                if axis == "z":
                    made = _answer(made, sigmas)
                for n, (row, order, _) in enumerate(lines):
                    back = np.empty(made[:, n].shape)
                    back[order] = made[:, n]
                    out[row] = list(back)
            pdf["out"] = out
            yield pdf.drop(columns="vals")

    kinds = dict(line.dtypes)
    others = [c for c in line.columns if c not in ("places", "vals")]
    return line.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in others) + ", places array<int>, out array<array<double>>")


def _answer(fields: np.ndarray, sigmas: Sequence[float], alpha: float = 0.5, beta: float = 0.5, gamma: float = 5.0) -> np.ndarray:
    """Best response over the scales and its scale, from the second differences zz, zy, yy, zx, yx, xx of every scale.

    With eigenvalues by size |a| <= |b| <= |c| a bright tube has b and c below 0; the answer grows with |c| and the
    squared scale. The smallest scale wins a tie; the scale is 0 where nothing answers.
    """
    d = fields.reshape(*fields.shape[:-1], len(sigmas), 6)
    value = np.linalg.eigvalsh(np.stack([d[..., [0, 1, 3]], d[..., [1, 2, 4]], d[..., [3, 4, 5]]], axis=-1))
    value = np.take_along_axis(value, np.argsort(np.abs(value), axis=-1), axis=-1)
    a, b, c = np.moveaxis(np.abs(value), -1, 0)
    bright = (value[..., 1] < 0) & (value[..., 2] < 0)
    b, c = np.where(bright, b, 1.0), np.where(bright, c, 1.0)
    scale = np.asarray(sigmas, float)
    response = np.where(bright, (1 - np.exp(-0.5 * (b / c / alpha) ** 2)) * np.exp(-0.5 * (a / np.sqrt(b * c) / beta) ** 2)
                        * (1 - np.exp(-0.5 * (value ** 2).sum(axis=-1) / gamma ** 2)) * c * scale ** 2, 0.0)
    best = response.argmax(axis=-1)
    top = np.take_along_axis(response, best[..., None], axis=-1)[..., 0]
    return np.stack([top, np.where(top > 0, scale[best], 0.0)], axis=-1)


def vesselness(vox: DataFrame, spacing: Sequence[float], reference: str, value: str = "hu",
               sigmas: Sequence[float] = SIGMAS) -> DataFrame:
    """Best response over the scales and its scale: ``case_id, z, y, x, response, sigma``.

    ``vox``: ``case_id, z, y, x``, the value and its reference; spacing is (x, y, z). Values are taken relative to the
    reference and clipped. Axes are taken in the order x, y, z; on a full box the order doesn't matter.
    """
    sigmas = sorted(map(float, sigmas))
    now = vox.selectExpr(*lattice.CELL, f"array(greatest(-0.2D, least(1D, {value} / greatest(cast({reference} AS double), 1D)))) AS v")
    fields = 1
    for axis, step in zip("xyz", spacing):
        others = [c for c in lattice.CELL if c != axis]
        line = now.groupBy(*others).agg(F.expr(f"collect_list(struct({axis}, v)) AS s")).selectExpr(
            *others, f"s.{axis} AS places", "s.v AS vals")
        now = _along(line, axis, fields, sigmas, float(step)).select(
            *others, F.expr("inline(arrays_zip(places, out))")).withColumnsRenamed({"places": axis, "out": "v"})
        fields = len(AFTER[axis])
    return now.selectExpr(*lattice.CELL, "v[0] AS response", "v[1] AS sigma")


def crops(parts: DataFrame, image: DataFrame, spacing: Sequence[float], sigmas: Sequence[float] = SIGMAS, tile: int = 32) -> DataFrame:
    """Image cells in the box around every part, widened by two of the largest sigma: the image with ``label``.

    ``parts``: ``case_id, label, z, y, x``, labels unique over cases. Boxes and image meet by tiles.
    """
    margin = math.ceil(2 * max(sigmas) / min(spacing))
    box = parts.groupBy("case_id", "label").agg(*[F.expr(f"min({c}) - {margin} AS {c}0") for c in "zyx"],
                                                *[F.expr(f"max({c}) + {margin} AS {c}1") for c in "zyx"])
    for c in "zyx":
        box = box.withColumn(f"t{c}", F.explode(F.expr(f"sequence(cast(floor({c}0 / {tile}) AS int), cast(floor({c}1 / {tile}) AS int))")))
    keys = ["case_id", "tz", "ty", "tx"]
    cells = image.selectExpr("*", *[f"cast(floor({c} / {tile}) AS int) AS t{c}" for c in "zyx"])
    return cells.join(box, keys).where(" AND ".join(f"{c} BETWEEN {c}0 AND {c}1" for c in "zyx")).select(*image.columns, "label")


def tubularity(parts: DataFrame, image: DataFrame, spacing: Sequence[float], neck: float, reach: float = REACH,
               sigmas: Sequence[float] = SIGMAS) -> DataFrame:
    """How tubular the beginning of every part is: ``case_id, label, median_response, median_radius``.

    ``parts``: ``case_id, label, z, y, x, dist``; ``image``: ``case_id, z, y, x, hu, ref``. Every part is looked at in a
    crop of its own, and its cells beyond the neck up to ``reach`` count. A part without such cells has zeros.
    """
    rounds = Rounds(parts.sparkSession, "tubularity")
    near = crops(parts, image, spacing, sigmas).selectExpr("label AS case_id", "z", "y", "x", "hu", "ref")
    core = parts.where(f"dist > {neck} AND dist <= {reach}").selectExpr("label AS case_id", "z", "y", "x")
    seen, _ = rounds.save(vesselness(near, spacing, "ref", sigmas=sigmas).join(core, lattice.CELL))
    answer = exact_quantiles(seen, ["case_id"], "response", {"response": 0.5}).select("case_id", "response")
    scale = exact_quantiles(seen, ["case_id"], "sigma", {"sigma": 0.5}).select("case_id", "sigma")
    both = answer.join(scale, "case_id").withColumnRenamed("case_id", "label")
    return parts.select("case_id", "label").distinct().join(both, "label", "left").selectExpr(
        "case_id", "label", "coalesce(response, 0D) AS median_response", f"coalesce(sigma, 0D) * {RADIUS_PER_SIGMA}D AS median_radius")
