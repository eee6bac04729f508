"""NIfTI volumes as relations.

Files are found and read by Spark's ``binaryFile`` source; a small decoder streams each file slice by
slice, so a task holds one compressed file and one slice. Everything after that is relational.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor.functions.scalar import case_id_from_path

GRID = "struct<spacing: array<double>, origin: array<double>, direction: array<double>, size: array<int>>"
SLICES = f"case_id string, kind string, path string, error string, grid {GRID}, z int, values array<float>"

# Fixed values of the file format: data type code to element type.
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = 348


def decode_header(head: bytes) -> dict:
    """Grid in LPS millimetres, element type and scaling from the first 348 bytes.

    A sform that is close to a rotation is replaced by the nearest rotation (polar factor).
    """
    import numpy as np

    end = "<" if int.from_bytes(head[:4], "little") == HEADER else ">"
    if int.from_bytes(head[:4], "little" if end == "<" else "big") != HEADER:
        raise ValueError("not a NIfTI-1 header")

    def get(kind, at, n=1):
        return np.frombuffer(head, end + kind, n, at)

    dim, pix = get("i2", 40, 8), get("f4", 76, 8).astype(float)
    code = int(get("i2", 70)[0])
    if code not in TYPES:
        raise ValueError(f"data type {code} is not supported")
    size = [int(max(1, dim[i])) if i <= dim[0] else 1 for i in (1, 2, 3)]
    if get("i2", 254)[0] > 0:
        affine = np.stack([get("f4", at, 4) for at in (280, 296, 312)]).astype(float)
    elif get("i2", 252)[0] > 0:
        b, c, d = get("f4", 256, 3).astype(float)
        a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
        turn = np.array([[a*a + b*b - c*c - d*d, 2*(b*c - a*d), 2*(b*d + a*c)],
                         [2*(b*c + a*d), a*a + c*c - b*b - d*d, 2*(c*d - a*b)],
                         [2*(b*d - a*c), 2*(c*d + a*b), a*a + d*d - b*b - c*c]])
        turn[:, 2] *= -1.0 if pix[0] < 0 else 1.0
        affine = np.column_stack([turn * pix[1:4], get("f4", 268, 3)])
    else:
        affine = np.column_stack([np.diag(pix[1:4]), np.zeros(3)])
    affine[:2] *= -1  # RAS to LPS
    spacing = np.linalg.norm(affine[:, :3], axis=0)
    if not (spacing > 0).all():
        raise ValueError("the grid has no extent")
    left, _, right = np.linalg.svd(affine[:, :3] / spacing)
    direction = left @ right
    if np.abs(direction - affine[:, :3] / spacing).max() > 0.05:
        raise ValueError("the axes are too far from perpendicular")
    slope, inter = float(get("f4", 112)[0]), float(get("f4", 116)[0])
    usable = np.isfinite(slope) and slope != 0
    return {"dtype": end + TYPES[code], "start": int(get("f4", 108)[0]), "slope": slope if usable else 1.0,
            "inter": inter if usable and np.isfinite(inter) else 0.0,
            "grid": {"spacing": spacing.tolist(), "origin": affine[:, 3].tolist(),
                     "direction": direction.ravel().tolist(), "size": size}}


def _stream(content: bytes):
    """``read(n)`` over the content, decompressing on the way when it starts with the gzip magic."""
    import gzip
    import io

    raw = io.BytesIO(content)
    return gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw


def _slices(batches):
    import numpy as np
    import pandas as pd

    for pdf in batches:
        for case_id, kind, path, content in zip(pdf.case_id, pdf.kind, pdf.path, pdf.content):
            base = {"case_id": case_id, "kind": kind, "path": path, "error": None, "grid": None, "z": None, "values": None}
            try:
                src = _stream(content)
                head = decode_header(src.read(HEADER))
                src.read(max(0, head["start"] - HEADER))
                nx, ny, nz = head["grid"]["size"]
                kind_np = np.dtype(head["dtype"])
                for z in range(nz):
                    raw = src.read(nx * ny * kind_np.itemsize)
                    if len(raw) < nx * ny * kind_np.itemsize:
                        raise ValueError(f"the file ends in slice {z}")
                    v = np.frombuffer(raw, kind_np).astype("f4") * np.float32(head["slope"]) + np.float32(head["inter"])
                    yield pd.DataFrame([{**base, "grid": head["grid"], "z": z, "values": v}])
            except (ValueError, OSError, EOFError, zlib.error) as e:
                yield pd.DataFrame([{**base, "error": str(e)}])


def list_files(spark: SparkSession, root: str, cases: list[str] | None = None) -> DataFrame:
    """Image and mask files below ``root`` by the name prefixes orig and mask: ``case_id, kind`` and what the file source tells."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.nii*")
             .load(root))
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(case_id_from_path(F.col("path")).alias("case_id"),
                         F.when(name.startswith("orig"), "image").when(name.startswith("mask"), "mask").alias("kind"),
                         "path", "length", "modificationTime", "content").where("kind IS NOT NULL")
    return found.where(F.col("case_id").isin(cases)) if cases else found


def list_cases(spark: SparkSession, root: str, cases: list[str] | None = None) -> DataFrame:
    """Contents of the files to read: ``case_id, kind, path, content``."""
    return list_files(spark, root, cases).select("case_id", "kind", "path", "content")


def read_slices(files: DataFrame) -> DataFrame:
    """Decoded slices; a file that cannot be read gives one row with ``error`` and no slices."""
    return files.mapInPandas(_slices, SLICES)


def grids(slices: DataFrame) -> DataFrame:
    return slices.where("z = 0").select("case_id", "kind", "path", "grid")


def grid_mismatch(image: str = "i", mask: str = "m") -> str:
    """SQL for the first way in which two grids differ, NULL when they agree."""
    def far(field, tol):
        return f"exists(zip_with({image}.{field}, {mask}.{field}, (a, b) -> abs(a - b) > {tol}D), c -> c)"

    return (f"CASE WHEN {image}.size <> {mask}.size THEN 'size' WHEN {far('spacing', 1e-4)} THEN 'spacing' "
            f"WHEN {far('origin', 1e-3)} THEN 'origin' WHEN {far('direction', 1e-4)} THEN 'direction' END")


def load_pairs(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases whose image and mask share one grid, and a row with the problem for every other case."""
    g = grids(slices)
    image = g.where("kind = 'image'").selectExpr("case_id", "grid AS i")
    mask = g.where("kind = 'mask'").selectExpr("case_id", "grid AS m")
    broken = slices.where("error IS NOT NULL").groupBy("case_id").agg(F.expr("min(error) AS error"))
    both = image.join(mask, "case_id", "full").join(broken, "case_id", "full").selectExpr(
        "case_id", "i AS grid", "CASE WHEN error IS NOT NULL THEN error WHEN i IS NULL THEN 'no image' "
        f"WHEN m IS NULL THEN 'no mask' ELSE {grid_mismatch()} END AS problem")
    return both.where("problem IS NULL").select("case_id", "grid"), both.where("problem IS NOT NULL").select("case_id", "problem")


def voxels(slices: DataFrame, good: DataFrame) -> DataFrame:
    """``case_id, z, y, x, vid, hu, in_mask`` of the loaded cases."""
    held = slices.join(good.select("case_id"), "case_id", "left_semi").where("z IS NOT NULL")
    image = held.where("kind = 'image'").selectExpr("case_id", "z", "grid.size[0] AS nx", "grid.size[1] AS ny", "values AS hu")
    mask = held.where("kind = 'mask'").selectExpr("case_id", "z", "values AS m")
    # slices meet, not voxels: the pairs of values are taken apart after the join
    cell = image.join(mask, ["case_id", "z"]).selectExpr("case_id", "z", "nx", "ny", "posexplode(arrays_zip(hu, m)) AS (p, v)")
    return cell.selectExpr("case_id", "z", "cast(p div nx AS int) AS y", "cast(p % nx AS int) AS x",
                           "cast((z * ny) * nx + p AS bigint) AS vid", "v.hu AS hu", "coalesce(v.m > 0, false) AS in_mask")
