"""Analytic test volumes: a straight trunk with capsule branches, generated as a voxel relation."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor import schema

# Fixed grid of the suite.
SPACINGS = {"0.8iso": (0.8, 0.8, 0.8), "1.5iso": (1.5, 1.5, 1.5), "0.7aniso": (0.7, 0.7, 1.5)}
LEVELS = (250.0, 400.0, 550.0)
COUNTS = (2, 5, 9)


@dataclass(frozen=True)
class Phantom:
    case_id: str
    spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)
    hu: float = 400.0
    background: float = 40.0
    size_mm: tuple[float, float, float] = (64.0, 64.0, 90.0)
    trunk_radius: float = 8.0
    trunk_z: tuple[float, float] = (10.0, 80.0)
    branches: tuple[tuple[float, float, float, float], ...] = ()  # z, azimuth in degrees, radius, length
    blobs: tuple[tuple[float, float, float, float, float], ...] = ()  # x, y, z, radius, hu
    noise: float = 0.0
    seed: int = 0
    tags: tuple[str, ...] = field(default=())

    @property
    def shape(self) -> tuple[int, int, int]:
        x, y, z = (int(round(m / s)) for m, s in zip(self.size_mm, self.spacing))
        return z, y, x

    def daughters(self) -> list[dict]:
        """Exact ostium, seed, radius and direction of every branch, by construction."""
        out, (cx, cy) = [], (self.size_mm[0] / 2, self.size_mm[1] / 2)
        for i, (z, azimuth, radius, _) in enumerate(self.branches, 1):
            d = (math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth)), 0.0)
            at = [cx + self.trunk_radius * d[0], cy + self.trunk_radius * d[1], z]
            out.append({"instance_id": f"branch_{i:03d}", "parent_instance_id": "aorta", "ostium_xyz_mm": at,
                        "seed_xyz_mm": [at[0] + 5 * d[0], at[1] + 5 * d[1], z], "radius_mm": radius, "direction_xyz": list(d)})
        return out

    def capsules(self) -> list[tuple]:
        """(ax, ay, az, bx, by, bz, radius, hu, trunk) of everything bright."""
        cx, cy = self.size_mm[0] / 2, self.size_mm[1] / 2
        rows = [(cx, cy, self.trunk_z[0], cx, cy, self.trunk_z[1], self.trunk_radius, self.hu, True)]
        for z, azimuth, radius, length in self.branches:
            far = self.trunk_radius + length
            dx, dy = math.cos(math.radians(azimuth)), math.sin(math.radians(azimuth))
            rows.append((cx, cy, z, cx + far * dx, cy + far * dy, z, radius, self.hu, False))
        rows += [(x, y, z, x, y, z, r, hu, False) for x, y, z, r, hu in self.blobs]
        return rows


def suite() -> list[Phantom]:
    """Three spacings, three brightness levels and three branch counts, then five special cases."""
    def fan(n):
        return tuple((20.0 + 50.0 * i / max(n - 1, 1), (137.5 * i) % 360, 1.5 + 0.25 * (i % 4), 16.0) for i in range(n))

    grid = [Phantom(f"{tag}_{int(hu)}_n{n}", s, hu, branches=fan(n), seed=k)
            for k, (tag, s, hu, n) in enumerate((t, s, hu, n) for t, s in SPACINGS.items() for hu in LEVELS for n in COUNTS)]
    special = [Phantom("truncated", branches=fan(3), trunk_z=(-20.0, 80.0), tags=("truncated",)),
               Phantom("non_contrast", hu=45.0, branches=fan(3), tags=("non_contrast",))]
    for i, share in enumerate((0.7, 1.0, 1.2)):
        special.append(Phantom(f"organ_bed_{i}", branches=fan(3), blobs=((50.0, 50.0, 45.0, 9.0, 400.0 * share),),
                               tags=("organ_bed",)))
    return grid + special


def voxels(spark: SparkSession, phantom: Phantom) -> DataFrame:
    """``case_id, z, y, x, vid, hu, in_mask`` of one phantom; the cells are made where they are needed."""
    nz, ny, nx = phantom.shape
    sx, sy, sz = phantom.spacing
    rows = ", ".join("struct({!r}D AS ax, {!r}D AS ay, {!r}D AS az, {!r}D AS bx, {!r}D AS `by`, {!r}D AS bz, {!r}D AS r, "
                     "{!r}D AS hu, {} AS trunk)".format(*c[:8], str(c[8]).lower()) for c in phantom.capsules())
    cell = spark.range(nz * ny * nx).selectExpr(
        "id AS vid", f"cast(id div {ny * nx} AS int) AS z", f"cast((id div {nx}) % {ny} AS int) AS y", f"cast(id % {nx} AS int) AS x")
    length = "((c.bx-c.ax)*(c.bx-c.ax) + (c.`by`-c.ay)*(c.`by`-c.ay) + (c.bz-c.az)*(c.bz-c.az))"
    along = (f"CASE WHEN {length} > 0 THEN greatest(0D, least(1D, ((px-c.ax)*(c.bx-c.ax) + (py-c.ay)*(c.`by`-c.ay) "
             f"+ (pz-c.az)*(c.bz-c.az)) / {length})) ELSE 0D END")
    gap = "sqrt(" + " + ".join(f"power(p{a} - c.a{a} - ({along}) * (c.{b} - c.a{a}), 2)"
                               for a, b in (("x", "bx"), ("y", "`by`"), ("z", "bz"))) + ")"
    hit = cell.selectExpr("*", f"x * {sx}D AS px", f"y * {sy}D AS py", f"z * {sz}D AS pz").selectExpr(
        "vid", "z", "y", "x", f"filter(array({rows}), c -> {gap} <= c.r) AS hit")
    noise = F.randn(phantom.seed) * phantom.noise if phantom.noise else F.lit(0.0)
    return hit.select(
        F.lit(phantom.case_id).alias("case_id"), "z", "y", "x", "vid",
        (F.expr(f"coalesce(array_max(transform(hit, c -> c.hu)), {phantom.background}D)") + noise).cast("float").alias("hu"),
        F.expr("exists(hit, c -> c.trunk)").alias("in_mask"))


def truth(spark: SparkSession, phantoms: list[Phantom]) -> DataFrame:
    """Nested reference records; a case without contrast has none."""
    rows = [(p.case_id, ("aorta",), [] if "non_contrast" in p.tags else p.daughters()) for p in phantoms]
    return spark.createDataFrame(rows, schema.PREDICTION)
