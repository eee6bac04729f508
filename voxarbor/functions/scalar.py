"""Column functions for geometry, ramps and identifiers. All stay inside codegen."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# --- ramps and bands -------------------------------------------------------------------------

def clip(v: Column, lo, hi) -> Column:
    return F.greatest(lit(lo), F.least(lit(hi), v))


def ramp(v: Column, onset: float, full: float) -> Column:
    """0 at ``onset``, 1 at ``full``; ``full`` below ``onset`` reverses it, equal knots give 0."""
    if onset == full:
        return F.when(v.isNotNull(), F.lit(0.0))
    return clip((v - F.lit(float(onset))) / F.lit(float(full - onset)), 0.0, 1.0)


def _rise(v: Column, a, b) -> Column:
    return clip((v - lit(a)) / F.greatest(lit(b) - lit(a), F.lit(1e-6)), 0.0, 1.0)


def trapezoid(v: Column, knots: Sequence) -> Column:
    """Membership that rises over the first two knots and falls over the last two."""
    a, b, c, d = knots
    fall = clip((lit(d) - v) / F.greatest(lit(d) - lit(c), F.lit(1e-6)), 0.0, 1.0)
    return F.least(_rise(v, a, b), fall)


# Fixed values of the brightness band and of the noise ratios that tighten it.
LUMEN_KNOTS = (0.35, 0.60, 1.35, 2.00)
NOISE_CLEAN, NOISE_FULL, MAX_TIGHTENING = 0.20, 0.60, 0.25


def adaptive_band(noise: Column, span: Column, reference: Column, threshold: Column,
                  knots: Sequence[float] = LUMEN_KNOTS) -> tuple[Column, list[Column]]:
    """Raise the two lower knots for noisy tissue or a small contrast margin.

    Returns ``(tightening in 0..1, four knots)``; the stronger of both reasons counts.
    """
    noisy = ramp(noise / F.greatest(span, F.lit(1e-6)), NOISE_CLEAN, NOISE_FULL)
    margin = (reference - threshold) / F.greatest(F.abs(reference), F.lit(1e-6))
    tight = F.greatest(noisy, clip(F.lit(1.0) - margin * 2.0, 0.0, 1.0))
    low = [F.lit(float(k)) + tight * MAX_TIGHTENING for k in knots[:2]]
    return tight, low + [F.lit(float(k)) for k in knots[2:]]


# --- nulls and finiteness ---------------------------------------------------------------------

def num(v: Column, default: float = 0.0) -> Column:
    return F.coalesce(v.cast("double"), F.lit(float(default)))


def finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


# --- three-component vectors held as columns --------------------------------------------------

def dot3(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def norm3(a: Sequence[Column]) -> Column:
    return F.sqrt(dot3(a, a))


def cross3(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def sub3(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def dist3(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return norm3(sub3(a, b))


def unit3(a: Sequence[Column]) -> list[Column]:
    n = norm3(a)
    return [F.when(n > 0, c / n).otherwise(F.lit(0.0)) for c in a]


def angle_deg(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Angle in degrees; 0 when either vector has no length."""
    n = norm3(a) * norm3(b)
    return F.when(n > 0, F.degrees(F.acos(clip(dot3(a, b) / n, -1.0, 1.0)))).otherwise(F.lit(0.0))


def perpendicular_pair(d: Sequence[Column]) -> tuple[list[Column], list[Column]]:
    """Two unit vectors perpendicular to unit ``d``; the helper axis is y once |x| exceeds 0.9."""
    steep = F.abs(d[0]) > 0.9
    helper = [F.when(steep, F.lit(0.0)).otherwise(F.lit(1.0)),
              F.when(steep, F.lit(1.0)).otherwise(F.lit(0.0)), F.lit(0.0)]
    first = unit3(cross3(d, helper))
    return first, cross3(d, first)


def rotate3(v: Sequence[Column], axis: Sequence[Column], angle: Column) -> list[Column]:
    """Rotate ``v`` about unit ``axis`` by ``angle`` radians."""
    c, s = F.cos(angle), F.sin(angle)
    turned, along = cross3(axis, v), dot3(axis, v)
    return [v[i] * c + turned[i] * s + axis[i] * along * (1 - c) for i in range(3)]


def segment_distance(p: Sequence[Column], a: Sequence[Column], b: Sequence[Column]) -> Column:
    ab, ap = sub3(b, a), sub3(p, a)
    length = dot3(ab, ab)
    t = F.when(length > 0, clip(dot3(ap, ab) / length, 0.0, 1.0)).otherwise(F.lit(0.0))
    return norm3([ap[i] - ab[i] * t for i in range(3)])


def array3(name: str) -> list[Column]:
    return [F.col(name)[i] for i in range(3)]


# --- grids ------------------------------------------------------------------------------------
# direction is a row-major 3x3 array, spacing and origin are (x, y, z).

def index_to_physical(index: Sequence[Column], spacing: Column, origin: Column,
                      direction: Column) -> list[Column]:
    step = [index[j] * spacing[j] for j in range(3)]
    return [origin[i] + sum((direction[3 * i + j] * step[j] for j in range(1, 3)),
                            direction[3 * i] * step[0]) for i in range(3)]


def physical_to_index(point: Sequence[Column], spacing: Column, origin: Column,
                      direction: Column) -> list[Column]:
    rel = [point[i] - origin[i] for i in range(3)]
    return [sum((direction[3 * i + j] * rel[i] for i in range(1, 3)), direction[j] * rel[0])
            / spacing[j] for j in range(3)]


def voxel_radius(mm: Column, spacing: Column) -> Column:
    """Whole voxels that cover ``mm``, rounded half to even and at least one."""
    return F.greatest(F.lit(1), F.bround(mm / spacing).cast("int"))


def flat_id(z: Column, y: Column, x: Column, ny, nx) -> Column:
    return ((z * lit(ny) + y) * lit(nx) + x).cast("bigint")


def unflatten(vid: str, ny: int, nx: int) -> tuple[Column, Column, Column]:
    return (F.expr(f"cast({vid} div {ny * nx} as int)"),
            F.expr(f"cast(({vid} div {nx}) % {ny} as int)"),
            F.expr(f"cast({vid} % {nx} as int)"))


def voxel_volume(spacing: Column) -> Column:
    return spacing[0] * spacing[1] * spacing[2]


def longest_edge(spacing: Column) -> Column:
    return F.sqrt(spacing[0] ** 2 + spacing[1] ** 2 + spacing[2] ** 2)


def disc_radius(area: Column) -> Column:
    return F.sqrt(area / F.lit(math.pi))


def band_radius(count: Column, volume, window) -> Column:
    """Radius of the disc with the volume ``count`` voxels spread over a ``window`` mm length."""
    return F.sqrt(count * lit(volume) / (lit(window) * F.lit(math.pi)))


def peak_floor(spacing: Column, base: float = 1.0) -> Column:
    return F.lit(base) + 0.5 * (spacing[0] + spacing[1] + spacing[2]) / 3


def leak_margin(median: Column, threshold: Column, reference: Column) -> Column:
    """How far the median sits above the threshold as a share of the way to the reference."""
    span = F.greatest(reference - threshold, F.lit(1e-6))
    return F.coalesce(clip((median - threshold) / span, 0.0, 2.0), F.lit(0.0))


def lumen_reference(median: Column, p25: Column, p75: Column, spread: float = 150.0) -> Column:
    """Upper quartile for a wide, mixed lumen, otherwise the median."""
    return F.when(p75 - p25 > spread, p75).otherwise(median)


# --- text -------------------------------------------------------------------------------------

def spacing_tag(spacing: Column) -> Column:
    same = (spacing[0] == spacing[1]) & (spacing[1] == spacing[2])
    return F.when(same, F.lit("iso")).otherwise(F.lit("aniso"))


def case_id_from_path(path: Column) -> Column:
    """Parent folder name, else the file name without its extension."""
    parts = F.split(path, "/")
    parent = F.when(F.size(parts) > 1, F.nullif(F.element_at(parts, -2), F.lit("")))
    stem = F.regexp_replace(F.element_at(parts, -1), r"(\.nii\.gz|\.nii|\.[^.]+)$", "")
    return F.coalesce(parent, stem)


def branch_id(rank: Column) -> Column:
    return F.format_string("branch_%03d", rank)
