"""Transparent scoring: a declarative rule table turned into column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxarbor.functions.scalar import clip, num, ramp


@dataclass(frozen=True)
class Ramp:
    name: str
    value: Column
    onset: float
    full: float
    weight: float
    note: str = ""

    def penalty(self) -> Column:
        return ramp(self.value, self.onset, self.full) * self.weight

    def term(self) -> Column:
        r = ramp(self.value, self.onset, self.full)
        return F.struct(
            F.lit(self.name).alias("name"),
            self.value.cast("double").alias("value"),
            F.lit(float(self.onset)).alias("onset"),
            F.lit(float(self.full)).alias("full"),
            F.lit(float(self.weight)).alias("weight"),
            r.alias("ramp"),
            (r * self.weight).alias("penalty"),
            F.lit(self.note).alias("note"),
        )


@dataclass(frozen=True)
class Limits:
    """Fixed cut-offs of the vetoes and the flat penalties."""

    min_length: float = 5.0
    min_radius: float = 1.0
    radius_slack: float = 0.3
    cap_ratio: float = 0.4
    cap_angle: float = 25.0
    cap_face: float = 0.5
    case_leak: float = 0.15
    shared_vessel: float = 0.05
    threshold: float = 0.65

    def scaled(self, name: str, factor: float) -> "Limits":
        return replace(self, **{name: getattr(self, name) * factor})


def feature(name: str, default: float = 0.0) -> Column:
    return num(F.col(name), default)


def default_ramps() -> list[Ramp]:
    """The eight ramps; fixed values of onset, full and weight."""
    nearby = feature("nearby_aortic_radius_mm")
    ratio = F.when(nearby > 0, feature("radius_at_seed_mm") / nearby).otherwise(F.lit(0.0))
    return [
        Ramp("parallel_to_aorta", feature("angle_to_centerline_deg", 90.0), 45.0, 15.0, 0.30),
        Ramp("flattened_cross_section", feature("cross_section_flatness", 1.0), 1.6, 3.0, 0.20),
        Ramp("hu_below_lumen", -feature("mean_hu_relative_to_lumen"), 60.0, 200.0, 0.20),
        Ramp("ostium_disagreement", feature("ostium_max_disagreement_mm"), 2.0, 6.0, 0.15),
        Ramp("radius_vs_aorta", ratio, 0.35, 0.70, 0.20),
        Ramp("thin_ostium", feature("ostium_flare_ratio"), 1.0, 0.6, 0.15),
        Ramp("radius_inconsistent", feature("radius_consistency_cv"), 0.35, 0.90, 0.10),
        Ramp("leak_margin", feature("leak_margin"), 0.5, 0.0, 0.15),
    ]


def first_reason(rules: Sequence[tuple[Column, str]]) -> Column:
    """Reason of the first rule that holds, in order; NULL when none does."""
    out = None
    for condition, reason in rules:
        out = F.when(condition, F.lit(reason)) if out is None else out.when(condition, F.lit(reason))
    return out


def veto_reason(lim: Limits, has_origin_radius: bool = True) -> Column:
    seed = feature("radius_at_seed_mm")
    if has_origin_radius:
        at_origin = feature("origin_radius_mm") + feature("origin_radius_uncertainty_mm") + 1e-6
        radius = [(at_origin < lim.min_radius, "origin_radius"), (seed <= 0, "seed_radius")]
    else:
        radius = [(seed < lim.min_radius - lim.radius_slack, "seed_radius")]
    touches = feature("touches_cap") > 0.5
    return first_reason([
        (feature("traced_length_mm") < lim.min_length, "too_short"),
        (feature("reached_seed_distance", 1.0) < 0.5, "seed_not_reached"),
        *radius,
        (touches & (feature("cap_radius_ratio") > lim.cap_ratio), "cap_radius"),
        (touches & (feature("angle_to_centerline_deg", 90.0) <= lim.cap_angle), "cap_angle"),
    ])


def explain(df: DataFrame, lim: Limits = Limits(), ramps: Sequence[Ramp] | None = None,
            has_origin_radius: bool = True, with_terms: bool = True) -> DataFrame:
    """Add ``veto, terms, total_penalty, confidence`` to a feature relation.

    The penalties are reported for vetoed rows too; a veto only sets the confidence to 0.
    """
    ramps = list(ramps or default_ramps())
    flat = (F.when(feature("case_flood_leaking") > 0.5, F.lit(lim.case_leak)).otherwise(F.lit(0.0))
            + F.when(feature("shares_vessel_with_count") > 0, F.lit(lim.shared_vessel))
            .otherwise(F.lit(0.0)))
    total = flat
    for r in ramps:
        total = total + r.penalty()
    out = df.withColumn("veto", veto_reason(lim, has_origin_radius)).withColumn("total_penalty", total)
    if with_terms:
        out = out.withColumn("terms", F.array(*[r.term() for r in ramps]))
    return out.withColumn(
        "confidence",
        F.when(F.col("veto").isNotNull(), F.lit(0.0))
        .otherwise(clip(F.lit(1.0) - F.col("total_penalty"), 0.0, 1.0)))


def rejection_reason(lim: Limits = Limits()) -> Column:
    """Ordered rejection of a component before it is split and traced."""
    touches = F.col("touches_cap")
    continues = ((F.col("radius_ratio") > lim.cap_ratio)
                 | (F.col("angle_to_centerline_deg") <= lim.cap_angle))
    return first_reason([
        (F.col("n_patch_voxels") == 0, "no_contact_patch"),
        (touches & (F.col("cap_face_fraction") >= lim.cap_face), "end_cap"),
        (touches & F.coalesce(continues, F.lit(False)), "aortic_continuation"),
        (F.col("max_distance_mm") < lim.min_length, "too_short"),
    ])
