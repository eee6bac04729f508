"""Shape of the published records and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAUGHTER = ("struct<instance_id: string, parent_instance_id: string, ostium_xyz_mm: array<double>, "
            "seed_xyz_mm: array<double>, radius_mm: double, direction_xyz: array<double>>")
PREDICTION = f"case_id string, parent struct<instance_id: string>, daughters array<{DAUGHTER}>"
# drafts: a null radius is allowed and each record may carry a review status
DRAFT = (f"case_id string, coordinate_system string, parent struct<instance_id: string>, daughters array<"
         f"{DAUGHTER[:-1]}, review_status: string>>")

_VECTORS = ("ostium_xyz_mm", "seed_xyz_mm", "direction_xyz")
_TOLERANCE = 1e-6


def _finite(v: str) -> str:
    return f"({v} IS NOT NULL AND NOT isnan({v}) AND abs({v}) < double('infinity'))"


def problem(position: str = "position", parent: str = "aorta") -> str:
    """SQL for the first rule a daughter breaks, NULL when it is valid. ``position`` counts from 1."""
    good = {v: f"(coalesce(size({v}), 0) = 3 AND forall({v}, c -> {_finite('c')}))" for v in _VECTORS}
    norm = "sqrt(aggregate(direction_xyz, 0D, (s, c) -> s + c * c))"
    offset = "zip_with(seed_xyz_mm, ostium_xyz_mm, (s, o) -> s - o)"
    outward = f"aggregate(zip_with(direction_xyz, {offset}, (d, s) -> d * s), 0D, (s, c) -> s + c)"
    return f"""CASE
        WHEN NOT (instance_id <=> format_string('branch_%03d', {position})) THEN 'instance_id'
        WHEN NOT (parent_instance_id <=> '{parent}') THEN 'parent_instance_id'
        WHEN NOT {good['ostium_xyz_mm']} THEN 'ostium_xyz_mm'
        WHEN NOT {good['seed_xyz_mm']} THEN 'seed_xyz_mm'
        WHEN NOT {_finite('radius_mm')} OR NOT (radius_mm > 0) THEN 'radius_mm'
        WHEN NOT {good['direction_xyz']} THEN 'direction_xyz'
        WHEN abs({norm} - 1) > {_TOLERANCE}D THEN 'direction_norm'
        WHEN NOT exists({offset}, c -> c <> 0) THEN 'seed_equals_ostium'
        WHEN {outward} < -{_TOLERANCE}D THEN 'direction_inward'
    END"""


def explode_daughters(predictions: DataFrame) -> DataFrame:
    """``case_id, position`` and the daughter fields, one row each."""
    return predictions.selectExpr("case_id", "posexplode(daughters) AS (at, d)").selectExpr(
        "case_id", "at + 1 AS position", "d.*")


def validate(predictions: DataFrame) -> DataFrame:
    """Add ``problem`` per prediction: the first broken rule of its first invalid daughter, or NULL."""
    checked = "transform(daughters, (d, i) -> " + _inline(problem("i + 1")) + ")"
    first = f"get(filter({checked}, p -> p IS NOT NULL), 0)"
    return predictions.withColumn("problem", F.expr(
        f"CASE WHEN case_id IS NULL OR case_id = '' THEN 'case_id' WHEN daughters IS NULL THEN 'daughters' ELSE {first} END"))


def _inline(rule: str) -> str:
    """Point the field names of a rule at the lambda variable ``d``."""
    import re

    names = "instance_id|parent_instance_id|ostium_xyz_mm|seed_xyz_mm|radius_mm|direction_xyz"
    return re.sub(rf"(?<!')\b({names})\b(?!')", r"d.\1", rule)


def public_fields(predictions: DataFrame) -> DataFrame:
    """Valid predictions with exactly the published fields; an invalid one stops the job."""
    six = ", ".join(f"'{n}', d.{n}" for n in ("instance_id", "parent_instance_id", "ostium_xyz_mm", "seed_xyz_mm",
                                              "radius_mm", "direction_xyz"))
    return validate(predictions).selectExpr(
        "CASE WHEN problem IS NULL THEN case_id ELSE raise_error(concat('invalid prediction ', case_id, ': ', problem)) END AS case_id",
        "named_struct('instance_id', 'aorta') AS parent",
        f"transform(daughters, d -> named_struct({six})) AS daughters")


def assemble(rows: DataFrame, cases: DataFrame, limit: int = 40) -> DataFrame:
    """One nested prediction per case, daughters in ``position`` order; a case without any keeps an empty list.

    ``rows`` holds ``case_id, position`` and the daughter columns, at most ``limit`` per case upstream.
    """
    fields = ["instance_id", "parent_instance_id", *_VECTORS[:2], "radius_mm", _VECTORS[2]]
    listed = rows.groupBy("case_id").agg(F.expr(
        f"transform(array_sort(collect_list(struct(position, {', '.join(fields)}))), "
        f"r -> named_struct({', '.join(repr(f) + ', r.' + f for f in fields)})) AS daughters"))
    return cases.select("case_id").join(listed, "case_id", "left").selectExpr(
        "cast(case_id AS string) AS case_id", "named_struct('instance_id', 'aorta') AS parent",
        f"coalesce(daughters, cast(array() AS array<{DAUGHTER}>)) AS daughters")
