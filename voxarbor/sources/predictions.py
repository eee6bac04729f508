"""Prediction, reference and draft documents; report sinks; file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor import schema
from voxarbor.functions.scalar import case_id_from_path


def read_predictions(spark: SparkSession, path: str, draft: bool = False) -> DataFrame:
    """Nested documents, one per file: an object with ``daughters`` or a bare list of them.

    A missing case id comes from the path. ``draft`` also reads the review status and the coordinate system.
    """
    shape = schema.DRAFT if draft else schema.PREDICTION
    one = shape[shape.index("array<") + 6:-1]  # the daughter struct
    text = spark.read.option("wholetext", True).text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("path"))
    bare = text.where("value RLIKE '^\\\\s*\\\\['").select(
        "path", F.expr(f"from_json(value, 'array<{one}>')").alias("daughters"))
    whole = text.where("NOT value RLIKE '^\\\\s*\\\\['").select("path", F.from_json("value", shape).alias("p"))
    extra = ["p.coordinate_system AS coordinate_system"] if draft else []
    rows = whole.selectExpr("path", "p.case_id AS case_id", *extra, "p.parent AS parent",
                            "coalesce(p.daughters, array()) AS daughters")
    rows = rows.unionByName(bare, allowMissingColumns=True)
    return rows.withColumn("case_id", F.coalesce(F.col("case_id"), case_id_from_path(F.col("path"))))


def write_predictions(predictions: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Validate, keep the six published fields and write one JSON document per case.

    An invalid record fails the job before anything is committed.
    """
    schema.public_fields(predictions).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report(rows: DataFrame, path: str, by_case: bool = False, mode: str = "overwrite", form: str = "json") -> None:
    out = rows.write.mode(mode).format(form)
    (out.partitionBy("case_id") if by_case else out).save(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file below a path pattern."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def status_text(lines: DataFrame) -> DataFrame:
    """One text line per finding from ``case_id, id, confidence, status, note``."""
    return lines.selectExpr("case_id", "concat_ws(' ', format_string('%s #%d %.3f', cast(case_id AS string), id, confidence), "
                            "status, note) AS value")
