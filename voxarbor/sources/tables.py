"""Parquet table access and the relations the queries are built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor.session import bounded

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name}")
    return bounded(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Lattice extent of the voxel relation derived from lineitem: quantity in steps of 5,
# discount and tax in steps of two percent.
NZ, NY, NX = 10, 6, 5
CELLS = NZ * NY * NX
TRUNK_Z = 2  # z <= TRUNK_Z is the trunk mask


def cents(name: str):
    return F.round(F.col(name) * 100).cast("bigint")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One lattice per supplier: ``case_id, z, y, x, vid, gid, hu, n, in_mask``.

    ``hu`` is the whole-number mean price in cents, so thresholds compare integers. ``vid`` is the
    flat cell number in its case and ``gid`` the same across cases.
    """
    cell = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("case_id"),
            F.floor((F.col("l_quantity") - 1) / 5).cast("int").alias("z"),
            F.expr("cast(cast(round(l_discount * 100) as int) div 2 as int)").alias("y"),
            F.expr("cast(cast(round(l_tax * 100) as int) div 2 as int)").alias("x"),
            cents("l_extendedprice").alias("cents"),
        )
        .groupBy("case_id", "z", "y", "x")
        .agg(F.sum("cents").alias("s"), F.count(F.lit(1)).alias("n"))
    )
    vid = (F.col("z") * NY + F.col("y")) * NX + F.col("x")
    return cell.select(
        "case_id", "z", "y", "x",
        vid.cast("bigint").alias("vid"),
        (F.col("case_id") * CELLS + vid).cast("bigint").alias("gid"),
        F.expr("s div n").alias("hu"),
        "n",
        (F.col("z") <= TRUNK_Z).alias("in_mask"),
    )


VOXELS_SQL = f"""vox AS (
  SELECT case_id, z, y, x,
         CAST((z * {NY} + y) * {NX} + x AS BIGINT) AS vid,
         CAST(case_id * {CELLS} + (z * {NY} + y) * {NX} + x AS BIGINT) AS gid,
         CAST(s // n AS BIGINT) AS hu, n, z <= {TRUNK_Z} AS in_mask
  FROM (
    SELECT l_suppkey AS case_id,
           CAST(floor((l_quantity - 1) / 5) AS INT) AS z,
           CAST(round(l_discount * 100) AS INT) // 2 AS y,
           CAST(round(l_tax * 100) AS INT) // 2 AS x,
           CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS s,
           count(*) AS n
    FROM lineitem GROUP BY ALL
  )
)"""
