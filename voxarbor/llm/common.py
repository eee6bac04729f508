"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxarbor.session import Rounds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the package is only needed by the queries, not by the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """Remainder of the CRC-32 of the key's decimal text."""
    return F.crc32(F.col(key).cast("string")) % folds


def settled(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a cut lineage that outlives any executor."""
    return Rounds(spark, name).save(df)[0]


def bounded_sample(df: DataFrame, key: str, group: str, rows: int) -> DataFrame:
    """About ``rows`` rows of each group, chosen by a hash of the key; at most twice as many.

    The groups are counted with map-side combining, so no group meets in one
    task; a group of fewer rows is taken whole. Null groups are left out.
    """
    df = df.where(F.col(group).isNotNull())
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(1.25 * rows) / F.col("_n"))
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(F.broadcast(sizes), group).where(place < share).drop("_n")


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets at most ``rows`` rows of the session travel to Python at a time: they are whole texts here, and the
    batch of either side counts in an executor's memory."""
    if not 0 < int(spark.conf.get(ROWS)) <= rows:
        spark.conf.set(ROWS, str(rows))


def keyed_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` (long) and ``text`` alone, on their way to Python."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))


def slices(batch: pa.RecordBatch, rows: int):
    """Pieces of a batch, so that a task holds the Python objects of few rows at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
