"""Session settings and durable materialisation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "voxarbor", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# A written table counts as its file size when the planner looks for a side to broadcast, and ids and flags take many
# times that on the driver.
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"
MOST_BROADCAST = 256 << 10
# What a task reads of a shuffle is packed rows; exploded to neighbours and hashed they take some twenty times that.
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
MOST_ADVISED = 8 << 20


def size_setting(value: str) -> int:
    """Bytes of a size as the session states it, ``10m`` or ``10485760b``."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)b?\s*", value.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def lower(spark: SparkSession, key: str, most: int) -> None:
    """Lowers a size of the session to ``most`` bytes; a smaller one stays, and so does one that is switched off."""
    if size_setting(spark.conf.get(key)) > most:
        spark.conf.set(key, str(most))


def bounded(spark: SparkSession) -> SparkSession:
    """The session with bounds on what the driver builds for a join and on what merged shuffle partitions give one task."""
    lower(spark, BROADCAST, MOST_BROADCAST)
    lower(spark, ADVISED, MOST_ADVISED)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for durable intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only a local-mode
    session without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    local = tempfile.mkdtemp(prefix="voxarbor-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


class Rounds:
    """Writes the state of an iterative job once per round and reads it back.

    A written table cuts the lineage and survives the loss of any executor.
    ``save`` runs one job: the table is written and the requested metrics are
    observed on the same pass. A table that a later round replaces is dropped
    with ``retire``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = bounded(spark)
        self.root = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")
        self.step = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, **metrics: Column) -> tuple[DataFrame, dict]:
        path = os.path.join(self.root, f"round-{self.step:04d}")
        self.step += 1
        watch = Observation() if metrics else None
        out = df.observe(watch, *[c.alias(k) for k, c in metrics.items()]) if watch else df
        out.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = path
        back._round_path = path
        return back, (dict(watch.get) if watch else {})

    def retire(self, df: DataFrame | None) -> None:
        path = getattr(df, "_round_path", None)
        if path is None:
            return
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


class Stages:
    """Named tables of one run, which a restart under the same folder finds again.

    The tables of a stage are written together; when the writes of all of them are committed they are read back and
    ``build`` is not called. Tables of a stage that was cut off are written anew. A run's folder must belong to one
    input and one set of parameters: name it by them.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def fresh(cls, spark: SparkSession, name: str) -> Stages:
        return cls(spark, os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}"))

    def finished(self, name: str) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.join(self.root, name, "_SUCCESS"))
        return mark.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)

    def save(self, names: Sequence[str], build: Callable[[], Sequence[DataFrame]]) -> list[DataFrame]:
        if not all(self.finished(n) for n in names):
            for name, df in zip(names, build(), strict=True):
                df.write.mode("overwrite").parquet(os.path.join(self.root, name))
        return [self.spark.read.parquet(os.path.join(self.root, n)) for n in names]

    def one(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.save([name], lambda: [build()])[0]
