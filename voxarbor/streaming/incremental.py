"""Incremental validation of prediction documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from voxarbor import schema


def watch_predictions(spark: SparkSession, source: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Validate every new document below ``source`` once: valid ones to ``sink/valid``, the rest to ``sink/rejected``.

    A document per file, one micro-batch per set of new files; the checkpoint remembers what was done, so a
    restarted job goes on after the last finished batch. Batches write under their own number, which makes a
    repeated batch overwrite itself.
    """
    docs = spark.readStream.schema(schema.PREDICTION).option("multiLine", "true").json(source)

    def keep(batch: DataFrame, number: int) -> None:
        checked = schema.validate(batch).persist()
        good = schema.public_fields(checked.where("problem IS NULL").drop("problem"))
        good.write.mode("overwrite").json(f"{sink}/valid/batch={number}")
        checked.where("problem IS NOT NULL").write.mode("overwrite").json(f"{sink}/rejected/batch={number}")
        checked.unpersist()

    return (docs.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
