"""Detection over a stream of files. An extension: the operators are the batch ones, without state of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bytelode.operators.catalog import detect


def detect_stream(arriving: DataFrame, probes: DataFrame, hints: DataFrame, sink: str, checkpoint: str):
    """Append the detection of each micro-batch of ``(carrier_kind, carrier_id, content, ext)`` to Parquet; a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        detect(batch, probes, hints).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
