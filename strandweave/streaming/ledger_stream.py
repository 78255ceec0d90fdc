"""The ledger over a folder that rows are appended to, as a stream.

An extension: each batch goes through the same functions as a file would, against the log as it stands, so
an appended row is never appended twice whatever batch brings it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import vocab
from ..operators import ledger


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(vocab.LOG).parquet(folder)


def append_stream(incoming: DataFrame, log_folder: str, checkpoint: str, role: str = "analyst", once: bool = True) -> StreamingQuery:
    """Append every batch's new rows to a Parquet log."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        try:
            log = spark.read.schema(vocab.LOG).parquet(log_folder)
        except Exception as error:  # the first batch finds no log
            if "PATH_NOT_FOUND" not in str(error):
                raise
            log = spark.createDataFrame([], vocab.LOG)
        order = batch.select(*ledger.IDENTITY, "log_seq").groupBy(*ledger.IDENTITY).agg(F.min("log_seq").alias("log_seq"))
        rows = ledger.append(batch.dropDuplicates(ledger.IDENTITY), log, role).join(order, ledger.IDENTITY)
        rows.select(*vocab.LOG.fieldNames()).write.mode("append").parquet(log_folder)

    writer = incoming.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def decisions_by_window(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by justification in event-time windows, for dashboards over a running log."""
    timed = log.withWatermark("mapping_date", late)
    return timed.groupBy(F.window("mapping_date", window), "mapping_justification").agg(F.count("*").alias("n"))
