"""Continuous arrival: harvest lines split into clean rows and rejects, and references counted by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litweave.operators.rejects import load_clean, reject_reasons


def load_lines(lines: DataFrame, clean: str, rejects: str, checkpoint: str, key: str = "line_id", line: str = "line", **trigger) -> StreamingQuery:
    """Each micro-batch of a stream of lines goes to Parquet folders, rejects with their reason.

    The folders of a batch are named by its number and overwritten, so a batch that is retried is not written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            load_clean(batch, key, line).write.mode("overwrite").parquet(f"{clean}/batch={number}")
            batch.join(reject_reasons(batch, key, line), key).write.mode("overwrite").parquet(f"{rejects}/batch={number}")
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def arrivals_by_period(rows: DataFrame, key: str, at: str = "loaded_at", late: str = "40 days", period: str = "30 days") -> DataFrame:
    """(window, key, n) of a stream of mapping rows; rows later than ``late`` behind the newest are left to the batch job."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, period), F.col(key)).agg(F.count("*").alias("n"))
