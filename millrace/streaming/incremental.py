"""Structured Streaming over growing tables of cells and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.kv import SCHEMA, latest


def cell_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, key, n in tumbling or sliding windows; rows later than ``late`` are dropped. Works on batches and streams."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    return source.groupBy(F.window(time, width, slide), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def keep_latest(cells: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's cells as a new generation merged with the last one, so that ``target`` always holds one row for each cell.

    Generations are folders named by batch, so a batch run twice after a failure writes the same folder again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch
        if number:
            new = new.unionByName(spark.read.schema(SCHEMA).parquet(f"{target}/generation={number - 1}"))
        latest(new).select("row_key", "col", "value", "version").write.mode("overwrite").parquet(f"{target}/generation={number}")

    return cells.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
