"""Closed bars from a stream of ticks: a bar is emitted once the watermark has passed its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def closed_bars(ticks: DataFrame, step: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Streaming ticks (symbol, ts, id, price, qv) to bars; later ticks of an emitted bar are dropped."""
    at = F.struct("ts", "id")
    w = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", step).alias("w"))
    bars = w.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("qv").alias("qv"), F.count("*").alias("n")
    )
    return bars.select("symbol", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "qv", "n")


def run_available(spark: SparkSession, stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there, exactly once, into Parquet under path, and reads it back."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def upsert_batches(path: str, merge):
    """A foreachBatch function that merges each batch of bars into the table at path/table; a repeated batch changes
    nothing.

    Only the partitions of the batch's symbols are read and written. What they become is stored first, so that a batch
    that was stopped on the way can simply be done again.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        table, stage = f"{path}/table", f"{path}/stage/{number}"
        symbols = batch.select("symbol").distinct()
        try:
            old = spark.read.schema(batch.schema).parquet(table).join(F.broadcast(symbols), "symbol", "left_semi")  # a batch's symbols
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = batch.limit(0)
        merge(old.select(batch.columns), batch).write.mode("overwrite").parquet(stage)
        ready = spark.read.schema(batch.schema).parquet(stage)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol").parquet(table)
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stage)
        done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)

    return apply
