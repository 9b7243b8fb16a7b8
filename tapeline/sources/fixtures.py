"""Adapters from the driver's tables to ticks, bars, panels and vector libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators.bars import resample

HOUR = 3_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, us (epoch microseconds), id, price, qv."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.col("value").alias("qv")
    )


def bars(spark: SparkSession, sf_dir: str, hours: int = 1) -> DataFrame:
    return resample(ticks(spark, sf_dir), hours * HOUR)


def panel(spark: SparkSession, sf_dir: str, days: int = 1) -> DataFrame:
    """sym (nation), day (a period of ``days``), dvol, close: one row for each nation and period with orders."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    day = F.expr(f"unix_micros(cast(o_orderdate as timestamp)) div {days * 86400000000}L")
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_nationkey").alias("sym"), day.alias("day"), "o_totalprice", "o_orderdate", "o_orderkey")
    last = F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey"))
    return rows.groupBy("sym", "day").agg(F.sum("o_totalprice").alias("dvol"), last.alias("close"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, symbol, v: the embeddings as a library of precomputed vectors."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("symbol"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
