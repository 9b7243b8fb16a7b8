"""What the operators of this subpackage share: scratch tables, batch sizes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with over one part in so many of the rows of a join are dealt out.
HOT_KEYS = 10_000
#: Rows per Arrow batch: long texts (100 kB and more) then stay within a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers, for the session: plans read the setting when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tapeline-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


#: The stores of this process, oldest first; see clear_since.
STORES: list[Store] = []


def clear_since(n: int, but: Store | None = None) -> None:
    """Delete the tables of all stores after the first n, once no later plan reads them."""
    for s in STORES[n:]:
        if s is not but:
            s.delete(s.root)
    STORES[n:] = [s for s in STORES[n:] if s is but]


class Store:
    """Parquet tables in the shared folder, which cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{scratch_root(spark)}/tapeline-{uuid.uuid4().hex}"
        self.n = 0
        STORES.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        self.delete(df.scratch_path)

    def delete(self, where: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: the optimizer does not copy it into inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dealt(rows: DataFrame, small: DataFrame, key: list[str], count: str, *spread: str | Column) -> tuple[DataFrame, DataFrame, list[str]]:
    """rows and small ready for an equi-join on the key and a salt, so that no key is one task's.

    small has a row a key and how many rows of rows have it. Keys with over a ten-thousandth of these rows (so at
    most 10,000 keys, which are broadcast) are dealt into parts of that size by a hash of ``spread``.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    limit = max(total // HOT_KEYS, 1000)
    parts = F.ceil(F.col(count) / limit).cast("int")
    hot = small.where(F.col(count) > limit).select(*key, parts.alias("_parts"))
    rows = rows.join(F.broadcast(hot), key, "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return rows, small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col(count) > limit, parts - 1).otherwise(0)))), [*key, "salt"]


def by_group(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by keys, one at a time."""
    rest: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        k = pdf[keys]
        cuts = [0, *((k.iloc[1:].to_numpy() != k.iloc[:-1].to_numpy()).any(axis=1).nonzero()[0] + 1), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k.iloc[a])
            if rest and key != last:
                yield pd.concat(rest) if len(rest) > 1 else rest[0]
                rest = []
            rest.append(pdf.iloc[a:b])
            last = key
    if rest:
        yield pd.concat(rest) if len(rest) > 1 else rest[0]


def connected_components(edges: DataFrame, store: Store) -> DataFrame:
    """(node, component) for every node of the long edges (a, b); component is the smallest node reached.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): O(log n) rounds, each a map-side
    combined minimum and a join whose large side Spark may split; nothing is collected but a count and a
    checksum. Nulls and loops are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a") != F.col("b")).alias("ok"))
    e = store.save(e.where("ok").select("u", "v").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.min("u"), F.max("v")).first())

    seen = mark(e)
    while seen[0]:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = store.save(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(new)
        store.drop(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
