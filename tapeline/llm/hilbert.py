"""Sharding along a Hilbert curve over quantised metadata columns, with DataFrame functions only.

Rows are range-partitioned and sorted by (curve index, id); a row's rank is its place in its partition plus
the sizes of the partitions before it, so no task sees more than its range and equal curve cells of any size
are split by id. Runs of ranks become shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Store, let

def ordinal(df: DataFrame, name: str) -> Column:
    """The column with a total order: strings (null lowest, as no string), or doubles (null and NaN lowest)."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    number = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(-1.7976931348623157e308))


def string_cuts(df: DataFrame, name: str, bits: int, store: Store) -> list[str]:
    """The strings at the quantiles k / 2^bits of the column's non-null values, by exact counts.

    Distinct strings are counted and range-partitioned; running counts are taken within partitions, so no task sees
    more than its range. At most 2^bits - 1 strings come to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("x")).agg(F.count("*").alias("n"))
    lined = store.save(counts.repartitionByRange(parts, "x").sortWithinPartitions("x").withColumn("p", F.spark_partition_id()))
    sums = lined.groupBy("p").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("p")) - F.col("m"))
    total = sums.agg(F.sum("m")).first()[0] or 0
    up_to = F.col("before") + F.sum("n").over(Window.partitionBy("p").orderBy("x"))
    ranked = lined.join(F.broadcast(sums.drop("m")), "p").withColumn("c", up_to)  # a row a partition
    step = lambda c: F.floor(c * 2**bits / F.lit(max(total, 1)))
    reached = ranked.withColumn("k", step(F.col("c"))).where((F.col("k") > step(F.col("c") - F.col("n"))) & (F.col("k") < 2**bits))
    got = sorted(r.x for r in reached.select("x").collect())
    store.drop(lined)
    return got


def quantised(df: DataFrame, dims: list[str], bits: int, store: Store) -> list[Column]:
    """A cell from 0 to 2^bits - 1 for each dimension, cut at quantiles over all rows.

    The cuts (2^bits - 1 values a dimension) are the only values that come to the driver.
    """
    at = [k / 2**bits for k in range(1, 2**bits)]
    texts = {d for d in dims if isinstance(df.schema[d].dataType, T.StringType)}
    numbers = [d for d in dims if d not in texts]
    found = df.agg(*[F.percentile_approx(ordinal(df, d), at, 10_000).alias(f"q{i}") for i, d in enumerate(numbers)]).first() if numbers else []
    cuts = {d: [float(x) for x in found[i] or []] for i, d in enumerate(numbers)}
    out = []
    for d in dims:
        if d in texts:
            edges = F.array(*map(F.lit, string_cuts(df, d, bits, store))).cast("array<string>")
            out.append(F.when(F.col(d).isNull(), 0).otherwise(let(F.col(d), _below(edges))))
        else:
            out.append(let(ordinal(df, d), _below(F.array(*map(F.lit, sorted(set(cuts[d])))).cast("array<double>"))))
    return out


def _below(edges: Column):
    return lambda x: F.size(F.filter(edges, lambda c: c < x))


def hilbert_index(cells: Column, dims: int, bits: int) -> Column:
    """Index of a cell (array of ints below 2^bits) along the Hilbert curve (Skilling 2004)."""

    def undo(x: Column, step: Column) -> Column:
        q = F.call_function("shiftleft", F.lit(1), F.lit(bits - 1) - F.floor(step / dims).cast("int"))
        i, p = F.pmod(step, F.lit(dims)).cast("int"), q - 1
        first, own = F.get(x, F.lit(0)), F.get(x, i)
        swap = first.bitwiseXOR(own).bitwiseAND(p)
        flip = own.bitwiseAND(q) != 0
        return F.transform(
            x,
            lambda v, k: F.when(flip, F.when(k == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(
                F.when((i != 0) & ((k == 0) | (k == i)), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    zero = F.lit(0).cast("int")
    fold = lambda xs, f: F.aggregate(xs, zero, f)
    steps = F.sequence(F.lit(0), F.lit(dims * (bits - 1) - 1)) if bits > 1 else F.array().cast("array<int>")
    turned = F.aggregate(steps, cells, undo)

    def gray(x: Column) -> Column:
        return F.transform(x, lambda _, k: fold(F.slice(x, F.lit(1), k + 1), lambda a, v: a.bitwiseXOR(v)))

    def finish(x: Column) -> Column:
        tail = fold(
            F.sequence(F.lit(1), F.lit(bits - 1)) if bits > 1 else F.array().cast("array<int>"),
            lambda a, j: F.when(
                F.get(x, F.lit(dims - 1)).bitwiseAND(F.call_function("shiftleft", F.lit(1), j)) != 0,
                a.bitwiseXOR(F.call_function("shiftleft", F.lit(1), j) - 1),
            ).otherwise(a),
        )
        return let(tail, lambda t: F.transform(x, lambda v: v.bitwiseXOR(t)))

    def weave(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.lit(dims * bits - 1))
        return F.aggregate(
            places,
            F.lit(0).cast("long"),
            lambda a, s: F.call_function("shiftleft", a, F.lit(1)).bitwiseOR(
                F.call_function(
                    "shiftright", F.get(x, F.pmod(s, F.lit(dims)).cast("int")), F.lit(bits - 1) - F.floor(s / dims).cast("int")
                ).bitwiseAND(F.lit(1)).cast("long")
            ),
        )

    return let(turned, lambda x: let(gray(x), lambda g: let(finish(g), weave)))


def hilbert_shards(
    df: DataFrame,
    dims: list[str],
    *,
    n_shards: int = 16,
    bits: int = 4,
    id_col: str = "doc_id",
    partitions: int | None = None,
) -> DataFrame:
    """The rows of df with hilbert long, shard int (0 to n_shards - 1) and slot long (gapless from 0 in each shard).

    Shards are runs of the order (hilbert, id); their row counts differ by one at most, so fewer rows than
    shards leave shards empty. Nulls in a dimension or in the id sort first; NaN counts as null. Repeated rows
    and equal ids each get a slot, in any order among themselves. Columns of df with these three names are
    replaced. No rows in: no rows out. df is read once and stored, so hand over the columns that shards need.
    """
    spark = df.sparkSession
    store = Store(spark)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = store.save(df)
    cells = F.array(*quantised(df, dims, bits, store))
    rows = df.withColumn("hilbert", hilbert_index(cells, len(dims), bits))
    keep = [c for c in rows.columns if c not in ("shard", "slot")]
    place = F.monotonically_increasing_id()
    ranked = rows.select(keep).repartitionByRange(parts, "hilbert", id_col).sortWithinPartitions("hilbert", id_col)
    ranked = store.save(ranked.withColumn("_at", place))
    part, local = F.expr("shiftrightunsigned(_at, 33)"), F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    total = ranked.count()
    # a row for each partition: the one window over all of them stays as small as their number
    sizes = ranked.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))
    offsets = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    out = ranked.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn("_rank", F.col("_before") + local)
    shard = F.expr(f"int((_rank * {n_shards}L) div {max(total, 1)}L)")
    slot = F.expr(f"_rank - ((shard * {total}L + {n_shards - 1}L) div {n_shards}L)")
    return out.withColumn("shard", shard).withColumn("slot", slot).select(*keep, "shard", "slot")


def write_shards(sharded: DataFrame, path: str, dims: list[str]) -> None:
    """One folder a shard, rows in curve order, so that min/max of every dimension prune files."""
    n = sharded.agg(F.max("shard")).first()[0]
    ordered = sharded.repartitionByRange(1 + (n or 0), "shard").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
