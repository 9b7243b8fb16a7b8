"""As-of, range, band and benchmark joins without cross products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Milliseconds of the bucket of time that one task of an as-of join scans.
DAY = 86_400_000


def asof(left: DataFrame, right: DataFrame, value: str, direction: str = "backward", strict: bool = False, width: int = DAY) -> DataFrame:
    """left (symbol, t) with the t and value of the last right row at or before it (first at or after it: 'forward').

    Both sides are cut into buckets of ``width`` of t, so a symbol with most of the rows is many tasks: the union
    is scanned in order within a bucket, which starts from what the symbol's buckets before it end with (one row
    a bucket). Of right rows at equal t the greatest value counts, the least one going forward.
    """
    cols, back = left.columns, direction == "backward"
    side = 1 if strict != back else 0  # where left stands among rows of equal t
    mark = F.struct(F.col("t").alias("at"), F.col(value).alias("v"))
    r = right.select("symbol", "t", mark.alias("_r"), F.lit(1 - side).alias("_o"), F.lit(False).alias("_l"))
    both = left.withColumns({"_o": F.lit(side), "_l": F.lit(True)}).unionByName(r, allowMissingColumns=True)
    both = both.withColumn("_b", F.expr(f"t div {width}L"))
    way = F.asc if back else F.desc
    ends = both.groupBy("symbol", "_b").agg((F.max if back else F.min)("_r").alias("_r"))
    before = Window.partitionBy("symbol").orderBy(way("_b")).rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select("symbol", "_b", F.last("_r", ignorenulls=True).over(before).alias("_r"), F.lit(False).alias("_l"), F.lit(0).alias("_s"))
    rows = both.withColumn("_s", F.lit(1)).unionByName(start, allowMissingColumns=True)
    # a running value either way: a frame that begins at each row would scan what follows it again and again
    w = Window.partitionBy("symbol", "_b").orderBy("_s", *map(way, ("t", "_o", "_r.v"))).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_f", F.last("_r", ignorenulls=True).over(w)).where("_l").select(*cols, F.col("_f.at").alias("match_t"), F.col("_f.v").alias(value))


def covering(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """points (symbol, t, ...) joined to ranges (symbol, t0, t1, ...) with t0 <= t <= t1.

    Ranges are cut into buckets of ``width``, so the join is an equi-join; a range meets a point in one bucket.
    """
    r = ranges.withColumn("_b", F.explode(F.sequence(F.expr(f"t0 div {width}L"), F.expr(f"t1 div {width}L"))))
    return points.withColumn("_b", F.expr(f"t div {width}L")).join(r, ["symbol", "_b"]).where("t between t0 and t1").drop("_b")


def nearest(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (symbol, t) with the t0 nearest to t (the earlier of equals), by two as-of joins."""
    starts = ranges.select("symbol", F.col("t0").alias("t"), F.col("t0"))
    a = asof(points, starts, "t0").withColumnRenamed("t0", "below").drop("match_t")
    b = asof(a, starts, "t0", "forward").withColumnRenamed("t0", "above").drop("match_t")
    pick = F.when(F.col("below").isNull(), F.col("above")).when(F.col("above").isNull(), F.col("below"))
    pick = pick.otherwise(F.when(F.col("t") - F.col("below") <= F.col("above") - F.col("t"), F.col("below")).otherwise(F.col("above")))
    return b.withColumn("nearest_t0", pick).drop("below", "above")


def locate(points: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """points (symbol, t) with one range each: of those that cover t the first to begin (exact true), else the one that
    begins nearest. Symbols without ranges are left out."""
    inside = covering(points.select("symbol", "t").distinct(), ranges.select("symbol", "t0", "t1"), width).groupBy("symbol", "t").agg(F.min("t0").alias("_in"))
    x = nearest(points, ranges).join(inside, ["symbol", "t"], "left")
    return x.withColumn("exact", F.col("_in").isNotNull()).withColumn("t0", F.coalesce("_in", "nearest_t0")).drop("_in", "nearest_t0").where("t0 is not null")


def band(rows: DataFrame, width: int, id_col: str) -> DataFrame:
    """Pairs of rows of a symbol at most ``width`` of t apart, each once, by buckets of that width."""
    a = rows.select("symbol", F.col("t").alias("t_a"), F.col(id_col).alias("a"), F.expr(f"t div {width}L").alias("_b"))
    b = rows.select("symbol", F.col("t").alias("t_b"), F.col(id_col).alias("b"), F.explode(F.expr(f"array(t div {width}L, t div {width}L - 1, t div {width}L + 1)")).alias("_b"))
    return a.join(b, ["symbol", "_b"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("t_a") - F.col("t_b")) <= width)).select("symbol", "a", "b")


def matched(left: DataFrame, right: DataFrame, on: list[str], least: float = 0.5) -> DataFrame:
    """A left join that fails when fewer than ``least`` of the rows of left find a match."""
    out = left.join(right.withColumn("_hit", F.lit(1)), on, "left")
    share = out.agg(F.avg(F.coalesce("_hit", F.lit(0))).alias("s")).first()["s"]
    if share is not None and share < least:
        raise ValueError(f"only {share:.1%} of the rows match on {on}")
    return out.drop("_hit")


def excess(rows: DataFrame, benchmark: str) -> DataFrame:
    """ret minus the benchmark symbol's ret at the same t; rows without one are dropped."""
    b = rows.where(F.col("symbol") == benchmark).select("t", F.col("ret").alias("bench"))
    return rows.where(F.col("symbol") != benchmark).join(b, "t").withColumn("excess", F.col("ret") - F.col("bench"))


def near(queries: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """queries (q_symbol, q_t0) with all rows (c_symbol, c_t0) of any symbol that begin at most ``width`` apart, the
    query itself left out. Buckets of that width, so the join is an equi-join; queries are a stated set."""
    q = queries.withColumn("_b", F.explode(F.expr(f"array(q_t0 div {width}L, q_t0 div {width}L - 1, q_t0 div {width}L + 1)")))
    got = q.join(rows.withColumn("_b", F.expr(f"c_t0 div {width}L")), "_b").drop("_b")
    return got.where((F.abs(F.col("q_t0") - F.col("c_t0")) <= width) & ~((F.col("q_symbol") == F.col("c_symbol")) & (F.col("q_t0") == F.col("c_t0"))))
