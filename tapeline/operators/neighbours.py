"""What neighbours tell: eligible queries, stratified samples, summaries for each query, consistency over queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.operators import knn
from tapeline.operators.evaluation import hash_order

DAY = 86_400_000


def eligible(library: DataFrame, low: float, high: float, floor: int) -> DataFrame:
    """Windows that may be queries: a forward label, amplitude within [low, high], begun after floor."""
    return library.where(F.col("fwd_ret").isNotNull() & F.col("amp_pct").between(low, high) & (F.col("t0") > floor))


def stratified(rows: DataFrame, n: int, seed: str, key: list[str]) -> DataFrame:
    """At most n rows, as many from each year of t0 (n div years, one at least), in the order of md5(seed-key)."""
    x = rows.withColumn("year", F.year(F.timestamp_millis("t0"))).withColumn("_o", hash_order(seed, *key))
    years = x.agg(F.countDistinct("year").alias("_y"))
    own = F.row_number().over(Window.partitionBy("year").orderBy("_o", *key))
    x = x.withColumn("_n", own).where(F.col("_n") <= n).crossJoin(F.broadcast(years))  # one row
    return x.where(F.col("_n") <= F.greatest(F.lit(1), F.expr(f"{n} div _y"))).orderBy("_o", *key).limit(n).drop("_o", "_n", "_y")


def with_excess(library: DataFrame) -> DataFrame:
    """exc and excmax, the forward return and best move less their means over all windows that end at the same time,
    and hit, whether the best move reaches 5 %. Null labels stay null and are not counted."""
    w = Window.partitionBy("t1")
    return library.withColumns(
        {"exc": F.col("fwd_ret") - F.avg("fwd_ret").over(w), "excmax": F.col("fwd_max") - F.avg("fwd_max").over(w), "hit": (F.col("fwd_max") >= 0.05).cast("double")}
    )


def clean_outcomes(library: DataFrame, cap: float = 100.0) -> DataFrame:
    """swing, the width of the forward range in per cent, cut to [0, cap]; rows without a return of at most 100 % either
    way, or without any swing, are dropped."""
    x = library.withColumn("swing", F.least(F.lit(cap), F.greatest(F.lit(0.0), (F.col("fwd_max") - F.col("fwd_min")) * 100)))
    return x.where((F.abs("fwd_ret") <= 1) & (F.col("swing") > 1e-9))


def by_scalar(queries: DataFrame, library: DataFrame, x: str, reach: int, k: int, by: list[str], ties: list[str], allow: Column) -> DataFrame:
    """The k neighbours of each query nearest in one column, among the ``reach`` rows on either side that ``allow``.

    Two bounded searches, upwards and downwards, so the library is never sorted as a whole.
    """
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    c = library.select(*(F.col(v).alias(f"c_{v}") for v in library.columns))
    pairs = c.crossJoin(knn.checked(q)).where(allow).withColumn("dist", F.abs(F.col(f"c_{x}") - F.col(f"q_{x}")))
    up = F.col(f"c_{x}") >= F.col(f"q_{x}")
    both = knn.top(pairs.withColumn("_up", up), reach, [*by, "_up"], ties, "_n").drop("_n", "_up")
    return knn.top(both, k, by, ties)


def summaries(found: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """For each query over its neighbours (c_exc, c_excmax, c_hit, c_fwd_ret, c_t0, c_t1 beside q_t0): mean excess,
    mean best move, hit rate, population dispersion of returns, mean distance in days, number, and the mean excess of
    those that end before the query begins. Null with under ``least`` neighbours."""
    past = F.col("c_t1") <= F.col("q_t0")
    ok = F.count("*") >= least
    return found.groupBy(*by).agg(
        F.when(ok, F.avg("c_exc")).alias("exc"),
        F.when(ok, F.avg("c_excmax")).alias("excmax"),
        F.when(ok, F.avg("c_hit")).alias("hit"),
        F.when(ok, F.stddev_pop("c_fwd_ret")).alias("dispersion"),
        F.when(ok, F.avg(F.abs(F.col("c_t0") - F.col("q_t0")) / DAY)).alias("days"),
        F.when(ok & (F.count_if(past) >= least), F.avg(F.when(past, F.col("c_exc")))).alias("past_exc"),
        F.when(ok, F.count("*")).otherwise(0).alias("n"),
    )


def consistency(per: DataFrame, reference: DataFrame, least: int = 30) -> DataFrame:
    """Over all queries (exc, dispersion, days, n beside the query's own own_exc): share of equal signs, mean own excess
    where neighbours rise (null under ``least`` queries), median dispersion and its ratio to that of ``reference``
    (dispersion of random neighbours), median distance in days, mean number of neighbours."""
    both = F.col("exc").isNotNull() & F.col("own_exc").isNotNull()
    rising = both & (F.col("exc") > 0)
    half = lambda c: F.percentile(c, F.lit(0.5))
    base = reference.agg(half("dispersion").alias("random"))
    x = per.agg(
        F.avg(F.when(both, (F.signum("exc") == F.signum("own_exc")).cast("double"))).alias("same_sign"),
        F.when(F.count_if(rising) >= least, F.avg(F.when(rising, F.col("own_exc")))).alias("long_rule"),
        half("dispersion").alias("dispersion"),
        half("days").alias("days"),
        F.avg("n").alias("neighbours"),
    )
    return x.crossJoin(base).withColumn("ratio", F.try_divide("dispersion", "random"))  # one row each


def outlook(found: DataFrame, by: list[str]) -> DataFrame:
    """Median swing and mean excess of each query's neighbours; null where none has any."""
    return found.groupBy(*by).agg(F.percentile("c_swing", F.lit(0.5)).alias("nb_vol"), F.avg("c_exc").alias("nb_ret"))


def every(rows: DataFrame, period: str, step: int, least: int) -> DataFrame:
    """Rows of every ``step``-th period that has ``least`` rows or more, with the period's new number g."""
    per = rows.groupBy(period).agg(F.count("*").alias("_n"))  # a row a period
    chosen = per.withColumn("_k", F.row_number().over(Window.orderBy(period)) - 1).where((F.col("_k") % step == 0) & (F.col("_n") >= least))
    chosen = chosen.select(period, (F.row_number().over(Window.orderBy(period)) - 1).alias("g"))
    return rows.join(chosen, period)


def context(ranges: DataFrame, bars: DataFrame) -> DataFrame:
    """ranges (symbol, t0, t1) with the market's net move in mean true ranges and that range as a share of the price,
    over the bars (of one benchmark symbol, with tr) from the first at or after t0 to the last at or before t1.

    Prefix sums and two as-of joins; null where fewer than two bars lie inside or none has a range.
    """
    from tapeline.operators.joins import asof

    w = Window.orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)  # one symbol's bars
    b = bars.withColumn("cum", F.sum("tr").over(w)).withColumn("rn", F.row_number().over(Window.orderBy("open_time")))
    b = b.select(F.lit("").alias("symbol"), F.col("open_time").alias("t"), F.struct("rn", "close", "cum", "tr").alias("x"))
    r = ranges.select(F.lit("").alias("symbol"), F.col("symbol").alias("_name"), "t0", "t1")
    first = asof(r.withColumn("t", F.col("t0")), b, "x", "forward").withColumnRenamed("x", "a").drop("match_t", "t")
    x = asof(first.withColumn("t", F.col("t1")), b, "x").withColumnRenamed("x", "z").drop("match_t", "t")
    n = F.col("z.rn") - F.col("a.rn") + 1
    atr = F.when((n > 1) & (F.col("z.cum") > F.col("a.cum") - F.col("a.tr")), (F.col("z.cum") - F.col("a.cum") + F.col("a.tr")) / n)
    return x.select(F.col("_name").alias("symbol"), "t0", "t1", F.try_divide(F.col("z.close") - F.col("a.close"), atr).alias("net_atr"), F.try_divide(atr, F.col("a.close")).alias("atr_pct"))
