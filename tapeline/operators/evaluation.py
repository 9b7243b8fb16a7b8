"""Cross-sectional evaluation: rank correlation, quintiles, portfolios, risk figures, block bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, *keys: str | Column) -> Column:
    """A reproducible random order: md5 of seed and keys, alike in any engine."""
    return F.md5(F.concat_ws("-", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def demean(x: str, by: str) -> Column:
    return F.col(x) - F.avg(x).over(Window.partitionBy(by))


def spearman(rows: DataFrame, a: str, b: str, ties: str, by: list[str], least: int = 30) -> DataFrame:
    """Rank correlation for each group with ordinal ranks (equals by ``ties``); null under ``least`` pairs."""
    x = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    w = lambda c: Window.partitionBy(*by).orderBy(c, ties)
    x = x.withColumn("_a", F.row_number().over(w(a)).cast("double")).withColumn("_b", F.row_number().over(w(b)).cast("double"))
    return x.groupBy(*by).agg(F.when(F.count("*") >= least, F.corr("_a", "_b")).alias("ic"), F.count("*").alias("n"))


def quintile(x: str, ties: str, by: list[str], parts: int = 5) -> Column:
    """Bucket 1..parts of the first-come rank: edges at even quantiles of the ranks."""
    w = Window.partitionBy(*by)
    r, n = F.row_number().over(w.orderBy(x, ties)), F.count("*").over(w)
    return F.greatest(F.lit(1), F.ceil((r - 1) * parts / F.greatest(n - 1, F.lit(1)))).cast("int")


def quintile_spread(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Mean of y over the top fifth of x minus that over the bottom fifth, by linear quantile edges."""
    edges = rows.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.2), F.lit(0.8))).alias("e"))
    z = rows.join(edges, by)
    low = F.avg(F.when(F.col(x) <= F.get("e", F.lit(0)), F.col(y)))
    high = F.avg(F.when(F.col(x) > F.get("e", F.lit(1)), F.col(y)))
    return z.groupBy(*by).agg((high - low).alias("spread"))


def neighbours(found: DataFrame, by: list[str], hit: float = 0.05) -> DataFrame:
    """For each query: mean, hit rate, population dispersion and number of its neighbours' labels."""
    y = F.col("y")
    return found.where(y.isNotNull()).groupBy(*by).agg(F.avg(y).alias("mean"), F.avg((y >= hit).cast("double")).alias("hit_rate"), F.stddev_pop(y).alias("dispersion"), F.count("*").alias("n"))


def inverse_weights(x: str, by: str, cap: float | None = None) -> Column:
    """Weights 1/x within a period, summing to 1; x that is null or not positive counts as the median."""
    w = Window.partitionBy(by)
    good = F.when(F.col(x) > 0, F.col(x))
    filled = F.coalesce(good, F.percentile(good, F.lit(0.5)).over(w))
    if cap is not None:
        filled = F.least(filled, F.percentile(good, F.lit(cap)).over(w))
    return (1 / filled) / F.sum(1 / filled).over(w)


def portfolio(cells: DataFrame, weight: str, ret: str, by: str) -> DataFrame:
    """Weighted return, effective number of holdings and greatest weight of each period."""
    return cells.groupBy(by).agg(
        F.sum(F.col(weight) * F.col(ret)).alias("ret"), (1 / F.sum(F.col(weight) * F.col(weight))).alias("effective_n"), F.max(weight).alias("max_weight"), F.count("*").alias("n")
    )


def exposure(periods: DataFrame, x: str, order: str) -> DataFrame:
    """Scale of total exposure: exp of the clipped distance of log x from its mean, with mean 1."""
    logs = periods.withColumn("_l", F.ln(x))
    m = logs.agg(F.avg("_l").alias("_m"))
    s = logs.crossJoin(F.broadcast(m)).withColumn("_s", F.exp(F.greatest(F.lit(-1.5), F.least(F.lit(1.5), F.col("_m") - F.col("_l")))))
    mean = s.agg(F.avg("_s").alias("_a"))
    return s.crossJoin(F.broadcast(mean)).select(order, (F.col("_s") / F.col("_a")).alias("scale"))


def inverse_exposure(cells: DataFrame, x: str, by: str) -> DataFrame:
    """Scale of total exposure: the mean of 1 / x over a period's holdings (x above 0), with mean 1 over periods."""
    per = cells.where(F.col(x) > 0).groupBy(by).agg(F.avg(1 / F.col(x)).alias("_s"))
    return per.crossJoin(F.broadcast(per.agg(F.avg("_s").alias("_a")))).select(by, (F.col("_s") / F.col("_a")).alias("scale"))  # one row


def nav(periods: DataFrame, by: list[str], order: str) -> DataFrame:
    """Net value and drawdown of returns above -1; periods are few (one row a period and scheme)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = periods.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(w)))
    return x.withColumn("drawdown", F.col("nav") / F.max("nav").over(w) - 1)


def risk(periods: DataFrame, by: list[str], order: str, per_year: float) -> DataFrame:
    """Annual return, volatility, Sharpe (population), worst drawdown, share of gains, t and thinned t (every 5th)."""
    x = nav(periods, by, order)
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    x = x.withColumn("_thin", F.when(n % 5 == 0, F.col("ret")))
    mean, sd = F.avg("ret"), F.stddev_pop("ret")
    return x.groupBy(*by).agg(
        F.count("*").alias("n"),
        (mean * per_year).alias("annual_ret"),
        (sd * per_year**0.5).alias("annual_vol"),
        F.when(sd > 0, mean / sd * per_year**0.5).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        F.when(sd > 0, mean / sd * F.sqrt(F.count("*"))).alias("t"),
        F.when(F.stddev_pop("_thin") > 0, F.avg("_thin") / F.stddev_pop("_thin") * F.sqrt(F.count("_thin"))).alias("t_thin"),
    )


def by_year(periods: DataFrame, schemes: list[str]) -> DataFrame:
    """Sum of returns by year, one column a scheme, and how many are positive."""
    x = periods.groupBy("year").pivot("scheme", schemes).agg(F.sum("ret"))
    return x.withColumn("positive", sum((F.coalesce(F.col(s), F.lit(0.0)) > 0).cast("int") for s in schemes))


def block_draws(places: DataFrame, n: DataFrame, reps: int, block: int, seed: str) -> DataFrame:
    """(rep, places' columns) of ``reps`` resamples: ceil(n / block) blocks that start anywhere and end with the series.

    Only (replicate, block) starts are generated; they meet the periods by an equi-join on the place, which leaves
    out what lies past the end.
    """
    draws = places.sparkSession.range(reps).select(F.col("id").alias("rep")).crossJoin(F.broadcast(n))  # one row
    draws = draws.select("rep", "n", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / block).cast("int") - 1)).alias("j"))
    start = F.conv(F.substring(hash_order(seed, "rep", "j"), 1, 8), 16, 10).cast("long") % F.col("n")
    draws = draws.select("rep", F.explode(F.sequence(start, start + (block - 1))).alias("i"))
    return draws.join(places, "i")


def block_bootstrap(periods: DataFrame, order: str, reps: int, block: int, seed: str, per_year: float) -> DataFrame:
    """Difference of the yearly Sharpe ratios of columns b and a: estimate, block-bootstrap standard error, two-sided p.

    A resample in which a column does not vary counts as neither side. No periods: one row of nulls.
    """
    x = periods.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1).select("i", "a", "b")  # a row a period
    n = x.agg(F.count("*").alias("n")).where("n > 0")
    sharpe = lambda c: F.try_divide(F.avg(c), F.stddev_pop(c)) * per_year**0.5
    d = block_draws(x, n, reps, block, seed).groupBy("rep").agg((sharpe("b") - sharpe("a")).alias("d"))
    actual = x.agg((sharpe("b") - sharpe("a")).alias("diff"))
    side = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    s = d.agg(F.stddev_pop("d").alias("se"), (2 * F.least(side(F.col("d") <= 0), side(F.col("d") >= 0))).alias("p"))
    return actual.crossJoin(s)


def bootstrap_mean(periods: DataFrame, order: str, reps: int, block: int, seed: str, least: int = 20) -> DataFrame:
    """Mean of b - a over periods that have both, its block-bootstrap standard error and their ratio; null under
    ``least`` periods."""
    both = periods.where("a is not null and b is not null")
    x = both.withColumn("i", F.row_number().over(Window.orderBy(order)) - 1).select("i", (F.col("b") - F.col("a")).alias("d"))
    n = x.agg(F.count("*").alias("n")).where("n > 0")
    se = block_draws(x, n, reps, block, seed).groupBy("rep").agg(F.avg("d").alias("m")).agg(F.stddev_pop("m").alias("se"))
    out = x.agg(F.avg("d").alias("mean"), F.count("*").alias("n")).crossJoin(se)
    ok = F.col("n") >= least
    return out.select(F.when(ok, F.col("mean")).alias("mean"), F.when(ok, F.col("se")).alias("se"), F.when(ok & (F.col("se") > 0), F.col("mean") / F.col("se")).alias("t"))


def random_control(rows: DataFrame, key: str, value: str, chosen: str, reps: int, seed: str) -> DataFrame:
    """The rule's mean against means of random subsets of the same size: its mean, theirs, share below it.

    Before a replicate's rows are sorted, a hash bound that holds as many as are wanted (but for odds of about 1e-9)
    leaves the others out.
    """
    size = rows.agg(F.count_if(chosen).alias("k"), F.count("*").alias("total"), F.avg(F.when(F.col(chosen), F.col(value))).alias("rule"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = rows.select(key, value).repartition(parts, key)  # few rows become reps times as many
    draws = draws.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).crossJoin(F.broadcast(size))
    draws = draws.withColumn("o", hash_order(seed, "rep", key))
    draws = draws.where(F.conv(F.substring("o", 1, 8), 16, 10).cast("double") / 2**32 <= (F.col("k") + 6 * F.sqrt("k") + 20) / F.col("total"))
    draws = draws.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("o", key))).where("n <= k")
    means = draws.groupBy("rep").agg(F.avg(value).alias("m"), F.first("rule").alias("rule"))
    return means.agg(F.first("rule").alias("rule"), F.avg("m").alias("control"), F.avg((F.col("m") < F.col("rule")).cast("double")).alias("rank"))


def random_portfolio(cells: DataFrame, by: str, key: str, ret: str, k: int, reps: int, seed: str) -> DataFrame:
    """Mean return over periods of k random holdings, drawn anew each period, for each replicate."""
    draws = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    w = Window.partitionBy("rep", by).orderBy(hash_order(seed, "rep", by, key), key)
    got = draws.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
    return got.groupBy("rep", by).agg(F.avg(ret).alias("r")).groupBy("rep").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))


def fixed_control(cells: DataFrame, chosen: Column, by: str, key: str, ret: str, k: int, reps: int, seed: str, per_year: float) -> DataFrame:
    """Yearly Sharpe ratios on the periods in which the scheme (cells that are ``chosen``) holds anything: the scheme's,
    that of k holdings drawn anew each period, and median, 5 % and 95 % of ``reps`` draws of k holdings for good; and
    the share of these below the scheme's. Holdings without a return in a period are left out of its mean."""
    mean, sd = F.avg("r"), F.stddev_pop("r")
    sharpe = F.when(F.count("r") > 1, F.try_divide(mean, sd)) * per_year**0.5
    scheme = cells.where(chosen).groupBy(by).agg(F.avg(ret).alias("r"))
    common = scheme.select(by)  # a row a period
    held = cells.join(F.broadcast(common), by, "left_semi")
    keys = cells.select(key).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    w = Window.partitionBy("rep").orderBy(hash_order(seed, "rep", key), key)
    keys = keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")  # k a replicate
    fixed = held.join(F.broadcast(keys), key).groupBy("rep", by).agg(F.avg(ret).alias("r")).groupBy("rep").agg(sharpe.alias("s"))
    w = Window.partitionBy(by).orderBy(hash_order(f"{seed}-each", by, key), key)
    drawn = held.withColumn("_n", F.row_number().over(w)).withColumn("_m", F.count("*").over(Window.partitionBy(by)))
    rotated = drawn.where((F.col("_n") <= k) & (F.col("_m") >= k)).groupBy(by).agg(F.avg(ret).alias("r")).agg(sharpe.alias("rotated"))
    own = scheme.agg(F.count("*").alias("periods"), sharpe.alias("scheme"))
    x = fixed.crossJoin(F.broadcast(own))  # one row
    q = lambda p: F.percentile("s", F.lit(p))
    out = x.agg(F.first("periods").alias("periods"), F.first("scheme").alias("scheme"), q(0.5).alias("fixed"), q(0.05).alias("fixed_p05"), q(0.95).alias("fixed_p95"), F.avg((F.col("s") < F.col("scheme")).cast("double")).alias("rank"))
    return out.crossJoin(rotated)


def permuted(cells: DataFrame, by: str, key: str, weight: str, ret: str, seed: str) -> DataFrame:
    """Period returns with the weights dealt out at random among the period's holdings."""
    a = cells.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(key))).select(by, "n", ret)
    b = cells.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(hash_order(seed, by, key), key))).select(by, "n", weight)
    return a.join(b, [by, "n"]).groupBy(by).agg(F.sum(F.col(weight) * F.col(ret)).alias("ret"))
