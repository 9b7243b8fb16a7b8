"""Liquidity panels and point-in-time universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_day() -> WindowSpec:
    return Window.partitionBy("sym").orderBy("day")


def calendar(panel: DataFrame) -> DataFrame:
    """The panel on a dense calendar from each symbol's first to its last day; days without trade have dvol 0."""
    span = panel.groupBy("sym").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("sym", F.explode(F.sequence("a", "b")).alias("day"))
    return days.join(panel, ["sym", "day"], "left").withColumn("dvol", F.coalesce("dvol", F.lit(0.0)))


def rolling_liquidity(dense: DataFrame, spans: tuple[tuple[int, int], ...] = ((30, 10), (60, 20))) -> DataFrame:
    """Rolling medians of dvol, null before the least number of days."""
    out = dense
    for n, least in spans:
        w = by_day().rowsBetween(1 - n, 0)
        out = out.withColumn(f"liq{n}", F.when(F.count("*").over(w) >= least, F.percentile("dvol", F.lit(0.5)).over(w)))
    return out


def pct_rank(value: str, by: list[str]) -> Column:
    """Average rank of equals over the number of values; null stays null and uncounted."""
    w = Window.partitionBy(*by)
    low = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    ties = F.count(value).over(Window.partitionBy(*by, value))
    return F.when(F.col(value).isNotNull(), (low + (ties - 1) / 2) / F.count(value).over(w))


def without(rows: DataFrame, names: DataFrame, column: str = "sym") -> DataFrame:
    """Rows whose symbol is not listed in names (one column of that name)."""
    return rows.join(names.select(column).distinct(), column, "left_anti")


def greatest_least(rows: DataFrame, value: str, n: int) -> DataFrame:
    """The n symbols with the greatest and with the least value, ties by symbol; a null value is neither."""
    x = rows.where(F.col(value).isNotNull())
    up, down = x.orderBy(F.col(value).desc(), "sym").limit(n), x.orderBy(F.col(value), "sym").limit(n)
    return up.withColumn("end", F.lit("greatest")).unionByName(down.withColumn("end", F.lit("least"))).select("sym", value, "end")


def top_k(liq: DataFrame, value: str, k: int, delay: int = 1, rank_zero: bool = False, floor: float = 0.0) -> DataFrame:
    """(sym, day) in the universe of a day: the k greatest values ``delay`` days before, by rank then symbol; of these,
    the ones of at least floor."""
    x = liq.where(F.col(value).isNotNull() if rank_zero else (F.col(value) > 0))
    w = Window.partitionBy("day").orderBy(F.col(value).desc(), "sym")
    x = x.withColumn("rank", F.row_number().over(w)).where((F.col("rank") <= k) & (F.col(value) >= floor))
    return x.select("sym", (F.col("day") + delay).alias("day"), "rank")


def turnover(members: DataFrame) -> DataFrame:
    """For each day but the first, 1 - shared / all members of it and the day before it."""
    sets = members.groupBy("day").agg(F.collect_set("sym").alias("now"))  # k members a day
    sets = sets.withColumn("then", F.lag("now").over(Window.orderBy("day"))).where("then is not null")  # a row a day
    return sets.select("day", (1 - F.size(F.array_intersect("now", "then")) / F.size(F.array_union("now", "then"))).alias("turnover"))


def membership(members: DataFrame, liq: DataFrame, value: str) -> DataFrame:
    """For each symbol: days in the universe, their share of all its days, median value while in it."""
    x = liq.join(members.select("sym", "day", F.lit(1).alias("hit")), ["sym", "day"], "left")
    return x.groupBy("sym").agg(
        F.count("hit").alias("days_in"), (F.count("hit") / F.count("*")).alias("share"), F.percentile(F.when(F.col("hit") == 1, F.col(value)), F.lit(0.5)).alias("median_in")
    )


def delisted(panel: DataFrame, days: int = 30) -> DataFrame:
    """Symbols whose last day lies more than ``days`` before the newest."""
    last = panel.groupBy("sym").agg(F.max("day").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.crossJoin(F.broadcast(newest)).where(F.col("last") < F.col("newest") - days).select("sym", "last")


def coverage(panel: DataFrame) -> DataFrame:
    """Symbols whose last day is at most 0, 1, 7 and 30 days before the newest."""
    last = panel.groupBy("sym").agg(F.max("day").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    x = last.crossJoin(F.broadcast(newest)).withColumn("age", F.col("newest") - F.col("last"))
    return x.agg(F.count("*").alias("symbols"), *(F.count_if(F.col("age") <= n).alias(f"within_{n}") for n in (0, 1, 7, 30)))


def visible(panel: DataFrame, stale_days: int = 60) -> DataFrame:
    """First and last month and count for each symbol; stale when the last lies far behind the newest."""
    x = panel.groupBy("sym").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"))
    newest = panel.agg(F.max("day").alias("newest"))
    return x.crossJoin(F.broadcast(newest)).select("sym", "first", "last", "days", (F.col("newest") - F.col("last") > stale_days).alias("stale"))


def build(spans: DataFrame, least_days: int, want: int) -> DataFrame:
    """A universe of up to ``want`` symbols: dead ones up to a third, then living ones, both by span then name."""
    x = spans.withColumn("span", F.col("last") - F.col("first")).where(F.col("span") >= least_days)
    w = lambda: Window.orderBy(F.col("span").desc(), "sym")  # noqa: E731  a row a symbol
    dead = x.where("stale").withColumn("n", F.row_number().over(w())).where(F.col("n") <= want // 3)
    room = dead.agg((F.lit(want) - F.count("*")).alias("room"))
    alive = x.where("not stale").withColumn("n", F.row_number().over(w())).crossJoin(F.broadcast(room)).where("n <= room")
    return dead.select("sym", F.lit("dead").alias("state"), "n").unionByName(alive.select("sym", F.lit("alive").alias("state"), "n"))
