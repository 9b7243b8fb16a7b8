"""Bars: resampling, sanity, audits, gaps, true range.

Ticks are reduced to bars by a map-side combined aggregate first. Windows run by symbol over bars, whose
number for one symbol is bounded by the time span and the bar length, never by the ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def interval_ms(text: Column) -> Column:
    """'15m' or '1h' in milliseconds; anything else is null."""
    n, unit = F.regexp_extract(text, r"^(\d+)([mh])$", 1), F.regexp_extract(text, r"^(\d+)([mh])$", 2)
    return F.when(unit == "m", n.try_cast("long") * 60_000).when(unit == "h", n.try_cast("long") * 3_600_000)


def total(x: Column) -> Column:
    """Sum of doubles that does not follow the order of the rows: equal ticks make equal bars, however they are read.

    In decimals, and rounded once, where every value has at most 18 digits before the point and 20 behind it; else as
    doubles add up.
    """
    d = x.try_cast("decimal(38, 20)")
    return F.coalesce(F.when(F.count_if(~x.eqNullSafe(d.cast("double"))) == 0, F.try_sum(d).cast("double")), F.sum(x))


def resample(ticks: DataFrame, step_ms: int) -> DataFrame:
    """OHLC, quote volume and count for each symbol and bucket; empty buckets are absent."""
    at = F.struct("us", "id")
    bucket = F.expr(f"(us div {step_ms * 1000}L) * {step_ms}L")
    return ticks.groupBy("symbol", bucket.alias("open_time")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), total(F.col("qv")).alias("qv"), F.count("*").alias("n")
    )


def coarsen(bars: DataFrame, step_ms: int) -> DataFrame:
    """Bars of a longer step from bars; equal to resampling the ticks."""
    bucket = F.expr(f"(open_time div {step_ms}L) * {step_ms}L")
    return bars.groupBy("symbol", bucket.alias("open_time")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), total(F.col("qv")).alias("qv"), F.sum("n").alias("n")
    )


def sanity(bars: DataFrame, order: str | None = None) -> DataFrame:
    """Counts of impossible bars for each symbol; descending: bars stored (by the column ``order``) after a later one."""
    gap = F.col("open_time") - F.lag("open_time").over(by_time())
    b = bars.withColumn("gap", gap)
    if order:
        b = b.withColumn("place", F.col("open_time") - F.lag("open_time").over(Window.partitionBy("symbol").orderBy(order)))
    else:
        b = b.withColumn("place", F.lit(0))
    count = lambda c: F.count_if(c)
    return b.groupBy("symbol").agg(
        F.count("*").alias("bars"),
        count(F.col("gap") == 0).alias("duplicates"),
        count(F.col("place") < 0).alias("descending"),
        count(F.col("high") < F.col("low")).alias("high_below_low"),
        count(F.col("high") < F.greatest("open", "close")).alias("high_short"),
        count(F.col("low") > F.least("open", "close")).alias("low_short"),
    )


def live_issues(bars: DataFrame, step_ms: int) -> DataFrame:
    """Bars with at least one fault, named."""
    gap = F.col("open_time") - F.lag("open_time").over(by_time())
    slack = 1e-9
    issues = F.array_compact(
        F.array(
            F.when(F.col("close").isNull() | F.isnan("close") | (F.abs("close") == float("inf")) | (F.col("close") <= 0), F.lit("close")),
            F.when((F.col("high") < F.greatest("open", "close") - slack) | (F.col("low") > F.least("open", "close") + slack), F.lit("envelope")),
            F.when(F.col("qv") < 0, F.lit("volume")),
            F.when(gap != step_ms, F.lit("step")),
        )
    )
    return bars.withColumn("issues", F.array_join(issues, ",")).where("issues != ''").select("symbol", "open_time", "issues")


def repair(bars: DataFrame, zero: bool = False) -> DataFrame:
    """High and low that are missing, not finite or not positive become the close.

    zero: prices may be anything, zero too; only those that are missing or do not cover open and close are replaced.
    """
    wrong = {c: F.isnan(c) | (F.abs(c) == float("inf")) | (F.col(c) <= 0) for c in ("high", "low")}
    if zero:
        wrong = {"high": F.col("high") < F.greatest("open", "close"), "low": F.col("low") > F.least("open", "close")}
    return bars.withColumns({c: F.when(F.col(c).isNull() | w, F.col("close")).otherwise(F.col(c)) for c, w in wrong.items()})


def with_step(bars: DataFrame) -> DataFrame:
    """gap to the previous bar, and step: the symbol's commonest gap (the least of equals)."""
    b = bars.withColumn("gap", F.col("open_time") - F.lag("open_time").over(by_time()))
    modes = b.where("gap is not null").groupBy("symbol", "gap").count()
    modes = modes.groupBy("symbol").agg(F.max_by("gap", F.struct("count", -F.col("gap"))).alias("step"))
    return b.join(modes, "symbol")


def audit(bars: DataFrame) -> DataFrame:
    """Coverage, gaps, dead volume and the tail without life, for each symbol."""
    live = (F.col("qv") > 0) & (F.col("high") != F.col("low"))
    b = with_step(bars)
    last_live = F.max(F.when(live, F.col("open_time")))
    a = b.groupBy("symbol").agg(
        F.count("*").alias("bars"),
        F.first("step").alias("step"),
        F.min("open_time").alias("first"),
        F.max("open_time").alias("last"),
        last_live.alias("last_live"),
        F.count_if(F.col("gap") > F.col("step")).alias("gaps"),
        F.max("gap").alias("max_gap"),
        F.max_by("open_time", F.struct("gap", -F.col("open_time"))).alias("max_gap_to"),
        F.avg(F.when(F.col("qv") > 0, 0.0).otherwise(1.0)).alias("z"),
        F.avg(F.when(F.col("high") == F.col("low"), 1.0).otherwise(0.0)).alias("f"),
        F.percentile("qv", F.lit(0.5)).alias("median_qv"),
    )
    expected = F.expr("(last - first) div step + 1")
    return a.select(
        "symbol",
        "bars",
        expected.alias("expected"),
        F.round((1 - F.col("bars") / expected) * 100, 6).alias("missing_pct"),
        "gaps",
        "max_gap",
        "max_gap_to",
        F.round(F.col("z") * 100, 6).alias("zero_pct"),
        F.round(F.col("f") * 100, 6).alias("flat_pct"),
        F.round("median_qv", 6).alias("median_qv"),
        "first",
        "last",
        "last_live",
    )


def halts(bars: DataFrame, newest_ms: int | None = None, gap_ms: int = 72 * 3_600_000, thin: float = 100_000.0) -> DataFrame:
    """Why a symbol's longest gap is long: thin, dead or resumed."""
    a = audit(bars)
    newest = bars.agg(F.max("open_time").alias("newest"))
    kind = (
        F.when(F.col("max_gap") <= gap_ms, "none")
        .when(F.col("median_qv") < thin, "thin")
        .when(F.date_trunc("month", F.timestamp_millis("last_live")) < F.date_trunc("month", F.timestamp_millis("newest")), "dead")
        .otherwise("resumed")
    )
    return a.crossJoin(F.broadcast(newest)).select("symbol", "max_gap", kind.alias("kind"))  # newest is one row


def gaps(bars: DataFrame) -> DataFrame:
    """Every gap longer than the symbol's step: its ends and missing bars."""
    b = with_step(bars).where("gap > step")
    return b.select("symbol", (F.col("open_time") - F.col("gap")).alias("before"), F.col("open_time").alias("after"), F.expr("gap div step - 1").alias("missing"))


def islands(bars: DataFrame) -> DataFrame:
    """Runs of consecutive bars: first, last, length."""
    b = with_step(bars)
    new = F.when(F.coalesce(F.col("gap") > F.col("step"), F.lit(True)), 1).otherwise(0)
    b = b.withColumn("island", F.sum(new).over(by_time()))
    return b.groupBy("symbol", "island").agg(F.min("open_time").alias("first"), F.max("open_time").alias("last"), F.count("*").alias("bars"))


def longest_runs(bars: DataFrame) -> DataFrame:
    """The longest runs of flat bars and of falling closes for each symbol."""
    b = bars.withColumn("fall", F.coalesce(F.col("close") < F.lag("close").over(by_time()), F.lit(False))).withColumn("flat", F.col("high") == F.col("low"))
    out = None
    for c in ("flat", "fall"):
        groups = b.withColumn("g", F.sum((~F.col(c)).cast("int")).over(by_time())).where(c).groupBy("symbol", "g").agg(F.count("*").alias("n"))
        top = groups.groupBy("symbol").agg(F.max("n").alias(f"longest_{c}"))
        out = top if out is None else out.join(top, "symbol", "full")
    return b.select("symbol").distinct().join(out, "symbol", "left").select("symbol", *(F.coalesce(f"longest_{c}", F.lit(0)).alias(f"longest_{c}") for c in ("flat", "fall")))


def zombie_tail(bars: DataFrame, thin: float = 0.0) -> DataFrame:
    """Bars after the last one with volume above thin and a range."""
    live = (F.col("qv") > thin) & (F.col("high") != F.col("low"))
    last = F.max(F.when(live, F.col("open_time"))).over(Window.partitionBy("symbol"))
    b = bars.withColumn("last_live", last)
    return b.groupBy("symbol").agg(F.first("last_live").alias("last_live"), F.count_if(F.col("last_live").isNull() | (F.col("open_time") > F.col("last_live"))).alias("zombies"))


def true_range(bars: DataFrame) -> DataFrame:
    """tr: of the first bar its range."""
    pc = F.lag("close").over(by_time())
    tr = F.when(pc.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc)))
    return bars.withColumn("tr", tr)


def atr(bars: DataFrame, n: int = 14, chunk: int = 1024) -> DataFrame:
    """Wilder's average of the true range, null for the first n - 1 bars.

    The recursion runs inside chunks of bounded length; what a chunk hands on decays by (1 - 1/n)^chunk, below
    double precision for chunk >= 500 * n / 7, so the end of the chunk before is all that a chunk needs.
    """
    keep = 1 - 1 / n
    b = true_range(bars).withColumn("rn", F.row_number().over(by_time()) - 1)
    rows = b.groupBy("symbol", F.expr(f"rn div {chunk}").alias("c")).agg(F.sort_array(F.collect_list(F.struct("rn", "open_time", "tr"))).alias("r"))
    zero = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        y = F.when(r["rn"] == 0, r["tr"]).otherwise(s["y"] * keep + r["tr"] / n)
        return F.struct(y.alias("y"), F.concat(s["out"], F.array(y)).alias("out"))

    rows = rows.withColumn("s", F.aggregate("r", zero, step))
    carry = F.coalesce(F.lag("s.y").over(Window.partitionBy("symbol").orderBy("c")), F.lit(0.0))
    rows = rows.withColumn("carry", carry).select("symbol", "carry", F.posexplode(F.arrays_zip("r", F.col("s.out").alias("y"))).alias("i", "z"))
    y = F.col("z.y") + F.col("carry") * F.pow(F.lit(keep), F.col("i") + 1)
    return rows.select("symbol", F.col("z.r.open_time").alias("open_time"), F.col("z.r.tr").alias("tr"), F.when(F.col("z.r.rn") >= n - 1, y).alias("atr"))


def liquid(bars: DataFrame, least: float, rows: int) -> DataFrame:
    """Symbols with a median volume and a length of at least so much."""
    return bars.groupBy("symbol").agg(F.percentile("qv", F.lit(0.5)).alias("m"), F.count("*").alias("k")).where((F.col("m") >= least) & (F.col("k") >= rows)).select("symbol")


def contiguous(bars: DataFrame, win: int, step_ms: int, least_n: int) -> DataFrame:
    """For each bar, whether the window that ends there has no hole and enough ticks in every bar."""
    w = by_time().rowsBetween(1 - win, 0)
    ok = (F.count("*").over(w) == win) & (F.min("n").over(w) >= least_n) & (F.col("open_time") - F.lag("open_time", win - 1).over(by_time()) == (win - 1) * step_ms)
    return bars.withColumn("valid", F.coalesce(ok, F.lit(False)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: str = "last") -> DataFrame:
    """Rows of both, one for each key: new wins for keep 'last', old for 'first'."""
    both = old.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    first = F.col("_p").desc() if keep == "last" else F.col("_p").asc()
    rest = [c for c in old.columns if c not in keys]
    pick = F.row_number().over(Window.partitionBy(*keys).orderBy(first, *rest))
    return both.withColumn("_n", pick).where("_n = 1").drop("_p", "_n")


def counts_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row counts of each symbol before and after, with what happened."""
    a, b = old.groupBy("symbol").agg(F.count("*").alias("before")), new.groupBy("symbol").agg(F.count("*").alias("after"))
    x = a.join(b, "symbol", "full").select("symbol", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    what = F.when(F.col("before") == 0, "added").when(F.col("after") < F.col("before"), "shrunk").when(F.col("after") > F.col("before"), "grown").otherwise("same")
    return x.withColumn("what", what)


def seams(old: DataFrame, new: DataFrame, step_ms: int) -> DataFrame:
    """For each symbol with new bars, whether the first of them follows the last old one without hole or overlap."""
    a, b = old.groupBy("symbol").agg(F.max("open_time").alias("last")), new.groupBy("symbol").agg(F.min("open_time").alias("first"))
    return b.join(a, "symbol", "left").select("symbol", "last", "first", F.coalesce(F.col("last") + step_ms == F.col("first"), F.lit(False)).alias("joined"))


def latest_window(bars: DataFrame, n: int, step_ms: int) -> DataFrame:
    """The last n bars of each symbol, made of bars of the given step where the median step is shorter; symbols with
    fewer are left out."""
    gap = F.col("open_time") - F.lag("open_time").over(by_time())
    fine = bars.withColumn("gap", gap).groupBy("symbol").agg((F.percentile("gap", F.lit(0.5)) < step_ms).alias("fine"))
    x = bars.join(F.broadcast(fine), "symbol")  # a row a symbol
    whole = coarsen(x.where("fine"), step_ms).unionByName(x.where("not coalesce(fine, false)").select("symbol", "open_time", "open", "high", "low", "close", "qv", "n"))
    w = Window.partitionBy("symbol")
    x = whole.withColumn("_n", F.row_number().over(w.orderBy(F.col("open_time").desc()))).where(F.col("_n") <= n)
    return x.withColumn("_m", F.count("*").over(w)).where(F.col("_m") == n).drop("_n", "_m")
