"""Price-spike events, limit-order simulation, fills, stop and target order, walk-forward rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tapeline.operators.joins import matched


def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_time")


def wicks(bars: DataFrame, levels: tuple[float, ...], sides: tuple[str, ...] = ("down", "up"), recover: float = 0.5, least_qv: float = 0.0, warm_up: int = 60, horizons: tuple[int, ...] = (15, 60, 240)) -> DataFrame:
    """One row for each bar, side and level that its wick reaches, measured from the close before.

    entry is the wick's extreme. Outcomes over each horizon (cut at the end of the series) are relative to entry, as
    of a purchase there (down) or a sale (up): best and worst move, move at the end; back is the end relative to the
    close before. recover is the share of the wick that the close wins back, 1 where there is none. A bar needs a bar
    after it, warm_up bars before, volume of least_qv, a positive close before and a positive extreme. Null or
    non-finite prices give no event; no rows in, no rows out.
    """
    pre = F.col("pre_close")
    b = bars.withColumn("pre_close", F.coalesce(F.lag("close").over(by_time()), F.col("open"))).withColumn("rn", F.row_number().over(by_time()) - 1)
    cols = {"next": F.lead("close").over(by_time())}
    for h in horizons:
        w = by_time().rowsBetween(1, h)
        cols |= {f"_h{h}": F.max("high").over(w), f"_l{h}": F.min("low").over(w), f"_c{h}": F.last("close").over(w)}
    b = b.withColumns(cols).where(F.col("next").isNotNull() & (F.col("rn") >= warm_up) & (F.col("qv") >= least_qv) & (pre > 0))

    def one(side: str) -> Column:
        sign = 1 if side == "down" else -1
        entry = F.col("low" if side == "down" else "high")
        depth = sign * (pre - entry)
        fields = [F.lit(side).alias("side"), entry.alias("entry"), (depth / pre).alias("dev"), F.when(depth > 0, sign * (F.col("close") - entry) / depth).otherwise(1.0).alias("recover")]
        for h in horizons:
            best, worst = (f"_h{h}", f"_l{h}") if side == "down" else (f"_l{h}", f"_h{h}")
            move = lambda c: F.try_divide(sign * (F.col(c) - entry), entry)  # noqa: B023, E731
            fields += [move(best).alias(f"mfe_{h}"), move(worst).alias(f"mae_{h}"), move(f"_c{h}").alias(f"ret_{h}"), (sign * (F.col(f"_c{h}") - pre) / pre).alias(f"back_{h}")]
        return F.struct(*fields)

    x = b.select("symbol", "open_time", "pre_close", "close", "qv", F.inline(F.array(*map(one, sides))))
    x = x.where((F.col("entry") > 0) & (F.col("entry") < float("inf")) & ~F.isnan("dev"))
    hit = F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda v: v <= F.col("dev"))
    return x.withColumn("level", F.explode(hit)).withColumn("rec_ok", F.col("recover") >= recover)


def market_wide(events: DataFrame, step_ms: int, reach: int = 2, least: int = 5, distinct: bool = False) -> DataFrame:
    """Flags events with ``least`` events (or symbols) of their side and level within ``reach`` steps either side.

    Counted by minute first, so a window sees one row for each step, side and level.
    """
    e, by = events.withColumn("slot", F.expr(f"open_time div {step_ms}L")), ["side", "level"]
    if distinct:
        near = e.select(*by, "symbol", F.explode(F.sequence(F.col("slot") - reach, F.col("slot") + reach)).alias("slot")).distinct()
        n = near.groupBy(*by, "slot").agg(F.count("*").alias("around"))
    else:
        per = e.groupBy(*by, "slot").agg(F.count("*").alias("k"))
        n = per.select(*by, "slot", F.sum("k").over(Window.partitionBy(*by).orderBy("slot").rangeBetween(-reach, reach)).alias("around"))
    return e.join(n, [*by, "slot"]).withColumn("mw", F.col("around") >= least).drop("slot")


def compare(events: DataFrame, flag: str, horizon: int) -> DataFrame:
    """By side, level and flag: number, mean (cut at 100 %) and median return, medians of best and worst move, share of gains."""
    r = F.col(f"ret_{horizon}")
    half = lambda c: F.percentile(c, F.lit(0.5))
    return events.groupBy("side", "level", flag).agg(
        F.count("*").alias("n"), F.avg(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))).alias("mean_ret"), half(r).alias("median_ret"), half(f"mfe_{horizon}").alias("median_mfe"), half(f"mae_{horizon}").alias("median_mae"), F.avg((r > 0).cast("double")).alias("gains")
    )


def limit_candidates(bars: DataFrame, depth: float, high_bars: int, hold: int) -> DataFrame:
    """Bars whose low reaches a limit under the shifted rolling high, with entry, outcome and place.

    A candidate needs hold + 1 bars after it.
    """
    shifted, ahead = by_time().rowsBetween(-high_bars, -1), by_time().rowsBetween(1, hold)
    ref = F.when(F.count("*").over(shifted) == high_bars, F.max("close").over(shifted))
    b = bars.withColumn("rn", F.row_number().over(by_time()) - 1).withColumn("len", F.count("*").over(Window.partitionBy("symbol"))).withColumn("entry", ref * (1 - depth))
    b = b.withColumns({"ret": F.try_divide(F.lead("close", hold).over(by_time()), F.col("entry")) - 1, "mfe": F.try_divide(F.max("high").over(ahead), F.col("entry")) - 1, "mae": F.try_divide(F.min("low").over(ahead), F.col("entry")) - 1})
    return b.where((F.col("high") > F.col("entry")) & (F.col("low") <= F.col("entry")) & (F.col("rn") + hold + 1 < F.col("len"))).select("symbol", "rn", F.col("open_time").alias("t0"), "entry", "ret", "mfe", "mae")


def non_overlapping(candidates: DataFrame, hold: int, by: list[str] | None = None) -> DataFrame:
    """Takes a candidate, skips all that begin within hold bars of it, and so on, for each symbol.

    Where a candidate begins hold bars or more after the one before it, the walk starts anew whatever was taken, so
    only runs of closer candidates are folded in order, each in one row.
    """
    by = by or ["symbol"]
    w = Window.partitionBy(*by).orderBy("rn")
    apart = F.coalesce((F.col("rn") - F.lag("rn").over(w) >= hold).cast("int"), F.lit(0))
    runs = candidates.withColumn("_apart", apart).withColumn("_run", F.sum("_apart").over(w)).drop("_apart")
    rest = [c for c in candidates.columns if c not in by]
    rows = runs.groupBy(*by, "_run").agg(F.sort_array(F.collect_list(F.struct("rn", *[c for c in rest if c != "rn"]))).alias("r"))
    start = F.struct(F.lit(-(2**31) + hold).cast("int").alias("last"), F.filter("r", lambda _: F.lit(False)).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        take = x["rn"] - hold >= s["last"]
        return F.struct(F.when(take, x["rn"]).otherwise(s["last"]).alias("last"), F.when(take, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    return rows.select(*by, F.inline(F.aggregate("r", start, step, lambda s: s["kept"])))


def spans(bars: DataFrame, ref_bars: int) -> DataFrame:
    """symbol, span_ms: from the first bar with ref_bars before it to the last; symbols with fewer bars are absent."""
    x = bars.withColumn("rn", F.row_number().over(by_time()) - 1)
    return x.groupBy("symbol").agg((F.max("open_time") - F.min(F.when(F.col("rn") == ref_bars, F.col("open_time")))).alias("span_ms")).where("span_ms is not null")


def trade_summary(trades: DataFrame, by: list[str], usable: DataFrame) -> DataFrame:
    """Number, mean and median return, medians of best and worst move, wins, longest losing run, and span_ms, the
    time in which trades were possible (usable: symbol, span_ms; see spans)."""
    w = Window.partitionBy(*by).orderBy("t0")
    x = trades.withColumn("g", F.sum((F.col("ret") >= 0).cast("int")).over(w))
    runs = x.groupBy(*by, "g").agg(F.count_if(F.col("ret") < 0).alias("k")).groupBy(*by).agg(F.max("k").alias("losing_run"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    s = trades.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), half("ret").alias("median_ret"), half("mfe").alias("median_mfe"), half("mae").alias("median_mae"), F.count_if(F.col("ret") > 0).alias("wins")
    )
    return s.join(runs, by).join(usable, "symbol")


def cost_ladder(summary: DataFrame, fee: float = 0.002, slip: float = 0.0025, keep: float = 1.0) -> DataFrame:
    """Mean of the symbols' means before costs, after fees, after slippage as well; trades a symbol and year; and
    the product: frequency, net expectation and the share of trades kept."""
    year = 365 * 86_400_000
    m = F.avg("mean_ret")
    rate = F.when(F.sum("span_ms") > 0, F.sum("n") / (F.sum("span_ms") / year))
    return summary.agg(m.alias("raw"), (m - fee).alias("after_fee"), (m - fee - slip).alias("after_all"), F.sum("n").alias("trades"), rate.alias("per_year"), (rate * (m - fee - slip) * keep).alias("annual"))


def tails(trades: DataFrame, by: list[str], tie: str = "t0") -> DataFrame:
    """Share of the best tenth in the total, 5 % quantile, mean of the worst twentieth, payoff ratio, skew."""
    w = Window.partitionBy(*by)
    x = trades.withColumns({"n": F.count("*").over(w), "down": F.row_number().over(w.orderBy(F.col("ret").desc(), tie)), "up": F.row_number().over(w.orderBy("ret", tie))})
    n, total = F.first("n"), F.sum("ret")
    best = F.sum(F.when(F.col("down") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), F.col("ret")))
    worst = F.avg(F.when(F.col("up") <= F.greatest(F.lit(1), F.floor(F.col("n") / 20)), F.col("ret")))
    gain, loss = F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, F.col("ret")))
    q = F.percentile("ret", F.array(*[F.lit(v) for v in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    return x.groupBy(*by).agg(
        n.alias("n"),
        F.when((total > 0) & (n >= 10), best / total).alias("tail_share"),
        F.when(n >= 20, F.get(q, F.lit(0))).alias("q05"),
        F.when(n >= 20, worst).alias("worst_mean"),
        F.try_divide(gain, F.abs(loss)).alias("payoff"),
        *(F.get(q, F.lit(i)).alias(f"p{p}") for i, p in enumerate((5, 25, 50, 75, 95))),
        F.when(F.avg("ret") > F.get(q, F.lit(2)), "right").otherwise("left").alias("skew"),
    )


def random_entries(bars: DataFrame, trades: DataFrame, hold: int, times: int, seed: str) -> DataFrame:
    """For each symbol, ``times`` as many random entries as trades, held as long: their mean return, and buy and hold."""
    b = bars.withColumn("later", F.lead("close", hold).over(by_time()))
    n = trades.groupBy("symbol").agg((F.count("*") * times).alias("k"))
    w = Window.partitionBy("symbol").orderBy(F.md5(F.concat_ws("-", F.lit(seed), "symbol", F.col("open_time").cast("string"))), "open_time")
    got = b.where("later is not null").join(n, "symbol").withColumn("i", F.row_number().over(w)).where("i <= k")
    r = got.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.try_divide(F.col("later"), F.col("close")) - 1).alias("random_ret"))
    held = bars.groupBy("symbol").agg((F.try_divide(F.max_by("close", "open_time"), F.min_by("close", "open_time")) - 1).alias("hold_ret"))
    return r.join(held, "symbol")


def near_ticks(orders: DataFrame, ticks: DataFrame, begin: Column, end: Column, span: int) -> DataFrame:
    """Orders with each tick of a positive price from begin to end (microseconds, at most span apart).

    Both meet by (symbol, bucket of span), so only ticks near an order are joined.
    """
    lo, hi = F.floor(begin / span).cast("long"), F.floor(end / span).cast("long")
    o = orders.withColumn("_b", F.explode(F.sequence(lo, hi)))
    k = ticks.where("price > 0").select("symbol", F.expr(f"us div {span}L").alias("_b"), "us", "id", "price")
    return o.join(k, ["symbol", "_b"]).where((F.col("us") >= begin) & (F.col("us") <= end)).drop("_b")


def fills(orders: DataFrame, ticks: DataFrame, before_us: int, after_us: int, least: int = 60, max_dev: float = 0.6) -> DataFrame:
    """Whether, when and at what price each order is filled: at the first tick in [t - before, t + after] at or past
    its limit, at the worse of limit and price; slippage is what that loses, as a share of the limit.

    orders: symbol, side ("down": a purchase under the price, "up": a sale above it), t, limit, dev. All orders come
    back; reason tells why one is not filled: too_far (dev above max_dev), few_ticks (under least), untouched.
    Ticks without a positive price are left out before they are counted.
    """
    buy = F.col("side") == "down"
    near = near_ticks(orders, ticks, F.col("t") - before_us, F.col("t") + after_us, before_us + after_us)
    hit = F.when(buy, F.col("price") <= F.col("limit")).otherwise(F.col("price") >= F.col("limit"))
    key = ["symbol", "side", "t", "limit"]
    got = near.groupBy(*key).agg(F.count("*").alias("seen"), F.min(F.when(hit, F.struct("us", "id", "price"))).alias("first"))
    x = orders.join(got, key, "left")
    reason = F.when(F.col("dev") > max_dev, "too_far").when(F.coalesce("seen", F.lit(0)) < least, "few_ticks").when(F.col("first").isNull(), "untouched").otherwise("")
    x = x.withColumn("reason", reason).withColumn("filled", F.col("reason") == "")
    done = lambda c: F.when(F.col("filled"), c)
    x = x.withColumn("fill", done(F.when(buy, F.least("limit", "first.price")).otherwise(F.greatest("limit", "first.price"))))
    slip = F.try_divide(F.when(buy, F.col("limit") - F.col("fill")).otherwise(F.col("fill") - F.col("limit")), F.col("limit"))
    return x.select(*orders.columns, "filled", "reason", done(F.col("first.us")).alias("fill_us"), done(F.col("first.id")).alias("fill_id"), "fill", slip.alias("slippage"))


def after_fill(fill: DataFrame, ticks: DataFrame, horizons: tuple[int, ...], after_us: int, deep: int = 60) -> DataFrame:
    """For each filled order, over its next h ticks up to t + after_us: best and worst (at most 0) move and move at
    the end, all in the order's favour; recovery_us until the price is back at pre, the one before the event; and
    deep_ticks, how many of the first ``deep`` ticks from the fill on are no better than the limit.

    fill: filled rows of fills() with pre. Fewer ticks than h: what there is; none after the fill: null moves.
    """
    buy = F.col("side") == "down"
    near = near_ticks(fill.where("filled"), ticks, F.col("fill_us"), F.col("t") + after_us, after_us)
    near = near.where((F.col("us") > F.col("fill_us")) | (F.col("id") >= F.col("fill_id")))
    key = ["symbol", "side", "t", "limit"]
    near = near.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("us", "id")) - 1)
    move = F.try_divide(F.when(buy, F.col("price") - F.col("fill")).otherwise(F.col("fill") - F.col("price")), F.col("fill"))
    cols = []
    for h in horizons:
        inside = F.col("n").between(1, h)
        worst = F.min(F.when(inside, move))
        cols += [F.max(F.when(inside, move)).alias(f"mfe_{h}"), F.when(worst.isNotNull(), F.least(F.lit(0.0), worst)).alias(f"mae_{h}"), F.max_by(F.when(inside, move), F.when(inside, F.col("n"))).alias(f"ret_{h}")]
    back = F.when(buy, F.col("price") >= F.col("pre")).otherwise(F.col("price") <= F.col("pre"))
    poor = F.when(buy, F.col("price") <= F.col("limit")).otherwise(F.col("price") >= F.col("limit"))
    cols += [(F.min(F.when(back, F.col("us"))) - F.first("fill_us")).alias("recovery_us"), F.count_if(poor & (F.col("n") < deep)).alias("deep_ticks")]
    return near.groupBy(*key).agg(*cols)


def reasons(fill: DataFrame) -> DataFrame:
    """How many orders of each side were filled, and why the others were not."""
    return fill.groupBy("side", F.when(F.col("filled"), "filled").otherwise(F.col("reason")).alias("what")).agg(F.count("*").alias("n"))


def first_touch(ticks: DataFrame, hours: DataFrame, step_us: int, stops: tuple[float, ...], targets: tuple[float, ...], least: int) -> DataFrame:
    """For each (symbol, hour) and grid cell, which of stop and target comes first; a tie is a stop.

    hours: symbol, h, open, atr. The ticks of an hour are reduced once for all cells, map-side.
    """
    t = ticks.withColumn("h", F.expr(f"us div {step_us}L")).join(hours, ["symbol", "h"])
    aggs = [F.count("*").alias("n")]
    for i, s in enumerate(stops):
        aggs.append(F.min(F.when(F.col("price") <= F.col("open") - s * F.col("atr"), F.col("us"))).alias(f"s{i}"))
    for j, g in enumerate(targets):
        for i, s in enumerate(stops):
            aggs.append(F.min(F.when(F.col("price") >= F.col("open") + s * g * F.col("atr"), F.col("us"))).alias(f"t{i}_{j}"))
    x = t.groupBy("symbol", "h").agg(*aggs).where(F.col("n") >= least)
    cells = []
    for i, s in enumerate(stops):
        for j, g in enumerate(targets):
            a, b = F.col(f"s{i}"), F.col(f"t{i}_{j}")
            kind = F.when(a.isNull() & b.isNull(), "none").when(b.isNull(), "stop").when(a.isNull(), "target").when(a <= b, "stop_first").otherwise("target_first")
            cells.append(F.struct(F.lit(s).alias("stop"), F.lit(g).alias("reward"), kind.alias("outcome")))
    return x.select("symbol", "h", F.inline(F.array(*cells)))


def ambiguity(outcomes: DataFrame) -> DataFrame:
    """Shares of the five outcomes for each cell, and expectation in stops: true, worst and best case."""
    c = lambda *k: F.avg(F.col("outcome").isin(*k).cast("double"))
    g = F.first("reward")
    both = c("stop_first", "target_first")
    return outcomes.groupBy("stop", "reward").agg(
        F.count("*").alias("n"),
        both.alias("ambiguous"),
        (g * c("target", "target_first") - c("stop", "stop_first")).alias("exp_true"),
        (g * c("target") - c("stop") - both).alias("exp_worst"),
        (g * (c("target") + both) - c("stop")).alias("exp_best"),
    )


def breadth(bars: DataFrame, drop: float = -0.02) -> DataFrame:
    """For each time: symbols that fell by more than drop, symbols that traded, their ratio (null where none did)."""
    b = bars.withColumn("ret", F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(by_time())) - 1, F.lit(0.0)))
    g = b.groupBy("open_time").agg(F.count_if(F.col("ret") < drop).alias("falling"), F.count_if(F.col("qv") > 0).alias("trading"))
    return g.withColumn("share", F.try_divide("falling", "trading"))


def pretrade(trades: DataFrame, trailing: DataFrame, crowd: DataFrame, prior: int, least: float = 0.5) -> DataFrame:
    """trades (symbol, t0) with what was known at t0: drop, vol, vol_ratio, below_ath of trailing() and the market's
    breadth and breadth_pct at that time (0 and null where nothing traded). Trades with fewer than ``prior`` bars before
    them are left out; fewer than ``least`` of the others with features is an error."""
    w = by_time()
    t = trailing.withColumn("_prior", F.row_number().over(w) - 1).select("symbol", F.col("open_time").alias("t0"), "drop", "vol", "below_ath", F.try_divide(F.col("qv"), F.col("med_qv")).alias("vol_ratio"), "_prior")
    x = matched(trades, t, ["symbol", "t0"], least).where(F.col("_prior") >= prior).drop("_prior")
    c = crowd.select(F.col("open_time").alias("t0"), F.col("falling").alias("breadth"), F.col("share").alias("breadth_pct"))
    return x.join(c, "t0", "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))


#: What rules look at: each cuts off one end, at the quantile p of the past, or 1 - p for breadth.
RULE_FEATURES = {"vol": False, "drop": False, "breadth": True, "breadth_pct": True}
#: The rules: which features a trade must pass.
RULES = {
    "calm": ("vol",),
    "deep": ("drop",),
    "together": ("breadth_pct",),
    "together_count": ("breadth",),
    "calm_deep": ("vol", "drop"),
    "all": ("vol", "drop", "breadth_pct"),
}
FEE, SLIP = 0.002, 0.0025


def thresholds(trades: DataFrame, p: float = 0.75, by: str | None = None) -> DataFrame:
    """th_<feature>: the quantile p (1 - p for breadth, linear) over all trades or for each value of ``by``."""
    aggs = [F.percentile(f, F.lit(1 - p if above else p)).alias(f"th_{f}") for f, above in RULE_FEATURES.items()]
    aggs.append(F.count("*").alias("past"))
    return trades.groupBy(by).agg(*aggs) if by else trades.agg(*aggs)


def passes(rule: str) -> Column:
    """Whether a trade (features and thresholds in one row) is kept: under the thresholds of volatility and drop, at
    or above those of breadth."""
    out = None
    for f in RULES[rule]:
        one = F.col(f) >= F.col(f"th_{f}") if RULE_FEATURES[f] else F.col(f) < F.col(f"th_{f}")
        out = one if out is None else out & one
    return F.coalesce(out, F.lit(False))


def masks(trades: DataFrame, th: DataFrame, on: Column | None = None) -> DataFrame:
    """Each trade once for each rule: rule, keep. th: one row, or a row a group with the condition that joins it."""
    x = trades.crossJoin(F.broadcast(th)) if on is None else trades.join(F.broadcast(th), on)
    return x.select("*", F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), passes(r).alias("keep")) for r in RULES])))


def control(pool: DataFrame, by: list[str], id_col: str, loss: float, reps: int, seed: str) -> DataFrame:
    """For each group of pool (id, ret, keep): the big-loss rate and net mean of ``reps`` random subsets as large as
    what is kept: medians, the best twentieth of loss rates, and the share of subsets with fewer big losses than kept.

    Subsets follow md5(seed-replicate-id), the same in any engine. Groups that keep all have no control.
    """
    n = pool.groupBy(*by).agg(F.count("*").alias("_n"), F.count_if("keep").alias("_k"), F.avg(F.when(F.col("keep"), (F.col("ret") <= loss).cast("double"))).alias("_loss"))
    n = n.where((F.col("_k") > 0) & (F.col("_k") < F.col("_n")))
    parts = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = pool.select(*by, id_col, "ret").join(n, by).repartition(parts, id_col)  # a small pool becomes reps times its rows
    x = x.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    order = F.md5(F.concat_ws("-", F.lit(seed), F.col("rep").cast("string"), F.col(id_col).cast("string")))
    # a share of the hashes that holds the _k least but for odds of about 1e-9, before anything is sorted, and 60 bits
    # of them as a number, which sorts faster than text
    share = (F.col("_k") + 6 * F.sqrt("_k") + 20) / F.col("_n")
    x = x.withColumn("_o", F.conv(F.substring(order, 1, 15), 16, 10).cast("long")).where(F.col("_o") <= share * 2.0**60)
    x = x.withColumn("_i", F.row_number().over(Window.partitionBy(*by, "rep").orderBy("_o", id_col))).where("_i <= _k")
    per = x.groupBy(*by, "rep").agg(F.avg((F.col("ret") <= loss).cast("double")).alias("bl"), F.avg(F.col("ret") - FEE - SLIP).alias("net"), F.first("_loss").alias("_loss"))
    half = lambda c, q=0.5: F.percentile(c, F.lit(q))
    return per.groupBy(*by).agg(half("bl").alias("control_loss"), half("bl", 0.05).alias("control_loss_p05"), half("net").alias("control_net"), F.avg((F.col("bl") < F.col("_loss")).cast("double")).alias("rank"))


def judged(pool: DataFrame, by: list[str], loss: float) -> DataFrame:
    """For each group of trades with keep: sizes, net means, big-loss rates and lower tails of all and of those kept."""
    bad, net, r = (F.col("ret") <= loss).cast("double"), F.col("ret") - FEE - SLIP, F.when(F.col("keep"), F.col("ret"))
    return pool.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("keep").alias("kept"),
        F.avg(net).alias("base_net"),
        F.avg(F.when(F.col("keep"), net)).alias("rule_net"),
        F.avg(bad).alias("base_loss"),
        F.avg(F.when(F.col("keep"), bad)).alias("rule_loss"),
        F.when(F.count_if("keep") >= 20, F.percentile(r, F.lit(0.05))).alias("rule_q05"),
    )


def split_eval(trades: DataFrame, last_in: int, id_col: str, loss: float, reps: int, seed: str, least: int = 200, least_kept: int = 50) -> DataFrame:
    """Every rule, its thresholds from trades up to the year last_in, on the trades after it, beside random subsets of
    the same size. A rule that keeps 99.5 % is flagged inactive. Fewer than ``least`` trades on a side: no rows."""
    inside, out = trades.where(F.col("year") <= last_in), trades.where(F.col("year") > last_in)
    th = thresholds(inside).where(F.col("past") >= least)
    pool = masks(out, th)
    x = judged(pool, ["rule"], loss).where((F.col("n") >= least) & (F.col("kept") >= least_kept))
    return x.join(control(pool, ["rule"], id_col, loss, reps, seed), "rule", "left").withColumn("inactive", F.col("kept") >= 0.995 * F.col("n"))


def walk_forward(trades: DataFrame, least_past: int, least_now: int, least_kept: int, loss: float, id_col: str, reps: int, seed: str, rule: str = "all") -> DataFrame:
    """Expanding windows: each year's thresholds from all years before, the combined rule applied to it, beside random
    subsets of the same size. Years with fewer rows, and years of which the rule keeps 99.5 %, are left out."""
    years = trades.select(F.col("year").alias("y")).distinct()
    past = trades.join(F.broadcast(years), F.col("year") < F.col("y"))  # a row a year
    th = thresholds(past, by="y").where(F.col("past") >= least_past)
    pool = trades.join(F.broadcast(th), F.col("year") == F.col("y")).withColumn("keep", passes(rule))
    return _tested(pool, ["year"], least_now, least_kept, loss, id_col, reps, seed)


def cut_grid(trades: DataFrame, cuts: tuple[int, ...], ahead: int, least_past: int, least_now: int, least_kept: int, loss: float, id_col: str, reps: int, seed: str, rule: str = "all") -> DataFrame:
    """For each cut, thresholds from the years up to it, tested on the ``ahead`` years after it: does the finding hang
    on one cut? verdict: beats (fewer big losses than the best twentieth of random subsets), better, no."""
    spark = trades.sparkSession
    cut = spark.createDataFrame([(c,) for c in cuts], "cut int")
    th = thresholds(trades.join(F.broadcast(cut), F.col("year") <= F.col("cut")), by="cut").where(F.col("past") >= least_past)
    pool = trades.join(F.broadcast(th), (F.col("year") > F.col("cut")) & (F.col("year") <= F.col("cut") + ahead)).withColumn("keep", passes(rule))
    x = _tested(pool, ["cut"], least_now, least_kept, loss, id_col, reps, seed)
    return x.withColumn("verdict", F.when(F.col("rule_loss") < F.col("control_loss_p05"), "beats").when(F.col("rule_loss") < F.col("control_loss"), "better").otherwise("no"))


def _tested(pool: DataFrame, by: list[str], least_now: int, least_kept: int, loss: float, id_col: str, reps: int, seed: str) -> DataFrame:
    x = judged(pool, by, loss).where((F.col("n") >= least_now) & (F.col("kept") >= least_kept) & (F.col("kept") < 0.995 * F.col("n")))
    return x.join(control(pool, by, id_col, loss, reps, seed), by)


def candidate_filters(trades: DataFrame, loss: float, per_year: float, least: int = 30) -> DataFrame:
    """Filters that drop one end of a feature (at the quartile of all trades), alone and combined: trades left, net
    mean, big-loss rate, lower tail, yearly return; best has the greatest yearly return, safest the fewest big losses."""
    edges = trades.agg(*[F.percentile(f, F.lit(0.75)).alias(f"e_{f}") for f in ("vol", "below", "drop", "vol_ratio", "breadth")], F.count("*").alias("_n"))
    under = lambda f: F.col(f) < F.col(f"e_{f}")
    crowd = F.col("breadth") > F.col("e_breadth")
    kinds = {"none": F.lit(True), "calm": under("vol"), "far_from_high": under("below"), "deep": under("drop"), "quiet_volume": under("vol_ratio"), "crowd": crowd, "crowd_calm": crowd & under("vol"), "calm_deep": under("vol") & under("drop")}
    x = trades.crossJoin(F.broadcast(edges)).select("ret", "_n", F.inline(F.array(*[F.struct(F.lit(k).alias("filter"), F.coalesce(c, F.lit(False)).alias("keep")) for k, c in kinds.items()]))).where("keep")
    net = F.avg(F.col("ret") - FEE - SLIP)
    g = x.groupBy("filter").agg(F.count("*").alias("n"), net.alias("net"), F.avg((F.col("ret") <= loss).cast("double")).alias("big_loss"), F.percentile("ret", F.lit(0.05)).alias("q05"), (net * per_year * F.count("*") / F.first("_n")).alias("annual")).where(F.col("n") >= least)
    w = Window.partitionBy(F.lit(1))  # a row a filter
    return g.withColumn("best", F.col("filter") == F.max_by("filter", F.struct("annual", "filter")).over(w)).withColumn("safest", F.col("filter") == F.min_by("filter", F.struct("big_loss", "filter")).over(w))


def extremes(trades: DataFrame, features: list[str], loss: float) -> DataFrame:
    """Big-loss rate in the lowest and the highest quarter of each feature."""
    out = None
    bad = (F.col("ret") <= loss).cast("double")
    edges = trades.agg(*[F.percentile(f, F.array(F.lit(0.25), F.lit(0.75))).alias(f"e_{f}") for f in features])
    x = trades.crossJoin(F.broadcast(edges))
    for f in features:
        e = F.col(f"e_{f}")
        r = x.agg(F.lit(f).alias("feature"), F.avg(F.when(F.col(f) <= F.get(e, F.lit(0)), bad)).alias("low_quarter"), F.avg(F.when(F.col(f) >= F.get(e, F.lit(1)), bad)).alias("high_quarter"))
        out = r if out is None else out.unionByName(r)
    return out
