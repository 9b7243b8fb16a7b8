"""Exact nearest neighbours by squared L2 with temporal exclusion.

The query side is a stated set: as many as may be broadcast are sent to the executors, more are searched in blocks.
The library is read once a block, distances stay in generated code, and each task keeps its k best before anything
is shuffled.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions import arrays
from tapeline.session import scratch_root

#: Queries that may be broadcast: 64 doubles each, about 50 MB.
QUERIES = 100_000


def checked(queries: DataFrame) -> DataFrame:
    """queries for a broadcast join; more than QUERIES go through in_blocks."""
    if queries.limit(QUERIES + 1).count() > QUERIES:
        raise ValueError(f"more than {QUERIES} queries: search them with in_blocks")
    return F.broadcast(queries)


def in_blocks(queries: DataFrame, key: list[str], search) -> DataFrame:
    """search(block) for blocks of at most about QUERIES queries, their results together.

    search returns some rows for each query of its block alone, so blocks need not know of each other; few queries
    are one block. Blocks follow a hash of the key, 10 % below the limit on average.
    """
    n = queries.count()
    blocks = 1 if n <= QUERIES else -(-10 * n // (9 * QUERIES)) + 1
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*key), F.lit(blocks)) == b)
        got = search(part)
        out = got if out is None else out.unionByName(got)
    return out


def distances(queries: DataFrame, library: DataFrame, dim: int = 64, first: int = 0, amp_weight: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """Every query against every library row: q_* and c_* columns (of c_* only those named in keep) and dist."""
    q = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    c = library.select(*(F.col(x).alias(f"c_{x}") for x in library.columns))
    d = arrays.squared_l2(F.col("q_v"), F.col("c_v"), dim, first)
    if amp_weight:
        d = d + amp_weight * (F.col("c_amp_z") - F.col("q_amp_z")) * (F.col("c_amp_z") - F.col("q_amp_z"))
    pairs = c.crossJoin(checked(q)).withColumn("dist", d)  # a bounded query set against all rows
    # vectors are not sent on with the pairs
    return pairs.drop("q_v", "c_v") if keep is None else pairs.select(*(x for x in q.columns if x != "q_v"), *(f"c_{x}" for x in keep), "dist")


def top(pairs: DataFrame, k: int, by: list[str], ties: list[str], out: str = "rank", order: str = "dist") -> DataFrame:
    """The k nearest of each query; ties by the given columns, those without a distance last.

    Each task keeps its k best before the shuffle; Spark does so up to a limit that is raised to k here.
    """
    spark, name = pairs.sparkSession, "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(name, "1000")) < k:
        spark.conf.set(name, str(k))
    w = Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last(), *ties)
    return pairs.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def overlaps() -> Column:
    """The candidate's time meets the query's, whatever the symbol."""
    return (F.col("c_t0") <= F.col("q_t1")) & (F.col("c_t1") >= F.col("q_t0"))


def isolated(gap: int) -> Column:
    """The candidate ends before the query begins, or begins a gap after it ends."""
    return (F.col("c_t1") <= F.col("q_t0")) | (F.col("c_t0") >= F.col("q_t1") + gap)


def shares_half() -> Column:
    """Same symbol, and more than half the query's span in common."""
    common = F.least("c_t1", "q_t1") - F.greatest("c_t0", "q_t0")
    return (F.col("c_symbol") == F.col("q_symbol")) & (common > (F.col("q_t1") - F.col("q_t0")) * 0.5)


def search(queries: DataFrame, library: DataFrame, k: int, pool: int, by: list[str], ties: list[str], exclude: Column | None = None, **how) -> DataFrame:
    """The pool nearest of each query, then those not excluded, then the k nearest of these: fewer may be left."""
    found = top(distances(queries, library, **how), pool, by, ties, "_pool")
    if exclude is not None:
        found = found.where(~exclude)
    return top(found, k, by, ties).drop("_pool")


def greedy(found: DataFrame, keep: int, by: list[str]) -> DataFrame:
    """Walks each query's candidates by rank and keeps those that share at most half their span with one kept.

    found holds at most a pool of candidates for each query, so a query's candidates fit one row.
    """
    item = F.struct("rank", F.col("c_symbol").alias("symbol"), F.col("c_t0").alias("t0"), F.col("c_t1").alias("t1"), "dist")
    rows = found.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("r"))

    def clash(a: Column, b: Column) -> Column:
        common = F.least(a["t1"], b["t1"]) - F.greatest(a["t0"], b["t0"])
        return (a["symbol"] == b["symbol"]) & (common > (b["t1"] - b["t0"]) * 0.5)

    def step(kept: Column, x: Column) -> Column:
        take = (F.size(kept) < keep) & ~F.exists(kept, lambda y: clash(y, x))
        return F.when(take, F.concat(kept, F.array(x))).otherwise(kept)

    none = F.filter("r", lambda _: F.lit(False))
    return rows.select(*by, F.explode(F.aggregate("r", none, step)).alias("x")).select(*by, F.col("x.rank").alias("rank"), F.col("x.symbol").alias("c_symbol"), F.col("x.t0").alias("c_t0"), F.col("x.dist").alias("dist"))


def sample(rows: DataFrame, n: int, seed: str, by: list[str], key: Column) -> DataFrame:
    """n rows of each group in the order of md5(seed-key): the same in any engine."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("-", F.lit(seed), key.cast("string"))), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def similarity(dist: Column, scale: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.sqrt(dist) / scale))


def separated(rows: DataFrame, gap: int, seed: str) -> DataFrame:
    """(symbol, t0): walks each symbol's windows in hash order and keeps those at least ``gap`` from every one kept.

    In rounds: a window that comes first in hash order among all undecided ones less than gap away is kept, and these
    are dropped; that is what the walk does. About log n rounds over frames of a symbol's windows; what is undecided is
    stored between rounds in the shared folder.
    """
    spark, where = rows.sparkSession, f"{scratch_root(rows.sparkSession)}/separated-{uuid.uuid4().hex}"
    order = F.md5(F.concat_ws("-", F.lit(seed), "symbol", F.col("t0").cast("string")))
    left = rows.select("symbol", "t0", F.struct(order.alias("o"), F.col("t0").alias("t")).alias("o")).distinct()
    near = Window.partitionBy("symbol").orderBy("t0").rangeBetween(1 - gap, gap - 1)
    kept, n = None, 0
    while True:
        marked = left.withColumn("first", F.col("o") == F.min("o").over(near))
        marked = marked.withColumn("beside", F.max(F.col("first").cast("int")).over(near))
        marked.write.parquet(f"{where}/{n}")
        marked = spark.read.schema(marked.schema).parquet(f"{where}/{n}")
        got = marked.where("first").select("symbol", "t0")
        kept = got if kept is None else kept.unionByName(got)
        left, n = marked.where("beside = 0").select("symbol", "t0", "o"), n + 1
        if left.limit(1).count() == 0:
            return kept


def channels(queries: DataFrame, library: DataFrame, near: int, seed: str, pool: int = 8) -> DataFrame:
    """Four candidates for each query, one a channel, none twice: nearest by shape, nearest by raw vector, a random
    one of like amplitude and time, a random one. place (1 to 4) is their shuffled order.

    Each channel is a search of its own that brings its first ``pool`` offers; one whose offers are all taken yields
    nothing.
    """
    by, ties = ["q_symbol", "q_t0"], ["c_symbol", "c_t0"]
    cols = ["symbol", "t0", "t1", "amp_pct"]
    h = F.md5(F.concat_ws("-", F.lit(seed), "q_symbol", F.col("q_t0").cast("string"), "c_symbol", F.col("c_t0").cast("string")))
    like = (F.abs(F.col("q_t0") - F.col("c_t0")) <= near) & F.col("c_amp_pct").between(F.col("q_amp_pct") * 0.5, F.col("q_amp_pct") * 2)
    shape, raw = (distances(*(x.select(*cols, F.col(v).alias("v")) for x in (queries, library))).where(~overlaps()) for v in ("v", "raw"))
    q, c = queries.select(*(F.col(x).alias(f"q_{x}") for x in cols)), library.select(*(F.col(x).alias(f"c_{x}") for x in cols))
    pairs = c.crossJoin(checked(q)).where(~overlaps()).withColumn("h", h).withColumn("back", F.reverse("h"))
    offers = None
    for i, (x, order) in enumerate(((shape, "dist"), (raw, "dist"), (pairs.where(like), "h"), (pairs, "back"))):
        got = top(x.select(*by, *ties, order), pool, by, ties, "r", order).select(*by, F.lit(i).alias("i"), "r", F.struct(*ties).alias("c"))
        offers = got if offers is None else offers.unionByName(got)
    lists = [F.sort_array(F.collect_list(F.when(F.col("i") == i, F.struct("r", "c")))) for i in range(4)]  # pool rows each
    packed = offers.groupBy(*by).agg(*(x.alias(f"l{i}") for i, x in enumerate(lists)))
    picks: list[Column] = []
    for i in range(4):
        taken = F.array_compact(F.array(*picks)) if picks else None
        free = F.filter(f"l{i}", lambda x: x["r"] > 0) if taken is None else F.filter(f"l{i}", _free(taken))
        picks.append(F.get(free, F.lit(0))["c"])
    names = ("shape", "raw", "regime", "random")
    rows = packed.select(*by, F.inline(F.array(*[F.struct(F.lit(n).alias("channel"), p.alias("c")) for n, p in zip(names, picks, strict=True)]))).where("c is not null")
    order = F.md5(F.concat_ws("-", F.lit(seed), "q_symbol", F.col("q_t0").cast("string"), "channel"))
    return rows.select(*by, "channel", "c.c_symbol", "c.c_t0", F.row_number().over(Window.partitionBy(*by).orderBy(order)).alias("place"))


def context_random(queries: DataFrame, pool: DataFrame, seed: str, days: tuple[int, ...] = (45, 120, 365), least: int = 5, dim: int = 64) -> DataFrame:
    """For each query a random window of the pool in a like market, but of another shape: begun within 45 days, else
    120, of it with a like net move and range of the market (net_atr, atr_pct), else within 365 days, else any time;
    the first of these steps that leaves ``least`` windows. Of them the nearer three fifths by shape are left out.

    Both sides: symbol, t0, t1, v, net_atr, atr_pct; the pool is a stated sample. step counts from 1; a query with too
    few windows in the last step has none.
    """
    by = ["q_symbol", "q_t0"]
    pairs = distances(queries, pool, dim, keep=["symbol", "t0", "t1", "net_atr", "atr_pct"]).where(~shares_half())
    like = (F.abs(F.col("c_net_atr") - F.col("q_net_atr")) <= 0.6) & (F.col("c_atr_pct") / F.greatest("q_atr_pct", F.lit(1e-12))).between(0.6000000001, 1.5999999999)
    apart = F.abs(F.col("q_t0") - F.col("c_t0"))
    steps = [(apart <= d * 86_400_000) & (F.coalesce(like, F.lit(False)) if i < 2 else F.lit(True)) for i, d in enumerate(days)] + [F.lit(True)]
    first = None  # the first step that takes the window; later ones take it too, but for the market
    flags = F.array(*steps)
    counts = pairs.groupBy(*by).agg(*[F.count_if(c).alias(f"n{i}") for i, c in enumerate(steps)])
    for i in range(len(steps)):
        one = F.col(f"n{i}") >= least
        first = F.when(one, i + 1) if first is None else first.when(one, i + 1)
    counts = counts.select(*by, first.alias("step")).where("step is not null")
    x = pairs.withColumn("_f", flags).join(F.broadcast(counts), by).where(F.get("_f", F.col("step") - 1))  # a row a query
    far = x.groupBy(*by).agg(F.percentile("dist", F.lit(0.6)).alias("_d"))
    h = F.md5(F.concat_ws("-", F.lit(seed), "q_symbol", F.col("q_t0").cast("string"), "c_symbol", F.col("c_t0").cast("string")))
    x = x.join(F.broadcast(far), by).where("dist > _d")
    return x.groupBy(*by, "step").agg(F.min_by(F.struct("c_symbol", "c_t0"), h).alias("c")).select(*by, "step", "c.c_symbol", "c.c_t0")


def tally(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """How often each channel was picked: answers hold q_symbol, q_t0 and the place picked."""
    picked = candidates.join(answers.select("q_symbol", "q_t0", F.col("pick").alias("place")), ["q_symbol", "q_t0", "place"])
    return picked.groupBy("channel").agg(F.count("*").alias("n"))


def _free(taken: Column):
    return lambda x: ~F.array_contains(taken, x["c"])


def with_norm(library: DataFrame, vector: str = "v") -> DataFrame:
    """The library with norm2, the squared length of each row's vector, kept in the row itself."""
    return library.withColumn("norm2", F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def stale_norms(library: DataFrame, vector: str = "v") -> DataFrame:
    """Rows whose stored norm2 is missing or is not that of their vector."""
    now = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x)
    return library.where(~F.equal_null(F.round("norm2", 9), F.round(now, 9)))
