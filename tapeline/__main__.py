"""Command line: bars and libraries from archives, audits, searches, the HTTP service."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.operators import bars, incremental, universe, windows
from tapeline.session import session
from tapeline.sources import klines
from tapeline.sources.reports import write_report


def _panel(b: DataFrame) -> DataFrame:
    day = F.expr("open_time div 86400000")
    return b.groupBy(F.col("symbol").alias("sym"), day.alias("day")).agg(F.sum("qv").alias("dvol"), F.max_by("close", "open_time").alias("close"))


def refresh(spark: SparkSession, old_bars: str, new_bars: str, root: str, stage: str = "all", horizon: int = 96) -> dict[str, str]:
    """The stages of a refresh under root; what each did. One that fails its checks stops those after it."""
    s = incremental.Stages(spark, root)
    key = ["symbol", "open_time"]

    def no_fewer(old: DataFrame | None, new: DataFrame) -> DataFrame:
        twice = new.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("bad")).select(F.lit("unique").alias("check"), "bad")
        if old is None:
            return twice
        lost = old.select(key).join(new.select(key), key, "left_anti").agg(F.count("*").alias("bad")).select(F.lit("none_lost").alias("check"), "bad")
        return twice.unionByName(lost)

    def same(old: DataFrame | None, new: DataFrame) -> DataFrame:
        before = new if old is None else old
        return incremental.verify(before, new, incremental.snapshot(before, 4000))

    if stage in ("merge", "all"):
        old, new = spark.read.parquet(old_bars), spark.read.parquet(new_bars)
        both = old.withColumn("_new", F.lit(0)).unionByName(new.select(old.columns).withColumn("_new", F.lit(1)))
        s.run("merge", both, lambda x: bars.upsert(x.where("_new = 0").drop("_new"), x.where("_new = 1").drop("_new"), key), no_fewer, "symbol")
    if stage in ("liquidity", "all"):
        s.run("liquidity", s.read("merge"), lambda x: universe.rolling_liquidity(universe.calendar(_panel(x))))
    if stage in ("index", "all"):
        s.run("index", s.read("merge"), lambda x: windows.library(x, 100, 5, horizon), same, "symbol")
    return s.done


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tapeline")
    sub = p.add_subparsers(dest="do", required=True)
    a = sub.add_parser("derive", help="bars of a longer step from zipped archives")
    a.add_argument("archives")
    a.add_argument("out")
    a.add_argument("--minutes", type=int, default=15)
    a = sub.add_parser("index", help="window library from bars")
    a.add_argument("bars")
    a.add_argument("out")
    a.add_argument("--horizon", type=int, default=96)
    for name in ("audit", "info", "serve", "list", "verify"):
        sub.add_parser(name).add_argument("path")
    a = sub.add_parser("universe", help="symbols to follow: dead ones up to a third, then living ones")
    a.add_argument("bars")
    a.add_argument("--least-days", type=int, default=180)
    a.add_argument("--want", type=int, default=200)
    a = sub.add_parser("plan", help="days still to fetch, up to a day (days since 1970)")
    a.add_argument("bars")
    a.add_argument("until", type=int)
    a = sub.add_parser("refresh", help="merge new bars, then index: stages that are done again only if what they read has changed")
    a.add_argument("bars")
    a.add_argument("new")
    a.add_argument("root")
    a.add_argument("--stage", choices=["merge", "liquidity", "index", "all"], default="all")
    a.add_argument("--horizon", type=int, default=96)
    a = sub.add_parser("report", help="a table as csv, json or md")
    a.add_argument("path")
    a.add_argument("out")
    a.add_argument("--kind", choices=["csv", "json", "md"], default="md")
    a = sub.add_parser("query", help="nearest windows")
    a.add_argument("path")
    a.add_argument("--symbol")
    a.add_argument("--time", type=int)
    a.add_argument("--topk", type=int, default=24)
    args = p.parse_args(argv)
    spark = session()
    if args.do == "derive":
        k = klines.read_zips(spark, args.archives).withColumnsRenamed({"quote_volume": "qv"}).withColumn("n", F.lit(1).cast("long"))
        bars.coarsen(k, args.minutes * 60_000).write.mode("overwrite").option("compression", "zstd").partitionBy("symbol").parquet(args.out)
    elif args.do == "index":
        windows.library(spark.read.parquet(args.bars), 100, 5, args.horizon).write.mode("overwrite").option("compression", "zstd").partitionBy("symbol").parquet(args.out)
    elif args.do == "list":
        klines.symbols_in(spark, args.path).show(10_000, truncate=False)
    elif args.do == "verify":
        b = spark.read.parquet(args.path)
        bars.sanity(b).join(bars.audit(b).select("symbol", "expected", "missing_pct", "gaps"), "symbol").orderBy("symbol").show(10_000, truncate=False)
    elif args.do == "universe":
        spans = universe.visible(_panel(spark.read.parquet(args.bars)))
        universe.build(spans, args.least_days, args.want).orderBy("state", "n").show(args.want, truncate=False)
    elif args.do == "plan":
        incremental.missing_days(spark.read.parquet(args.bars), args.until).orderBy("symbol", "day").show(100_000, truncate=False)
    elif args.do == "refresh":
        refresh(spark, args.bars, args.new, args.root, args.stage, args.horizon)
    elif args.do == "report":
        write_report(spark.read.parquet(args.path), args.out, args.kind)
    elif args.do == "audit":
        bars.audit(spark.read.parquet(args.path)).orderBy("symbol").show(10_000, truncate=False)
    else:
        from tapeline.api import Service, serve

        library = spark.read.parquet(args.path)
        if args.do == "info":
            print(Service(library).info())
        elif args.do == "query":
            print(Service(library).search(args.symbol, args.time, args.topk))
        else:
            serve(library).serve_forever()


if __name__ == "__main__":
    main()
