"""Incremental refresh: work lists, touched symbols, fingerprints, verification."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DAY = 86_400_000


def missing_days(bars: DataFrame, until_day: int, alive_days: int = 3) -> DataFrame:
    """(symbol, day) still to fetch: after the last bar, for symbols whose last bar is recent."""
    last = bars.groupBy("symbol").agg(F.max(F.expr(f"open_time div {DAY}L")).alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    live = last.crossJoin(F.broadcast(newest)).where(F.col("newest") - F.col("last") <= alive_days).where(F.col("last") < until_day)
    return live.select("symbol", F.explode(F.sequence(F.col("last") + 1, F.lit(until_day).cast("long"))).alias("day"))


def fetch_days(rows: DataFrame, days: DataFrame) -> DataFrame:
    """Rows of the listed (symbol, day) pairs."""
    return rows.withColumn("day", F.expr(f"open_time div {DAY}L")).join(days, ["symbol", "day"], "left_semi").drop("day")


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols with a row in new that old does not hold alike."""
    return new.exceptAll(old.select(new.columns)).select("symbol").distinct()


def refresh(old_result: DataFrame, rows: DataFrame, touched_symbols: DataFrame, build) -> DataFrame:
    """build(rows) for the touched symbols and the old result for all others; an emptied symbol vanishes."""
    fresh = build(rows.join(touched_symbols, "symbol", "left_semi"))
    return old_result.join(touched_symbols, "symbol", "left_anti").unionByName(fresh)


def fingerprint(rows: DataFrame, vector: str = "v", digits: int = 6) -> DataFrame:
    """sha1 prefix of the vector's rounded values written out, alike in any engine."""
    text = F.array_join(F.transform(vector, lambda x: F.round(x * 10**digits).cast("long").cast("string")), ",")
    return rows.withColumn("print", F.substring(F.sha1(text), 1, 16))


def snapshot(library: DataFrame, n: int, seed: str = "snapshot") -> DataFrame:
    """Fingerprints of n windows whose forward label is complete, chosen by hash."""
    done = library.where("fwd_ret is not null")
    order = F.md5(F.concat_ws("-", F.lit(seed), "symbol", F.col("t0").cast("string")))
    return fingerprint(done.orderBy(order, "symbol", "t0").limit(n)).select("symbol", "t0", "print")


def verify(before: DataFrame, after: DataFrame, prints: DataFrame, liquidity: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row a check, with the number of violations: before and after are libraries, prints a snapshot of before,
    liquidity the panels (sym, day, liq30, liq60) before and after, of which old rows must be the same to the bit and
    no symbol may end earlier. Libraries that are read several times here had better be stored first."""
    key = ["symbol", "t0"]
    w = Window.partitionBy("symbol").orderBy("k")
    dup = after.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("bad"))
    order = after.withColumn("p", F.lag("t0").over(w)).where("p >= t0").agg(F.count("*").alias("bad"))
    a = before.groupBy("symbol").agg(F.count("*").alias("n"))
    b = after.groupBy("symbol").agg(F.count("*").alias("m"))
    fewer = a.join(b, "symbol", "left").where(F.coalesce("m", F.lit(0)) < F.col("n")).agg(F.count("*").alias("bad"))
    lost = before.join(after, key, "left_anti").agg(F.count("*").alias("bad"))
    now = fingerprint(after).select(*key, F.col("print").alias("now"))
    moved = prints.join(now, key, "left").where(~F.equal_null("print", "now")).agg(F.count("*").alias("bad"))
    label = before.select(*key, F.col("fwd_ret").alias("old")).join(after.select(*key, F.col("fwd_ret").alias("new")), key)
    label = label.where("old is not null and not (old <=> new)").agg(F.count("*").alias("bad"))
    empty = after.where("v is null or size(v) = 0").agg(F.count("*").alias("bad"))
    holes = after.groupBy("symbol").agg(F.count("*").alias("n"), (F.max("k") - F.min("k") + 1).alias("m")).where("n != m").agg(F.count("*").alias("bad"))
    checks = [("unique", dup), ("order", order), ("blocks", holes), ("not_fewer", fewer), ("none_lost", lost), ("same_vectors", moved), ("same_labels", label), ("complete", empty)]
    if liquidity:
        old, new = liquidity
        cols = ["sym", "day", "liq30", "liq60"]
        checks.append(("old_liquidity", old.select(cols).exceptAll(new.select(cols)).agg(F.count("*").alias("bad"))))
        ends = old.groupBy("sym").agg(F.max("day").alias("a")).join(new.groupBy("sym").agg(F.max("day").alias("b")), "sym", "left")
        checks.append(("coverage", ends.where("b is null or b < a").agg(F.count("*").alias("bad"))))
    out = None
    for name, df in checks:
        one = df.select(F.lit(name).alias("check"), "bad")
        out = one if out is None else out.unionByName(one)
    return out


def replace_symbols(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the symbols in rows and no others. A symbol's partition is replaced as a whole; for
    several symbols at once, or with checks before the switch, see Stages."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("symbol").parquet(path)


class StageFailed(RuntimeError):
    pass


class Stages:
    """A refresh as named stages under a folder, each kept in numbered versions with a manifest.

    A stage is done again only if what it reads has changed, so a stopped refresh goes on where it stopped. A new
    version is written beside the old one, counted and checked, and only then named by a manifest, which appears by
    one rename; until then, and if a check fails, readers see the old version.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.done = spark, root, {}

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self, stage: str) -> dict | None:
        """The newest manifest of a stage, or none."""
        p, fs = self._fs(f"{self.root}/{stage}")
        if not fs.exists(p):
            return None
        names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))
        return json.loads(self.spark.read.text(f"{self.root}/{stage}/{names[-1]}").first()[0]) if names else None

    def read(self, stage: str) -> DataFrame:
        m = self.manifest(stage)
        if m is None:
            raise StageFailed(f"{stage} has not been done")
        return self.spark.read.parquet(f"{self.root}/{stage}/{m['version']}")

    def run(self, stage: str, source: DataFrame, build, check=None, partition: str | None = None) -> DataFrame:
        """build(source), unless the manifest tells that it was made of the same rows. check(old or None, new) returns
        a table of checks (check, bad); any bad above 0 stops the refresh with the old version in place."""
        mark = table_print(source)
        old = self.manifest(stage)
        if old and old["source"] == mark:
            self.done[stage] = "kept"
            return self.read(stage)
        version = f"v{(int(old['version'][1:]) if old else 0) + 1:06d}"
        where = f"{self.root}/{stage}/{version}"
        made = build(source).write.mode("overwrite").option("compression", "zstd")
        (made.partitionBy(partition) if partition else made).parquet(where)
        new = self.spark.read.parquet(where)
        if check is not None:
            bad = check(self.read(stage) if old else None, new).where("bad > 0").collect()  # a row a check
            if bad:
                self.done[stage] = "failed"
                raise StageFailed(f"{stage}: " + ", ".join(f"{r['check']} {r.bad}" for r in bad))
        text = json.dumps({"version": version, "source": mark, "rows": new.count(), "made": int(time.time() * 1000)})
        temp, fs = self._fs(f"{self.root}/{stage}/_{version}.tmp")
        out = fs.create(temp, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.rename(temp, self._fs(f"{self.root}/{stage}/{version}.json")[0])
        if old:
            for gone in (old["version"], f"{old['version']}.json"):
                fs.delete(self._fs(f"{self.root}/{stage}/{gone}")[0], True)
        self.done[stage] = "made"
        return new

    def stale(self, stage: str, than: str) -> bool:
        """Whether a stage was made before another one, so that it no longer tells how that one was."""
        a, b = self.manifest(stage), self.manifest(than)
        return a is None or (b is not None and a["made"] < b["made"])

    def complete(self, stage: str) -> bool:
        """Whether the stage's table holds as many rows as its manifest says."""
        m = self.manifest(stage)
        return m is not None and self.read(stage).count() == m["rows"]


def table_print(rows: DataFrame) -> str:
    """A fingerprint of a table's rows, whatever their order: their number and hashes added up."""
    cols = [F.xxhash64(*[F.col(f"`{c}`") for c in sorted(rows.columns)])]
    r = rows.select(cols[0].alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("x"), F.sum(F.pmod("h", F.lit(1_000_003))).alias("s")).first()
    return f"{','.join(sorted(rows.columns))}:{r.n}:{r.x}:{r.s}"


def each(symbols: list[str], work) -> tuple[list[str], dict[str, str]]:
    """work(symbol) for each symbol; one that fails does not stop the others. Returns those done and what failed why."""
    done, failed = [], {}
    for s in symbols:
        try:
            work(s)
            done.append(s)
        except Exception as e:  # reported, not swallowed
            failed[s] = str(e)
    return done, failed
