"""Candle archives: zipped and plain CSV, positional JSON, listings, symbol lists."""

from __future__ import annotations

import io
import warnings
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The positional fields of an archive row; the twelfth is ignored.
FIELDS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")
LONGS = ("open_time", "close_time", "trades")
SCHEMA = ", ".join(f"{c} {'long' if c in LONGS else 'double'}" for c in FIELDS)
#: Times above this are microseconds.
MICROS = 10**14


def to_millis(t: Column, micros: Column) -> Column:
    return F.when(micros, F.expr("0L") + F.floor(t / 1000).cast("long")).otherwise(t)


def typed(raw: DataFrame, cells: Column, keep: list[str] | None = None) -> DataFrame:
    """Rows from an array of strings: coerced fields, without rows that lack open_time or close, in milliseconds.

    Times of a row whose open_time is above MICROS are microseconds; an archive has one unit, so this is its rule.
    """
    keep = keep or []
    cols = [F.get(cells, F.lit(i)).try_cast("double").cast("long").alias(c) if c in LONGS else F.get(cells, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate(FIELDS)]
    rows = raw.where(F.size(cells) >= len(FIELDS)).select(*keep, *cols).where("open_time is not null and close is not null")
    micros = F.col("open_time") > MICROS
    return rows.withColumns({c: to_millis(F.col(c), micros) for c in ("open_time", "close_time")})


def parse_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """CSV lines (column ``value``); a header line does not begin with a digit and is dropped."""
    return typed(lines.where(F.col("value").rlike(r"^\d")), F.split("value", ","), keep)


def parse_json(rows: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """Arrays of positional arrays in a JSON string column."""
    got = rows.select(*(keep or []), F.explode(F.from_json(column, "array<array<string>>")).alias("cells"))
    return typed(got, F.col("cells"), keep)


def closed_only(klines: DataFrame, server_now: int, n: int, whole: bool = False) -> DataFrame:
    """The newest n bars of each symbol whose close_time has passed; whole: none of a symbol with fewer."""
    w = Window.partitionBy("symbol")
    x = klines.where(F.col("close_time") < server_now).withColumn("_n", F.row_number().over(w.orderBy(F.col("open_time").desc())))
    x = x.where(F.col("_n") <= n)
    return (x.withColumn("_m", F.count("*").over(w)).where(F.col("_m") == n).drop("_m") if whole else x).drop("_n")


def zip_lines(content: bytes) -> list[str]:
    """The lines of an archive's first CSV file; of an archive without one, none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
        return z.read(name).decode("utf-8", "replace").splitlines() if name else []


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """Archives under path, unpacked a file a task row, their lines parsed as plain CSV is: symbol, month, the rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame({"path": name, "value": zip_lines(content)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).where("length > 0").select("path", "content")
    rows = parse_lines(files.mapInPandas(unpack, "path string, value string"), ["path"])
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(F.substring_index(name, "-", 1).alias("symbol"), month_of(name).alias("month"), *FIELDS)


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Every file under a folder that holds no byte, in order; listed by the driver, since scans leave such files out."""
    sc = spark.sparkContext
    root = sc._jvm.org.apache.hadoop.fs.Path(path)
    files, found = root.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(root, True), []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            found.append(f.getPath().toString())
    return sorted(found)


def symbols_in(spark: SparkSession, path: str) -> DataFrame:
    """symbol, in order: the names of the Parquet files in a folder, or its symbol=... partitions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path")
    part, name = F.regexp_extract("path", r"symbol=([^/]+)/", 1), F.regexp_extract("path", r"([^/]+)\.parquet$", 1)
    return files.select(F.when(part != "", part).otherwise(name).alias("symbol")).distinct().orderBy("symbol")


def download(spark: SparkSession, plan: DataFrame, fetch: Callable[[str, str], bytes | None], least_bytes: int = 200) -> DataFrame:
    """plan (symbol, month) with what fetch(symbol, month) brings: the parsed rows of each archive. No archive (none,
    or fewer bytes than least_bytes) is skipped. Tasks fetch; partition the plan for as many fetches at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for symbol, month in zip(b["symbol"], b["month"], strict=True):
                content = fetch(symbol, month)
                if content is not None and len(content) >= least_bytes:
                    yield pd.DataFrame({"symbol": symbol, "month": month, "value": zip_lines(content)})

    lines = plan.select("symbol", "month").mapInPandas(run, "symbol string, month string, value string")
    return parse_lines(lines, ["symbol", "month"])


def newest_archive(keys: DataFrame, today: int, back: int = 8) -> DataFrame:
    """symbol, key, day: of keys (symbol, key, with a date in the key) the newest of the last ``back`` days to today
    (days since 1970)."""
    day = F.datediff(F.regexp_extract("key", r"(\d{4}-\d{2}-\d{2})\.zip$", 1).try_cast("date"), F.lit("1970-01-01").cast("date"))
    x = keys.withColumn("day", day).where((F.col("day") <= today) & (F.col("day") > today - back))
    return x.groupBy("symbol").agg(F.max_by("key", F.struct("day", "key")).alias("key"), F.max("day").alias("day"))


def read_query(spark: SparkSession, path: str, n: int = 100, step_ms: int = 900_000) -> DataFrame:
    """The last n bars of a CSV of open_time, open, high, low, close and volume, named after the file; finer bars are
    made coarser first. Fails where a column is missing or bars are too few."""
    from tapeline.operators.bars import latest_window

    raw = spark.read.option("header", "true").csv(path)
    want = ("open_time", "open", "high", "low", "close", "volume")
    missing = [c for c in want if c not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1)
    rows = raw.select(name.alias("symbol"), F.col("open_time").try_cast("double").cast("long").alias("open_time"), *(F.col(c).try_cast("double").alias(c) for c in want[1:5]), F.col("volume").try_cast("double").alias("qv"), F.lit(1).cast("long").alias("n"))
    out = latest_window(rows.where("open_time is not null and close is not null"), n, step_ms)
    if out.limit(1).count() == 0:
        raise ValueError(f"{path} holds fewer than {n} bars")
    return out


def month_of(key: Column) -> Column:
    """'2024-05' from an archive's key, or null."""
    return F.nullif(F.regexp_extract(key, r"(\d{4}-\d{2})(?:-\d{2})?\.zip$", 1), F.lit(""))


def leveraged(symbol: Column) -> Column:
    """Suffixes of leveraged tokens."""
    out = None
    for s in ("UPUSDT", "DOWNUSDT", "BULLUSDT", "BEARUSDT"):
        out = symbol.endswith(s) if out is None else out | symbol.endswith(s)
    return out


def parse_listing(xml: str) -> tuple[list[tuple[str, int]], list[str], str | None]:
    """Keys with sizes, common prefixes and the next marker of one page of a bucket listing."""
    root = ElementTree.fromstring(xml)
    tag = lambda e: e.tag.rpartition("}")[2]
    keys, prefixes, cut, marker = [], [], False, None
    for e in root:
        kids = {tag(k): (k.text or "") for k in e}
        if tag(e) == "Contents":
            keys.append((kids["Key"], int(kids.get("Size", 0))))
        elif tag(e) == "CommonPrefixes":
            prefixes.append(kids["Prefix"])
        elif tag(e) == "IsTruncated":
            cut = (e.text or "").lower() == "true"
        elif tag(e) == "NextMarker":
            marker = e.text
    return keys, prefixes, (marker or (keys[-1][0] if keys else None)) if cut else None


def list_bucket(fetch, prefix: str, max_pages: int = 1000) -> Iterator[tuple[str, int]]:
    """All keys under a prefix; fetch(prefix, marker) returns one page of XML. Fails where max_pages hold only a part."""
    marker: str | None = ""
    for _ in range(max_pages):
        keys, _, marker = parse_listing(fetch(prefix, marker))
        yield from keys
        if not marker:
            return
    raise ValueError(f"{prefix} has more than {max_pages} pages")


def symbol_list(spark: SparkSession, spec: str, known: DataFrame) -> DataFrame:
    """Symbols of a spec: 'all', 'A,B,C', or '@file' with # comments; upper-cased, only known ones."""
    if spec == "all":
        return known.select("symbol").distinct()
    if spec.startswith("@"):
        said = spark.read.text(spec[1:]).select(F.upper(F.trim(F.substring_index("value", "#", 1))).alias("symbol"))
    else:
        said = spark.range(1).select(F.explode(F.split(F.lit(spec), ",")).alias("s")).select(F.upper(F.trim("s")).alias("symbol"))
    said, have = said.where("symbol != ''").distinct(), known.select("symbol").distinct()
    unknown = [r.symbol for r in said.join(have, "symbol", "left_anti").limit(20).collect()]
    if unknown:
        warnings.warn(f"unknown symbols are left out: {', '.join(sorted(unknown))}", stacklevel=2)
    return said.join(have, "symbol", "left_semi")
