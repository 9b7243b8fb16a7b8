"""HTTP API over a bar table and a window library: info, symbols, search, live search, search by picture."""

from __future__ import annotations

import base64
import json
import threading
import time as clock
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import arrays
from tapeline.operators import bars as B
from tapeline.operators.windows import numbered
from tapeline.session import scratch_root
from tapeline.sources import klines, screenshot

#: Bars of a window, bars shown after one, and how long a fetched series stays fresh.
WIN, AFTER, FRESH_S = 100, 96, 15.0


class BadInput(ValueError):
    pass


class Unreachable(RuntimeError):
    """The exchange could not be asked, or what it said cannot be used."""


class Service:
    """library: symbol, t0, t1, v, amp_pct, fwd_ret, and raw for the raw variant; bars for what comes after a window.

    fetch(symbol, n) returns positional rows (see klines.FIELDS) of the newest bars, the last perhaps still open, and
    the server's time in milliseconds. A search reads the library once and brings k rows to the driver. rows: the
    library's length as its manifest has it, to be held against the table.
    """

    def __init__(self, library: DataFrame, bars: DataFrame | None = None, fetch: Callable[[str, int], tuple[list[list], int]] | None = None, step_ms: int = 900_000, rows: int | None = None):
        cols = ["symbol", "t0", "t1", "v", "amp_pct", "fwd_ret", *(c for c in ("raw",) if c in library.columns)]
        finite = {c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ("amp_pct", "fwd_ret")}  # JSON has no other numbers
        self.library = numbered(library.select(cols).withColumns(finite), ["symbol", "t0"]).cache()
        if rows is not None and self.library.count() != rows:
            raise ValueError(f"the library holds {self.library.count()} windows, its manifest says {rows}")
        self.bars, self.fetch, self.step = bars, fetch, step_ms
        self.recent: dict[str, tuple[float, list[dict], int]] = {}
        self.lock = threading.Lock()

    @property
    def spark(self):
        return self.library.sparkSession

    def info(self) -> dict:
        return self.library.agg(F.count("*").alias("rows"), F.countDistinct("symbol").alias("symbols"), F.min("t0").alias("first"), F.max("t1").alias("last")).first().asDict()

    def coins(self) -> list[dict]:
        return [r.asDict() for r in self.library.groupBy("symbol").agg(F.count("*").alias("windows"), F.min("t0").alias("first"), F.max("t1").alias("last")).orderBy("symbol").collect()]

    def pick(self, symbol: str | None = None, time: int | None = None, idx: int | None = None, random: str | None = None, amp: tuple[float, float] = (2.0, 60.0), after: int | None = None) -> tuple[DataFrame, str]:
        """One window and a note: by number; by hash of ``random`` among those of an amplitude within amp and begun
        at or after ``after``; of the symbol, the one that covers the time, else the nearest start; without a time the
        latest."""
        if idx is not None:
            return self.library.where(F.col("idx") == idx), ""
        if random is not None:
            rows = self.library.where(F.col("amp_pct").between(*amp) & (F.col("t0") >= (after or 0)))
            order = F.md5(F.concat_ws("-", F.lit(random), F.col("idx").cast("string")))
            return rows.orderBy(order, "idx").limit(1), "random"
        rows = self.library.where(F.col("symbol") == symbol) if symbol else self.library
        if time is None:
            return rows.orderBy(F.col("t1").desc(), "symbol").limit(1), "latest"
        covers = F.when((F.col("t0") <= time) & (F.col("t1") >= time), 0).otherwise(1)
        found = rows.orderBy(covers, F.abs(F.col("t0") - time), "t0", "symbol").limit(1)
        one = found.select(covers.alias("c")).first()
        return found, "" if one is None or one.c == 0 else "no window covers that time: the nearest one"

    def nearest(self, q: dict, topk: int, pool: int, variant: str, contemp: bool) -> list[dict]:
        """The pool nearest windows to a vector, less those of its own time (of itself only: contemp), topk at most."""
        column = "raw" if variant == "raw" else "v"
        if column not in self.library.columns:
            raise BadInput("this library has no raw vectors")
        vector = F.array(*[F.lit(float(x)) for x in q["v"]])
        # one query: its k best are kept by each task before anything moves, whatever k is
        near = self.library.withColumn("dist", arrays.squared_l2(F.col(column), vector, len(q["v"]))).drop("v", "raw").orderBy("dist", "symbol", "t0").limit(pool)
        own = (F.col("symbol") == q["symbol"]) & (F.col("t0") == q["t0"])
        overlap = (F.col("t0") <= q["t1"]) & (F.col("t1") >= q["t0"])
        got = near.where(~(own if contemp else overlap)).orderBy("dist", "symbol", "t0").limit(topk).collect()
        return [{"rank": k, **r.asDict()} for k, r in enumerate(got, 1)]

    def following(self, found: list[dict]) -> None:
        """Adds to each window the closes of up to AFTER bars after it."""
        if self.bars is None or not found:
            return
        ends = self.spark.createDataFrame([(r["symbol"], r["t1"]) for r in found], "symbol string, t1 long").distinct()
        near = self.bars.join(F.broadcast(ends), "symbol").where((F.col("open_time") > F.col("t1")) & (F.col("open_time") <= F.col("t1") + AFTER * self.step))
        per = near.groupBy("symbol", "t1").agg(F.sort_array(F.collect_list(F.struct("open_time", "close"))).alias("x"))
        closes = {(r.symbol, r.t1): [p.close for p in r.x] for r in per.collect()}  # AFTER prices for each of topk
        for r in found:
            r["after"] = closes.get((r["symbol"], r["t1"]), [])

    def search(self, symbol: str | None = None, time: int | None = None, topk: int = 24, contemp: bool = False, variant: str = "shape", pool: int | None = None, show_after: bool = False, **how) -> dict:
        topk = max(1, min(120, topk))
        window, note = self.pick(symbol, time, **how)
        one = window.first()
        if one is None:
            raise BadInput(f"no window for {symbol or how}")
        q = one.asDict()
        q["v"] = q["raw"] if variant == "raw" and "raw" in q else q["v"]
        found = self.nearest(q, topk, pool or max(600, 20 * topk), variant, contemp)
        if show_after:
            self.following(found)
        return {"query": {k: q[k] for k in ("idx", "symbol", "t0", "t1", "amp_pct", "fwd_ret")}, "results": found, "variant": variant, "note": note}

    def newest(self, symbol: str) -> tuple[list[dict], int, bool]:
        """The newest WIN closed bars of a symbol, the server's time, and whether they were still fresh."""
        with self.lock:
            held = self.recent.get(symbol)
        if held and clock.monotonic() - held[0] < FRESH_S:
            return held[1], held[2], True
        if self.fetch is None:
            raise Unreachable("no source of live bars is set up")
        try:
            raw, now = self.fetch(symbol, WIN + 2)
        except Exception as e:
            raise Unreachable(f"{symbol} could not be fetched: {e}") from e
        rows = self.spark.createDataFrame([(symbol, json.dumps([[str(x) for x in r] for r in raw]))], "symbol string, js string")
        parsed = klines.parse_json(rows, "js", ["symbol"])
        got = [r.asDict() for r in klines.closed_only(parsed, now, WIN, whole=True).orderBy("open_time").collect()]  # WIN rows
        if len(got) < WIN:
            raise Unreachable(f"{symbol}: fewer than {WIN} closed bars")
        with self.lock:
            if len(self.recent) > 64:
                self.recent.clear()
            self.recent[symbol] = (clock.monotonic(), got, now)
        return got, now, False

    def vector(self, close: list[float], qv: list[float], variant: str) -> list[float]:
        """The vector of an outside window, by the expression that builds the library."""
        make = arrays.raw_vector if variant == "raw" else arrays.shape_vector
        row = self.spark.createDataFrame([(close, qv)], "close array<double>, qv array<double>")
        return row.select(make(F.col("close"), F.col("qv"), len(close)).alias("v")).first().v

    def live(self, symbol: str, topk: int = 24, contemp: bool = False, variant: str = "shape", pool: int | None = None, show_after: bool = False) -> dict:
        topk, symbol = max(1, min(120, topk)), symbol.upper().strip()
        got, now, cached = self.newest(symbol)
        table = self.spark.createDataFrame([(symbol, r["open_time"], r["open"], r["high"], r["low"], r["close"], r["quote_volume"], 1) for r in got], "symbol string, open_time long, open double, high double, low double, close double, qv double, n long")
        issues = [f"{r.open_time}: {r.issues}" for r in B.live_issues(table, self.step).collect()]
        q = {"symbol": symbol, "t0": got[0]["open_time"], "t1": got[-1]["open_time"], "v": self.vector([r["close"] for r in got], [max(r["quote_volume"] or 0.0, 0.0) for r in got], variant)}
        found = self.nearest(q, topk, pool or max(600, 20 * topk), variant, contemp)
        if show_after:
            self.following(found)
        amp = (max(r["high"] for r in got) / min(r["low"] for r in got) - 1) * 100
        swing = sum((r["high"] - r["low"]) / r["close"] for r in got) / len(got) * 100
        shown = [[round(r["open"], 10), round(r["high"], 10), round(r["low"], 10), round(r["close"], 10), round(r["quote_volume"], 2)] for r in got]
        return {
            "query": {"idx": -1, "symbol": symbol, "t0": q["t0"], "t1": q["t1"], "amp_pct": round(amp, 2), "vol_pct": round(swing, 3), "fwd_ret": None, "bars": shown},
            "results": found,
            "variant": variant,
            "note": "; ".join(issues),
            "live": {"server_now": now, "last_closed": got[-1]["close_time"], "lag_s": round((now - got[-1]["close_time"]) / 1000, 1), "cached": cached},
        }

    def shot(self, body: dict) -> dict:
        """Search by a picture of a chart: image (base64, perhaps as a data URL), box (plot area), top and bottom
        (prices at its edges), log, topk. Candles are read off it; its time is unknown, so nothing is left out."""
        try:
            content = base64.b64decode(str(body["image"]).rpartition(",")[2], validate=True)
            box = tuple(int(x) for x in body["box"]) if body.get("box") else None
            top, bottom, topk = float(body["top"]), float(body["bottom"]), max(1, min(120, int(body.get("topk", 24))))
        except (KeyError, TypeError, ValueError) as e:
            raise BadInput(f"picture or calibration cannot be read: {e}") from e
        sc, where = self.spark.sparkContext, f"{scratch_root(self.spark)}/shot-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{where}/shot.png")
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        out = fs.create(path, True)
        out.write(bytearray(content))
        out.close()
        try:
            x = self.spark.read.format("image").option("dropInvalid", "true").load(where).select("image.*").where("nChannels >= 3").first()
            if x is None:
                raise BadInput("the picture cannot be decoded")
            rgb = np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.nChannels)[..., 2::-1]
            try:
                c = screenshot.candles(rgb, 0, self.step, top, bottom, bool(body.get("log")), box=box, least=10)
            except ValueError as e:
                raise BadInput(str(e)) from e
        finally:
            fs.delete(path.getParent(), True)
        q = {"symbol": "", "t0": 1, "t1": 0, "v": self.vector(c["close"].tolist(), [1.0] * len(c), "shape")[:32]}
        near = self.library.withColumn("dist", arrays.squared_l2(F.col("v"), F.array(*[F.lit(float(v)) for v in q["v"]]), 32)).drop("v", "raw").orderBy("dist", "symbol", "t0").limit(topk)
        return {"candles": len(c), "bars": c[["open", "high", "low", "close"]].round(10).values.tolist(), "results": [{"rank": k, **r.asDict()} for k, r in enumerate(near.collect(), 1)]}

    def answer(self, url: str, body: bytes | None = None) -> tuple[int, object]:
        """Status and body: 400 for bad input, 404 for an unknown path, 502 for a live source that fails, 500 for
        anything else. body: that of a POST."""
        parts = urlsplit(url)
        args = {k: v[-1] for k, v in parse_qs(parts.query).items()}
        try:
            if body is not None:
                if parts.path != "/api/shot":
                    return 404, {"error": "unknown path"}
                try:
                    said = json.loads(body)
                except ValueError as e:
                    raise BadInput(str(e)) from e
                return 200, self.shot(said if isinstance(said, dict) else {})
            if parts.path == "/":
                return 200, {"paths": ["/api/info", "/api/coins", "/api/search", "/api/live", "/api/shot"]}
            if parts.path == "/api/info":
                return 200, self.info()
            if parts.path == "/api/coins":
                return 200, self.coins()
            if parts.path in ("/api/search", "/api/live"):
                how = self.options(args)
                if parts.path == "/api/live":
                    return 200, self.live(args.get("symbol", "BTCUSDT"), **how)
                return 200, self.search(**how, **self.wanted(args))
            return 404, {"error": "unknown path"}
        except BadInput as e:
            return 400, {"error": str(e)}
        except Unreachable as e:
            return 502, {"error": str(e), "hint": "the exchange cannot be reached from here, or has no such symbol"}
        except Exception as e:
            return 500, {"error": str(e)}

    @staticmethod
    def options(args: dict[str, str]) -> dict:
        yes = lambda k: args.get(k, "0") in ("1", "true", "yes")
        try:
            pool = int(args["pool_k"]) if "pool_k" in args else None
            out = {"topk": int(args.get("topk", 24)), "pool": pool, "contemp": yes("contemp"), "show_after": yes("after")}
        except ValueError as e:
            raise BadInput(str(e)) from e
        return {**out, "variant": "raw" if args.get("variant") == "raw" else "shape"}

    @staticmethod
    def wanted(args: dict[str, str]) -> dict:
        """Which window: idx, else random, else latest, else symbol with or without time (milliseconds or UTC text)."""
        try:
            if "idx" in args:
                return {"idx": int(args["idx"])}
            if "random" in args:
                return {"random": args["random"], "amp": (float(args.get("amp_min", 2.0)), float(args.get("amp_max", 60.0)))}
            if "latest" in args:
                return {"symbol": args["latest"]}
            said = args.get("time")
            if not said:
                return {"symbol": args.get("symbol")}
            at = int(said) if said.lstrip("-").isdigit() else int(datetime.fromisoformat(said).replace(tzinfo=UTC).timestamp() * 1000)
            return {"symbol": args.get("symbol"), "time": at}
        except ValueError as e:
            raise BadInput(str(e)) from e


def serve(library: DataFrame, host: str = "127.0.0.1", port: int = 8765, **how) -> ThreadingHTTPServer:
    service = Service(library, **how)

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self.reply(*service.answer(self.path))

        def do_POST(self) -> None:
            self.reply(*service.answer(self.path, self.rfile.read(int(self.headers.get("Content-Length", 0)))))

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)

