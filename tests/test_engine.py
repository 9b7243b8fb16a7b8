"""Invariants, controls and parsers that SQL does not cover."""

import io
import random
import zipfile

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tapeline.functions import arrays
from tapeline.operators import bars, events, incremental, joins, knn, windows
from tapeline.sources import fixtures, klines
from tapeline.streaming.closed_bars import upsert_batches

SF = f"{DATA}/sf0.001"


def test_entry_and_catalogue_load():
    import __spark_entry__ as e

    assert callable(e.entry) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_finds_neighbours(spark):
    import __spark_entry__ as e

    out = e.entry(spark).toPandas()
    assert 0 < len(out) <= 24 and out["dist"].is_monotonic_increasing


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
def test_asof_in_buckets_equals_brute_force(spark, same, direction, strict):
    rng = random.Random(5)
    left = [("hot" if rng.random() < 0.8 else rng.choice("ab"), rng.randrange(-50, 400), k) for k in range(300)] + [("alone", 7, 300)]
    right = [(rng.choice(["hot", "a"]), rng.randrange(-30, 380), float(rng.randrange(5))) for _ in range(60)] + [("b", 90, 1.0), ("b", 90, 2.0)]
    expected = []
    for symbol, t, k in left:
        if direction == "backward":
            found = max(((u, v) for s, u, v in right if s == symbol and (u < t if strict else u <= t)), default=(None, None))
        else:
            found = min(((u, v) for s, u, v in right if s == symbol and (u > t if strict else u >= t)), default=(None, None))
        expected.append((symbol, t, k, *found))
    a = spark.createDataFrame(left, "symbol string, t long, id long")
    b = spark.createDataFrame(right, "symbol string, t long, close double")
    truth = spark.createDataFrame(expected, "symbol string, t long, id long, match_t long, close double").toPandas()
    for width in (1, 20, 1000):
        same(joins.asof(a, b, "close", direction, strict, width).toPandas(), truth)
    assert joins.asof(a.limit(0), b, "close", direction, strict).count() == 0
    assert joins.asof(a, b.limit(0), "close", direction, strict).where("match_t is null").count() == len(left)


def test_chunked_windows_equal_unchunked(spark, same):
    b = fixtures.bars(spark, SF)
    a = windows.library(b, 100, 5, 10).select("symbol", "t0", "t1", F.round("amp_pct", 6).alias("a"), F.round("fwd_ret", 6).alias("f")).toPandas()
    w = windows.windows(b, 100, 5, 10, chunk=110)
    last = F.get("close", F.lit(99))
    c = w.select("symbol", "t0", "t1", F.round((F.array_max("high") / F.array_min("low") - 1) * 100, 6).alias("a"), F.round(F.when(F.size("f_close") == 10, F.get("f_close", F.lit(9)) / last - 1), 6).alias("f")).toPandas()
    same(a, c)


def test_build_equals_query_vector(spark):
    """A library window fed back as an outside query has the same vector and finds itself at distance 0."""
    w = windows.windows(fixtures.bars(spark, SF), 100, 5)
    one = w.limit(3).select("symbol", "t0", "close", "qv").toPandas()
    outside = spark.createDataFrame([(r.symbol, r.t0, [float(x) for x in r.close], [float(x) for x in r.qv]) for r in one.itertuples()], "symbol string, t0 long, close array<double>, qv array<double>")
    make = arrays.shape_vector(F.col("close"), F.col("qv"), 100).alias("v")
    lib = windows.library(fixtures.bars(spark, SF), 100, 5).select("symbol", "t0", "t1", "v")
    q = outside.select("symbol", "t0", make)
    top = knn.top(knn.distances(q, lib), 1, ["q_symbol", "q_t0"], ["c_symbol", "c_t0"]).collect()
    assert len(top) == 3 and all(r.dist == 0 and r.c_t0 == r.q_t0 for r in top)


def test_atr_does_not_depend_on_chunks(spark, same):
    b = fixtures.bars(spark, SF)
    a, c = (bars.atr(b, chunk=k).select("symbol", "open_time", F.round("atr", 6).alias("atr")).toPandas() for k in (1024, 600))
    same(a, c)


def test_asof_directions(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "symbol string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 9, 2.0), ("a", 10, 3.0)], "symbol string, t long, x double")
    get = lambda **k: {(r.symbol, r.t): r.x for r in joins.asof(left, right, "x", **k).collect()}
    assert get() == {("a", 5): 1.0, ("a", 10): 3.0, ("b", 1): None}
    assert get(strict=True) == {("a", 5): None, ("a", 10): 2.0, ("b", 1): None}
    assert get(direction="forward") == {("a", 5): 1.0, ("a", 10): 3.0, ("b", 1): None}
    assert get(direction="forward", strict=True) == {("a", 5): 2.0, ("a", 10): None, ("b", 1): None}


def test_matched_refuses_low_match_rates(spark):
    left, right = spark.range(10).toDF("k"), spark.range(3).toDF("k")
    with pytest.raises(ValueError, match="30.0%"):
        joins.matched(left, right, ["k"])
    assert joins.matched(left, right, ["k"], least=0.2).count() == 10


def test_positive_and_random_control(spark):
    """A window with a little noise finds its source first; the ticks being noise, others are far away."""
    lib = windows.library(fixtures.bars(spark, SF), 100, 5).select("symbol", "t0", "t1", "v")
    noisy = lib.withColumn("v", F.transform("v", lambda x, i: x + F.sin(i * 7.0) * 0.05))
    top = knn.top(knn.distances(noisy, lib), 2, ["q_symbol", "q_t0"], ["c_symbol", "c_t0"]).collect()
    first = [r for r in top if r.rank == 1]
    assert all((r.c_symbol, r.c_t0) == (r.q_symbol, r.q_t0) for r in first)
    assert max(r.dist for r in first) < min(r.dist for r in top if r.rank == 2)


def test_greedy_trades_against_a_loop(spark):
    rnd = random.Random(3)
    rns = sorted(rnd.sample(range(500), 120))
    c = spark.createDataFrame([("s", r, float(r)) for r in rns], "symbol string, rn int, ret double")
    want, last = [], -(10**9)
    for r in rns:
        if r - last >= 7:
            want.append(r)
            last = r
    assert sorted(x.rn for x in events.non_overlapping(c, 7).collect()) == want


def test_separated_rounds_equal_one_walk(spark):
    import hashlib

    rnd = random.Random(6)
    times = {s: sorted(rnd.sample(range(2000), n)) for s, n in (("a", 300), ("b", 40), ("c", 1))}
    df = spark.createDataFrame([(s, t) for s, ts in times.items() for t in ts], "symbol string, t0 long")
    want = set()
    for s, ts in times.items():
        kept = []
        for t in sorted(ts, key=lambda t: hashlib.md5(f"sep-{s}-{t}".encode()).hexdigest()):  # noqa: B023
            if all(abs(t - k) >= 25 for k in kept):
                kept.append(t)
        want |= {(s, t) for t in kept}
    assert {(r.symbol, r.t0) for r in knn.separated(df, 25, "sep").collect()} == want
    assert knn.separated(df.limit(0), 25, "sep").count() == 0


def test_archive_round_trip(spark, tmp_path):
    rows = ["open_time,open,high,low,close,volume,close_time,qv,n,tb,tq,ignore"] + [f"{1735689600000000 + i * 60000000},1,2,0.5,1.5,10,{1735689659999999 + i * 60000000},15,3,4,6,0" for i in range(3)] + ["bad,row", "1735689780000000,1,2,0.5,,10,1,15,3,4,6,0"]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a.csv", "\n".join(rows))
    (tmp_path / "BTCUSDT-1m-2025-01.zip").write_bytes(buf.getvalue())
    (tmp_path / "EMPTY-1m-2025-01.zip").write_bytes(b"")
    got = klines.read_zips(spark, str(tmp_path)).orderBy("open_time").collect()
    assert [(r.symbol, r.month, r.open_time, r.close_time, r.trades) for r in got] == [("BTCUSDT", "2025-01", 1735689600000 + i * 60000, 1735689659999 + i * 60000, 3) for i in range(3)]
    lines = spark.createDataFrame([(r,) for r in rows], "value string")
    assert [r.open_time for r in klines.parse_lines(lines).orderBy("open_time").collect()] == [r.open_time for r in got]


def test_listing_pages():
    page = '<R xmlns="x"><IsTruncated>{}</IsTruncated><Contents><Key>{}</Key><Size>5</Size></Contents><CommonPrefixes><Prefix>p/</Prefix></CommonPrefixes></R>'
    pages = {"": page.format("true", "a"), "a": page.format("false", "b")}
    assert list(klines.list_bucket(lambda prefix, marker: pages[marker], "p")) == [("a", 5), ("b", 5)]


def test_symbol_lists(spark, tmp_path):
    known = spark.createDataFrame([("AAA",), ("BBB",), ("CCC",)], "symbol string")
    f = tmp_path / "list.txt"
    f.write_text("aaa # first\n\n# none\nzzz\nccc\n")
    names = lambda s: sorted(r.symbol for r in klines.symbol_list(spark, s, known).collect())
    assert names("all") == ["AAA", "BBB", "CCC"] and names(" bbb,zzz") == ["BBB"] and names(f"@{f}") == ["AAA", "CCC"]


def test_closed_only(spark):
    k = spark.createDataFrame([("a", i * 10, i * 10 + 9) for i in range(5)], "symbol string, open_time long, close_time long")
    assert sorted(r.open_time for r in klines.closed_only(k, 45, 2).collect()) == [20, 30]


def test_foreach_batch_is_idempotent(spark, tmp_path):
    path = str(tmp_path)
    merge = lambda old, new: bars.upsert(old, new, ["symbol", "open_time"])
    put = upsert_batches(path, merge)
    a = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0)], "symbol string, open_time long, close double")
    b = spark.createDataFrame([("a", 2, 5.0), ("a", 3, 1.0)], "symbol string, open_time long, close double")
    put(a, 0)
    put(b, 1)
    put(b, 1)
    put(spark.createDataFrame([("b", 9, 2.0)], a.schema), 2)
    got = spark.read.parquet(f"{path}/table").collect()
    assert sorted((r.symbol, r.open_time, r.close) for r in got) == [("a", 1, 1.0), ("a", 2, 5.0), ("a", 3, 1.0), ("b", 9, 2.0)]


def test_emptied_symbol_vanishes(spark):
    b = fixtures.bars(spark, SF)
    n = lambda x: x.groupBy("symbol").agg(F.count("*").alias("n"))
    rest = b.where("symbol != 'view'")
    changed = incremental.touched(rest, b).unionByName(incremental.touched(b, rest)).distinct()
    out = {r.symbol for r in incremental.refresh(n(b), rest, changed, n).collect()}
    assert "view" not in out and "click" in out


def test_partition_overwrite_touches_no_other_symbol(spark, tmp_path):
    path = str(tmp_path / "t")
    incremental.replace_symbols(spark, spark.createDataFrame([("a", 1), ("b", 1)], "symbol string, x int"), path)
    incremental.replace_symbols(spark, spark.createDataFrame([("a", 2)], "symbol string, x int"), path)
    assert sorted((r.symbol, r.x) for r in spark.read.parquet(path).collect()) == [("a", 2), ("b", 1)]


def test_query_sets_are_checked(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 5)
    with pytest.raises(ValueError, match="blocks"):
        knn.checked(spark.range(6))


def test_resample_is_linear_interpolation(spark):
    x = np.random.default_rng(0).normal(size=100)
    v = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(arrays.resample(F.col("x"), 100, 32)).first()[0]
    assert np.allclose(v, np.interp(np.linspace(0, 99, 32), np.arange(100), x))


def test_separated_windows_keep_their_distance(spark):
    from tapeline.plans.catalogue import QUERIES

    got = QUERIES["separated_sample"](spark, f"{DATA}/sf0.01").toPandas()
    assert len(got) and all(np.diff(sorted(g.t0)).min(initial=10**18) >= 40 * 3_600_000 for _, g in got.groupby("symbol"))


def test_blind_candidates_are_distinct(spark):
    from tapeline.plans.catalogue import QUERIES

    got = QUERIES["blind_candidates"](spark, f"{DATA}/sf0.01").toPandas()
    for _, g in got.groupby(["q_symbol", "q_t0"]):
        assert not g.duplicated(["c_symbol", "c_t0"]).any() and sorted(g.place) == list(range(1, len(g) + 1)) and {"shape", "raw", "random"} <= set(g.channel)


@pytest.mark.parametrize("log", [False, True])
def test_chart_round_trip(log):
    from tapeline.sources.screenshot import candles

    rnd = np.random.default_rng(7)
    img = np.zeros((480, 60 * 16, 3), np.uint8)
    top, bottom = 200.0, 100.0
    want = []
    row = lambda p: int(round((np.log(top / p) / np.log(top / bottom) if log else (top - p) / (top - bottom)) * 479))
    for k in range(60):
        o, c = rnd.uniform(120, 180, 2)
        h, low = max(o, c) + rnd.uniform(0, 15), min(o, c) - rnd.uniform(0, 15)
        colour = (0, 200, 80) if c >= o else (220, 30, 30)
        img[row(h) : row(low) + 1, k * 16 + 6 : k * 16 + 7] = colour
        img[row(max(o, c)) : row(min(o, c)) + 1, k * 16 + 2 : k * 16 + 12] = colour
        want.append((o, h, low, c))
    got = candles(img, 0, 900_000, top, bottom, log)
    assert len(got) == 60 and np.abs(got[["open", "high", "low", "close"]].to_numpy() - np.array(want)).max() < 0.6


@pytest.fixture(scope="module")
def service(spark):
    from tapeline.api import Service

    b = fixtures.bars(spark, f"{DATA}/sf0.01")
    raw = windows.library(b, 100, 5, 24, "raw").select("symbol", "t0", F.col("v").alias("raw"))
    step = 3_600_000
    series = [[1_700_000_000_000 // step * step + k * step, 10 + k % 7, 12 + k % 7, 9 + k % 5, 10.5 + (k * 3) % 7, 1, 1_700_000_000_000 // step * step + (k + 1) * step - 1, 100 + k, 5, 1, 1, 0] for k in range(102)]

    def fetch(symbol, n):
        if symbol == "GONE":
            raise OSError("refused")
        rows = series[:50] if symbol == "NEW" else series[:n]
        return rows, series[-1][0] + 5  # the last bar is still open

    return Service(windows.library(b, 100, 5, 24).join(raw, ["symbol", "t0"]), b, fetch, step)


def test_service_answers(service):
    s = service
    status, info = s.answer("/api/info")
    assert status == 200 and info["symbols"] == 5 and len(s.coins()) == 5
    status, got = s.answer("/api/search?symbol=click&topk=5&after=1")
    q = got["query"]
    assert status == 200 and len(got["results"]) == 5 and all(r["t0"] > q["t1"] or r["t1"] < q["t0"] for r in got["results"])
    assert all(len(r["after"]) <= 96 for r in got["results"]) and got["note"] == "latest"
    assert [r["rank"] for r in got["results"]] == [1, 2, 3, 4, 5] and all(x["dist"] <= y["dist"] for x, y in zip(got["results"], got["results"][1:], strict=False))
    for bad in ("symbol=none", "topk=x", "idx=x", "time=nonsense&symbol=click", "random=1&amp_min=1e9&amp_max=2e9"):
        assert s.answer(f"/api/search?{bad}")[0] == 400
    assert s.answer("/x")[0] == 404 and s.answer("/")[0] == 200


def test_service_picks_windows(service):
    total = service.info()["rows"]
    got = [service.answer(f"/api/search?idx={i}&topk=1")[1]["query"] for i in (0, total - 1)]
    assert [q["idx"] for q in got] == [0, total - 1] and got[0]["symbol"] < got[1]["symbol"]
    a, b = (service.answer("/api/search?random=seed&amp_min=0&amp_max=1e7&topk=1")[1]["query"] for _ in range(2))
    assert a == b
    raw = service.answer("/api/search?idx=0&variant=raw&topk=3&contemp=1")[1]
    assert raw["variant"] == "raw" and len(raw["results"]) == 3 and all(r["idx"] != 0 for r in raw["results"])
    q = service.answer("/api/search?idx=7&topk=1")[1]["query"]
    text = __import__("datetime").datetime.fromtimestamp(q["t0"] / 1000, __import__("datetime").UTC).strftime("%Y-%m-%d %H:%M")
    assert service.answer(f"/api/search?symbol={q['symbol']}&time={text.replace(' ', '%20')}&topk=1")[1]["query"]["t0"] <= q["t0"]
    assert len(service.answer("/api/search?idx=0&topk=120&pool_k=2000")[1]["results"]) == 120


def test_live_search(service):
    status, got = service.answer("/api/live?symbol=btcusdt&topk=3")
    assert status == 200 and len(got["results"]) == 3 and len(got["query"]["bars"]) == 100 and got["query"]["fwd_ret"] is None
    assert not got["live"]["cached"] and service.answer("/api/live?symbol=btcusdt&topk=3")[1]["live"]["cached"]
    assert got["query"]["t1"] == got["query"]["t0"] + 99 * 3_600_000  # the open bar is not among them
    assert service.answer("/api/live?symbol=GONE")[0] == 502 and service.answer("/api/live?symbol=NEW")[0] == 502


def png(img):
    import struct
    import zlib

    rows = b"".join(b"\0" + r.tobytes() for r in img)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_search_by_picture(service):
    import base64
    import json

    img = np.zeros((200, 40 * 8 + 20, 3), np.uint8)
    for k in range(40):
        img[90 - k : 110 - k, 20 + k * 8 + 1 : 20 + k * 8 + 6] = (0, 200, 80)
    ask = {"image": "data:image/png;base64," + base64.b64encode(png(img)).decode(), "box": [20, 0, 340, 200], "top": 200.0, "bottom": 100.0, "topk": 3}
    status, got = service.answer("/api/shot", json.dumps(ask).encode())
    assert status == 200 and got["candles"] == 40 and len(got["results"]) == 3
    assert service.answer("/api/shot", json.dumps({**ask, "box": [20, 0, 60, 200]}).encode())[0] == 400
    assert service.answer("/api/shot", b"{")[0] == 400 and service.answer("/api/shot", json.dumps({**ask, "image": "x y"}).encode())[0] == 400
    assert service.answer("/api/other", b"{}")[0] == 404


def test_charts_are_read_from_a_folder(spark, tmp_path):
    from tapeline.sources.screenshot import candles, read_charts

    img = np.zeros((100, 20 * 6, 3), np.uint8)
    for k in range(20):
        img[40 - k : 60 - k, k * 6 + 1 : k * 6 + 5] = (0, 200, 80) if k % 2 else (220, 30, 30)
    (tmp_path / "a.png").write_bytes(png(img))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = read_charts(spark, str(tmp_path), 0, 60_000, 200.0, 100.0).orderBy("open_time").toPandas()
    want = candles(img, 0, 60_000, 200.0, 100.0)
    assert np.allclose(got[["open_time", "open", "high", "low", "close"]], want[["open_time", "open", "high", "low", "close"]])
    with pytest.raises(ValueError, match="20 candles"):
        candles(img, 0, 60_000, 200.0, 100.0, least=21)


def test_a_library_of_another_length_is_refused(spark):
    from tapeline.api import Service

    lib = windows.library(fixtures.bars(spark, SF), 100, 5, 24)
    Service(lib, rows=lib.count())
    with pytest.raises(ValueError, match="manifest"):
        Service(lib, rows=1)


def test_norms_that_do_not_fit_are_found(spark):
    lib = knn.with_norm(windows.library(fixtures.bars(spark, SF), 100, 5, 24))
    assert knn.stale_norms(lib).count() == 0
    assert knn.stale_norms(lib.withColumn("norm2", F.when(F.col("k") == 0, 1.0).otherwise(F.col("norm2")))).count() == lib.where("k = 0").count()


# events, by hand


def bar_rows(spark, rows):
    return spark.createDataFrame([("s", i * 60_000, *map(float, r)) for i, r in enumerate(rows)], "symbol string, open_time long, open double, high double, low double, close double, qv double")


def test_wicks_on_both_sides_by_hand(spark):
    """Bar 2 falls from 100 to 80 and closes at 95; bar 4 rises from 100 to 130 and closes at 104."""
    b = bar_rows(spark, [(100, 101, 99, 100, 9), (100, 101, 99, 100, 9), (100, 100, 80, 95, 9), (95, 105, 90, 100, 9), (100, 130, 100, 104, 9), (104, 110, 91, 117, 9)])
    got = {(r.side, r.open_time // 60_000): r for r in events.wicks(b, (0.15,), recover=0.5, warm_up=1, horizons=(1, 2)).collect()}
    assert set(got) == {("down", 2), ("up", 4)}
    d, u = got["down", 2], got["up", 4]
    assert d.entry == 80 and abs(d.dev - 0.2) < 1e-12 and abs(d.recover - 0.75) < 1e-12 and d.rec_ok
    assert abs(d.mfe_1 - (105 - 80) / 80) < 1e-12 and abs(d.mae_1 - (90 - 80) / 80) < 1e-12 and abs(d.ret_1 - (100 - 80) / 80) < 1e-12 and d.back_1 == 0
    assert abs(d.mfe_2 - (130 - 80) / 80) < 1e-12 and abs(d.back_2 - 0.04) < 1e-12
    assert u.entry == 130 and abs(u.dev - 0.3) < 1e-12 and abs(u.recover - 26 / 30) < 1e-12
    for h in (1, 2):  # the series ends after one bar
        assert abs(u[f"mfe_{h}"] - (130 - 91) / 130) < 1e-12 and abs(u[f"mae_{h}"] - (130 - 110) / 130) < 1e-12 and abs(u[f"ret_{h}"] - (130 - 117) / 130) < 1e-12
        assert abs(u[f"back_{h}"] - (100 - 117) / 100) < 1e-12


def test_wicks_odd_bars(spark):
    b = bar_rows(spark, [(100, 101, 99, 100, 9), (100, 101, 0, 100, 9), (100, 101, 99, float("nan"), 9), (100, 101, 50, 100, 9), (0, 1, 0, 0, 9), (5, 9, 1, 2, 9), (2, 2, 1, 1, 9)])
    got = [(r.side, r.open_time // 60_000) for r in events.wicks(b, (0.3,), warm_up=0, horizons=(1,)).collect()]
    assert ("down", 1) not in got and all(t not in (3, 5) for _, t in got)
    assert events.wicks(b.limit(0), (0.3,)).count() == 0


def test_fills_by_hand(spark):
    """A purchase at 90 against a price of 100 before: touched at 88, so filled there; a sale at 110, filled at 112."""
    us = 1_000_000
    ticks = [(1, 100), (2, 95), (3, 0), (4, 88), (5, 89), (6, 91), (7, 85), (8, 101), (9, 112), (10, 108), (11, 115), (12, 99)]
    t = spark.createDataFrame([("s", s * us, s, float(p)) for s, p in ticks], "symbol string, us long, id long, price double")
    orders = [("s", "down", 2 * us, 90.0, 0.1, 100.0), ("s", "up", 6 * us, 110.0, 0.1, 100.0), ("s", "down", 2 * us, 50.0, 0.5, 100.0), ("s", "down", 2 * us, 20.0, 0.8, 100.0), ("q", "down", 2 * us, 90.0, 0.1, 100.0)]
    o = spark.createDataFrame(orders, "symbol string, side string, t long, limit double, dev double, pre double")
    f = events.fills(o, t, 1 * us, 10 * us, least=3)
    got = {(r.symbol, r.side, r.limit): r for r in f.collect()}
    buy, sell = got["s", "down", 90.0], got["s", "up", 110.0]
    assert (buy.fill_us, buy.fill) == (4 * us, 88.0) and abs(buy.slippage - 2 / 90) < 1e-12
    assert (sell.fill_us, sell.fill) == (9 * us, 112.0) and abs(sell.slippage - 2 / 110) < 1e-12
    assert {k: r.reason for k, r in got.items() if not r.filled} == {("s", "down", 50.0): "untouched", ("s", "down", 20.0): "too_far", ("q", "down", 90.0): "few_ticks"}
    after = {r.side: r for r in events.after_fill(f, t, (2, 60), 10 * us, deep=3).collect()}
    b, s = after["down"], after["up"]
    assert abs(b.mfe_2 - (91 - 88) / 88) < 1e-12 and b.mae_2 == 0 and abs(b.ret_2 - 3 / 88) < 1e-12
    assert abs(b.mfe_60 - (115 - 88) / 88) < 1e-12 and abs(b.mae_60 + 3 / 88) < 1e-12 and abs(b.ret_60 - (99 - 88) / 88) < 1e-12
    assert b.recovery_us == 4 * us and b.deep_ticks == 2  # 88 and 89 of 88, 89, 91
    assert abs(s.mfe_2 - (112 - 108) / 112) < 1e-12 and abs(s.mae_2 - (112 - 115) / 112) < 1e-12 and s.recovery_us == 3 * us and s.deep_ticks == 2


def test_block_bootstrap_draws_anywhere_and_cuts_at_the_end(spark):
    from tapeline.operators import evaluation

    rnd = np.random.default_rng(3)
    a, b = rnd.normal(0, 1, 23), rnd.normal(0.5, 1, 23)
    p = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "g int, a double, b double")
    starts = [int(__import__("hashlib").md5(f"z-{r}-{j}".encode()).hexdigest()[:8], 16) % 23 for r in range(50) for j in range(3)]
    sharpe = lambda x: x.mean() / x.std() * 52**0.5
    diffs, means = [], []
    for r in range(50):
        at = np.concatenate([np.arange(s, min(s + 10, 23)) for s in starts[3 * r : 3 * r + 3]])
        diffs.append(sharpe(b[at]) - sharpe(a[at]))
        means.append((b - a)[at].mean())
    got = evaluation.block_bootstrap(p, "g", 50, 10, "z", 52.0).first()
    assert abs(got["diff"] - (sharpe(b) - sharpe(a))) < 1e-9 and abs(got.se - np.std(diffs)) < 1e-9
    assert abs(got.p - 2 * min(np.mean(np.array(diffs) <= 0), np.mean(np.array(diffs) >= 0))) < 1e-9
    got = evaluation.bootstrap_mean(p, "g", 50, 10, "z").first()
    assert abs(got["mean"] - (b - a).mean()) < 1e-9 and abs(got.se - np.std(means)) < 1e-9


def test_volume_block_of_zero_volume(spark):
    """A bar without volume gives ln(1e-9), not less; blocks exist though the median is 0."""
    w = [(i, float(10 + np.sin(i))) for i in range(100)]
    df = spark.createDataFrame([([c for _, c in w], [c + 1 for _, c in w], [c - 1 for _, c in w], [0.0] * 60 + [1.0] * 40, [0.0 if i == 0 else 5.0 for i in range(100)])], "c array<double>, h array<double>, l array<double>, z array<double>, q array<double>")
    r = df.select(*(arrays.block_vectors(F.col("c"), F.col("h"), F.col("l"), F.col("c"), F.col(v), 100).alias(v) for v in ("z", "q"))).first()
    assert abs(r.q.vol[0] - np.log(1e-9)) < 1e-6 and abs(r.q.vol[7]) < 1e-6
    assert abs(r.z.vol[0] - np.log(1e-9)) < 1e-6 and abs(r.z.vol[7] - np.log(1e12)) < 1e-6


def test_blocks_of_queries_equal_one_search(spark, same, monkeypatch):
    lib = windows.library(fixtures.bars(spark, SF), 100, 5, 10).select("symbol", "t0", "t1", "v").cache()
    by, ties = ["q_symbol", "q_t0"], ["c_symbol", "c_t0"]
    find = lambda part: knn.search(part, lib, 3, 20, by, ties, knn.overlaps()).select(*by, *ties, "dist", "rank")
    whole = knn.in_blocks(lib, ["symbol", "t0"], find).toPandas()
    monkeypatch.setattr(knn, "QUERIES", 40)
    assert lib.count() > 40
    same(knn.in_blocks(lib, ["symbol", "t0"], find).toPandas(), whole)


def test_many_neighbours_are_cut_before_the_shuffle(spark):
    lib = windows.library(fixtures.bars(spark, SF), 100, 5, 10).select("symbol", "t0", "t1", "v")
    got = knn.top(knn.distances(lib.limit(1), lib), 2400, ["q_symbol", "q_t0"], ["c_symbol", "c_t0"])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()


def test_staged_refresh(spark, tmp_path):
    """Stages are kept while their source is the same; a failed check leaves the old version; manifests count rows."""
    root = str(tmp_path)
    one = spark.createDataFrame([("a", 1), ("b", 2)], "symbol string, x int")
    two = one.unionByName(spark.createDataFrame([("c", 3)], "symbol string, x int"))
    build = lambda s: s.withColumn("y", F.col("x") * 2)
    s = incremental.Stages(spark, root)
    assert s.run("merge", one, build).count() == 2 and s.done == {"merge": "made"}
    s = incremental.Stages(spark, root)
    assert s.run("merge", one.orderBy("x", ascending=False), build).count() == 2 and s.done == {"merge": "kept"}
    grow = lambda old, new: spark.createDataFrame([("fewer", max(0, (old.count() if old else 0) - new.count()))], "check string, bad long")
    assert s.run("merge", two, build, grow, "symbol").count() == 3
    with pytest.raises(incremental.StageFailed, match="fewer 2"):
        s.run("merge", one.limit(1), build, grow)
    assert s.read("merge").count() == 3 and s.complete("merge") and s.manifest("merge")["version"] == "v000002"
    s.run("index", s.read("merge"), build)
    assert not s.stale("index", "merge") and s.stale("none", "merge")
    with pytest.raises(incremental.StageFailed):
        s.read("none")


def test_one_bad_symbol_does_not_stop_the_others():
    def work(s):
        if s == "b":
            raise ValueError("broken")

    assert incremental.each(["a", "b", "c"], work) == (["a", "c"], {"b": "broken"})


def test_downloads_and_folders(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("readme.txt", "1,2,3")
        z.writestr("a.csv", "1735689600000000,1,2,0.5,1.5,10,1735689659999999,15,,4,6,0\n" * 3)
    content = buf.getvalue() + b"\0" * 0
    plan = spark.createDataFrame([("A", "2025-01"), ("B", "2025-01"), ("C", "2025-02")], "symbol string, month string")
    got = klines.download(spark, plan, lambda s, m: {"A": content, "B": b"short"}.get(s)).collect()
    assert [(r.symbol, r.open_time, r.trades) for r in got] == [("A", 1735689600000, None)] * 3
    for name in ("ZZ.parquet", "AA.parquet"):
        spark.createDataFrame([(1,)], "x int").toPandas().to_parquet(tmp_path / name)
    (tmp_path / "empty.zip").write_bytes(b"")
    assert [r.symbol for r in klines.symbols_in(spark, str(tmp_path)).collect()] == ["AA", "ZZ"]
    assert [p.rsplit("/", 1)[1] for p in klines.empty_files(spark, str(tmp_path))] == ["empty.zip"]
    keys = spark.createDataFrame([("A", "A-1m-2025-01-03.zip"), ("A", "A-1m-2025-01-05.zip"), ("A", "A-1m-2025-01-09.zip"), ("B", "B-1m-2024-12-01.zip")], "symbol string, key string")
    assert [(r.symbol, r.key) for r in klines.newest_archive(keys, 20_095, 8).collect()] == [("A", "A-1m-2025-01-05.zip")]


def test_query_csv(spark, tmp_path):
    rows = [f"{k * 300_000},{k},{k + 1},{k - 1},{k + 0.5},2" for k in range(320)]
    (tmp_path / "mine.csv").write_text("\n".join(["open_time,open,high,low,close,volume", *rows]))
    got = klines.read_query(spark, str(tmp_path / "mine.csv")).orderBy("open_time").collect()
    assert len(got) == 100 and got[0].symbol == "mine" and got[-1].open_time == 106 * 900_000 and got[0].qv == 6 and got[0].n == 3
    (tmp_path / "short.csv").write_text("\n".join(["open_time,open,high,low,close,volume", *rows[:9]]))
    with pytest.raises(ValueError, match="fewer"):
        klines.read_query(spark, str(tmp_path / "short.csv"))
    (tmp_path / "bad.csv").write_text("open_time,open\n1,2")
    with pytest.raises(ValueError, match="high"):
        klines.read_query(spark, str(tmp_path / "bad.csv"))


def test_reports(spark, tmp_path):
    from tapeline.sources.reports import write_report

    df = spark.createDataFrame([("a,b", 1.5), ("c|d", None)], "name string, x double").orderBy("name")
    for kind, want in (("csv", '\ufeffname,x\n"a,b",1.5\nc|d,\n'), ("md", "| name | x |\n|---|---|\n| a,b | 1.5 |\n| c\\|d |  |\n")):
        write_report(df, str(tmp_path / kind), kind)
        assert (tmp_path / kind).read_text(encoding="utf-8") == want
    write_report(df, str(tmp_path / "json"), "json")
    assert '"name": "c|d"' in (tmp_path / "json").read_text()


def test_faults_of_live_bars(spark):
    b = spark.createDataFrame([("s", 0, 1.0, 2.0, 0.5, None, 1.0), ("s", 60, 1.0, 2.0, 0.5, float("inf"), 1.0), ("s", 120, 1.0, 2.0, 0.5, 1.5, 1.0)], "symbol string, open_time long, open double, high double, low double, close double, qv double")
    got = {r.open_time: r.issues.split(",")[0] for r in bars.live_issues(b, 60).collect()}
    assert got == {0: "close", 60: "close"}


def test_empty_tables_give_empty_results(spark):
    b = fixtures.bars(spark, SF).limit(0)
    for out in (windows.library(b, 100, 5, 24), bars.audit(b), bars.atr(b), events.limit_candidates(b, 0.9, 12, 6), events.spans(b, 12), events.breadth(b), bars.latest_window(b, 10, 3_600_000), windows.full_library(b)):
        assert out.count() == 0


def test_refresh_runs_all_stages_and_keeps_what_is_done(spark, tmp_path):
    from tapeline.__main__ import refresh

    b = fixtures.bars(spark, SF)
    b.where("open_time < 1705000000000").write.parquet(str(tmp_path / "old"))
    b.where("open_time >= 1704900000000").write.parquet(str(tmp_path / "new"))
    root = str(tmp_path / "root")
    made = {"merge": "made", "liquidity": "made", "index": "made"}
    assert refresh(spark, str(tmp_path / "old"), str(tmp_path / "new"), root, horizon=24) == made
    assert refresh(spark, str(tmp_path / "old"), str(tmp_path / "new"), root, horizon=24) == dict.fromkeys(made, "kept")
    s = incremental.Stages(spark, root)
    assert s.read("merge").count() == b.count() and s.complete("index") and s.read("index").count() == windows.library(b, 100, 5, 24).count()
