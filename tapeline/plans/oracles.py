"""DuckDB SQL for the registered queries, written apart from their plans."""

from __future__ import annotations

import math

HOUR, DAY = 3_600_000, 86_400_000
ORACLES: dict[str, str] = {}

TICKS = "ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS id, value AS price, value AS qv FROM events)"


def bars(hours: int = 1, name: str = "b") -> str:
    return f"""{name} AS (SELECT symbol, (us // {hours * HOUR * 1000}) * {hours * HOUR} AS open_time, first(price ORDER BY us, id) AS open, max(price) AS high,
  min(price) AS low, last(price ORDER BY us, id) AS close, sum(qv) AS qv, count(*)::BIGINT AS n FROM ticks GROUP BY 1, 2)"""


W = "PARTITION BY symbol ORDER BY open_time"


def put(name: str, select: str, *ctes: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}" if ctes else select


def put_bars(name: str, select: str, *ctes: str, hours: int = 1, recursive: bool = False) -> None:
    put(name, select, TICKS, bars(hours), *ctes, recursive=recursive)


def r(*exprs: str) -> str:
    """'expr AS name' or 'name', each rounded."""
    out = []
    for e in exprs:
        body, _, name = e.rpartition(" AS ")
        out.append(f"round({body or name}, 6) AS {name}")
    return ", ".join(out)


# bars and quality

put_bars("resample_ohlcv", f"SELECT symbol, open_time, open, high, low, close, {r('qv')}, n FROM b")
put_bars("resample_2h_from_1h", f"SELECT symbol, open_time, open, high, low, close, {r('qv')}, n FROM b", hours=2)
STEP = f"""g AS (SELECT *, open_time - lag(open_time) OVER ({W}) AS gap FROM b),
st AS (SELECT symbol, gap AS step FROM (SELECT symbol, gap, row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, gap) AS k FROM g WHERE gap IS NOT NULL GROUP BY symbol, gap) WHERE k = 1),
s AS (SELECT g.*, step FROM g JOIN st USING (symbol))"""
AUDIT = """a AS (SELECT symbol, count(*) AS bars, any_value(step) AS step, min(open_time) AS first, max(open_time) AS last,
  max(open_time) FILTER (qv > 0 AND high <> low) AS last_live, count(*) FILTER (gap > step) AS gaps, max(gap) AS max_gap, quantile_cont(qv, 0.5) AS median_qv,
  avg(CASE WHEN qv > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS z, avg(CASE WHEN high = low THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS f FROM s GROUP BY symbol),
mg AS (SELECT symbol, min(open_time) AS max_gap_to FROM s JOIN (SELECT symbol, max_gap FROM a) USING (symbol) WHERE gap = max_gap GROUP BY symbol)"""
put_bars(
    "bar_audit",
    """SELECT symbol, bars, (last - first) // step + 1 AS expected, round((1 - bars / ((last - first) // step + 1)) * 100, 6) AS missing_pct, gaps, max_gap, max_gap_to,
  round(z * 100, 6) AS zero_pct, round(f * 100, 6) AS flat_pct, round(median_qv, 6) AS median_qv, first, last, last_live FROM a JOIN mg USING (symbol)""",
    STEP,
    AUDIT,
)
put_bars(
    "halt_classes",
    f"""SELECT symbol, max_gap, CASE WHEN max_gap <= {2 * HOUR} THEN 'none' WHEN median_qv < 400 THEN 'thin'
  WHEN date_trunc('month', make_timestamp(last_live * 1000)) < date_trunc('month', make_timestamp((SELECT max(open_time) FROM b) * 1000)) THEN 'dead' ELSE 'resumed' END AS kind FROM a""",
    STEP,
    AUDIT,
)
put_bars("gap_list", "SELECT symbol, open_time - gap AS before, open_time AS after, gap // step - 1 AS missing FROM s WHERE gap > step", STEP)
ISLANDS = f"""i AS (SELECT *, sum(CASE WHEN gap > step OR gap IS NULL THEN 1 ELSE 0 END) OVER ({W}) AS island FROM s)"""
put_bars("gap_islands", "SELECT symbol, min(open_time) AS first, max(open_time) AS last, count(*) AS bars FROM i GROUP BY symbol, island", STEP, ISLANDS)
put_bars(
    "zombie_tail",
    "SELECT symbol, l AS last_live, count(*) FILTER (l IS NULL OR open_time > l) AS zombies FROM b JOIN (SELECT symbol, max(open_time) FILTER (qv > 300 AND high <> low) AS l FROM b GROUP BY symbol) USING (symbol) GROUP BY symbol, l",
)


def _run(flag: str) -> str:
    return f"""(SELECT symbol, max(n) AS m FROM (SELECT symbol, g, count(*) AS n FROM (SELECT symbol, f, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER ({W}) AS g
  FROM (SELECT *, {flag} AS f FROM b)) WHERE f GROUP BY symbol, g) GROUP BY symbol)"""


put_bars(
    "longest_runs",
    f"""SELECT s.symbol, coalesce(a.m, 0) AS longest_flat, coalesce(d.m, 0) AS longest_fall FROM (SELECT DISTINCT symbol FROM b) s
  LEFT JOIN {_run('high = low')} a USING (symbol) LEFT JOIN {_run(f'coalesce(close < lag(close) OVER ({W}), false)')} d USING (symbol)""",
)
put_bars(
    "ohlc_sanity",
    f"""SELECT symbol, count(*) AS bars, count(*) FILTER (gap = 0) AS duplicates, 0::BIGINT AS descending, count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < greatest(open, close)) AS high_short,
  count(*) FILTER (low > least(open, close)) AS low_short FROM (SELECT *, open_time - lag(open_time) OVER ({W}) AS gap FROM b) GROUP BY symbol""",
)
put_bars("live_validate", f"SELECT symbol, open_time, 'step' AS issues FROM (SELECT *, open_time - lag(open_time) OVER ({W}) AS gap FROM b) WHERE gap <> {HOUR}")
put_bars("repair_high_low", "SELECT symbol, open_time, CASE WHEN n = 1 THEN close ELSE high END AS high, low FROM b")
TR = f"tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER ({W})), 0), coalesce(abs(low - lag(close) OVER ({W})), 0)) AS tr, row_number() OVER ({W}) - 1 AS rn FROM b)"
ATR = "atr AS (SELECT symbol, rn, open_time, open, tr, tr AS y FROM tr WHERE rn = 0 UNION ALL SELECT t.symbol, t.rn, t.open_time, t.open, t.tr, a.y * (1 - 1 / 14::DOUBLE) + t.tr / 14 FROM atr a JOIN tr t ON t.symbol = a.symbol AND t.rn = a.rn + 1)"
put_bars("true_range", f"SELECT symbol, open_time, {r('tr')} FROM tr", TR)
put_bars("atr_ewm", f"SELECT symbol, open_time, {r('tr', 'CASE WHEN rn >= 13 THEN y END AS atr')} FROM atr", TR, ATR, recursive=True)
put_bars("liquidity_gate", "SELECT symbol FROM b GROUP BY symbol HAVING quantile_cont(qv, 0.5) >= 100 AND count(*) >= 200")
put_bars(
    "window_contiguity",
    f"""SELECT symbol, count(*) AS bars, count(*) FILTER (k >= 100 AND m >= 1 AND open_time - p = {99 * 2 * HOUR}) AS valid FROM (SELECT *, row_number() OVER ({W}) AS k,
  min(n) OVER ({W} ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS m, lag(open_time, 99) OVER ({W}) AS p FROM b) GROUP BY symbol""",
    hours=2,
)
OLD, NEW = "(open_time // 3600000) % 3 <> 0", "(open_time // 3600000) % 2 = 0"
put_bars("upsert_keep_last", f"SELECT symbol, open_time, round(CASE WHEN {NEW} THEN close + 1 ELSE close END, 6) AS close FROM b WHERE {OLD} OR {NEW}")
put_bars("keyset_diff", f"SELECT symbol, open_time FROM b WHERE NOT ({OLD})")
put_bars(
    "changed_shrunk",
    f"""SELECT *, CASE WHEN before = 0 THEN 'added' WHEN after < before THEN 'shrunk' WHEN after > before THEN 'grown' ELSE 'same' END AS what
  FROM (SELECT symbol, count(*) FILTER ({OLD} OR symbol = 'click') AS before, count(*) FILTER ({NEW}) AS after FROM b GROUP BY symbol)""",
)

# joins

put_bars("asof_prev_bar", "SELECT x.symbol, x.t, x.id, b.open_time AS match_t, b.close FROM (SELECT symbol, us // 1000 AS t, id FROM ticks) x ASOF LEFT JOIN b ON x.symbol = b.symbol AND x.t > b.open_time")
put_bars("asof_next_bar", "SELECT x.symbol, x.t, x.id, coalesce(b.open_time, -1) AS match_t, b.close FROM (SELECT symbol, us // 1000 AS t, id FROM ticks) x ASOF LEFT JOIN b ON x.symbol = b.symbol AND x.t <= b.open_time")


def windows(src: str = "b", win: int = 100, stride: int = 5) -> str:
    return f"""nb AS (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS len FROM {src}),
w AS (SELECT s.symbol, s.rn, s.rn // {stride} AS k, s.open_time AS t0, e.open_time AS t1, s.len FROM nb s JOIN nb e ON e.symbol = s.symbol AND e.rn = s.rn + {win - 1} WHERE s.rn % {stride} = 0),
x AS (SELECT w.symbol, w.k, w.t0, w.t1, w.rn AS start, n.rn - w.rn AS i, n.open, n.high, n.low, n.close, n.qv, n.n FROM w JOIN nb n ON n.symbol = w.symbol AND n.rn BETWEEN w.rn AND w.rn + {win - 1})"""


DAYBARS = bars(24, "p24")
RANGES = [TICKS, bars(2), windows(), DAYBARS, "p AS (SELECT symbol, open_time AS t FROM p24)"]
put("range_contains", "SELECT p.symbol, t, t0, t1 FROM p JOIN w ON w.symbol = p.symbol AND t BETWEEN t0 AND t1", *RANGES)
put("nearest_window", "SELECT p.symbol, t, arg_min(t0, abs(t - t0) * 4 + CASE WHEN t0 <= t THEN 0 ELSE 1 END) AS nearest_t0 FROM p LEFT JOIN w ON w.symbol = p.symbol GROUP BY p.symbol, t", *RANGES)
put(
    "locate_window",
    """SELECT symbol, t, i IS NOT NULL AS exact, coalesce(i, nt) AS t0 FROM (SELECT p.symbol, t, arg_min(t0, abs(t - t0) * 4 + CASE WHEN t0 <= t THEN 0 ELSE 1 END) AS nt, min(t0) FILTER (t BETWEEN t0 AND t1) AS i FROM p JOIN w ON w.symbol = p.symbol GROUP BY p.symbol, t)""",
    *RANGES,
)
put("band_selfjoin", f"SELECT x.symbol, x.t0 AS a, y.t0 AS b FROM w x JOIN w y ON x.symbol = y.symbol AND x.t0 < y.t0 AND abs(x.t1 - y.t1) <= {DAY}", *RANGES)
put("point_lookup", f"SELECT q.symbol, q.open_time, pos FROM q JOIN (SELECT symbol, open_time, row_number() OVER ({W}) - 1 AS pos FROM b) USING (symbol, open_time)", TICKS, bars(), bars(6, "q"))


def fwd(h: int) -> str:
    f = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    ok = f"count(*) {f} = {h}"
    return ", ".join(f"CASE WHEN {ok} THEN {e} {f} / close - 1 END AS {k}_{h}" for k, e in (("ret", "last_value(close)"), ("mfe", "max(high)"), ("mae", "min(low)")))


put_bars(
    "benchmark_excess",
    "SELECT a.symbol, a.open_time AS t, round(a.ret_4 - c.ret_4, 6) AS excess FROM f a JOIN f c ON c.symbol = 'click' AND c.open_time = a.open_time WHERE a.symbol <> 'click' AND a.ret_4 IS NOT NULL AND c.ret_4 IS NOT NULL",
    f"f AS (SELECT symbol, open_time, {fwd(4)} FROM b)",
)

# windows and vectors

LABELS = """lab AS (SELECT w.symbol, w.k, w.t0, w.t1, max(x.high) / min(x.low) AS hl, avg((x.high - x.low) / x.close) AS v, last(x.close ORDER BY i) AS c FROM w JOIN x ON x.symbol = w.symbol AND x.k = w.k GROUP BY 1, 2, 3, 4),
fw AS (SELECT w.symbol, w.k, last(n.close ORDER BY n.rn) AS fc, max(n.high) AS fh, min(n.low) AS fl FROM w JOIN nb n ON n.symbol = w.symbol AND n.rn BETWEEN w.rn + 100 AND w.rn + 123 GROUP BY 1, 2 HAVING count(*) = 24),
meta AS (SELECT symbol, k, t0, t1, (hl - 1) * 100 AS amp_pct, v * 100 AS vol_pct, fc / c - 1 AS fwd_ret, fh / c - 1 AS fwd_max, fl / c - 1 AS fwd_min FROM lab LEFT JOIN fw USING (symbol, k))"""
put_bars("window_meta", f"SELECT symbol, t0, t1, {r('amp_pct', 'vol_pct', 'fwd_ret', 'fwd_max', 'fwd_min')} FROM meta", windows(), LABELS)
put_bars("window_strict", f"SELECT w.symbol, w.k::INT AS k, w.t0, w.t1 FROM w WHERE t1 - t0 = {99 * 2 * HOUR}", windows(), hours=2)
put_bars("fwd_labels", f"SELECT symbol, open_time, {r(*(f'{k}_{h}' for h in (4, 24) for k in ('ret', 'mfe', 'mae')))} FROM (SELECT *, {fwd(4)}, {fwd(24)} FROM b)")
CLIP = f"OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)"
put_bars("fwd_labels_clipped", f"SELECT symbol, open_time, {r(f'last_value(close) {CLIP} / close - 1 AS ret_24', f'max(high) {CLIP} / close - 1 AS mfe_24', f'min(low) {CLIP} / close - 1 AS mae_24')} FROM b")


def trail(high: int, sd: int, sd_least: int, med: int, med_least: int) -> str:
    p = f"OVER ({W} ROWS BETWEEN {high} PRECEDING AND 1 PRECEDING)"
    s, m = f"OVER ({W} ROWS BETWEEN {sd - 1} PRECEDING AND CURRENT ROW)", f"OVER ({W} ROWS BETWEEN {med - 1} PRECEDING AND CURRENT ROW)"
    return f"""t1 AS (SELECT *, coalesce(close / lag(close) OVER ({W}) - 1, 0) AS ret1 FROM b),
tf AS (SELECT symbol, open_time, qv, CASE WHEN count(*) {p} = {high} THEN max(close) {p} END AS high_ref, CASE WHEN count(*) {s} >= {sd_least} THEN stddev_samp(ret1) {s} END AS vol,
  CASE WHEN count(*) {m} >= {med_least} THEN quantile_cont(qv, 0.5) {m} END AS med_qv, close / max(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS below_ath,
  close / lag(close, {high}) OVER ({W}) - 1 AS drop_, row_number() OVER ({W}) - 1 AS prior FROM t1)"""


put_bars("trailing_features", f'SELECT symbol, open_time, {r("high_ref", "vol", "med_qv", "below_ath")}, round(drop_, 6) AS "drop" FROM tf', trail(60, 240, 60, 60, 20))


def places(n: int, d: int, name: str) -> str:
    rows = []
    for i in range(d):
        pos = i * (n - 1) / (d - 1)
        lo = math.floor(pos)
        rows.append(f"({i}, {lo}, {min(lo + 1, n - 1)}, {pos - lo!r}::DOUBLE)")
    return f"{name}(j, lo, hi, w) AS (VALUES {', '.join(rows)})"


def resampled(src: str, keys: str, n: int, d: int, shift: int = 0) -> str:
    """Rows (keys, i, x) of src resampled."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    cols = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"(SELECT {cols}, j + {shift} AS i, (1 - w) * a.x + w * b.x AS x FROM {src} a JOIN (VALUES {places(n, d, '')[len('(j, lo, hi, w) AS (VALUES '):-1]}) q(j, lo, hi, w) ON a.i = q.lo JOIN {src} b ON b.i = q.hi AND {on})"


def zclip(src: str, keys: str) -> str:
    return f"""(SELECT {keys}, i, least(3, greatest(-3, (x - avg(x) OVER (PARTITION BY {keys})) / CASE WHEN stddev_pop(x) OVER (PARTITION BY {keys}) < 1e-9 THEN 1
  ELSE stddev_pop(x) OVER (PARTITION BY {keys}) END)) AS x FROM {src})"""


def residual(src: str, keys: str) -> str:
    return f"(SELECT {keys}, i, x - regr_intercept(x, i) OVER (PARTITION BY {keys}) - regr_slope(x, i) OVER (PARTITION BY {keys}) * i AS x FROM {src})"


E64 = "e AS (SELECT vec_id AS id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
put("resample_linear", f"SELECT id, i::INT AS i, {r('x')} FROM {resampled('e', 'id', 64, 10)}", E64)
put("zscore_clip", f"SELECT id, i::INT AS i, {r('x')} FROM {zclip('e', 'id')}", E64)
put("detrend", f"SELECT id, i::INT AS i, {r('x')} FROM {residual('e', 'id')}", E64)
KEYS = "symbol, t0"


def vec(kind: str, name: str = "vl") -> list[str]:
    """A row a window: symbol, t0, v (list of 64)."""
    at = [i * 99 / 31 for i in range(32)]
    low, share = [math.floor(x) for x in at], [x - math.floor(x) for x in at]
    one = "(1 - {sh}[j + 1]) * {c}[{lo}[j + 1] + 1] + {sh}[j + 1] * {c}[least({lo}[j + 1] + 1, 99) + 1]"
    res = lambda c: "list_transform(range(32), lambda j: " + one.format(c=c, lo=low, sh=share) + ")"
    clip = lambda c, m, d: f"list_transform({c}, lambda y: least(3, greatest(-3, (y - {m}) / CASE WHEN {d} < 1e-9 THEN 1 ELSE {d} END)))"
    flat = "list_transform(range(100), lambda i: c[i + 1] - list_avg(c) - b * (i - 49.5))" if kind == "shape" else "c"
    return [
        f"{name}1 AS (SELECT symbol, t0, list(ln(close) ORDER BY i) AS c, list(ln(1 + qv) ORDER BY i) AS q FROM x GROUP BY symbol, t0)",
        f"{name}2 AS (SELECT *, list_sum(list_transform(range(100), lambda i: c[i + 1] * (i - 49.5))) / {sum((i - 49.5) ** 2 for i in range(100))!r} AS b FROM {name}1)",
        f"{name}3 AS (SELECT symbol, t0, {flat} AS c, q FROM {name}2)",
        f"{name}4 AS (SELECT symbol, t0, {clip('c', 'list_avg(c)', 'list_stddev_pop(c)')} AS c, {clip('q', 'list_avg(q)', 'list_stddev_pop(q)')} AS q FROM {name}3)",
        f"{name} AS (SELECT symbol, t0, list_concat({res('c')}, {res('q')}) AS v FROM {name}4)",
    ]


FLAT_VEC = "SELECT symbol, t0, unnest(range(64))::INT AS i, round(unnest(v), 6) AS x FROM vl"
put_bars("vec_shape64", FLAT_VEC, windows(), *vec("shape"))
put_bars("vec_raw64", FLAT_VEC, windows(), *vec("raw"))
BLOCKS = [
    f"xt AS (SELECT *, CASE WHEN i = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER (PARTITION BY {KEYS} ORDER BY i)), abs(low - lag(close) OVER (PARTITION BY {KEYS} ORDER BY i))) END AS tr FROM x)",
    f"""st AS (SELECT symbol, t0, avg(tr) AS a, first(close ORDER BY i) AS c0, last(close ORDER BY i) AS cl, max(high) AS hh, min(low) AS ll, greatest(quantile_cont(qv, 0.5), 1e-12) AS mv,
  regr_slope(close, i) AS sl, regr_intercept(close, i) AS ic, sum(close * close) - count(*) * avg(close) * avg(close) AS rough, avg(close) AS mc FROM xt GROUP BY {KEYS})""",
    "j AS (SELECT xt.*, a, c0, cl, hh, ll, mv, sl, ic, mc FROM xt JOIN st USING (symbol, t0) WHERE a > 0)",
    "br AS (SELECT symbol, t0, i, (close - ic - sl * i) / a AS x FROM j)",
    "bw AS (SELECT symbol, t0, i, (close - c0) / a AS x FROM j)",
    "bv AS (SELECT symbol, t0, i, ln(greatest((qv + mv * 1e-9) / mv, 1e-9)) AS x FROM j)",
    "bt AS (SELECT symbol, t0, i, tr / a AS x FROM j)",
    """tr4 AS (SELECT symbol, t0, any_value((cl - c0) / a) AS x0, 1 - avg((close - ic - sl * i) ** 2) / greatest(avg((close - mc) ** 2), 1e-18) AS x1, any_value((cl - ll) / greatest(hh - ll, 1e-18)) AS x2, any_value((hh - ll) / a) AS x3 FROM j GROUP BY symbol, t0)""",
    f"""v AS (SELECT * FROM {resampled('br', KEYS, 100, 48)} UNION ALL SELECT * FROM {resampled('bw', KEYS, 100, 48, 48)} UNION ALL SELECT * FROM {resampled('bv', KEYS, 100, 8, 96)}
  UNION ALL SELECT * FROM {resampled('bt', KEYS, 100, 4, 104)} UNION ALL SELECT symbol, t0, 108 + unnest(range(4)), unnest([x0, x1, x2, x3]) FROM tr4)""",
]
put_bars("vec_blocks_atr", f"SELECT symbol, t0, i::INT AS i, {r('x')} FROM v", windows(), *BLOCKS)
put_bars(
    "block_scales",
    """SELECT block, round(avg(s), 6) AS scale FROM (SELECT CASE WHEN i < 48 THEN 'resid' WHEN i < 96 THEN 'raw' WHEN i < 104 THEN 'vol' WHEN i < 108 THEN 'range' ELSE 'trend' END AS block, i, stddev_pop(round(x, 6)) AS s FROM v GROUP BY 1, 2) GROUP BY block""",
    windows(),
    *BLOCKS,
)

# retrieval

VEC = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def sq(a: str, b: str, first: int = 1, last: int = 64) -> str:
    return f"list_sum(list_transform(range({first}, {last + 1}), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"


def nearest(dist: str, k: int = 10) -> str:
    return f"SELECT q_id, c_id, round(dist, 6) AS dist, rank::INT AS rank FROM (SELECT q.id AS q_id, c.id AS c_id, {dist} AS dist, row_number() OVER (PARTITION BY q.id ORDER BY {dist}, c.id) AS rank FROM v q, v c WHERE q.id % 100 = 0 AND q.id <> c.id) WHERE rank <= {k}"


put("knn_exact", nearest(sq("q.v", "c.v")), VEC)
put("knn_subspace32", nearest(sq("q.v", "c.v", 33, 64)), VEC)
put(
    "knn_amp_aug",
    nearest(sq("q.v", "c.v") + " + 0.1 * (c.z - q.z) * (c.z - q.z)"),
    "v0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, ln(list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[])) AS l FROM embeddings)",
    "v AS (SELECT id, v, (l - avg(l) OVER ()) / stddev_pop(l) OVER () AS z FROM v0)",
)
WIN_VEC = [windows(), *vec("shape"), LABELS, "lib AS (SELECT m.symbol, m.k, m.t0, m.t1, amp_pct, fwd_ret, l.v FROM meta m JOIN vl l USING (symbol, t0))"]
DIST = [
    f"d AS (SELECT q.symbol AS q_symbol, q.t0 AS q_t0, q.t1 AS q_t1, c.symbol AS c_symbol, c.t0 AS c_t0, c.t1 AS c_t1, c.amp_pct, c.fwd_ret, {sq('q.v', 'c.v')} AS dist FROM lib q, lib c WHERE q.k % 100 = 0)"
]


def ranked(src: str, k: int, name: str = "rank", where: str = "TRUE") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_symbol, q_t0 ORDER BY dist, c_symbol, c_t0)::INT AS {name} FROM {src} WHERE {where}) WHERE {name} <= {k})"


OVERLAP = "NOT (c_t0 <= q_t1 AND c_t1 >= q_t0)"
EXCLUDED = [*WIN_VEC, *DIST, f"pool AS {ranked('d', 600, 'p')}", f"found AS {ranked('pool', 24, 'rank', OVERLAP)}"]
put_bars("knn_exclude_overlap", f"SELECT q_symbol, q_t0, c_symbol, c_t0, rank, {r('dist', 'amp_pct', 'fwd_ret')} FROM found", *EXCLUDED)
put_bars("knn_isolated", f"SELECT q_symbol, q_t0, c_symbol, c_t0, rank, {r('dist')} FROM {ranked('d', 20, 'rank', f'c_t1 <= q_t0 OR c_t0 >= q_t1 + {DAY}')}", *WIN_VEC, *DIST)
HALF = "NOT (c_symbol = q_symbol AND least(c_t1, q_t1) - greatest(c_t0, q_t0) > (q_t1 - q_t0) * 0.5)"
put_bars("knn_same_symbol_half", f"SELECT q_symbol, q_t0, c_symbol, c_t0, rank, {r('dist')} FROM {ranked('pool', 10, 'rank', HALF)}", *WIN_VEC, *DIST, f"pool AS {ranked('d', 100, 'p')}")
put_bars(
    "knn_dedup_greedy",
    f"SELECT q_symbol, q_t0, rank, c_symbol, c_t0, {r('dist')} FROM g JOIN pool USING (q_symbol, q_t0, rank) WHERE took",
    *WIN_VEC,
    *DIST,
    f"pool AS {ranked('d', 500)}",
    """g AS (SELECT q_symbol, q_t0, rank, true AS took, [{'s': c_symbol, 'a': c_t0, 'b': c_t1}] AS kept FROM pool WHERE rank = 1
  UNION ALL SELECT p.q_symbol, p.q_t0, p.rank, t.took, CASE WHEN t.took THEN list_append(g.kept, {'s': p.c_symbol, 'a': p.c_t0, 'b': p.c_t1}) ELSE g.kept END
  FROM g JOIN pool p ON p.q_symbol = g.q_symbol AND p.q_t0 = g.q_t0 AND p.rank = g.rank + 1,
  LATERAL (SELECT len(g.kept) < 10 AND len(list_filter(g.kept, lambda y: y.s = p.c_symbol AND least(y.b, p.c_t1) - greatest(y.a, p.c_t0) > (p.c_t1 - p.c_t0) * 0.5)) = 0 AS took) t)""",
    recursive=True,
)
SCALE = f"""SELECT round(quantile_cont(m, 0.5), 6) AS scale FROM (SELECT q.id, quantile_cont(sqrt({sq('q.v', 'c.v')}), 0.5) AS m
  FROM (SELECT * FROM v ORDER BY md5('q-' || id), id LIMIT 24) q, (SELECT * FROM v ORDER BY md5('c-' || id), id LIMIT 3000) c GROUP BY q.id)"""
put("dist_random_scale", SCALE, VEC)
put("similarity_score", f"SELECT q_id, c_id, round(least(1, greatest(0, 1 - sqrt(dist) / scale)), 5) AS score FROM ({nearest(sq('q.v', 'c.v'))}), ({SCALE})", VEC)
LABELLED = """lx AS (SELECT m.symbol, m.k, m.t0, m.t1, amp_pct, fwd_ret, fwd_max, fwd_min, fwd_ret - avg(fwd_ret) OVER (PARTITION BY m.t1) AS exc, fwd_max - avg(fwd_max) OVER (PARTITION BY m.t1) AS excmax, (fwd_max >= 0.05)::INT AS hit, l.v
  FROM meta m JOIN vl l USING (symbol, t0))"""
_PAIR = "q.symbol AS q_symbol, q.t0 AS q_t0, q.t1 AS q_t1, c.symbol AS c_symbol, c.t0 AS c_t0, c.t1 AS c_t1"
DX = f"dx AS (SELECT {_PAIR}, q.exc AS own, c.exc, c.excmax, c.hit, c.fwd_ret, c.fwd_max, c.fwd_min, {sq('q.v', 'c.v')} AS dist FROM lx q, lx c WHERE q.k % 100 = 0)"
ISO = f"(c_t1 <= q_t0 OR c_t0 >= q_t1 + {DAY})"
FOUND40 = [windows(), *vec("shape"), LABELS, LABELLED, DX, f"fn AS {ranked('dx', 40, 'rank', ISO)}"]


def summary(src: str) -> str:
    past = "FILTER (c_t1 <= q_t0)"
    return f"""(SELECT q_symbol, q_t0, any_value(own) AS own, CASE WHEN count(*) >= 10 THEN avg(exc) END AS exc, CASE WHEN count(*) >= 10 THEN avg(excmax) END AS excmax, CASE WHEN count(*) >= 10 THEN avg(hit) END AS hit,
  CASE WHEN count(*) >= 10 THEN stddev_pop(fwd_ret) END AS dispersion, CASE WHEN count(*) >= 10 THEN avg(abs(c_t0 - q_t0) / {DAY}) END AS days,
  CASE WHEN count(*) >= 10 AND count(*) {past} >= 10 THEN avg(exc) {past} END AS past_exc, CASE WHEN count(*) >= 10 THEN count(*) ELSE 0 END AS n FROM {src} GROUP BY 1, 2)"""


put_bars(
    "stratified_queries",
    """SELECT symbol, t0, year FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY o, symbol, t0) AS n, count(DISTINCT year) OVER () AS years FROM (SELECT symbol, t0, year(make_timestamp(t0 * 1000)) AS year, md5('sq-' || symbol || '-' || t0) AS o
  FROM meta WHERE fwd_ret IS NOT NULL AND amp_pct BETWEEN 1 AND 1e7 AND t0 > 1704200000000)) WHERE n <= greatest(1, 20 // years) ORDER BY o, symbol, t0 LIMIT 20""",
    windows(),
    LABELS,
)
put_bars("neighbour_summary", f"SELECT q_symbol, q_t0, {r('exc', 'excmax', 'hit', 'dispersion', 'days', 'past_exc')}, n FROM {summary('fn')}", *FOUND40)
put_bars(
    "neighbour_consistency",
    f"""SELECT {r('same_sign', 'long_rule', 'dispersion', 'days', 'neighbours', 'random', 'dispersion / random AS ratio')} FROM (SELECT avg((sign(exc) = sign(own))::INT) FILTER (exc IS NOT NULL AND own IS NOT NULL) AS same_sign,
  CASE WHEN count(*) FILTER (exc > 0 AND own IS NOT NULL) >= 3 THEN avg(own) FILTER (exc > 0 AND own IS NOT NULL) END AS long_rule, quantile_cont(dispersion, 0.5) AS dispersion, quantile_cont(days, 0.5) AS days, avg(n) AS neighbours FROM {summary('fn')}),
  (SELECT quantile_cont(dispersion, 0.5) AS random FROM {summary('dr')})""",
    *FOUND40,
    "dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_symbol, q_t0 ORDER BY md5('nr-' || q_symbol || '-' || q_t0 || '-' || c_symbol || '-' || c_t0), c_symbol, c_t0) AS rk FROM dx) WHERE rk <= 40)",
)
put_bars(
    "neighbour_volatility",
    f"SELECT q_symbol, q_t0, {r('quantile_cont(least(1000, greatest(0, (fwd_max - fwd_min) * 100)), 0.5) AS nb_vol', 'avg(exc) AS nb_ret')} FROM {ranked('dx', 40, 'rank', f'{ISO} AND abs(fwd_ret) <= 1 AND least(1000, greatest(0, (fwd_max - fwd_min) * 100)) > 1e-9')} GROUP BY 1, 2",
    windows(),
    *vec("shape"),
    LABELS,
    LABELLED,
    DX,
)
put_bars(
    "neighbours_by_amplitude",
    f"SELECT q_symbol, q_t0, c_symbol, c_t0, {r('dist')}, rank FROM {ranked('sd', 20)}",
    windows(),
    LABELS,
    f"am AS (SELECT {_PAIR}, abs(c.amp_pct - q.amp_pct) AS dist, c.amp_pct >= q.amp_pct AS up FROM meta q, meta c WHERE q.k % 100 = 0)",
    f"sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_symbol, q_t0, up ORDER BY dist, c_symbol, c_t0) AS n FROM am WHERE {ISO}) WHERE n <= 50)",
)
put_bars("neighbour_union", f"SELECT c_symbol AS symbol, c_t0 AS t0 FROM {ranked('dx', 10, 'rank', ISO)} UNION SELECT q_symbol, q_t0 FROM {ranked('dx', 10, 'rank', ISO)}", *FOUND40[:-1])
put_bars(
    "decision_cells",
    f"""SELECT (dense_rank() OVER (ORDER BY day) - 1)::INT AS g, day, symbol, t0, t1 FROM (SELECT *, dense_rank() OVER (ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY day) AS c
  FROM (SELECT symbol, t0, t1, t1 // {DAY} AS day, row_number() OVER (PARTITION BY t1 // {DAY}, symbol ORDER BY t1 DESC, t0 DESC) AS n FROM w) WHERE n = 1) WHERE k % 3 = 0 AND c >= 3""",
    windows(),
    hours=2,
)
put_bars(
    "market_context",
    """SELECT w.symbol, w.t0, w.t1, round(CASE WHEN n > 1 AND a > 0 THEN (cz - ca) / a END, 6) AS net_atr, round(CASE WHEN n > 1 AND a > 0 THEN a / ca END, 6) AS atr_pct FROM w LEFT JOIN
  (SELECT w.symbol, w.t0, count(*) AS n, avg(tr) AS a, arg_min(close, open_time) AS ca, arg_max(close, open_time) AS cz FROM w JOIN tr ON tr.symbol = 'click' AND open_time BETWEEN t0 AND t1 GROUP BY 1, 2) x USING (symbol, t0)""",
    windows(),
    TR,
    hours=2,
)
put_bars(
    "fwd_atr",
    f"""SELECT symbol, t0, {r('(fc - cl) / a AS fwd', '(fh - cl) / a AS max_up', '(fl - cl) / a AS max_down')} FROM (SELECT symbol, k, any_value(t0) AS t0, avg(tr) AS a, last(close ORDER BY i) AS cl FROM xt GROUP BY symbol, k)
  JOIN (SELECT w.symbol, w.k, last(n.close ORDER BY n.rn) AS fc, max(n.high) AS fh, min(n.low) AS fl FROM w JOIN nb n ON n.symbol = w.symbol AND n.rn BETWEEN w.rn + 100 AND w.rn + 123 GROUP BY 1, 2 HAVING count(*) >= 5) USING (symbol, k) WHERE a > 0""",
    windows(),
    BLOCKS[0],
)
FULL = [
    *BLOCKS,
    "sc AS (SELECT b, avg(s) AS s FROM (SELECT CASE WHEN i < 48 THEN 0 WHEN i < 104 THEN 1 WHEN i < 108 THEN 2 ELSE 3 END AS b, i, stddev_pop(x) AS s FROM v WHERE i < 48 OR i >= 96 GROUP BY 1, 2) GROUP BY b)",
    "fv AS (SELECT symbol, t0, CASE WHEN i < 48 THEN i ELSE i - 48 END AS i, x / s AS x FROM v JOIN sc ON b = CASE WHEN i < 48 THEN 0 WHEN i < 104 THEN 1 WHEN i < 108 THEN 2 ELSE 3 END WHERE i < 48 OR i >= 96)",
]
put_bars("vec_full64", f"SELECT symbol, t0, i::INT AS i, {r('x')} FROM fv", windows(), *FULL)
put_bars(
    "knn_full64",
    f"SELECT q_symbol, q_t0, c_symbol, c_t0, {r('dist')}, rank FROM {ranked('pool', 10, 'rank', OVERLAP)}",
    windows(),
    *FULL,
    "fl AS (SELECT symbol, k, t0, t1, v FROM w JOIN (SELECT symbol, t0, list(x ORDER BY i) AS v FROM fv GROUP BY 1, 2) USING (symbol, t0))",
    f"df AS (SELECT {_PAIR}, {sq('q.v', 'c.v')} AS dist FROM fl q, fl c WHERE q.k % 100 = 0)",
    f"pool AS {ranked('df', 100, 'p')}",
)
put("norm_cache", "SELECT id, round(list_dot_product(v, v), 6) AS norm2 FROM v", VEC)
put("query_window", f"SELECT symbol, open_time, open, high, low, close, {r('qv')}, n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM b) WHERE k <= 50 AND c >= 50", TICKS, bars(6))
put_bars("seam_check", f"SELECT symbol, max(open_time) FILTER (open_time < 1705000000000) AS last, min(open_time) FILTER (open_time >= 1705000000000) AS first, coalesce(max(open_time) FILTER (open_time < 1705000000000) + {HOUR} = min(open_time) FILTER (open_time >= 1705000000000), false) AS joined FROM b GROUP BY symbol HAVING count(*) FILTER (open_time >= 1705000000000) > 0")
put_bars("plot_overlay", f"SELECT symbol, t0, i::INT AS i, {r('x')} FROM {zclip(residual('lg', KEYS), KEYS)}", windows(), "lg AS (SELECT symbol, t0, i, ln(close) AS x FROM x WHERE k % 10 = 0)")
put_bars("plot_frames", f"SELECT symbol, t0, i::INT AS i, {r('open', 'high', 'low', 'close')}, round(qv, 2) AS qv FROM x WHERE k % 10 = 0", windows())
put_bars("index_info", "SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, min(t0) AS first, max(t1) AS last FROM w", windows(), hours=2)
put_bars(
    "neighbour_outlook",
    "SELECT q_symbol, q_t0, len(list_filter(f, lambda y: y > 0))::INT AS up, f[len(f) // 2 + 1] AS median, list_max(f) AS best, list_min(f) AS worst FROM (SELECT q_symbol, q_t0, list_sort(list(round(fwd_ret, 6))) AS f FROM found WHERE fwd_ret IS NOT NULL GROUP BY 1, 2)",
    *EXCLUDED,
)
put_bars("window_pick_latest", "SELECT symbol, arg_max(t0, t1) AS t0, max(t1) AS t1 FROM w GROUP BY symbol", windows(), hours=2)

put_bars(
    "separated_sample",
    "SELECT symbol, unnest(kept) AS t0 FROM (SELECT symbol, arg_max(kept, n) AS kept FROM g GROUP BY symbol)",
    windows(),
    "od AS (SELECT symbol, t0, row_number() OVER (PARTITION BY symbol ORDER BY md5('sep-' || symbol || '-' || t0), t0) AS n FROM w)",
    f"""g AS (SELECT symbol, n, [t0] AS kept FROM od WHERE n = 1 UNION ALL SELECT o.symbol, o.n, CASE WHEN len(list_filter(g.kept, lambda y: abs(y - o.t0) < {40 * HOUR})) > 0 THEN g.kept ELSE list_append(g.kept, o.t0) END
  FROM g JOIN od o ON o.symbol = g.symbol AND o.n = g.n + 1)""",
    hours=2,
    recursive=True,
)
_HASH = "md5('blind-' || q_symbol || '-' || q_t0 || '-' || c_symbol || '-' || c_t0)"


def _offer(i: int, order: str, where: str = "TRUE") -> str:
    return f"(SELECT q_symbol, q_t0, {i} AS i, {{'s': c_symbol, 't': c_t0}} AS c, row_number() OVER (PARTITION BY q_symbol, q_t0 ORDER BY {order}, c_symbol, c_t0) AS n FROM bp WHERE {where} QUALIFY n <= 8)"


BLIND = [
    windows(),
    *vec("shape"),
    *vec("raw", "rl"),
    LABELS,
    "bl AS (SELECT m.symbol, m.k, m.t0, m.t1, amp_pct, a.v, b.v AS raw FROM meta m JOIN vl a USING (symbol, t0) JOIN rl b USING (symbol, t0))",
    f"bp AS (SELECT *, {_HASH} AS h FROM (SELECT {_PAIR}, q.amp_pct AS qa, c.amp_pct AS ca, {sq('q.v', 'c.v')} AS ds, {sq('q.raw', 'c.raw')} AS dr FROM bl q, bl c WHERE q.k % 100 = 0) WHERE {OVERLAP})",
    f"of AS ({_offer(0, 'ds')} UNION ALL {_offer(1, 'dr')} UNION ALL {_offer(2, 'h', f'abs(q_t0 - c_t0) <= {10 * DAY} AND ca BETWEEN qa * 0.5 AND qa * 2')} UNION ALL {_offer(3, 'reverse(h)')})",
    "ls AS (SELECT q_symbol, q_t0, " + ", ".join(f"list(c ORDER BY n) FILTER (i = {i}) AS l{i}" for i in range(4)) + " FROM of GROUP BY 1, 2)",
    "p0 AS (SELECT *, l0[1] AS c0 FROM ls)",
    "p1 AS (SELECT *, list_filter(l1, lambda y: c0 IS NULL OR y <> c0)[1] AS c1 FROM p0)",
    "p2 AS (SELECT *, list_filter(l2, lambda y: (c0 IS NULL OR y <> c0) AND (c1 IS NULL OR y <> c1))[1] AS c2 FROM p1)",
    "p3 AS (SELECT *, list_filter(l3, lambda y: (c0 IS NULL OR y <> c0) AND (c1 IS NULL OR y <> c1) AND (c2 IS NULL OR y <> c2))[1] AS c3 FROM p2)",
    """bc AS (SELECT q_symbol, q_t0, channel, c.s AS c_symbol, c.t AS c_t0, row_number() OVER (PARTITION BY q_symbol, q_t0 ORDER BY md5('blind-' || q_symbol || '-' || q_t0 || '-' || channel))::INT AS place
  FROM (SELECT q_symbol, q_t0, unnest(['shape', 'raw', 'regime', 'random']) AS channel, unnest([c0, c1, c2, c3]) AS c FROM p3) WHERE c IS NOT NULL)""",
]
put_bars("blind_candidates", "SELECT * FROM bc", *BLIND)
put_bars("blind_tally", "SELECT channel, count(*) AS n FROM bc WHERE place = 1 + q_t0 % 4 GROUP BY channel", *BLIND)

put_bars(
    "context_candidates",
    """SELECT q_symbol, q_t0, step, arg_min(c_symbol, h) AS c_symbol, arg_min(c_t0, h) AS c_t0 FROM (SELECT *, quantile_cont(dist, 0.6) OVER (PARTITION BY q_symbol, q_t0) AS far FROM cs WHERE CASE step WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE true END) WHERE dist > far GROUP BY 1, 2, 3""",
    windows(),
    *vec("shape"),
    TR,
    """cx AS (SELECT symbol, t0, CASE WHEN n > 1 AND a > 0 THEN (cz - ca) / a END AS net, CASE WHEN n > 1 AND a > 0 THEN a / ca END AS pct FROM (SELECT w.symbol, w.t0, count(*) AS n, avg(tr) AS a, arg_min(close, open_time) AS ca, arg_max(close, open_time) AS cz
  FROM w JOIN tr ON tr.symbol = 'click' AND open_time BETWEEN t0 AND t1 GROUP BY 1, 2))""",
    "lc AS (SELECT w.symbol, w.k, w.t0, w.t1, v, net, pct FROM w JOIN vl USING (symbol, t0) LEFT JOIN cx USING (symbol, t0))",
    f"""pc AS (SELECT *, md5('ctx-' || q_symbol || '-' || q_t0 || '-' || c_symbol || '-' || c_t0) AS h, coalesce(abs(cn - qn) <= 0.6 AND cp / greatest(qp, 1e-12) > 0.6 AND cp / greatest(qp, 1e-12) < 1.6, false) AS alike, abs(q_t0 - c_t0) AS ap
  FROM (SELECT {_PAIR}, q.net AS qn, q.pct AS qp, c.net AS cn, c.pct AS cp, {sq('q.v', 'c.v')} AS dist FROM lc q, lc c WHERE q.k % 100 = 0) WHERE {HALF})""",
    f"sf AS (SELECT *, ap <= {2 * DAY} AND alike AS s1, ap <= {4 * DAY} AND alike AS s2, ap <= {8 * DAY} AS s3 FROM pc)",
    """cs AS (SELECT *, CASE WHEN count(*) FILTER (s1) OVER v >= 5 THEN 1 WHEN count(*) FILTER (s2) OVER v >= 5 THEN 2 WHEN count(*) FILTER (s3) OVER v >= 5 THEN 3 WHEN count(*) OVER v >= 5 THEN 4 END AS step FROM sf WINDOW v AS (PARTITION BY q_symbol, q_t0))""",
)

# universe


def panel(days: int = 1) -> str:
    return f"""p AS (SELECT c_nationkey AS sym, epoch_us(o_orderdate) // {days * 86400000000} AS day, sum(o_totalprice) AS dvol, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


DENSE = "cal AS (SELECT sym, unnest(range(a, b + 1)) AS day FROM (SELECT sym, min(day) AS a, max(day) AS b FROM p GROUP BY sym)), ds AS (SELECT cal.sym, cal.day, coalesce(dvol, 0) AS dvol FROM cal LEFT JOIN p USING (sym, day))"


def _roll(n: int, least: int) -> str:
    o = f"OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) {o} >= {least} THEN quantile_cont(dvol, 0.5) {o} END AS liq{n}"


LIQ = [panel(7), DENSE, f"liq AS (SELECT *, {_roll(30, 10)}, {_roll(60, 20)} FROM ds)"]
TOP5 = "tk AS (SELECT sym, day + 1 AS day, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY liq60 DESC, sym) AS rank FROM liq WHERE liq60 > 0) WHERE rank <= 5)"
put("liq_calendar_fill", f"SELECT sym, day, {r('dvol')} FROM ds", panel(), DENSE)
put("liq_rolling_median", f"SELECT sym, day, {r('liq30', 'liq60')} FROM liq", *LIQ)
put("pit_topk", "SELECT sym, day, rank FROM tk", *LIQ, TOP5)
put("pit_topk_floor", "SELECT tk.sym, tk.day, tk.rank FROM tk JOIN liq ON liq.sym = tk.sym AND liq.day = tk.day - 1 WHERE liq60 >= 150000", *LIQ, TOP5)
put("panel_without", "SELECT sym, count(*) AS days FROM p WHERE sym NOT IN (3, 7, 24) GROUP BY sym", panel())
put(
    "liquidity_ends",
    "SELECT sym, round(med, 6) AS med, e AS \"end\" FROM (SELECT *, row_number() OVER (ORDER BY med DESC, sym) AS g, row_number() OVER (ORDER BY med, sym) AS l FROM (SELECT sym, quantile_cont(dvol, 0.5) AS med FROM p GROUP BY sym)), (VALUES ('greatest'), ('least')) v(e) WHERE CASE e WHEN 'greatest' THEN g ELSE l END <= 5",
    panel(),
)
put_bars(
    "near_any_symbol",
    f"SELECT q.symbol AS q_symbol, q.t0 AS q_t0, c.symbol AS c_symbol, c.t0 AS c_t0 FROM w q JOIN w c ON abs(q.t0 - c.t0) <= {2 * DAY} AND NOT (q.symbol = c.symbol AND q.t0 = c.t0) WHERE q.k % 20 = 0",
    windows(),
    hours=2,
)
put(
    "pct_rank_avg",
    "SELECT sym, day, round(CASE WHEN liq30 IS NOT NULL THEN (rank() OVER (PARTITION BY day ORDER BY liq30 NULLS LAST) + (count(liq30) OVER (PARTITION BY day, liq30) - 1) / 2) / count(liq30) OVER (PARTITION BY day) END, 6) AS pr FROM liq",
    *LIQ,
)
put(
    "pool_turnover",
    "SELECT day, round(1 - len(list_intersect(now, past)) / len(list_distinct(list_concat(now, past))), 6) AS turnover FROM (SELECT day, now, lag(now) OVER (ORDER BY day) AS past FROM (SELECT day, list(sym) AS now FROM tk GROUP BY day)) WHERE past IS NOT NULL",
    *LIQ,
    TOP5,
)
put(
    "membership_share",
    "SELECT l.sym, count(tk.rank) AS days_in, round(count(tk.rank) / count(*), 6) AS share, round(quantile_cont(CASE WHEN tk.rank IS NOT NULL THEN liq60 END, 0.5), 6) AS median_in FROM liq l LEFT JOIN tk ON l.sym = tk.sym AND l.day = tk.day GROUP BY l.sym",
    *LIQ,
    TOP5,
)
put("delisted_count", "SELECT sym, last FROM (SELECT sym, max(day) AS last FROM p GROUP BY sym) WHERE last < (SELECT max(day) FROM p) - 2", panel())
put(
    "coverage_days",
    "SELECT count(*) AS symbols, " + ", ".join(f"count(*) FILTER (age <= {n}) AS within_{n}" for n in (0, 1, 7, 30)) + " FROM (SELECT (SELECT max(day) FROM p) - max(day) AS age FROM p GROUP BY sym)",
    panel(),
)
VISIBLE = "vs AS (SELECT sym, min(day) AS first, max(day) AS last, count(*) AS days, (SELECT max(day) FROM p) - max(day) > 2 AS stale FROM p GROUP BY sym)"
put("visible_spans", "SELECT * FROM vs", panel(), VISIBLE)
put(
    "universe_build",
    "SELECT sym, 'dead' AS state, n::INT AS n FROM dd UNION ALL SELECT sym, 'alive', n::INT FROM al WHERE n <= 12 - (SELECT count(*) FROM dd)",
    panel(),
    VISIBLE,
    "dd AS (SELECT * FROM (SELECT sym, row_number() OVER (ORDER BY last - first DESC, sym) AS n FROM vs WHERE stale AND last - first >= 100) WHERE n <= 4)",
    "al AS (SELECT sym, row_number() OVER (ORDER BY last - first DESC, sym) AS n FROM vs WHERE NOT stale AND last - first >= 100)",
)

# evaluation

CELLS = [
    panel(),
    "c0 AS (SELECT sym, day // 7 AS g, quantile_cont(dvol, 0.5) AS x, arg_max(close, day) AS close FROM p GROUP BY 1, 2)",
    "c AS (SELECT sym, g, x, close, ret, year(DATE '1970-01-01' + (g * 7)::INT) AS year FROM (SELECT *, least(0.5, greatest(-0.5, lead(close) OVER (PARTITION BY sym ORDER BY g) / close - 1)) / 10 AS ret FROM c0) WHERE ret IS NOT NULL)",
    "cw AS (SELECT *, (1 / x) / sum(1 / x) OVER (PARTITION BY g) AS w FROM c)",
    "pr AS (SELECT g, year, avg(ret) AS a, sum(w * ret) AS b FROM cw GROUP BY 1, 2)",
]
put("xs_demean", "SELECT sym, g, round(ret - avg(ret) OVER (PARTITION BY g), 6) AS dm FROM c", *CELLS)
QUINT = "cq AS (SELECT *, greatest(1, ceil((row_number() OVER (PARTITION BY g ORDER BY x, sym) - 1) * 5 / greatest(count(*) OVER (PARTITION BY g) - 1, 1)))::INT AS q FROM c)"
put("quintile_table", "SELECT q, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM cq GROUP BY q", *CELLS, QUINT)
put(
    "quintile_spread",
    "SELECT year, round(avg(ret) FILTER (x > e[2]) - avg(ret) FILTER (x <= e[1]), 6) AS spread FROM c JOIN (SELECT year, quantile_cont(x, [0.2, 0.8]) AS e FROM c GROUP BY year) USING (year) GROUP BY year",
    *CELLS,
)
put(
    "spearman_ic",
    "SELECT year, round(CASE WHEN count(*) >= 30 THEN corr(a, b) END, 6) AS ic, count(*) AS n FROM (SELECT year, row_number() OVER (PARTITION BY year ORDER BY x, g * 100 + sym)::DOUBLE AS a, row_number() OVER (PARTITION BY year ORDER BY ret, g * 100 + sym)::DOUBLE AS b FROM c) GROUP BY year",
    *CELLS,
)
put_bars(
    "neighbor_dispersion",
    f"SELECT q_symbol, q_t0, {r('avg(fwd_ret) AS mean', 'avg((fwd_ret >= 0.05)::INT) AS hit_rate', 'stddev_pop(fwd_ret) AS dispersion')}, count(*) AS n FROM {ranked('d', 40, 'rank', 'c_t1 <= q_t0 OR c_t0 >= q_t1')} WHERE fwd_ret IS NOT NULL GROUP BY 1, 2",
    *WIN_VEC,
    *DIST,
)
put("inv_vol_portfolio", f"SELECT g, {r('sum(w * ret) AS ret', '1 / sum(w * w) AS effective_n', 'max(w) AS max_weight')}, count(*) AS n FROM cw GROUP BY g", *CELLS)
put("equal_weight_portfolio", "SELECT g, round(avg(ret) FILTER (q = 5), 6) AS ret, count(*) FILTER (q = 5) AS n FROM cq GROUP BY g HAVING count(*) FILTER (q = 5) >= 2", *CELLS, QUINT)
put(
    "exposure_scale",
    "SELECT g, round(s / avg(s) OVER (), 6) AS scale FROM (SELECT g, exp(greatest(-1.5, least(1.5, avg(ln(m)) OVER () - ln(m)))) AS s FROM (SELECT g, quantile_cont(x, 0.5) AS m FROM c GROUP BY g))",
    *CELLS,
)
put("exposure_inverse", "SELECT g, round(s / avg(s) OVER (), 6) AS scale FROM (SELECT g, avg(1 / x) AS s FROM c WHERE x > 0 GROUP BY g)", *CELLS)
SCHEMES = """sc AS (SELECT g, year, 'equal' AS scheme, a AS ret FROM pr UNION ALL SELECT g, year, 'inverse', b FROM pr),
nv AS (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY g) - 1 AS i, exp(sum(ln(1 + ret)) OVER (PARTITION BY scheme ORDER BY g)) AS nav FROM sc),
dn AS (SELECT *, nav / max(nav) OVER (PARTITION BY scheme ORDER BY g) - 1 AS drawdown FROM nv)"""
THIN = "ret) FILTER (i % 5 = 0)"
put(
    "sharpe_table",
    "SELECT scheme, count(*) AS n, "
    + r(
        "avg(ret) * 52 AS annual_ret",
        "stddev_pop(ret) * sqrt(52) AS annual_vol",
        "avg(ret) / stddev_pop(ret) * sqrt(52) AS sharpe",
        "min(drawdown) AS max_drawdown",
        "avg((ret > 0)::INT) AS win_rate",
        "avg(ret) / stddev_pop(ret) * sqrt(count(*)) AS t",
        f"avg({THIN} / stddev_pop({THIN} * sqrt(count({THIN}) AS t_thin",
    )
    + " FROM dn GROUP BY scheme",
    *CELLS,
    SCHEMES,
)
put(
    "scheme_coverage",
    f"""SELECT s.scheme, round(avg(ret) / stddev_pop(ret) * sqrt(52), 6) AS sharpe, round(any_value(holdings), 6) AS holdings, any_value(periods) AS periods FROM dn s JOIN
  (SELECT 'inverse' AS scheme, avg(n) AS holdings, count(*) AS periods FROM (SELECT 1 / sum(w * w) AS n FROM cw GROUP BY g) UNION ALL SELECT 'equal', avg(n), count(*) FROM (SELECT count(*) AS n FROM cw GROUP BY g)) h USING (scheme) GROUP BY s.scheme""",
    *CELLS,
    SCHEMES,
)
put("drawdown", f"SELECT scheme, g, {r('nav', 'drawdown')} FROM dn", *CELLS, SCHEMES)
put("by_year", "SELECT year, round(a, 6) AS equal, round(b, 6) AS inverse, (a > 0)::INT + (b > 0)::INT AS positive FROM (SELECT year, sum(a) AS a, sum(b) AS b FROM pr GROUP BY year)", *CELLS)


def draws(seed: str, reps: int) -> str:
    return f"""ix AS (SELECT row_number() OVER (ORDER BY g) - 1 AS i, a, b FROM pr), nn AS (SELECT count(*) AS n FROM ix),
st AS (SELECT rep, n, j, ('0x' || substr(md5('{seed}-' || rep || '-' || j), 1, 8))::BIGINT % n AS start FROM (SELECT n, unnest(range({reps})) AS rep FROM nn), LATERAL (SELECT unnest(range(ceil(n / 10)::INT)) AS j)),
bs AS (SELECT rep, a, b FROM (SELECT rep, start + unnest(range(10)) AS i FROM st) JOIN ix USING (i))"""


_SH = "(avg(b) / stddev_pop(b) - avg(a) / stddev_pop(a)) * sqrt(52)"
put(
    "block_bootstrap_sharpe",
    f"SELECT (SELECT round({_SH}, 6) FROM ix) AS diff, {r('stddev_pop(d) AS se', '2 * least(avg((d <= 0)::INT), avg((d >= 0)::INT)) AS p')} FROM (SELECT rep, {_SH} AS d FROM bs GROUP BY rep)",
    *CELLS,
    draws("bst", 1000),
)
put(
    "block_bootstrap_mean",
    "SELECT round(m, 6) AS mean, round(se, 6) AS se, round(m / se, 6) AS t FROM (SELECT avg(b - a) AS m FROM ix), (SELECT stddev_pop(d) AS se FROM (SELECT rep, avg(b - a) AS d FROM bs GROUP BY rep))",
    *CELLS,
    draws("bsm", 2000),
)
put(
    "random_k_portfolio",
    f"SELECT rep, {r('avg(m) AS mean', 'stddev_pop(m) AS sd')} FROM (SELECT rep, g, avg(ret) AS m FROM (SELECT rep, g, ret, row_number() OVER (PARTITION BY rep, g ORDER BY md5('rk-' || rep || '-' || g || '-' || sym), sym) AS k FROM c, range(300) t(rep)) WHERE k <= 5 GROUP BY 1, 2) GROUP BY rep",
    *CELLS,
)
put(
    "fixed_k_control",
    f"""SELECT any_value(periods) AS periods, {r('any_value(scheme) AS scheme', 'quantile_cont(s, 0.5) AS fixed', 'quantile_cont(s, 0.05) AS fixed_p05', 'quantile_cont(s, 0.95) AS fixed_p95', 'avg((s < scheme)::INT) AS rank', 'any_value(rotated) AS rotated')}
  FROM (SELECT rep, avg(r) / stddev_pop(r) * sqrt(52) AS s FROM (SELECT rep, g, avg(ret) AS r FROM c JOIN ks USING (sym) WHERE g IN (SELECT g FROM sch) GROUP BY rep, g) GROUP BY rep),
  (SELECT count(*) AS periods, avg(r) / stddev_pop(r) * sqrt(52) AS scheme FROM sch), (SELECT avg(r) / stddev_pop(r) * sqrt(52) AS rotated FROM (SELECT g, avg(ret) AS r FROM dw WHERE n <= 5 AND m >= 5 GROUP BY g))""",
    *CELLS,
    QUINT,
    "sch AS (SELECT g, avg(ret) AS r FROM cq WHERE q = 5 GROUP BY g)",
    "ks AS (SELECT * FROM (SELECT sym, rep, row_number() OVER (PARTITION BY rep ORDER BY md5('fk-' || rep || '-' || sym), sym) AS n FROM (SELECT DISTINCT sym FROM c), range(300) t(rep)) WHERE n <= 5)",
    "dw AS (SELECT g, ret, row_number() OVER (PARTITION BY g ORDER BY md5('fk-each-' || g || '-' || sym), sym) AS n, count(*) OVER (PARTITION BY g) AS m FROM c WHERE g IN (SELECT g FROM sch))",
)
put(
    "perm_control",
    "SELECT a.g, round(sum(b.w * a.ret), 6) AS ret FROM (SELECT g, ret, row_number() OVER (PARTITION BY g ORDER BY sym) AS n FROM cw) a JOIN (SELECT g, w, row_number() OVER (PARTITION BY g ORDER BY md5('pc-' || g || '-' || sym), sym) AS n FROM cw) b USING (g, n) GROUP BY a.g",
    *CELLS,
)

# events and simulation


def _wick(side: str) -> str:
    s, e, best, worst = ("", "low", "h", "l") if side == "down" else ("-", "high", "l", "h")
    moves = ", ".join(f"{s}({p}{h} - {e}) / {e} AS {k}_{h}" for h in (15, 60) for k, p in (("mfe", best), ("mae", worst), ("ret", "c")))
    backs = ", ".join(f"{s}(c{h} - pre_close) / pre_close AS back_{h}" for h in (15, 60))
    return f"""SELECT symbol, open_time, pre_close, close, qv, '{side}' AS side, {e} AS entry, {s}(pre_close - {e}) / pre_close AS dev,
  CASE WHEN {s}(pre_close - {e}) > 0 THEN {s}(close - {e}) / ({s}(pre_close - {e})) ELSE 1 END AS recover, {moves}, {backs} FROM wk WHERE {e} > 0"""


_AHEAD = ", ".join(f"{f} OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) AS {k}{h}" for h in (15, 60) for k, f in (("h", "max(high)"), ("l", "min(low)"), ("c", "last_value(close)")))
WICKS = f"""wk AS (SELECT * FROM (SELECT *, coalesce(lag(close) OVER ({W}), open) AS pre_close, row_number() OVER ({W}) - 1 AS rn, lead(close) OVER ({W}) AS nxt, {_AHEAD} FROM b)
  WHERE nxt IS NOT NULL AND rn >= 60 AND qv >= 100 AND pre_close > 0),
ev AS (SELECT w.*, level, recover >= 0.5 AS rec_ok FROM ({_wick('down')} UNION ALL {_wick('up')}) w, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) l(level) WHERE dev >= level),
mw AS (SELECT *, count(*) OVER (PARTITION BY side, level ORDER BY open_time RANGE BETWEEN {2 * HOUR} PRECEDING AND {2 * HOUR} FOLLOWING) AS around FROM ev)"""
put_bars("wick_events", f"SELECT symbol, side, open_time, level, rec_ok, {r('entry', 'pre_close', 'dev', 'recover', 'mfe_15', 'mae_15', 'ret_15', 'back_15', 'mfe_60', 'mae_60', 'ret_60', 'back_60')} FROM ev", WICKS)
put_bars("wick_marketwide", "SELECT symbol, side, open_time, level, around, around >= 5 AS mw FROM mw", WICKS)
put_bars(
    "wick_marketwide_symbols",
    f"SELECT e.symbol, e.side, e.open_time, e.level, count(DISTINCT o.symbol) AS around, count(DISTINCT o.symbol) >= 4 AS mw FROM ev e JOIN ev o ON o.level = e.level AND o.side = e.side AND abs(o.open_time - e.open_time) <= {2 * HOUR} GROUP BY 1, 2, 3, 4",
    WICKS,
)
_COMPARED = f"count(*) AS n, {r('avg(least(1, greatest(-1, ret_15))) AS mean_ret', 'quantile_cont(ret_15, 0.5) AS median_ret', 'quantile_cont(mfe_15, 0.5) AS median_mfe', 'quantile_cont(mae_15, 0.5) AS median_mae', 'avg((ret_15 > 0)::INT) AS gains')}"
put_bars("wick_recover_table", f"SELECT side, level, rec_ok, {_COMPARED} FROM ev GROUP BY side, level, rec_ok", WICKS)
put_bars("wick_marketwide_table", f"SELECT side, level, around >= 5 AS mw, {_COMPARED} FROM mw GROUP BY 1, 2, 3", WICKS)
put_bars("wick_days", f"SELECT DISTINCT symbol, open_time // {DAY} AS day FROM ev WHERE level > 0.9 AND rec_ok AND side = 'down'", WICKS)
CAND = f"""cd AS (SELECT symbol, rn, open_time AS t0, entry, fc / entry - 1 AS ret, fh / entry - 1 AS mfe, fl / entry - 1 AS mae FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS len,
  CASE WHEN count(*) OVER h = 12 THEN max(close) OVER h END * (1 - 0.9::DOUBLE) AS entry, lead(close, 6) OVER ({W}) AS fc, max(high) OVER f AS fh, min(low) OVER f AS fl FROM b
  WINDOW h AS ({W} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING), f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)) WHERE high > entry AND low <= entry AND rn + 7 < len)"""
TRADES = [
    CAND,
    "pick AS (SELECT symbol, min(rn) AS rn FROM cd GROUP BY symbol UNION ALL SELECT p.symbol, (SELECT min(rn) FROM cd WHERE cd.symbol = p.symbol AND cd.rn >= p.rn + 6) AS rn FROM pick p WHERE p.rn IS NOT NULL)",
    "tr AS (SELECT cd.* FROM cd JOIN pick USING (symbol, rn))",
]
put_bars("limit_backtest", f"SELECT symbol, rn::INT AS rn, t0, {r('entry', 'ret', 'mfe', 'mae')} FROM cd", CAND)
put_bars("greedy_nonoverlap", f"SELECT symbol, rn::INT AS rn, t0, {r('ret')} FROM tr", *TRADES, recursive=True)
SUMMARY = f"""us AS (SELECT symbol, max(open_time) - min(open_time) FILTER (rn = 12) AS span_ms FROM (SELECT *, row_number() OVER ({W}) - 1 AS rn FROM b) GROUP BY symbol),
sm AS (SELECT symbol, count(*) AS n, avg(ret) AS mean_ret, quantile_cont(ret, 0.5) AS median_ret, quantile_cont(mfe, 0.5) AS median_mfe, quantile_cont(mae, 0.5) AS median_mae,
  count(*) FILTER (ret > 0) AS wins FROM tr GROUP BY symbol),
lr AS (SELECT symbol, max(k) AS losing_run FROM (SELECT symbol, g, count(*) FILTER (ret < 0) AS k FROM (SELECT *, sum((ret >= 0)::INT) OVER (PARTITION BY symbol ORDER BY t0) AS g FROM tr) GROUP BY 1, 2) GROUP BY symbol)"""
put_bars("trade_summary", f"SELECT symbol, n, {r('mean_ret', 'median_ret', 'median_mfe', 'median_mae')}, wins, span_ms, losing_run FROM sm JOIN lr USING (symbol) JOIN us USING (symbol)", *TRADES, SUMMARY, recursive=True)
put_bars(
    "cost_ladder",
    f"""SELECT {r('raw', 'raw - 0.002 AS after_fee', 'raw - 0.002 - 0.0025 AS after_all')}, trades, {r('per_year', 'per_year * (raw - 0.002 - 0.0025) AS annual')}
  FROM (SELECT avg(mean_ret) AS raw, sum(n)::BIGINT AS trades, sum(n) / (sum(span_ms) / {365 * DAY}) AS per_year FROM sm JOIN us USING (symbol))""",
    *TRADES,
    SUMMARY,
    recursive=True,
)
put_bars(
    "tail_share",
    f"""SELECT symbol, any_value(n) AS n, {r('CASE WHEN sum(ret) > 0 AND any_value(n) >= 10 THEN sum(ret) FILTER (dn <= greatest(1, floor(n * 0.1))) / sum(ret) END AS tail_share', 'CASE WHEN any_value(n) >= 20 THEN quantile_cont(ret, 0.05) END AS q05',
    'CASE WHEN any_value(n) >= 20 THEN avg(ret) FILTER (up <= greatest(1, n // 20)) END AS worst_mean', 'avg(ret) FILTER (ret > 0) / abs(avg(ret) FILTER (ret < 0)) AS payoff', *(f'quantile_cont(ret, {p / 100}) AS p{p}' for p in (5, 25, 50, 75, 95)))},
  CASE WHEN avg(ret) > quantile_cont(ret, 0.5) THEN 'right' ELSE 'left' END AS skew
  FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC, t0) AS dn, row_number() OVER (PARTITION BY symbol ORDER BY ret, t0) AS up FROM tr) GROUP BY symbol""",
    *TRADES,
    recursive=True,
)
put_bars(
    "random_entries",
    f"""SELECT symbol, n, round(rr, 6) AS random_ret, round(hr, 6) AS hold_ret FROM (SELECT symbol, count(*) AS n, avg(later / close - 1) AS rr FROM (SELECT e.*, row_number() OVER (PARTITION BY e.symbol ORDER BY md5('re-' || e.symbol || '-' || open_time), open_time) AS i, k
  FROM (SELECT *, lead(close, 6) OVER ({W}) AS later FROM b) e JOIN (SELECT symbol, count(*) * 3 AS k FROM tr GROUP BY symbol) q ON q.symbol = e.symbol WHERE later IS NOT NULL) WHERE i <= k GROUP BY symbol)
  JOIN (SELECT symbol, arg_max(close, open_time) / arg_min(close, open_time) - 1 AS hr FROM b GROUP BY symbol) USING (symbol)""",
    *TRADES,
    recursive=True,
)
put_bars(
    "random_control",
    """SELECT round(any_value(rule), 6) AS rule, round(avg(m), 6) AS control, round(avg((m < rule)::INT), 6) AS rank FROM (SELECT rep, avg(ret) AS m, any_value(rule) AS rule FROM (SELECT rep, ret, k, rule, row_number() OVER (PARTITION BY rep ORDER BY md5('rc-' || rep || '-' || id), id) AS n
  FROM (SELECT symbol || '-' || t0 AS id, ret FROM tr), range(400) t(rep), (SELECT count(*) FILTER (mae > -0.9) AS k, avg(ret) FILTER (mae > -0.9) AS rule FROM tr)) WHERE n <= k GROUP BY rep)""",
    *TRADES,
    recursive=True,
)
FILL = """od AS (SELECT symbol, side, open_time * 1000 AS t, CASE side WHEN 'down' THEN pre_close * (1 - level) ELSE pre_close * (1 + level) END AS lim, dev, pre_close AS pre FROM ev WHERE level = 0.8),
nr AS (SELECT od.*, us, id, price, CASE side WHEN 'down' THEN price <= lim ELSE price >= lim END AS hit FROM od JOIN ticks USING (symbol) WHERE price > 0 AND us BETWEEN t - 300000000 AND t + 3600000000),
tc AS (SELECT symbol, side, t, lim, count(*) AS seen, min(us) FILTER (hit) AS fus, first(id ORDER BY us, id) FILTER (hit) AS fid, first(price ORDER BY us, id) FILTER (hit) AS fp FROM nr GROUP BY 1, 2, 3, 4),
rs AS (SELECT od.*, fus, fid, fp, CASE WHEN dev > 50 THEN 'too_far' WHEN coalesce(seen, 0) < 2 THEN 'few_ticks' WHEN fus IS NULL THEN 'untouched' ELSE '' END AS reason FROM od LEFT JOIN tc USING (symbol, side, t, lim)),
fl AS (SELECT *, CASE WHEN reason = '' THEN CASE side WHEN 'down' THEN least(lim, fp) ELSE greatest(lim, fp) END END AS fill FROM rs)"""
put_bars(
    "tick_fill",
    f"""SELECT symbol, side, t, round(lim, 6) AS "limit", reason = '' AS filled, reason, CASE WHEN reason = '' THEN fus END AS fill_us, {r("fill", "CASE side WHEN 'down' THEN lim - fill ELSE fill - lim END / lim AS slippage")} FROM fl""",
    WICKS,
    FILL,
)
put_bars("fill_reasons", "SELECT side, CASE reason WHEN '' THEN 'filled' ELSE reason END AS what, count(*) AS n FROM fl GROUP BY 1, 2", WICKS, FILL)
put_bars(
    "fill_horizons",
    "SELECT symbol, side, t, round(lim, 6) AS \"limit\", "
    + r(*(e for h in (2, 5) for e in (f"max(m) FILTER (n BETWEEN 1 AND {h}) AS mfe_{h}", f"CASE WHEN count(*) FILTER (n BETWEEN 1 AND {h}) > 0 THEN least(0, min(m) FILTER (n BETWEEN 1 AND {h})) END AS mae_{h}", f"arg_max(m, n) FILTER (n BETWEEN 1 AND {h}) AS ret_{h}")))
    + """, min(us) FILTER (CASE side WHEN 'down' THEN price >= pre ELSE price <= pre END) - any_value(fus) AS recovery_us, count(*) FILTER (n < 3 AND CASE side WHEN 'down' THEN price <= lim ELSE price >= lim END) AS deep_ticks
  FROM (SELECT fl.*, us, price, CASE fl.side WHEN 'down' THEN price - fill ELSE fill - price END / fill AS m, row_number() OVER (PARTITION BY fl.symbol, fl.side, t, lim ORDER BY us, id) - 1 AS n
    FROM fl JOIN ticks USING (symbol) WHERE reason = '' AND price > 0 AND (us > fus OR us = fus AND id >= fid) AND us <= t + 3600000000) GROUP BY symbol, side, t, lim""",
    WICKS,
    FILL,
)
TOUCH = f"""hr AS (SELECT symbol, open_time // {6 * HOUR} AS h, open, a FROM (SELECT symbol, open_time, open, lag(CASE WHEN rn >= 13 THEN y END) OVER ({W}) AS a FROM atr) WHERE a IS NOT NULL),
gr AS (SELECT s.*, r.* FROM (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) s(stop), (VALUES (1.0::DOUBLE), (2.0::DOUBLE)) r(reward)),
oc AS (SELECT symbol, h, stop, reward, min(us) FILTER (price <= open - stop * a) AS s, min(us) FILTER (price >= open + stop * reward * a) AS t FROM ticks t JOIN hr USING (symbol), gr WHERE us // {6 * HOUR * 1000} = h GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5),
ou AS (SELECT symbol, h, stop, reward, CASE WHEN s IS NULL AND t IS NULL THEN 'none' WHEN t IS NULL THEN 'stop' WHEN s IS NULL THEN 'target' WHEN s <= t THEN 'stop_first' ELSE 'target_first' END AS outcome FROM oc)"""
put_bars("stop_target_order", "SELECT * FROM ou", TR, ATR, TOUCH, hours=6, recursive=True)


def _share(*k: str) -> str:
    return f"avg((outcome IN ({', '.join(repr(x) for x in k)}))::INT)"


BOTH = _share("stop_first", "target_first")
put_bars(
    "ambiguity_grid",
    "SELECT stop, reward, count(*) AS n, "
    + r(
        f"{BOTH} AS ambiguous",
        f"reward * {_share('target', 'target_first')} - {_share('stop', 'stop_first')} AS exp_true",
        f"reward * {_share('target')} - {_share('stop')} - {BOTH} AS exp_worst",
        f"reward * ({_share('target')} + {BOTH}) - {_share('stop')} AS exp_best",
    )
    + " FROM ou GROUP BY stop, reward",
    TR,
    ATR,
    TOUCH,
    hours=6,
    recursive=True,
)
BREADTH = f"bd AS (SELECT open_time, count(*) FILTER (x < -0.02) AS falling, count(*) FILTER (qv > 0) AS trading FROM (SELECT *, coalesce(close / lag(close) OVER ({W}) - 1, 0) AS x FROM b) GROUP BY open_time)"
put_bars("breadth_minute", "SELECT open_time, falling, trading, round(falling / nullif(trading, 0), 6) AS share FROM bd", BREADTH)
put_bars(
    "pretrade_features",
    'SELECT tr.symbol, tr.t0, round(drop_, 6) AS "drop", round(vol, 6) AS vol, round(qv / med_qv, 6) AS vol_ratio, round(below_ath, 6) AS below_ath, coalesce(falling, 0) AS breadth, round(falling / nullif(trading, 0), 6) AS breadth_pct FROM tr JOIN tf ON tf.symbol = tr.symbol AND tf.open_time = tr.t0 LEFT JOIN bd ON bd.open_time = tr.t0 WHERE prior >= 48',
    *TRADES,
    trail(12, 48, 24, 24, 10),
    BREADTH,
    recursive=True,
)
FEAT = [
    panel(),
    """f0 AS (SELECT *, coalesce(close / lag(close) OVER (PARTITION BY sym ORDER BY day) - 1, 0) AS r1 FROM p),
bd AS (SELECT day, count(*) FILTER (r1 < -0.02) AS breadth, count(*) FILTER (r1 < -0.02) / count(*) AS breadth_pct FROM f0 GROUP BY day),
ft AS (SELECT f.*, breadth, breadth_pct, sym || '-' || day AS id, year(DATE '1970-01-01' + day::INT) AS year FROM (SELECT sym, day, lead(close) OVER o / close - 1 AS ret, close / lag(close, 5) OVER o - 1 AS drop_, dvol / quantile_cont(dvol, 0.5) OVER (PARTITION BY sym ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS vol_ratio,
  CASE WHEN count(*) OVER v >= 20 THEN stddev_samp(r1) OVER v END AS vol, close / max(close) OVER (PARTITION BY sym ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS below FROM f0 WINDOW o AS (PARTITION BY sym ORDER BY day), v AS (PARTITION BY sym ORDER BY day ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) f
  JOIN bd USING (day) WHERE ret IS NOT NULL AND drop_ IS NOT NULL AND vol_ratio IS NOT NULL AND vol IS NOT NULL)""",
]
TH = "quantile_cont(vol, 0.75) AS th_vol, quantile_cont(drop_, 0.75) AS th_drop, quantile_cont(breadth, 0.25) AS th_breadth, quantile_cont(breadth_pct, 0.25) AS th_breadth_pct, count(*) AS past"
RULE = {
    "calm": "vol < th_vol",
    "deep": "drop_ < th_drop",
    "together": "breadth_pct >= th_breadth_pct",
    "together_count": "breadth >= th_breadth",
    "calm_deep": "vol < th_vol AND drop_ < th_drop",
    "all": "vol < th_vol AND drop_ < th_drop AND breadth_pct >= th_breadth_pct",
}
MASKS = f"unnest([{', '.join(repr(k) for k in RULE)}]) AS rule, unnest([{', '.join(RULE.values())}]) AS keep"
JUDGED = f"""count(*) AS n, count(*) FILTER (keep) AS kept, {r('avg(ret - 0.002 - 0.0025) AS base_net', 'avg(ret - 0.002 - 0.0025) FILTER (keep) AS rule_net', 'avg((ret <= -0.5)::INT) AS base_loss', 'avg((ret <= -0.5)::INT) FILTER (keep) AS rule_loss',
  'CASE WHEN count(*) FILTER (keep) >= 20 THEN quantile_cont(ret, 0.05) FILTER (keep) END AS rule_q05')}, avg((ret <= -0.5)::INT) FILTER (keep) AS rl"""


def control(by: str, seed: str, reps: int) -> str:
    return f"""nk AS (SELECT {by}, count(*) FILTER (keep) AS k, count(*) AS total, avg((ret <= -0.5)::INT) FILTER (keep) AS loss FROM pool GROUP BY {by}),
cs AS (SELECT {by}, rep, avg((ret <= -0.5)::INT) AS bl, avg(ret - 0.002 - 0.0025) AS net, any_value(loss) AS loss FROM (SELECT {by}, rep, ret, k, loss, row_number() OVER (PARTITION BY {by}, rep ORDER BY md5('{seed}-' || rep || '-' || id), id) AS i
  FROM pool JOIN nk USING ({by}), range({reps}) t(rep) WHERE k > 0 AND k < total) WHERE i <= k GROUP BY {by}, rep),
ct AS (SELECT {by}, quantile_cont(bl, 0.5) AS c50, quantile_cont(bl, 0.05) AS c05, {r('quantile_cont(bl, 0.5) AS control_loss', 'quantile_cont(bl, 0.05) AS control_loss_p05', 'quantile_cont(net, 0.5) AS control_net', 'avg((bl < loss)::INT) AS rank')} FROM cs GROUP BY {by}),
jd AS (SELECT {by}, {JUDGED} FROM pool GROUP BY {by})"""


put("rule_thresholds", f"SELECT {r('th_vol', 'th_drop', 'th_breadth', 'th_breadth_pct')}, past FROM (SELECT {TH} FROM ft WHERE year <= 1995)", *FEAT)
put("rule_masks", f"SELECT rule, count(*) AS n, count(*) FILTER (keep) AS kept FROM (SELECT {MASKS} FROM ft, (SELECT {TH} FROM ft WHERE year <= 1995) WHERE year > 1995) GROUP BY rule", *FEAT)
put(
    "split_evaluation",
    "SELECT jd.* EXCLUDE (rl), ct.* EXCLUDE (rule, c50, c05), kept >= 0.995 * n AS inactive FROM jd LEFT JOIN ct USING (rule) WHERE n >= 200 AND kept >= 50",
    *FEAT,
    f"pool AS (SELECT id, ret, {MASKS} FROM ft, (SELECT {TH} FROM ft WHERE year <= 1995) WHERE year > 1995 AND past >= 200)",
    control("rule", "se", 100),
)
put(
    "walkforward_years",
    "SELECT jd.* EXCLUDE (rl), ct.* EXCLUDE (year, c50, c05) FROM jd JOIN ct USING (year) WHERE n >= 150 AND kept >= 50 AND kept < 0.995 * n",
    *FEAT,
    f"th AS (SELECT y, {TH} FROM (SELECT DISTINCT year AS y FROM ft) q JOIN ft ON ft.year < y GROUP BY y HAVING count(*) >= 500)",
    f"pool AS (SELECT id, ret, year, coalesce({RULE['all']}, false) AS keep FROM ft JOIN th ON th.y = ft.year)",
    control("year", "wf", 100),
)
put(
    "cut_grid",
    "SELECT jd.* EXCLUDE (rl), ct.* EXCLUDE (cut, c50, c05), CASE WHEN rl < c05 THEN 'beats' WHEN rl < c50 THEN 'better' ELSE 'no' END AS verdict FROM jd JOIN ct USING (cut) WHERE n >= 150 AND kept >= 50 AND kept < 0.995 * n",
    *FEAT,
    f"th AS (SELECT cut, {TH} FROM (VALUES (1993), (1994), (1995), (1996)) v(cut) JOIN ft ON ft.year <= cut GROUP BY cut HAVING count(*) >= 500)",
    f"pool AS (SELECT id, ret, cut, coalesce({RULE['all']}, false) AS keep FROM ft JOIN th ON ft.year > cut AND ft.year <= cut + 3)",
    control("cut", "cg", 100),
)
_FILTERS = {"none": "true", "calm": "vol < e_vol", "far_from_high": "below < e_below", "deep": "drop_ < e_drop", "quiet_volume": "vol_ratio < e_vr", "crowd": "breadth > e_breadth", "crowd_calm": "breadth > e_breadth AND vol < e_vol", "calm_deep": "vol < e_vol AND drop_ < e_drop"}
put(
    "candidate_filters",
    f"""SELECT filter, n, {r('net', 'big_loss', 'q05', 'annual')}, filter = (SELECT filter FROM g ORDER BY annual DESC, filter DESC LIMIT 1) AS best, filter = (SELECT filter FROM g ORDER BY big_loss, filter LIMIT 1) AS safest FROM g""",
    *FEAT,
    "ed AS (SELECT quantile_cont(vol, 0.75) AS e_vol, quantile_cont(below, 0.75) AS e_below, quantile_cont(drop_, 0.75) AS e_drop, quantile_cont(vol_ratio, 0.75) AS e_vr, quantile_cont(breadth, 0.75) AS e_breadth, count(*) AS total FROM ft)",
    f"""g AS (SELECT filter, count(*) AS n, avg(ret - 0.002 - 0.0025) AS net, avg((ret <= -0.5)::INT) AS big_loss, quantile_cont(ret, 0.05) AS q05, avg(ret - 0.002 - 0.0025) * 6.7 * count(*) / any_value(total) AS annual
  FROM (SELECT ret, total, unnest([{', '.join(repr(k) for k in _FILTERS)}]) AS filter, unnest([{', '.join(_FILTERS.values())}]) AS keep FROM ft, ed) WHERE keep GROUP BY filter HAVING count(*) >= 30)""",
)
put(
    "feature_extremes",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {r(f'avg((ret <= -0.5)::INT) FILTER ({c} <= e[1]) AS low_quarter', f'avg((ret <= -0.5)::INT) FILTER ({c} >= e[2]) AS high_quarter')} FROM ft, (SELECT quantile_cont({c}, [0.25, 0.75]) AS e FROM ft)"
        for n, c in (("drop", "drop_"), ("vol_ratio", "vol_ratio"), ("below", "below"), ("vol", "vol"), ("breadth_pct", "breadth_pct"))
    ),
    *FEAT,
)

# incremental and streaming

put_bars(
    "missing_days",
    f"SELECT symbol, unnest(range(l + 1, 19741)) AS day FROM (SELECT symbol, max(open_time // {DAY}) AS l FROM b WHERE open_time < 1705000000000 GROUP BY symbol) WHERE (SELECT max(open_time // {DAY}) FROM b WHERE open_time < 1705000000000) - l <= 3",
)
put_bars("touched_refresh", "SELECT symbol, count(DISTINCT island) AS islands, count(*) AS bars FROM i GROUP BY symbol", STEP, ISLANDS)
ORACLES["verify_seven"] = "SELECT unnest(['unique', 'order', 'blocks', 'not_fewer', 'none_lost', 'same_vectors', 'same_labels', 'complete', 'old_liquidity', 'coverage']) AS \"check\", 0::BIGINT AS bad"
put_bars("closed_bar_stream", f"SELECT symbol, open_time, open, high, low, close, {r('qv')}, n FROM b WHERE (open_time + {HOUR}) * 1000 <= (SELECT max(us) // 1000 * 1000 FROM ticks) - 600000000")

# sources

put(
    "json_klines",
    f"SELECT symbol, open_time, open_time + {DAY} - 1 AS close_time, {r('close', 'qv AS quote_volume')}, n AS trades, 0.0::DOUBLE AS taker_buy_quote FROM b",
    TICKS,
    bars(24),
)
put(
    "archive_round_trip",
    f"SELECT symbol, '2024-01' AS month, open_time, open_time + {DAY} - 1 AS close_time, {r('open', 'close', 'qv AS quote_volume')}, n AS trades FROM b",
    TICKS,
    bars(24),
)
put_bars(
    "fetch_day_rows",
    f"""SELECT symbol, open_time, round(close, 6) AS close FROM b JOIN (SELECT symbol, max(open_time // {DAY}) AS l FROM b WHERE open_time < 1705000000000 GROUP BY symbol) USING (symbol)
  WHERE open_time // {DAY} > l AND open_time // {DAY} <= 19740 AND (SELECT max(open_time // {DAY}) FROM b WHERE open_time < 1705000000000) - l <= 3""",
)
put_bars("closed_klines", f"SELECT symbol, open_time, open_time + {HOUR} - 1 AS close_time FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k, count(*) OVER (PARTITION BY symbol) AS c FROM b WHERE open_time + {HOUR} - 1 < 1705000000000) WHERE k <= 30 AND c >= 30")
put("symbol_spec", "SELECT DISTINCT upper(event_type) AS symbol FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW')")
put(
    "newest_archives",
    f"SELECT symbol, symbol || '-1d-' || strftime(make_timestamp(max(open_time) * 1000), '%Y-%m-%d') || '.zip' AS key, max(open_time // {DAY})::INT AS day FROM b WHERE open_time // {DAY} <= 19740 AND open_time // {DAY} > 19732 GROUP BY symbol",
    TICKS,
    bars(24),
)
put_bars("staged_refresh", "SELECT i AS step, d AS done, CASE WHEN i < 2 THEN (SELECT count(*) FROM b WHERE symbol <> 'click') ELSE (SELECT count(*) FROM b) END AS n, true AS complete FROM (VALUES (0, 'made'), (1, 'kept'), (2, 'made')) v(i, d)")
put("props_json", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE (props::JSON->>'k') IS NOT NULL")
put(
    "utc_strings",
    "SELECT symbol, open_time, strftime(make_timestamp(open_time * 1000), '%Y-%m-%d %H:%M') AS utc, open_time AS parsed, year(make_timestamp(open_time * 1000))::INT AS year, (year(make_timestamp(open_time * 1000)) * 12 + month(make_timestamp(open_time * 1000)) - (2023 * 12 + 11))::INT AS months FROM b",
    TICKS,
    bars(24),
)
put_bars("coin_counts", "SELECT symbol, count(*) AS n, any_value(s)::INT AS symbols, 0::BIGINT AS other FROM w, (SELECT count(DISTINCT symbol) AS s FROM w) GROUP BY symbol", windows(), hours=2)
put("interval_parse", "SELECT s, ms::BIGINT AS ms FROM (VALUES ('15m', 900000), ('1h', 3600000), ('4h', 14400000), ('1d', -1), ('h', -1), ('', -1)) t(s, ms)")
put("archive_months", "SELECT DISTINCT upper(event_type) || 'USDT-1m-' || strftime(ts, '%Y-%m') || '.zip' AS key, strftime(ts, '%Y-%m') AS month, upper(event_type) LIKE '%UP' AS leveraged FROM events")
