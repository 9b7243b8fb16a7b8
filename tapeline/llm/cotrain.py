"""Quality filter by co-training two views of a document.

One classifier sees the text (hashed tokens, token prefixes, character statistics), the other the page's
metadata (its values, their pairs). Over rounds each view labels, for the other, the documents of which it is
most confident, in the proportions of the classes; at the end both calibrated views are combined and all
documents scored. Two properties are judged: low quality and toxicity.

Labelled rows are dealt into three parts: one fits the views, one calibrates and combines them, one decides
which view may teach what and which round is kept. Texts are read once for the rounds: what the views need of a
document (some hundred bytes) is stored, and rounds read that.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import Store, prepare
from .linear import Linear, calibrated, fit, sigmoid

HEADS = ("low", "toxic")
BITS, PREFIXES = 20, (4, 5, 6)
#: Labelled rows that fit the classifiers, chosen by a hash of the id; the only bounded sample.
LABELLED = 4000
#: Hashed text features kept for each property, by strength of association.
FEATURES = 256
#: Of the unlabelled documents, the share that a view labels in a round for a property, and the least and the
#: greatest number: these rows come to the driver.
SHARE, FEWEST, MOST = 0.02, 50, 2000
#: A view may teach a value of which it is so sure, if so many of the deciding rows bear it out.
CONFIDENT, BORNE_OUT = 0.85, 10
META_BUCKETS = 64
#: Columns of statistics().
N_STATS = 16

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def statistics(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Character and repetition statistics of each text, all ratios or logarithms."""
    n = len(offsets) - 1
    size = np.diff(offsets)

    def per_row(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    wide = np.zeros(len(data), bool)  # upper-case letters of two bytes
    wide[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    upper = ((data >= 65) & (data <= 90)) | wide
    again = np.zeros(len(row), bool)
    again[1:] = (token[1:] == token[:-1]) & (row[1:] == row[:-1])
    tokens = np.bincount(row, minlength=n)
    chars, words = np.maximum(size, 1), np.maximum(tokens, 1)
    cols = [np.log1p(size), np.log1p(tokens), per_row(upper) / chars, per_row((data >= 48) & (data <= 57)) / chars, per_row(_PUNCT[data]) / words]
    cols += [per_row(data == c) / words for c in b"!|#$%&*<>\n"]
    cols.append(np.bincount(row, again, minlength=n) / words)
    return np.stack(cols, axis=1).astype(np.float64)


def text_rows(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, statistics, token row, 64-bit features), about a slice of text at a time."""
    data, offsets = kernels.buffers(col)
    for a, b in kernels.row_ranges(np.diff(offsets)):
        o, d = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        row, feats = kernels.token_features(d, o, PREFIXES)
        yield a, statistics(d, o, row, feats[0]), row, feats


def meta_codes(pdf: pd.DataFrame, numeric: list[str], nominal: list[str]) -> np.ndarray:
    """A bucket from 0 to META_BUCKETS - 1 for each column and each pair of columns.

    Nominal columns are hashed; numbers go by their logarithm; null and NaN are a bucket of their own.
    """
    own = [pd.util.hash_array(pdf[c].fillna("\0null").astype(str).to_numpy(object)).astype(np.int64) % META_BUCKETS for c in nominal]
    for c in numeric:
        x = pd.to_numeric(pdf[c], errors="coerce").to_numpy(float)
        finite = np.isfinite(x)
        level = np.where(finite, 1 + np.clip(np.floor(2 * np.log2(1 + np.abs(np.where(finite, x, 0)))), 0, META_BUCKETS - 2), 0)
        own.append(level.astype(np.int64))
    pairs = [(a * 1_000_003 + b * 7919 + 12345) % 1_000_033 % META_BUCKETS for a, b in itertools.combinations(own, 2)]
    return np.stack([*own, *pairs], axis=1) if own else np.zeros((len(pdf), 1), np.int64)


def one_hot(codes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(codes), codes.shape[1] * META_BUCKETS))
    for k in range(codes.shape[1]):
        out[np.arange(len(codes)), k * META_BUCKETS + codes[:, k]] = 1
    return out


class Model(NamedTuple):
    chosen: np.ndarray  # leading BITS of a feature -> column, or -1
    exact: np.ndarray  # the feature of each column
    mean: np.ndarray
    scale: np.ndarray
    text: dict[str, Linear]
    meta: dict[str, Linear]
    both: dict[str, Linear]
    base: dict[str, float]  # log odds of the property among the calibrating rows
    report: dict

    def hits(self, n: int, row: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """n rows of bool, a column for each chosen feature."""
        col = self.chosen[(feats >> np.uint64(64 - BITS)).astype(np.int64)]
        kind, at = np.nonzero(col >= 0)
        col = col[kind, at]
        same = self.exact[col] == feats[kind, at]
        x = np.zeros((n, len(self.exact)), bool)
        x[row[at[same]], col[same]] = True
        return x

    def matrix(self, hits: np.ndarray, stats: np.ndarray) -> np.ndarray:
        return np.hstack([hits, np.clip((stats - self.mean) / self.scale, -3, 3)])  # as far as labelled rows tell

    def views(self, x: np.ndarray, codes: np.ndarray, head: str) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log odds of the text view and of the metadata view."""
        m = self.meta[head]
        place = np.arange(codes.shape[1]) * META_BUCKETS + codes
        return self.text[head].score(x), m.slope * (m.weight[place].sum(axis=1) + m.bias) + m.shift

    def combined(self, text: np.ndarray, meta: np.ndarray, head: str) -> np.ndarray:
        """Probability of the property: what either view adds to the log odds of any document."""
        return sigmoid(self.both[head].score(np.stack([text, meta - self.base[head]], axis=1)))

    def judged(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """A column for each property."""
        return np.stack([self.combined(*self.views(x, codes, h), h) for h in HEADS], axis=1)


class _Rows(NamedTuple):
    """Documents as the views see them; y[h] is nan where nothing is known, w weighs the rows."""

    stats: np.ndarray
    bags: list[np.ndarray] | None
    hits: np.ndarray | None
    codes: np.ndarray
    y: dict[str, np.ndarray]
    w: np.ndarray


def _gold(t: pa.Table, numeric: list[str], nominal: list[str]) -> _Rows:
    stats, bags = [np.zeros((0, N_STATS))], []
    for _, s, row, feats in text_rows(t.column("text")):
        stats.append(s)
        cuts = np.searchsorted(row, np.arange(len(s) + 1))
        bags += [np.unique(feats[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    y = {h: t.column(h).to_numpy().astype(float) for h in HEADS}
    return _Rows(np.vstack(stats), bags, None, meta_codes(t.select([*numeric, *nominal]).to_pandas(), numeric, nominal), y, np.ones(len(t)))


def _common(bags: list[np.ndarray]) -> list[np.ndarray]:
    """The bags without features that surely are in fewer than 5 of them; keeps the driver's memory low."""
    count = np.zeros(1 << 22, np.int32)
    places = [(b >> np.uint64(42)).astype(np.int32) for b in bags]
    for p in places:
        count[p] += 1
    return [b[count[p] >= 5] for b, p in zip(bags, places, strict=True)]


def _choose(s: _Rows) -> tuple[np.ndarray, np.ndarray]:
    """The features that differ most between the classes, by the statistic of two proportions."""
    table, exact = np.full(1 << BITS, -1, np.int16), []
    if not s.bags:
        return table, np.zeros(0, np.uint64)
    bags = _common(s.bags)
    names, at = np.unique(np.concatenate(bags), return_inverse=True)
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    total = np.bincount(at, minlength=len(names))
    for h in HEADS:
        y = s.y[h]
        if y.min() == y.max():
            continue
        hit = np.bincount(at, y[doc], minlength=len(names))
        n1, n0 = y.sum(), len(y) - y.sum()
        p = total / len(y)
        z = np.abs(hit / n1 - (total - hit) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        z[total < 5] = 0
        for f in np.argsort(-z, kind="stable")[:FEATURES]:
            place = int(names[f] >> np.uint64(64 - BITS))
            if z[f] > 4 and table[place] < 0:  # a place holds its strongest feature
                table[place] = len(exact)
                exact.append(names[f])
    return table, np.array(exact, np.uint64)


def _blank(rows: _Rows) -> Model:
    chosen, exact = _choose(rows)
    mean, scale = (rows.stats.mean(axis=0), rows.stats.std(axis=0) + 1e-6) if len(rows.stats) else (np.zeros(N_STATS), np.ones(N_STATS))
    return Model(chosen, exact, mean, scale, {}, {}, {}, {}, {})


def _matrix(blank: Model, s: _Rows) -> np.ndarray:
    hits = s.hits
    if hits is None:
        row = np.repeat(np.arange(len(s.bags)), [len(b) for b in s.bags])
        hits = blank.hits(len(s.bags), row, np.concatenate(s.bags)[None, :] if s.bags else np.zeros((1, 0), np.uint64))
    return blank.matrix(hits, s.stats)


def _model(blank: Model, parts: list[_Rows], for_text: list[_Rows], for_meta: list[_Rows]) -> Model:
    """Both views fitted on the first part and on what the other view has labelled, calibrated and combined on the
    second, reported on the third."""
    train, scale, decide = parts
    xt, xs, xd = (_matrix(blank, s) for s in parts)
    pseudo_text = [_matrix(blank, s) for s in for_text]
    text, meta, both, base, report = {}, {}, {}, {}, {}
    out = blank._replace(text=text, meta=meta, both=both, base=base, report=report)
    for h in HEADS:

        def stacked(own: np.ndarray, others: list[np.ndarray], rows: list[_Rows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            known = [~np.isnan(r.y[h]) for r in rows]
            x = np.vstack([own, *(m[k] for m, k in zip(others, known, strict=True))])
            y = np.concatenate([train.y[h], *(r.y[h][k] for r, k in zip(rows, known, strict=True))])
            return x, y, np.concatenate([train.w, *(r.w[k] for r, k in zip(rows, known, strict=True))])

        x, y, w = stacked(xt, pseudo_text, for_text)
        text[h] = calibrated(fit(x, y, weight=w), xs, scale.y[h])
        x, y, w = stacked(one_hot(train.codes), [one_hot(r.codes) for r in for_meta], for_meta)
        meta[h] = calibrated(fit(x, y, l2=5.0, weight=w), one_hot(scale.codes), scale.y[h])
        n, bad = len(scale.y[h]), scale.y[h].sum()
        base[h] = float(np.log((bad + 0.5) / (n - bad + 0.5)))
        t, m = out.views(xs, scale.codes, h)
        enough = n >= 20 and scale.y[h].min() < scale.y[h].max()
        # views that are independent add up with weights of 1; few rows move the weights little from there
        both[h] = fit(np.stack([t, m - base[h]], axis=1), scale.y[h], l2=5.0, toward=1.0) if enough else Linear(np.array([1.0, 0.0]), 0.0)
        t, m = out.views(xd, decide.codes, h)
        p = {"text": sigmoid(t), "meta": sigmoid(m), "both": out.combined(t, m, h)}
        truth = decide.y[h]
        report[h] = {k: {"accuracy": float(((v >= 0.5) == truth).mean()) if len(v) else 1.0, "rows": len(v)} for k, v in p.items()}
        safe = np.clip(p["both"], 1e-6, 1 - 1e-6)
        report[h]["loss"] = float(-(truth * np.log(safe) + (1 - truth) * np.log(1 - safe)).mean()) if len(safe) else 0.0
        for k in ("text", "meta"):
            for value, sure in ((1, p[k] >= CONFIDENT), (0, p[k] <= 1 - CONFIDENT)):
                share = float((truth[sure] == value).mean()) if sure.any() else 0.0
                report[h][k][value] = share if sure.sum() >= BORNE_OUT and share >= CONFIDENT else 0.0
    return out


def _better(old: Model, new: Model) -> Model:
    """For each property the new views, unless they raise the loss on the deciding rows by more than 0.001."""
    keep = {h: new if new.report[h]["loss"] <= old.report[h]["loss"] + 1e-3 else old for h in HEADS}
    return new._replace(**{k: {h: getattr(keep[h], k)[h] for h in HEADS} for k in ("text", "meta", "both", "base", "report")})


class Trained(NamedTuple):
    model: Model
    stored: DataFrame  # id, hits, stats, codes of every row of the documents
    taught: dict  # (from, property, value) -> documents labelled in all rounds


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    numeric: tuple[str, ...] = ("n_chars",),
    nominal: tuple[str, ...] = ("lang", "source"),
    rounds: int = 2,
) -> Trained:
    """Co-train on labels (id_col, quality 0/1, toxic 0/1) and on all documents without a label.

    Labelled rows beyond LABELLED are left out of the fit, by the order of a hash; conflicting labels of an id
    count as the worse one; null labels as good. Without labels, or of one class alone, a property has its
    prior. Each round scores every unlabelled document; a view passes on, for each property, SHARE of them (FEWEST
    at least, MOST at most), divided between both values by the property's frequency. It may teach a value only
    where it gives it CONFIDENT or more, and where CONFIDENT or more of the deciding rows (a fifth of the labels)
    of which it is so sure, BORNE_OUT at least, bear it out; what it teaches counts by that share. It passes nothing
    on of which the other view is surer the other way. Where a round raises a property's loss on the deciding rows, the
    views of that property stay as they were. With fewer than 20 calibrating rows, or of
    one class alone, the text view alone judges.
    """
    prepare(docs.sparkSession)
    store = Store(docs.sparkSession)
    num, nom = list(numeric), list(nominal)
    cols = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *num, *nom)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.coalesce("quality", F.lit(1)) == 0).cast("int")).alias("low"), F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic")
    )
    few = marks.orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    gold = cols.join(F.broadcast(few), "id").dropDuplicates(["id"]).toArrow().sort_by("id")  # LABELLED rows at most
    part = (gold.column("id").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(5)
    parts = [_gold(gold.filter(pa.array(m)), num, nom) for m in (part < 3, part == 3, part == 4)]
    del gold
    blank = _blank(parts[0])
    stored = store.save(_features(cols, blank, num, nom))
    pool = stored.join(marks.select("id"), "id", "left_anti").where("id is not null")
    model, taught = _model(blank, parts, [], []), {}
    for_text: list[_Rows] = []
    for_meta: list[_Rows] = []
    size = pool.count() if rounds else 0
    used: set[int] = set()
    for _ in range(rounds):
        many = int(min(max(SHARE * size, FEWEST), MOST))
        asks = {(k, h, v): model.report[h][k][v] for k in ("text", "meta") for h in HEADS for v in (1, 0) if model.report[h][k][v]}
        if not asks:
            break
        scored = store.save(_scored(pool, model))
        picks: dict[str, dict[int, dict]] = {"text": {}, "meta": {}}
        sure = float(np.log(CONFIDENT / (1 - CONFIDENT)))
        for (k, h, v), weight in asks.items():
            rate = sigmoid(np.array(model.base[h]))
            n = max(1, round(many * float(rate if v else 1 - rate)))
            c, other = F.col(f"{k}_{h}"), F.col(f"{'meta' if k == 'text' else 'text'}_{h}")
            agreed = (c >= sure) & (c + other > 0) if v else (c <= -sure) & (c + other < 0)
            best = scored.where(agreed).orderBy(c.desc() if v else c.asc(), F.xxhash64("id"), "id").select("id").limit(n + len(used))
            fresh = [r.id for r in best.collect() if r.id not in used][:n]  # MOST and those used before at most
            for i in fresh:
                picks[k].setdefault(i, {})[h] = (float(v), weight)
            taught[(k, h, v)] = taught.get((k, h, v), 0) + len(fresh)
        store.drop(scored)
        ids = sorted({*picks["text"], *picks["meta"]})
        if not ids:
            break
        used |= set(ids)
        wanted = docs.sparkSession.createDataFrame(pd.DataFrame({"id": ids}), "id long")  # 8 * MOST at most
        rows = pool.join(F.broadcast(wanted), "id").dropDuplicates(["id"]).toPandas().sort_values("id")
        for k, other in (("text", for_meta), ("meta", for_text)):
            mine = rows[rows["id"].isin(picks[k].keys())]
            if len(mine):
                said = [picks[k][i] for i in mine["id"]]
                y = {h: np.array([s[h][0] if h in s else np.nan for s in said]) for h in HEADS}
                hits, stats, codes = _unpacked(mine["hits"].tolist(), mine["stats"].tolist(), mine["codes"].tolist(), len(blank.exact))
                other.append(_Rows(stats, None, hits, codes, y, np.array([min(w for _, w in s.values()) for s in said])))
        model = _better(model, _model(blank, parts, for_text, for_meta))
    return Trained(model, stored, taught)


def _unpacked(hits: list, stats: list, codes: list, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = len(hits)
    h = np.unpackbits(np.frombuffer(b"".join(map(bytes, hits)), np.uint8).reshape(m, -1), axis=1, count=n).astype(bool) if n else np.zeros((m, 0), bool)
    s = np.frombuffer(b"".join(map(bytes, stats)), np.float32).reshape(m, N_STATS).astype(float)
    return h, s, np.frombuffer(b"".join(map(bytes, codes)), np.uint8).reshape(m, -1).astype(np.int64)


def _rows_of(b: pa.RecordBatch, at: int, model: Model, numeric: list[str], nominal: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hits, statistics (rounded to single precision, as they are stored) and metadata codes of a batch."""
    codes = meta_codes(pa.Table.from_batches([b]).select([*numeric, *nominal]).to_pandas(), numeric, nominal)
    hits, stats = np.zeros((b.num_rows, len(model.exact)), bool), np.zeros((b.num_rows, N_STATS), np.float32)
    for first, s, row, feats in text_rows(b.column(at)):
        part = slice(first, first + len(s))
        hits[part], stats[part] = model.hits(len(s), row, feats), s
    return hits, stats, codes


def _features(cols: DataFrame, blank: Model, numeric: list[str], nominal: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, stats, codes = _rows_of(b, 1, blank, numeric, nominal)
            packed = (np.packbits(hits, axis=1), stats, codes.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in packed)], ["id", "hits", "stats", "codes"])

    return cols.mapInArrow(run, "id long, hits binary, stats binary, codes binary")


def _scored(pool: DataFrame, model: Model) -> DataFrame:
    """id and the log odds of either view for each property."""
    names = [f"{k}_{h}" for h in HEADS for k in ("text", "meta")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hits, stats, codes = _unpacked(*(b.column(k).to_pylist() for k in (1, 2, 3)), len(model.exact))
                x = model.matrix(hits, stats)
                z = [v for h in HEADS for v in model.views(x, codes, h)]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, z)], ["id", *names])

    return pool.select("id", "hits", "stats", "codes").mapInArrow(run, ", ".join(["id long", *(f"{n} double" for n in names)]))


def judge_stored(trained: Trained, *, id_col: str = "doc_id", reject: float = 0.5) -> DataFrame:
    """(id_col, p_low, p_toxic, kept) for every row that train() read, from what it stored: no text is read again."""
    model = trained.model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                hits, stats, codes = _unpacked(*(b.column(k).to_pylist() for k in (1, 2, 3)), len(model.exact))
                p = np.round(model.judged(model.matrix(hits, stats), codes), 6)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < reject).all(axis=1))], ["id", "p_low", "p_toxic", "kept"])

    return trained.stored.mapInArrow(run, "id long, p_low double, p_toxic double, kept boolean").withColumnRenamed("id", id_col)


def judge(
    docs: DataFrame,
    model: Model,
    *,
    text_col: str = "text",
    numeric: tuple[str, ...] = ("n_chars",),
    nominal: tuple[str, ...] = ("lang", "source"),
    reject: float = 0.5,
    names: tuple[str, str, str] = ("p_low", "p_toxic", "kept"),
) -> DataFrame:
    """docs with p_low, p_toxic and kept, for every row: kept unless either probability reaches ``reject``.

    Null or empty text has no tokens and is judged by its statistics and metadata; null metadata is a value
    of its own. ``names`` are the new columns' names; columns of docs so named are replaced, others pass through.
    No rows in, no rows out.
    """
    prepare(docs.sparkSession)
    num, nom = list(numeric), list(nominal)
    frame = docs.select([c for c in docs.columns if c not in names])
    at = frame.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, stats, codes = _rows_of(b, at, model, num, nom)
            p = np.round(model.judged(model.matrix(hits, stats.astype(float)), codes), 6)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array((p < reject).all(axis=1))], [*b.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), f"{names[0]} double, {names[1]} double, {names[2]} boolean"])
    return frame.mapInArrow(run, schema)
