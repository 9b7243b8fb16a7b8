"""Embedding near-duplicates by int8 tile products with error bounds.

Unit vectors of one label are quantised to int8 once, with a scale and rigorous bounds on the error, ordered by
cells along a few directions and cut into tiles. Tiles are stored and sent as int8, an eighth of the bytes; a
strip keeps one tile in a task while the tiles it meets stream past. A product plus its error bound below the
threshold rules a pair out, a product less its bound at or above it links the pair, and only tile pairs that
hold pairs between are met again in double precision, for those pairs. Tile pairs whose ranges along any
direction are farther apart than the threshold allows are never formed. Equal vectors are one class; a tile pair
gives a count and a root for each class it links, never the pairs themselves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, connected_components, prepare

TILE = 1024
#: Directions along which ranges of tiles are kept; tiles are ordered by cells of the first two, then the third.
DIRECTIONS = 4
SLACK = 1e-9  # above any rounding of the double-precision sums here


@lru_cache(maxsize=16)
def directions(dim: int) -> np.ndarray:
    """Orthonormal columns, the same in every process."""
    x = np.random.default_rng(dim).standard_normal((dim, min(DIRECTIONS, dim)))
    return np.linalg.qr(x)[0]


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1)[:, None]  # no overflow of squares
    return v / np.linalg.norm(v, axis=1)[:, None]


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows as int8, their scales, the norms of the int8 rows, and bounds on the residuals' norms."""
    scale = np.abs(v).max(axis=1) / 127
    q = np.rint(v / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(back, axis=1) + SLACK, np.linalg.norm(v - back, axis=1) + SLACK


class Tile(NamedTuple):
    cls: np.ndarray
    copies: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    norm: np.ndarray
    error: np.ndarray

    def packed(self) -> bytes:
        return b"".join(np.ascontiguousarray(x).tobytes() for x in self)

    @staticmethod
    def read(raw: bytes, dim: int) -> Tile:
        n, at, out = len(raw) // (40 + dim), 0, []
        for kind, width in ((np.int64, 1), (np.int64, 1), (np.int8, dim), (np.float64, 1), (np.float64, 1), (np.float64, 1)):
            x = np.frombuffer(raw, kind, n * width, at)
            at += x.nbytes
            out.append(x.reshape(n, dim) if kind is np.int8 else x)
        return Tile(*out)


def bounds(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs the int8 product, scaled, and what the true product may differ from it."""
    product = (a.q.astype(np.int32) @ b.q.astype(np.int32).T) * a.scale[:, None] * b.scale[None, :]
    # |u.v - u'.v'| <= |u'||v - v'| + |u - u'||v|, and |v| = 1
    return product, a.norm[:, None] * b.error[None, :] + a.error[:, None] * (1 + SLACK) + SLACK


def split(a: Tile, b: Tile, same: bool, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs that surely link, and of those that the int8 products leave open.

    One pass in single precision, with the tiles' widest bound, finds the pairs that may link; only for these are
    products and their own bounds taken in double precision.
    """
    rough = (a.q * a.scale[:, None].astype(np.float32)) @ (b.q * b.scale[:, None].astype(np.float32)).T
    widest = a.norm.max() * b.error.max() + a.error.max() * (1 + SLACK) + SLACK
    i, j = np.nonzero(rough >= threshold - widest - a.q.shape[1] * 2.0**-22)  # single precision's rounding of unit rows
    if same:
        once = a.cls[i] < b.cls[j]
        i, j = i[once], j[once]
    product = np.empty(len(i))
    for k in range(0, len(i), 1 << 15):
        p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        product[k : k + (1 << 15)] = np.einsum("ij,ij->i", a.q[p].astype(np.int32), b.q[q].astype(np.int32)) * a.scale[p] * b.scale[q]
    off = a.norm[i] * b.error[j] + a.error[i] * (1 + SLACK) + SLACK
    sure, open_ = product - off >= threshold, (product + off >= threshold) & (product - off < threshold)
    return (i[sure], j[sure]), (i[open_], j[open_])


def links_of(a: Tile, b: Tile, i: np.ndarray, j: np.ndarray) -> pd.DataFrame | None:
    """For each class that the pairs (i, j) link: how many vectors it is linked to, and a root."""
    if not len(i):
        return None
    links = np.concatenate([np.bincount(i, b.copies[j], len(a.cls)), np.bincount(j, a.copies[i], len(b.cls))]).astype(np.int64)
    ids = np.concatenate([a.cls, b.cls])
    root, far = ids.copy(), j + len(a.cls)
    while True:  # the smallest class that links reach inside this pair of tiles
        low = np.minimum(root[i], root[far])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, far, low)
        if (new == root).all():
            break
        root = new
    hit = links > 0
    return pd.DataFrame({"cls": ids[hit], "links": links[hit], "root": root[hit]})


def _quantised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """cls, copies, label, dim, v to the int8 row and its place, one matrix product for each dimension of a batch."""
    for pdf in batches:
        for dim, rows in pdf.groupby("dim", sort=False):
            u = unit(np.stack([np.asarray(v, np.float64) for v in rows["v"]]))
            q, scale, norm, error = quantise(u)
            x = np.zeros((len(rows), DIRECTIONS))
            x[:, : min(DIRECTIONS, dim)] = u @ directions(int(dim))
            out = rows[["cls", "copies", "label", "dim"]].assign(q=[r.tobytes() for r in q], scale=scale, norm=norm, error=error)
            yield out.assign(**{f"x{k}": x[:, k] for k in range(DIRECTIONS)})


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Numbers the rows of each (label, dim) within a sorted partition."""
    part, seen = TaskContext.get().partitionId(), {}
    for pdf in batches:
        nth = np.empty(len(pdf), np.int64)
        for key, at in pdf.groupby(["label", "dim"], sort=False).indices.items():
            n = seen.get(key, 0)
            nth[at] = np.arange(n, n + len(at))
            seen[key] = n + len(at)
        yield pdf.assign(part=part, nth=nth)


def _blob(pdf: pd.DataFrame) -> pd.DataFrame:
    """A tile as one row."""
    dim = int(pdf["dim"].iloc[0])
    q = np.frombuffer(b"".join(pdf["q"]), np.int8).reshape(-1, dim)
    tile = Tile(*(pdf[c].to_numpy(np.int64) for c in ("cls", "copies")), q, *(pdf[c].to_numpy(float) for c in ("scale", "norm", "error")))
    one = pdf.iloc[:1][["label", "dim", "tile"]].reset_index(drop=True)
    ends = {f"{e}{k}": [getattr(pdf[f"x{k}"], e)()] for k in range(DIRECTIONS) for e in ("min", "max")}
    return one.assign(raw=[tile.packed()], **ends)


def _doubles(pdf: pd.DataFrame) -> pd.DataFrame:
    """The unit rows of a tile's classes, by class."""
    pdf = pdf.sort_values("cls")
    one = pdf.iloc[:1][["label", "dim", "tile"]].reset_index(drop=True)
    v = np.stack([np.asarray(x, np.float64) for x in pdf["v"]])
    return one.assign(ids=[pdf["cls"].to_numpy(np.int64).tobytes()], v=[v.tobytes()])


def _strips(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Rows sorted by strip, the strip's own tile first; links that int8 settles, and the tile pairs left open."""
    key, own = None, None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            tile = Tile.read(r.raw, r.dim)
            if r.other < 0:
                key, own = r.strip, tile
            a, b = (own, tile) if r.other < 0 or key < r.other else (tile, own)  # bounds depend on the order
            (i, j), (p, _) = split(a, b, r.other < 0, threshold)
            found = links_of(a, b, i, j)
            if found is not None:
                yield found.assign(at=None, lo=None, hi=None)
            if len(p):
                other = key if r.other < 0 else r.other
                yield pd.DataFrame({"cls": [None], "links": [None], "root": [None], "at": [r.at], "lo": [min(key, other)], "hi": [max(key, other)]})


def _exact(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """The open pairs of two tiles by cosine in double precision."""
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            a, b = Tile.read(r.raw_a, r.dim), Tile.read(r.raw_b, r.dim)
            rows = []
            for t, ids, v in ((a, r.ids_a, r.v_a), (b, r.ids_b, r.v_b)):
                x = np.frombuffer(v).reshape(-1, r.dim)[np.searchsorted(np.frombuffer(ids, np.int64), t.cls)]
                x = x / np.abs(x).max(axis=1)[:, None]
                rows.append((x, np.linalg.norm(x, axis=1)))
            (va, na), (vb, nb) = rows
            _, (i, j) = split(a, b, r.lo == r.hi, threshold)
            ok = np.empty(len(i), bool)
            for k in range(0, len(i), 1 << 15):
                p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                ok[k : k + (1 << 15)] = np.einsum("ij,ij->i", va[p], vb[q]) / (na[p] * nb[q]) >= threshold
            out = links_of(a, b, i[ok], j[ok])
            if out is not None:
                yield out


def near_duplicate_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98
) -> DataFrame:
    """(id_col, n_links long, component_id, kept) for each row of vectors.

    Rows with equal labels and dimensions are linked at a cosine (double precision) of threshold or more.
    n_links counts the other rows linked directly. A null label, and a vector that is null, empty, zero or
    holds null, NaN or infinity, links with nothing. component_id is the smallest id that links reach; a null
    id has none, counts as a row, and is kept. Repeated rows are rows of their own. Other columns are ignored.
    Vectors count as equal if 128 bits of hashes of label and components are (by chance for n rows: n^2 / 2^129).
    """
    spark = vectors.sparkSession
    prepare(spark)
    store = Store(spark)
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    ok = F.coalesce(F.col("v").isNotNull() & fit & F.col("label").isNotNull(), F.lit(False))
    # 128 bits stand for label and vector, so that joins need not move vectors
    hashes = [F.when(ok, F.xxhash64(*seed, "label", "v")).alias(n) for n, seed in (("h", []), ("g", [F.lit(1)]))]
    rows = rows.select("id", "label", "v", *hashes)
    classes = rows.where("h is not null").groupBy("h", "g").agg(F.min("id").alias("cls"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("v").alias("v"))
    # a class of rows without ids still needs a number of its own: above all ids, and never shown
    classes = store.save(classes.withColumn("cls", F.coalesce("cls", F.lit(2**62) + F.pmod("h", F.lit(2**61)))))
    kind = rows.schema["label"].dataType.simpleString()
    flat = classes.select("cls", "copies", "label", F.size("v").alias("dim"), "v")
    places = ", ".join(f"x{k} double" for k in range(DIRECTIONS))
    columns = f"cls long, copies long, label {kind}, dim int, q binary, scale double, norm double, error double, {places}"
    reach = math.sqrt(2 - 2 * threshold) + 1e-9  # no farther apart along any direction than in space
    order = ["label", "dim", F.floor(F.col("x0") / (reach / 2)), F.floor(F.col("x1") / (reach / 2)), "x2", "cls"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lined = flat.mapInPandas(_quantised, columns).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lined = store.save(lined.mapInPandas(_number, f"{columns}, part int, nth long"))
    before = lined.groupBy("label", "dim", "part").agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("label", "dim").orderBy("part")) - F.col("n"))
    tiled = lined.join(before.drop("n"), ["label", "dim", "part"]).withColumn("tile", F.expr(f"(before + nth) div {TILE}"))
    ends = ", ".join(f"min{k} double, max{k} double" for k in range(DIRECTIONS))
    blobs = tiled.groupBy("label", "dim", "tile").applyInPandas(_blob, f"label {kind}, dim int, tile long, raw binary, {ends}")
    blobs = store.save(blobs.withColumn("at", F.xxhash64("label", "dim")))
    at = blobs.drop("raw")
    left, right = at.alias("l"), at.alias("r")
    apart = None
    for k in range(DIRECTIONS):
        gap = F.greatest(F.col(f"l.min{k}") - F.col(f"r.max{k}"), F.col(f"r.min{k}") - F.col(f"l.max{k}")) > reach
        apart = gap if apart is None else apart | gap
    pairs = left.join(right, (F.col("l.label") == F.col("r.label")) & (F.col("l.dim") == F.col("r.dim")) & (F.col("l.tile") < F.col("r.tile"))).where(~apart)
    lo, hi = F.col("l.tile"), F.col("r.tile")
    even = (lo + hi) % 2 == 0  # so that strips meet about equally many tiles
    pairs = pairs.select("l.label", "l.dim", F.when(even, lo).otherwise(hi).alias("strip"), F.when(even, hi).otherwise(lo).alias("other"))
    met = pairs.join(blobs.select("label", "dim", F.col("tile").alias("other"), "raw", "at"), ["label", "dim", "other"])
    met = met.select("at", "dim", "strip", "other", "raw").unionByName(blobs.select("at", "dim", F.col("tile").alias("strip"), F.lit(-1).cast("long").alias("other"), "raw"))

    def strips(batches):
        return _strips(batches, threshold)

    def exact(batches):
        return _exact(batches, threshold)

    met = met.repartition("at", "dim", "strip").sortWithinPartitions("at", "dim", "strip", "other")
    seen = store.save(met.mapInPandas(strips, "cls long, links long, root long, at long, lo long, hi long"))
    # in double precision, the tiles that hold open pairs
    left_open = seen.where("at is not null").select("at", "lo", "hi")
    wanted = left_open.select("at", F.explode(F.array("lo", "hi")).alias("tile")).distinct()
    some = tiled.select("label", "dim", "tile", "cls", F.xxhash64("label", "dim").alias("at")).join(wanted, ["at", "tile"], "left_semi")
    full = some.join(classes.select("cls", "v"), "cls").groupBy("label", "dim", "tile")
    full = full.applyInPandas(_doubles, f"label {kind}, dim int, tile long, ids binary, v binary").join(blobs.select("label", "dim", "tile", "raw", "at"), ["label", "dim", "tile"])
    again = left_open
    for side, end in (("a", "lo"), ("b", "hi")):
        again = again.join(full.select("at", "dim", F.col("tile").alias(end), *(F.col(c).alias(f"{c}_{side}") for c in ("ids", "v", "raw"))), ["at", "dim", end] if side == "b" else ["at", end])
    links = store.save(seen.where("cls is not null").select("cls", "links", "root").unionByName(again.mapInPandas(exact, "cls long, links long, root long")))
    comps = connected_components(links.select(F.col("cls").alias("a"), F.col("root").alias("b")), store)
    totals = links.groupBy("cls").agg(F.sum("links").alias("links"))
    facts = classes.join(totals, "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
    facts = facts.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "cls").alias("c"))
    out = rows.select("id", "h", "g").join(facts, ["h", "g"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
