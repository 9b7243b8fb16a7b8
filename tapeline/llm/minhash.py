"""MinHash near-duplicates with sequential Bayesian verification.

Banded MinHash proposes candidates; batches of the two signatures are compared and a pair is dropped as soon
as the posterior probability that its Jaccard similarity reaches the threshold falls below the chosen miss
probability; survivors are confirmed on their full shingle sets.

Groups of any size: equal shingle sets are one class first. In each bucket every class is tried against one
pivot (as many pairs as classes); connected classes need no further test. Only buckets that still hold
several components are compared across components, inside tasks that hold two blocks of bounded size; a pair
is tried only in the first band that it shares, and only links that join components leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import Store, by_group, connected_components, dealt, prepare

N_PERM, BAND_ROWS = 128, 4
N_BANDS = N_PERM // BAND_ROWS
#: Matches are looked at in batches of this many hashes.
BATCH = 32
#: Classes of one bucket that meet in one task: BLOCK x BLOCK comparisons.
BLOCK = 512

_A = (np.random.default_rng(97).integers(0, 2**31, N_PERM, dtype=np.uint64) * 2 + 1).astype(np.uint32)


@lru_cache
def least_matches(threshold: float, miss: float) -> dict[int, int]:
    """For each number of compared hashes, the fewest matches that keep a pair.

    With a uniform prior the posterior after k matches in m hashes is Beta(k + 1, m - k + 1); its upper tail
    at the threshold equals P(Binomial(m + 1, threshold) <= k).
    """
    out = {}
    for m in range(BATCH, N_PERM + 1, BATCH):
        tail, k = 0.0, 0
        while k <= m:
            tail += math.comb(m + 1, k) * threshold**k * (1 - threshold) ** (m + 1 - k)
            if tail >= miss:
                break
            k += 1
        out[m] = k
    return out


def signatures(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, number of shingles, 128-bit digest of the set, 128 16-bit minima)."""
    for b in batches:
        for s in kernels.shingle_sets(b.column(1), k):
            n = len(s.count)
            sig = np.zeros((n, N_PERM), np.uint16)
            d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            full = np.flatnonzero(s.count)
            if len(full):
                at = np.searchsorted(s.row, full)
                d1[full], d2[full] = np.add.reduceat(s.h, at), np.add.reduceat(kernels.mix(s.h ^ np.uint64(0x5BD1E995)), at)
                x = (s.h >> np.uint64(32)).astype(np.uint32)
                for p in range(0, N_PERM, 16):
                    low = np.minimum.reduceat(x[None, :] * _A[p : p + 16, None], at, axis=1)
                    sig[full, p : p + 16] = ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).T
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(s.first, n),
                    pa.array(s.count.astype(np.int64)),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                ["id", "n", "d1", "d2", "sig"],
            )


def sig_matrix(col: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint16).reshape(len(col), N_PERM)


def survivors(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Positions of the rows whose similarity bound stays above the threshold through all batches."""
    alive, hits = np.arange(len(a)), np.zeros(len(a), np.int64)
    for m, k in least.items():
        same = a[alive, m - BATCH : m] == b[alive, m - BATCH : m]
        hits = hits + same.sum(axis=1)
        alive, hits = alive[hits >= k], hits[hits >= k]
    return alive


def _prune(batches: Iterator[pd.DataFrame], least: dict[int, int]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            yield pdf.iloc[survivors(sig_matrix(pdf["sig_a"]), sig_matrix(pdf["sig_b"]), least)][["a", "b"]]


def _across(batches: Iterator[pd.DataFrame], least: dict[int, int], percent: int) -> Iterator[pd.DataFrame]:
    """Links that join different components between two blocks of a bucket, confirmed on the full sets.

    Pairs with the bucket's pivot have been tried, and pairs that share an earlier band are tried there.
    A link that joins two components settles all other pairs between them, so few links leave the task.
    """
    for g in by_group(batches, ["key", "lo", "hi"]):
        lo, hi, band = g["lo"].iloc[0], g["hi"].iloc[0], int(g["band"].iloc[0])
        g = g[g["id"] != g["pivot"]]
        left, right = g[g["blk"] == lo], g[g["blk"] == hi]
        if left.empty or right.empty:
            continue
        sl, sr = sig_matrix(left["sig"]), sig_matrix(right["sig"])
        il, ir = left["id"].to_numpy(), right["id"].to_numpy()
        cl, cr = left["component"].to_numpy().copy(), right["component"].to_numpy().copy()
        tl, tr = ([np.frombuffer(x, np.uint64) for x in t["shingles"]] for t in (left, right))
        nr = np.array([len(x) for x in tr])
        for i, mine in enumerate(tl):
            fewer, more = np.minimum(nr, len(mine)), np.maximum(nr, len(mine))
            other = np.flatnonzero((cr != cl[i]) & (100 * fewer >= percent * more) & ((ir > il[i]) if lo == hi else True))
            if not len(other):
                continue
            other = other[survivors(np.broadcast_to(sl[i], (len(other), N_PERM)), sr[other], least)]
            if len(other):
                bands = (sr[other] == sl[i]).reshape(len(other), N_BANDS, BAND_ROWS).all(axis=2)
                other = other[bands.argmax(axis=1) == band]
            if not len(other):
                continue
            theirs = np.concatenate([tr[j] for j in other])
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            owner = np.repeat(np.arange(len(other)), nr[other])
            shared = np.bincount(owner[mine[at] == theirs], minlength=len(other))
            linked = other[100 * shared >= percent * (len(mine) + nr[other] - shared)]
            found = []
            for j in linked:
                if cr[j] != cl[i]:
                    found.append((min(il[i], ir[j]), max(il[i], ir[j])))
                    old, new = cr[j], cl[i]
                    cl[cl == old] = new
                    cr[cr == old] = new
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to the sorted distinct shingles."""
    for b in batches:
        for s in kernels.shingle_sets(b.column(1), k):
            cuts = np.concatenate([[0], np.cumsum(s.count)])
            packed = [s.h[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(s.count)), pa.array(packed, pa.binary())], ["id", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, text_a, text_b) whose full shingle sets reach the threshold."""
    for batch in batches:
        sizes = kernels.text_sizes(batch.column(2)) + kernels.text_sizes(batch.column(3))
        for i, j in kernels.row_ranges(sizes, 2 * kernels.SLICE):
            rows, hashes, total = [], [], np.zeros(j - i, np.int64)
            for c in (2, 3):
                for s in kernels.shingle_sets(batch.column(c).slice(i, j - i), k):
                    rows.append(s.row + s.first)
                    hashes.append(s.h)
                    total[s.first : s.first + len(s.count)] += s.count
            row, h = np.concatenate(rows), np.concatenate(hashes)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            shared = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=j - i)
            ok = (100 * shared >= percent * (total - shared)) & (shared > 0)
            part = batch.slice(i, j - i).select([0, 1])
            yield part.filter(pa.array(ok))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 75,
    miss: float = 1e-6,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each row of docs.

    Two documents are linked when 100 * shared shingles >= percent * shingles of both together; words are cut
    at ASCII white space after A-Z are lower-cased. component_id is the smallest id that links reach.
    Bands of 4 of 128 hashes miss a pair at 0.75 with probability 5e-6; ``miss`` bounds what each batch prunes.

    Shingles stand for 64-bit hashes of their words (a polynomial modulo 2^64, finalised): texts made for it could
    collide. Null or empty text, or white space alone: no shingles, linked with nothing. A null id: component null,
    kept. Rows that share an id are one document to links, any one of their texts where these differ; each keeps its
    own row and n_shingles. Other
    columns are ignored. No rows in: no rows out.
    """
    spark = docs.sparkSession
    prepare(spark)
    store = Store(spark)
    least = least_matches(percent / 100, miss)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches):
        return signatures(batches, shingle)

    signed = store.save(texts.mapInArrow(sign, "id long, n long, d1 long, d2 long, sig binary"))
    real = signed.where("id is not null and n > 0")
    # classes of one document stand for themselves; the members of the others are dealt out, whatever their number
    classes = real.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    classes = store.save(classes)
    mine, several, key = dealt(real, classes, ["n", "d1", "d2"], "c", "id")
    mine = mine.join(several.drop("c"), key, "left")
    reps = store.save(mine.where("rep is null or id = rep").select("id", "sig").dropDuplicates(["id"]))
    bands = reps.select(
        "id",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(N_BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sig", b * (2 * BAND_ROWS) + 1, F.lit(2 * BAND_ROWS))))
        ).alias("band", "key"),
    )
    pick = F.struct(F.xxhash64("key", "id").alias("o"), F.col("id"))
    buckets = store.save(
        bands.groupBy("key").agg(F.count("*").alias("m"), F.min(pick).alias("p")).where("m > 1").select("key", "m", F.col("p.id").alias("pivot"))
    )

    # stored: bands are made anew each time they are read, and most of their rows are alone in their bucket
    shared = store.save(bands.join(buckets.hint("merge"), "key").select("key", "band", "m", "pivot", "id"))
    store.drop(buckets)
    # texts of the classes that share a bucket with another; merge joins behave alike at every size
    some = store.save(texts.join(shared.select("id").distinct().hint("merge"), "id", "left_semi"))

    star = shared.where("id != pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    for c in ("a", "b"):
        star = star.join(reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")).hint("merge"), c)

    def prune(batches):
        return _prune(batches, least)

    def confirm(batches):
        return _confirm(batches, shingle, percent)

    pairs = star.mapInPandas(prune, "a long, b long")
    for c in ("a", "b"):
        pairs = pairs.join(some.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge"), c)
    links = store.save(pairs.select("a", "b", "text_a", "text_b").mapInArrow(confirm, "a long, b long").distinct())
    comps = store.save(connected_components(links, store))

    label = F.coalesce("component", "id")
    held = shared.where("m > 2").join(comps.withColumnRenamed("node", "id"), "id", "left")
    held = held.select("key", "band", "m", "pivot", "id", label.alias("component"))
    side = F.when(F.col("id") != F.col("pivot"), F.col("component"))
    mixed = held.groupBy("key").agg(F.min(side).alias("x"), F.max(side).alias("y")).where("x != y").select("key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    members = held.join(mixed, "key").withColumn("blk", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    members = store.save(members.select("key", "band", "m", "pivot", "id", "component", "blk"))

    def sets(batches):
        return _sets(batches, shingle)

    def across(batches):
        return _across(batches, least, percent)

    full = some.join(members.select("id").distinct().hint("merge"), "id", "left_semi").mapInArrow(sets, "id long, shingles binary")
    spread = members.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("c")).drop("m")
    spread = spread.withColumn("lo", F.least("blk", "c")).withColumn("hi", F.greatest("blk", "c")).drop("c")
    spread = spread.join(reps.hint("merge"), "id").join(full.hint("merge"), "id")
    spread = spread.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    more = store.save(spread.mapInPandas(across, "a long, b long").distinct())
    for t in (shared, some, members, comps):
        store.drop(t)
    comps = connected_components(links.unionByName(more), store)

    whole, several, key = dealt(signed.select("id", "n", "d1", "d2"), classes, ["n", "d1", "d2"], "c", "id")
    whole = whole.join(several.drop("c"), key, "left").withColumn("rep", F.coalesce("rep", "id"))
    whole = whole.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))
    return whole.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
