"""Exact removal of repeated word windows by level-wise doubling.

Levels are window / 4, window / 2 and window words. At the first level only the minimiser of each window is
counted (equal windows have equal minimisers at equal places, so no repeat is lost); those repeated anywhere
are extended to twice the length, to the right or left as the window around them lies, and again to the
window. Doubling ends there, or earlier when no candidate survives: longer repeats remove the same words.

A level's hashes meet in buckets of their first-level hash. A task sends each distinct hash once, whatever
its count, so a passage that a third of all documents hold costs one entry a task. Windows are identified by
96 bits besides the 64 of their bucket hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import prepare

#: Entries that a task holds before it sends them.
HELD = 1 << 20

_U32 = np.uint64(32)


def _starts_in_row(w: kernels.Words, length: int) -> np.ndarray:
    """For each word, whether a window of length words from it stays in its row."""
    return np.arange(len(w.h)) + length <= w.base[w.row + 1] if len(w.h) else np.zeros(0, bool)


def _all_spans(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the windows of length words at every place; places too near the end repeat the last."""
    if len(h) < length:
        return np.zeros(len(h), np.uint64)
    at = np.arange(len(h) - length + 1)
    x = kernels.spans(h, at, np.full(len(at), length))
    return np.concatenate([x, np.full(length - 1, x[-1])])


def _anchors(w: kernels.Words, base: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the minimiser (leftmost least base-word hash) of each, and all base-word hashes."""
    h = _all_spans(w.h, base)
    value, place, width = h, np.arange(len(h)), 1
    target = window - base + 1
    while width < target and len(value) > 1:
        step = min(width, target - width)
        if len(value) <= step:
            break
        left, right = value[:-step], value[step:]
        take = right < left
        value = np.where(take, right, left)
        place = np.where(take, place[step:], place[:-step])
        width += step
    starts = np.flatnonzero(_starts_in_row(w, window))
    return starts, place[starts], h


def _blobs(bucket: np.ndarray, cols: dict[str, np.ndarray], kind: int) -> pd.DataFrame:
    """One row for each bucket, its entries packed."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    ends = np.concatenate([[0], cuts, [len(bucket)]])
    out = {"bucket": bucket[ends[:-1]].astype(np.int32), "kind": np.full(len(ends) - 1, kind, np.int32)}
    for name, x in cols.items():
        x = x[order]
        out[name] = [x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pd.DataFrame(out)


LEVEL_1 = "bucket int, kind int, h binary, right binary, left binary, many binary, doc binary, at binary"


def _first_level(batches: Iterator[pa.RecordBatch], base: int, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(id, text) to the distinct (minimiser, right and left extension) triples of the task, by bucket."""
    held: list[tuple] = []
    count = 0

    def send() -> pa.RecordBatch:
        h, right, left, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        triple = kernels.mix(h ^ kernels.mix(right.astype(np.uint64) << _U32 | left.astype(np.uint64)))
        order = np.lexsort((at, doc, triple))
        h, right, left, doc, at, triple = (x[order] for x in (h, right, left, doc, at, triple))
        new = np.ones(len(h), bool)
        new[1:] = triple[1:] != triple[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(h)))
        cols = {"h": h[new], "right": right[new], "left": left[new], "many": (size > 1).astype(np.uint8), "doc": doc[new], "at": at[new]}
        parts = [_blobs((h[new] % np.uint64(buckets)).astype(np.int64), cols, 0)]
        if not new.all():  # known to repeat: they need no answer, only to be passed on
            rest = ~new
            none = np.zeros(int(rest.sum()), np.uint8)
            cols = {"h": none[:0], "right": none[:0], "left": none[:0], "many": none[:0]}
            spread = (kernels.mix(doc[rest].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            parts.append(_blobs(spread, {"doc": doc[rest], "at": at[rest]}, 1).assign(**{c: b"" for c in cols}))
        names = [c.split()[0] for c in LEVEL_1.split(", ")]
        return pa.RecordBatch.from_pandas(pd.concat(parts)[names], preserve_index=False)

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for w in kernels.words(b.column(1)):
            starts, anchors, h = _anchors(w, base, window)
            a = np.unique(anchors)
            if not len(a):
                continue
            long = (_all_spans(w.h, 2 * base) >> _U32).astype(np.uint32) | np.uint32(1)
            right = np.where(_starts_in_row(w, 2 * base)[a], long[a], 0).astype(np.uint32)
            before = a - base
            inside = before >= w.base[w.row[a]]
            left = np.where(inside, long[np.maximum(before, 0)], 0).astype(np.uint32)
            held.append((h[a], right, left, ids[w.first + w.row[a]], (a - w.base[w.row[a]]).astype(np.int32)))
            count += len(a)
            if count >= HELD:
                yield send()
                held, count = [], 0
    if count:
        yield send()


def _unpack(pdf: pd.DataFrame, name: str, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(pdf[name]), dtype)


def _repeated(values: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each value, whether it occurs twice or an entry says that it does."""
    _, inverse, count = np.unique(values, return_inverse=True, return_counts=True)
    total = count + np.bincount(inverse, many)
    return total[inverse] > 1


def _first_answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """The minimisers of a bucket that are repeated at the base length and at twice that length."""
    known, ask = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 0]
    h, many = _unpack(ask, "h", np.uint64), _unpack(ask, "many", np.uint8)
    right, left = _unpack(ask, "right", np.uint32), _unpack(ask, "left", np.uint32)
    doc, at = _unpack(ask, "doc", np.int64), _unpack(ask, "at", np.int32)
    alive = np.flatnonzero(_repeated(h, many))
    h, right, left, many = h[alive], right[alive], left[alive], many[alive]
    ok = np.zeros(len(alive), bool)
    for x, salt in ((right, 1), (left, 2)):
        ok |= (x > 0) & _repeated(kernels.mix(h + np.uint64(salt)) ^ kernels.mix(x.astype(np.uint64)), many)
    alive = alive[ok]
    return pd.DataFrame(
        {"id": np.concatenate([doc[alive], _unpack(known, "doc", np.int64)]), "at": np.concatenate([at[alive], _unpack(known, "at", np.int32)])}
    )


LEVEL_3 = "bucket int, kind int, h binary, g binary, anchor binary, doc binary, at binary, n binary"


def _runs(bucket: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where runs of consecutive windows of a document begin in sorted entries."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])
    return np.flatnonzero(new)


def _window_level(batches: Iterator[pa.RecordBatch], base: int, window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(id, text, surviving minimisers) to the distinct windows around them, by bucket, and known removals."""
    held: list[tuple] = []
    count = 0

    def send() -> pa.RecordBatch:
        h, g, anchor, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc, g, anchor, h))
        h, g, anchor, doc, at = (x[order] for x in (h, g, anchor, doc, at))
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (anchor[1:] != anchor[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        later = ~new & ((doc != doc[lead]) | (at != at[lead]))  # the task itself holds an earlier one
        bucket = (anchor % np.uint64(buckets)).astype(np.int64)
        parts = []
        for mask, kind in ((new, 0), (later, 1)):
            pick = np.flatnonzero(mask)
            if not len(pick):
                continue
            where = bucket[pick] if kind == 0 else (kernels.mix(doc[pick].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            pick = pick[np.lexsort((at[pick], doc[pick], where))]
            where = bucket[pick] if kind == 0 else (kernels.mix(doc[pick].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            first = _runs(where, doc[pick], at[pick])
            n = np.diff(np.append(first, len(pick))).astype(np.int32)
            runs = _blobs(where[first], {"doc": doc[pick][first], "at": at[pick][first], "n": n}, kind)
            if kind == 0:
                runs = runs.merge(_blobs(where, {"h": h[pick], "g": g[pick], "anchor": anchor[pick]}, kind), on=["bucket", "kind"])
            else:
                runs = runs.assign(h=b"", g=b"", anchor=b"")
            parts.append(runs)
        names = [c.split()[0] for c in LEVEL_3.split(", ")]
        return pa.RecordBatch.from_pandas(pd.concat(parts)[names], preserve_index=False)

    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        marks = b.column(2)
        for w in kernels.words(b.column(1)):
            starts, anchors, hb = _anchors(w, base, window)
            rows = len(w.base) - 1
            some = marks.slice(w.first, rows)
            flat = some.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(rows), some.value_lengths().to_numpy(zero_copy_only=False))
            alive = np.zeros(len(w.h) + 1, bool)
            place = w.base[row] + flat
            alive[place[place < w.base[row + 1]]] = True
            hit = alive[anchors]
            starts, anchors = starts[hit], anchors[hit]
            if not len(starts):
                continue
            length = np.full(len(starts), window)
            h, g = kernels.spans(w.h, starts, length), kernels.spans(w.h, starts, length, salt=77)
            r = w.row[starts]
            held.append((h, (g >> _U32).astype(np.uint32), (hb[anchors] >> _U32).astype(np.uint32), ids[w.first + r], (starts - w.base[r]).astype(np.int32)))
            count += len(starts)
            if count >= HELD:
                yield send()
                held, count = [], 0
    if count:
        yield send()


def _window_answer(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """Word ranges [at, to) of a bucket's windows that also start earlier."""
    known, ask = pdf[pdf["kind"] == 1], pdf[pdf["kind"] == 0]
    h, g, anchor = _unpack(ask, "h", np.uint64), _unpack(ask, "g", np.uint32), _unpack(ask, "anchor", np.uint32)
    n = _unpack(ask, "n", np.int32)
    doc, at = np.repeat(_unpack(ask, "doc", np.int64), n), np.repeat(_unpack(ask, "at", np.int32), n)
    at = at + (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    order = np.lexsort((at, doc, g, anchor, h))
    new = np.ones(len(order), bool)
    for x in (h, g, anchor):
        x = x[order]
        new[1:] &= x[1:] == x[:-1]
    new[1:] = ~new[1:]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order
    later = np.zeros(len(order), bool)
    later[order] = (doc[order] != doc[lead]) | (at[order] != at[lead])
    doc, at = doc[later], at[later]
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    first = _runs(np.zeros(len(doc), np.int8), doc, at)
    size = np.diff(np.append(first, len(doc)))
    k_at, k_n = _unpack(known, "at", np.int32), _unpack(known, "n", np.int32)
    begin = np.concatenate([at[first], k_at]).astype(np.int32)
    return pd.DataFrame(
        {"id": np.concatenate([doc[first], _unpack(known, "doc", np.int64)]), "at": begin, "to": (begin + np.concatenate([size, k_n]) - 1 + window).astype(np.int32)}
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, at, to) to the kept text, counted words and removed words."""
    for b in batches:
        out, words, gone = [], [], []
        for text, at, to in zip(b.column(1), b.column(2), b.column(3), strict=True):
            ws = (text.as_py() or "").encode().split()
            words.append(len(ws))
            if at.is_valid and len(at):
                a, z = np.array(at.values), np.array(to.values)
                edge = np.zeros(len(ws) + 1, np.int64)
                ok = z <= len(ws)
                np.add.at(edge, a[ok], 1)
                np.add.at(edge, z[ok], -1)
                keep = np.cumsum(edge[:-1]) == 0
                ws = [x for x, k in zip(ws, keep.tolist(), strict=True) if k]
            gone.append(words[-1] - len(ws))
            out.append(b" ".join(ws).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(words, pa.int64()), pa.array(gone, pa.int64())], ["id", "kept_text", "n_words", "n_removed"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20, buckets: int | None = None) -> DataFrame:
    """(id_col, kept_text, n_words, n_removed) for each row of docs.

    Removed is every word covered by a window whose words also start earlier: in a document of smaller id, or
    in the same one at an earlier word. Words are runs other than ASCII white space, unchanged, whole texts;
    windows are judged on the input. kept_text is the other words joined by one space.

    Null or empty text: no words. Rows with a null id are not compared and lose nothing. Rows that share an id
    are one document and must hold the same text; windows at the same place of it are the same window. Other
    columns are ignored; no rows in, no rows out. window must be a multiple of 4. Windows are compared by 160 bits of
    hashes, never word by word. ``buckets`` (by default three a shuffle partition) hold an even share of the windows
    each, so they grow with the input unless the partitions do; windows of one hash are in one bucket as places, a few
    bytes each.
    """
    if window % 4:
        raise ValueError("window must be a multiple of 4")
    spark = docs.sparkSession
    prepare(spark)
    base = window // 4
    buckets = buckets or 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = texts.where("id is not null")
    # a key that is never null: both joins below then read one and the same exchange of the texts; rows without id are
    # dealt out by their text. A struct, since a flag of its own would become a filter of one of the joins.
    key = lambda c: F.struct(F.coalesce(c, F.xxhash64("text")).alias("k"), F.col(c).isNull().alias("no")).alias("k")
    plain = F.struct(F.coalesce("id", F.lit(0).cast("long")).alias("k"), F.lit(False).alias("no")).alias("k")
    keyed = texts.select("*", key("id"))

    def first(batches):
        return _first_level(batches, base, window, buckets)

    def windows(batches):
        return _window_level(batches, base, window, buckets)

    def answer(pdf):
        return _window_answer(pdf, window)

    alive = known.mapInArrow(first, LEVEL_1).groupBy("bucket").applyInPandas(_first_answer, "id long, at int")
    alive = alive.groupBy("id").agg(F.collect_set("at").alias("marks")).select(plain, "marks")
    near = keyed.join(alive.hint("merge"), "k").select("id", "text", "marks").mapInArrow(windows, LEVEL_3)
    gone = near.groupBy("bucket").applyInPandas(answer, "id long, at int, to int")
    gone = gone.groupBy("id").agg(F.collect_list(F.struct("at", "to")).alias("r"))
    gone = gone.select(plain, F.col("r.at").alias("at"), F.col("r.to").alias("to"))
    cut = keyed.join(gone.hint("merge"), "k", "left").select("id", "text", "at", "to").mapInArrow(_cut, "id long, kept_text string, n_words long, n_removed long")
    return cut.withColumnRenamed("id", id_col)
