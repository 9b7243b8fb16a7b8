"""Best-fit packing of token pieces under vector capacities.

Pieces are told apart by length alone, so bins are chosen for all pieces of a length at once: the plan works
on a histogram (one count for each length up to the capacity) and on groups of bins in the same state, takes
lengths in decreasing order, and puts as many pieces as fit into the group that scores best. Its size depends
on the capacity, not on the rows. Each piece then finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Store, prepare


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> uint32 ids of the byte-level BPE file, special tokens' strings being ordinary text.

    The .tiktoken file beside the .json holds the same vocabulary as ranks and its encoder gives the same ids
    several times faster; it is used if present, and the .json's own tokenizer where it refuses a text.
    """
    import public_tokenizers as vocab
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def by_file(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    try:
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except (ImportError, OSError):
        return by_file
    fast = tiktoken.Encoding("ranks", pat_str=vocab.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_ranks(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode_ordinary(text), np.uint32)
        except BaseException as e:  # its regular expression engine gives up on very long runs of white space
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return by_file(text)

    return by_ranks


def pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """(id, text) to the pieces of each document, numbered within the task for each length."""
    encode, part = encoder(path), TaskContext.get().partitionId()
    seen = np.zeros(capacity + 1, np.int64)
    for b in batches:
        cols: dict[str, list] = {k: [] for k in ("id", "piece", "start", "length", "crc", "nth", "ids")}
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.append(encode(text.as_py() or ""), np.uint32(0)).astype("<u4")
            first = len(ids) % capacity or capacity
            ends = range(first, len(ids) + 1, capacity)
            for k, end in enumerate(ends):
                start = 0 if k == 0 else end - capacity
                body = ids[start:end]
                cols["id"].append(key)
                cols["piece"].append(k)
                cols["start"].append(start)
                cols["length"].append(end - start)
                cols["crc"].append(zlib.crc32(body.tobytes()))
                cols["nth"].append(int(seen[end - start]))
                cols["ids"].append(body.tolist() if with_ids else None)
                seen[end - start] += 1
        n = len(cols["id"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cols["id"], pa.int64()),
                pa.array(cols["piece"], pa.int32()),
                *(pa.array(cols[k], pa.int64()) for k in ("start", "length", "crc", "nth")),
                pa.array(np.full(n, part, np.int32)),
                pa.array(cols["ids"], pa.list_(pa.int32())),
            ],
            ["id", "piece", "start", "length", "crc", "nth", "part", "ids"],
        )


def plan(
    counts: dict[int, int], capacity: int, *, max_docs: int, max_cost: float, weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm"
) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, end rank, first bin, offset): pieces of a rank go to consecutive bins.

    A bin's residual vector is (tokens, documents, attention cost), each over its capacity; a piece of length
    n takes (n, 1, n * n). Among the groups of bins where it fits in every dimension, rule "norm" takes the
    one with the least weighted norm of what would remain, "dot" the one with the greatest weighted dot
    product of demand and residual; ties go to the older group.
    """
    caps, w = np.array([capacity, max_docs, max_cost], float), np.array(weights)
    left = np.zeros((0, 3))
    size, begin, runs, bins = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        need = np.array([length, 1, float(length) * length])
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while todo:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if len(fits):
                rest, demand = left[fits], need / caps
                score = (w * ((rest - need) / caps) ** 2).sum(axis=1) if rule == "norm" else -(w * demand * (rest / caps)).sum(axis=1)
                g = fits[np.argmin(score)]
                n = min(todo, int(size[g]))
                runs.append((length, rank, rank + n, int(begin[g]), int(capacity - left[g, 0])))
                moved, at = left[g] - need, int(begin[g])
                if n == size[g]:
                    left, size, begin = np.delete(left, g, 0), np.delete(size, g), np.delete(begin, g)
                else:
                    size[g] -= n
                    begin[g] += n
            else:
                deep = int(min(capacity // length, max_docs, max_cost // need[2]))
                n = -(-todo // deep)  # so many new bins; the next rounds fill them
                n = min(n, todo)
                runs.append((length, rank, rank + n, bins, 0))
                moved, at = caps - need, bins
                bins += n
            todo, rank = todo - n, rank + n
            if moved[0] > 0 and moved[1] > 0:
                left, size, begin = np.vstack([left, moved]), np.append(size, n), np.append(begin, at)
    return runs


def bins_of(runs: list[tuple[int, int, int, int, int]]) -> int:
    return max((first + end - begin for _, begin, end, first, _ in runs), default=0)


def evenest(counts: dict[int, int], capacity: int, max_cost: float, rule: str) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The least of capacity, capacity / 2, ... documents a sequence that costs no sequence more than the token
    capacity alone, and its plan: sequences of many tiny documents are spread over others where that is free."""
    best = (capacity, plan(counts, capacity, max_docs=capacity, max_cost=max_cost, rule=rule))
    fewest, limit = bins_of(best[1]), capacity // 2
    while limit:
        for weights in ((1.0, 0.01, 0.01), (1.0, 1.0, 0.01)):
            runs = plan(counts, capacity, max_docs=limit, max_cost=max_cost, weights=weights, rule=rule)
            if bins_of(runs) <= fewest:
                best = (limit, runs)
                break
        else:
            return best
        limit //= 2
    return best


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    max_docs: int | None = None,
    max_cost: float | None = None,
    rule: str = "norm",
    with_ids: bool = False,
) -> DataFrame:
    """(id_col, piece, start, length, ids_crc32, sequence_id, offset[, ids]): every piece of every document.

    A document is its ids and a closing id 0; one longer than capacity is cut into pieces of capacity of which
    the first may be shorter. Sequences hold at most capacity tokens, max_docs pieces and an attention cost
    (sum of squared lengths) of max_cost. max_docs None: the tightest limit that costs no sequence more, see
    evenest(). max_cost None: capacity squared, the cost of a piece that fills a sequence; lower ones bind, and need
    shorter pieces. Null or empty text is the closing id
    alone. A null id is packed like others. Repeated rows are packed once each. Other columns are dropped.
    No rows in: no rows out.
    """
    spark = docs.sparkSession
    prepare(spark)
    store = Store(spark)

    def cut(batches):
        return pieces(batches, tokenizer_path, capacity, with_ids)

    schema = "id long, piece int, start long, length long, crc long, nth long, part int, ids array<int>"
    cuts = store.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema))
    by_part = cuts.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    cost = float(capacity) ** 2 if max_cost is None else max_cost
    runs = evenest(counts, capacity, cost, rule)[1] if max_docs is None else plan(counts, capacity, max_docs=max_docs, max_cost=cost, rule=rule)
    per: dict[int, list] = {}
    for length, a, b, first, offset in runs:
        per.setdefault(length, []).append((a, b, first, offset))
    places = spark.createDataFrame(
        [(k, [r[0] for r in v], [r[2] - r[0] for r in v], [r[3] for r in v]) for k, v in per.items()],
        "length long, a array<long>, shift array<long>, at array<long>",
    )
    ranked = cuts.join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(F.broadcast(places), "length")  # the plan's size is bounded by the capacity
    hit = placed.withColumn("k", F.size(F.filter("a", lambda x: x <= F.col("rank"))) - 1)
    return hit.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        "length",
        F.col("crc").alias("ids_crc32"),
        (F.col("rank") + F.get("shift", F.col("k"))).alias("sequence_id"),
        F.get("at", F.col("k")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
