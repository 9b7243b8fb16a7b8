"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Tokens are runs of letters and digits of the lower-cased text. A mask hashes some positions of a span and
ignores the others, so a substituted token does not hide an overlap. Hashes of benchmark and documents are
joined; around every hit the aligned tokens are compared, and a window of enough equal tokens is an overlap.

The masks reach every overlap of the rule: whichever 4 of 20 tokens, 3 of 15 to 19 or 2 of 13 or 14 are
substituted, one mask lies on equal tokens alone (the tests try all placements). Items under 13 tokens are
matched exactly: wholly, in a row; those under 5 tokens only against documents of nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let

#: 1: position hashed, 0: ignored.
MASKS = ("1111011", "11000010111", "1101111")
#: An overlap is a window of so many aligned tokens (the whole item where it is shorter) ...
WINDOW = 20
#: ... of which this percentage at least are equal.
PERCENT = 80
#: Items of fewer tokens must be equal in all of them ...
LEAST = 13
#: ... and those of fewer than this to the whole document.
WHOLE = 5
#: Benchmark seeds sent to every executor with their tokens, about 350 bytes each.
BROADCAST_ROWS = 200_000
#: Above that, only the seeds are sent, about 40 bytes each, and the documents' seeds found among them are shuffled.
FILTER_ROWS = 4_000_000

TOKEN_GAP = r"[^\p{L}\p{N}]+"


def token_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), TOKEN_GAP), ""), lambda t: F.xxhash64(t))


def seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """One row for each mask and position of the tokens: kind (the mask) and at int, seed long.

    At the end of the tokens a seed is of those that there are: verification rules such hits out. seed is never
    null, since a join would filter nulls first; and what follows the generator is kept small, since a method of
    over 8000 bytes is not compiled to machine code.
    """
    n = len(masks)
    last = (F.size("tokens") - min(map(len, masks)) + 1) * n - 1
    rows = df.select("*", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("_k"))
    rows = rows.withColumn("at", F.expr(f"int(_k div {n})"))
    kind, value = F.col("_k") % n, None
    for k, m in enumerate(masks):
        one = F.xxhash64(*[F.get("tokens", F.col("at") + i) for i, c in enumerate(m) if c == "1"])
        value = F.when(kind == 0, one) if value is None else value.when(kind == k, one)
    return rows.withColumn("seed", F.xxhash64(kind, value)).withColumn("kind", kind).drop("_k")


def overlap(doc: Column, doc_at: Column, item: Column, item_at: Column, span: int, need: Column, percent: Column) -> Column:
    """Whether some window of ``need`` aligned tokens that holds ``span`` tokens from the hit on has enough equal ones.

    doc and item hold the tokens around the hit, doc_at and item_at are the hit's places in these arrays.
    """

    def windows(need: Column) -> Column:
        # starts, in the item, of the windows of `need` tokens that hold the span and lie in both texts
        lowest = F.greatest(F.lit(0), item_at + span - need, item_at - doc_at)
        highest = F.least(item_at, F.size(item) - need, item_at - doc_at + F.size(doc) - need)
        same = F.transform(
            F.sequence(F.lit(0), F.size(item) - 1), lambda q: F.when(F.get(doc, q - item_at + doc_at) == F.get(item, q), 1).otherwise(0)
        )
        found = let(
            same,
            lambda s: F.exists(
                F.sequence(lowest, highest), lambda b: F.aggregate(F.slice(s, b + 1, need), F.lit(0), lambda a, x: a + x) * 100 >= need * percent
            ),
        )
        return F.when(lowest <= highest, found).otherwise(F.lit(False))

    return let(need, windows)


def around(at: Column, span: int) -> tuple[Column, Column]:
    """The tokens that a window around a hit can reach, and the hit's place among them."""
    begin = F.greatest(F.lit(0), at - WINDOW + span)
    return F.slice("tokens", begin + 1, at - begin + WINDOW), at - begin


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id_col, item_col, hits long): documents and the benchmark items that they overlap, each pair once.

    An overlap is a window of 20 aligned tokens of both (of the whole item, where that has 13 to 19) of which 80
    per cent are equal; for an item of 5 to 12 tokens, all of them in a row; for a shorter one, a document of the
    same tokens and no others. Null texts and texts without tokens overlap nothing. Rows that share an id are one
    document; a null id or item is a value like others. hits counts the verified seed hits of the pair. Other
    columns are ignored. Empty tables: no rows. Documents are read and cut into tokens once, however many seeds
    the benchmark has.
    """
    items = benchmark.select(F.col(item_col).alias("item"), token_hashes(F.col(text_col)).alias("tokens"))
    size = F.size("tokens")
    # at most 20 rows, by length
    counts = {r.n: r.c for r in items.where(size > 0).groupBy(F.least(size, F.lit(WINDOW)).alias("n")).agg(F.sum(size.cast("long")).alias("c")).collect()}
    short = sorted(n for n in counts if WHOLE <= n < LEAST)
    masks = [*(MASKS if any(n >= LEAST for n in counts) else ()), *("1" * n for n in short)]
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), token_hashes(F.col(text_col)).alias("tokens"))
    whole = F.xxhash64("tokens").alias("seed")
    tiny = (size > 0) & (size < WHOLE)
    found = rows.where(tiny).select("id", whole, "tokens").join(items.where(tiny).select("item", whole, F.col("tokens").alias("theirs")), "seed").where("tokens = theirs").select("id", "item")
    if masks:
        span = min(map(len, masks))  # of every hit, so many tokens at least lie in the window that holds its mask
        near, place = around(F.col("at"), span)
        need = F.least(F.lit(WINDOW), size)
        length = F.get(F.array(*[F.lit(len(m)) for m in masks]), F.col("kind"))
        own_kind = F.when(size >= LEAST, F.col("kind") < len(masks) - len(short)).otherwise(length == size)
        item_seeds = seeds(items.where(size >= WHOLE), masks).where((F.col("at") + length <= size) & own_kind)
        item_seeds = item_seeds.select("seed", "item", near.alias("item_near"), place.alias("item_at"), need.alias("need"), F.when(size < LEAST, 100).otherwise(PERCENT).alias("percent"))
        many = sum(c * (len(MASKS) if n >= LEAST else 1) for n, c in counts.items() if n >= WHOLE)
        own = seeds(rows, masks)
        if many > BROADCAST_ROWS:
            known = item_seeds.select("seed").distinct()
            own = own.join(F.broadcast(known) if many <= FILTER_ROWS else known, "seed", "left_semi")
        if many > BROADCAST_ROWS:
            own = own.select("seed", "id", near.alias("near"), place.alias("near_at"))
        hits = own.join(F.broadcast(item_seeds) if many <= BROADCAST_ROWS else item_seeds, "seed")
        if many <= BROADCAST_ROWS:  # only the tokens that a window around the hit can reach go on
            hits = hits.select("id", "item", near.alias("near"), place.alias("near_at"), "item_near", "item_at", "need", "percent")
        # as a generator, since a filter would move into the join, whose probe side then leaves generated code
        # and buffers the tokens once for each position
        real = overlap(F.col("near"), F.col("near_at"), F.col("item_near"), F.col("item_at"), span, F.col("need"), F.col("percent"))
        seen = hits.select("id", "item", F.explode(F.when(real, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))))
        found = found.unionAll(seen.select("id", "item"))
    return found.groupBy("id", "item").agg(F.count("*").alias("hits")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """(id_col, kept boolean, n_items long, first_item): one row for each row of docs; kept: no overlap."""
    id_col, item_col = names.get("id_col", "doc_id"), names.get("item_col", "item_id")
    per = overlaps(docs, benchmark, **names).groupBy(F.col(id_col).alias("_id")).agg(F.count("*").alias("n"), F.min(item_col).alias("first_item"))
    out = docs.select(id_col).join(per, F.col(id_col).eqNullSafe(F.col("_id")), "left")
    return out.select(id_col, F.col("n").isNull().alias("kept"), F.coalesce("n", F.lit(0)).alias("n_items"), "first_item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """docs without the documents that overlap the benchmark; columns unchanged."""
    id_col, mark = names.get("id_col", "doc_id"), free(docs, "_id")
    bad = overlaps(docs, benchmark, **names).select(F.col(id_col).alias(mark)).distinct()
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col(mark)), "left_anti")
