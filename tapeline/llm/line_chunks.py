"""Line de-duplication over content-defined chunks of lines, with DataFrame functions only.

A hash over the hashes of the last two lines decides whether a chunk ends there, so boundaries follow the
content and survive shifts. A chunk that occurs before (smaller id, then earlier place), once its bytes equal
those of the first occurrence, is a repeat; it is extended line by line into the chunks on either side, as far
as their lines equal those around the first occurrence. Repeated runs of two lines or more are removed, and
lines of more than LINE_WORDS words, which are chunks of their own. Most lines end a chunk, since a passage of a few lines is found
only if a whole chunk lies inside it.

Passages that hold no whole chunk are missed. With whole=True every two neighbouring lines are a chunk, so
every repeated run of two lines or more goes, wherever it begins; and so is every line of more than LINE_WORDS
words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, dealt, free, let

#: A chunk ends where the rolling hash's first hexadecimal digit is none of these: at seven lines of eight on average.
GOES_ON = ("0", "1")
ROLL = 2
#: A repeated line of more words than this goes though no line beside it is repeated with it.
LINE_WORDS = 50
WORD_GAP = r"[\x20\x09-\x0D]+"
#: Occurrences of a chunk that are compared with its first one in one part.
PART = 500


def chunks(text: Column) -> Column:
    """array<struct<pos int, n int, prev int, next int, h long>>: every chunk, pos counting lines from 0, and how many
    lines the chunks before and after it have. A line of over LINE_WORDS words is a chunk of its own."""

    def ends(marks: Column) -> Column:
        def is_end(i: Column) -> Column:
            roll = F.md5(F.concat_ws("", *[F.get(marks, i - k)["m"] for k in range(ROLL, 0, -1)]))  # of the first line alone, at it
            return (i == F.size(marks)) | F.get(marks, i - 1)["own"] | F.get(marks, i)["own"] | ~F.substring(roll, 1, 1).isin(*GOES_ON)

        return F.filter(F.sequence(F.lit(1), F.size(marks)), is_end)

    def cut(lines: Column, at: Column) -> Column:
        def chunk(end: Column, j: Column) -> Column:
            begin = F.coalesce(F.get(at, j - 1), F.lit(0))
            before = F.when(j > 0, begin - F.coalesce(F.get(at, j - 2), F.lit(0))).otherwise(0)
            after = F.coalesce(F.get(at, j + 1) - end, F.lit(0))
            return F.struct(begin.alias("pos"), (end - begin).alias("n"), before.alias("prev"), after.alias("next"), F.xxhash64(F.slice(lines, begin + 1, end - begin)).alias("h"))

        return F.transform(at, chunk)

    return let(
        F.split(text, "\n"),
        lambda lines: let(
            F.transform(lines, lambda x: F.struct(F.substring(F.md5(x), 1, 8).alias("m"), long_line(x).alias("own"))), lambda marks: let(ends(marks), lambda at: cut(lines, at))
        ),
    )


def in_common(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from the first on."""
    same = F.transform(a, lambda x, i: x.eqNullSafe(F.get(b, i)))
    at = F.array_position(same, F.lit(False))
    return F.when(at == 0, F.size(a)).otherwise(at - 1).cast("int")


def long_line(line: Column) -> Column:
    words = F.array_remove(F.split(line, WORD_GAP), "")
    return (F.length(line) > 2 * LINE_WORDS) & (F.size(words) > LINE_WORDS)  # the length is cheap


def rolls(text: Column) -> Column:
    """The same of every two neighbouring lines and of every line of more than LINE_WORDS words, without neighbours."""

    def all_of(lines: Column) -> Column:
        def pair(i: Column) -> Column:
            return F.struct(i.alias("pos"), F.lit(2).alias("n"), F.lit(0).alias("prev"), F.lit(0).alias("next"), F.xxhash64(F.get(lines, i), F.get(lines, i + 1)).alias("h"))

        def one(i: Column) -> Column:
            return F.struct(i.alias("pos"), F.lit(1).alias("n"), F.lit(0).alias("prev"), F.lit(0).alias("next"), F.xxhash64(F.get(lines, i)).alias("h"))

        def is_long(i: Column) -> Column:
            return long_line(F.get(lines, i))

        places = F.sequence(F.lit(0), F.size(lines) - 1)
        return F.concat(F.transform(F.filter(places, lambda i: i < F.size(lines) - 1), pair), F.transform(F.filter(places, is_long), one))

    return let(F.split(text, "\n"), all_of)


def without(text: Column, removed: Column) -> Column:
    """Text without the lines of removed, an array<struct<pos, n>> sorted by pos."""

    def rest(lines: Column, gone: Column) -> Column:
        def run(j: Column) -> Column:
            begin = F.coalesce(F.get(gone, j - 1)["pos"] + F.get(gone, j - 1)["n"], F.lit(0))
            end = F.coalesce(F.get(gone, j)["pos"], F.size(lines))
            return F.slice(lines, begin + 1, end - begin)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), run)), "\n")

    return let(F.split(text, "\n"), lambda lines: let(removed, lambda gone: rest(lines, gone)))


def drop_repeated_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, whole: bool = False, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with n_lines long, n_removed long (lines) and text_col without the repeated chunks.

    Chunks are judged on the input. The first occurrence stays; of rows that repeat the same id and text each
    keeps what the others keep. A null id sorts before all others. Null text stays null (0 lines); empty text
    is one empty line. A text may become empty. A chunk whose hash equals that of an earlier one but whose
    bytes differ stays; lines that extend a chunk are compared by 64-bit hashes. min_lines: lines of the shortest run
    that goes, but for single lines of over LINE_WORDS words. ``counts`` are the names of both new columns; columns of docs so named are replaced. No
    rows in: no rows out.
    whole takes the chunks of rolls(), and min_lines has no effect. These overlap, so that the first occurrence
    of every line stays, but not always that of a pair: of one line many times over, one is left.
    """
    store = Store(docs.sparkSession)
    names = [c for c in docs.columns if c not in (*counts, text_col)]
    own_id, own_hash = free(docs, "_id"), free(docs, "_th")
    rows = docs.select(*names, text_col).withColumn(own_hash, F.xxhash64(text_col))
    key = ["_id", "_th"]
    slim = rows.select(F.col(id_col).alias("_id"), F.col(own_hash).alias("_th"), F.col(text_col).alias("_text"))
    cut = rolls(F.col("_text")) if whole else chunks(F.col("_text"))
    held = slim.where(F.col("_text").isNotNull()).select(*key, F.inline(cut))
    place = F.struct("_id", "_th", "pos")
    # a chunk that many documents hold is dealt out by its count, here and where its bytes are compared
    seen = store.save(held.groupBy("h").agg(F.count("*").alias("c"), F.min(place).alias("first")).where("c > 1"))
    some, firsts, on = dealt(held, seen, ["h"], "c", "_id", "_th", "pos")
    found = some.join(firsts, on)
    found = found.withColumn("is_first", F.equal_null(place, F.col("first"))).withColumn("parts", (1 + F.floor(F.col("c") / PART)).cast("int"))
    found = found.groupBy(*key).agg(F.collect_set(F.struct("pos", "n", "prev", "next", "h", "is_first", "parts")).alias("found"))
    # the same columns as below where docs has no others: both joins then read one exchange of the texts
    with_text = rows.alias("s").join(found.alias("f").hint("merge"), _same("s", own_hash, id_col, "f", "_th", "_id"))
    marks = lambda lines: F.transform(lines, lambda x: F.xxhash64(x))

    def piece(lines: Column) -> Column:
        return F.transform(
            "f.found",
            lambda c: F.struct(
                *(c[k].alias(k) for k in ("pos", "n", "h", "is_first", "parts")),
                F.array_join(F.slice(lines, c["pos"] + 1, c["n"]), "\n").alias("body"),
                F.reverse(marks(F.slice(lines, c["pos"] - c["prev"] + 1, c["prev"]))).alias("before"),
                marks(F.slice(lines, c["pos"] + c["n"] + 1, c["next"])).alias("after"),
            ),
        )

    pieces = with_text.select(F.col(f"s.{id_col}").alias("_id"), F.col(f"s.{own_hash}").alias("_th"), F.inline(let(F.split(f"s.{text_col}", "\n"), piece)))
    firsts = pieces.where("is_first").select("h", "parts", F.col("body").alias("first_body"), F.col("before").alias("first_before"), F.col("after").alias("first_after")).dropDuplicates(["h"])
    firsts = firsts.select("h", "first_body", "first_before", "first_after", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rest = pieces.where("not is_first").withColumn("part", F.pmod(F.xxhash64(*key), F.col("parts")).cast("int"))
    gone = rest.join(firsts, ["h", "part"]).where("body = first_body")
    back, fore = in_common(F.col("before"), F.col("first_before")), in_common(F.col("after"), F.col("first_after"))
    gone = gone.select(*key, (F.col("pos") - back).alias("pos"), (F.col("n") + back + fore).alias("n"), "body")
    gone = gone.where((F.col("n") >= min_lines) | ((F.col("n") == 1) & long_line(F.col("body"))))
    gone = gone.groupBy(*key).agg(F.collect_set(F.struct("pos", "n")).alias("gone"))
    # line by line, since chunks may overlap
    each = F.array_distinct(F.flatten(F.transform("gone", lambda c: F.sequence(c["pos"], c["pos"] + c["n"] - 1))))
    gone = gone.select(*key, F.transform(F.sort_array(each), lambda i: F.struct(i.alias("pos"), F.lit(1).alias("n"))).alias("gone"))
    gone = gone.select(F.col("_id").alias(own_id), F.col("_th").alias(own_hash), "gone")
    out = rows.alias("l").join(gone.alias("g").hint("merge"), _same("l", own_hash, id_col, "g", own_hash, own_id), "left")
    text = F.when(F.col("g.gone").isNull(), F.col(f"l.{text_col}")).otherwise(without(F.col(f"l.{text_col}"), F.col("g.gone")))
    lines = F.when(F.col(f"l.{text_col}").isNull(), 0).otherwise(F.size(F.split(f"l.{text_col}", "\n")))
    removed = F.coalesce(F.aggregate("g.gone", F.lit(0), lambda a, c: a + c["n"]), F.lit(0))
    return out.select(*(F.col(f"l.{c}") for c in names), text.alias(text_col), lines.cast("long").alias(counts[0]), removed.cast("long").alias(counts[1]))


def _same(a: str, hash_a: str, id_a: str, b: str, hash_b: str, id_b: str) -> Column:
    return (F.col(f"{a}.{hash_a}") == F.col(f"{b}.{hash_b}")) & F.col(f"{a}.{id_a}").eqNullSafe(F.col(f"{b}.{id_b}"))
