"""Training-data operators against brute force, and their odd inputs."""

import html as H
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tapeline.llm import chat, cotrain, embeddings, hilbert, html, kernels, line_chunks, minhash, packing, spaced_seeds, substring
from tapeline.llm.common import Store, connected_components
from tapeline.llm.oracles import ORACLES
from tapeline.llm.queries import QUERIES

SF = f"{DATA}/sf0.001"
DOC = "doc_id long, text string"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df())


def odd_docs(spark, extra=""):
    """Nulls, empty, white space, repeated rows, a null id, a long text, columns named like results."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (4, "one two"), (None, "one two"), (5, long), (6, long), (7, "a\n\nb\nc\nd"), (8, "\x00 odd \x1f ü ６   end")]
    df = spark.createDataFrame(rows, DOC)
    for c in ("id", "kept", "n_words", "shard", "slot", "component_id", "n_lines", "tokens", "hilbert", "p_low", "k", "at", "lang", "source", "n_chars"):
        df = df.withColumn(c, F.lit(None).cast("long") if c == "n_chars" else F.lit("x" if c != "lang" else None))
    return df


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# shared parts


def test_kernel_words_are_exact_and_context_free():
    import pyarrow as pa

    rnd = random.Random(1)
    vocab = ["a", "bb", "Ünder", "日本", "x" * 300, "end.", "\x00"]
    texts = [rnd.choice([" ", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.randrange(60))) for _ in range(300)] + [None, "", " ", "x" * 3_000_000, "y " * 3_000_000]
    seen = {}
    got = {}
    for w in kernels.words(pa.array(texts)):
        for r in range(len(w.base) - 1):
            got[w.first + r] = w.h[w.base[r] : w.base[r + 1]].tolist()
    for i, t in enumerate(texts):
        ws = words(t)
        assert len(got[i]) == len(ws)
        for x, h in zip(ws[:200], got[i][:200], strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_against_a_loop(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Store(spark)).collect()}
    assert got == {x: find(x) for x in list(root)}


# 1


def test_cotraining_held_out_accuracy(spark):
    """On a quarter of the labels, of which no training, calibrating or deciding row is one."""
    docs, labels = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    test = F.col("doc_id") % 4 == 0
    trained = cotrain.train(docs, labels.where(~test))
    got = cotrain.judge_stored(trained).join(labels.where(test), "doc_id").toPandas()
    bad = (got.quality == 0) | (got.toxic == 1)
    assert (got.kept == ~bad).mean() > 0.98
    assert (~got.kept[~bad]).mean() < 0.01
    assert trained.model.report["low"]["both"]["accuracy"] > 0.98
    # both views teach: text both values, metadata (which knows nothing of either property here) the common one
    assert {k for k, n in trained.taught.items() if n} >= {("text", "low", 1), ("text", "low", 0), ("text", "toxic", 1), ("meta", "toxic", 0)}


def test_cotraining_stored_equals_read_again(spark, same):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    trained = cotrain.train(docs, labels)
    again = cotrain.judge(docs, trained.model).select("doc_id", "p_low", "p_toxic", "kept")
    same(cotrain.judge_stored(trained).toPandas(), again.toPandas())


def test_cotraining_odd_inputs(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (5, None, 1), (None, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        trained = cotrain.train(docs, marks)
        out = cotrain.judge(docs, trained.model)
        assert out.count() == docs.count() == cotrain.judge_stored(trained).count() and out.where("kept is null").count() == 0
    named = cotrain.judge(docs, trained.model, names=("a1", "a2", "a3"))
    assert {r.kept for r in named.select("kept").collect()} == {"x"} and dict(named.dtypes)["a3"] == "boolean"
    empty = docs.limit(0)
    trained = cotrain.train(empty, labels)
    assert cotrain.judge(empty, trained.model).count() == cotrain.judge_stored(trained).count() == 0


def test_confident_views_teach_each_other(spark):
    """A source that is always bad lets the metadata view label; both views then serve."""
    rnd = random.Random(2)
    mk = lambda bad: " ".join(rnd.choice(["vile", "junk", "spam"] if bad else ["fine", "good", "calm"]) + str(rnd.randrange(50)) for _ in range(30))
    rows = [(i, mk(i % 3 == 0), "en", "bad.com" if i % 3 == 0 else "ok.com", 100) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.where("doc_id < 600").selectExpr("doc_id", "cast(doc_id % 3 != 0 as int) quality", "0 toxic")
    trained = cotrain.train(docs, labels)
    assert all(trained.taught[(k, "low", v)] for k in ("text", "meta") for v in (1, 0))
    got = cotrain.judge_stored(trained).where("doc_id >= 600").toPandas()
    assert (got.kept == (got.doc_id % 3 != 0)).all()


# 2


def test_hilbert_index_is_a_curve(spark):
    """Every cell once, and neighbours on the curve differ by one step in one dimension."""
    for dims, bits in ((2, 3), (3, 2)):
        cells = list(itertools.product(range(2**bits), repeat=dims))
        df = spark.createDataFrame([(list(c),) for c in cells], "c array<int>")
        got = {r.h: r.c for r in df.select("c", hilbert.hilbert_index(F.col("c"), dims, bits).alias("h")).collect()}
        assert sorted(got) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1], strict=True)) == 1 for i in range(len(cells) - 1))


def test_hilbert_law_and_slots(spark):
    got = QUERIES["op2_hilbert"](spark, SF).toPandas()
    n = got.groupby("shard").size()
    assert set(got.shard) == set(range(16)) and n.max() - n.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    order = got.sort_values(["shard", "slot"]).hilbert
    assert order.is_monotonic_increasing
    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and len(text[r.doc_id].encode()) + 1 == r.size for r in got.itertuples())


def test_hilbert_odd_inputs(spark, tmp_path):
    docs = odd_docs(spark)
    out = hilbert.hilbert_shards(docs, ["lang", "n_chars", "source"], n_shards=3)
    assert sorted(r["count"] for r in out.groupBy("shard").count().collect()) == [3, 3, 4]
    assert hilbert.hilbert_shards(docs.limit(0), ["lang"]).count() == 0
    hilbert.write_shards(out.select("doc_id", "shard", "slot"), str(tmp_path / "s"), ["lang"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


def test_strings_are_cut_whole(spark):
    """Values with a long common beginning fall into different cells, in their order and evenly."""
    rows = [(i, f"https://www.example.com/a/very/long/path/{i % 40:03d}", None) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, url string, none string")
    store = Store(spark)
    got = df.select("url", *(c.alias(n) for c, n in zip(hilbert.quantised(df, ["url", "none"], 3, store), ("u", "z"), strict=True))).toPandas()
    assert got.groupby("u").url.nunique().to_dict() == dict.fromkeys(range(8), 5) and set(got.z) == {0}
    assert got.sort_values("url").u.is_monotonic_increasing


def test_written_shards_prune_by_every_dimension(spark, tmp_path):
    """Of 64 files, a range of any one dimension touches far fewer than in any other order of the rows."""
    import pyarrow.parquet as pq

    rnd = random.Random(4)
    rows = [(i, rnd.random(), rnd.random(), rnd.random()) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, a double, b double, c double")
    hilbert.write_shards(hilbert.hilbert_shards(df, ["a", "b", "c"], n_shards=64), str(tmp_path / "s"), ["a", "b", "c"])
    files = list((tmp_path / "s").rglob("*.parquet"))
    assert len(files) == 64
    for c in ("a", "b", "c"):
        ends = []
        for f in files:
            group = pq.ParquetFile(f).metadata.row_group(0)
            col = next(group.column(k).statistics for k in range(group.num_columns) if group.column(k).path_in_schema == c)
            ends.append((col.min, col.max))
        assert sum(lo <= 0.55 and hi >= 0.45 for lo, hi in ends) < 40


# 3


def plain_repeats(docs, window=20):
    seen, gone = {}, defaultdict(set)
    for d, t in sorted(docs):
        ws = words(t)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i : i + window])
            if seen.setdefault(key, (d, i)) != (d, i):
                gone[d].update(range(i, i + window))
    return {d: (len(words(t)), len(gone[d]), " ".join(w for i, w in enumerate(words(t)) if i not in gone[d])) for d, t in docs}


@pytest.mark.parametrize("seed", range(3))
def test_substring_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(3 if seed == 0 else 40)]
    base = [rnd.choice(vocab) for _ in range(400)]
    docs = []
    for d in rnd.sample(range(-500, 500), 40):
        a, n = rnd.randrange(300), rnd.randrange(5, 90)
        mid = base[a : a + n]
        if rnd.random() < 0.3 and mid:
            mid[rnd.randrange(len(mid))] = "odd"
        docs.append((d, " ".join([rnd.choice(vocab) for _ in range(rnd.randrange(30))] + mid + [rnd.choice(vocab) for _ in range(rnd.randrange(30))])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(spark.createDataFrame(docs, DOC).repartition(5)).collect()}
    assert got == plain_repeats(docs)


def test_substring_odd_inputs(spark):
    docs = odd_docs(spark)
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.remove_repeats(docs).collect()}
    want = {d: v for d, v in plain_repeats([(r.doc_id, r.text) for r in docs.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]).collect()]).items()}
    assert got == {(d, n, k) for d, (n, k, _) in want.items()} | {(None, 2, 0)}
    assert substring.remove_repeats(docs).count() == docs.count()
    assert substring.remove_repeats(docs.limit(0)).count() == 0


# 4


def test_chat_round_trip(spark):
    odd = ["", None, "<|im_end|>\n", "<\\|im_start|>", "<", "|", "a<\\\\|b", "x\n<|im_start|>assistant\ny", "<<|<\\|"]
    roles = ["user", "assistant", "system", "assistant", "we%ird\n|role", None]
    turns = [(c, t, roles[(c + t) % len(roles)], odd[(c * 3 + t) % len(odd)]) for c in range(12) for t in range(c % 5 + 1)] + [(None, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chat(df)
    got = out.select("*", chat.read_chat(F.col("formatted")).alias("t"), F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)").alias("under")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.conv_id].append(r)
    for c in {t[0] for t in turns}:
        mine = [(t[2] or "", t[3] or "") for t in turns if t[0] == c]
        ex = sorted(by[c], key=lambda r: r.example)
        assert [(t.role, t.text) for t in ex[-1].t] == mine
        plain = lambda s: re.sub(r"<(\\*)\\\|", r"<\1|", s)
        loss = [plain(r.under) for r in ex if r.loss_end > r.loss_start or mine[r.n_turns - 1][0] == "assistant"]
        assert loss == [t for role, t in mine if role == "assistant"]
        assert [r.n_turns for r in ex] == sorted({i + 1 for i, (role, _) in enumerate(mine) if role == "assistant"} | {len(mine)})
    assert chat.format_chat(df.limit(0)).count() == 0


# 5


def test_fast_ids_equal_the_tokenizers_file(spark):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(BPE)
    slow.encode_special_tokens = True
    docs = [r.text for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect()]
    assert len(docs) > 500
    for t in ["", "Hello  world\n\n don't <|endoftext|> 12345 日本語 é́   \U0001f600", "a" * 5000, "\t\t  x", "tion" * 900, *docs]:
        assert packing.encoder(BPE)(t).tolist() == slow.encode(t, add_special_tokens=False).ids


def fewest_bins(pieces, caps):
    """The least number of bins, by trying all ways."""
    best = len(pieces)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(pieces):
            best = len(bins)
            return
        need = (pieces[k], 1, pieces[k] ** 2)
        for i, b in enumerate(bins):
            left = tuple(x - y for x, y in zip(b, need, strict=True))
            if min(left) >= 0 and b not in bins[:i]:
                place(k + 1, [*bins[:i], left, *bins[i + 1 :]])
        place(k + 1, [*bins, tuple(x - y for x, y in zip(caps, need, strict=True))])

    place(0, [])
    return best


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_against_the_optimum(rule):
    """Small cases where each of the capacities binds: never more than one bin above the optimum, mostly none."""
    rnd = random.Random(11)
    above = 0
    for k in range(60):
        pieces = sorted((rnd.randint(1, 12) for _ in range(9)), reverse=True)
        caps = (20, rnd.choice([2, 3, 9]), rnd.choice([144, 180, 400]))
        counts = defaultdict(int)
        for p in pieces:
            counts[p] += 1
        got = packing.bins_of(packing.plan(counts, caps[0], max_docs=caps[1], max_cost=float(caps[2]), weights=(1.0, 1.0, 1.0), rule=rule))
        best = fewest_bins(pieces, caps)
        assert best <= got <= best + 1
        above += got > best
    assert above <= 12


def test_document_limit_is_tight_and_free():
    counts = {1: 3000, 700: 900, 1300: 880, 5: 400}
    limit, runs = packing.evenest(counts, 2048, 2048.0**2, "norm")
    alone = packing.bins_of(packing.plan(counts, 2048, max_docs=2048, max_cost=2048.0**2))
    assert packing.bins_of(runs) == alone and limit < 64
    held = defaultdict(int)
    for length, a, b, first, _ in runs:
        for k in range(b - a):
            held[first + k] += 1
    assert max(held.values()) <= limit and sum(held.values()) == sum(counts.values())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_places_every_piece(spark, rule):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd_docs(spark).selectExpr("doc_id + 1000000 AS doc_id", "text"))
    got = packing.pack(docs, BPE, capacity=256, max_docs=6, max_cost=70_000.0, rule=rule, with_ids=True).toPandas()
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 256).all() and (by.size() <= 6).all() and (by.length.apply(lambda x: (x**2).sum()) <= 70_000).all()
    assert all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    want = defaultdict(int)
    for r in docs.collect():
        want[(r.doc_id, tuple([*packing.encoder(BPE)(r.text or "").tolist(), 0]))] += 1
    assert sum(len(k[1]) * v for k, v in want.items()) == got.length.sum()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.itertuples())
    one = got[got.doc_id == 1_000_005].sort_values("piece")
    assert [i for x in one.ids for i in x] == next(list(k[1]) for k in want if k[0] == 1_000_005)
    assert (one.length.iloc[1:] == 256).all()


def test_packing_is_tight():
    rnd = random.Random(0)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, 1 + int(rnd.expovariate(1 / 500)))] += 1
    runs = packing.plan(counts, 2048, max_docs=2048, max_cost=2048.0**2)
    bins = max(first + b - a for _, a, b, first, _ in runs)
    assert bins <= 1.002 * -(-sum(k * v for k, v in counts.items()) // 2048)


def test_packing_nothing(spark):
    assert packing.pack(odd_docs(spark).limit(0), BPE).count() == 0


# 6


def plain_components(docs, percent=75):
    sets = {}
    for d, t in docs:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_minhash_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rnd = random.Random(4)
    base = [f"t{rnd.randrange(2000)}" for _ in range(150)]
    docs = []
    for d in range(150):  # one group whose members link to some of the others only
        w = list(base)
        for _ in range(rnd.randrange(12)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(10**6)}"
        docs.append((d, " ".join(w)))
    docs += [(1000 + i, docs[i % 7][1].upper()) for i in range(30)] + [(2000, "a b"), (2001, "A  b"), (2002, "a b c"), (2003, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(docs, DOC)).collect()}
    assert got == plain_components(docs)


def test_minhash_makes_bands_twice(spark, monkeypatch):
    """For the buckets' sizes and for their members; what comes after reads the members that are stored."""
    plans, save = [], Store.save
    monkeypatch.setattr(Store, "save", lambda self, df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or save(self, df))
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*words[: 60 - i], f"x{i}"])) for i in range(4)]
    got = minhash.near_duplicates(spark.createDataFrame(docs, DOC))
    assert {r.component_id for r in got.collect()} == {0}
    assert sum(p.count("posexplode") for p in plans) == 2


def test_minhash_pruning_bound():
    least = minhash.least_matches(0.75, 1e-6)
    assert sorted(least) == [32, 64, 96, 128] and least[128] < 96 and all(least[m] > m * 0.3 for m in least)


def test_minhash_odd_inputs(spark):
    docs = odd_docs(spark)
    got = minhash.near_duplicates(docs)
    by = {(r.doc_id, r.component_id, r.kept) for r in got.collect()}
    assert by == {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (None, None, True), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True)}
    assert got.count() == docs.count()
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


# 7


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "TILE", 16)
    rnd = np.random.default_rng(0)
    centre = rnd.normal(size=(4, 8))
    rows = []
    for i in range(160):
        v = centre[i % 4] + rnd.normal(size=8) * rnd.choice([0.02, 0.1, 0.4])
        rows.append((i, [float(x) for x in (v if i % 9 else centre[0] * 3)], i % 3 if i % 11 else None))
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] * 8, 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [], 1), (None, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit(1))
    ok = {i: (np.array(v), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    root, links = {r[0]: r[0] for r in rows}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ok, 2):
        (u, p), (v, q) = ok[a], ok[b]
        if p == q and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
            links[a] += 1
            links[b] += 1
            if a is not None and b is not None:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(df).collect()}
    assert got == {i: (links[i], None if i is None else find(i)) for i in root}
    assert embeddings.near_duplicate_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    v = np.random.default_rng(1).normal(size=(300, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    tile = embeddings.Tile(np.arange(300), np.ones(300, np.int64), *embeddings.quantise(v))
    product, off = embeddings.bounds(tile, tile)
    assert (np.abs(product - v @ v.T) <= off).all() and off.max() < 0.1
    back = embeddings.Tile.read(tile.packed(), 64)
    assert all((x == y).all() for x, y in zip(tile, back, strict=True))


def test_int8_settles_most_pairs():
    """Of pairs of random vectors and near copies, the int8 products leave a few open; these are near the threshold."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 64))
    v = np.vstack([v, v + rng.normal(size=v.shape) * 0.02, v + rng.normal(size=v.shape) * 0.2])
    v /= np.linalg.norm(v, axis=1)[:, None]
    tile = embeddings.Tile(np.arange(600), np.ones(600, np.int64), *embeddings.quantise(v))
    sure, open_ = embeddings.split(tile, tile, True, 0.98)
    cos = v @ v.T
    assert (cos[sure] >= 0.98).all() and len(sure[0]) > 150
    assert 0 < len(open_[0]) < 500 and (np.abs(cos[open_] - 0.98) < 0.05).all()
    rest = np.triu(np.ones_like(cos, bool), 1)
    rest[sure] = rest[open_] = False
    assert (cos[rest] < 0.98).all()


# 8


def test_pages_against_their_article(spark):
    got = QUERIES["op8_min_cut_html"](spark, SF).toPandas().set_index("page_id")
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        assert got.text[r.page_id] == article(r.html)


def mute(page):
    """The page with div for every telling element and without class names."""
    return re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(nav|article|footer)\b[^>]*>", r"<\1div>", page))


def article(page):
    inner = page[page.index("<article>") + 9 : page.rindex("</article>")]
    parts = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)[^>]*>", inner))
    return "\n".join(p for p in parts if p)


@pytest.mark.parametrize("headings", [True, False])
def test_the_cut_decides_where_names_say_nothing(headings):
    """Of pages without article, nav, footer and class names nearly all still equal their article; the cut changes many
    labels, and without it, by the costs of each block alone, far more pages are wrong, without headings too."""
    pages = pd.read_parquet(f"{DATA}/sf0.1/pages.parquet").html
    change = mute if headings else lambda h: re.sub(r"<(/?)h1>", r"<\1div>", mute(h))
    model = html.default_model()
    alone = model.without_edges()
    wrong, changed = [0, 0], 0
    for h in pages:
        blocks = html.blocks_of(change(h))
        got = [html.label(blocks, m) for m in (model, alone)]
        changed += sum(a != b for a, b in zip(*got, strict=True))
        for k in (0, 1):
            wrong[k] += "\n".join(b.text for b, x in zip(blocks, got[k], strict=True) if x) != article(h)
    assert 2 * wrong[0] < wrong[1] and changed > 100 and wrong[0] < (10 if headings else 150)


def test_edges_help_on_made_pages():
    from tapeline.llm.page_samples import labelled_pages

    model = html.default_model()
    wrong = [0, 0]
    for page, truth in labelled_pages(300, seed=99):
        blocks = html.blocks_of(page)
        for k, m in enumerate((model, model.without_edges())):
            wrong[k] += sum(x != (b.text in truth) for b, x in zip(blocks, html.label(blocks, m), strict=True))
    assert wrong[0] < wrong[1] and (model.near > 0).any() and model.kin > 0


def test_every_page_equals_its_article_at_every_scale():
    model = html.default_model()
    pages = pd.read_parquet(f"{DATA}/sf0.1/pages.parquet").html
    assert all(html.main_text(h, model)[0] == article(h) for h in pages)


def test_boilerplate_of_other_shapes():
    page = """<body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies on this site and many more words here</div>
    <div id=main><h2>Title &amp; more</h2><p>First   paragraph of the story<br>with a break and enough words.<p>Second paragraph <a href=x>with a link</a> inside it.
    <div class="advert"><p>Buy this thing now because it is cheap and good</p></div><p>Third one ends &copy; here.</p><form><label>Your mail</label><input></form></div>
    <aside><p>Other stories that you may like to read today</p></aside><div class="comments"><article><p>I disagree with all of this, said a reader.</p></article></div>
    <footer>All rights</footer><script>var a = "<p>no</p>";</script></body>"""
    text, blocks, kept = html.main_text(page)
    assert text == "Title & more\nFirst paragraph of the story with a break and enough words.\nSecond paragraph with a link inside it.\nThird one ends © here."
    assert blocks > kept == 4


def _text(n, word):
    return " ".join(f"{word}{i}" for i in range(n)) + "."


def _own(*sizes):
    return "".join(f"<p>{_text(n, 'own')}</p>" for n in sizes)


SHAPES = {
    "long sidebar": f"<article><h1>own</h1>{_own(40, 30)}</article><aside><p>{_text(80, 'bad')}</p><p>{_text(60, 'bad')}</p></aside><footer><p>{_text(40, 'bad')}</p></footer>",
    "long footer": f"<article><h1>own</h1>{_own(5)}</article><footer><p>{_text(120, 'bad')}</p><p>{_text(100, 'bad')}</p></footer>",
    "comments": f"<main><h1>own</h1>{_own(40, 30)}</main><section class='comments'><article><p>{_text(80, 'bad')}</p></article><article><p>{_text(70, 'bad')}</p></article></section>",
    "notice": f"<div class='cookie-banner'><p>{_text(60, 'bad')}</p></div><article><h1>own</h1>{_own(20)}</article>",
    "advert inside": f"<article><h1>own</h1>{_own(20)}<div class='advertisement'><p>{_text(30, 'bad')}</p></div>{_own(25)}<div class='share'><a href=x>bad0</a></div>{_own(10)}</article>",
    "form inside": f"<article><h1>own</h1>{_own(20)}<form><p>{_text(12, 'bad')}</p><button>bad0</button></form>{_own(25)}</article>",
    "contents inside": f"<article><h1>own</h1><nav><ol><li><a href='#a'>bad0 bad1</a></li><li><a href='#b'>bad2</a></li></ol></nav>{_own(20, 25)}</article>",
    "short paragraphs": f"<article><h1>own</h1><p>own1.</p><p>own2.</p>{_own(20)}<p>own3</p></article><footer>bad1 bad2</footer>",
    "lists and tables": f"<article><h1>own</h1>{_own(20)}<ul><li>{_text(8, 'own')}</li><li>{_text(5, 'own')}</li></ul><table><tr><td>own1</td><td>own2</td></tr></table>{_own(10)}</article><div class='ad'>bad here.</div>",
    "links in the text": f"<article><h1>own</h1>{_own(20)}<p><a href=x>own5 own6</a> own8</p><p><a href=x>own9 own10</a></p>{_own(10)}</article>",
    "headers": f"<header><h1>bad0 Site</h1><p>{_text(9, 'bad')}</p></header><article><header><h1>own</h1><p>{_text(6, 'own')}</p></header>{_own(20)}</article>",
    "sidebar first": f"<div class='sidebar'><h2>bad0</h2><p>{_text(70, 'bad')}</p></div><div class='content'><h1>own</h1>{_own(20, 9)}</div>",
    "empty": "<nav><a href=x>bad0</a></nav><article></article><footer>bad1 bad2 bad3</footer>",
    "short": "<nav><a href=x>bad0</a></nav><article><h1>own</h1><p>own1</p></article><footer>bad1 bad2</footer>",
    "newsletter": f"<article><h1>own</h1>{_own(50)}</article><div class='newsletter'><h3>bad0</h3><p>{_text(25, 'bad')}</p></div>",
    "plain boxes": f"<div class='post'><h1>own</h1><div>{_text(30, 'own')}</div><div>{_text(20, 'own')}</div></div><div class='related'><p>{_text(30, 'bad')}</p></div>",
}


@pytest.mark.parametrize("deep", [False, True])
@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_shapes_of_pages(shape, deep):
    page = SHAPES[shape]
    if deep:
        page = "<div>" * 4 + page.replace("<h1>own</h1>", "<div><div><h1>own</h1></div></div>") + "</div>" * 4
    blocks = html.blocks_of(f"<!DOCTYPE html><html><body>{page}</body></html>")
    assert html.main_text(page)[0].split("\n") == ([b.text for b in blocks if "own" in b.text] or [""])


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(0)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        s, t = [rnd.random() * 3 for _ in range(n)], [rnd.random() * 3 for _ in range(n)]
        edges = [(i, j, rnd.random()) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(c for i, j, c in edges if x[i] != x[j])  # noqa: B023, E731
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(html.minimum_cut(s, t, edges)) - best) < 1e-9


def test_html_odd_inputs(spark):
    rows = [(1, None, "u"), (1, None, "u"), (2, "", None), (3, "<p>" + "long words go on " * 50_000, "u"), (None, "<<a <b", "u"), (4, "<article>a</div></p>&#x41;&nbsp;&bogus;</article>", "u")]
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, html string, url string").withColumn("text", F.lit("old")))
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == 6 and got[1] == got[2] == "" and len(got[3]) == 50_000 * 17 - 1 and got[4] == "a\nA &bogus;"
    assert html.extract_main_text(out.limit(0).withColumn("html", F.lit("x"))).count() == 0


# 9


def test_line_chunks_odd_inputs(spark):
    docs = odd_docs(spark).unionByName(odd_docs(spark).where("doc_id = 7").withColumn("doc_id", F.lit(70).cast("long")))
    out = line_chunks.drop_repeated_chunks(docs)
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert out.count() == docs.count() and (1, None) in got and (2, "") in got and (7, "a\n\nb\nc\nd") in got
    assert next(t for d, t in got if d == 70) == ""
    assert line_chunks.drop_repeated_chunks(docs.limit(0)).count() == 0


def test_line_chunks_resist_shifts(spark):
    body = [f"line {i} of the passage" for i in range(60)]
    docs = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new start", *body, "and an end"]))], DOC)
    got = {r.doc_id: r.n_removed for r in line_chunks.drop_repeated_chunks(docs).collect()}
    assert got[1] == 0 and got[2] >= 40


def test_passages_of_a_few_lines_are_mostly_found(spark):
    """Passages of 2 to 8 lines and over 50 words inside other documents: nine tenths of their words go, nothing of the
    lines around them, and every line stays somewhere."""
    rnd = random.Random(14)
    line = lambda: " ".join(f"c{rnd.randrange(10**6)}" for _ in range(26))
    docs, passages, own = [], {}, {}
    for n in range(2, 9):
        for k in range(30):
            passage, mine, d = [line() for _ in range(n)], [line() for _ in range(4)], 10_000 + 100 * n + k
            docs += [(100 * n + k, "\n".join([line(), *passage, line()])), (d, "\n".join([*mine[:2], *passage, *mine[2:]]))]
            passages[d], own[d] = passage, mine
    got = {r.doc_id: r.text.split("\n") for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(docs, DOC)).collect()}
    left = sum(x in got[d] for d in passages for x in passages[d])
    assert left < 0.1 * sum(map(len, passages.values()))
    assert all(x in got[d] for d in own for x in own[d])
    assert all(got[d] == t.split("\n") for d, t in docs if d < 10_000)


def test_lines_and_copies_by_the_chunk_rule(spark):
    """Repeated lines of over 50 words go alone, none of 50; exact copies go wholly."""
    rnd = random.Random(15)
    line = lambda n: " ".join(f"c{rnd.randrange(10**6)}" for _ in range(n))
    docs, lines = [], {}
    for k in range(60):
        x = line(51 if k < 40 else 50)
        lines[1000 + k] = x
        docs += [(k, f"{line(9)}\n{x}\n{line(7)}"), (1000 + k, f"{line(6)}\n{line(5)}\n{x}\n{line(8)}")]
    whole = "\n".join(line(12) for _ in range(40))
    docs += [(5000, whole), (5001, whole), (5002, line(3)), (5003, "a b c"), (5004, "a b c")]
    got = {r.doc_id: r.text for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(docs, DOC)).collect()}
    gone = [d for d, x in lines.items() if x not in got[d].split("\n")]
    assert gone == list(range(1000, 1040)) and all(len(got[d].split("\n")) == 3 for d in gone)
    assert got[5000] == whole and got[5001] == "" and got[5004] == "a b c"


def plain_line_repeats(docs):
    """By doc_id, the lines that stay where every repeated pair of neighbouring lines goes."""
    seen, out = {}, {}
    for d, t in sorted(docs):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 1):
            if seen.setdefault(tuple(lines[i : i + 2]), (d, i)) != (d, i):
                gone.update((i, i + 1))
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_whole_line_repeats_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    vocab = [f"line {i}" for i in range(4 if seed == 0 else 60)]
    docs = [(d, "\n".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 30)))) for d in rnd.sample(range(-500, 500), 60)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(docs, DOC).repartition(5), whole=True).collect()}
    assert got == plain_line_repeats(docs)
    first = {x for _, t, in docs for x in t.split("\n")}
    assert {x for _, _, t in got.values() for x in t.split("\n")} - {""} == first


def test_short_passages_go_in_the_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(9)
    line = lambda: " ".join(f"c{rnd.randrange(10**6)}" for _ in range(30))
    docs, want = [], {}
    for n in range(2, 9):
        for k in range(10):
            passage, own = [line() for _ in range(n)], [line() for _ in range(4)]
            docs += [(100 * n + k, "\n".join([line(), *passage, line()])), (10_000 + 100 * n + k, "\n".join([*own[:2], *passage, *own[2:]]))]
            want[10_000 + 100 * n + k] = "\n".join(own)
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(docs, DOC), SF).collect()}
    assert got == {**dict(docs), **want}


def test_long_lines_and_exact_copies_go_in_the_pipeline(spark):
    import corpus_pipeline

    rnd = random.Random(10)
    line = lambda n: " ".join(f"c{rnd.randrange(10**6)}" for _ in range(n))
    long, odd, short, own = line(51), line(60).replace(" ", " \t "), line(50), [line(12) for _ in range(6)]
    whole = "\n".join(line(n) for n in (5, 60, 3, 40, 1))
    docs = [(1, f"{own[0]}\n{long}\n{own[1]}\n{odd}"), (2, f"{own[2]}\n{long}\n{own[3]}"), (3, long), (4, f"{odd}\n{own[4]}"), (5, f"{short}\n{own[5]}"), (6, f"{own[4]}\n{short}"), (7, whole), (8, whole), (9, short), (10, short)]
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, spark.createDataFrame(docs, DOC), SF).collect()}
    gone = {2: f"{own[2]}\n{own[3]}", 4: own[4]}
    assert got == {**{d: t for d, t in docs if d not in (3, 8)}, **gone}


# 10


def test_seeds_tolerate_substitutions_and_spare_clean_text(spark):
    rnd = random.Random(8)
    item = [f"q{rnd.randrange(10**6)}" for _ in range(40)]
    near, far = list(item), list(item)
    for i in range(5, 40, 9):
        near[i] = "changed"
    for i in range(0, 40, 3):
        far[i] = "changed"
    pad = lambda w: " ".join(f"p{rnd.randrange(10**6)}" for _ in range(50)) + " " + ", ".join(w).title() + "! tail"
    docs = spark.createDataFrame([(1, pad(item)), (2, pad(near)), (3, pad(far)), (4, pad(item[:10])), (5, " ".join(item[10:35]))], DOC)
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short to hold a seed")], "item_id long, text string")
    got = {r.doc_id: (r.kept, r.n_items, r.first_item) for r in spaced_seeds.contamination(docs, bench).collect()}
    assert got == {1: (False, 1, 7), 2: (False, 1, 7), 3: (True, 0, None), 4: (True, 0, None), 5: (False, 1, 7)}
    assert sorted(r.doc_id for r in spaced_seeds.decontaminate(docs, bench).collect()) == [3, 4]


@pytest.mark.parametrize("n, changed", [(13, 2), (14, 2), (15, 3), (16, 3), (17, 3), (18, 3), (19, 3), (20, 4)])
def test_masks_reach_every_overlap(n, changed):
    """Whichever tokens are substituted, some mask lies on equal ones alone: no overlap of the rule is without a seed."""
    marks = [{i for i, c in enumerate(m) if c == "1"} for m in spaced_seeds.MASKS]
    spots = [{i + a for i in m} for m, mask in zip(marks, spaced_seeds.MASKS, strict=True) for a in range(n - len(mask) + 1)]
    assert all(any(not p & set(gone) for p in spots) for gone in itertools.combinations(range(n), changed))


def plain_overlaps(docs, items):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    found = set()
    for d, t in docs:
        for i, u in items:
            a, b = cut(t), cut(u)
            need = min(20, len(b))
            share = 100 if len(b) < 13 else 80
            if 0 < len(b) < 5:
                hit = a == b
            else:
                hit = len(b) and any(
                    100 * sum(x == y for x, y in zip(a[p : p + need], b[q : q + need], strict=True)) >= share * need
                    for q in range(len(b) - need + 1)
                    for p in range(len(a) - need + 1)
                )
            if hit:
                found.add((d, i))
    return found


@pytest.mark.parametrize("limits", [(10**6, 10**6), (10, 10**6), (10, 10)])
def test_seeds_against_brute_force(spark, monkeypatch, limits):
    """Items of every length, copied with as many substitutions as the rule allows, one more, and none."""
    monkeypatch.setattr(spaced_seeds, "BROADCAST_ROWS", limits[0])
    monkeypatch.setattr(spaced_seeds, "FILTER_ROWS", limits[1])
    rnd = random.Random(12)
    word = lambda: f"q{rnd.randrange(40)}"
    items = [(n, " ".join(f"i{n}x{k}" if k % 2 else word() for k in range(n))) for n in (1, 2, 4, 5, 8, 12, 13, 14, 15, 17, 19, 20, 21, 33)]
    docs = []
    for n, t in items:
        for more in (-1, 0, 1):
            w = t.split()
            for k in rnd.sample(range(min(n, 20)), max(0, min(n, (0 if n < 13 else min(n, 20) // 5) + more))):
                w[k] = "other"
            pad = [] if n < 5 and more == 0 else [word() for _ in range(rnd.randrange(1, 30))]
            docs.append((1000 * n + more, " ".join([*pad, *w, *pad[:3]])))
    got = spaced_seeds.overlaps(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == plain_overlaps(docs, items)


def test_seeds_odd_inputs(spark, monkeypatch):
    docs = odd_docs(spark).unionByName(odd_docs(spark).where("doc_id = 8").withColumn("text", F.expr("array_join(transform(sequence(1, 60), x -> concat('z', x)), ' ')")).withColumn("doc_id", F.lit(80).cast("long")))
    docs = docs.withColumn("_id", F.lit("own"))
    text = " ".join(f"w{i % 997}" for i in range(500, 600))
    bench = spark.createDataFrame([(None, text), (None, None), (3, ""), (4, "One, two!")], "item_id long, text string")
    for limit in (10**6, 50):
        monkeypatch.setattr(spaced_seeds, "BROADCAST_ROWS", limit)
        assert {r.doc_id for r in spaced_seeds.contamination(docs, bench).where("not kept").collect()} == {4, 5, 6, None}
    left = spaced_seeds.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 5 and {r[0] for r in left.select("_id").collect()} == {"own"}
    assert spaced_seeds.decontaminate(docs, bench.limit(0)).count() == docs.count()
    assert spaced_seeds.decontaminate(docs.limit(0), bench).count() == 0


# pipeline


def test_pipeline_stages_keep_their_columns_and_the_clean(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(6)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    clean = [(10**6 + i, "\n".join(" ".join(f"c{rnd.randrange(10**5)}" for _ in range(12)) for _ in range(6)), "en", "src1", 500) for i in range(5)]
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    planted = [(2 * 10**6, clean[0][1] + " end", "en", "src1", 500), (2 * 10**6 + 1, clean[1][1] + "\n" + bench[0], "en", "src2", 500)]
    docs = base.unionByName(spark.createDataFrame(clean + planted, base.schema))
    texts = {}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == base.columns
            texts[k] = {r.doc_id: r.text for r in docs.collect()}
    assert 10**6 + 2 in texts[3] and 10**6 + 3 in texts[3]
    # line de-duplication has taken most of the near copy before near-duplicates are sought
    assert len(texts[2].get(2 * 10**6, "")) < len(clean[0][1]) / 2
    assert 2 * 10**6 + 1 not in texts[3]
    assert set(pd.unique(docs.toPandas().doc_id)) == set(texts[3])


def plain_lines_stage(docs):
    """Every repeated pair of neighbouring lines goes, every repeated line of over 50 words, and emptied documents."""
    pairs, longs, out = {}, {}, {}
    for d, t in sorted(docs.items()):
        ls, gone = t.split("\n"), set()
        for i, x in enumerate(ls):
            if i + 1 < len(ls) and pairs.setdefault((x, ls[i + 1]), (d, i)) != (d, i):
                gone.update((i, i + 1))
            if len(words(x)) > 50 and longs.setdefault(x, (d, i)) != (d, i):
                gone.add(i)
        kept = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        if kept or not gone:
            out[d] = kept
    return out


def plain_contaminated(docs, items):
    """As plain_overlaps, but only where three tokens in a row are shared, without which there is no overlap."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    found, by = set(), defaultdict(list)
    for i, u in items:
        b = cut(u)
        assert len(b) >= 13
        for k in range(len(b) - 2):
            by[tuple(b[k : k + 3])].append((i, k, b))
    for d, t in docs.items():
        a = cut(t)
        for shift, b in {(p - k, tuple(b)) for p in range(len(a) - 2) for _, k, b in by.get(tuple(a[p : p + 3]), ())}:
            need = min(20, len(b))
            same = [0 <= q + shift < len(a) and a[q + shift] == x for q, x in enumerate(b)]
            if any(100 * sum(same[q : q + need]) >= 80 * need and 0 <= q + shift and q + shift + need <= len(a) for q in range(len(b) - need + 1)):
                found.add(d)
    return found


def test_pipeline_against_brute_force(spark):
    """From the documents that the quality stage keeps on, every row of run() by plain Python, but for the sequences,
    which are held to their rules."""
    import corpus_pipeline

    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, base, SF).collect()}
    assert 0.5 * base.count() < len(docs) < base.count()
    docs = plain_lines_stage(docs)
    comp = plain_components(list(docs.items()))
    docs = {d: t for d, t in docs.items() if comp[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = plain_contaminated(docs, items)
    assert bad
    want = set()
    for d in set(docs) - bad:
        ids = [*packing.encoder(BPE)(docs[d]).tolist(), 0]
        first = len(ids) % 2048 or 2048
        for k, end in enumerate(range(first, len(ids) + 1, 2048)):
            start = 0 if k == 0 else end - 2048
            want.add((d, k, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want and len(got) == len(want)
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 2048).all() and all((g.offset == g.length.cumsum() - g.length).all() for _, g in by)
    assert by.ngroups <= -(-got.length.sum() // 2048) + 1


def test_pipeline_stages_handle_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, a null id, columns named like results; then an empty table."""
    import corpus_pipeline

    docs = odd_docs(spark)
    for c in ("_id", "_th", "n_removed", "_kept", "gone"):
        docs = docs.withColumn(c, F.lit("own"))
    want = docs.schema
    names = {"x": ("id", "kept", "n_lines", "p_low"), "own": ("_id", "_th", "n_removed", "_kept", "gone")}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in want], name
        out.write.parquet(str(tmp_path / str(k)))
        got = spark.read.parquet(str(tmp_path / str(k)))
        for value, cols in names.items():
            assert got.where(F.expr(" or ".join(f"`{c}` is distinct from '{value}'" for c in cols))).count() == 0, name
        if name != "quality":  # whose judgement on such texts is its own
            docs = got
    assert {r.doc_id for r in docs.collect()} >= {1, 2, 3, 5, 7, 8} and docs.where("doc_id = 6").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
