"""Centroid clustering, phrase index and Merkle manifest: odd rows, and results against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sourcelight.llm import centroids, merkle, oracles, phrase_index, queries
from sourcelight.llm.common import saved

FOLDER = "/root/testdata/sf0.001"


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# --- centroids ----------------------------------------------------------------------------------


def plain_clusters(rows, k, rounds, dims, scale=256):
    """rows: (id, vector). Python integers throughout."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            limit = centroids.LIMIT
            kept.append((i, [int(max(-limit, min(limit, np.floor(scale * float(x))))) for x in v]))
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    middle = [list(v) for _, v in sorted(kept, key=name)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middle))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, g in groups.items():
            middle[n] = [sum(x) // len(g) for x in zip(*g)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=str), middle


@pytest.mark.parametrize("shape", ["spread", "tied", "huge"])
def test_clusters(spark, shape):
    rng = random.Random(shape)
    pick = {"spread": lambda: rng.uniform(-1, 1), "tied": lambda: rng.choice([0.0, 1 / 256, -1 / 256]),
            "huge": lambda: rng.choice([1e30, -1e30, 0.5, 3e5])}[shape]
    rows = [(i, [pick() for _ in range(3)]) for i in range(200)]
    rows += [(i, rows[i][1]) for i in range(20)]  # repeated rows
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 0.0]), (903, [1.0, float("nan"), 0.0]),
             (904, [float("inf"), 0.0, 0.0]), (None, [0.1, 0.2, 0.3]), (905, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<double>, id string, cluster int")
    found = centroids.cluster(df, k=17, rounds=3, dims=3)
    want, middle = plain_clusters(rows, 17, 3, 3)
    assert found.centroids == middle
    assert sorted(rows_of(found.assigned), key=str) == want


def test_tree_prunes_nothing_it_needs():
    rng = np.random.default_rng(5)
    for dims in (1, 2, 8):
        middle = rng.integers(-9, 9, (60, dims))  # many equal distances
        points = rng.integers(-12, 12, (500, dims))
        owner, away = centroids.VantageTree(middle).nearest(points)
        plain = ((points[:, None] - middle[None]) ** 2).sum(axis=2)
        assert (owner == plain.argmin(axis=1)).all() and (away == plain.min(axis=1)).all()


def test_few_or_no_vectors(spark):
    shape = "vec_id bigint, embedding array<float>"
    none = centroids.cluster(spark.createDataFrame([], shape))
    assert rows_of(centroids.with_inertia(none)) == [] and none.centroids == []
    two = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64)], shape)
    told = rows_of(centroids.with_inertia(centroids.cluster(two)).orderBy("id"))
    assert [t[2:5] for t in told] == [(0, 0, 0), (0, 0, 0)] and len({t[1] for t in told}) == 2


# --- phrase index -------------------------------------------------------------------------------


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(docs, items, size):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows.setdefault("" if item is None else str(item), set()).update(
            tuple(w[s : s + n]) for s in range(len(w) - n + 1) if n
        )
    lengths = {len(x) for ws in windows.values() for x in ws}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        grams = {}
        for n in lengths:
            for s in range(len(w) - n + 1):
                grams.setdefault(tuple(w[s : s + n]), []).append(s)
        for item, ws in windows.items():
            for x in ws & grams.keys():
                found.add(item)
                hit.update(p for s in grams[x] for p in range(s, s + len(x)))
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def hits(spark, docs, items, **kw):
    left = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, term string")
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, segment string")
    return sorted(((r[0], r[1], r[2], list(r[3])) for r in phrase_index.contaminated(left, right, **kw).collect()), key=str)


PHRASE = "one two three four five six seven eight nine ten eleven twelve"


def test_contaminated_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, "   "), (4, f"Before {PHRASE.upper()}, after"), (4, f"Before {PHRASE.upper()}, after"),
        (None, PHRASE), (5, PHRASE.rsplit(" ", 3)[0]), (6, "short-item, twice: Short item"), (7, "a " * 5000 + PHRASE),
        (8, "É漢字 été x 0123"), (9, PHRASE + " " + PHRASE), (10, "a" * 100_000),
    ]
    items = [(1, PHRASE), (2, "short item"), (2, "a a"), (3, None), (4, "--"), (None, "É漢字"), (5, PHRASE), (11, "a a a")]
    assert hits(spark, docs, items) == plain_hits(docs, items, 10)
    assert hits(spark, docs, items, segment_words=7) == plain_hits(docs, items, 10)
    assert hits(spark, [], items) == []
    assert hits(spark, docs, []) == plain_hits(docs, [], 10)


def test_contaminated_random(spark, monkeypatch):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 120)))) for i in range(150)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 9)))) for i in range(60)]
    monkeypatch.setattr(phrase_index, "WINDOWS_A_CALL", 20)
    assert hits(spark, docs, items, size=3, segment_words=500) == plain_hits(docs, items, 3)


def test_postings_of_every_word_are_stored(spark):
    docs = [(i, f"{PHRASE} {i} {PHRASE}") for i in range(30)] + [(99, None)]
    index = phrase_index.build_index(spark.createDataFrame(docs, "doc_id bigint, text string"), segment_words=100)
    terms = index.where("term is not null")
    assert terms.agg(F.sum("n")).first()[0] == sum(len(words(t)) for _, t in docs)
    assert terms.where("n <> size(postings)").count() == 0 and terms.select("segment").distinct().count() > 5
    assert phrase_index.indexed_documents(index).count() == 31


def test_proximity(spark):
    docs = [(1, "red x blue y green"), (2, "green blue red"), (3, "red blue"), (4, "red a b c d e f blue green"), (5, "blue"), (6, "green")]
    found = hits(spark, docs, [(7, "red blue green")], seek=phrase_index.near_phrases(4))
    assert [i for i, _, n, _ in found if n] == [1, 2]


def test_words_of_slices():
    texts = pa.array(["zero", "One two", None, "", "3-Four", "五 six"])
    terms, counts = phrase_index.words_of(texts[1:])
    assert terms.to_pylist() == ["one", "two", "3", "four", "五", "six"] and counts.tolist() == [2, 0, 0, 2, 2]
    assert phrase_index.words_of(texts[2:4])[1].tolist() == [0, 0]


# --- Merkle manifest ----------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_proofs(trees, arity):
    """trees: name -> ordered leaves. (name, leaf number) -> siblings per level, and the root."""

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([H(*last[i : i + arity]) for i in range(0, len(last), arity)])
        return levels

    def path(levels, i):
        out = []
        for nodes in levels[:-1]:
            s = i - i % arity
            run = nodes[s : s + arity]
            out.append(("".join(run[: i - s]), "".join(run[i - s + 1 :])))
            i //= arity
        return out

    grown = {name: climb(leaves) for name, leaves in trees.items()}
    names = sorted(grown, key=lambda n: (n is not None, (n or "").encode()))
    top = climb([grown[n][-1][0] for n in names])
    return {
        (n, leaf): path(grown[n], i) + path(top, names.index(n)) for n in names for i, leaf in enumerate(trees[n])
    }, top[-1][0]


@pytest.mark.parametrize("arity,step", [(2, 1), (2, 3), (3, 2), (2, 8)])
def test_proofs(spark, arity, step, monkeypatch):
    monkeypatch.setattr(merkle, "_STRETCH", 2)
    rng = random.Random(step)
    sizes = {None: 1, "": 2, "a": 3, "é": 17, "z": 64, "zz": 65, "long": 130}
    rows = [(i, g) for g, n in sizes.items() for i in rng.sample(range(1000), n)]
    df = spark.createDataFrame([(i, g, "x", 0) for i, g in rows], "i int, g string, digest string, idx int")
    made = merkle.manifest(df, F.col("g"), F.col("i"), merkle.digest(merkle.field(F.col("i"))), {"i": F.col("i")}, arity, step)
    leaf = lambda i: H(f"{len(str(i))}:{i}")
    want, root = plain_proofs({g: [leaf(i) for i, h in sorted(r for r in rows if r[1] == g)] for g in sizes}, arity)
    got = {((None if r["tree"] == "" else r["tree"][1:]), r["leaf"]): [tuple(s) for s in r["path"]] for r in made.proofs.collect()}
    assert got == want and made.root == root
    checked = made.proofs.select(merkle.folded(F.col("leaf"), F.col("path")).alias("r")).distinct().collect()
    assert [r["r"] for r in checked] == [root]


def test_only_some_levels_are_stored(spark):
    df = spark.range(1000).select(F.lit("").alias("tree"), F.col("id").alias("idx"), F.lit(1000).cast("bigint").alias("n"),
                                  F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    forest = merkle.plant(saved(df, "t"), 2, 4)
    assert [t.count() for t in forest.levels] == [1000, 63, 4, 1]


def test_merkle_odd_rows(spark, tmp_path):
    """Nulls everywhere, repeated rows, ties, extra columns; tampered rows are those the query names."""
    rows = [(None, None, None, None, None, "x"), (None, "t", "en", "s", 1, "x"), (5, "t", "en", "s", 1, "x"), (5, "t", "en", "s", 1, "x"),
            (5, "ü", None, None, None, "x"), (6, "", "", "", 0, "x")]
    rows += [(i, "text" * i, "fr", "s", i, "y") for i in range(40)]
    shape = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(oracles.OP13).fetchall()
    columns = [c[0] for c in con.description]
    df = queries.op13_merkle(spark, str(tmp_path)).select(*columns)
    assert sorted(map(str, rows_of(df))) == sorted(map(str, want)) and len(want) == len(rows)
    for r in df.collect():
        changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
        if changed and r["doc_id"] not in (5, 6):
            assert not r["verified"]
    spark.createDataFrame([], shape).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_merkle(spark, f"{tmp_path}/none").count() == 0
