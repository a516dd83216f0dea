import re
from collections import Counter, defaultdict
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlab.llm import embedding_dedup, exact_dedup, near_dedup, queries, shared
from cohortlab.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, kept string"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_darts_of_many_short_texts_are_not_held_at_once(spark, monkeypatch):
    df, held, whole = spark.range(0, 6000, 1, 1).selectExpr("id as doc_id", "concat('w', id) as text"), [], near_dedup.dart_signatures
    monkeypatch.setattr(type(df), "mapInArrow", lambda rows, run, schema: (rows, run))
    rows, run = near_dedup._signed(df, "doc_id", "text")
    monkeypatch.setattr(near_dedup, "dart_signatures", lambda h, w, off, k: held.append(len(off) - 1) or whole(h, w, off, k))
    got = {r["id"]: r["bands"] for b in run(iter(rows.toArrow().combine_chunks().to_batches())) for r in b.to_pylist()}
    assert sum(held) == len(got) == 6000 and max(held) <= 2500
    some = [0, 2499, 2500, 5999]  # as each by itself
    assert all(got[i] == next(run(iter(rows.where(f"id = {i}").toArrow().to_batches()))).to_pylist()[0]["bands"] for i in some)


# -- exact ------------------------------------------------------------------------------------------------------------------------


def test_exact_edge_cases(spark):
    rows = [(1, "a", "en", "x"), (2, "a", "en", "y"), (3, None, "en", "z"), (4, "", "de", None), (5, "b" * 200_000, None, "x"), (6, "a ", "en", "x"), (7, "q", "en", "1"), (7, "q", "en", "1"), (None, "q", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = {(r["doc_id"], r["lang"]): r for r in exact_dedup.mark_exact_duplicates(df).collect()}
    assert got[1, "en"]["keep_id"] == 2 and not got[1, "en"]["kept"] and got[1, "en"]["group_size"] == 2
    assert got[3, "en"]["keep_id"] == 4 and got[4, "de"]["kept"]  # null counts as empty
    assert got[5, None]["kept"] and got[6, "en"]["kept"] and got[6, "en"]["group_size"] == 1
    marked = exact_dedup.mark_exact_duplicates(df).where("keep_id = 7")
    assert marked.count() == 3 and marked.where("kept").count() == 1
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns  # a column named like an output stays
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 4, 5, 6, 7]
    assert {r["doc_id"]: r["kept"] for r in out.collect()}[2] == "y"


def test_exact_empty_and_all_equal(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.mark_exact_duplicates(empty).count() == 0 and exact_dedup.exact_dedup(empty).count() == 0
    same = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same text").alias("text"))
    got = exact_dedup.mark_exact_duplicates(same)
    assert got.count() == 5000 and got.where("keep_id = 4999 and group_size = 5000").count() == 5000 and got.where("kept").count() == 1


def test_exact_with_a_filter_too_large_to_broadcast(spark, sf, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_BLOCKS", 0)
    test_exact_on_documents(spark, sf)


def test_exact_on_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = df.select("doc_id", "text").collect()
    most = defaultdict(list)
    for r in rows:
        most[r["text"] or ""].append(r["doc_id"])
    for r in exact_dedup.mark_exact_duplicates(df, carry=["doc_id"]).collect():
        own = next(v for v in most.values() if r["doc_id"] in v)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(own), len(own), r["doc_id"] == max(own))


# -- near -------------------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (sets[a] and sets[b] and similarity(sets[a], sets[b]) >= 0.8)]
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append(i)
    links += [(v[0], x) for v in texts.values() for x in v[1:]]
    return components(ids, links)


def test_near_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_classes([(r["doc_id"], r["text"]) for r in df.collect()])
    got = near_dedup.mark_near_duplicates(df).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)
    kept = near_dedup.near_dedup(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))


def test_near_chains_and_edges(spark):
    rng = np.random.default_rng(0)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 300)]
    chain = [list(base)]
    for k in range(6):  # each a little further from the first
        nxt = list(chain[-1])
        nxt[10 + 40 * k : 14 + 40 * k] = [f"x{k}{i}" for i in range(4)]
        chain.append(nxt)
    rows = [(i, " ".join(t), "en", None) for i, t in enumerate(chain)]
    rows += [(20, "", "en", None), (21, None, "en", None), (22, "... !!", "en", None), (23, "one two", "en", None), (24, "One, two!", "en", None), (25, "lone text here now", "en", None), (25, "lone text here now", "en", None), (None, "lone text here now", "en", None), (30, "word " * 60_000, "en", None)]
    df = spark.createDataFrame(rows, DOCS)
    got = near_dedup.mark_near_duplicates(df)
    by = {r["doc_id"]: r["class_id"] for r in got.where("doc_id is not null").collect()}
    assert all(by[i] == 0 for i in range(7))
    assert by[20] == by[21] == 20 and by[22] == 22 and by[23] == by[24] == 23 and by[30] == 30
    assert got.where("class_size = 3 and kept").count() == 1
    out = near_dedup.near_dedup(df)
    assert out.count() == got.select("class_id").distinct().count() and out.columns == df.columns
    assert near_dedup.near_dedup(df.limit(0)).count() == 0 and near_dedup.mark_near_duplicates(df.limit(0)).count() == 0


def test_near_tells_alike_words_apart(spark):
    """Words that every sum of powers modulo 2^64 takes for each other make different runs."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    texts = [" ".join([w, "one", "two", w, "three", w]) for w in (word, other)] + [" ".join([word, "one", "two", word, "three", word, "!"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.mark_near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0}


def test_near_mixed_bucket(spark, monkeypatch):
    """A bucket of unlike texts loses no link: one band makes every text meet every other, and the least text links with one of them only."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 1000, 40)) for _ in range(18)]
    texts += [t + " end" for t in texts]
    whole = near_dedup._links_in_families
    monkeypatch.setattr(near_dedup, "band_keys", lambda sig: np.zeros((len(sig), 1), np.uint64))
    monkeypatch.setattr(near_dedup, "BANDS", 1)
    monkeypatch.setattr(near_dedup, "ROWS", 125)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for block in (1500, 7):  # a family in one task, and cut into pairs of blocks
        monkeypatch.setattr(near_dedup, "_links_in_families", partial(whole, block=block))
        rows, classes = near_dedup._classes(df, "doc_id", "text", 0.8)
        assert sorted(r["class_size"] for r in classes.collect()) == [2] * 36


def test_links_between_classes_against_brute_force():
    rng = np.random.default_rng(7)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 40))) for _ in range(60)]
    for k in range(60):  # near copies, copies of copies, and subsets
        s = sets[rng.integers(len(sets))]
        sets.append(np.unique(np.concatenate((s[rng.random(len(s)) > 0.08], rng.integers(0, 400, rng.integers(0, 3))))) if k % 3 else s.copy())
    sets = [s for s in sets if len(s)]
    size, flat = np.array([len(s) for s in sets]), np.concatenate(sets)
    near = lambda x, y: len(np.intersect1d(sets[x], sets[y])) >= 0.8 * len(np.union1d(sets[x], sets[y]))
    label = np.arange(len(sets))
    label[::7] = label[0]
    given = [(0, i) for i in range(0, len(sets), 7)]
    for side in (np.full(len(sets), -1), np.arange(len(sets)) % 2):
        links = [(x, y) for x in range(len(sets)) for y in range(x) if near(x, y) and (side[x] < 0 or side[x] != side[y])]
        found = near_dedup.links_between_classes(size, flat, label, side, 0.8)
        assert set(found) <= set(links) and components(range(len(sets)), found + given) == components(range(len(sets)), links + given)


def test_dart_signature_estimates_weighted_jaccard():
    rng = np.random.default_rng(2)
    a, b = rng.uniform(0, 2, 60), rng.uniform(0, 2, 60)
    h = near_dedup.mix(np.arange(1, 61, dtype=np.uint64))
    sig = near_dedup.dart_signatures(np.concatenate((h, h)), np.concatenate((a, b)), np.array([0, 60, 120]), 4096)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03
    small = near_dedup.dart_signatures(h[:1], np.array([1.0]), np.array([0, 0, 1]), 128)
    assert (small[0] == 0).all() and (small[1] != 0).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [tuple(map(int, rng.integers(0, 400, 2))) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    nodes = {x for a, b in links for x in (a, b) if a != b}
    want = components(nodes, [(a, b) for a, b in links if a != b])
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([(1, 1)], "src long, dst long")).count() == 0


# -- embeddings -------------------------------------------------------------------------------------------------------------------


def brute_links(ids, vectors):
    v = np.array(vectors, np.float64)
    v = v / np.sqrt((v * v).sum(1, keepdims=True))
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    return near


def planted_vectors(n=3000, d=32, seed=9):
    """Unlike vectors, with pairs at cosines of 0.95 to 0.99, chains, a dense cluster and copies planted among them."""
    rng = np.random.default_rng(seed)
    v = embedding_dedup.unit(rng.normal(size=(n, d)))

    def beside(x, cosine):
        y = rng.normal(size=d)
        y -= (y @ x) * x
        return cosine * x + np.sqrt(1 - cosine**2) * y / np.sqrt(y @ y)

    extra = [beside(v[i], c) for i, c in enumerate(rng.uniform(0.951, 0.99, 400))]
    for start in range(500, 520):  # chains whose ends don't link
        x = v[start]
        for _ in range(6):
            x = beside(x, 0.96)
            extra.append(x)
    extra += [beside(v[600], 0.985) for _ in range(300)]  # all of these link with most others
    extra += [v[700]] * 50
    both = np.concatenate((v, np.array(extra)))
    return both[rng.permutation(len(both))]


@pytest.mark.parametrize("settings", [{}, {"shard_rows": 120}, {"shard_rows": 120, "most_centroids": 6}, {"shard_rows": 2000, "block_rows": 250}])
def test_embeddings_against_brute_force(spark, settings):
    v = planted_vectors()
    near = brute_links(None, v)
    want = components(range(len(v)), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = embedding_dedup.mark_near_vectors(df, **settings)
    by = {r["vec_id"]: r for r in got.collect()}
    true = near.sum(1)
    assert len(by) == len(v) and true.sum() > 50_000
    assert all(by[i]["n_links"] <= n for i, n in enumerate(true))
    few = np.flatnonzero((true > 0) & (true < 20))  # the pairs and chains, which no dense cluster hides
    assert sum(by[i]["n_links"] for i in few) >= 0.97 * true[few].sum() and sum(r["n_links"] for r in by.values()) >= 0.97 * true.sum()
    assert np.mean([by[i]["component_id"] == want[i] for i in range(len(v))]) >= 0.98
    assert embedding_dedup.audit_recall(df, got) >= 0.97


def test_audit_tells_lost_links(spark):
    v = planted_vectors(800)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    none = df.select("vec_id", F.lit(0).cast("long").alias("n_links"))
    assert embedding_dedup.audit_recall(df, none) == 0.0
    apart = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert embedding_dedup.audit_recall(apart, apart.select("vec_id", F.lit(0).cast("long").alias("n_links"))) is None


def test_embedding_query(spark):
    got = queries.op2_embedding_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 500 and {r["vec_id"] for r in got if r["kept"]} >= {r["component_id"] for r in got}


def test_lengths_link_within_themselves(spark):
    rows = [(i, [1.0, 0.01 * i]) for i in range(4)] + [(10 + i, [1.0, 0.01 * i, 0.0]) for i in range(3)] + [(20, [1.0, 0.0, 0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.mark_near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {**{i: (3, 0) for i in range(4)}, **{10 + i: (2, 10) for i in range(3)}, 20: (0, 20)}


def test_embedding_edge_cases(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=8)
    rows = [(i, [float(x) for x in centre + rng.normal(size=8) * 0.02], 1) for i in range(40)]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [1.0] * 7 + [None], 1), (103, [1.0] * 7 + [float("nan")], 1), (104, [float("inf")] + [1.0] * 7, 1), (105, [1.0] * 3, 1), (106, [], 1)]
    rows += [(200, [float(x) for x in -centre], 1), (201, [float(x) for x in -centre], 1), (201, [float(x) for x in -centre], 1), (None, [float(x) for x in -centre], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")
    got = embedding_dedup.mark_near_vectors(df)
    by = {r["vec_id"]: r for r in got.where("vec_id is not null").collect()}
    assert all(by[i]["n_links"] == 39 and by[i]["component_id"] == 0 for i in range(40)) and by[0]["kept"] and not by[1]["kept"]
    assert all(by[i]["n_links"] == 0 and by[i]["component_id"] == i and by[i]["kept"] for i in range(100, 107))
    assert by[200]["n_links"] == 3 and by[201]["component_id"] == 200 and got.count() == len(rows)
    assert embedding_dedup.mark_near_vectors(df.limit(0)).count() == 0


def test_range_search_finds_isolated_pairs():
    rng = np.random.default_rng(5)
    v = embedding_dedup.unit(rng.normal(size=(400, 16)))
    v[300:] = embedding_dedup.unit(v[:100] + rng.normal(size=(100, 16)) * 0.02)
    graph = embedding_dedup.build_graph(v)
    assert max(map(len, graph)) <= embedding_dedup.DEGREE
    start, flat, seen = np.concatenate(([0], np.cumsum([len(g) for g in graph]))), np.concatenate(graph), np.full(400, -1, np.int64)
    hits = sum(300 + q in embedding_dedup.range_search(v, start, flat, 0, q, 0.95, seen) for q in range(100))
    assert hits >= 97


@pytest.mark.parametrize("n", [1, 2, 3])
def test_tiny_embedding_tables(spark, n):
    df = spark.createDataFrame([(i, [1.0, 0.1 * i]) for i in range(n)], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in embedding_dedup.mark_near_vectors(df).orderBy("vec_id").collect()] == [n - 1] * n
