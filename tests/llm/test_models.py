import math
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from cohortlab.llm import language_model, pieces, quality, queries, textvec, tokens, url_filter
from cohortlab.llm.textvec import buffers

# -- quality ----------------------------------------------------------------------------------------------------------------------


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (order[y > 0].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries.op5_quality_classifier(spark, sf).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())
    own = [i for i in labels if got[i]["held_out"]]
    y, s = np.array([labels[i] for i in own]), np.array([got[i]["score"] for i in own])
    assert auc(s, y) > 0.9 and (s[y > 0] >= 0.3).mean() > 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "x", 0.5), (4, "y" * 300_000, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert quality.score(docs, model).count() == 4
    many = spark.createDataFrame([(7, f"text {i}", 0.5) for i in range(50)], "doc_id long, text string, score double")  # one id, many rows
    assert quality.score(many, quality.train(many, spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"))).count() == 50
    one = spark.createDataFrame([(1, 1, None), (2, None, 0), (3, 1, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, one)).where("score > 0.5").count() == 4
    assert quality.score(docs.limit(0), model).count() == 0


def grams(text):
    """The indicators of a text, from the definition: byte pairs, and hashed runs of four bytes."""
    b = text.encode()
    out = {b[i] << 8 | b[i + 1] for i in range(len(b) - 1)}
    return out | {(1 << 16) + (int.from_bytes(b[i : i + 4], "big") * 2654435761 % (1 << 32) >> 16) for i in range(len(b) - 3)}


def test_quality_by_hand(spark):
    """Ratios, margins and scores against plain sums over sets of n-grams, and the solution against its optimality conditions."""
    rng = np.random.default_rng(8)
    said = ["good words in a row", "bad bad ###", "ünï", "", "x", "ab", "abcd"] + ["".join(rng.choice(list("abc #é"), 30)) for _ in range(60)]
    y = np.array([int("#" not in t) for t in said])
    rows = [quality.indicators(np.frombuffer(t.encode(), np.uint8)) for t in said]
    assert all(set(r.tolist()) == grams(t) for r, t in zip(rows, said))
    ratios = quality.log_count_ratios(rows, y)
    good, bad = (Counter(g for t, k in zip(said, y) if k == side for g in grams(t)) for side in (1, 0))
    share = lambda counts, g: (1 + counts[g]) / (quality.DIM + counts.total())
    assert all(math.isclose(ratios[g], math.log(share(good, g)) - math.log(share(bad, g)), abs_tol=1e-9) for g in [*good, *bad, 0])
    w, bias = quality.dual_coordinate_descent(rows, ratios, y, 1.0, 200)
    x = np.zeros((len(said), quality.DIM))
    for i, r in enumerate(rows):
        x[i, r] = ratios[r] / math.sqrt(max(1, len(r)))
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    primal = 0.5 * (w @ w + bias**2) + (cost * np.maximum(0, 1 - sign * (x @ w + bias))).sum()
    for _ in range(30):  # no nearby point is better: the problem is convex
        dw, db = rng.normal(size=len(w)) * (np.abs(x).sum(0) > 0) * 1e-2, rng.normal() * 1e-2
        assert 0.5 * ((w + dw) @ (w + dw) + (bias + db) ** 2) + (cost * np.maximum(0, 1 - sign * (x @ (w + dw) + bias + db))).sum() >= primal - 1e-3
    model = quality.fit_rows(rows, y)
    got = {r["doc_id"]: r for r in quality.score(spark.createDataFrame(list(enumerate([*said, None])), "doc_id long, text string"), model).collect()}
    for i, t in enumerate([*said, None]):
        found = grams(t or "")
        margin = sum(model.weights[g] for g in found) / math.sqrt(max(1, len(found))) + model.bias
        score = 1 / (1 + math.exp(-min(30, max(-30, model.slope * margin + model.shift))))
        assert math.isclose(got[i]["score"], score, abs_tol=1e-9) and got[i]["predicted"] == (score >= 0.3)


def test_dual_coordinate_descent_solves_the_dual():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(200, 30, replace=False)) for _ in range(80)]
    y = np.array([int(x[0] % 2 == 0) for x in rows])
    w, b = quality.dual_coordinate_descent(rows, np.ones(quality.DIM), y, 10.0, 300)
    sign = np.where(y > 0, 1, -1)
    margin = np.array([w[x].sum() / np.sqrt(len(x)) + b for x in rows]) * sign
    assert (margin > 0).mean() > 0.95


# -- language model ---------------------------------------------------------------------------------------------------------------


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def check_scores(rows, got):
    train = Counter(w for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for w in words(t))
    n, v = sum(train.values()), len(train)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        r, own = by[i], words(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0


@pytest.mark.parametrize("most_known", [1 << 19, 40])
def test_lm_base_scores(spark, sf, most_known):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**7, None), (10**7 + 1, ""), (10**7 + 2, "\u00a0É A\u2003b  c\x1cd\tE\x0b"), (10**7 + 3, "neverseen " * 30_000)], "doc_id long, text string")
    df = df.unionAll(extra)
    check_scores([tuple(r) for r in df.collect()], language_model.score_texts(df, most_known=most_known, most_symbols=64).collect())


def test_lm_tells_alike_words_apart(spark):
    """Words that every sum of powers modulo 2^64 takes for each other are counted apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    train = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = next(i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(train[0], f"{word} x"), (train[1], f"{word} {word}"), (train[2], f"y {other}"), (held, f"{other} {word}")]
    check_scores(rows, language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_lm_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    assert language_model.score_texts(df).count() == 4
    assert language_model.score_texts(df.limit(0)).count() == 0
    held = spark.createDataFrame([(i, "x y") for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert held.count() and language_model.score_texts(held).where("n_known = 0 and train_tokens = 0").count() == held.count()  # nothing to learn from


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(300))
    model = language_model.LogBilinear.start(p, 8)
    norm = model.normalisers(block=128)
    for w1, w2 in rng.integers(0, 300, (40, 2)):
        every = np.arange(300)
        assert math.isclose(np.exp(model.log_p(every, np.full(300, w1), np.full(300, w2), norm)).sum(), 1, abs_tol=1e-4)


def test_lm_shares_of_symbols_sum_to_one(spark):
    """Over the tokens of a tail symbol and one unseen token, the shares of its probability sum to 1; a frequent token's share is 1."""
    rng = np.random.default_rng(0)
    w = np.append(rng.integers(0, 1 << 63, 400, dtype=np.uint64), language_model.END)
    c = np.append((1000 / np.arange(1, 401)).astype(np.int64), 50)
    counts = spark.createDataFrame(list(zip(w.view(np.int64).tolist(), c.tolist())), "w long, c long")
    for most in (1 << 19, 100, 1):
        known = language_model._known(counts, most, 64)
        mass, (here, found, ids) = language_model.symbol_masses(counts, known), known.find(w)
        assert (known.frequent().of(w) == ids).all()
        assert len(known.keys) <= most and ids[-1] == 0 and (found[here] == c[here]).all() and (ids < 64).all()
        share = np.where(ids >= known.tail, (c + 0.5) / mass[ids], 1.0)
        total = np.bincount(ids, share, known.size)
        total[known.tail :] += 0.5 / mass[known.tail :]
        assert np.allclose(total, 1) and np.isclose(mass.sum(), c.sum() + 0.5 * (len(c) + 16))


def test_lm_symbols_grow_with_the_tokens():
    sizes = [language_model.symbols_for(n) for n in (0, 100, 10**4, 10**5, 10**6, 10**9)]
    assert sizes == sorted(sizes) and sizes[0] == 64 and sizes[-1] == 4096


def test_lm_learns_context():
    """A language in which each word fixes the next: the trained model has to beat the unigram law by far."""
    rng = np.random.default_rng(0)
    ids = np.tile(np.arange(1, 9), 20_000)
    ids[rng.random(len(ids)) < 0.05] = 9
    p = np.bincount(ids, minlength=12) + 0.5
    p = p / p.sum()
    model, squares = language_model.LogBilinear.start(p, 8), language_model.LogBilinear.of(np.full(12 * 16 + 16 + 12, 1.0), 12, 8)
    rows = np.arange(0, len(ids) + 1, 100)
    model.train(ids, rows, p, squares, rng)
    w1, w2 = language_model.contexts(ids, rows, 0)
    assert model.log_p(ids, w1, w2, model.normalisers()).mean() > np.log(p[ids]).mean() + 0.7


def test_lm_beats_unigrams_on_held_out_texts(spark):
    got = queries.op10_lm_scoring(spark, "/root/testdata/sf0.1").where("held_out").selectExpr("sum(score) / sum(n_tokens) a", "sum(base_score) / sum(n_tokens) b").first()
    assert got["a"] > got["b"] + 0.15


# -- pieces -----------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(tokens.tokenizer_path("piece_bpe_32k.model"))


def every_segmentation(model, word):
    out = []
    for cut in product([0, 1], repeat=len(word) - 1):
        places = [0, *[i + 1 for i, c in enumerate(cut) if c], len(word)]
        own = [model.vocabulary.get(word[a:b]) for a, b in zip(places[:-1], places[1:])]
        if all(own):
            out.append((tuple(x[0] for x in own), sum(x[1] for x in own)))
    ids, lp = zip(*out)
    p = np.exp(np.array(lp))
    return dict(zip(ids, p / p.sum()))


def draw(model, texts, keys, k):
    """For each text its (ids, log-probability, value) in the order drawn, and the next value."""
    data, offsets = buffers(pa.array(texts, pa.large_string()))
    *rounds, (_, _, _, _, bound) = pieces.sample_segmentations(model, data, offsets, keys, k)
    out = [[] for _ in texts]
    for rows, ids, off, log_p, value in rounds:
        for i, r in enumerate(rows.tolist()):
            out[r].append((tuple(ids[off[i] : off[i + 1]].tolist()), log_p[i], value[i]))
    return out, bound


def test_samples_follow_the_lattice(model):
    law = every_segmentation(model, "▁thering")
    n = 6000
    drawn, bound = draw(model, ["▁thering"] * n, pieces.mix(np.arange(n, dtype=np.uint64)), 3)
    first, second = Counter(d[0][0] for d in drawn), Counter(d[1][0] for d in drawn)
    for d, b in zip(drawn, bound):
        values = [v for *_, v in d]
        assert len({s for s, *_ in d}) == len(d) == 3 and values == sorted(values, reverse=True) and b < values[-1]
        assert all(abs(np.log(law[s]) - lp) < 1e-9 for s, lp, _ in d)
    for seg, p in law.items():
        assert abs(first[seg] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 2e-3
        later = sum(q * p / (1 - q) for other, q in law.items() if other != seg)
        assert abs(second[seg] / n - later) < 4 * np.sqrt(later * (1 - later) / n) + 3e-3


def test_inclusion_weights_estimate_sums(model):
    """Weighting each drawn segmentation by probability over inclusion estimates sums over all segmentations without bias."""
    law = every_segmentation(model, "▁thering")
    n, k = 4000, 3
    drawn, bound = draw(model, ["▁thering"] * n, pieces.mix(np.arange(7, n + 7, dtype=np.uint64)), k)
    weight = lambda lp, b: np.exp(lp) / -np.expm1(-np.exp(lp - b))
    for f in (lambda s: 1.0, len, lambda s: float(s[0] % 7)):
        true = sum(p * f(s) for s, p in law.items())
        found = np.array([sum(weight(lp, b) * f(s) for s, lp, _ in d) for d, b in zip(drawn, bound)])
        assert abs(found.mean() - true) < 5 * found.std() / np.sqrt(n) + 1e-9


def test_units_multiply(model):
    """The law of a text is the product of those of its units, and units are cut only where no piece crosses."""
    text = "▁ab▁the12.▁e"
    data, offsets = buffers(pa.array([text], pa.large_string()))
    starts, ends, first = model.units(data, offsets)
    said = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert "".join(said) == text and len(said) > 3 and first.tolist() == [0, len(said)]
    law = every_segmentation(model, text)
    drawn, _ = draw(model, [text], np.array([5], np.uint64), 2000)
    assert len(drawn[0]) == len(law) and {s for s, *_ in drawn[0]} == set(law)
    assert all(math.isclose(math.exp(lp), law[s], rel_tol=1e-9) for s, lp, _ in drawn[0])


def test_few_segmentations_run_out(model):
    total = len(every_segmentation(model, "▁ab"))
    drawn, bound = draw(model, ["▁ab", "▁ab▁ab", "", "▁漢😀"], np.array([1, 2, 3, 4], np.uint64), 60)
    assert [len(d) for d in drawn] == [len({s for s, *_ in d}) for d in drawn] == [total, total**2, 1, 1]
    assert np.isneginf(bound).all()


@pytest.mark.parametrize("window", [0.0, 3.0, 1e9])
def test_windows_do_not_matter(model, monkeypatch, window):
    """Values of far steps are computed where they could count, so every window draws alike."""
    texts, keys = ["▁the▁cat▁sat▁on▁the▁mat" * 30, "▁ab", "12▁x", "▁the▁1▁2"], pieces.mix(np.arange(4, dtype=np.uint64))
    want, bound = draw(model, texts, keys, 12)
    monkeypatch.setattr(pieces._Path, "WINDOW", window)
    got, other = draw(model, texts, keys, 12)
    assert got == want and np.array_equal(bound, other)


def test_units_of_one_hash(model, monkeypatch):
    want, _ = draw(model, ["▁the▁cat▁sat", "▁on▁the▁mat"], np.array([8, 9], np.uint64), 3)
    monkeypatch.setattr(pieces, "span_hashes", lambda data, starts, ends: ((ends - starts) % 2).astype(np.uint64))
    other = pieces.Pieces(tokens.tokenizer_path("piece_bpe_32k.model"))
    assert draw(other, ["▁the▁cat▁sat", "▁on▁the▁mat"], np.array([8, 9], np.uint64), 3)[0] == want


def test_batches_do_not_matter(model):
    texts = ["▁some▁words", "", "▁漢字▁x", "▁" + "ab" * 400, "▁some▁words"]
    keys = np.array([3, 1, 4, 1, 5], np.uint64)
    whole, _ = draw(model, texts, keys, 4)
    model.clear()
    for i in (4, 3, 2, 1, 0):
        for (s, lp, v), (s1, lp1, v1) in zip(whole[i], draw(model, [texts[i]], keys[i : i + 1], 4)[0][0], strict=True):
            assert s == s1 and math.isclose(lp, lp1, abs_tol=1e-9) and math.isclose(v, v1, abs_tol=1e-9)


def test_piece_table(spark):
    texts = ["Hello world", "", None, "  two  spaces ", "漢字 😀 ünï\n\ttab", "x" * 30_000, "a", "Hello world", "ﬁ ½ 𝒜 \x00 e\u0301", "▁ marks ▁▁"]
    df = spark.createDataFrame([(i % 7, i, t, "clash") for i, t in enumerate(texts)], "conv_id long, turn long, text string, sample string")
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    got = pieces.sample_pieces(df, path, ["conv_id", "turn"]).collect()
    assert all(r["decoded"] and 0 <= r["inclusion"] <= 1 and -1e6 < r["log_inclusion"] <= 0 and math.isclose(math.exp(r["log_inclusion"]), r["inclusion"], abs_tol=1e-12) and r["n_pieces"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)
    by = Counter(r["turn"] for r in got)
    assert by[0] == 4 and by[1] == by[2] == 1 and by[5] == 4
    model = pieces.Pieces(path)
    for r in got:  # the library's decoder gives back the normalised text
        normal = model.sp.normalize(texts[r["turn"]] or "").replace("▁", " ")
        assert model.sp.decode(r["ids"]) == model.decode(r["ids"]) == (normal[1:] if normal.startswith(" ") else normal)
    again = pieces.sample_pieces(df.repartition(3), path, ["conv_id", "turn"], with_ids=False)
    assert "ids" not in again.columns
    assert {(r["turn"], r["sample"]): r["ids_crc32"] for r in got} == {(r["turn"], r["sample"]): r["ids_crc32"] for r in again.collect()}
    assert pieces.sample_pieces(df.limit(0), path, ["conv_id"]).count() == 0
    with pytest.raises(ValueError, match="sample"):
        pieces.sample_pieces(df, path, ["sample"])


def test_memory_goes_back_after_several_batches_of_pieces(spark, monkeypatch):
    df = spark.range(20).selectExpr("id as doc_id", "repeat('a few words ', 9) as text")
    path, freed = tokens.tokenizer_path("piece_bpe_32k.model"), []
    want = pieces.sample_pieces(df, path, ["doc_id"]).select("doc_id", "sample", "ids_crc32").collect()
    monkeypatch.setattr(type(df), "mapInArrow", lambda kept, run, schema: (kept, run))
    kept, run = pieces.sample_pieces(df, path, ["doc_id"], rows_a_batch=1)
    monkeypatch.setattr(textvec, "release", lambda: freed.append(1))
    got = [(r["doc_id"], r["sample"], r["ids_crc32"]) for b in run(iter(kept.toArrow().to_batches())) for r in b.to_pylist()]
    assert sorted(got) == sorted(map(tuple, want)) and len(freed) == 3  # not 20


def test_pieces_read_every_document(spark, sf):
    got = queries.op6_sampled_pieces(spark, sf).where("sample = 0").select("doc_id", "conv_id", "turn", "decoded").collect()
    docs, turns = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(*c).collect()] for t, c in (("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])))
    assert sorted((r["doc_id"],) for r in got if r["doc_id"] is not None) == sorted(docs)
    assert sorted((r["conv_id"], r["turn"]) for r in got if r["doc_id"] is None) == sorted(turns) and all(r["decoded"] for r in got)


# -- urls -------------------------------------------------------------------------------------------------------------------------


def brute_rule(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en", "https://badexample.com/en/", "http://a.net/fr/x", "http://net/es/", "http://x.net?q=/fr/", "ftp://É.com/a", "x://y://com/", "http://com", "http://h.co.uk/a\nb", "http://1.2.3.4:80/", "http://.", "http://host.com#/en/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate(URLS)] + [(0, None, None, None)], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, None), (1, None, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = url_filter.judge_urls(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute_rule(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ([verdict] if verdict else ["allow", "block"])
    assert url_filter.judge_urls(pages.limit(0), labels).count() == 0
    assert url_filter.judge_urls(pages, labels.limit(0)).count() == len(URLS) + 1


def test_url_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = sorted(map(tuple, con.execute(queries.ORACLE_SQL["op7_url_filter"]).fetchall()), key=str)
    got = sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in queries.op7_url_filter(spark, sf).collect()), key=str)
    assert got == want and {v for *_, v in got} == {"allow", "block"}


def test_reputation_shrinks_to_its_parents(spark):
    rows = [("a.big.com", 1)] * 30 + [("b.big.com", None)] * 5 + [("c.fine.org", 0)] * 60 + [("d.fine.org", None)]
    got = {r["host"]: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.big.com"]["mean"] > got["b.big.com"]["mean"] > got["d.fine.org"]["mean"] and got["b.big.com"]["n"] == 0
    assert all(r["low"] < r["mean"] for r in got.values())


def test_addresses_and_ports(spark):
    hosts = ["1.2.3.4:80", "1.2.3.4", "9.9.9.9", "a.b.co.uk:8080", "x.com", "com", "", "a.1.2.3.4"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = [tuple(r) for r in df.select(*url_filter.suffix_and_domain(df["host"])).collect()]
    assert got == [("address", "1.2.3.4"), ("address", "1.2.3.4"), ("address", "9.9.9.9"), ("co.uk", "b.co.uk"), ("com", "x.com"), ("com", "com"), ("", ""), ("4", "3.4")]


def test_known_table_handles_nothing():
    known = language_model.Known(np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), 6, 8)
    assert known.find(np.array([1, language_model.END], np.uint64))[2].tolist() == [6, 0]
    assert len(language_model.tokens(*[np.frombuffer(b"A b", np.uint8), np.array([0, 3, 3])])[0]) == 4
    assert pa.__version__
