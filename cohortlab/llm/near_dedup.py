"""Near-duplicates of texts by DartMinHash signatures, banded joining, exact verification and connected components.

A text is the weighted set of its runs of five words, each weighing as often as it occurs. Darts are thrown at the region of each element, unit cells of
weight times an axis of ranks, as a Poisson process that depends on the element alone; a signature coordinate keeps the earliest dart
that hits it. About k ln k + 2k darts a text suffice, whatever its length. Two texts agree in a coordinate with a chance of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import build_bloom, materialize, probe_bloom, remove, sized_join
from .textvec import WORD, column, gather, lists, mix, parts, release, span_hashes, spans, window_hashes

SHINGLE, BANDS, ROWS = 5, 25, 5
OUTPUT = ["class_id", "class_size", "kept"]
_C, _D, _MASK = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and weights (counts) of the distinct shingles of each row, sorted by hash, and the n + 1 row offsets."""
    starts, ends, first = spans(data, offsets, WORD)
    h, off = window_hashes(span_hashes(data, starts, ends), first, width)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], np.diff(np.append(at, len(h))).astype(np.float64), np.searchsorted(row[at], np.arange(len(off)))


def cells(h: np.ndarray, weight: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, share of the unit cell that the weight covers, and row of every cell of weight of every element."""
    n = np.ceil(weight).astype(np.int64)
    which = np.repeat(np.arange(len(h)), n)
    c = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return mix(h[which] + c.astype(np.uint64) * np.uint64(_D)), np.minimum(1.0, weight[which] - c), row[which]


def dart_signatures(h: np.ndarray, weight: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """(rows, k) signature of the weighted sets (element hashes and weights by row); rows without weight are all 0."""
    n = len(off) - 1
    cell, cover, row = cells(h, weight, off)
    total = np.bincount(row, cover, n)
    sig = np.zeros(n * k, np.uint64)
    reach = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-12)  # of the ranks, for that many darts a row
    todo = total > 0
    while todo.any():
        own = todo[row]
        e, cov, r = cell[own], cover[own], row[own]
        rank, throw = np.zeros(len(e)), 0
        keys, ranks, darts = [], [], []
        while len(e):  # the throws at a cell, in order of their ranks
            throw += 1
            u = (mix(e + np.uint64(throw * _C & _MASK)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            rank = rank - np.log1p(-u)
            near = rank < reach[r]
            e, cov, r, rank = e[near], cov[near], r[near], rank[near]
            dart = mix(e ^ np.uint64(throw * _D & _MASK))
            inside = (dart & np.uint64(0xFFFFFF)).astype(np.float64) < cov * 2.0**24
            bucket = ((dart >> np.uint64(40)) * np.uint64(k)) >> np.uint64(24)
            keys.append((r * k + bucket.astype(np.int64))[inside])
            ranks.append(rank[inside])
            darts.append(dart[inside])
        key, rk, dart = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
        best = np.full(n * k, np.inf)
        np.minimum.at(best, key, rk)
        won = rk == best[key]
        sig[key[won]] = dart[won]
        todo &= np.isinf(best).reshape(n, k).any(1)  # a coordinate that no dart hit: throw further
        reach = np.where(todo, reach * 2, reach)
    return sig.reshape(n, k)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    factor = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((sig[:, : bands * rows].reshape(-1, bands, rows) * factor).sum(2) + np.arange(bands, dtype=np.uint64))


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(col, ""))


def _signed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, bands): a 128-bit key of the text and its band keys, none for a text without words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), F.xxhash64(text, F.lit(1)).alias("k2"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in parts(_lower(column(batch, "text")), 512 << 10, 2500):  # a short text takes as many darts as a long one
                h, w, off = weighted_shingles(data, offsets)
                keys = band_keys(dart_signatures(h, w, off, BANDS * ROWS)).view(np.int64)
                full = np.diff(off) > 0
                where = np.concatenate(([0], np.cumsum(full * BANDS)))
                yield pa.RecordBatch.from_arrays([*(column(batch, c).slice(i, j - i) for c in ("id", "k1", "k2")), lists(keys[full].ravel(), where)], ["id", "k1", "k2", "bands"])

    return source.mapInArrow(run, "id long, k1 long, k2 long, bands array<long>")


def _shingled(df: DataFrame, id_col: str, text_col: str, texts: DataFrame) -> DataFrame:
    """(uid, cells): the sorted cell hashes of the texts in `texts` (uid, id, k1, k2). Only rows that a Bloom filter lets through are shuffled."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("k1"), text.alias("text"))
    maybe = probe_bloom(source, "k1", build_bloom(texts.select("k1"), "k1"), "__maybe").where("__maybe").withColumn("k2", F.xxhash64("text", F.lit(1)))
    hit = maybe.join(texts.select("uid", F.col("id").alias("id_"), "k1", "k2"), ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("id_"))).select("uid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in parts(_lower(column(batch, "text")), 512 << 10):
                e, _, row = cells(*weighted_shingles(data, offsets))
                order = np.lexsort((e, row))
                yield pa.RecordBatch.from_arrays([column(batch, "uid").slice(i, j - i), lists(e[order].view(np.int64), np.searchsorted(row, np.arange(j - i + 1)))], ["uid", "cells"])

    return hit.mapInArrow(run, "uid long, cells array<long>").dropDuplicates(["uid"])


def _verified(pairs: DataFrame, shingled: DataFrame, threshold: float) -> DataFrame:
    """The pairs (src, dst, n) whose weighted Jaccard similarity is at least the threshold, computed in full.

    A text with many partners is copied to as many salts as it needs for about 500 partners each.
    """
    salts = lambda n: F.ceil(n / F.lit(500.0)).cast("int")
    most = pairs.groupBy("src").agg(F.max(salts(F.col("n"))).alias("salts"))
    left = shingled.select(F.col("uid").alias("src"), F.col("cells").alias("a")).join(most, "src").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = shingled.select(F.col("uid").alias("dst"), F.col("cells").alias("b"))
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("dst"), salts(F.col("n"))).cast("int")).drop("n")
    both = salted.join(right, "dst").join(left, ["src", "salt"]).select("src", "dst", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = column(batch, "a"), column(batch, "b")
            av, bv, ao, bo = a.values.to_numpy(), b.values.to_numpy(), a.offsets.to_numpy(), b.offsets.to_numpy()
            near = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    continue
                z = np.concatenate((x, y))
                z.sort()
                same = int((z[1:] == z[:-1]).sum())
                near[i] = same >= threshold * (len(z) - same)
            release()
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(near)) for c in (column(batch, "src"), column(batch, "dst"))], ["src", "dst"])

    return both.mapInArrow(run, "src long, dst long")


def links_between_classes(size: np.ndarray, flat: np.ndarray, label: np.ndarray, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links between texts of different classes, by an exact prefix filter: enough of them to join every two classes that any link joins.

    size, flat: cells of each text; label: its class; side: texts of one side are not compared with each other, unless all are on side -1. With the cells of a text ordered from the
    rarest to the most frequent, two texts of a similarity of at least t share one of the first |x| - ceil(t |x|) + 1 cells of both. Pairs within a class, given or found, are passed over.
    """
    n, first = len(size), np.concatenate(([0], np.cumsum(size)))
    _, cell, often = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    cell, row = rank[cell], np.repeat(np.arange(n), size)
    order = np.lexsort((cell, row))
    cell = cell[order]
    need = np.ceil(size * threshold - 1e-9).astype(np.int64)
    inside = np.arange(len(cell)) - first[row] < (size - need + 1)[row]
    by = np.argsort(cell[inside], kind="stable")
    posting, at = row[inside][by], np.searchsorted(cell[inside][by], np.arange(len(often) + 1))
    root = {c: c for c in set(label.tolist())}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    current, mark, out = label.copy(), np.zeros(len(often), bool), []
    for x in range(n):
        own = cell[first[x] : first[x + 1]]
        head = own[: size[x] - need[x] + 1]
        near = np.flatnonzero(np.bincount(gather(posting, at[head], at[head + 1] - at[head]), minlength=n)[:x])
        near = near[(current[near] != current[x]) & ((side[near] != side[x]) | (side[x] < 0)) & (np.minimum(size[near], size[x]) >= threshold * np.maximum(size[near], size[x]))]
        if not len(near):
            continue
        mark[own] = True
        hits = mark[gather(cell, first[near], size[near])]
        mark[own] = False
        both = np.add.reduceat(hits, np.cumsum(size[near]) - size[near], dtype=np.int64)
        for y in near[both >= threshold * (size[near] + size[x] - both) - 1e-9].tolist():
            a, b = find(int(current[x])), find(int(current[y]))
            if a != b:
                out.append((x, y))
                root[max(a, b)] = min(a, b)
                current[(current == a) | (current == b)] = min(a, b)
    return out


def _links_in_families(members: DataFrame, pairs: DataFrame, classes: DataFrame, shingled: DataFrame, threshold: float, block: int = 1500) -> DataFrame:
    """(src, dst): links that join classes, among the texts of buckets that still hold several classes.

    Texts that a chain of shared buckets connects are a family. Small families are dealt by hash, several to a task; a larger one is cut into blocks, and each pair of its
    blocks is a task, so no task holds more than about 2 * block texts and no pair of texts is ever a row.
    """
    held = members.join(classes, members["uid"] == classes["node"], "left").select("band", "key", "uid", F.coalesce("component", "uid").alias("class"))
    mixed = held.groupBy("band", "key").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    open_ = sized_join(held, mixed, ["band", "key"], "n", held.count()).select("uid", "class").distinct()
    family = connected_components(pairs.select("src", "dst"))
    placed = materialize(open_.join(family, open_["uid"] == family["node"]).select("uid", "class", F.col("component").alias("family")), "open")
    total = placed.count()
    sizes = placed.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b").select("family", "n")
    groups = max(1, total // block)
    blocks = F.ceil(F.col("n") / F.lit(float(block))).cast("int")
    dealt = sized_join(placed, sizes, ["family"], "n", max(total, 1)).withColumn("blocks", blocks).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("group", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(groups))).otherwise(-1 - F.col("family"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("uid", "class", "group", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part")
    rows = dealt.join(shingled, "uid")

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        cells_ = table.column("cells").combine_chunks()
        uid, part = table.column("uid").to_numpy(), table.column("part").to_numpy()
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        found = links_between_classes(np.diff(cells_.offsets.to_numpy()).astype(np.int64), cells_.flatten().to_numpy(), table.column("class").to_numpy(), part if across else np.full(len(uid), -1), threshold)
        return pa.table({"src": uid[[x for x, _ in found]].astype(np.int64), "dst": uid[[y for _, y in found]].astype(np.int64)})

    return rows.groupBy("group", "i", "j").applyInArrow(link, "src long, dst long")


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (row, id, k1, k2) of df, and one row for each distinct text with its class.

    Every text of a bucket is compared with the bucket's least text, which joins most near-duplicates at a cost in proportion to the rows. Texts of buckets that
    still hold several classes are then compared exactly within their families, so every link between two texts that share a bucket is found or lies within a class.
    """
    rows = materialize(_signed(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "signed")
    texts = rows.groupBy("k1", "k2").agg(F.min("row").alias("uid"), F.min(F.struct("id", "row")).alias("top"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    texts = materialize(texts.select("uid", "k1", "k2", F.col("top.id").alias("id"), F.col("top.row").alias("top_row"), "copies", "bands"), "texts")
    total = texts.count()
    banded = texts.select("uid", F.posexplode("bands").alias("band", "key"))
    buckets = materialize(banded.groupBy("band", "key").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    shared = probe_bloom(banded, "key", build_bloom(buckets.select("key"), "key"), "__maybe").where("__maybe").drop("__maybe")  # most bands have a bucket of their own
    members = materialize(sized_join(shared, buckets, ["band", "key"], "n", total), "members")
    pairs = materialize(members.where("uid <> least").groupBy(F.col("least").alias("src"), F.col("uid").alias("dst")).agg(F.max("n").alias("n")), "pairs")
    ids = members.select("uid").distinct().join(texts.select("uid", "id", "k1", "k2"), "uid")
    candidates = materialize(ids, "candidates")
    shingled = materialize(_shingled(df, id_col, text_col, candidates), "shingles")
    links = materialize(_verified(pairs, shingled, threshold), "verified")
    classes = connected_components(links)
    more = materialize(_links_in_families(members, pairs, classes, shingled, threshold), "links")
    if not more.isEmpty():
        classes = connected_components(links.unionByName(more))
    joined = texts.drop("bands").join(classes, texts["uid"] == classes["node"], "left").select("uid", "k1", "k2", "id", "top_row", "copies", F.coalesce("component", "uid").alias("class"))
    joined = materialize(joined, "classed")
    for table in (texts, buckets, members, pairs, candidates, shingled):  # all that follows reads other tables
        remove(table)
    top = joined.groupBy("class").agg(F.min(F.struct("id", "top_row")).alias("top"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("__texts"))
    return rows, sized_join(joined, materialize(top, "tops"), ["class"], "__texts", total)


def mark_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id_col, class_id, class_size, kept), one row for each row of df.

    Rows whose texts are joined by a chain of links (weighted Jaccard similarity of their runs of five words of at least
    the threshold) form a class; equal texts always do. class_id is its least id, null if all are, and exactly one row of a class is kept, one with
    that id. A text of fewer than five words is one run. Texts without words, null ones included, link only with equal ones.
    """
    rows, texts = _classes(df, id_col, text_col, threshold)
    texts = materialize(texts.select("k1", "k2", "copies", F.col("top.id").alias("class_id"), F.col("top.top_row").alias("top_row"), "class_size"), "classes")
    out = sized_join(rows.select("row", "id", "k1", "k2"), texts, ["k1", "k2"], "copies", rows.count())
    return out.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("row") == F.col("top_row")).alias("kept"))


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """df with one row of each class of near-duplicates: the one with the least id, its columns unchanged.

    Rows that no dropped text can equal pass straight through a Bloom filter; the others are joined with the dropped texts. Of rows with equal text and id one stays, and a null id
    counts as the least. Texts without words, null and empty ones included, are near-duplicates of equal ones only. An empty df stays empty. Columns that begin with two underscores are reserved.
    """
    rows, texts = _classes(df, id_col, text_col, threshold)
    verdict = texts.where((F.col("copies") > 1) | (F.col("uid") != F.col("top.top_row"))).select("k1", "k2", "copies", F.col("top.top_row").alias("top_row"))
    marked = sized_join(rows.select("row", "id", "k1", "k2"), materialize(verdict, "verdicts"), ["k1", "k2"], "copies", rows.count())
    # of the rows with one text and id, how many are there, and does one of them stay?
    marked = materialize(marked.groupBy("k1", "k2", "id").agg(F.count(F.lit(1)).alias("__n"), F.max((F.col("row") == F.col("top_row")).cast("int")).alias("__stays")), "marked")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumns({"__k1": F.xxhash64(text), "__k2": F.xxhash64(text, F.lit(1))})
    probed = probe_bloom(keyed, "__k1", build_bloom(marked.select("k1"), "k1"), "__maybe")
    through = probed.where("not __maybe")
    maybe = probed.where("__maybe")
    join = lambda how, right: maybe.join(right, (maybe["__k1"] == right["k1"]) & (maybe["__k2"] == right["k2"]) & maybe[id_col].cast("long").eqNullSafe(right["id"]), how)
    stay = join("left_anti", marked)
    if not marked.where("__stays = 1").isEmpty():  # texts with copies, one row of which stays
        one = join("left_semi", marked.where("__stays = 1"))
        stay = stay.unionByName(one.dropDuplicates(["__k1", "__k2", id_col]))
    return through.unionByName(stay).select(*df.columns)
