"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards and range-expanding greedy search.

Vectors are dealt to their nearest `overlap` centroids; in each shard a directed graph is built by robust pruning; the adjacency lists of a
vector from all its shards are united; and every vector is searched for in the united graph of each of its shards: greedily from
the shard's medoid, then outwards as long as neighbours are near enough. Cosines are computed in double precision, and only pairs at or above the threshold count.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, sized_join
from .textvec import column

DEGREE, POOL, ALPHA, BEAM, SLACK = 24, 48, 1.2, 12, 0.05


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def robust_prune(v: np.ndarray, p: int, pool: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Neighbours of p out of the pool: the nearest first, without those that one of them is nearer to by the factor alpha."""
    pool = pool[pool != p]
    near = 1 - v[pool] @ v[p]
    order = np.argsort(near, kind="stable")
    pool, near = pool[order], near[order]
    between = 1 - v[pool] @ v[pool].T
    alive, out = np.ones(len(pool), bool), []
    for i in range(len(pool)):
        if alive[i]:
            out.append(pool[i])
            if len(out) == degree:
                break
            alive &= alpha * between[i] > near
    return np.array(out, np.int64)


def build_graph(v: np.ndarray, degree: int = DEGREE, pool: int = POOL) -> list[np.ndarray]:
    """Adjacency lists of unit vectors: each prunes a pool of its nearest and some far vectors, then takes on backward links."""
    n = len(v)
    far = np.random.default_rng(0).integers(0, n, (n, 8)) if n > pool else np.empty((n, 0), np.int64)
    out: list[np.ndarray] = []
    for a in range(0, n, 512):
        sims = v[a : a + 512] @ v.T
        top = np.argpartition(-sims, min(pool, n - 1), axis=1)[:, : pool + 1] if n > pool + 1 else np.tile(np.arange(n), (len(sims), 1))
        out += [robust_prune(v, a + i, np.unique(np.concatenate((t, far[a + i]))), degree) for i, t in enumerate(top)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(out):
        for j in own.tolist():
            back[j].append(i)
    for i in range(n):
        every = np.union1d(out[i], np.array(back[i], np.int64))
        out[i] = every if len(every) <= degree else robust_prune(v, i, every if len(every) <= 8 * degree else every[np.argsort(-(v[every] @ v[i]))[: 8 * degree]], degree)
    return out


def range_search(v: np.ndarray, start: np.ndarray, flat: np.ndarray, medoid: int, q: int, threshold: float, seen: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Vectors found with a cosine to q of at least the threshold: greedy search from the medoid, then range expansion.

    start, flat: adjacency lists; seen: a scratch array of ints, in which q marks what it has looked at.
    """
    x = v[q]
    first = float(v[medoid] @ x)
    heap, best, seen[medoid] = [(-first, medoid)], [(first, medoid)], q
    while heap:
        d, p = heapq.heappop(heap)
        if len(best) >= beam and -d < best[0][0]:
            break
        near = flat[start[p] : start[p + 1]]
        near = near[seen[near] != q]
        if len(near):
            seen[near] = q
            for s, j in zip((v[near] @ x).tolist(), near.tolist()):
                if len(best) < beam or s > best[0][0]:
                    heapq.heappush(heap, (-s, j))
                    heapq.heappush(best, (s, j))
                    if len(best) > beam:
                        heapq.heappop(best)
    at = np.array([j for s, j in best if s >= threshold - SLACK] + [q], np.int64)
    found, mark = [at], -2 - q  # a second mark: what the beam has passed over may be met again
    seen[at] = mark
    while len(at):
        lengths = start[at + 1] - start[at]
        ends = np.cumsum(lengths)
        near = np.unique(flat[np.repeat(start[at] - ends + lengths, lengths) + np.arange(ends[-1])])
        near = near[seen[near] != mark]
        seen[near] = mark
        at = near[v[near] @ x >= threshold - SLACK]
        found.append(at)
    every = np.concatenate(found)
    return every[(v[every] @ x >= threshold) & (every != q)]


def _cluster(v: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Centroids of spherical k-means on unit vectors."""
    rng = np.random.default_rng(0)
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(rounds if len(c) > 1 else 0):
        own = np.argmax(v @ c.T, 1)
        c = unit(np.stack([m if np.abs(m := v[own == i].sum(0)).max(initial=0) > 0 else v[rng.integers(len(v))] for i in range(len(c))]))
    return c


def _nearest(sims: np.ndarray, n: int) -> np.ndarray:
    return np.argpartition(-sims, n - 1, axis=1)[:, :n]


def _centroids(vectors: DataFrame, k: int, most_sample: int) -> np.ndarray:
    """k centroids, from a sample of at most most_sample vectors, those with the smallest hashes."""
    sample = vectors.orderBy(F.xxhash64("uid"), "uid").limit(most_sample).select("uid", "vector").toArrow()
    return _cluster(unit(_matrix(sample.column("vector"))[np.argsort(sample.column("uid").to_numpy())]), k)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _deal(vectors: DataFrame, n: int, overlap: int, shard_rows: int, most_sample: int, most_centroids: int) -> DataFrame:
    """(shard, uid, vector, copies, shards): each vector in the shards of its `overlap` nearest centroids, so that a shard has about overlap * shard_rows rows, however many vectors there are.

    Up to most_centroids centroids are broadcast. For more, vectors go to the cells of their nearest coarse centroids first; each cell's own centroids come from a sample
    of its rows, and meet the rows in groups of about 20,000; a vector keeps its nearest shards of all its cells.
    """
    shards = max(1, -(-n // shard_rows))
    coarse = shards if shards <= most_centroids else min(most_centroids, int(np.ceil(np.sqrt(shards))))
    centroids = vectors.sparkSession.sparkContext.broadcast(_centroids(vectors, coarse, most_sample))  # at most most_centroids rows
    wide = min(overlap, len(centroids.value))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            top = np.sort(_nearest(unit(_matrix(column(batch, "vector"))) @ centroids.value.T, wide), axis=1).astype(np.int64)
            which = pa.array(np.repeat(np.arange(len(batch)), wide))
            yield pa.RecordBatch.from_arrays([pa.array(top.ravel()), *(column(batch, k).take(which) for k in ("uid", "vector", "copies")), _lists(top).take(which)], ["shard", "uid", "vector", "copies", "shards"])

    dealt = vectors.select("uid", "vector", "copies").mapInArrow(deal, "shard long, uid long, vector array<double>, copies long, shards array<long>")
    if coarse == shards:
        return materialize(dealt, "shards")
    cells = materialize(dealt.select(F.col("shard").alias("cell"), "uid", "vector"), "cells")
    sizes = materialize(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")), "cell-sizes")  # a row a cell
    sized = cells.join(F.broadcast(sizes), "cell")
    drawn = sized.where(F.pmod(F.xxhash64("uid", F.lit(3)), F.col("rows")) < most_sample)  # about most_sample rows a cell

    def centres(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        k = max(1, -(-table.column("rows")[0].as_py() // (shard_rows * wide)))
        c = _cluster(unit(_matrix(table.column("vector"))), k)
        return pa.table({"cell": pa.array(np.full(len(c), table.column("cell")[0].as_py()), pa.int64()), "sub": np.arange(len(c)), "centre": _lists(c)})

    own = materialize(drawn.groupBy("cell").applyInArrow(centres, "cell long, sub long, centre array<double>"), "centroids")
    groups = F.ceil(F.col("rows") / F.lit(20_000.0)).cast("int")
    rows = sized.select("cell", F.pmod(F.xxhash64("uid"), groups).cast("int").alias("group"), "uid", "vector")
    spread = own.join(F.broadcast(sizes), "cell").select("cell", F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"), "sub", "centre")

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"uid": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        sims = unit(_matrix(left.column("vector"))) @ _matrix(right.column("centre")).T
        top = _nearest(sims, min(overlap, sims.shape[1]))
        name = left.column("cell")[0].as_py() * (1 << 32) + right.column("sub").to_numpy()
        return pa.table({"uid": np.repeat(left.column("uid").to_numpy(), top.shape[1]), "shard": name[top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel()})

    found = rows.groupBy("cell", "group").cogroup(spread.groupBy("cell", "group")).applyInArrow(assign, "uid long, shard long, sim double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "shard")), asc=False), 1, overlap)  # overlap * overlap entries a vector
    chosen = found.groupBy("uid").agg(F.array_sort(F.transform(best, lambda x: x["shard"])).alias("shards"))
    return materialize(vectors.select("uid", "vector", "copies").join(chosen, "uid").select(F.explode("shards").alias("shard"), "uid", "vector", "copies", "shards"), "shards")


def mark_near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, overlap: int = 3, shard_rows: int = 1500, most_sample: int = 20_000, most_centroids: int = 4096, block_rows: int = 3000) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row for each row of df.

    Equal vectors are handled once, and count as often as they occur. Null or zero vectors, and those that hold null or non-finite components, link with nothing; vectors of different
    lengths don't link, and each length is worked off by itself. Centroids come from samples of at most most_sample vectors; every vector is indexed and searched.
    Shards of more than block_rows are worked off in pairs of blocks, so no task holds more than two blocks.
    component_id is the least id that links lead to, null if all are; rows with that id are kept. An empty df gives an empty result; other columns are not read.
    """
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    rows = materialize(df.select(F.col(id_col).cast("long").alias("id"), F.when(fine, x.cast("array<double>")).alias("vector")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    lengths = {r["d"]: r["count"] for r in rows.where("vector is not null").groupBy(F.size("vector").alias("d")).count().collect()}  # a row a length
    linked = [d for d, n in sorted(lengths.items()) if n > 1]
    rest = rows.where(F.col("vector").isNull() | ~F.size("vector").isin(linked)) if linked else rows
    out = rest.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    for d in linked:
        own = rows.where(F.col("vector").isNotNull() & (F.size("vector") == d))
        out = out.unionByName(_mark(own, id_col, threshold, overlap, shard_rows, most_sample, most_centroids, block_rows))
    return out


def _mark(rows: DataFrame, id_col: str, threshold: float, overlap: int, shard_rows: int, most_sample: int, most_centroids: int, block_rows: int) -> DataFrame:
    """The result for vectors of one length."""
    vectors = materialize(rows.groupBy("vector").agg(F.min("row").alias("uid"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    n = vectors.count()
    dealt = _deal(vectors, n, overlap, shard_rows, most_sample, most_centroids)
    blocks = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(block_rows))).cast("int").alias("blocks"))  # a row a shard
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = dealt.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")).withColumn("other", other)
    placed = placed.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "uid", "vector", "copies", "shards")

    def graph(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        uid = table.column("uid").to_numpy()
        own = build_graph(unit(_matrix(table.column("vector"))))
        off = np.concatenate(([0], np.cumsum([len(o) for o in own]))).astype(np.int32)
        return pa.table({"uid": uid, "near": pa.ListArray.from_arrays(pa.array(off), pa.array(uid[np.concatenate(own)] if len(own) else uid))})

    built = placed.groupBy("shard", "i", "j").applyInArrow(graph, "uid long, near array<long>")
    united = materialize(built.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        uid, block = table.column("uid").to_numpy(), table.column("block").to_numpy()
        shard, across = table.column("shard")[0].as_py(), table.column("i")[0].as_py() != table.column("j")[0].as_py()
        v, copies, m = unit(_matrix(table.column("vector"))), table.column("copies").to_numpy(), len(uid)
        shards = table.column("shards").combine_chunks().flatten().to_numpy().reshape(m, -1)
        lists = table.column("near").combine_chunks()
        length = np.diff(lists.offsets.to_numpy())
        every = lists.flatten().to_numpy()
        place = np.minimum(np.searchsorted(uid, every), m - 1)
        here = uid[place] == every  # neighbours of the united graph that this shard holds
        start = np.concatenate(([0], np.cumsum(here)))[np.concatenate(([0], np.cumsum(length)))]
        flat, medoid, seen = place[here], int(np.argmax(v @ v.mean(0))), np.full(m, -1, np.int64)
        linked = np.zeros((m, m), bool)
        for q in range(m):
            linked[q, range_search(v, start, flat, medoid, q, threshold, seen)] = True
        linked |= linked.T
        links, component, free = np.zeros(m, np.int64), np.arange(m), np.ones(m, bool)
        for q in range(m):
            y = np.flatnonzero(linked[q])
            # a pair counts in the first of its common shards, and across blocks only where its two blocks meet
            common = (shards[y][:, :, None] == shards[q][None, None, :]).any(2)
            home = np.where(common, shards[y], np.iinfo(np.int64).max).min(1) == shard if len(y) else np.zeros(0, bool)
            links[q] = copies[y[home & ((block[y] != block[q]) if across else True)]].sum()
            if free[q]:
                at, free[q] = np.array([q]), False
                while len(at):
                    at = np.flatnonzero(linked[at].any(0) & free)
                    free[at] = False
                    component[at] = q
        return pa.table({"uid": uid, "links": links, "root": uid[component]})

    found = placed.join(united, "uid").groupBy("shard", "i", "j").applyInArrow(search, "uid long, links long, root long")
    found = materialize(found, "found")
    linked = found.groupBy("uid").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("uid").alias("src"), F.col("root").alias("dst")))
    whole = vectors.join(linked, "uid").join(classes, vectors["uid"] == classes["node"], "left").select("uid", "vector", "copies", "links", "least_id", F.coalesce("component", "uid").alias("class"))
    whole = materialize(whole, "linked")
    least = whole.groupBy("class").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    named = sized_join(whole, materialize(least, "components"), ["class"], "__n", n)
    named = materialize(named.select("vector", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"), "named")
    out = sized_join(rows, named, ["vector"], "copies", rows.count())
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def audit_recall(df: DataFrame, marked: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, queries: int = 200) -> float | None:
    """Share of the links of up to `queries` vectors (those marked as linked first, then by hashes of the id) that `marked` has, against brute force over all rows in blocks. None without any link."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(x, lambda e: e != 0)
    valid = df.where(fine).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))
    links = marked.groupBy(F.col(id_col).alias("id")).agg(F.max("n_links").alias("n_links"))
    half = valid.join(links, "id").orderBy(F.pmod(F.xxhash64("id"), F.lit(2)) * F.least("n_links", F.lit(1)), F.xxhash64("id")).limit(queries).select("id", "v", "n_links").toArrow()
    ids, found, by_length = half.column("id").to_numpy(), half.column("n_links").to_numpy(), {}
    for i, v in enumerate(half.column("v").to_pylist()):
        by_length.setdefault(len(v), []).append((i, v))
    sent = {d: (np.array([i for i, _ in own]), unit(np.array([v for _, v in own]))) for d, own in by_length.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            size, who = np.diff(column(batch, "v").offsets.to_numpy()), column(batch, "id").to_numpy(zero_copy_only=False)
            for d, (at, q) in sent.items():
                here = np.flatnonzero(size == d)
                if len(here):
                    near = unit(_matrix(column(batch, "v").take(pa.array(here)))) @ q.T >= threshold
                    total[at] += (near & (who[here][:, None] != ids[at][None, :])).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids))), pa.array(total)], ["i", "n"])

    true = {r["i"]: r["n"] for r in valid.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()} if len(ids) else {}
    n = np.array([true.get(i, 0) for i in range(len(ids))])
    return float(np.minimum(n, found).sum() / n.sum()) if n.sum() else None
