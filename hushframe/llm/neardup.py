"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

1. Equal vectors are one class with a multiplicity. Classes go to the ``overlap`` nearest of some centroids, which are fitted on a
   sample of ``SAMPLE`` vectors at most; every class is indexed. Centroids that could be links of each other are one, so that a dense group does not fall
   apart. A cluster of more than ``cap`` classes is dealt into blocks by hash.
2. Each block's nearest neighbours are pruned (a neighbour goes if a nearer one is, by the factor ALPHA, closer to it) and joined
   by reverse edges. The lists of a class's blocks are united into one flat graph.
3. A block's region is its members and, of the united graph, their neighbours elsewhere that are near enough to link with something a member
   links with. Every class is searched in the regions of its clusters: greedily with a beam from the medoids of the region's graph (one for each part
   that no edge leaves) and, in its own block, from its own place too; then, once within range, through the neighbours of everything
   within range, also where they belong to other shards.
4. Links are verified as cosines in double precision. A link counts for an end in the smallest region that the end asks and the other is in, so nothing
   is counted twice; a task sends on a number of links for each class and one edge to its component, never pairs.
5. The recall is audited by comparing ``AUDIT`` classes, taken by hash whether links were found or not, with all others. If too few of them have links
   to tell, partners put at the threshold in random directions must share a cluster often enough. While ``least_recall`` is not reached, the search is
   repeated with twice the overlap; once that costs as much as comparing everything, all classes are compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, stored
from .tokens import release

THRESHOLD = 0.9
SAMPLE = 100_000
PER_SHARD = 1500
MAX_SHARDS = 20_000
CAP = 6000
NEIGHBOURS = 32
DEGREE = 16
ALPHA = 1.2
BEAM = 12
AUDIT = 4096
#: Audited classes with links that a figure needs.
LEAST_LINKED = 100
#: Bits of a region's name for its block within the cluster.
BLOCK_BITS = 24
#: Numbers in a block of vectors that the exact comparison hands to every task.
BLOCK = 1 << 22


def centroids(x: np.ndarray, k: int, rounds: int = 6, apart: float = THRESHOLD) -> np.ndarray:
    """Spherical k-means of unit vectors, from evenly spaced rows of a hash-ordered sample; of middles with a cosine of ``apart`` or more one stays."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 2000] @ c.T, 1) for i in range(0, len(x), 2000)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    kept = np.ones(k, bool)
    for i in range(k):
        if kept[i]:
            kept[i + 1 :] &= c[i + 1 :] @ c[i] < apart
    return c[kept]


def flat_graph(x: np.ndarray, neighbours: int = NEIGHBOURS, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned neighbour lists of unit vectors, with reverse edges."""
    n = len(x)
    k = min(neighbours, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64)] * n
    lists: list[np.ndarray] = []
    for i in range(0, n, 256):
        sim = x[i : i + 256] @ x.T
        rows = np.arange(len(sim))
        sim[rows, i + rows] = -9
        cand = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        s = np.take_along_axis(sim, cand, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        cand, s = np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1)
        to = np.maximum(0, 2 - 2 * s)  # squared distances to the node, and among the candidates
        near = x[cand]
        between = np.maximum(0, 2 - 2 * (near @ near.transpose(0, 2, 1)))
        alive, kept = np.ones(cand.shape, bool), np.zeros(cand.shape, bool)
        for j in range(k):
            take = alive[:, j] & (kept.sum(1) < degree)
            kept[take, j] = True
            alive[take] &= alpha**2 * between[take, j] > to[take]
        lists += [c[m] for c, m in zip(cand, kept, strict=True)]
    frm = np.repeat(np.arange(n), [len(x) for x in lists])
    to = np.concatenate(lists)
    pairs = np.unique(np.concatenate([frm * n + to, to * n + frm]))
    frm, to = pairs // n, pairs % n
    cuts = np.searchsorted(frm, np.arange(n + 1))
    out = []
    for i in range(n):
        near = to[cuts[i] : cuts[i + 1]]
        if len(near) > 2 * degree:  # a hub keeps its nearest, but its own list stays
            far = np.setdiff1d(near, lists[i], assume_unique=True)
            far = far[np.argsort(-(x[far] @ x[i]), kind="stable")][: 2 * degree - len(lists[i])]
            near = np.concatenate([lists[i], far])
        out.append(near)
    return out


def medoids(x: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """The node nearest the middle of each connected part of the graph."""
    a, b = np.nonzero(adjacent >= 0)
    part = _join(np.arange(len(x)), a, adjacent[a, b])
    name, of = np.unique(part, return_inverse=True)
    sums = np.zeros((len(name), x.shape[1]))
    np.add.at(sums, of, x)
    near = np.einsum("nd,nd->n", x, sums[of])
    order = np.lexsort((-near, of))
    return order[np.searchsorted(of[order], np.arange(len(name)))]


def range_search(x: np.ndarray, adjacent: np.ndarray, starts: np.ndarray, q: np.ndarray, own: np.ndarray, threshold: float, beam: int = BEAM) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, similarities of the chunk's queries to the nodes that were visited, else -2). ``own``: a query's node, or -1."""
    m, width = adjacent.shape if len(adjacent) else (0, 0)
    for lo in range(0, len(q), 256):
        part = q[lo : lo + 256]
        n = len(part)
        sim = np.full((n, m), -2.0)
        sim[:, starts] = part @ x[starts].T
        held, score = np.full((n, beam), -1), np.full((n, beam), -9.0)
        entry = min(beam - 1, len(starts))
        top = np.argpartition(-sim[:, starts], entry - 1, axis=1)[:, :entry]
        held[:, :entry], score[:, :entry] = starts[top], np.take_along_axis(sim[:, starts], top, 1)
        place = own[lo : lo + 256]
        has = np.flatnonzero(place >= 0)
        again = (held[has] == place[has, None]).any(1)
        sim[has, place[has]] = 1.0
        has = has[~again]
        held[has, -1], score[has, -1] = place[has], 1.0
        done = np.zeros((n, beam), bool)
        while width:
            open_ = np.where(done | (held < 0), -9.0, score)
            best = open_.argmax(1)
            act = np.flatnonzero(open_[np.arange(n), best] > -9)
            if not len(act):
                break
            done[act, best[act]] = True
            near = adjacent[held[act, best[act]]]
            new = (near >= 0) & (sim[act[:, None], near] == -2)
            s = np.where(new, (x[near] @ part[act][:, :, None])[:, :, 0], -9.0)
            at = np.nonzero(new)
            sim[act[at[0]], near[at]] = s[at]
            all_score = np.concatenate([score[act], s], 1)
            top = np.argpartition(-all_score, beam - 1, axis=1)[:, :beam]
            score[act] = np.take_along_axis(all_score, top, 1)
            held[act] = np.take_along_axis(np.concatenate([held[act], np.where(new, near, -1)], 1), top, 1)
            done[act] = np.take_along_axis(np.concatenate([done[act], np.zeros(near.shape, bool)], 1), top, 1)
        qi, ni = np.nonzero(sim >= threshold)
        while len(qi) and width:  # everything within range hands on its neighbours
            key = np.zeros(0, np.int64)
            for i in range(0, len(qi), 200_000):
                near = adjacent[ni[i : i + 200_000]]
                who = np.broadcast_to(qi[i : i + 200_000, None], near.shape)
                new = (near >= 0) & (sim[who, near] == -2)
                key = np.unique(np.concatenate([key, who[new] * m + near[new]]))
            qi, ni = key // m, key % m
            for i in range(0, len(qi), 50_000):
                j = slice(i, i + 50_000)
                sim[qi[j], ni[j]] = np.einsum("kd,kd->k", part[qi[j]], x[ni[j]])
            hit = sim[qi, ni] >= threshold
            qi, ni = qi[hit], ni[hit]
        yield lo, sim


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, v): vectors of length 1 in double precision, null for those that link with nothing. Components are divided by the largest
    first, so that squares neither vanish nor overflow."""
    for batch in batches:
        raw, n = batch.column("raw"), batch.num_rows
        sizes = raw.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
        row = np.repeat(np.arange(n), sizes)
        bad = np.bincount(row, ~np.isfinite(values), n) > 0
        top = np.zeros(n)
        np.maximum.at(top, row, np.where(bad[row], 0.0, np.abs(values)))
        ok = ~bad & (top > 0)
        kept = ok[row]
        row, values = row[kept], values[kept]
        values = values / top[row]
        values = values / np.sqrt(np.bincount(row, values * values, n))[row] + 0.0
        at = np.concatenate([[0], np.cumsum(np.where(ok, sizes, 0))]).astype(np.int32)
        v = pa.ListArray.from_arrays(pa.array(at), pa.array(values), mask=pa.array(~ok))
        yield pa.RecordBatch.from_arrays([batch.column("id"), v], names=["id", "v"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def _graph(key: tuple, table: pa.Table) -> pa.Table:
    node = table.column("node").to_numpy()
    order = np.argsort(node, kind="stable")
    node, x = node[order], _matrix(table.column("v"))[order]
    lists = flat_graph(x)
    out = pa.table({"node": pa.array(node), "near": pa.array([node[a] for a in lists], pa.list_(pa.int64())), "cosine": pa.array([x[a] @ x[i] for i, a in enumerate(lists)], pa.list_(pa.float64()))})
    release()
    return out


def _search(threshold: float):  # noqa: ANN202
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cluster, region = key[0].as_py(), key[0].as_py() << BLOCK_BITS | key[2].as_py()
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "links": pa.array([], pa.int64())})
        index = table.filter(table.column("as_index")).sort_by("node")
        query = table.filter(table.column("as_query")).sort_by("node")
        if not index.num_rows or not query.num_rows:
            return none
        node, asking = index.column("node").to_numpy(), query.column("node").to_numpy()
        mult, x, q_x = index.column("n").to_numpy(), _matrix(index.column("v")), _matrix(query.column("v"))
        lists = _lists(index.column("near"))
        adjacent = np.full((len(node), max(map(len, lists), default=0)), -1, np.int64)
        for i, near in enumerate(lists):
            near = np.unique(near)
            at = np.searchsorted(node, near)
            at[at == len(node)] = 0
            here = at[node[at] == near]
            adjacent[i, : len(here)] = here
        # for each class of the region and each cluster that is asked here: the first region of that cluster which it is in
        own = _lists(query.column("clusters"))
        clusters = np.unique(np.concatenate(own))
        asked = np.stack([np.resize(np.searchsorted(clusters, c), max(map(len, own))) for c in own])
        first = np.full((len(node), len(clusters)), np.iinfo(np.int64).max)
        present = _lists(index.column("present"))
        who, regions = np.repeat(np.arange(len(node)), [len(r) for r in present]), np.concatenate(present)
        at = np.searchsorted(clusters, regions >> BLOCK_BITS)
        at[at == len(clusters)] = 0
        known = clusters[at] == regions >> BLOCK_BITS
        np.minimum.at(first, (who[known], at[known]), regions[known])
        place = np.searchsorted(node, asking)
        place[place == len(node)] = 0
        place = np.where(node[place] == asking, place, -1)
        found = np.zeros((len(asking), len(node)), bool)  # bounded by the cap and the edges that leave a block
        for lo, sim in range_search(x, adjacent, medoids(x, adjacent), q_x, place, threshold):
            found[lo : lo + len(sim)] = sim >= threshold
        if (place >= 0).all():
            found[:, place] |= found[:, place].T  # what either end finds is a link
        links, best = np.zeros(len(asking), np.int64), np.arange(len(asking) + len(node))
        for lo in range(0, len(asking), 512):
            q, i = np.nonzero(found[lo : lo + 512])
            q = q + lo
            other = asking[q] != node[i]
            q, i = q[other], i[other]
            if len(q):
                mine = first[i[:, None], asked[q]].min(1) == region
                np.add.at(links, q[mine], mult[i[mine]])
                best = _join(best, q, len(asking) + i)
        names = np.concatenate([asking, node])
        out = np.flatnonzero(np.concatenate([links > 0, np.zeros(len(node), bool)]) | (best != np.arange(len(names))))
        result = pa.table({"a": pa.array(names[out]), "b": pa.array(names[best[out]]), "links": pa.array(np.concatenate([links, np.zeros(len(node), np.int64)])[out])})
        release()
        return result

    return run


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that the labels and the given edges connect each index with."""
    label = label.copy()
    while True:
        la, lb = label[a], label[b]
        low = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, low)
        np.minimum.at(new, lb, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sharing(x: np.ndarray, middle: np.ndarray, take: int, threshold: float) -> float:
    """The share of vectors that have a cluster in common with a partner put at the threshold from them in a random direction."""
    away = np.random.default_rng(1).normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    near = lambda v: np.sort(np.argpartition(-(v @ middle.T), take - 1, axis=1)[:, :take], axis=1)
    a, b = near(x), near(threshold * x + np.sqrt(1 - threshold**2) * away)
    return float((a[:, :, None] == b[:, None, :]).any((1, 2)).mean()) if len(x) else 1.0


def _links(classes: DataFrame, dim: int, n: int, overlap: int, threshold: float) -> tuple[DataFrame, float]:
    """(a, b, links) of the classes (node, v, n) by one build and search, and what share of partners at the threshold would share a cluster."""
    spark = classes.sparkSession
    k = max(1, min(MAX_SHARDS, -(-n // PER_SHARD)))
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(min(SAMPLE, max(20_000, 20 * k))).select("v").toArrow()
    x = _matrix(sample.column("v"))
    middle = centroids(x, min(k, len(x)), apart=threshold)
    expected = sharing(x[:AUDIT], middle, min(overlap, len(middle)), threshold)
    del sample, x
    shared = spark.sparkContext.broadcast(middle)
    take = min(overlap, len(middle))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"))
                near = np.concatenate([np.argpartition(-(v[i : i + 1000] @ shared.value.T), take - 1, axis=1)[:, :take] for i in range(0, len(v), 1000)])
                clusters = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, take, dtype=np.int32)), pa.array(near.ravel().astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*batch.columns, clusters], names=[*batch.schema.names, "clusters"])

    placed = stored(classes.mapInArrow(assign, "node long, v array<double>, n long, clusters array<long>"), "placed")
    each = placed.withColumn("cluster", F.explode("clusters"))
    sizes = each.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).select("cluster", F.ceil(F.col("size") / CAP).cast("int").alias("blocks"))
    sizes = F.broadcast(cut(sizes))  # at most MAX_SHARDS rows
    dealt = each.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    graph = dealt.select("cluster", "block", "node", "v").groupBy("cluster", "block").applyInArrow(_graph, "node long, near array<long>, cosine array<double>")
    edges = stored(graph, "graph")
    # two links of one vector have at least this cosine
    least = 2 * threshold**2 - 1
    member = dealt.select("node", (F.shiftleft("cluster", BLOCK_BITS) + F.col("block")).alias("region"))
    strong = edges.select(F.col("node").alias("of"), F.explode(F.arrays_zip("near", "cosine")).alias("e")).where(F.col("e.cosine") >= least).select("of", F.col("e.near").alias("node")).distinct()
    beyond = member.withColumnRenamed("node", "of").join(strong, "of").select("node", "region").distinct().join(member, ["node", "region"], "left_anti")
    beyond = cut(beyond)
    about = member.union(beyond).groupBy("node").agg(F.collect_set("region").alias("present")).join(edges.groupBy("node").agg(F.flatten(F.collect_list("near")).alias("near")), "node")
    kept = ["cluster", "node", "v", "n", "clusters", "near", "present"]
    turns = lambda c: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(c)
    rows = dealt.join(about, "node")
    asks = rows.select(*kept, F.col("block").alias("i"), turns("j"), "block").select(*kept, "i", "j", (F.col("j") == F.col("block")).alias("as_index"), F.lit(True).alias("as_query"))
    indexed = rows.where("blocks > 1").select(*kept, turns("i"), F.col("block").alias("j"), "block").where("i <> block").select(*kept, "i", "j", F.lit(True).alias("as_index"), F.lit(False).alias("as_query"))
    outer = beyond.join(placed, "node").join(about, "node").withColumns({"cluster": F.shiftright("region", BLOCK_BITS), "j": F.col("region").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")}).join(sizes, "cluster")
    outer = outer.select(*kept, turns("i"), "j", F.lit(True).alias("as_index"), F.lit(False).alias("as_query"))
    return asks.union(indexed).union(outer).groupBy("cluster", "i", "j").applyInArrow(_search(threshold), "a long, b long, links long"), expected


def _against(classes: DataFrame, block: pa.Table, threshold: float) -> DataFrame:
    """(a, b, links) of all classes against those of a block: the links of each class, and edges that connect what links connect."""
    shared = classes.sparkSession.sparkContext.broadcast((block.column("node").to_numpy(), _matrix(block.column("v")), block.column("n").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda a, b, links: pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(links)], names=["a", "b", "links"])
        node, x, mult = shared.value
        label = np.arange(len(node))
        for batch in batches:
            if not batch.num_rows:
                continue
            own, q = batch.column("node").to_numpy(), _matrix(batch.column("v"))
            for lo in range(0, len(own), 128):
                qi, ni = np.nonzero(q[lo : lo + 128] @ x.T >= threshold)
                other = own[lo + qi] != node[ni]
                qi, ni = qi[other], ni[other]
                if len(qi):
                    row, first, of = np.unique(qi, return_index=True, return_inverse=True)
                    label = _join(label, ni[first][of], ni)
                    yield out(own[lo + row], node[ni[first]], np.bincount(of, mult[ni]).astype(np.int64))
        moved = np.flatnonzero(label != np.arange(len(node)))
        yield out(node[moved], node[label[moved]], np.zeros(len(moved), np.int64))

    return cut(classes.select("node", "v").mapInArrow(run, "a long, b long, links long"))


def _exact(classes: DataFrame, dim: int, n: int, threshold: float) -> DataFrame:
    """(a, b, links) of the classes by comparing all with all, a block at a time."""
    turns = max(1, -(-n * dim // BLOCK))
    found = None
    for t in range(turns):
        block = classes.where(F.pmod(F.xxhash64("node", F.lit(11)), F.lit(turns)) == t).select("node", "v", "n").toArrow()
        if block.num_rows:
            rows = _against(classes, block, threshold)
            found = rows if found is None else found.union(rows)
    return found


def audit(classes: DataFrame, found: DataFrame, threshold: float = THRESHOLD, n: int = AUDIT) -> tuple[float, int]:
    """(recall, classes with links) of ``n`` classes taken by hash, against all classes: the mean of the shares of their links that were
    found, less two standard errors unless these are all classes. Links are verified, so a number of links that is not too high is of right ones; a
    number that is too high is an error."""
    spark = classes.sparkSession
    chosen = classes.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(n).select("node", "v").toArrow()
    if not chosen.num_rows:
        return 1.0, 0
    shared = spark.sparkContext.broadcast((chosen.column("node").to_numpy(), _matrix(chosen.column("v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                node, q, mult = batch.column("node").to_numpy(), _matrix(batch.column("v")), batch.column("n").to_numpy()
                for lo in range(0, len(node), 512):
                    s = q[lo : lo + 512] @ x.T >= threshold
                    s &= node[lo : lo + 512, None] != ids[None]
                    total += mult[lo : lo + 512] @ s
        some = total > 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(total[some])], names=["node", "links"])

    there = classes.select("node", "v", "n").mapInArrow(run, "node long, links long").groupBy("node").agg(F.sum("links").alias("there"))
    share = F.coalesce("links", F.lit(0)) / F.col("there")
    r = there.join(found, "node", "left").agg(F.avg(share).alias("mean"), F.coalesce(F.stddev_pop(share), F.lit(0.0)).alias("sd"), F.count(F.lit(1)).alias("linked"), F.max(share).alias("top")).first()
    if r["linked"] and r["top"] > 1:
        raise RuntimeError("a link was counted twice")
    if not r["linked"]:
        return 1.0, 0
    return r["mean"] - (2 * r["sd"] / r["linked"] ** 0.5 if chosen.num_rows == n else 0), r["linked"]


def _all_links(classes: DataFrame, dim: int, n: int, overlap: int, threshold: float, least_recall: float) -> DataFrame:
    """(a, b, links) with the recall that is asked for."""
    while True:
        found, expected = _links(classes, dim, n, overlap, threshold)
        found = cut(found)
        recall, linked = audit(classes, found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), threshold)
        if linked < LEAST_LINKED and n > AUDIT:
            recall = min(recall, expected) if linked else expected
        if recall >= least_recall:
            return found
        overlap *= 2
        # a graph compares some PER_SHARD vectors in each cluster, for lists and for the search
        if 4 * overlap * PER_SHARD >= n:
            return _exact(classes, dim, n, threshold)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, overlap: int = 2, least_recall: float = 0.95) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different lengths are not
    compared. Repeated ids are vectors of their own; equal vectors link. A null id stands for itself if its vector links with
    nothing. Other columns are ignored; an empty table gives an empty result."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("raw"))
    rows = stored(given.mapInArrow(_normalised, "id long, v array<double>"), "vectors")
    grouped = rows.where("v is not null").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    # a class is named by the smallest id of its vectors; repeated or null ids can be no names
    classes = stored(grouped.withColumn("node", F.xxhash64("v")), "classes")
    edges = links = None
    dims = [(r[0], r[1]) for r in classes.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).collect()]
    for dim, n in sorted(dims):
        own = classes.where(F.size("v") == dim).select("node", "v", "n")
        found = _all_links(own, dim, n, overlap, threshold, least_recall)
        sums = cut(found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")))
        edges = found.select("a", "b") if edges is None else edges.union(found.select("a", "b"))
        links = sums if links is None else links.union(sums)
    if edges is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    parents = components(edges)
    named = classes.select("node", "least", "n").join(parents, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    about = named.join(least, "component").join(links, "node", "left").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    about = cut(about)
    return rows.withColumn("node", F.when(F.col("v").isNotNull(), F.xxhash64("v"))).select("id", "node").join(about, "node", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept")
    )


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
n AS (SELECT x, count(*) AS n FROM e GROUP BY x), m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.y, vec_id)) AS component_id, least(vec_id, coalesce(m.y, vec_id)) = vec_id AS kept
FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN m ON m.x = vec_id
"""
