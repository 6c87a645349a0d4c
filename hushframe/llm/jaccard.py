"""N-gram Jaccard join with PartEnum signatures.

Texts become sets of word shingles; equal sets are one node, so copies cost nothing. Sizes are split into bands. Two
sets with Jaccard similarity of 85 % or more have sizes within 85 % of each other, so a set signs in its own band and in those that
larger partners may be in. In a band whose largest size is r, similar sets differ in k = floor(2 r * 15 / 185) shingles
at most. The shingle domain is hashed into n1 partitions, each of n2 = 3 parts. With n1 = ceil((k + 1) / 2), some partition holds one
of the differences at most, and two of its three parts are equal: each partition gives three signatures, one for each pair
of parts. So similar sets always share a signature. Parts that are empty in both count as equal, which says little; so there are 6 %
more partitions than needed, and as many more with one difference at most. A set with no more partitions than these spare ones that
have two empty parts leaves the signatures of empty parts out: it shares another one. Only the rare other sets sign them.

Signatures meet without pairs: a task joins the sets of a signature to the smallest of them, sends that one on, and the shuffle
does the same with the tasks' smallest. Each signature's members thus form a star, of as many edges as members. Stars'
edges are verified on whole texts. Where an edge of a signature's star fails and its ends are not connected otherwise,
all its members of different components are compared too, if there are more than these two, so no link between components is lost. Before texts are
fetched, a count sketch gives an upper bound of each pair's intersection; what it excludes cannot be similar.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_place, bit_table, bits_at, components, cut, keyed, parts, stored, tidy, without
from .tokens import LOWER, NON_SPACE, buffers, hashes, mix, shingles, slices, words

SIZE = 4
PERCENT = 85
#: The same for the pipeline's stage.
STAGE_SIZE = 5
STAGE_PERCENT = 85
SKETCH = 512
#: Members of a signature that one task compares; more are dealt into blocks, and pairs of blocks are compared.
GROUP = 2000
#: A node's smallest open signatures that go with it, by which a pair that meets in several of them comes out of the smallest.
OWNERS = 16
#: Passes over the signatures: each deals out its share of them, so the shuffle's files take that share of the room.
TURNS = 2
#: Signatures that a task holds to join equal ones before the shuffle; it bounds memory, not results.
HELD = 800_000
_U = np.uint64
_I64 = np.int64
_LAST = (1 << 63) - 1


def sets(texts: pa.Array, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of each text, sorted."""
    data, at = buffers(texts)
    low = LOWER[data]
    starts, ends, first = words(low, at, NON_SPACE)
    h, text = shingles(hashes(low, starts, ends), first, size)
    # each text's shingles stand together; those of short texts, one each, come last
    counts = np.diff(first)
    bounds = np.concatenate([[0], np.cumsum(np.maximum(0, counts - size + 1))])
    for i, k in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if k - i > 1:
            h[i:k].sort()
    if bounds[-1] < len(h):
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])
        h, text = h[new], text[new]
    return text, h


def _sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by (sorted) text."""
    run = np.concatenate([[_U(0)], np.cumsum(values, dtype=_U)])
    at = np.searchsorted(text, np.arange(n + 1))
    return run[at[1:]] - run[at[:-1]]


def node_ids(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, number of shingles) of each text; node 0 means no shingle."""
    count = np.bincount(text, minlength=n)
    node = mix(_sums(text, mix(h), n) + count.astype(_U))
    node[count == 0] = 0
    return node.view(_I64), count


def sketches(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Numbers of shingles in each of the sketch's buckets."""
    cell = text * SKETCH + (mix(h ^ _U(0x5851F42D4C957F2D)) % _U(SKETCH)).astype(_I64)
    return np.minimum(np.bincount(cell, minlength=n * SKETCH), 255).astype(np.uint8).reshape(n, SKETCH)


def may_be_similar(x: np.ndarray, y: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether sketches allow pairs of sets of n shingles together to be similar. A full bucket bounds nothing."""
    least = np.minimum(x, y)
    most = np.where((least == 255).any(1), n, least.sum(1, dtype=_I64))
    return 100 * most >= percent * (n - most)


def bands(most: int) -> list[int]:
    """Smallest sizes of the bands up to size ``most``; the last entry is beyond it."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * 3 // 2 + 1)
    return edges


def _band_signatures(local: np.ndarray, r: np.ndarray, n1: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, text, empty) of texts in one band each: ``local`` and ``r`` are their shingles' texts and random numbers, ``n1`` the
    numbers of partitions. ``empty``: the signature's parts hold no shingle."""
    first = np.concatenate([[0], np.cumsum(n1)])
    partition = ((r >> _U(32)) * n1[local].astype(_U) >> _U(32)).astype(_I64)
    cell = (first[local] + partition) * 3 + (r % _U(3)).astype(_I64)
    sums = np.zeros(int(first[-1]) * 3, _U)
    np.add.at(sums, cell, mix(r + _U(77)))
    sums = sums.reshape(-1, 3)
    held = np.bincount(cell, minlength=int(first[-1]) * 3).reshape(-1, 3) > 0
    owner = np.repeat(np.arange(len(n1)), n1)
    tag = mix((np.arange(len(owner)) - first[owner]).astype(_U) + band[owner].astype(_U) * _U(1 << 40))
    out = [mix(tag + sums[:, x] * _U(0x9E3779B97F4A7C15) + sums[:, y] * _U(0xD1342543DE82EF95) + _U(i + 1)) for i, (x, y) in enumerate(_PARTS)]
    return np.stack(out, 1).ravel(), np.repeat(owner, 3), np.stack([~(held[:, x] | held[:, y]) for x, y in _PARTS], 1).ravel()


_PARTS = ((1, 2), (0, 2), (0, 1))


def signatures(text: np.ndarray, h: np.ndarray, node: np.ndarray, count: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(signature, node) of all texts with shingles; equal sets are expected once."""
    if not len(h):
        return np.zeros(0, _U), np.zeros(0, _I64)
    edges = np.array(bands(int(count.max()) * 100 // percent + 1))
    own = np.searchsorted(edges, count, "right") - 1
    last = np.searchsorted(edges, count * 100 // percent, "right") - 1
    out_s, out_n = [], []
    base = mix(h)
    starts = np.concatenate([[0], np.cumsum(count)])

    for step in range(int((last - own)[count > 0].max()) + 1):
        band = np.minimum(own + step, last)
        k = 2 * (edges[band + 1] - 1) * (100 - percent) // (100 + percent)
        chosen = np.flatnonzero((count > 0) & (own + step <= last) & (k > 0))
        if not len(chosen):
            continue
        need = (k[chosen] + 2) // 2
        spare = -(-need * 6 // 100)
        size = count[chosen]
        local = np.repeat(np.arange(len(chosen)), size)
        at = np.arange(len(local)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[chosen], size)
        r = mix(base[at] + band[chosen][local].astype(_U) * _U(0x9E3779B97F4A7C15))
        sig, owner, empty = _band_signatures(local, r, need + spare, band[chosen])
        # partitions with a signature of empty parts, by text
        holes = np.bincount(owner[::3][empty.reshape(-1, 3).any(1)], minlength=len(chosen))
        kept = ~empty | (holes > spare)[owner]
        out_s.append(sig[kept])
        out_n.append(node[chosen][owner[kept]])
    if not out_s:
        return np.zeros(0, _U), np.zeros(0, _I64)
    return np.concatenate(out_s), np.concatenate(out_n)


def _stars(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, smallest node, node) for each signature and node, by signature."""
    if not len(sig):
        return sig, node, node
    order = np.argsort(sig)
    sig, node = sig[order], node[order]
    at = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    return sig, np.repeat(np.minimum.reduceat(node, at), np.diff(np.append(at, len(sig)))), node


def star_edges(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, turn: int = 0, turns: int = 1) -> DataFrame:
    """(sig, a, b): the star of every signature that two nodes or more share, of ``docs`` (text); of one turn's signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen = np.zeros(0, _I64)

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            sig, a, b = _stars(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            held.clear()
            for i in range(0, len(sig), 100_000):
                j = slice(i, i + 100_000)
                # the smallest itself has no b: it takes no room, and most signatures are of one set
                yield pa.RecordBatch.from_arrays([pa.array(sig[j].view(_I64)), pa.array(a[j]), pa.array(b[j], mask=a[j] == b[j])], names=["sig", "a", "b"])

        n = 0
        for whole in batches:
            for batch in slices(whole, "text"):
                text, h = sets(batch.column("text"), size)
                node, count = node_ids(text, h, batch.num_rows)
                # equal sets once: the first of this slice that earlier slices did not have
                _, first = np.unique(node, return_index=True)
                fresh = np.zeros(len(node), bool)
                fresh[first] = True
                fresh &= (node != 0) & ~np.isin(node, seen)
                seen = np.concatenate([seen, node[fresh]])
                kept = fresh[text]
                renamed = np.cumsum(fresh) - 1
                sig, who = signatures(renamed[text[kept]], h[kept], node[fresh], count[fresh], percent)
                if turns > 1:
                    mine = sig % _U(turns) == turn
                    sig, who = sig[mine], who[mine]
                held.append((sig, who))
                n += len(sig)
                if n > HELD:
                    yield from flush()
                    n = 0
        yield from flush()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead_sig, lead = None, None
        for batch in batches:
            sig, a, b = (batch.column(c).fill_null(0).to_numpy() for c in ("sig", "a", "b"))
            if not len(sig):
                continue
            star = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            s, m = sig[star], a[star]
            if len(s):
                # rows come sorted by signature and node: the first of a run is the smallest, also across batches
                new = np.concatenate([[s[0] != lead_sig], s[1:] != s[:-1]])
                at = np.maximum.accumulate(np.where(new, np.arange(len(s)), -1))
                head = np.where(at >= 0, m[np.maximum(at, 0)], lead if lead is not None else 0)
                lead_sig, lead = s[-1], head[-1]
                out = head != m
            else:
                head, out = m, np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s[out], sig[~star]])), pa.array(np.concatenate([head[out], a[~star]])), pa.array(np.concatenate([m[out], b[~star]]))], names=["sig", "a", "b"])

    rows = docs.select("text").mapInArrow(run, "sig long, a long, b long")
    # a signature's smallest node goes by the signature, its edges anywhere
    by = F.when(F.col("b").isNull(), F.col("sig")).otherwise(F.xxhash64("sig", "b"))
    dealt = rows.repartition(parts(docs.sparkSession), by).sortWithinPartitions("sig", "a", "b")
    return dealt.mapInArrow(join, "sig long, a long, b long")


def nodes_of(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_shingles, node, sketch) of every row; node 0 stands for no shingle."""
    given = docs.select("doc_id", "text")
    id_type = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                text, h = sets(batch.column("text"), size)
                node, count = node_ids(text, h, n)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH), n, [None, pa.py_buffer(sketches(text, h, n).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), pa.array(node), sketch], names=["doc_id", "n_shingles", "node", "sketch"])

    return given.mapInArrow(run, f"doc_id {id_type}, n_shingles long, node long, sketch binary")


def _possible(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches do not exclude the similarity."""
    side = lambda c: sized.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(f"sketch_{c}").to_pylist()), np.uint8).reshape(-1, SKETCH) for c in "ab")
            n = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(may_be_similar(x, y, n, percent)))

    return both.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")


def _cross(who: DataFrame, sized: DataFrame, percent: int, turn: int = 0, turns: int = 1) -> DataFrame:
    """Pairs (a, b), a < b, of members (sig, node, part) of one signature in different parts that sizes and sketches do not exclude; of one turn's signatures.

    Members of a signature are compared in one task without making rows of pairs; only what may be similar comes out. Similar sets share
    many signatures. Each member knows its ``OWNERS`` smallest ones; a pair that is seen to share a smaller signature than the
    present one is left to that one, so it comes out of one signature or few."""
    spark = who.sparkSession
    low = who.groupBy("node").agg(F.array_sort(F.collect_list("sig")).alias("all")).select("node", F.slice(F.concat("all", F.array_repeat(F.lit(_LAST), OWNERS)), 1, OWNERS).alias("low"))
    about = low.join(sized.select(F.col("node").alias("nd"), "n", "sketch"), F.col("node") == F.col("nd")).drop("nd")
    who = who.where(F.pmod("sig", F.lit(turns)) == turn)
    sizes = who.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP).select(F.col("sig").alias("large"), F.ceil(F.col("size") / GROUP).cast("int").alias("k"))
    dealt = who.join(sizes, F.col("sig") == F.col("large"), "left").withColumn("k", F.coalesce("k", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    blocks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "part")
    # sketches come last, so that they are dealt out once
    rows = blocks.join(about, "node").select("sig", "i", "j", "block", "node", "part", "n", "sketch", "low")

    def pairs(sig: int, group: tuple[np.ndarray, ...]) -> np.ndarray:
        i, j, block, node, part, n, sketch, low = group
        out = []
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in left:
            y = right[(part[right] != part[x]) & (100 * np.minimum(n[right], n[x]) >= percent * np.maximum(n[right], n[x]))]
            if i[0] == j[0]:
                y = y[y > x]
            if len(y):
                y = y[may_be_similar(sketch[x][None], sketch[y], n[x] + n[y], percent)]
                y = y[~np.isin(low[y], low[x][low[x] < sig]).any(1)]
                out.append(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1))
        return np.concatenate(out) if out else np.zeros((0, 2), _I64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        found: list[np.ndarray] = []

        def end() -> None:
            if held and sum(len(x[0]) for x in held) > 1:
                found.append(pairs(key[0], tuple(np.concatenate(c) for c in zip(*held, strict=True))))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            sig, *rest = (batch.column(c).to_numpy() for c in ("sig", "i", "j", "block", "node", "part", "n"))
            rest.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH))
            rest.append(batch.column("low").flatten().to_numpy().reshape(-1, OWNERS))
            new = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (rest[0][1:] != rest[0][:-1]) | (rest[1][1:] != rest[1][:-1])]))
            for lo, hi in zip(new, [*new[1:], len(sig)], strict=True):
                now = (sig[lo], rest[0][lo], rest[1][lo])
                if now != key:
                    end()
                    key = now
                held.append(tuple(c[lo:hi] for c in rest))
            if sum(map(len, found)) > 100_000:
                found[:] = [np.unique(np.concatenate(found), axis=0)]
        end()
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), _I64)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    dealt = rows.repartition(parts(spark), "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _texts(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, text) of the wanted nodes (node, doc_id), one text each. A fixed-size bit table spares most other rows the join."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bit_table(wanted.select(bit_place("doc_id").alias("p"))))
    given = docs.select("doc_id", "text", bit_place("doc_id").alias("p"))
    id_type = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bits_at(shared.value, batch.column("p").to_numpy())
            for part in slices(batch.filter(pa.array(hit)).select(["doc_id", "text"]), "text"):
                text, h = sets(part.column("text"), size)
                node, _ = node_ids(text, h, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(node)], names=["doc_id", "text", "node"])

    some = given.mapInArrow(run, f"doc_id {id_type}, text string, node long")
    return some.join(wanted.withColumnsRenamed({"doc_id": "id", "node": "nd"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("nd"))).groupBy("node").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, docs: DataFrame, sized: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole texts."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = cut(ends.join(sized.select("node", "doc_id"), "node"))
    texts = cut(_texts(docs, wanted, size))
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_a", 1 << 20):
                n = batch.num_rows
                (ta, ha), (tb, hb) = (sets(batch.column(c), size) for c in ("text_a", "text_b"))
                t, h = np.concatenate([ta, tb]), np.concatenate([ha, hb])
                order = np.lexsort((h, t))
                t, h = t[order], h[order]
                same = np.flatnonzero((t[1:] == t[:-1]) & (h[1:] == h[:-1]))
                common = np.bincount(t[same], minlength=n)
                union = np.bincount(t, minlength=n) - common
                yield batch.select(["a", "b"]).filter(pa.array(100 * common >= percent * union))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links reach. Null, empty and blank texts have no shingle and link with nothing,
    and so stand for themselves. Rows of one text link whatever their ids; repeated rows are rows of their own. Null ids link as others
    do and never are the smallest one, unless there is no other. Other columns are ignored."""
    docs, spark = docs.select("doc_id", "text"), docs.sparkSession
    rows = stored(nodes_of(docs, size), "nodes")
    sized = cut(rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    edges = stored(star_edges(docs, size, percent, 0, TURNS), "stars")
    for turn in range(1, TURNS):
        edges = edges.union(stored(star_edges(docs, size, percent, turn, TURNS), "stars"))
    tidy(spark)
    pairs = cut(_possible(edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).select("a", "b"), sized, percent))
    links = cut(_verified(pairs, docs, sized, size, percent))
    parents = components(links)

    def labelled(df: DataFrame, *ends: str) -> DataFrame:
        for c in ends:
            df = df.join(parents.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")), c, "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c))
        return df

    # signatures whose stars hold several components: every two members of different components; where there is one edge, that pair is known
    several = labelled(edges, "a", "b").groupBy("sig").agg(F.count(F.lit(1)).alias("edges"), F.max(F.col("of_a") != F.col("of_b")).alias("open"))
    open_ = cut(several.where("edges > 1 AND open").select("sig"))
    held = edges.join(open_, "sig")
    who = cut(labelled(held.select("sig", F.col("a").alias("x")).union(held.select("sig", "b")).distinct(), "x").select("sig", F.col("x").alias("node"), F.col("of_x").alias("part")))
    rest = cut(_cross(who, sized, percent, 0, TURNS))
    for turn in range(1, TURNS):
        tidy(spark)
        rest = rest.union(cut(_cross(who, sized, percent, turn, TURNS)))
    rest = cut(rest.distinct().join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = cut(_verified(rest, docs, sized, size, percent))
        if not more.isEmpty():
            links = cut(links.union(more))
            parents = components(links)
    # each node's component, named by its smallest doc_id
    named = sized.select("node", "doc_id").join(parents, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = cut(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    final = cut(named.join(least, "component").select(F.col("node").alias("nd"), "component_id"))
    return rows.join(final, F.col("node") == F.col("nd"), "left").select("doc_id", "n_shingles", F.when(F.col("node") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group, by five-word shingles and a similarity of 85 % or more, one row stays, that of the smallest id (a null one comes
    last), and those that link with nothing.

    Rows go by themselves: one that shares its id with a row that goes stays, and of repeated rows one stays."""
    rows = keyed(docs)
    found = join(rows.select(F.col("_hf_row").alias("doc_id"), "text"), STAGE_SIZE, STAGE_PERCENT).select(F.col("doc_id").alias("row"), "component_id")
    named = found.join(rows.select("_hf_row", "doc_id"), F.col("row") == F.col("_hf_row")).select("row", "component_id", "doc_id")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))["row"].alias("_hf_row"))
    return without(rows, named.select("row").join(stays, F.col("row") == F.col("_hf_row"), "left_anti"), "_hf_row").drop("_hf_row")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.y, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = w.doc_id
"""
