"""Benchmark decontamination with a distributed positional inverted index.

Index. Documents are read in segments of about ``segment_bytes`` of text. A segment numbers its words 0, 1, ... over all its
documents; for each word (as a 64-bit hash) it stores the postings, the sorted numbers, as variable-length gaps. A second kind
of row has a segment's documents with their first word's number. Both go to one table, which searches share; building
it needs no shuffle, as segments are indexed where they are read.

Search. Every ten consecutive words of a benchmark item are a window (an item of fewer words is one window). Words' total counts
come from the index. The postings of each window's ``rarest`` words are fetched first. A segment looks at the windows whose rarest word it has, takes
that word's places, shifted, as candidates, and keeps those at which the next rarer words stand too. Only for segments and windows with any left are
the other words' postings fetched and looked up, so a hit has all the window's words at their places. So the cost goes with the places of rare words, not
with the number of windows. Items come to the driver and are searched in blocks of bounded size; the index is not.

Proximity. For an item's rarest words, wherever the rarest of them stands, the others are looked for within some words of it.

Words: A-Z is lower-cased; words are runs of a-z, 0-9 and of anything that is not ASCII.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keyed, stored, without
from .tokens import ALNUM, LOWER, buffers, hashes, release, slices, words

WINDOW = 10
RAREST = 4
SEGMENT_BYTES = 4 << 20
#: Characters of benchmark text that one pass over the index searches (one item at least).
BLOCK_CHARS = 2 << 20
#: Candidates that a segment looks at together.
TOGETHER = 1 << 20
#: Words of an item that proximity looks for, and how far they may stand from the rarest.
NEAR_WORDS = 3
WITHIN = 10
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_I64 = np.int64


def pack_gaps(starts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each list of sorted numbers (lists begin at ``starts``) as 7-bit groups of its gaps: (bytes, byte bounds of the lists)."""
    gaps = np.diff(numbers, prepend=0)
    gaps[starts] = numbers[starts]
    size = np.ones(len(gaps), _I64)
    for k in range(1, 5):
        size += gaps >= 1 << (7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        has = size > k
        at = ends[has] - size[has] + k
        out[at] = (gaps[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, np.append(ends[starts] - size[starts], len(out))


def unpack_gaps(data: bytes | np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
    """The numbers of one packed list, or of several one after another, with their lengths."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    if not len(raw):
        return np.zeros(0, _I64)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(first, last - first + 1)
    gaps = np.add.reduceat((raw & 127).astype(_I64) << (7 * place), first)
    run = np.cumsum(gaps)
    if sizes is None:
        return run
    begin = np.cumsum(sizes) - sizes
    return run - np.repeat(run[begin] - gaps[begin], sizes)


class Lists:
    """A segment's postings of some words, for looking up many places at once."""

    def __init__(self, table: pa.Table) -> None:
        table = table.filter(pa.compute.is_valid(table.column("word"))).combine_chunks()
        word, size = table.column("word").to_numpy(), table.column("n").to_numpy()
        order = np.argsort(word)
        packed = table.column("postings").take(pa.array(order)).cast(pa.large_binary()).combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) and packed.num_chunks == 1 else packed
        self.word, self.size = word[order], size[order]
        if len(word):
            _, offsets, data = packed.buffers()
            at = np.frombuffer(offsets, _I64, len(word) + 1, packed.offset * 8)
            self.place = unpack_gaps(np.frombuffer(data, np.uint8)[at[0] : at[-1]], self.size)
        else:
            self.place = np.zeros(0, _I64)
        self.begin = np.cumsum(self.size) - self.size
        self.key = np.repeat(np.arange(len(word)), self.size) << 40 | self.place

    def rank(self, words: np.ndarray) -> np.ndarray:
        """The words' places in this table, -1 for those that it has not."""
        at = np.searchsorted(self.word, words)
        at[at == len(self.word)] = 0
        return np.where(self.word[at] == words, at, -1) if len(self.word) else np.full(len(words), -1)

    def has(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the words of some ranks stand at the places."""
        key = rank << 40 | place
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        return (rank >= 0) & (place >= 0) & (self.key[at] == key) if len(self.key) else np.zeros(len(rank), bool)

    def near(self, rank: np.ndarray, place: np.ndarray, within: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether the words of some ranks stand within some words of the places, at lo or later and before hi."""
        if not len(self.key):
            return np.zeros(len(rank), bool)
        key = rank << 40 | np.maximum(place - within, lo)
        at = np.searchsorted(self.key, key)
        here = at < len(self.key)
        at[~here] = 0
        return (rank >= 0) & here & (self.key[at] >> 40 == rank) & (self.place[at] <= np.minimum(place + within, hi - 1))

    def starts(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index into ``words``, place) of every place of the words, some at a time."""
        rank = self.rank(words)
        which = np.flatnonzero(rank >= 0)
        size = self.size[rank[which]]
        total = np.cumsum(size)
        i = 0
        while i < len(which):
            j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + TOGETHER, "right")))
            n = size[i:j]
            at = np.repeat(self.begin[rank[which[i:j]]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(which[i:j], n), self.place[at]
            i = j


def build(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text): postings rows (segment, word, n, postings) and document rows (segment, row, doc_id, at, n).

    Null and empty texts have no words but are documents; repeated rows are documents of their own."""
    given = docs.select("doc_id", "text", F.spark_partition_id().cast("long").alias("part"))
    id_type = given.schema["doc_id"].dataType.simpleString()
    names = ["segment", "word", "n", "postings", "doc_id", "at", "row"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = made = 0

        def segment() -> Iterator[pa.RecordBatch]:
            nonlocal made, size
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            name = (whole.column("part")[0].as_py() << 24) + made
            made, size = made + 1, 0
            data, at = buffers(whole.column("text"))
            low = LOWER[data]
            starts, ends, first = words(low, at, ALNUM)
            h = hashes(low, starts, ends).view(_I64)
            order = np.argsort(h, kind="stable")
            sorted_h = h[order]
            new = np.flatnonzero(np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])) if len(h) else np.zeros(0, _I64)
            packed, bounds = pack_gaps(new, order) if len(h) else (np.zeros(0, np.uint8), np.zeros(1, _I64))
            n, rows = len(new), whole.num_rows
            lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds.astype(_I64)), pa.py_buffer(packed)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(sorted_h[new]), pa.array(np.diff(np.append(new, len(h)))), lists, pa.nulls(n, whole.column("doc_id").type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, name)), pa.nulls(rows, pa.int64()), pa.array(np.diff(first)), pa.nulls(rows, pa.binary()), whole.column("doc_id"), pa.array(first[:-1]), pa.array(np.arange(rows))], names=names)

        for whole in batches:
            for batch in slices(whole, "text", segment_bytes):
                held.append(batch)
                size += batch.column("text").nbytes
                if size >= segment_bytes:
                    yield from segment()
        if held:
            yield from segment()
        release()

    # a segment is named by its task's partition, which a recomputation keeps
    return given.mapInArrow(run, f"segment long, word long, n long, postings binary, doc_id {id_type}, at long, row long")


def phrases(items: list[tuple], window: int = WINDOW) -> dict[tuple[int, ...], list]:
    """The different windows of (item_id, text) rows, as word hashes, each with its items' ids."""
    texts = [_WORD.findall((text or "").translate(_TO_LOWER)) for _, text in items]
    distinct = sorted({w for t in texts for w in t})
    data, at = buffers(pa.array(distinct, pa.string()))
    code = dict(zip(distinct, hashes(data, at[:-1], at[1:]).view(_I64).tolist(), strict=True))
    found: dict[tuple[int, ...], list] = {}
    for (item, _), t in zip(items, texts, strict=True):
        h = [code[w] for w in t]
        for j in range(max(1, len(h) - window + 1) if h else 0):
            owners = found.setdefault(tuple(h[j : j + window]), [])
            if not owners or owners[-1] != item:
                owners.append(item)
    return found


class Windows:
    """Windows as arrays: their words, the words' places in order of rarity, and the items that have them."""

    def __init__(self, found: dict[tuple[int, ...], list], total: dict[int, int], window: int) -> None:
        kept = [(word, owners) for word, owners in found.items() if all(w in total for w in word)]
        self.size = np.array([len(word) for word, _ in kept], _I64)
        self.word = np.zeros((len(kept), window), _I64)
        often = np.full((len(kept), window), np.iinfo(_I64).max)
        for i, (word, _) in enumerate(kept):
            self.word[i, : len(word)] = word
            often[i, : len(word)] = [total[w] for w in word]
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int16)
        self.items = sorted({str(x) for _, owners in kept for x in owners if x is not None})
        place = {x: i for i, x in enumerate(self.items)}
        listed = [[place[str(x)] for x in owners if x is not None] for _, owners in kept]
        self.bounds = np.cumsum([0, *map(len, listed)])
        self.owner = np.array([x for one in listed for x in one], np.int32)

    def terms(self, lo: int, hi: int) -> np.ndarray:
        """The words that stand lo-th to hi-th by rarity in any window."""
        cols = [self.word[np.flatnonzero(self.size > j), self.order[self.size > j, j]] for j in range(lo, min(hi, self.word.shape[1]))]
        return np.unique(np.concatenate(cols)) if cols else np.zeros(0, _I64)

    def at(self, lists: Lists, window: np.ndarray, start: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The (window, start) whose lo-th to hi-th rarest words stand at their places."""
        for j in range(lo, min(hi, self.word.shape[1])):
            p = self.order[window, j]
            ok = (self.size[window] <= j) | lists.has(lists.rank(self.word[window, p]), start + p)
            window, start = window[ok], start[ok]
        return window, start


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, as disjoint ones."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    at = np.flatnonzero(new)
    return start[at], end[np.append(at[1:], len(end)) - 1]


def search(index: DataFrame, items: list[tuple], window: int = WINDOW, rarest: int = RAREST) -> DataFrame | None:
    """(segment, row, from, to, items): for each document with any, the words inside occurrences of windows of a block of
    (item_id, text) rows, as disjoint intervals, and the items that occur. None if no item has a word."""
    spark = index.sparkSession
    found = phrases(items, window)
    if not found:
        return None
    windows = Windows(found, counts(index, sorted({h for word in found for h in word})), window)
    del found
    shared = spark.sparkContext.broadcast(windows)
    terms = spark.createDataFrame(pa.table({"word": windows.terms(0, rarest)}))

    def near(key: tuple, table: pa.Table) -> pa.Table:
        lists, w = Lists(table), shared.value
        rows = np.arange(len(w.size))
        none = [np.zeros(0, _I64)]
        number, start = [], []
        for i, place in lists.starts(w.word[rows, w.order[:, 0]]):
            n, s = w.at(lists, i, place - w.order[i, 0], 1, rarest)
            number.append(n[s >= 0])
            start.append(s[s >= 0])
        number, start = np.concatenate(number or none), np.concatenate(start or none)
        del lists
        release()
        return pa.table({"segment": pa.array(np.full(len(number), key[0].as_py(), _I64)), "phrase": pa.array(number), "start": pa.array(start)})

    # a segment's lists and what is found in it are bounded by the segment and the block
    candidates = cut(index.join(F.broadcast(terms), "word").select("segment", "word", "n", "postings").groupBy("segment").applyInArrow(near, "segment long, phrase long, start long"))
    column = np.arange(windows.word.shape[1])
    late, at = np.nonzero((column >= rarest) & (column < windows.size[:, None]))
    others = spark.createDataFrame(pa.table({"phrase": late.astype(_I64), "word": windows.word[late, windows.order[late, at]]}))
    needed = cut(candidates.select("segment", "phrase").distinct().join(F.broadcast(others), "phrase").select("segment", "word").distinct())
    hit_segments = candidates.select("segment").distinct()
    # the different words are a block's, so most of the index is left out where it is read, and only the rest meets its segments
    words_needed = F.broadcast(needed.select("word").distinct())
    rows = index.where("word is not null").join(words_needed, "word", "left_semi").join(needed, ["segment", "word"]).select("segment", "word", "postings", "at", "n", "row").union(
        index.where("word is null").join(hit_segments, "segment").select("segment", "word", "postings", "at", "n", "row")
    )

    def verify(key: tuple, near: pa.Table, table: pa.Table) -> pa.Table:
        lists, w = Lists(table), shared.value
        docs = table.filter(pa.compute.is_valid(table.column("row"))).sort_by("row")
        at, n, row = (docs.column(c).to_numpy() for c in ("at", "n", "row"))
        has = n > 0
        at, n, row = at[has], n[has], row[has]
        phrase, start = w.at(lists, near.column("phrase").to_numpy(), near.column("start").to_numpy(), rarest, w.word.shape[1])
        doc = np.searchsorted(at, start, "right") - 1
        inside = start + w.size[phrase] <= at[doc] + n[doc] if len(at) else np.zeros(len(start), bool)  # a phrase does not go on into the next document
        phrase, begin, doc = phrase[inside], start[inside], doc[inside]
        end = begin + w.size[phrase]
        owner = [(x, w.owner[w.bounds[i] : w.bounds[i + 1]]) for x, i in np.unique(np.stack([doc, phrase], 1), axis=0)] if len(doc) else []
        out: list[tuple] = []
        if len(begin):
            by_doc: dict[int, set] = {}
            for x, owners in owner:
                by_doc.setdefault(x, set()).update(owners)
            order = np.argsort(doc, kind="stable")
            begin, end, doc = begin[order], end[order], doc[order]
            for x in sorted(by_doc):
                lo, hi = np.searchsorted(doc, [x, x + 1])
                b, e = merged(begin[lo:hi], end[lo:hi])
                out.append((int(row[x]), (b - at[x]).tolist(), (e - at[x]).tolist(), sorted(w.items[o] for o in by_doc[x])))
        cols = list(zip(*out, strict=True)) or [()] * 4
        del lists, table, docs
        release()
        longs = pa.list_(pa.int64())
        return pa.table({"segment": pa.array([key[0].as_py()] * len(out), pa.int64()), "row": pa.array(cols[0], pa.int64()), "from": pa.array(cols[1], longs), "to": pa.array(cols[2], longs), "items": pa.array(cols[3], pa.list_(pa.string()))})

    return candidates.groupBy("segment").cogroup(rows.groupBy("segment")).applyInArrow(verify, "segment long, row long, `from` array<long>, `to` array<long>, items array<string>")


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The benchmark's (item_id, text) rows, in blocks of about ``most`` characters."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1] or "") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def counts(index: DataFrame, words: list[int]) -> dict[int, int]:
    """How often the words stand in the index; those that do not are left out. The words are a block's, so their number is bounded."""
    asked = index.sparkSession.createDataFrame(pa.table({"word": pa.array(words, pa.int64())}))
    return {r["word"]: r["n"] for r in index.join(F.broadcast(asked), "word").groupBy("word").agg(F.sum("n").alias("n")).collect()}


def near(index: DataFrame, terms: dict[str, list[str]], within: int = WITHIN, most: int = NEAR_WORDS) -> DataFrame | None:
    """Proximity matches: (segment, row, name, place) where of each name's list of words the rarest stands at word ``place`` of a document and the
    ``most - 1`` next rarer ones within ``within`` words of it, in any order. Words are taken as they are split from texts, equal ones once; of equally
    rare ones the first by alphabet is rarer. A name with a word that no document has is found nowhere. None if there are no words."""
    spark = index.sparkSession
    split = {name: sorted({w for t in words for w in _WORD.findall((t or "").translate(_TO_LOWER))}) for name, words in terms.items()}
    distinct = sorted({w for words in split.values() for w in words})
    if not distinct:
        return None
    data, at = buffers(pa.array(distinct, pa.string()))
    code = dict(zip(distinct, hashes(data, at[:-1], at[1:]).view(_I64).tolist(), strict=True))
    total = counts(index, sorted(code.values()))
    chosen = [(name, sorted(words, key=lambda w: (total.get(code[w], 0), w))[:most]) for name, words in sorted(split.items()) if words]
    chosen = [(name, [code[w] for w in words]) for name, words in chosen if all(code[w] in total for w in words)]
    names = [name for name, _ in chosen]
    word, size = np.zeros((len(chosen), most), _I64), np.array([len(w) for _, w in chosen], _I64)
    for i, (_, words) in enumerate(chosen):
        word[i, : len(words)] = words
    asked = spark.createDataFrame(pa.table({"word": np.unique(word[np.arange(most) < size[:, None]])}))
    columns = ["segment", "word", "postings", "at", "n", "row"]
    rows = index.join(F.broadcast(asked), "word").select(*columns).union(index.where("word is null").select(*columns))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = Lists(table)
        docs = table.filter(pa.compute.is_valid(table.column("row"))).sort_by("row")
        docs = docs.filter(pa.compute.greater(docs.column("n"), 0))
        at, n, row = (docs.column(c).to_numpy() for c in ("at", "n", "row"))
        none = np.zeros(0, _I64)
        found = [[none] * 3]
        for i, place in lists.starts(word[:, 0]) if len(word) else ():
            d = np.searchsorted(at, place, "right") - 1
            for j in range(1, most):
                ok = (size[i] <= j) | lists.near(lists.rank(word[i, j]), place, within, at[d], at[d] + n[d])
                i, place, d = i[ok], place[ok], d[ok]
            found.append([i, row[d], place - at[d]])
        i, r, place = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"segment": pa.array(np.full(len(i), key[0].as_py(), _I64)), "row": pa.array(r), "name": pa.array(names, pa.string()).take(pa.array(i)), "place": pa.array(place)})

    return rows.groupBy("segment").applyInArrow(run, "segment long, row long, name string, place long")


def proximity(docs: DataFrame, benchmark: DataFrame, within: int = WITHIN, most: int = NEAR_WORDS) -> DataFrame:
    """One row a document: doc_id, n_near, the number of items whose rarest words stand together in it, and near_sha256 of their ids, sorted.

    Items of equal ids are one; those without words or of a null id name none."""
    index = stored(build(docs), "postings")
    rows = index.where("word is null").select("segment", "row", "doc_id")
    found = None
    for block in blocks(benchmark.where("item_id is not null").groupBy("item_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text"))):
        one = near(index, {str(i): [t] for i, t in block}, within, most)
        found = one if found is None or one is None else found.union(one)
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    if found is None:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_near"), empty.alias("near_sha256"))
    by = found.groupBy("segment", "row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return rows.join(by, ["segment", "row"], "left").select("doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_near"), F.coalesce(F.sha2(F.array_join("names", ","), 256), empty).alias("near_sha256"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Benchmark rows without words, or of a null item_id, name no item; items of equal ids count once. Null texts have no words."""
    index = stored(build(docs), "postings")
    found = [x for b in blocks(benchmark) if (x := search(index, b, window, rarest)) is not None]
    rows = index.where("word is null").select("segment", "row", "doc_id", F.col("n").alias("n_words"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    if not found:
        return rows.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    hits = found[0]
    for x in found[1:]:
        hits = hits.union(x)
    hits = hits.groupBy("segment", "row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("from", "to", "items")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, sha = [], [], []
            for begin, end, items in zip(*(batch.column(c).to_pylist() for c in ("from", "to", "items")), strict=True):
                b, e = merged(np.array(begin, _I64), np.array(end, _I64))
                n_hit.append(int((e - b).sum()))
                names = sorted(set(items))
                n_items.append(len(names))
                sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("row"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())], names=["segment", "row", "n_hit", "n_items", "items_sha256"])

    counted = hits.mapInArrow(count, "segment long, row long, n_hit long, n_items long, items_sha256 string")
    zero = F.lit(0).cast("long")
    return rows.join(counted, ["segment", "row"], "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS p
        FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT occ.doc_id, occ.i, occ.k, win.item_id FROM occ JOIN win USING (k, p)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS i FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


PROXIMITY_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
o AS (SELECT doc_id, w[i] AS w, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT w, count(*) AS n FROM o WHERE w IN (SELECT w FROM b) GROUP BY w),
r AS (SELECT item, w, coalesce(n, 0) AS n, row_number() OVER (PARTITION BY item ORDER BY coalesce(n, 0), w) AS k FROM b LEFT JOIN n USING (w)),
c AS (SELECT item, w, k, min(n) OVER (PARTITION BY item) AS least, count(*) OVER (PARTITION BY item) AS size FROM r WHERE k <= {NEAR_WORDS}),
a AS (SELECT item, w, size FROM c WHERE k = 1 AND least > 0),
h AS (SELECT a.item, a.size, o.doc_id, o.i FROM a JOIN o USING (w)),
x AS (SELECT h.item, h.doc_id, h.i, any_value(h.size) AS size, count(DISTINCT c.k) AS k FROM h JOIN c ON c.item = h.item AND c.k > 1 JOIN o ON o.w = c.w AND o.doc_id = h.doc_id AND abs(o.i - h.i) <= {WITHIN} GROUP BY 1, 2, 3),
f AS (SELECT DISTINCT doc_id, item FROM (SELECT doc_id, item FROM x WHERE k = size - 1 UNION ALL SELECT doc_id, item FROM h WHERE size = 1)),
g AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_near, sha256(coalesce(items, '')) AS near_sha256 FROM d LEFT JOIN g USING (doc_id)
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated rows go, whatever their ids."""
    rows = keyed(docs)
    marked = decontaminate(rows.select(F.col("_hf_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return without(rows, marked.select("doc_id"), "_hf_row").drop("_hf_row")
