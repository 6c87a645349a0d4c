"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made from lengths alone. There are at most ``capacity`` different lengths, so the whole packing problem
is a table of that many counts, whatever the number of documents; it goes to the driver, the documents do not.

1. Lengths above ``large_from`` are sorted, split into ``groups`` groups of equal cardinality and rounded up to the
   group's longest (linear grouping).
2. For the few rounded sizes, configurations (which sizes share a sequence) and how often to use each come from the
   cutting-stock linear program by column generation, rounded down, the rest by the fullest configurations.
3. Actual lengths take the places of the rounded ones, as runs of equal sequences.
4. Small documents, longest first, go where the least room remains that holds them; new sequences open when none does.

Plan rows say: the documents of length l with ranks lo..hi-1 go to sequences s, s+1, ... at offset o. Documents are
ranked within their length without putting a length in one task, and look their place up in the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, with_rank
from .tokens import slices

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
#: Chunks whose ids a worker keeps; the store is emptied when full, so it bounds memory and changes no result.
CACHE = 400_000


@lru_cache(1)
def encoder(name: str) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian 32-bit bytes, the same ids as the named tokenizers file gives.

    The byte-pair vocabulary is also there as ranks, which are quicker to apply. The vocabulary's pattern never joins a
    space to what stands before it, and joins a space to the word after it, so a text without a run of white space may be cut
    before each space and the ids of each cut be remembered. Texts that name the special token go to the tokenizer itself."""
    import base64
    import re

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(f"{name}.tiktoken"), "rb"))}  # noqa: SIM115
    quick = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    plain = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    runs = re.compile(r"\s \s?| \s").search
    known: dict[str, bytes] = {}

    def of(chunk: str) -> bytes:
        found = known.get(chunk)
        if found is None:
            if len(known) >= CACHE:
                known.clear()
            found = np.array(quick.encode_ordinary(chunk), "<u4").tobytes()
            if len(chunk) < 64:
                known[chunk] = found
        return found

    def encode(text: str) -> bytes:
        if "<|endoftext|>" in text:
            return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text or text[0] == " " or text[-1] == " " or runs(text):
            return np.array(quick.encode_ordinary(text), "<u4").tobytes()
        get = known.get
        head, *rest = text.split(" ")
        out = [of(head)]
        for chunk in rest:
            out.append(get(" " + chunk) or of(" " + chunk))
        return b"".join(out)

    return encode


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of every document: id, piece, start, length, ids_crc32. A null text is an empty one: its piece is the end id alone."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = given.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    ids = encode(text or "") + b"\0\0\0\0"
                    n = len(ids) // 4
                    first = n % capacity or capacity if n > capacity else n
                    lo, hi, k = 0, first, 0
                    while lo < n:
                        row.append(i)
                        piece.append(k)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(ids[4 * lo : 4 * hi]))
                        lo, hi, k = hi, min(n, hi + capacity), k + 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return given.mapInArrow(run, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def _fullest(sizes: list[int], value: list[float], most: list[int], capacity: int) -> list[int]:
    """The configuration of largest total value: an integer knapsack over sizes, each used ``most`` times at most."""
    best = np.zeros(capacity + 1)
    took = []
    for s, v, m in zip(sizes, value, most, strict=True):
        count = np.zeros(capacity + 1, np.int16)
        if v > 0:
            base = best.copy()
            for c in range(1, min(m, capacity // s) + 1):
                other = base[: capacity + 1 - c * s] + c * v
                better = other > best[c * s :] + 1e-12
                best[c * s :][better] = other[better]
                count[c * s :][better] = c
        took.append(count)
    left, out = int(np.argmax(best)), [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        out[i] = int(took[i][left])
        left -= out[i] * sizes[i]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 200) -> list[tuple[list[int], int]]:
    """(how many of each size, times used), covering the demand: column generation, then the fullest for the rest."""
    n = len(sizes)
    if not n:
        return []
    columns = [[capacity // s if i == j else 0 for j in range(n)] for i, s in enumerate(sizes)]
    basis = np.array(columns, float).T
    need = np.array(demand, float)
    for _ in range(rounds):
        try:
            price = np.linalg.solve(basis.T, np.ones(n))
            use = np.linalg.solve(basis, need)
        except np.linalg.LinAlgError:
            break
        new = _fullest(sizes, list(price), [capacity // s for s in sizes], capacity)
        if np.dot(new, price) <= 1 + 1e-7:
            break
        direction = np.linalg.solve(basis, np.array(new, float))
        ratio = np.where(direction > 1e-9, np.maximum(use, 0) / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out] = new
        columns[out] = new
    use = np.maximum(np.linalg.solve(basis, need), 0)
    left, found = list(demand), []
    for column, times in zip(columns, use, strict=True):
        times = int(times + 1e-9)
        if times:
            found.append((column, times))
            left = [x - times * c for x, c in zip(left, column, strict=True)]
    left = [max(0, x) for x in left]
    while any(left):
        column = _fullest(sizes, [float(s) for s in sizes], left, capacity)
        times = min(x // c for x, c in zip(left, column, strict=True) if c)
        found.append((column, times))
        left = [x - times * c for x, c in zip(left, column, strict=True)]
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 48, large_from: tuple[int, ...] = ()) -> tuple[np.ndarray, int]:
    """(rows of length, lo, hi, sequence, offset; number of sequences) for the given counts of lengths.

    What counts as large is tried at a quarter, a third and a half of the capacity; the plan of fewest sequences stays."""
    tried = [_plan(counts, capacity, groups, x) for x in large_from or (capacity // 4, capacity // 3, capacity // 2)]
    return min(tried, key=lambda p: p[1])


def _plan(counts: dict[int, int], capacity: int, groups: int, large_from: int) -> tuple[np.ndarray, int]:
    rank = dict.fromkeys(counts, 0)
    rows: list[tuple[int, int, int, int, int]] = []
    total = 0
    bins: dict[int, list[tuple[int, int]]] = {}  # room -> runs (first sequence, number)

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + n, sequence, offset))
        rank[length] += n

    full = counts.get(capacity, 0)
    if full:
        put(capacity, full, 0, 0)
        total = full
    large = sorted((x for x in counts if large_from < x < capacity), reverse=True)
    # linear grouping: equal cardinality, rounded up to the longest of the group
    n_large = sum(counts[x] for x in large)
    members: list[list[list[int]]] = []  # by group: runs [length, count], longest first
    each, room = max(1, -(-n_large // groups)), 0
    for x in large:
        n = counts[x]
        while n:
            if not room:
                members.append([])
                room = each
            take = min(n, room)
            members[-1].append([x, take])
            n, room = n - take, room - take
    sizes = [m[0][0] for m in members]
    demand = [sum(c for _, c in m) for m in members]
    for column, times in configurations(sizes, demand, capacity):
        slots = [(g, c) for g, c in enumerate(column) if c]
        while times:
            # a run of equal sequences: each place keeps one actual length; else a single sequence
            step = max(1, min([times, *(members[g][0][1] // c for g, c in slots)]))
            offset = 0
            for g, c in slots:
                for _ in range(c):
                    head = members[g][0]
                    put(head[0], step, total, offset)
                    offset += head[0]
                    head[1] -= step
                    if not head[1]:
                        members[g].pop(0)
            bins.setdefault(capacity - offset, []).append((total, step))
            total, times = total + step, times - step
    rooms = sorted(x for x in bins if x)
    for x in sorted((x for x in counts if x <= min(large_from, capacity - 1)), reverse=True):
        n = counts[x]
        while n:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                fit = capacity // x
                many, rest = divmod(n, fit)
                for times, c in ((many, fit), (1 if rest else 0, rest)):
                    if times:
                        for k in range(c):
                            put(x, times, total, k * x)
                        if capacity - c * x:
                            bins.setdefault(capacity - c * x, []).append((total, times))
                            if capacity - c * x not in rooms:
                                bisect.insort(rooms, capacity - c * x)
                        total += times
                break
            r = rooms[i]
            first, m = bins[r].pop()
            if not bins[r]:
                del bins[r]
                rooms.pop(i)
            fit = min(r // x, n)
            times = min(m, n // fit)
            for k in range(fit):
                put(x, times, first, capacity - r + k * x)
            n -= fit * times
            for rr, run in ((r - fit * x, (first, times)), (r, (first + times, m - times))):
                if rr and run[1]:
                    if rr not in bins:
                        bisect.insort(rooms, rr)
                    bins.setdefault(rr, []).append(run)
    return np.array(rows, np.int64).reshape(-1, 5), total


def pack(found: DataFrame, capacity: int = CAPACITY, groups: int = 48, rows_per_part: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to stored pieces (a table with length in 1..capacity)."""
    spark = found.sparkSession
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    rows, _ = plan(counts, capacity, groups)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # a few rows for each length and configuration: bounded by capacity and groups, not by the documents
    shared = spark.sparkContext.broadcast((rows[:, 0] << 44 | rows[:, 1], rows))
    order = [F.col(c) for c in found.columns]
    spread = F.xxhash64(*found.columns)
    ranked = with_rank(found, ["length"], order, spread, max(256, sum(counts.values()) // rows_per_part))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(stored(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")), "pieces"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the pieces of all documents, packed."""
    return pack(stored(pieces(docs), "pieces"))
