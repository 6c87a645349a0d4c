"""WARC archives of pages, and a two-level capture index over them.

Writing. A page becomes one WARC/1.0 record. Records are written by Spark's text sink with the record's closing
CR LF CR LF as line separator, so the archives are plain WARC files on whatever file system Spark can write to; to a local
(or mounted) folder tasks write the same bytes themselves, as said below. Of the
records with equal payloads of ``least`` bytes or more, the one with the smallest page_id is a response and the
others are revisits that name it; smaller payloads are always responses. Rows that tie for the smallest page_id are
all responses. A null html is an empty payload; a null url gives an empty target.

Reading. Archives are read as whole files (their size is bounded when they are written) and parsed by their
Content-Length, so a payload may hold anything, also whole WARC records. Each record gives a capture: reversed-host key,
file, offset, length, and the payload's size and digest as found in the archive.

Index. Captures are range-partitioned and sorted by key (url, then page), then packed into compressed blocks of ``per_block`` captures;
a sparse directory has each block's first key. It has ``DIRECTORY`` entries at most, as blocks grow with the number of captures beyond. A lookup
binary-searches the directory, inflates the block or blocks that may hold the key, binary-searches them, and range-reads the record. A table of
keys is looked up in the same way: tasks search the directory, keys meet their blocks by a join, and each block is searched once for all of its keys.

Executors start a process for each file or folder that Spark makes on a local disk (``chmod``), and until it has replaced itself it counts the
executor's memory a second time. So tasks write archives and blocks on a local disk without Spark, each task in a folder that gets its name when all is
written; and tables that are needed a few times on the way are no files of the shared folder but stay on the executors' disks, and are computed again where
an executor is lost.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import shutil
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bit_place, bit_table, bits_at, new_path

LEAST = 100
PER_BLOCK = 2000
#: Blocks of an index, and so entries of its directory, at most.
DIRECTORY = 100_000
#: Bytes of a file of the archive: a record that would go beyond begins the next file, so only a single record can be longer.
FILE_BYTES = 16 << 20
#: Hadoop's local file system, and Hive's name for it.
LOCAL = ("org.apache.hadoop.fs.LocalFileSystem", "org.apache.hadoop.hive.ql.io.ProxyLocalFileSystem")
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
CAPTURE = "surt string, page_id long, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"
BLOCK = "block long, first string, first_page long, n int, data binary"
_SCHEMA = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def surt(url: str) -> str:
    """Reversed-host key: ``http://www.a.org:8080/p?q`` -> ``org,a,www:8080)/p?q``; host in lower case, no scheme, no fragment."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return ")" + url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


@contextmanager
def _held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` on the executors' disks, for as long as the block runs."""
    held = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield held
    finally:
        held.unpersist()


def _uuid(seed: Column) -> Column:
    h = F.md5(seed)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Write one record a row below ``path``. Only payloads that may have equals are shuffled."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x1F\x7F]", "").alias("url"), html.alias("html")).withColumns(
        {"bytes": F.octet_length("html").cast("long"), "digest": F.sha2(F.col("html").cast("binary"), 256)}
    )
    # only digests that two rows or more share; combined before the shuffle
    shared = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")

    with _held(shared) as shared:
        # payloads whose digest nobody shares are written where they are read; only the others are dealt out to be joined
        table = spark.sparkContext.broadcast(bit_table(shared.select(bit_place("d").alias("p"))))
        marked = rows.withColumn("p", bit_place("digest"))

        def some(shares: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(bits_at(table.value, batch.column("p").to_numpy()) == shares))

            return run

        _sink(marked.withColumn("first", F.lit(None).cast("long")).select(_record().alias("value"), "p"), path, file_bytes, some(False))
        if not table.value.any():  # no payload has equals
            return
        dealt = marked.mapInArrow(some(True), "page_id long, url string, html string, bytes long, digest string, p long")
        dealt = dealt.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") >= least), "left").select(*rows.columns, "first").hint("rebalance")
        _sink(dealt.select(_record().alias("value")), path, file_bytes)


def _local(spark: SparkSession, path: str) -> str | None:
    """The path without its scheme if it is one of a plain local file system, else None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(at).toUri().getPath() if system.getClass().getName() in LOCAL else None


@contextmanager
def _folder(local: str, run: str) -> Iterator[tuple[str, int]]:
    """A folder for what a task writes, and the task's number. It gets its name at once when the block has ended, so that of a task that runs again only one try counts."""
    part = TaskContext.get().partitionId()
    own, named = f"{local}/_{run}-{uuid.uuid4().hex}", f"{local}/{run}-{part:05d}"
    os.makedirs(own)
    try:
        yield own, part
        if os.listdir(own):
            try:
                os.rename(own, named)
            except OSError:
                if not os.path.isdir(named):  # else another try was first
                    raise
    finally:
        shutil.rmtree(own, ignore_errors=True)


def _sink(found: DataFrame, path: str, file_bytes: int, some: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter) -> None:
    """Write the records in column ``value`` that ``some`` lets pass into files of at most ``file_bytes`` below ``path``."""
    local, run = _local(found.sparkSession, path), uuid.uuid4().hex

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Records, and the number of the file within the task that each goes to."""
        file, size = 0, 0
        for batch in some(batches):
            value = batch.column("value")
            of = np.empty(len(value), np.int32)
            for i, n in enumerate((pc.binary_length(value).to_numpy() + len(END)).tolist()):
                if size and size + n > file_bytes:
                    file, size = file + 1, 0
                size += n
                of[i] = file
            yield value, of

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, of in roll(batches):
            yield pa.RecordBatch.from_arrays([value, pa.array(of)], names=["value", "roll"])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _folder(local, run) as (own, part), ExitStack() as files:
            at = -1
            for value, of in roll(batches):
                for record, file in zip(value, of.tolist(), strict=True):
                    if file != at:
                        files.close()
                        out, at = files.enter_context(open(f"{own}/part-{part:05d}-{file:05d}.warc", "wb")), file
                    out.write(record.as_buffer())
                    out.write(END.encode())
        yield from ()

    if local is None:
        found.mapInArrow(rolled, "value string, roll int").write.mode("append").option("lineSep", END).partitionBy("roll").text(path)
    else:
        os.makedirs(local, exist_ok=True)
        found.mapInArrow(kept, "none int").write.format("noop").mode("overwrite").save()


def _record() -> Column:
    """A WARC record without its closing line ends, of page_id, url, html, bytes, digest and first."""
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", _uuid(F.concat_ws("|", page, "digest"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Refers-To", _uuid(F.concat_ws("|", F.col("first").cast("string"), "digest"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("X-Refers-To-Page", F.col("first").cast("string")), line("X-Payload-Bytes", F.col("bytes").cast("string")),
        )).otherwise(F.lit("")),
        line("X-Page", page),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body,
    )


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """(offset, length, headers in lower case, payload) of each record."""
    at, view = 0, memoryview(content)
    while at < len(content):
        head = content.index(b"\r\n\r\n", at)
        lines = content[at:head].decode("utf-8", "surrogateescape").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        end = head + 4 + int(headers["content-length"])
        if content[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has another length than it says")
        yield at, end + 4 - at, headers, view[head + 4 : end]
        at = end + 4


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``; sizes and digests of responses are taken from the payload read.

    Files on a local disk are opened by the tasks, others are read by Spark."""
    local = _local(spark, path) is not None

    def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
        for i, file in enumerate(batch.column("path").to_pylist()):
            if local:
                with open("/" + file.removeprefix("file:").lstrip("/"), "rb") as f:
                    yield file, f.read()
            else:
                yield file, batch.column("content")[i].as_py()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _SCHEMA
        for batch in batches:
            for file, content in contents(batch):
                out: list[list] = [[] for _ in schema]
                for offset, length, head, payload in records(content):
                    named = head["warc-payload-digest"].removeprefix("sha256:")
                    if head["warc-type"] == "revisit":
                        row = ("revisit", int(head["x-payload-bytes"]), named, int(head["x-refers-to-page"]))
                    else:
                        digest = hashlib.sha256(payload).hexdigest()
                        if digest != named:
                            raise ValueError(f"{file}, byte {offset}: the payload's digest is not the recorded one")
                        row = ("response", len(payload), digest, None)
                    for column, value in zip(out, (surt(head["warc-target-uri"]), int(head["x-page"]) if head["x-page"] else None, file, offset, length, *row), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", *[] if local else ["content"]).mapInArrow(run, CAPTURE)


def _key(url_key: str, page: int | None) -> tuple[str, int]:
    """What captures are sorted by; a null page comes first."""
    return url_key, -(1 << 63) if page is None else page


def _inflate(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def _run(rows: list[list], key: tuple[str, int]) -> list[list]:
    """The captures of a key in a sorted block."""
    of = lambda r: _key(r[0], r[1])
    return rows[bisect.bisect_left(rows, key, key=of) : bisect.bisect_right(rows, key, key=of)]


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK).option("recursiveFileLookup", "true").parquet(f"{path}/blocks")


def write_index(found: DataFrame, path: str, per_block: int = PER_BLOCK) -> None:
    """Blocks of sorted captures below ``path``/blocks, their directory below ``path``/directory. Equal urls are told apart by
    page_id, file and offset, so a hot host or url spreads over many blocks."""
    order = ["surt", "page_id", "file", "offset"]
    per_block = max(per_block, -(-found.count() // DIRECTORY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = []
        made, part = 0, 0

        def block(rows: list[list]) -> pa.RecordBatch:
            nonlocal made
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
            made += 1
            return pa.RecordBatch.from_pydict({"block": [(part << 32) + made], "first": [rows[0][0]], "first_page": pa.array([_key(*rows[0][:2])[1]], pa.int64()), "n": pa.array([len(rows)], pa.int32()), "data": [data]})

        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
            kept += [list(r) for r in zip(*(batch.column(n).to_pylist() for n in _SCHEMA.names), strict=True)]
            while len(kept) >= per_block:
                yield block(kept[:per_block])
                del kept[:per_block]
        if kept:
            yield block(kept)

    spark = found.sparkSession
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    local, name = _local(spark, f"{path}/blocks"), uuid.uuid4().hex

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _folder(local, name) as (own, task), ExitStack() as files:
            out = None
            for made_block in run(batches):
                out = out or files.enter_context(pq.ParquetWriter(f"{own}/part-{task:05d}.parquet", made_block.schema, compression="none"))
                out.write_batch(made_block)
        yield from ()

    if local is None:
        ranged.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    else:
        os.makedirs(local)
        ranged.mapInArrow(kept, "none int").write.format("noop").mode("overwrite").save()
    _blocks(spark, path).select("block", "first", "first_page", "n").coalesce(1).write.parquet(f"{path}/directory")  # ``DIRECTORY`` rows at most


class Directory:
    """The sparse directory, sorted: it says which blocks may hold a key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        rows = sorted(((r["first"], r["first_page"]), r["block"]) for r in spark.read.parquet(f"{path}/directory").collect())  # ``DIRECTORY`` at most
        self.firsts, self.blocks = [x[0] for x in rows], [x[1] for x in rows]

    def search(self, lo: tuple[str, int], hi: tuple[str, int]) -> list[int]:
        """The blocks that may hold keys from lo to hi."""
        return self.blocks[max(0, bisect.bisect_left(self.firsts, lo) - 1) : bisect.bisect_right(self.firsts, hi)]


def keys_of(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(surt, page_id) of pages, each once; a null url has the key of an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")], names=["surt", "page_id"])

    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x1F\x7F]", "")
    return pages.select(url.alias("url"), F.col(id_col).cast("long").alias("page_id")).mapInArrow(run, "surt string, page_id long").distinct()


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """The captures of a table of different keys (surt, page_id), out of the index below ``path``."""
    spark = keys.sparkSession
    shared = spark.sparkContext.broadcast(Directory(spark, path))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, block = [], []
            for i, (key, page) in enumerate(zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist(), strict=True)):
                for b in shared.value.search(_key(key, page), _key(key, page)):
                    row.append(i)
                    block.append(b)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(row, pa.int64())) for c in batch.columns], pa.array(block, pa.int64())], names=["surt", "page_id", "block"])

    def search(_: tuple, asked: pa.Table, blocks: pa.Table) -> pa.Table:
        out: list[list] = []
        for data in blocks.column("data").to_pylist():
            rows = _inflate(data)
            for key, page in zip(asked.column("surt").to_pylist(), asked.column("page_id").to_pylist(), strict=True):
                out += _run(rows, _key(key, page))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(_SCHEMA), _SCHEMA, strict=True)], schema=_SCHEMA)

    asked = keys.mapInArrow(ask, "surt string, page_id long, block long")
    blocks = _blocks(spark, path).select("block", "data")
    return asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(search, CAPTURE)


def _range(spark: SparkSession, file: str, offset: int, length: int) -> bytes:
    """``length`` bytes of a file from ``offset``, by Hadoop's positioned read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(file)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(offset)
        limited = jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(limited))
    finally:
        stream.close()


class Index:
    """Lookups of single urls, on the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.directory = spark, path, Directory(spark, path)

    def lookup(self, url: str) -> list[tuple[dict, bytes]]:
        """(capture, record bytes' payload) for each capture of the url, revisits with an empty payload."""
        key = surt(url)
        wanted = self.directory.search((key, -(1 << 63)), (key, (1 << 63) - 1))
        if not wanted:
            return []
        out = []
        for b in _blocks(self.spark, self.path).where(F.col("block").isin(wanted)).select("data").collect():
            rows = _inflate(bytes(b["data"]))
            for row in rows[bisect.bisect_left(rows, key, key=lambda r: r[0]) : bisect.bisect_right(rows, key, key=lambda r: r[0])]:
                capture = dict(zip(_SCHEMA.names, row, strict=True))
                _, _, _, payload = next(records(_range(self.spark, capture["file"], capture["offset"], capture["length"])))
                out.append((capture, bytes(payload)))
        return out


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive, read it back, index its captures, and look every page up in the index."""
    pages, path = spark.read.parquet(f"{sf_dir}/pages.parquet"), new_path(spark, "warc")
    write(pages, f"{path}/archive")
    with _held(captures(spark, f"{path}/archive")) as found:
        write_index(found, f"{path}/index")
    return lookup(keys_of(pages), f"{path}/index").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest AND p.payload_bytes >= 100
"""
