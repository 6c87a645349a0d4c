"""What several corpus operators share: shared-folder storage, distributed ranks and connected components."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent on one machine, as in tests, a temporary folder is made once and set; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="hushframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh place in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/hushframe-{uuid.uuid4().hex}-{name}"
    _made.append((spark, path))
    return path


def made() -> list[str]:
    """The places that are still there, the newest last."""
    return [path for _, path in _made]


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _drop_all() -> None:
    for spark, path in list(_made):
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            return


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files, checkpoints and broadcasts of tables that nothing refers to any more.

    It acts when the driver collects its garbage, which the iterative operators make it do after each large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    tidy(spark)  # the caller still held the table of the step before when that was written
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; for the small states of iterative joins."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_rank(df: DataFrame, keys: list[str], order: list[Column], spread: Column, buckets: int, name: str = "rank") -> DataFrame:
    """Add a gapless rank (from 0) within ``keys`` without putting a key's rows in one task.

    Rows go to ``buckets`` parts by ``spread``; each part is numbered by itself and starts after the rows of
    the parts before it. The table of part sizes has at most ``buckets`` rows a key."""
    df = df.withColumn("_part", F.pmod(spread, F.lit(buckets)).cast("int"))
    starts = (
        df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))
    return (
        df.withColumn("_local", local).join(starts, same)
        .withColumn(name, F.col("_start") + F.col("_local") - 1)
        .drop("_part", "_p", "_start", "_local", *[f"_k{i}" for i in range(len(keys))])
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that links reach. ``edges`` has columns a and b; nodes without edges are absent.

    Labels go to neighbours by minimum, then every label jumps to its label's label, so that long chains take
    a logarithmic number of rounds. Each round's labels are checkpointed. Aggregations combine before the
    shuffle and the joins are plain equi-joins, which adaptive execution splits for nodes with many links."""
    links = cut(edges.select("a", "b").where("a <> b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = cut(links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    for _ in range(max_rounds):
        near = links.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        up = step.select(F.col("node").alias("up_node"), F.col("label").alias("up_label"))
        labels = cut(step.join(up, F.col("label") == F.col("up_node"), "left").select("node", "was", F.least("label", F.coalesce("up_label", "label")).alias("label")))
        tidy(edges.sparkSession)
        if labels.where("was <> label").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


#: Places of a bit table: a fixed 4 MB, whatever the data.
BITS = 1 << 25


def bit_place(*cols: str) -> Column:
    """The place of a key in a bit table."""
    return F.pmod(F.xxhash64(*cols), F.lit(BITS)) + 1


def bit_table(places: DataFrame) -> np.ndarray:
    """Bits for the places in column ``p``: a prefilter of fixed size for a join whose one side may be small. It may let other
    rows pass, so the join itself must follow; it never stops a row of the table."""
    rows = places.groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    table = np.zeros(BITS // 8, np.uint8)
    for r in rows:  # at most BITS / 32768 rows of 4 KB
        bits = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["k"] - 1) * 4096
        table[at : at + len(bits)] = bits
    return table


def bits_at(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    p = p - 1
    return (table[p // 8] >> (p % 8).astype(np.uint8) & 1).astype(bool)


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows of the given ids (a table of one column). Only rows that the bit table lets pass are shuffled."""
    (name,) = ids.columns
    ids = cut(ids.distinct())
    table = docs.sparkSession.sparkContext.broadcast(bit_table(ids.select(bit_place(name).alias("p"))))
    marked = docs.withColumn("_hf_p", bit_place(id_col))

    def some(hit: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                p = batch.column(batch.schema.get_field_index("_hf_p")).to_numpy()
                yield batch.filter(pa.array(bits_at(table.value, p) == hit))

        return marked.mapInArrow(run, marked.schema).drop("_hf_p")

    bad = ids.select(F.col(name).alias("_hf_bad"))
    return some(False).union(some(True).join(bad, F.col(id_col).eqNullSafe(F.col("_hf_bad")), "left_anti"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row, ``_hf_row``; written, so that the keys stay."""
    return stored(docs.withColumn("_hf_row", F.monotonically_increasing_id()), "rows")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions, as the session sets them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


__all__ = ["BITS", "bit_place", "bit_table", "bits_at", "components", "cut", "drop_path", "keyed", "made", "new_path", "parts", "shared_dir", "stored", "tidy", "with_rank", "without"]
