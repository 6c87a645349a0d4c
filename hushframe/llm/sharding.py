"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with a common hub (by default: an equal text) are linked. The graph is kept in hub form (a document
row names its hub), so a group of n copies costs n rows and not n*n edges. Each linked document starts in a
shard by the hash of its id. A round joins every linked document with its hub's counts by shard and lets it ask
for the shard, among those with room, that holds most of its neighbours. Requests into a shard are granted up to
a quota: its capacity less the linked documents in it, plus those that leave. Documents without links have no wish
and fill what remains, so they never displace linked ones.

A group of more than half a shard's rows cannot stay together and would only block the others; it is dealt out in a run over few shards.

The end is exact: linked documents beyond a shard's capacity join the unlinked ones in a pool, which is dealt out in
runs over what the shards still lack. Sizes follow the law ``rows``: counts of any two shards differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, with_rank


def _quotas(wants: list[tuple[int, int, int]], room: list[int]) -> list[float]:
    """Share of the requests into each shard that is granted, from (from, to, count) and the free places."""
    k = len(room)
    into, share = [0] * k, [1.0] * k
    for _, to, n in wants:
        into[to] += n
    for _ in range(20):
        leaves = [0.0] * k
        for frm, to, n in wants:
            leaves[frm] += n * share[to]
        share = [min(share[s], max(0.0, room[s] + leaves[s]) / into[s]) if into[s] else 0.0 for s in range(k)]
    return share


def propagate(linked: DataFrame, capacity: list[int], rounds: int = 6) -> DataFrame:
    """Labels for ``linked`` (columns uid, hub): adds ``label``. ``capacity``: rows that a shard may hold."""
    k = len(capacity)
    state = cut(linked.withColumn("label", F.pmod(F.xxhash64("uid"), F.lit(k)).cast("int")))
    for turn in range(rounds):
        held = {r["label"]: r["n"] for r in state.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most k rows
        room = [capacity[s] - held.get(s, 0) for s in range(k)]
        free = F.array(*[F.lit(x > 0) for x in room])
        counts = state.groupBy("hub", "label").agg(F.count(F.lit(1)).alias("n"))
        # ties go by a hash of hub and shard, so that equal groups spread over the shards
        order = F.struct("n", F.pmod(F.xxhash64("hub", "label"), F.lit(1 << 30)), "label")
        most = F.max(order).alias("most")
        open_ = F.max(F.when(free[F.col("label")], order)).alias("open")
        best = counts.groupBy("hub").agg(most, open_).select(
            F.col("hub").alias("h"),
            # the shard with most neighbours if it has room or already holds them, else the fullest one with room
            F.when(free[F.col("most.label")], F.col("most.label")).otherwise(F.coalesce("open.label", "most.label")).alias("wish"),
            F.col("most.label").alias("top"),
        )
        asked = state.join(best, F.col("hub") == F.col("h")).withColumn("to", F.when(F.col("label") == F.col("top"), F.col("label")).otherwise(F.col("wish")))
        wants = [tuple(r) for r in asked.where("label <> to").groupBy("label", "to").agg(F.count(F.lit(1)).alias("n")).collect()]  # at most k*k rows
        if not wants:
            break
        share = _quotas(wants, room)
        if not any(share):
            break
        lot = F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
        granted = F.array(*[F.lit(float(x)) for x in share])
        state = cut(asked.select("uid", "hub", F.when(lot < granted[F.col("to")], F.col("to")).otherwise(F.col("label")).alias("label")))
    return state


def _told_apart(base: DataFrame) -> DataFrame:
    """Repeated rows (equal ``uid``) numbered; which of them gets which number does not matter, as they are interchangeable."""
    twice = cut(base.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("uid").alias("u")))
    if twice.isEmpty():
        return base
    same = base.join(twice, F.col("uid") == F.col("u"), "left_semi").withColumn("at", F.monotonically_increasing_id())
    numbered = with_rank(cut(same), ["uid"], [F.col("at")], F.xxhash64("at"), 64).withColumn("uid", F.xxhash64("uid", "rank")).drop("at", "rank")
    return cut(base.join(twice, F.col("uid") == F.col("u"), "left_anti").unionByName(numbered))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, rounds: int = 6, hub: Column | None = None, rows_per_part: int = 20_000) -> DataFrame:
    """One row a document: id, size, text_crc32, law, shard, slot, grown_shard.

    ``hub``: what links documents, by default the text itself (as hash, checksum and length). A null text has size 1, the
    checksum of no bytes, and no links; an empty text is a text as any other. Repeated rows and repeated or null ids
    are rows of their own. The result is a function of the rows: their order and partitions do not matter. An empty table gives an empty result. Other columns are ignored."""
    spark: SparkSession = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
        (F.struct(F.xxhash64(text), F.crc32(text), F.octet_length(text)) if hub is None else hub).alias("hub"),
        text.isNull().alias("alone"),
    )
    groups = rows.where(~F.col("alone")).groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("hub").alias("h"))
    linked = rows.join(groups, F.col("hub").eqNullSafe(F.col("h")) & ~F.col("alone"), "left")
    # a row is named by its content, so that neither its place in the table nor a task's second run changes where it goes
    base = cut(linked.select("id", "size", "crc", F.when(F.col("h").isNotNull(), F.xxhash64("hub")).alias("hub"), F.xxhash64("id", "size", "crc", "alone", "hub").alias("uid")))
    base = _told_apart(base)
    total = base.count()
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    # hubs of more than half a shard: 2 * shards at most; dealt out in runs, they fill few shards and take no quota from small groups
    big = [r["hub"] for r in base.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, capacity[0] // 2)).orderBy(F.desc("n"), "hub").limit(2 * shards).collect()]
    state = propagate(base.where(F.col("hub").isNotNull() & ~F.col("hub").isin(big)).select("uid", "hub"), capacity, rounds)
    own = F.lit(-1)
    for i, h in enumerate(big):
        own = F.when(F.col("hub") == h, -2 - i).otherwise(own)
    labelled = base.join(state.select(F.col("uid").alias("u"), "label"), F.col("uid") == F.col("u"), "left").select("id", "size", "crc", "uid", F.coalesce("label", own).alias("label"))
    buckets = max(256, total // rows_per_part)
    ranked = cut(with_rank(labelled, ["label"], [F.col("uid")], F.xxhash64("uid"), buckets))
    held = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 * shards + 1 rows
    kept = [min(held.get(s, 0), capacity[s]) for s in range(shards)]
    # the pool: large hubs, unlinked rows, then what is over in each shard; pool place -> shard by running sums
    over_start, at, pool = {}, 0, {}
    for label in [*range(-2, -2 - len(big), -1), -1]:
        pool[label] = at
        at += held.get(label, 0)
    for s in range(shards):
        over_start[s] = at
        at += held.get(s, 0) - kept[s]
    place = F.lit(None).cast("long")
    for label, first in pool.items():
        place = F.when(F.col("label") == label, F.col("rank") + first).otherwise(place)
    for s in range(shards):
        place = F.when((F.col("label") == s) & (F.col("rank") >= kept[s]), F.col("rank") - kept[s] + over_start[s]).otherwise(place)
    to_shard, to_slot, lo = F.col("label"), F.col("rank"), 0
    for s in range(shards):
        lack = capacity[s] - kept[s]
        here = F.col("place").isNotNull() & (F.col("place") >= lo) & (F.col("place") < lo + lack)
        to_shard = F.when(here, F.lit(s)).otherwise(to_shard)
        to_slot = F.when(here, F.col("place") - lo + kept[s]).otherwise(to_slot)
        lo += lack
    return ranked.withColumn("place", place).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
        to_shard.cast("int").alias("shard"), to_slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
