"""Toxicity scores from confirmed toxic examples and unlabelled text, by non-negative positive-unlabelled learning.

Features of a text are hashes of its words and of its words' beginnings (4 to 8 bytes), each once a text, weighted by
how much of the text they make up. Learning takes three steps, all on rows outside the held-out third:

1. A bounded sample is drawn by the hash of the id: at most ``max_positive`` confirmed toxic rows and ``max_unlabelled``
   rows without a label (if there are none, rows not confirmed toxic). These two bounds are parameters and the only sampling.
2. The ``features`` hashes that tell the two sets best apart are kept, by document counts over the whole sample.
3. A logistic model is trained in numpy with the risk  p*R+(toxic) + max(0, R-(unlabelled) - p*R-(toxic)),  p being the
   share of toxic rows among the labelled ones. Where the bracket falls below zero its gradient is turned round, so
   that the model cannot gain by calling the toxic rows among the unlabelled ones clean.

Scoring reads every whole text once and uses the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy
from .tokens import ALNUM, LOWER, buffers, hashes, mix, owners, slices, words

PREFIXES = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
MAX_POSITIVE = 4000
MAX_UNLABELLED = 8000
FEATURES = 6000
#: Bits of the table of feature hashes.
BITS = 22


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the distinct features of each text, sorted by text, and each text's number of words."""
    data, at = buffers(texts)
    low = LOWER[data]
    starts, ends, first = words(low, at, ALNUM)
    n_words = np.diff(first)
    text, size = owners(first), ends - starts
    found_text, found = [text], [hashes(low, starts, ends)]
    for k in PREFIXES:
        long = size > k
        found_text.append(text[long])
        found.append(mix(hashes(low, starts[long], starts[long] + k) + np.uint64(k)))
    key = np.concatenate(found_text).astype(np.uint64) << np.uint64(BITS) | np.concatenate(found) >> np.uint64(64 - BITS)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64((1 << BITS) - 1)).astype(np.int64), count, n_words


def weight(count: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """A feature's value: more for more of the text, never much less than for a single place."""
    return 0.5 + np.log1p(200.0 * count / np.maximum(n_words, 1)) / 3


@dataclass
class Model:
    """Column of each feature hash (sorted) with its weight, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        text, feature, count, n_words = features(texts)
        at = np.searchsorted(self.keys, feature)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == feature if len(self.keys) else np.zeros(len(feature), bool)
        text, at = text[hit], at[hit]
        z = np.bincount(text, self.weights[at] * weight(count[hit], n_words[text]), len(n_words)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def risk(z: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """What is minimised, and its gradient, for the linear scores of toxic and unlabelled rows: the non-negative risk, or, where the bracket is negative,
    the bracket's distance from zero alone."""
    n_p, n_u = int(toxic.sum()), int((~toxic).sum())
    s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    bracket = np.mean(np.logaddexp(0, z[~toxic])) - prior * np.mean(np.logaddexp(0, z[toxic]))
    g = np.zeros(len(z))
    if bracket >= 0:
        g[toxic] = (prior * (s[toxic] - 1) - prior * s[toxic]) / n_p
        g[~toxic] = s[~toxic] / n_u
        return float(prior * np.mean(np.logaddexp(0, -z[toxic])) + bracket), g
    g[toxic] = prior * s[toxic] / n_p
    g[~toxic] = -s[~toxic] / n_u
    return float(-bracket), g


def train(keys: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """A model over the feature hashes ``keys`` from the sample's entries (row, column of keys, value)."""
    n_p, n_u = int(toxic.sum()), int((~toxic).sum())
    if not n_p or not n_u:
        return Model(np.zeros(0, np.int64), np.zeros(0), -3.0 if n_u or not n_p else 3.0)
    w, b, m = np.zeros(len(keys)), -2.0, len(toxic)
    state = [np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0]
    for t in range(1, rounds + 1):
        z = np.bincount(row, w[col] * value, m) + b
        _, g = risk(z, toxic, prior)
        gw, gb = np.bincount(col, g[row] * value, len(keys)) + decay * w, g.sum()
        # Adam, a public optimiser
        state[0] = 0.9 * state[0] + 0.1 * gw
        state[1] = 0.999 * state[1] + 0.001 * gw**2
        state[2] = 0.9 * state[2] + 0.1 * gb
        state[3] = 0.999 * state[3] + 0.001 * gb**2
        w = w - rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.999**t)) + 1e-8)
        b -= rate * (state[2] / (1 - 0.9**t)) / (np.sqrt(state[3] / (1 - 0.999**t)) + 1e-8)
    return Model(keys, w, float(b))


def held_out(doc_id: Column) -> Column:
    """The third of the rows whose labels are never learned from; a null id is taken as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, n_features: int = FEATURES) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic; a null toxic is no label, repeated ids count as toxic if one is).

    Without a toxic row the model calls everything clean. Of rows that share an id one text is taken."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id").distinct().join(known, "doc_id", "left")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # three rows
    rest = F.col("toxic").isNull() if n.get(None) else F.col("toxic") == 0
    prior = n.get(1, 0) / max(1, n.get(1, 0) + n.get(0, 0))
    if not n.get(1) or not (n.get(None) or n.get(0)):
        return train(np.zeros(0, np.int64), *[np.zeros(0, np.int64)] * 2, np.zeros(0), np.array([True] * n.get(1, 0) + [False] * (n.get(0, 0) > 0), bool), prior)
    # a bounded number of ids: max_positive + max_unlabelled
    some = lambda which, most: rows.where(which).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()
    toxic_ids, other_ids = some(F.col("toxic") == 1, max_positive), some(rest, max_unlabelled)
    n_p, n_u = len(toxic_ids), len(other_ids)
    toxic = np.arange(n_p + n_u) < n_p
    chosen = pa.concat_tables([toxic_ids, other_ids]).append_column("row", pa.array(np.arange(n_p + n_u)))
    # The sample is read twice, so that its entries are never a table: executors start a process for each file that they write, and such a process
    # holds the executor's memory a second time until it has replaced itself.
    sample = docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame(chosen)), "doc_id").groupBy("row").agg(F.max("text").alias("text")).repartition(24, "row")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                text, feature, _, _ = features(batch.column("text"))
                one, at = np.unique(feature, return_inverse=True)
                p = np.bincount(at, batch.column("row").to_numpy()[text] < n_p, len(one)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(p), pa.array(np.bincount(at, minlength=len(one)) - p)], names=["feature", "p", "u"])

    seen = sample.mapInArrow(counts, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    # log-likelihood ratio of the two document rates, for features more frequent among toxic rows
    part = lambda x, total, all_: F.when(x > 0, x * F.log(x / total / all_)).otherwise(0.0)
    p, u = F.col("p"), F.col("u")
    rate = (p + u) / (n_p + n_u)
    gain = part(p, n_p, rate) + part(u, n_u, rate) + part(n_p - p, n_p, 1 - rate) + part(n_u - u, n_u, 1 - rate)
    top = seen.where((p >= 3) & (p / n_p > u / n_u)).withColumn("gain", gain).where("gain > 3").orderBy(F.desc("gain"), "feature").limit(n_features)
    keys = np.sort(np.array([r["feature"] for r in top.select("feature").collect()], np.int64))  # at most n_features

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                text, feature, count, n_words = features(batch.column("text"))
                at = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
                hit = keys[at] == feature
                text = text[hit]
                key = batch.column("row").to_numpy()[text] << 32 | at[hit]
                value = weight(count[hit], n_words[text]).astype(np.float32)
                # a row of the result carries a slice's entries: place of row and column, and value
                yield pa.RecordBatch.from_pydict({"key": [key.tobytes()], "value": [value.tobytes()]})

    # the sample's entries of kept features: bounded by the sample and the number of features
    got = sample.mapInArrow(kept, "key binary, value binary").collect() if len(keys) else []
    key = np.frombuffer(b"".join(bytes(r["key"]) for r in got), np.int64)
    order = np.argsort(key, kind="stable")
    value = np.frombuffer(b"".join(bytes(r["value"]) for r in got), np.float32)[order]
    del got
    key = key[order]
    row, col = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
    del key, order
    tidy(docs.sparkSession)
    return train(keys, row, col, value, toxic, prior)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """Add score and predicted to every row, whatever its other columns. Null and empty texts have the score of no features."""
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                s = model.score(batch.column(text_col))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the model rejects go."""
    model = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("predicted = 0").select(*docs.columns)
