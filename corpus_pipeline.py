"""The corpus pipeline: stages over documents, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hushframe.llm import decontam, jaccard, packing, pii, toxicity
from hushframe.llm.common import drop_path, made, stored

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity.stage),
    ("jaccard", jaccard.stage),
    ("decontamination", decontam.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: SQL can express neither a trained classifier nor a packing; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = set(made())
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        # once its result is written, a stage's own tables and its input only take room
        for path in made()[:-1]:
            if path not in others:
                drop_path(spark, path)
    return docs
