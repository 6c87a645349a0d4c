"""Streaming queries over what there is: run until the sources are read, the result as a table."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; where that is not set, on one machine, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="hushframe-")
    return f"{at.rstrip('/')}/hushframe-{uuid.uuid4().hex}"


def to_table(stream: DataFrame) -> DataFrame:
    """All that a streaming table gives for the present content of its sources. State and result are in the shared folder, so a lost executor's part is
    computed again from them."""
    spark, at = stream.sparkSession, shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
