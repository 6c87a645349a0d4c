"""Functions for SQL users: ``secret_redact(text)``, ``secret_count(text)`` and the table function ``secret_matches(text)``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import kernel


def register(spark: SparkSession) -> None:
    """Register the functions in a session. For whole tables ``operators.detect`` is quicker, as it sends only suspicious rows to Python."""

    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else kernel.redact(t, kernel.detect(t)))

    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(kernel.detect(t)))

    class Matches:
        def eval(self, text: str) -> Iterator[tuple]:
            for start, end, kind, detector, _ in kernel.detect(text):
                yield detector, kind, start, end, text[start:end], kernel.redact_match(text[start:end], kind)

    spark.udf.register("secret_redact", pandas_udf(redact, "string"))
    spark.udf.register("secret_count", pandas_udf(count, "int"))
    spark.udtf.register("secret_matches", udtf(Matches, returnType="detector string, pattern_type int, start int, `end` int, matched string, redacted string"))
