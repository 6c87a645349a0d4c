"""Format detection and line-wise redaction of environment files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import COMMON_VARIABLES, SECRET_KEYWORDS
from .detect import redact_each

SAMPLE = 512


def lines(text: Column) -> Column:
    """Lines without their ends; a closing line end opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"))


def env_score(text: Column) -> Column:
    """How much a text looks like NAME=value lines, from 0 to 1."""
    found = lines(text)
    equals = F.size(F.filter(found, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith(";") & x.contains("=")))
    name = lambda x: F.upper(F.substring_index(F.ltrim(x), "=", 1))
    keyword = F.size(F.filter(found, lambda x: name(x).rlike("|".join(SECRET_KEYWORDS))))
    common = F.size(F.filter(found, lambda x: F.ltrim(x).rlike("^(?:" + "|".join(COMMON_VARIABLES) + ")") & x.contains("=")))
    share = lambda n: F.when(equals > 0, F.least(n / equals * 0.8, F.lit(1.0))).otherwise(0.0)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.least(0.3 * equals / F.size(found) + 0.5 * share(keyword) + 0.2 * share(common), F.lit(1.0)))


def format_of(text: Column) -> Column:
    """binary, env or text, by the first bytes: a NUL or more than 30 % unprintable bytes are binary, a score of 0.45 or more is env."""
    head = F.left(text, F.lit(SAMPLE))
    printable = F.length(F.regexp_replace(head, r"[^\x20-\x7E\t\n\r]", ""))
    odd = (F.octet_length(head) - printable) / F.greatest(F.octet_length(head), F.lit(1))
    return F.when(head.contains("\x00") | (odd > 0.3), "binary").when(env_score(head) >= 0.45, "env").otherwise("text")


def split_line(line: Column) -> Column:
    """struct(key, separator, value) of a line: at the first =, else at the first : that is neither first nor last nor part of ://."""
    at = F.instr(line, "=")
    colon = F.instr(line, ":")
    usable = (colon > 1) & (colon < F.length(line)) & ~((F.substring(line, colon - 1, F.lit(1)) == "/") & (F.substring(line, colon + 1, F.lit(1)) == "/"))
    place = F.when(at > 0, at).when(usable, colon).otherwise(0)
    return F.struct(
        F.when(place > 0, F.trim(F.substring(line, F.lit(1), place - 1))).alias("key"), F.when(place > 0, F.substring(line, place, F.lit(1))).alias("separator"),
        F.when(place > 0, F.trim(F.substring(line, place + 1, F.length(line)))).otherwise(line).alias("value"),
    )


def _redacted(df: DataFrame, text_col: str, out_col: str, by_line: Column) -> DataFrame:
    """Texts redacted as lists of what is scanned by itself: the values of their lines, or the text as a whole."""
    given = df.withColumn("_hf_parts", F.when(by_line, F.transform(lines(F.col(text_col)), split_line)))
    given = given.withColumn("_hf_values", F.when(by_line, F.transform("_hf_parts", lambda s: s["value"])).otherwise(F.array(F.col(text_col))))
    done = redact_each(given, "_hf_values", "_hf_clean")
    line = lambda s, v: F.concat(F.coalesce(s["key"], F.lit("")), F.coalesce(s["separator"], F.lit("")), v, F.lit("\n"))
    out = F.when(by_line, F.array_join(F.zip_with("_hf_parts", "_hf_clean", line), "")).otherwise(F.get("_hf_clean", F.lit(0)))
    return done.withColumn(out_col, out).drop("_hf_parts", "_hf_values", "_hf_clean")


def redact_env(df: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """Add the text with every line's value redacted by itself: key and separator stay, each line gets a line end. Every row stays a row; null stays
    null and an empty text has no line."""
    return _redacted(df, text_col, out_col, F.lit(True))


def redact_auto(df: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """Add ``format`` and the text redacted as that: environment files line by line, all else as one text."""
    return _redacted(df.withColumn("format", format_of(F.col(text_col))), text_col, out_col, F.col("format") == "env")
