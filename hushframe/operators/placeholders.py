"""Placeholders for secrets: generated from names and a seed, put in for secrets and back."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import PLACEHOLDER_MARK


def prefix(value: Column) -> Column:
    """The part of a secret that its placeholder keeps: one or two parts of 1 to 4 bytes before - or _, else four capitals, else up to four
    bytes before a dot. Two parts are both followed by the first separator."""
    first = F.regexp_extract(value, "^([^_-]*)[_-]", 1)
    sep = F.regexp_extract(value, "^[^_-]*([_-])", 1)
    second = F.regexp_extract(value, "^[^_-]*[_-]([^_-]*)[_-]", 1)
    short = lambda c: F.octet_length(c).between(1, 4)
    dot = F.regexp_extract(value, r"(?s)^([^.]*)\.", 1)
    return (
        F.when(short(first) & short(second), F.concat(first, sep, second, sep))
        .when(short(first), F.concat(first, sep))
        .when(value.rlike("^[A-Z]{4}"), F.left(value, F.lit(4)))
        .when(short(dot), F.concat(dot, F.lit(".")))
        .otherwise("")
    )


def placeholder(name: Column, value: Column, seed: str, mark: str = PLACEHOLDER_MARK) -> Column:
    """prefix + mark + the hash of name and seed, repeated or cut so that the length is the secret's (or longer, for very short ones)."""
    kept = prefix(value)
    n = F.octet_length(value) - F.octet_length(kept) - len(mark)
    digest = F.sha2(F.concat(name, F.lit(seed)).cast("binary"), 256)
    return F.concat(kept, F.lit(mark), F.left(F.repeat(digest, F.greatest(F.ceil(n / 64).cast("int"), F.lit(1))), F.greatest(n, F.lit(0))))


def generate(secrets: DataFrame, seed: str) -> DataFrame:
    """(name, value, placeholder, prefix) for (name, value)."""
    return secrets.select("name", "value", placeholder(F.col("name"), F.col("value"), seed).alias("placeholder"), prefix(F.col("value")).alias("prefix"))


def collisions(secrets: DataFrame) -> DataFrame:
    """Values that several names share."""
    return secrets.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")).where("n > 1")


def is_placeholder(value: Column) -> Column:
    return value.contains(PLACEHOLDER_MARK)


def substitute(text: Column, pairs: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(text with every first replaced by its second, number of replacements), in one pass from the left; of strings that begin at one place the
    longest counts, and what was put in is not looked at again. ``pairs`` is a driver-side list, so of the size of a configuration."""
    known = {old: new for old, new in pairs if old}
    if not known:
        return text, F.when(text.isNotNull(), F.lit(0))
    pattern = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", old) for old in sorted(known, key=lambda x: (-len(x), x)))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    out = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, x: F.concat(g, F.element_at(table, x))), ""), F.element_at(gaps, -1))
    return out, F.size(found)


def substitute_tracked(text: Column, tracker: Column) -> tuple[Column, Column]:
    """(text with the tracker's keys, secrets, replaced by their values, placeholders; number of secrets that were there). Longer ones go first."""
    entries = F.reverse(F.array_sort(F.transform(F.map_entries(tracker), lambda e: F.struct(F.length(e["key"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))))
    out = F.aggregate(entries, text, lambda t, e: F.replace(t, e["key"], e["value"]))
    return F.coalesce(out, text), F.coalesce(F.size(F.filter(F.map_keys(tracker), lambda k: text.contains(k))), F.lit(0))


def substitute_by_host(messages: DataFrame, pairs: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Replace, in each message, the placeholders that its host may use: ``pairs`` has host, placeholder and value.

    The pairs of a host are one map, joined by host; a text is folded over it."""
    maps = pairs.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("placeholder")).alias("n"), "placeholder", "value"))).alias("_pairs")).withColumnRenamed("host", "_host")
    folded = F.aggregate(F.coalesce("_pairs", F.array().cast("array<struct<n:int,placeholder:string,value:string>>")), F.col(text_col), lambda t, p: F.replace(t, p["placeholder"], p["value"]))
    return messages.join(maps, F.col("host") == F.col("_host"), "left").withColumn(out_col, folded).drop("_pairs", "_host")


def validate(value: Column, mode: str = "fail") -> tuple[Column, Column]:
    """(what is wrong, or null; the value to use). NUL, CR, LF and DEL are dangerous in a header: fail gives no value, warn the same value, and
    sanitize the value without them."""
    tests = {"NUL": value.contains("\x00"), "CR": value.contains("\r"), "LF": value.contains("\n"), "DEL": value.contains("\x7f")}
    n = sum((t.cast("int") for t in tests.values()), F.lit(0))
    wrong = F.when(n > 1, "MULTIPLE")
    for name, t in tests.items():
        wrong = wrong.when(t, name)
    clean = F.translate(value, "\x00\r\n\x7f", "")
    return wrong, {"fail": F.when(n == 0, value), "warn": value, "sanitize": clean}[mode]


def render(placeholders: DataFrame, accept_json: bool = False) -> DataFrame:
    """The discovery answer: NAME=placeholder lines in order, or a JSON object."""
    rows = placeholders.agg(F.array_sort(F.collect_list(F.struct("name", "placeholder"))).alias("p"))
    text = F.concat(F.array_join(F.transform("p", lambda x: F.concat(x["name"], F.lit("="), x["placeholder"])), "\n"), F.lit("\n"))
    return rows.select((F.to_json(F.map_from_entries("p")) if accept_json else text).alias("body"))


def discovery(requests: DataFrame, placeholders: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Adds ``status`` and ``answer`` for requests to the discovery endpoint: 400 for a line of fewer than two words, 405 for another method than
    GET, 404 for another path than /placeholders..., else 200 with the list, as JSON where an Accept header asks for it. ``placeholders`` is a
    configuration's (name, placeholder), one row of text when rendered."""
    raw = F.regexp_replace(F.col(raw_col), "\r", "")
    words = F.filter(F.split(F.substring_index(raw, "\n", 1), r"\s+"), lambda w: w != "")
    accepts = F.exists(F.split(raw, "\n"), lambda x: F.lower(x).startswith("accept:") & F.lower(x).contains("application/json"))
    text, json = (render(placeholders, j).select(F.col("body").alias(n)) for j, n in ((False, "_hf_text"), (True, "_hf_json")))
    status = F.when(F.size(words) < 2, 400).when(F.get(words, F.lit(0)) != "GET", 405).when(~F.get(words, F.lit(1)).startswith("/placeholders"), 404).otherwise(200)
    both = requests.withColumns({"status": status, "_hf_accepts": accepts}).crossJoin(F.broadcast(text)).crossJoin(F.broadcast(json))  # one row each
    return both.withColumn("answer", F.when(F.col("status") == 200, F.when(F.col("_hf_accepts"), F.col("_hf_json")).otherwise(F.col("_hf_text")))).drop("_hf_accepts", "_hf_text", "_hf_json")
