"""Policies: which rule holds for a host or a header, and what it does. Rules are configuration, so they become expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .select import glob, simple_glob

HOP_BY_HOP = ("connection", "transfer-encoding", "upgrade", "te", "trailer", "proxy-authenticate", "proxy-authorization")
#: The default rules. Fixed values.
DEFAULT_HEADERS = (("Authorization", "replace"), ("*", "redact"))
ACTIONS = ("replace", "redact", "detect", "passthrough")


def header_action(header: Column, rules: tuple[tuple[str, str], ...] = DEFAULT_HEADERS) -> Column:
    """The action for a header's name, without case: of the exact rule, else of the longest prefix*, else of *, else redact."""
    name = F.lower(header)
    order = sorted(rules, key=lambda r: (0 if not r[0].endswith("*") else 2 if r[0] == "*" else 1, -len(r[0]), r[0].lower()))
    out = None
    for pattern, action in order:
        low = pattern.lower()
        test = name.startswith(low[:-1]) if low.endswith("*") else name == low
        out = F.when(test, action) if out is None else out.when(test, action)
    return F.lit("redact") if out is None else out.otherwise("redact")


def host_policy(host: Column, patterns: list[str]) -> Column:
    """The pattern that holds for a host: the longest that fits, of equal ones the first by name; else default."""
    out = None
    for p in sorted(patterns, key=lambda p: (-len(p), p)):
        test = simple_glob(host, p)
        out = F.when(test, p) if out is None else out.when(test, p)
    return F.lit("default") if out is None else out.otherwise("default")


def allowed(host: Column, globs: list[str], enabled: bool = True) -> Column:
    """Whether traffic to a host is let through: always where the policy is off."""
    return F.lit(True) if not enabled else reduce(lambda a, b: a | b, [simple_glob(host, g) for g in globs], F.lit(False))


def hop_by_hop(header: Column) -> Column:
    return F.lower(header).isin(*HOP_BY_HOP)


def merge_rules(base: tuple[tuple[str, str], ...], override: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """Rules of both; of equal patterns the override's."""
    return tuple((dict(base) | dict(override)).items())


def merge_host_rules(own: tuple[tuple[str, str], ...], defaults: tuple[tuple[str, str], ...] = DEFAULT_HEADERS) -> tuple[tuple[str, str], ...]:
    """A host's rules over the defaults: none of its own means the defaults, a * of its own means its own alone, else both."""
    return defaults if not own else own if "*" in dict(own) else merge_rules(defaults, own)


def counts_by_action(resolved: DataFrame, *keys: str) -> DataFrame:
    """How many headers met each action, by the keys."""
    return resolved.groupBy(*keys).agg(*[F.sum((F.col("action") == a).cast("long")).alias(f"n_{a}") for a in ACTIONS])


def should(mode: Column) -> tuple[Column, Column]:
    """(detect, redact) of a mode: passthrough, detect-only or redact."""
    return mode.isin("detect-only", "redact"), mode == "redact"


def path_rule(path: Column, rules: Sequence[tuple[str, bool]], default: bool = True) -> Column:
    """Whether a path is redacted: as the first rule (glob with *, redact) says that fits, else the default. A rule needs a path."""
    if any(not glob_ for glob_, _ in rules):
        raise ValueError("a path rule has no path")
    out = None
    for pattern, redacted in rules:
        test = glob(path, pattern, question=False)
        out = F.when(test, redacted) if out is None else out.when(test, redacted)
    return F.lit(default) if out is None else out.otherwise(default)
