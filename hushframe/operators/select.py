"""Selectors: which patterns or tiers are detected or redacted, as predicates over catalog or match columns."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import MARKERS

TIER_NAMES = ("CRITICAL", "API_KEYS", "INFRASTRUCTURE", "SERVICES", "PATTERNS")
TYPES = {"fast": "fast", "fastprefix": "fast", "structured": "structured", "structuredformat": "structured", "regex": "regex", "regexbased": "regex"}


def glob_regex(glob: str, question: bool = True) -> str:
    """An anchored pattern for a glob: * is any run, ? one character."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" and question else re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in glob) + r"\z"


def glob(name: Column, pattern: str, question: bool = True) -> Column:
    return name.rlike(glob_regex(pattern, question))


def simple_glob(name: Column, pattern: str, middle: bool = True) -> Column:
    """The configuration's globs: *, prefix*, *suffix and, with ``middle``, prefix*suffix; anything else is exact."""
    if pattern == "*":
        return F.lit(True)
    if pattern.endswith("*") and "*" not in pattern[:-1]:
        return name.startswith(pattern[:-1])
    if pattern.startswith("*") and "*" not in pattern[1:]:
        return name.endswith(pattern[1:])
    if middle and pattern.count("*") == 1:
        first, last = pattern.split("*")
        return name.startswith(first) & name.endswith(last)
    return name == pattern


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


@dataclass(frozen=True)
class Selector:
    """kind: all, none, type, tiers, patterns, tags, wildcard or regex, with its values."""

    kind: str
    values: tuple[str, ...] = ()

    @staticmethod
    def parse(spec: str) -> Selector:
        """From text such as ``all``, ``CRITICAL,API_KEYS``, ``type:fast``, ``wildcard:aws-*``; a bare list of globs selects patterns."""
        low = spec.lower()
        if low in ("all", "none"):
            return Selector(low)
        bare = [p.strip() for p in low.split(",")]
        if all(p in TYPES for p in bare):
            return Selector("type", tuple(TYPES[p] for p in bare))
        head, colon, rest = low.partition(":")
        listed = tuple(p.strip() for p in rest.split(","))
        if colon and head == "type":
            return Selector("type", listed)
        known = tuple(p.upper() for p in (listed if colon and head == "tier" else bare) if p.upper() in TIER_NAMES)
        if known and (head == "tier" or not colon):
            return Selector("tiers", known)
        if colon and head in ("patterns", "tags"):
            return Selector(head, listed)
        if colon and head in ("wildcard", "regex"):
            return Selector(head, (rest,))
        if not colon and any(c in low for c in "*?"):
            return Selector("patterns", tuple(bare))
        raise ValueError(f"no selector: {spec!r}")

    def matches(self, name: Column, tier: Column, tags: Column | None = None) -> Column:
        """Over pattern metadata. A type selects everything, as all detectors are of all types here; a regex selects nothing by itself."""
        if self.kind in ("all", "type"):
            return F.lit(True)
        if self.kind == "tiers":
            return tier.isin(*self.values)
        if self.kind in ("patterns", "wildcard"):
            return _any([glob(name, v) for v in self.values])
        if self.kind == "tags" and tags is not None:
            return _any([F.exists(tags, lambda t: t.rlike(glob_regex(v, question=False)) if v.endswith("*") else t == v) for v in self.values])  # noqa: B023 - called at once
        return F.lit(False)

    def matches_tier(self, tier: Column) -> Column:
        """Over a match of which only the tier is known: other kinds than none and tiers let it pass."""
        if self.kind == "none":
            return F.lit(False)
        return tier.isin(*self.values) if self.kind == "tiers" else F.lit(True)


    def tiers(self) -> tuple[str, ...]:
        """The tiers of which matches pass."""
        return () if self.kind == "none" else tuple(t for t in TIER_NAMES if t in self.values) if self.kind == "tiers" else TIER_NAMES

    def describe(self) -> str:
        """The selector in words."""
        listed = ", ".join(self.values)
        return {"all": "all", "none": "none", "wildcard": f"wildcard {listed}", "regex": f"regex {listed}"}.get(self.kind, f"{self.kind} {listed}")


ALL = Selector("all")
#: What is detected and redacted unless said otherwise.
DEFAULT = Selector("tiers", ("CRITICAL", "API_KEYS"))


def resolve(flag: str | None = None, env: Mapping[str, str] | None = None, variable: str = "DETECT_PATTERNS", default: str = "ALL") -> Selector:
    """The selector of a flag, else of a variable of the environment, else the default. One that cannot be read is an error, never another selector."""
    env = os.environ if env is None else env
    spec = flag if flag is not None else env.get(variable, default)
    try:
        return Selector.parse(spec)
    except ValueError as wrong:
        raise ValueError(f"{variable}: {wrong}; tiers are {', '.join(TIER_NAMES)}, others patterns:<globs>, wildcard:<glob>, regex:<pattern>") from wrong


def resolve_names(names: DataFrame, globs: list[str], col: str = "name") -> DataFrame:
    """(name, place): the different names that globs select, each at the first glob that fits, then in the table's own order (column ``place``)."""
    fits = F.array(*[F.when(glob(F.col(col), g), i) for i, g in enumerate(globs)]) if globs else F.array().cast("array<int>")
    first = F.array_min(F.array_compact(fits))
    found = names.select(F.col(col).alias("name"), F.col("place").alias("own"), first.alias("first")).where("first IS NOT NULL")
    return found.groupBy("name").agg(F.min(F.struct("first", "own")).alias("place"))


@dataclass(frozen=True)
class Composite:
    """Included and excluded filters: ``CRITICAL,aws-*,!aws-asia``. Exclusions come first; without an inclusion it is an error."""

    include: tuple[tuple[str, str], ...]
    exclude: tuple[tuple[str, str], ...]

    @staticmethod
    def parse(spec: str) -> Composite:
        include, exclude = [], []
        for part in filter(None, (p.strip() for p in spec.split(","))):
            if part.startswith("!") or part.startswith("exclude:"):
                exclude.append(("glob", part.removeprefix("!").removeprefix("exclude:")))
            elif part.upper() in TIER_NAMES:
                include.append(("tier", part.upper()))
            elif part.upper() == "ALL":
                include.append(("glob", "*"))
            else:
                include.append(("glob", part))
        if not include:
            raise ValueError(f"nothing is included: {spec!r}")
        return Composite(tuple(include), tuple(exclude))

    def matches(self, name: Column, tier: Column) -> Column:
        one = lambda f: tier == f[1] if f[0] == "tier" else glob(name, f[1])
        return ~_any([one(f) for f in self.exclude]) & _any([one(f) for f in self.include])


@dataclass(frozen=True)
class KeepFilter:
    """The policy's filter: what a keep glob matches stays, else what a redact glob matches is redacted."""

    redact: tuple[str, ...] = ("*",)
    keep: tuple[str, ...] = field(default=())

    def matches(self, name: Column) -> Column:
        return ~_any([simple_glob(name, g) for g in self.keep]) & _any([simple_glob(name, g) for g in self.redact])

    def merge(self, other: KeepFilter) -> KeepFilter:
        return KeepFilter(tuple(dict.fromkeys(self.redact + other.redact)), tuple(dict.fromkeys(self.keep + other.keep)))


#: Severities with their scores, from the worst; kinds of services; kinds of patterns. Fixed values.
SEVERITIES = (("CRITICAL", 95), ("HIGH", 85), ("MEDIUM", 65), ("LOW", 40), ("GENERIC", 30))
CATEGORIES = ("CloudProvider", "PaymentProcessor", "CodeHost", "Database", "Messaging", "Infrastructure", "Authentication", "Monitoring", "Development", "AI", "Other")
KINDS = ("FixedPrefix", "StructuredFormat", "RegexBased")


def severity(spec: Column) -> Column:
    """struct(name, score, redacted by default) of a severity's name, in any case, or its score; null for others."""
    out = None
    for name, score in SEVERITIES:
        test = F.upper(F.trim(spec)).isin(name, str(score))
        value = F.struct(F.lit(name).alias("name"), F.lit(score).alias("score"), F.lit(score >= 85).alias("redacted"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _member(spec: Column, names: Sequence[str]) -> Column:
    out = None
    for name in names:
        test = F.replace(F.lower(F.trim(spec)), F.lit("-"), F.lit("")) == name.lower()
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def category(spec: Column) -> Column:
    """The service category of a name in any case, with or without hyphens; null for others."""
    return _member(spec, CATEGORIES)


def pattern_kind(spec: Column) -> Column:
    """The pattern kind of a name, in the same way."""
    return _member(spec, KINDS)


def parsed_list(spec: Column, one: Callable[[Column], Column]) -> Column:
    """Every part of a comma-separated list by ``severity``, ``category`` or ``pattern_kind``; null as a whole if any part is none."""
    found = F.transform(F.split(spec, ","), one)
    return F.when(F.forall(found, lambda x: x.isNotNull()), found)


def marker_candidates(text: Column, at: Column, fuzzy: bool = False) -> Column:
    """Places in the catalog of the block markers that may begin at a place (from 0) of a text: those whose first 16 characters stand there, or with
    ``fuzzy``, if there are none, those of the first marker by name whose first 8 do. Null if fewer than 8 characters are left."""
    starts = [f"-----BEGIN {label}-----" for _, label, _, _ in MARKERS]
    heads: dict[str, list[int]] = {}
    for i, s in enumerate(starts):
        heads.setdefault(s[:16], []).append(i)
    here, short = F.substring(text, at + 1, F.lit(16)), F.substring(text, at + 1, F.lit(8))
    out = None
    for test, key in [(here == h, h) for h in heads] + ([(short == h[:8], min(k for k in heads if k[:8] == h[:8])) for h in heads] if fuzzy else []):
        value = F.array(*[F.lit(i) for i in heads[key]])
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.when(F.length(text) - at >= 8, out)


def first_prefix(text: Column, prefix: str) -> Column:
    """The first place of a prefix, from 0; 0 for an empty one, null if there is none."""
    return F.lit(0) if not prefix else F.nullif(F.instr(text, prefix) - 1, F.lit(-1))


def should_redact(name: Column, mode: str, names: tuple[str, ...] = ()) -> Column:
    """Exact-name selection: all, none, whitelist or blacklist."""
    return {"all": F.lit(True), "none": F.lit(False), "whitelist": name.isin(*names), "blacklist": ~name.isin(*names)}[mode]


def with_tier(df: DataFrame, names: DataFrame, col: str = "name") -> DataFrame:
    """Add ``tier`` by name from a table (name, tier): exact, else without case, else PATTERNS. Both are equi-joins."""
    exact = names.groupBy(F.col("name").alias("_n")).agg(F.min("tier").alias("_exact"))
    loose = names.groupBy(F.lower("name").alias("_l")).agg(F.min("tier").alias("_loose"))
    return df.join(exact, F.col(col) == F.col("_n"), "left").join(loose, F.lower(col) == F.col("_l"), "left").withColumn("tier", F.coalesce("_exact", "_loose", F.lit("PATTERNS"))).drop("_n", "_l", "_exact", "_loose")


def by_type(catalog: DataFrame) -> DataFrame:
    """Patterns by type: counts and names in order."""
    kind = F.when(F.col("kind").isin("simple", "validated"), "fast").when(F.col("kind") == "jwt", "structured").otherwise("regex")
    return catalog.groupBy(kind.alias("type")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def describe(catalog: DataFrame, name: str) -> DataFrame:
    """The first pattern of a name."""
    rows = catalog.where(F.col("name") == name)
    return rows.groupBy("name").agg(*[F.min_by(c, "pattern_type").alias(c) for c in catalog.columns if c not in ("name", "pattern_type")], F.min("pattern_type").alias("pattern_type"))
