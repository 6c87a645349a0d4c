"""Detection and redaction over a text column, and the engine that selects what is reported and what is redacted.

Rows go to the kernel as Arrow batches, once, whether they have matches or not; there is no shuffle. The row gate, a native superset of all that the
detectors accept, is for callers whose rows are mostly short and clean: Spark then evaluates it first and only rows that pass reach Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel
from ..sources.catalog import DEFAULT_TABLE, SIMPLE, TIERS, URIS, Validated, live, live_simple, validated
from .select import ALL, Selector

MATCH = {"detector": "string", "pattern_idx": "int", "pattern_type": "int", "name": "string", "start": "int", "end": "int", "byte_start": "int", "byte_end": "int", "matched": "string", "redacted": "string"}
_ARROW = {"string": pa.string(), "int": pa.int32()}


def tier_of(pattern_type: Column) -> Column:
    """The tier that an id is reported under, by its hundreds."""
    return F.when(pattern_type < 100, "CRITICAL").when(pattern_type < 200, "API_KEYS").when(pattern_type < 300, "PATTERNS").when(pattern_type < 400, "INFRASTRUCTURE").otherwise("SERVICES")


def gate(text: Column, table: str = DEFAULT_TABLE) -> Column:
    """False only for texts without any match."""
    rows = live(validated(table))
    least = min((v.min_len for v in rows if v.charset != "ANY"), default=1)
    loose = sorted({v.prefix for v in rows if v.charset == "ANY" or v.min_len < 1})
    fixed = sorted({p for _, p in live_simple()} | set(loose) | {"eyJ"})
    alternatives = "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", p) for p in fixed)
    return text.rlike(f"[A-Za-z0-9_+/=-]{{{least}}}|{alternatives}") | text.contains("-----BEGIN ") | text.contains("://")


def tier_name(pattern_type: int) -> str:
    """The same for one id."""
    return ("CRITICAL", "API_KEYS", "PATTERNS", "INFRASTRUCTURE", "SERVICES")[min(pattern_type // 100, 4)]


def _name(detector: str, idx: int, rows: tuple[Validated, ...]) -> str:
    if detector == "simple":
        return SIMPLE[idx][0]
    if detector == "validated":
        return rows[idx].name
    if detector == "marker":
        return kernel.MARKERS[idx][0]
    return URIS[idx][0] if detector == "uri" else "jwt-generic"


def _finder(detector: str, rows: tuple[Validated, ...], strict: bool = True, skip_placeholders: bool = False) -> Callable[[str], list[kernel.Match]]:
    return {
        "all": lambda t: kernel.detect(t, rows, strict, skip_placeholders), "simple": lambda t: kernel.simple_prefix(t, rows), "validated": lambda t: kernel.validated_prefix(t, rows),
        "jwt": kernel.jwt, "marker": lambda t: kernel.markers(t, strict), "uri": kernel.uris,
    }[detector]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _added(df: DataFrame, *more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], *more])


def matches(df: DataFrame, text_col: str = "text", detector: str = "all", table: str = DEFAULT_TABLE, strict: bool = True, skip_placeholders: bool = False, gated: bool = False) -> DataFrame:
    """A row for each match: the input's other columns, then detector, pattern, span in code points and bytes, matched and redacted text, tier.

    ``detector``: all (overlaps removed), or one of simple, validated, jwt, marker, uri by itself. An input column that has the name of an added one
    is called ``<name>_in``. Null and empty texts have no match."""
    own = {f.name: f"{f.name}_in" if f.name in MATCH or f.name == "tier" else f.name for f in df.schema if f.name != text_col}
    rows = validated(table)
    given = df.where(gate(F.col(text_col), table)) if gated else df
    given = given.select(*[F.col(f"`{a}`").alias(b) for a, b in own.items()], F.col(f"`{text_col}`").alias("_hf_text"))
    schema = _added(given.drop("_hf_text"), *[f"`{n}` {k}" for n, k in MATCH.items()])
    find = _finder(detector, rows, strict, skip_placeholders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row: list[int] = []
            out: list[list] = [[] for _ in MATCH]
            for i, text in enumerate(_column(batch, "_hf_text").to_pylist()):
                found = find(text) if text else ()
                if not found:
                    continue
                at = kernel.byte_places(text, {x for m in found for x in m[:2]})
                for start, end, kind, which, idx in found:
                    part = text[start:end]
                    row.append(i)
                    for c, v in zip(out, (which, idx, kind, _name(which, idx, rows), start, end, at[start], at[end], part, kernel.redact_match(part, kind)), strict=True):
                        c.append(v)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([_column(batch, n).take(at) for n in own.values()] + [pa.array(c, _ARROW[k]) for c, k in zip(out, MATCH.values(), strict=True)], names=[*own.values(), *MATCH])

    return given.mapInArrow(run, schema).withColumn("tier", tier_of(F.col("pattern_type")))


def counts(df: DataFrame, text_col: str = "text", out_col: str = "n_matches", detector: str = "all", table: str = DEFAULT_TABLE) -> DataFrame:
    """Add the number of matches to every row, in one pass."""
    find = _finder(detector, validated(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(find(t)) if t else 0 for t in _column(batch, text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int32())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(run, _added(df, f"`{out_col}` int"))


def _redactor(text_col: str, rows: tuple[Validated, ...], chosen: Callable[[int], bool]) -> Callable[[pa.RecordBatch], tuple[pa.Array, list[list[kernel.Match]]]]:
    """For a batch: the redacted texts and all matches of each text. A batch without anything to redact keeps its column as it is."""

    def run(batch: pa.RecordBatch) -> tuple[pa.Array, list[list[kernel.Match]]]:
        column = _column(batch, text_col)
        texts = column.to_pylist()
        found = [kernel.detect(t, rows) for t in texts]
        changed = False
        for i, every in enumerate(found):
            if every and (some := [m for m in every if chosen(m[2])]):
                texts[i], changed = kernel.redact(texts[i], some), True
        return (pa.array(texts, pa.string()) if changed else column.cast(pa.string())), found

    return run


def redact(df: DataFrame, text_col: str = "text", out_col: str = "redacted", tiers: tuple[str, ...] | None = None, enabled: bool = True, table: str = DEFAULT_TABLE) -> DataFrame:
    """Add the redacted text and ``n_matches``, the number of matches that were redacted, in one pass.

    ``tiers`` selects what is redacted after detection and overlap removal, as selecting earlier would change which of two
    overlapping matches counts. Null stays null. Input columns of the added names are replaced."""
    if not enabled:
        return df.withColumns({out_col: F.col(text_col), "n_matches": F.lit(0)})
    wanted = {t.upper() for t in (tiers if tiers is not None else [t for t, *_ in TIERS])}
    chosen = lambda kind: tier_name(kind) in wanted
    run_one = _redactor(text_col, validated(table), chosen)
    own = [n for n in df.columns if n not in (out_col, "n_matches") or n == text_col]
    given = df.select(*[F.col(f"`{n}`") for n in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = run_one(batch)
            n = [sum(chosen(m[2]) for m in every) for every in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, texts, pa.array(n, pa.int32())], names=[*batch.schema.names, out_col, "n_matches"])

    return given.mapInArrow(run, _added(given, f"`{out_col}` string", "n_matches int"))


def redact_each(df: DataFrame, list_col: str, out_col: str = "redacted", tiers_col: str | None = None, table: str = DEFAULT_TABLE) -> DataFrame:
    """For a column of lists of texts: a list with every text redacted by itself and, if wanted, one with the tiers of each text's matches. Lists are
    not exploded, so nothing is shuffled; null lists and null texts stay null."""
    rows = validated(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, tiers = [], []
            for given in _column(batch, list_col).to_pylist():
                found = None if given is None else [kernel.detect(t, rows) for t in given]
                texts.append(given if not found else [kernel.redact(t, f) if f else t for t, f in zip(given, found, strict=True)])
                tiers.append(found if found is None else [[tier_name(m[2]) for m in f] for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.list_(pa.string())), pa.array(tiers, pa.list_(pa.list_(pa.string())))], names=[*batch.schema.names, out_col, "_hf_tiers"])

    done = df.mapInArrow(run, _added(df, f"`{out_col}` array<string>", "`_hf_tiers` array<array<string>>"))
    return done.withColumnRenamed("_hf_tiers", tiers_col) if tiers_col else done.drop("_hf_tiers")


@dataclass(frozen=True)
class Engine:
    """What is reported and what is redacted, selected apart from each other. Everything is detected first; selectors then go by tier."""

    detect: Selector = ALL
    redact: Selector = ALL
    table: str = DEFAULT_TABLE

    def describe(self) -> str:
        return f"Detect: {self.detect.describe()}, Redact: {self.redact.describe()}"

    def detect_only(self, df: DataFrame, *keys: str, text_col: str = "text") -> DataFrame:
        """(keys, tier, cnt): matches by tier, of the tiers that the detect selector takes."""
        found = matches(df.select(*keys, text_col), text_col, table=self.table)
        return warnings(found.where(self.detect.matches_tier(F.col("tier"))), *keys)

    def redact_only(self, df: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
        return redact(df, text_col, out_col, self.redact.tiers(), table=self.table)

    def detect_and_redact(self, df: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
        """Both in one pass: the redacted text, the number of matches redacted, and ``warnings``, a map from tier to the number of matches found in
        it, of the tiers that are reported. A row without a match has an empty map, also where its text is null."""
        redacted, reported = set(self.redact.tiers()), set(self.detect.tiers())
        chosen = lambda kind: tier_name(kind) in redacted
        run_one = _redactor(text_col, validated(self.table), chosen)
        own = [n for n in df.columns if n not in (out_col, "n_matches", "warnings") or n == text_col]
        given = df.select(*[F.col(f"`{n}`") for n in own])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, found = run_one(batch)
                n, told = [], []
                for every in found:
                    seen: dict[str, int] = {}
                    for m in every:
                        seen[tier_name(m[2])] = seen.get(tier_name(m[2]), 0) + 1
                    n.append(sum(c for t, c in seen.items() if t in redacted))
                    told.append(sorted((t, c) for t, c in seen.items() if t in reported))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts, pa.array(n, pa.int32()), pa.array(told, pa.map_(pa.string(), pa.int64()))], names=[*batch.schema.names, out_col, "n_matches", "warnings"])

        return given.mapInArrow(run, _added(given, f"`{out_col}` string", "n_matches int", "warnings map<string,bigint>"))


def warnings(found: DataFrame, *keys: str) -> DataFrame:
    """Matches by document (or other keys) and tier."""
    return found.groupBy(*keys, "tier").agg(F.count(F.lit(1)).alias("cnt"))


def redact_rule(matched: Column, pattern_type: Column) -> Column:
    """The kernel's redaction of a matched text as a native expression."""
    fill = lambda s: F.repeat(F.lit("x"), F.octet_length(s))
    at = F.instr(matched, "=")
    value = F.substring(matched, at + 1, F.length(matched))
    rest = lambda s: F.substring(s, F.lit(5), F.length(s))
    return (
        F.when(at > 0, F.concat(F.substring(matched, F.lit(1), at), F.left(value, F.lit(4)), fill(rest(value))))
        .when(pattern_type >= 300, fill(matched))
        .otherwise(F.concat(F.left(matched, F.lit(4)), fill(rest(matched))))
    )


def simple_tokens(text: Column) -> Column:
    """The simple detector's tokens as a native expression: a run of token characters, capped, from a prefix on."""
    return F.regexp_extract_all(text, F.lit("(?=(?:" + "|".join(re.sub(r"([^A-Za-z0-9_])", r"\\\1", p) for _, p in live_simple()) + "))[A-Za-z0-9_-]{1,256}"), F.lit(0))


def redact_uri(uri: Column, credential: Column) -> Column:
    """A URI without its credentials: the password before the last @, or the last path segment."""
    password = F.regexp_replace(uri, r"(?s)^(.*:)[^:]*(@[^@]*)$", r"$1[REDACTED]$2")
    token = F.when(uri.contains("/"), F.regexp_replace(uri, r"(?s)^(.*/)[^/]*$", r"$1[REDACTED]")).otherwise("[REDACTED]")
    after_colon = F.regexp_replace(uri, r"(?s)^([^:]*:)[^ ]*( .*)$", r"$1[REDACTED]$2")
    return F.when(credential == "UserPasswordAtHost", password).when(credential == "TokenOnly", token).otherwise(after_colon)
