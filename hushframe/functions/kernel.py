"""The detection kernel: all five detectors over one text, in code points.

Prefixes are found by an Aho-Corasick automaton. Of overlapping hits the one that ends first counts (of those that end together the
longest), and the search goes on at its end, whether or not a token is accepted there."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick

from ..sources.catalog import CHARSETS, MARKERS, PLACEHOLDER_MARK, SIMPLE, URIS, Validated, validated

Match = tuple[int, int, int, str, int]  # start, end, pattern_type, detector, place in the detector's catalog
SIMPLE_CAP, JWT_CAP, JWT_LEAST = 256, 10_000, 32
_AN = re.compile(CHARSETS["AN"] + "*")
_JWT = re.compile(r"[A-Za-z0-9_=.-]*")
_SCHEMES = [(s, i) for i, (_, s, _, _) in enumerate(URIS[:11])]
_HOOKS = [(s, 11 + i) for i, (_, s, _, _) in enumerate(URIS[11:])]
_SOLID = re.compile(r"[^ \t\n\x0b\x0c\r]*")
_RUNS = {k: re.compile(v + "*") for k, v in CHARSETS.items()}


@lru_cache(4)
def _prefixes(rows: tuple[Validated, ...]) -> ahocorasick.Automaton:
    """One automaton for both catalogs of prefixes: each has its length and its place in either, or -1."""
    simple, checked = {}, {}
    for i, (_, p, _) in enumerate(SIMPLE):
        simple.setdefault(p, i)
    for v in rows:
        checked.setdefault(v.prefix, v.idx)
    found = ahocorasick.Automaton()
    for p in {**simple, **checked}:
        found.add_word(p, (len(p), simple.get(p, -1), checked.get(p, -1)))
    found.make_automaton()
    return found


def _hits(found: list[tuple[int, tuple[int, int, int]]], which: int) -> list[tuple[int, int, int]]:
    """(start, end, pattern) of the non-overlapping hits of one catalog, in order of their ends."""
    out, resume, at = [], 0, -1
    best = None
    for end, word in found:
        i = word[which]
        if i < 0:
            continue
        if end != at and best is not None:
            out.append(best)
            resume, best = best[1], None
        at = end
        start = end + 1 - word[0]
        if start >= resume and (best is None or start < best[0]):
            best = (start, end + 1, i)
    if best is not None:
        out.append(best)
    return out


def _simple(text: str, hits: list) -> list[Match]:
    out, last = [], 0
    for start, _, i in _hits(hits, 1):
        if start >= last:
            last = _AN.match(text, start, start + SIMPLE_CAP).end()
            out.append((start, last, i, "simple", i))
    return out


def _validated(text: str, hits: list, rows: tuple[Validated, ...]) -> list[Match]:
    out, last = [], 0
    for start, token, i in _hits(hits, 2):
        if start >= last:
            v = rows[i]
            end = _RUNS[v.charset].match(text, token, token + v.max_len if v.max_len else len(text)).end()
            if end - token >= v.min_len:
                out.append((start, end, 100 + i, "validated", i))
                last = end
    return out


def simple_prefix(text: str, rows: tuple[Validated, ...] | None = None) -> list[Match]:
    return _simple(text, list(_prefixes(validated() if rows is None else rows).iter(text)))


def validated_prefix(text: str, rows: tuple[Validated, ...] | None = None) -> list[Match]:
    rows = validated() if rows is None else rows
    return _validated(text, list(_prefixes(rows).iter(text)), rows)


def jwt(text: str) -> list[Match]:
    out, at = [], text.find("eyJ")
    while at >= 0:
        end = _JWT.match(text, at + 3, at + JWT_CAP).end()
        if end - at >= JWT_LEAST and text.count(".", at, end) == 2:
            out.append((at, end, 200, "jwt", 0))
        at = text.find("eyJ", at + 3)
    return out


def markers(text: str, strict: bool = True) -> list[Match]:
    """Blocks from a BEGIN to its END marker. ``strict``: a block that begins just where another ends is passed over."""
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], data.find(b"-----BEGIN ")
    seen = [0, 0]  # the last place, in bytes and in code points

    def place(i: int) -> int:
        if len(data) == len(text):
            return i
        if i < seen[0]:
            seen[:] = 0, 0
        seen[:] = i, seen[1] + len(data[seen[0] : i].decode("utf-8", "surrogatepass"))
        return seen[1]

    while at >= 0:
        go_on = at + 1
        for i, (_, label, _, far) in enumerate(MARKERS):
            if data.startswith(f"-----BEGIN {label}-----".encode(), at):
                last = f"-----END {label}-----".encode()
                end = data.find(last, at, at + far)
                if end >= 0:
                    end += len(last)
                    end += data[end : end + 1] == b"\n"
                    out.append((place(at), place(end), 300 + i, "marker", i))
                    go_on = end + strict
                break
        at = data.find(b"-----BEGIN ", go_on)
    return out


def hits(text: str, rows: tuple[Validated, ...]) -> list[tuple[int, int]]:
    """Where prefixes of either catalog are found, whether or not a token follows."""
    found = list(_prefixes(rows).iter(text))
    return [h[:2] for which in (1, 2) for h in _hits(found, which)] if found else []


def run_pattern(m: Match, rows: tuple[Validated, ...]) -> str:
    """The characters that an open token or URI may go on with, as a pattern."""
    return (_RUNS[rows[m[4]].charset] if m[3] == "validated" else _SOLID).pattern


def open_from(text: str, rows: tuple[Validated, ...] | None = None) -> int:
    """Where the first match begins that more text could complete or lengthen; else the text's length."""
    n = first = len(text)
    rows = validated() if rows is None else rows
    for start, token, i in _hits(list(_prefixes(rows).iter(text)), 2):
        v = rows[i]
        if start < first and not (v.max_len and n - token >= v.max_len) and _RUNS[v.charset].match(text, token).end() == n:
            first = start
    at = text.find("eyJ", max(0, n - JWT_CAP))
    while 0 <= at < first:
        if _JWT.match(text, at + 3).end() == n:
            first = at
        at = text.find("eyJ", at + 3)
    at = text.find("-----BEGIN ")
    while 0 <= at < first:
        for _, label, _, far in MARKERS:
            if text.startswith(f"-----BEGIN {label}-----", at):
                last = f"-----END {label}-----"
                rest = text[at : at + far]
                end = rest.find(last)
                # its END may still come, or the line end after it
                if len(rest.encode("utf-8", "surrogatepass")) < far and (end < 0 or at + end + len(last) == n):
                    first = at
                break
        at = text.find("-----BEGIN ", at + 1)
    at = text.rfind("://")
    solid = n - len(re.search(r"[^ \t\n\x0b\x0c\r]*\Z", text)[0]) if at >= 0 else n
    while at >= 0 and at + 3 >= solid:  # a URI that goes on to the end
        for s, _ in _SCHEMES + _HOOKS:
            start = at - s.index("://")
            if 0 <= start < first and text.startswith(s[: n - start], start):
                first = start
        at = text.rfind("://", 0, at)
    return first


def uris(text: str) -> list[Match]:
    """Database schemes first, then webhooks. Every scheme and webhook holds one ://, by which it is found."""
    out: list[list[Match]] = [[], []]
    at = text.find("://")
    while at >= 0:
        for tier, known in enumerate((_SCHEMES, _HOOKS)):
            for s, i in known:
                start = at - s.index("://")
                if start >= 0 and text.startswith(s, start):
                    end = _SOLID.match(text, start + len(s)).end()
                    if len(text[start:end].encode("utf-8", "surrogatepass")) >= URIS[i][3]:
                        out[tier].append((start, end, 400 + i, "uri", i))
                    break
        at = text.find("://", at + 3)
    return out[0] + out[1]


def without_overlaps(found: list[Match]) -> list[Match]:
    """Earliest start first, of equal starts the longest, of equal spans the earlier detector; a match that begins inside a kept one goes."""
    out, last = [], 0
    for m in sorted(found, key=lambda m: (m[0], -m[1])):
        if m[0] >= last or len(found) == 1:
            out.append(m)
            last = m[1]
    return out


def raw(text: str, rows: tuple[Validated, ...], strict: bool = True) -> list[Match]:
    """What each detector finds by itself, overlaps and all."""
    hits = list(_prefixes(rows).iter(text))
    found = _simple(text, hits) + _validated(text, hits, rows) if hits else []
    if "eyJ" in text:
        found += jwt(text)
    if "-----BEGIN " in text:
        found += markers(text, strict)
    if "://" in text:
        found += uris(text)
    return found


def detect(text: str | None, rows: tuple[Validated, ...] | None = None, strict: bool = True, skip_placeholders: bool = False, mark: str = PLACEHOLDER_MARK) -> list[Match]:
    """All matches of a text; none for a null one. ``rows``: the validated catalog, by default the package's."""
    if not text:
        return []
    found = raw(text, validated() if rows is None else rows, strict)
    if len(found) > 1:
        found = without_overlaps(found)
    return [m for m in found if mark not in text[m[0] : m[1]]] if skip_placeholders else found


def byte_places(text: str, places: set[int]) -> dict[int, int]:
    """Where code points begin in UTF-8, for some of them; one walk over the text."""
    if text.isascii():
        return {i: i for i in places}
    out, last, size = {}, 0, 0
    for i in sorted(places):
        size += len(text[last:i].encode("utf-8", "surrogatepass"))
        last = i
        out[i] = size
    return out


def redact_match(text: str, pattern_type: int) -> str:
    """What a matched text becomes: after the first ``=`` four characters stay; else from type 300 on nothing does; else four characters
    do. The rest is x, one for each byte, so the length in bytes stays."""
    n = lambda s: len(s.encode("utf-8", "surrogatepass"))
    if "=" in text:
        key, _, value = text.partition("=")
        return f"{key}={value[:4]}{'x' * n(value[4:])}"
    if pattern_type >= 300:
        return "x" * n(text)
    return text[:4] + "x" * n(text[4:])


def redact(text: str, found: list[Match]) -> str:
    out, at = [], 0
    for start, end, kind, *_ in found:
        out += [text[at:start], redact_match(text[start:end], kind)]
        at = end
    return "".join([*out, text[at:]])
