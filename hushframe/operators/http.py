"""HTTP messages as text: lines, headers, bodies, hosts and locations, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HEADER = "array<struct<k:string,v:string>>"


def request_line(line: Column) -> Column:
    """struct(method, path, version) of a request line; parts that are missing are null."""
    parts = F.split(F.trim(line), " ")
    return F.struct(F.get(parts, F.lit(0)).alias("method"), F.get(parts, F.lit(1)).alias("path"), F.get(parts, F.lit(2)).alias("version"))


def response_line(line: Column) -> Column:
    """struct(version, status, reason)."""
    parts = F.split(F.trim(line), " ", 3)
    return F.struct(F.get(parts, F.lit(0)).alias("version"), F.get(parts, F.lit(1)).try_cast("int").alias("status"), F.get(parts, F.lit(2)).alias("reason"))


def path_of(line: Column) -> Column:
    """The path of a request line without its query."""
    return F.substring_index(request_line(line)["path"], "?", 1)


def headers(block: Column) -> Column:
    """The header lines of a block up to its blank line, in order, repeated ones too."""
    head = F.substring_index(block, "\r\n\r\n", 1)
    lines = F.filter(F.split(head, "\r\n"), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v")))


def header(all_: Column, name: str) -> Column:
    """The first value of a header, without case."""
    return F.get(F.filter(all_, lambda h: F.lower(h["k"]) == name.lower()), F.lit(0))["v"]


def set_header(all_: Column, name: str, value: Column) -> Column:
    """The first header of a name replaced, or the header added."""
    at = F.array_position(F.transform(all_, lambda h: F.lower(h["k"])), name.lower())
    new = F.struct(F.lit(name).alias("k"), value.alias("v"))
    return F.when(at > 0, F.transform(all_, lambda h, i: F.when(i + 1 == at, F.struct(h["k"].alias("k"), value.alias("v"))).otherwise(h))).otherwise(F.array_append(all_, new))


def remove_header(all_: Column, name: str) -> Column:
    return F.filter(all_, lambda h: F.lower(h["k"]) != name.lower())


def content_length(all_: Column) -> Column:
    return header(all_, "content-length").try_cast("long")


def is_chunked(all_: Column) -> Column:
    return F.coalesce(F.lower(header(all_, "transfer-encoding")).contains("chunked"), F.lit(False))


def keep_alive(all_: Column) -> Column:
    """Unless a header says close."""
    return F.coalesce(F.lower(header(all_, "connection")) != "close", F.lit(True))


def bodyless(status: Column) -> Column:
    """1xx, 204 and 304 have no body."""
    return status.between(100, 199) | status.isin(204, 304)


def serialize(first_line: Column, all_: Column, body: Column) -> Column:
    return F.concat(first_line, F.lit("\r\n"), F.array_join(F.transform(all_, lambda h: F.concat(h["k"], F.lit(": "), h["v"], F.lit("\r\n"))), ""), F.lit("\r\n"), F.coalesce(body, F.lit("")))


def dechunk(body: Column) -> Column:
    """The data of a body in chunked transfer coding. Sizes count bytes and are hexadecimal; what follows a ; is ignored; the body ends at size 0, or
    where a size is not one. The body is taken as bytes, so a chunk may end inside a character."""
    raw = body.cast("binary")
    state = F.struct(F.lit(1).alias("at"), F.lit(False).alias("done"), F.array().cast("array<binary>").alias("out"))

    def step(s: Column, _: Column) -> Column:
        # a short look first, so that a step does not copy the rest of the body; a line that is longer is looked for in all of it
        near = F.substring(raw, s["at"], F.lit(64)).cast("string")
        window = F.when(near.contains("\r\n"), near).otherwise(F.substring(raw, s["at"], F.octet_length(raw)).cast("string"))
        line = F.substring_index(window, "\r\n", 1)
        size = F.least(F.conv(F.trim(F.substring_index(line, ";", 1)), 16, 10).try_cast("long"), F.octet_length(raw).cast("long")).cast("int")
        ok = ~s["done"] & window.contains("\r\n") & line.rlike("(?s)^ *0*[0-9A-Fa-f]{1,15} *(;.*)?$") & (size > 0)
        start = s["at"] + F.octet_length(line) + 2
        return F.when(ok, F.struct((start + size + 2).alias("at"), F.lit(False).alias("done"), F.array_append(s["out"], F.substring(raw, start, size)).alias("out"))).otherwise(F.struct(s["at"].alias("at"), F.lit(True).alias("done"), s["out"].alias("out")))

    # a chunk takes 6 bytes at least; most bodies have few, so the fold is over the line ends there are
    turns = F.sequence(F.lit(1), F.greatest(F.size(F.split(body, "\r\n")), F.lit(1)))
    return F.aggregate(turns, state, step, lambda s: F.array_join(F.transform(s["out"], lambda x: x.cast("string")), ""))


def body_of(all_: Column, body: Column) -> Column:
    """The body cut to its content-length in bytes; whole without one, null if fewer bytes came."""
    n = content_length(all_).cast("int")
    return F.when(n.isNull(), body).when(F.octet_length(body) >= n, F.substring(body.cast("binary"), F.lit(1), n).cast("string"))


def rechunk(body: Column, size: int = 65_536) -> Column:
    """A body in chunked transfer coding, ``size`` bytes a chunk."""
    raw = body.cast("binary")
    n = F.octet_length(raw)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))).otherwise(F.array().cast("array<int>"))
    line = lambda i: F.encode(F.concat(F.lower(F.hex(F.least(F.lit(size), n - i + 1))), F.lit("\r\n")), "utf-8")
    end = F.encode(F.lit("\r\n"), "utf-8")
    whole = F.aggregate(starts, F.encode(F.lit(""), "utf-8"), lambda out, i: F.concat(out, line(i), F.substring(raw, i, F.lit(size)), end))
    return F.concat(whole, F.encode(F.lit("0\r\n\r\n"), "utf-8")).cast("string")


def all_text(first_line: Column, all_: Column, body: Column) -> Column:
    """A message's line, headers and body as one text to scan."""
    return F.concat_ws("\n", first_line, F.array_join(F.transform(all_, lambda h: F.concat(h["k"], F.lit(": "), h["v"])), "\n"), body)


def parse_request(raw: Column) -> Column:
    """struct(method, path, version, headers, body) of a whole request; the body is cut to its content-length or decoded from chunks."""
    return _parsed(raw, request_line)


def parse_response(raw: Column) -> Column:
    """struct(version, status, reason, headers, body) of a whole response."""
    return _parsed(raw, response_line)


def _parsed(raw: Column, line: Callable[[Column], Column]) -> Column:
    first = F.substring_index(raw, "\r\n", 1)
    rest = F.substring(raw, F.length(first) + 3, F.length(raw))
    all_ = headers(rest)
    gap = F.instr(raw, "\r\n\r\n")
    came = F.when(gap > 0, F.substring(raw, gap + 4, F.length(raw))).otherwise("")
    body = F.when(is_chunked(all_) & content_length(all_).isNull(), dechunk(came)).otherwise(body_of(all_, came))
    return F.struct(line(first).alias("line"), all_.alias("headers"), body.alias("body"))


def upstream(url: Column) -> Column:
    """struct(scheme, host, port, base) of a fixed upstream; null for another scheme than http and https, no host, or a port that is none."""
    scheme = F.regexp_extract(url, "(?s)^(.*?)://", 1)
    rest = F.regexp_extract(url, "(?s)^.*?://(.*)$", 1)
    at = F.substring_index(rest, "/", 1)
    named = at.rlike("^.+:[^:]*$")
    host = F.when(named, F.regexp_extract(at, "^(.+):[^:]*$", 1)).otherwise(at)
    port = F.when(named, F.regexp_extract(at, "^.+:([^:]*)$", 1).try_cast("int")).when(scheme == "http", 80).otherwise(443)
    base = F.regexp_replace(F.substring(rest, F.length(at) + 1, F.length(rest)), "/+$", "")
    ok = scheme.isin("http", "https") & (host != "") & port.between(0, 65535)
    return F.when(ok, F.struct(scheme.alias("scheme"), host.alias("host"), port.alias("port"), F.when(base == "", "/").otherwise(base).alias("base")))


def authority(at: Column) -> Column:
    return F.concat(at["host"], F.lit(":"), at["port"])


def upstream_line(line: Column, at: Column) -> Column:
    """A request line with its target below the upstream's base path; absolute targets stay; null for a line of fewer than three words."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    target = F.get(words, F.lit(1))
    joined = F.when(target.startswith("http://") | target.startswith("https://") | (at["base"] == "/"), target).when(target == "/", at["base"]).otherwise(F.concat(at["base"], target))
    return F.when(F.size(words) >= 3, F.concat_ws(" ", F.get(words, F.lit(0)), joined, F.get(words, F.lit(2))))


def is_absolute(location: Column) -> Column:
    return location.contains("://")


def host_of(uri: Column) -> Column:
    """Host and port of an absolute URI, null if there is none."""
    return F.nullif(F.regexp_extract(uri, "://([^/]*)", 1), F.lit(""))


def should_rewrite(location: Column, upstream: Column) -> Column:
    """Whether a location is absolute and points to the upstream host, without case and port."""
    name = lambda h: F.lower(F.substring_index(h, ":", 1))
    return F.coalesce(is_absolute(location) & (name(host_of(location)) == name(upstream)), F.lit(False))


def rewrite_location(location: Column, scheme: Column, proxy: Column) -> Column:
    """An absolute URI's path at the proxy."""
    rest = F.regexp_extract(location, "(?s)://[^/]*(/.*)$", 1)
    return F.when(is_absolute(location), F.concat(scheme, F.lit("://"), proxy, F.when(rest == "", "/").otherwise(rest))).otherwise(location)


def normalize_location(location: Column) -> Column:
    """Without the default port of its scheme."""
    return F.when(location.contains("https://") & location.contains(":443/"), F.replace(location, F.lit(":443/"), F.lit("/"))).when(location.contains("http://") & location.contains(":80/"), F.replace(location, F.lit(":80/"), F.lit("/"))).otherwise(location)


def host_port(value: Column, default: int = 443) -> Column:
    """struct(host, port) of a Host header; both null if it has more than one colon or no port number after one."""
    parts = F.split(value, ":")
    port = F.when(F.size(parts) == 1, F.lit(default)).when(F.size(parts) == 2, F.get(parts, F.lit(1)).try_cast("int"))
    ok = port.between(0, 65535)
    return F.struct(F.when(ok, F.get(parts, F.lit(0))).alias("host"), F.when(ok, port).alias("port"))


def identify_host(connect: Column, sni: Column, host: Column, certificate: Column) -> Column:
    """struct(host, source, consistent, others): CONNECT target before SNI before Host header before certificate name."""
    named = [("connect", connect), ("sni", sni), ("host", host), ("certificate", certificate)]
    source = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in named])
    chosen = F.coalesce(*[c for _, c in named])
    others = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in named]), lambda x: x["value"].isNotNull() & (x["key"] != source))
    return F.struct(chosen.alias("host"), source.alias("source"), F.forall(others, lambda x: F.lower(x["value"]) == F.lower(chosen)).alias("consistent"), F.map_from_entries(others).alias("others"))


def proxy_url(url: Column) -> Column:
    """struct(scheme, host, port) of http://host:port."""
    port = F.regexp_extract(url, r"^[a-z]+://[^/:]+:([0-9]+)", 1).try_cast("int")
    scheme = F.regexp_extract(url, "^([a-z]+)://", 1)
    return F.struct(F.nullif(scheme, F.lit("")).alias("scheme"), F.nullif(F.regexp_extract(url, "^[a-z]+://([^/:]+)", 1), F.lit("")).alias("host"), F.coalesce(port, F.when(scheme == "https", 443).otherwise(80)).alias("port"))


def connect_target(line: Column) -> Column:
    """struct(host, port) of ``CONNECT host:port HTTP/1.1``; null for other lines."""
    return F.when(line.rlike("^CONNECT +[^ :]+:[0-9]+ "), host_port(F.regexp_extract(line, "^CONNECT +([^ ]+) ", 1)))
