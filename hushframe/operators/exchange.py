"""HTTP exchanges under a policy: headers, bodies, and requests with their responses.

A message is a row with ``host``, ``headers`` (array of k, v) and ``body``; an exchange has ``request_...`` and ``response_...`` columns of each.
Policies and the placeholders of a deployment are configuration, so they become expressions; only texts in which secrets are looked for go to
the kernel, as lists within their rows. Nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import DEFAULT_TABLE
from . import http
from .detect import redact_each
from .placeholders import substitute, substitute_tracked
from .policy import DEFAULT_HEADERS, header_action, hop_by_hop, host_policy, merge_host_rules
from .select import KeepFilter

EVENTS = "array<struct<location:string,name:string,action:string>>"


@dataclass(frozen=True)
class HostPolicy:
    """What is done to a host's messages. ``replace``: these rules alone hold, nothing comes from the defaults."""

    headers: tuple[tuple[str, str], ...] = DEFAULT_HEADERS
    request_body: str = "redact"
    response_body: str = "redact"
    patterns: KeepFilter = KeepFilter()
    replace: bool = False

    def resolve(self, defaults: HostPolicy) -> HostPolicy:
        """With the defaults: header rules by name unless there is an own *, own body actions, pattern globs of both."""
        if self.replace:
            return self
        return HostPolicy(merge_host_rules(self.headers, defaults.headers), self.request_body, self.response_body, defaults.patterns.merge(self.patterns))


@dataclass(frozen=True)
class Policy:
    """Defaults, host policies by glob, and (placeholder, secret) pairs. The longest glob that fits a host holds."""

    defaults: HostPolicy = HostPolicy()
    hosts: dict[str, HostPolicy] = field(default_factory=dict)
    secrets: tuple[tuple[str, str], ...] = ()
    table: str = DEFAULT_TABLE

    def source(self, host: Column) -> Column:
        """The glob that holds, or ``default``."""
        return host_policy(host, list(self.hosts))

    def by_host(self, host: Column, of: Callable[[HostPolicy], Column]) -> Column:
        """An expression of the policy that holds for a host."""
        out, name = None, self.source(host)
        for glob, own in self.hosts.items():
            value = of(own.resolve(self.defaults))
            out = F.when(name == glob, value) if out is None else out.when(name == glob, value)
        return of(self.defaults) if out is None else out.otherwise(of(self.defaults))

    def header_action(self, host: Column, header: Column) -> Column:
        return self.by_host(host, lambda p: header_action(header, p.headers))

    def body_action(self, host: Column, direction: str) -> Column:
        return self.by_host(host, lambda p: F.lit(p.request_body if direction == "request" else p.response_body))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def process_headers(messages: DataFrame, policy: Policy, host_col: str = "host", headers_col: str = "headers") -> DataFrame:
    """Headers by their action: ``replace`` puts secrets in for placeholders, ``redact`` redacts what is found, ``detect`` reports it, ``passthrough`` does
    nothing. Adds headers_processed, placeholders_replaced, secrets_redacted, secrets_detected and ``events`` (location, tier, action). Null headers
    stay null and count nothing."""
    headers = F.col(headers_col)
    acted = messages.withColumn("_hf_actions", F.transform(headers, lambda h: policy.header_action(F.col(host_col), h["k"])))
    scanned = acted.withColumn("_hf_values", F.zip_with(headers, "_hf_actions", lambda h, a: F.when(a.isin("redact", "detect"), h["v"])))
    done = redact_each(scanned, "_hf_values", "_hf_clean", "_hf_found", policy.table)
    put = lambda v: F.struct(*[c.alias(n) for n, c in zip(("v", "n"), substitute(v, policy.secrets), strict=True)])
    done = done.withColumn("_hf_put", F.zip_with(headers, "_hf_actions", lambda h, a: F.when(a == "replace", put(h["v"]))))
    n = F.sequence(F.lit(1), F.size(headers))
    n = F.when(F.size(headers) > 0, n).otherwise(F.array().cast("array<int>"))
    at = lambda c, i: F.element_at(F.col(c), i)
    new = F.transform(n, lambda i: F.struct(F.element_at(headers, i)["k"].alias("k"), F.when(at("_hf_actions", i) == "replace", at("_hf_put", i)["v"]).when(at("_hf_actions", i) == "redact", at("_hf_clean", i)).otherwise(F.element_at(headers, i)["v"]).alias("v")))
    found = lambda action: _sum(F.zip_with("_hf_actions", "_hf_found", lambda a, f: F.when(a == action, F.size(f)).otherwise(0).cast("long")))
    events = F.flatten(F.transform(n, lambda i: F.transform(F.coalesce(at("_hf_found", i), F.array().cast("array<string>")), lambda t: F.struct(F.concat(F.lit("header:"), F.element_at(headers, i)["k"]).alias("location"), t.alias("name"), F.when(at("_hf_actions", i) == "redact", "redacted").otherwise("detected").alias("action")))))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    out = done.withColumns({
        "headers_processed": F.coalesce(F.size(headers), F.lit(0)).cast("long"), "placeholders_replaced": zero(_sum(F.transform("_hf_put", lambda p: F.coalesce(p["n"], F.lit(0)).cast("long")))),
        "secrets_redacted": zero(found("redact")), "secrets_detected": zero(found("detect")), "events": F.coalesce(events, F.array().cast(EVENTS)), "_hf_new": F.when(headers.isNotNull(), new),
    })
    return out.withColumn(headers_col, F.col("_hf_new")).drop("_hf_actions", "_hf_values", "_hf_clean", "_hf_found", "_hf_put", "_hf_new")


def process_body(messages: DataFrame, policy: Policy, direction: str = "request", host_col: str = "host", body_col: str = "body") -> DataFrame:
    """The body by its host's action for the direction; adds bytes_processed, secrets_redacted and secrets_detected. A null body is none."""
    action = policy.body_action(F.col(host_col), direction)
    given = messages.withColumn("_hf_action", action).withColumn("_hf_list", F.when(F.col("_hf_action") != "passthrough", F.array(F.col(body_col))))
    done = redact_each(given, "_hf_list", "_hf_clean", "_hf_found", policy.table)
    n = F.coalesce(F.size(F.get("_hf_found", F.lit(0))), F.lit(0)).cast("long")
    n = F.when(F.col("_hf_found").isNull(), 0).otherwise(n).cast("long")
    out = done.withColumns({
        "bytes_processed": F.coalesce(F.octet_length(body_col), F.lit(0)).cast("long"), "secrets_redacted": F.when(F.col("_hf_action") == "redact", n).otherwise(0).cast("long"),
        "secrets_detected": F.when(F.col("_hf_action") == "detect", n).otherwise(0).cast("long"),
    })
    clean = F.when(F.col("_hf_action") == "redact", F.get("_hf_clean", F.lit(0))).otherwise(F.col(body_col))
    return out.withColumn("_hf_new", clean).withColumn(body_col, F.col("_hf_new")).drop("_hf_action", "_hf_list", "_hf_clean", "_hf_found", "_hf_new")


def process_request(messages: DataFrame, policy: Policy, host_col: str = "host", body_col: str = "body") -> DataFrame:
    """Secrets put in for placeholders in a request's body, unless its host's action is passthrough. Adds ``replaced`` and ``tracker``, a map from each
    secret that was put in to its placeholder."""
    text = F.when(policy.body_action(F.col(host_col), "request") != "passthrough", F.col(body_col))
    out, n = substitute(text, policy.secrets)
    used = F.filter(F.array(*[F.struct(F.lit(s).alias("key"), F.lit(p).alias("value")) for p, s in policy.secrets]).cast("array<struct<key:string,value:string>>"), lambda x: F.coalesce(text.contains(x["value"]), F.lit(False)))
    # two placeholders of one secret lead back to the first
    first = F.aggregate(used, F.array().cast("array<struct<key:string,value:string>>"), lambda s, x: F.when(F.exists(s, lambda y: y["key"] == x["key"]), s).otherwise(F.array_append(s, x)))
    return messages.withColumns({"_hf_new": F.coalesce(out, F.col(body_col)), "replaced": F.coalesce(n, F.lit(0)), "tracker": F.map_from_entries(first)}).withColumn(body_col, F.col("_hf_new")).drop("_hf_new")


def process_response(messages: DataFrame, body_col: str = "body", tracker_col: str = "tracker") -> DataFrame:
    """Placeholders put back for the tracked secrets in a response's body; adds ``restored``, the number of secrets that were there."""
    out, n = substitute_tracked(F.col(body_col), F.col(tracker_col))
    return messages.withColumns({"_hf_new": out, "restored": n}).withColumn(body_col, F.col("_hf_new")).drop("_hf_new")


def handle(exchanges: DataFrame, policy: Policy) -> DataFrame:
    """Whole exchanges (host, request_headers, request_body, status, response_headers, response_body): request headers by policy, placeholders of
    the request body replaced, tracked secrets of the response body turned back, and the response's length set if it changed.

    Adds replaced, restored, tracker, and the counters of the request's headers. Responses that have no body by their status get none."""
    sent = process_request(process_headers(exchanges, policy, headers_col="request_headers"), policy, body_col="request_body")
    got = process_response(sent.withColumn("response_body", F.when(~http.bodyless(F.col("status")), F.col("response_body"))), body_col="response_body")
    size = F.octet_length("response_body").cast("string")
    return got.withColumn("response_headers", F.when(F.col("restored") > 0, http.set_header(F.col("response_headers"), "Content-Length", size)).otherwise(F.col("response_headers")))


def forward_headers(headers: Column, mark: str | None = "X-Redacted") -> Column:
    """Headers as they are sent on when a body's length may change: without content-length and the two that tell how it is sent, closed by ``Connection:
    close`` and, if given, a mark."""
    kept = F.filter(headers, lambda h: ~F.lower(h["k"]).isin("content-length", "transfer-encoding", "connection"))
    one = lambda k, v: F.struct(F.lit(k).alias("k"), F.lit(v).alias("v"))
    return F.concat(kept, F.array(one("Connection", "close"), *([one(mark, "true")] if mark else [])))


def stream_responses(messages: DataFrame, table: str = DEFAULT_TABLE, upstream: str | None = None, proxy: str | None = None, scheme: str = "http", mark: str | None = "X-Redacted") -> DataFrame:
    """Responses (status, headers, body as it came) as they go to the client: chunked bodies decoded, others cut to their content-length, headers
    sent on and the Location made the proxy's, header values and body redacted. Adds ``patterns_found``."""
    headers = F.col("headers")
    whole = F.when(http.is_chunked(headers) & http.content_length(headers).isNull(), http.dechunk(F.col("body"))).otherwise(http.body_of(headers, F.col("body")))
    body = F.when(~http.bodyless(F.col("status")), whole)
    at = http.normalize_location(http.header(headers, "location"))
    if proxy is not None:
        at = F.when(F.lit(True) if upstream is None else http.should_rewrite(at, F.lit(upstream)), http.rewrite_location(at, F.lit(scheme), F.lit(proxy))).otherwise(at)
    located = F.when(http.header(headers, "location").isNotNull(), http.set_header(headers, "Location", at)).otherwise(headers)
    given = messages.withColumns({"_hf_body": body, "_hf_headers": forward_headers(located, mark)}).withColumn("_hf_list", F.array_append(F.transform("_hf_headers", lambda h: h["v"]), F.col("_hf_body")))
    done = redact_each(given, "_hf_list", "_hf_clean", "_hf_found", table)
    new = F.zip_with("_hf_headers", F.slice("_hf_clean", 1, F.size("_hf_clean") - 1), lambda h, v: F.struct(h["k"].alias("k"), v.alias("v")))
    found = _sum(F.transform("_hf_found", lambda f: F.coalesce(F.size(f), F.lit(0)).cast("long")))
    return done.withColumns({"headers": new, "body": F.element_at("_hf_clean", -1), "patterns_found": found}).drop("_hf_body", "_hf_headers", "_hf_list", "_hf_clean", "_hf_found")


def stream_requests(messages: DataFrame, policy: Policy) -> DataFrame:
    """Requests (host, headers, body) as they go upstream: hop-by-hop headers dropped, header actions done, placeholders of the body replaced."""
    kept = messages.withColumn("headers", F.filter("headers", lambda h: ~hop_by_hop(h["k"])))
    return process_request(process_headers(kept, policy), policy)
