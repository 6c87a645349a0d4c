"""Pattern catalogs as plain data and as DataFrames.

The validated-prefix catalog has several hundred rows and is a parameter: a Markdown table with the columns #, name, prefix, tier,
min, max and charset, by default the package's ``validated.md``. The driver reads it; tasks get its rows. The small catalogs are below."""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

DEFAULT_TABLE = str(Path(__file__).resolve().with_name("validated.md"))

#: Regular-expression classes of the token charsets. Fixed values.
CHARSETS = {"AN": "[A-Za-z0-9_-]", "B64": "[A-Za-z0-9+/=]", "B64U": "[A-Za-z0-9_=-]", "HEX": "[0-9a-fA-F]", "ANY": "[\x20-\x7e]"}
TIER_LETTERS = {"C": "CRITICAL", "A": "API_KEYS", "I": "INFRASTRUCTURE", "S": "SERVICES", "P": "PATTERNS"}

#: Name, code, risk, redacted by default. Fixed values.
TIERS = [("CRITICAL", 0, 95, True), ("API_KEYS", 1, 80, True), ("INFRASTRUCTURE", 2, 60, False), ("SERVICES", 3, 40, False), ("PATTERNS", 4, 30, False)]

#: Id (its place), name, prefix, declared tier. Fixed values.
SIMPLE = [
    ("artifactoryreferencetoken", "cmVmdGtu", "INFRASTRUCTURE"), ("azure-storage", "AccountName", "INFRASTRUCTURE"), ("azure-app-config", "Endpoint=https://", "INFRASTRUCTURE"),
    ("coinbase", "organizations/", "SERVICES"), ("context7-api-key", "ctx7sk_", "CRITICAL"), ("context7-secret", "ctx7sk-", "CRITICAL"), ("langsmith-deployment-key", "lsv2_sk_", "CRITICAL"),
    ("pypi-upload-token", "pypi-AgEIcHlwaS5vcmc", "SERVICES"), ("salad-cloud-api-key", "salad_cloud_", "INFRASTRUCTURE"), ("sentry-access-token", "bsntrys_", "API_KEYS"), ("travisoauth", "travis_", "API_KEYS"),
    ("tumblr-api-key", "tumblr_", "SERVICES"), ("upstash-redis", "redis_", "INFRASTRUCTURE"), ("vercel-token", "vercel_", "API_KEYS"), ("aws-akia", "AKIA", "CRITICAL"), ("aws-asia", "ASIA", "CRITICAL"),
    ("aws-abia", "ABIA", "CRITICAL"), ("aws-acca", "ACCA", "CRITICAL"), ("github-ghp", "ghp_", "CRITICAL"), ("github-ghu", "ghu_", "CRITICAL"), ("github-ghs", "ghs_", "CRITICAL"),
    ("openai-sk-proj", "sk-proj-", "CRITICAL"), ("openai-sk", "sk-", "CRITICAL"),
]

#: Name, label between the marker's dashes, declared tier, furthest end. Ids from 300. Fixed values.
MARKERS = [
    ("ssh-rsa-private-key", "RSA PRIVATE KEY", "CRITICAL", 4096), ("ssh-openssh-private-key", "OPENSSH PRIVATE KEY", "CRITICAL", 4096), ("ssh-private-key", "PRIVATE KEY", "CRITICAL", 4096),
    ("ssh-ec-private-key", "EC PRIVATE KEY", "CRITICAL", 4096), ("x509-certificate", "CERTIFICATE", "INFRASTRUCTURE", 10240), ("x509-certificate-request", "CERTIFICATE REQUEST", "INFRASTRUCTURE", 5120),
    ("encrypted-private-key", "ENCRYPTED PRIVATE KEY", "CRITICAL", 5120), ("public-key", "PUBLIC KEY", "INFRASTRUCTURE", 3072), ("pgp-private-key-block", "PGP PRIVATE KEY BLOCK", "CRITICAL", 20480),
    ("pgp-public-key-block", "PGP PUBLIC KEY BLOCK", "INFRASTRUCTURE", 6144), ("pgp-message", "PGP MESSAGE", "CRITICAL", 15360),
]

#: Name, scheme, kind of credential, least length. Ids from 400; the last two are webhooks. Fixed values.
URIS = [
    ("mongodb-uri", "mongodb://", "UserPasswordAtHost", 20), ("mongodb-srv-uri", "mongodb+srv://", "UserPasswordAtHost", 20), ("redis-uri", "redis://", "UserPasswordAtHost", 15),
    ("postgres-uri", "postgres://", "UserPasswordAtHost", 20), ("cassandra-uri", "cassandra://", "UserPasswordAtHost", 20), ("elasticsearch-uri", "elasticsearch://", "UserPasswordAtHost", 20),
    ("amqp-uri", "amqp://", "UserPasswordAtHost", 15), ("dynamodb-uri", "dynamodb://", "UserPasswordAtHost", 15), ("couchdb-uri", "couchdb://", "UserPasswordAtHost", 20),
    ("influxdb-uri", "influxdb://", "UserPasswordAtHost", 20), ("memcached-uri", "memcached://", "TokenOnly", 10),
    ("slack-webhook-url", "https://hooks.slack.com/services/", "TokenOnly", 50), ("discord-webhook-url", "https://discord.com/api/webhooks/", "TokenOnly", 50),
]

#: Words in a variable's name that mark a secret, and usual variables. Fixed values.
SECRET_KEYWORDS = ["API_KEY", "SECRET", "TOKEN", "PASSWORD", "CREDENTIAL", "PASSPHRASE", "AWS_ACCESS", "AWS_SECRET", "PRIVATE_KEY"]
COMMON_VARIABLES = ["PATH", "HOME", "USER", "SHELL", "LANG", "PWD", "HOSTNAME", "TERM"]
#: Marks a generated placeholder. Fixed value.
PLACEHOLDER_MARK = "scrd-"


class Validated(NamedTuple):
    idx: int
    name: str
    prefix: str
    tier: str
    min_len: int
    max_len: int
    charset: str


@lru_cache(4)
def validated(path: str = DEFAULT_TABLE) -> tuple[Validated, ...]:
    """The validated-prefix catalog, from rows ``| # | name | `prefix` | tier | min | max | charset |``."""
    found = []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        m = re.match(r"\|\s*(\d+)\s*\|\s*([^|]+?)\s*\|\s*`(.+)`\s*\|\s*([CAISP])\s*\|\s*(\d+)\s*\|\s*(\d+)\s*\|\s*(AN|B64U|B64|HEX|ANY)\s*\|", line)
        if m:
            found.append(Validated(int(m[1]), m[2], m[3].replace("\\|", "|"), TIER_LETTERS[m[4]], int(m[5]), int(m[6]), m[7]))
    if [v.idx for v in found] != list(range(len(found))) or not found:
        raise ValueError(f"{path} holds no catalog whose rows are numbered from 0")
    return tuple(found)


def live(rows: tuple[Validated, ...] | None = None) -> list[Validated]:
    """Rows that can fire: the first of each prefix, without prefixes in which another one ends earlier."""
    first: dict[str, Validated] = {}
    for v in validated() if rows is None else rows:
        first.setdefault(v.prefix, v)
    inside = lambda p: any(p[i:j] in first for j in range(1, len(p)) for i in range(j))
    return [v for p, v in first.items() if not inside(p)]


def live_simple() -> list[tuple[int, str]]:
    """(id, prefix) of the simple prefixes that can fire."""
    known = {p for _, p, _ in SIMPLE}
    return [(i, p) for i, (_, p, _) in enumerate(SIMPLE) if not any(p[a:b] in known for b in range(1, len(p)) for a in range(b))]


def catalog(spark: SparkSession) -> DataFrame:
    """All patterns: kind, pattern_type, name, prefix, tier, min_len, max_len."""
    rows = [("simple", i, n, p, t, 0, 256) for i, (n, p, t) in enumerate(SIMPLE)]
    rows += [("validated", 100 + v.idx, v.name, v.prefix, v.tier, v.min_len, v.max_len) for v in validated()]
    rows += [("jwt", 200, "jwt-generic", "eyJ", "CRITICAL", 32, 10000)]
    rows += [("marker", 300 + i, n, f"-----BEGIN {x}-----", t, 0, k) for i, (n, x, t, k) in enumerate(MARKERS)]
    rows += [("uri", 400 + i, n, s, "SERVICES", k, 0) for i, (n, s, _, k) in enumerate(URIS)]
    return spark.createDataFrame(rows, "kind string, pattern_type int, name string, prefix string, tier string, min_len int, max_len int")


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIERS, "tier string, code int, risk int, default_redact boolean")
