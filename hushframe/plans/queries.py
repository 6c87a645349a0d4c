"""Queries over the operators, each with SQL that says the same by itself where SQL can."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import exchange, formats, http, placeholders, policy
from ..operators import select as S
from ..sources import catalog as C
from ..sources import texts
from ..streaming import redaction, run
from .corpora import secret_sql, seeded, seeded_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


SEED = "test-seed"
DOCS = seeded_sql(False)
SPANS = f"""SELECT doc_id, kind, strlen('order ' || doc_id) + 1 AS s, secret, text FROM ({DOCS}) d"""
#: Two rows for two secrets back to back.
FOUND = f"""SELECT doc_id, kind, s AS start, s + CASE WHEN kind = 11 THEN 20 ELSE strlen(secret) + CASE WHEN kind IN (5, 8) THEN 1 ELSE 0 END END AS "end",
  CASE kind WHEN 0 THEN 14 WHEN 1 THEN 18 WHEN 2 THEN 22 WHEN 3 THEN 200 WHEN 4 THEN 319 WHEN 5 THEN 300 WHEN 6 THEN 400 WHEN 7 THEN 354 WHEN 8 THEN 310 WHEN 9 THEN 22 WHEN 11 THEN 14 END AS pattern_type, text
FROM ({SPANS}) x WHERE kind <> 10
UNION ALL SELECT doc_id, kind, s + 21, s + 41, 14, text FROM ({SPANS}) x WHERE kind = 11"""
TIER = "CASE WHEN pattern_type < 100 THEN 'CRITICAL' WHEN pattern_type < 200 THEN 'API_KEYS' WHEN pattern_type < 300 THEN 'PATTERNS' WHEN pattern_type < 400 THEN 'INFRASTRUCTURE' ELSE 'SERVICES' END"
RULE = """CASE WHEN contains(m, '=') THEN substr(m, 1, instr(m, '=') + 4) || repeat('x', greatest(0, strlen(m) - instr(m, '=') - 4))
WHEN pattern_type >= 300 THEN repeat('x', strlen(m)) ELSE substr(m, 1, 4) || repeat('x', strlen(m) - 4) END"""
MATCHED = f"""SELECT *, substr(text, start + 1, "end" - start) AS m FROM ({FOUND}) f"""


def _one(detector: str) -> Query:
    return lambda spark, sf: D.matches(seeded(spark, sf).select("doc_id", "text"), detector=detector).select("doc_id", "pattern_type", "start", "end")


@query(f"""SELECT doc_id, pattern_type, start, "end", substr(text, start + 1, "end" - start) AS matched, {TIER} AS tier FROM ({FOUND}) f""")
def detect_all(spark: SparkSession, sf: str) -> DataFrame:
    return D.matches(seeded(spark, sf).select("doc_id", "text")).select("doc_id", "pattern_type", "start", "end", "matched", "tier")


@query(f"SELECT doc_id, pattern_type, start, \"end\" FROM ({FOUND}) f WHERE pattern_type < 100")
def detect_simple_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _one("simple")(spark, sf)


@query(f"SELECT doc_id, len(t) AS n, array_to_string(t, '|') AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '(?:AKIA|ghp_|sk-)[A-Za-z0-9_-]*') AS t FROM ({DOCS}) d) x")
def simple_tokens_native(spark: SparkSession, sf: str) -> DataFrame:
    docs = seeded(spark, sf).select("doc_id", D.simple_tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", "|").alias("tokens"))


#: By itself this detector also finds its prefix d7dc in the digests of two kinds, with 20 characters or more after it.
@query(f"""WITH x AS (SELECT doc_id, kind, s, secret, sha256(CAST(doc_id AS varchar)) AS sha FROM ({SPANS}) y)
SELECT doc_id, CASE kind WHEN 1 THEN 114 WHEN 4 THEN 319 ELSE 354 END AS pattern_type, s AS start, s + strlen(secret) AS "end" FROM x WHERE kind IN (1, 4, 7)
UNION ALL SELECT doc_id, 107, s + 31 + instr(sha, 'd7dc'), s + 96 FROM x WHERE kind = 5 AND instr(sha, 'd7dc') BETWEEN 1 AND 41
UNION ALL SELECT doc_id, 107, s + 7 + instr(sha, 'd7dc'), s + 38 FROM x WHERE kind = 9 AND instr(sha, 'd7dc') BETWEEN 1 AND 7""")
def detect_validated(spark: SparkSession, sf: str) -> DataFrame:
    return _one("validated")(spark, sf)


@query(f"SELECT doc_id, pattern_type, start, \"end\" FROM ({FOUND}) f WHERE kind = 3")
def detect_jwt(spark: SparkSession, sf: str) -> DataFrame:
    # the token's second part begins like a token too, but has one dot only
    return _one("jwt")(spark, sf)


@query(f"SELECT doc_id, pattern_type, start, \"end\" FROM ({FOUND}) f WHERE kind IN (5, 8)")
def detect_markers(spark: SparkSession, sf: str) -> DataFrame:
    return _one("marker")(spark, sf)


@query(f"SELECT doc_id, CASE kind WHEN 6 THEN 400 ELSE 411 END AS pattern_type, start, \"end\" FROM ({FOUND}) f WHERE kind IN (6, 7)")
def detect_uris(spark: SparkSession, sf: str) -> DataFrame:
    return _one("uri")(spark, sf)


@query(f"SELECT {TIER} AS tier, count(*) AS cnt FROM ({FOUND}) f GROUP BY 1")
def warnings_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return D.warnings(D.matches(seeded(spark, sf).select("doc_id", "text")))


@query(f"SELECT kind, {TIER} AS tier, count(*) AS cnt FROM ({FOUND}) f GROUP BY ROLLUP (kind, {TIER})")
def matches_rollup(spark: SparkSession, sf: str) -> DataFrame:
    found = D.matches(seeded(spark, sf).select("doc_id", "kind", "text"))
    return found.rollup("kind", "tier").agg(F.count(F.lit(1)).alias("cnt"))


@query(f"SELECT doc_id, start, {RULE} AS redacted FROM ({MATCHED}) m")
def redact_rule(spark: SparkSession, sf: str) -> DataFrame:
    found = D.matches(seeded(spark, sf).select("doc_id", "text"))
    return found.select("doc_id", "start", D.redact_rule(F.col("matched"), F.col("pattern_type")).alias("redacted"))




@query(f"""WITH r AS (SELECT doc_id, start, "end", {RULE} AS r, pattern_type FROM ({MATCHED}) m),
a AS (SELECT doc_id, min(start) AS s, max("end") AS e, string_agg(r, '/' ORDER BY start) AS r, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(substr(text, 1, s) || r || substr(text, e + 1), text) AS redacted, CAST(coalesce(n, 0) AS INT) AS n_matches FROM ({DOCS}) d LEFT JOIN a USING (doc_id)""")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    return D.redact(seeded(spark, sf).select("doc_id", "text")).drop("text")


@query(f"""WITH r AS (SELECT doc_id, start, "end", {RULE} AS r, pattern_type FROM ({MATCHED}) m WHERE pattern_type < 100),
a AS (SELECT doc_id, min(start) AS s, max("end") AS e, string_agg(r, '/' ORDER BY start) AS r, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(substr(text, 1, s) || r || substr(text, e + 1), text) AS redacted, CAST(coalesce(n, 0) AS INT) AS n_matches FROM ({DOCS}) d LEFT JOIN a USING (doc_id)""")
def redact_critical(spark: SparkSession, sf: str) -> DataFrame:
    return D.redact(seeded(spark, sf).select("doc_id", "text"), tiers=S.Selector.parse("tier:critical").values).drop("text")


@query(f"SELECT count(*) AS n, sum(strlen(text)) AS bytes FROM ({DOCS}) d")
def length_preserved(spark: SparkSession, sf: str) -> DataFrame:
    return D.redact(seeded(spark, sf).select("doc_id", "text")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("redacted").cast("long")).alias("bytes"))


CLEAN = ("AKIA", "ASIA", "ABIA", "ACCA", "ghp_", "ghu_", "ghs_", "sk-", "eyJ", "://", "-----BEGIN ")


@query("SELECT doc_id, CAST(0 AS INT) AS n_simple, strlen(text) AS bytes FROM documents WHERE NOT regexp_matches(text, '(AKIA|ASIA|ABIA|ACCA|gh[pus]_|sk-|eyJ|://|-----BEGIN )')")
def negative_control(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for x in CLEAN:
        docs = docs.where(~F.col("text").contains(x))
    return D.counts(docs, out_col="n_simple", detector="simple").select("doc_id", "n_simple", F.octet_length("text").cast("long").alias("bytes"))


#: Every live prefix with a token of its least length, tokens with two dots, block markers and URIs: a text without any of these has no match.
ANY = "|".join([
    *[re.escape(p) for _, p in C.live_simple()], *[re.escape(v.prefix) + C.CHARSETS[v.charset] + f"{{{max(v.min_len, 1)}}}" for v in C.live()],
    r"eyJ[A-Za-z0-9_=.-]{29}", *[f"-----BEGIN {label}-----" for _, label, _, _ in C.MARKERS], *[re.escape(u) for _, u, _, _ in C.URIS],
])


@query("SELECT doc_id, 'a pattern that was not found' AS name, '' AS tier, 0 AS start, 0 AS \"end\" FROM documents WHERE regexp_matches(text, '" + ANY.replace("'", "''") + "')")
def detect_documents(spark: SparkSession, sf: str) -> DataFrame:
    return D.matches(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).select("doc_id", "name", "tier", "start", "end")


@query()
def redact_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with html and url redacted; n_matches counts both."""
    pages = D.redact(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html"), "html").withColumnRenamed("n_matches", "n_html")
    done = D.redact(pages.drop("html"), "url", "redacted_url")
    return done.select("page_id", "redacted", "redacted_url", (F.col("n_html") + F.col("n_matches")).alias("n_matches"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'mongodb://u:[REDACTED]@h' || c_custkey || ':27017/db' WHEN 1 THEN 'https://hooks.slack.com/services/T/B/[REDACTED]' ELSE 'user:secret' || c_custkey END AS redacted FROM customer""")
def redact_uri_credentials(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN 'mongodb://u:pw' || c_custkey || '@h' || c_custkey || ':27017/db' WHEN 1 THEN 'https://hooks.slack.com/services/T/B/K' || c_custkey ELSE 'user:secret' || c_custkey END AS uri", "element_at(array('UserPasswordAtHost', 'TokenOnly', 'UserPassword'), CAST(c_custkey % 3 AS INT) + 1) AS kind")
    return rows.select("c_custkey", D.redact_uri(F.col("uri"), F.col("kind")).alias("redacted"))


ENV = """CASE k % 5 WHEN 0 THEN 'API_KEY=v' || k || chr(10) || 'PATH=/bin' || chr(10) || '# note' WHEN 1 THEN 'plain text without pairs' || k WHEN 2 THEN 'a=1' || chr(10) || 'b=2' || chr(10) || 'USER=u' || k
WHEN 3 THEN '  DB_PASSWORD=x' || k ELSE '' END"""


def _env(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"{ENV} AS text")


ENV_SCORE = f"""WITH t AS (SELECT k, text, CASE WHEN text = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM (SELECT k, {ENV} AS text FROM (SELECT c_custkey AS k FROM customer) a) b),
n AS (SELECT k, len(l) AS n, len(list_filter(l, lambda x: x <> '' AND x NOT LIKE '#%' AND x NOT LIKE ';%' AND contains(x, '='))) AS e,
 len(list_filter(l, lambda x: regexp_matches(upper(string_split(ltrim(x), '=')[1]), 'API_KEY|SECRET|TOKEN|PASSWORD|CREDENTIAL|PASSPHRASE|AWS_ACCESS|AWS_SECRET|PRIVATE_KEY'))) AS w,
 len(list_filter(l, lambda x: regexp_matches(ltrim(x), '^(PATH|HOME|USER|SHELL|LANG|PWD|HOSTNAME|TERM)') AND contains(x, '='))) AS c FROM t),
s AS (SELECT k, CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, 0.3 * e / n + CASE WHEN e = 0 THEN 0.0 ELSE 0.5 * least(1.0, 0.8 * w / e) + 0.2 * least(1.0, 0.8 * c / e) END) END AS score FROM n)"""


@query(ENV_SCORE + " SELECT k, round(CAST(score AS DOUBLE), 4) AS score, CASE WHEN score >= 0.45 THEN 'env' ELSE 'text' END AS format FROM s")
def env_format(spark: SparkSession, sf: str) -> DataFrame:
    return _env(spark, sf).select("k", F.round(formats.env_score(F.col("text")).cast("double"), 4).alias("score"), formats.format_of(F.col("text")).alias("format"))


@query("""SELECT k, CASE WHEN k % 4 = 0 THEN 'aws=AKIA' || repeat('x', 16) WHEN k % 4 = 1 THEN 'note: AKIA' || repeat('x', 16) WHEN k % 4 = 2 THEN 'AKIA' || repeat('x', 16) ELSE 'EMPTY=' END || chr(10) || 'x=' || k || chr(10) AS redacted
FROM (SELECT c_custkey AS k FROM customer) a""".replace("'note: AKIA'", "'note:AKIA'"))
def env_lines(spark: SparkSession, sf: str) -> DataFrame:
    key = "'AKIA' || upper(substr(md5(CAST(k AS string)), 1, 16))"
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"CASE WHEN k % 4 = 0 THEN ' aws = ' || {key} WHEN k % 4 = 1 THEN 'note: ' || {key} WHEN k % 4 = 2 THEN {key} ELSE 'EMPTY=' END || chr(10) || 'x=' || k AS text")
    return formats.redact_env(rows).select("k", "redacted")


@query("SELECT * FROM (VALUES ('CRITICAL', 0, 95, TRUE), ('API_KEYS', 1, 80, TRUE), ('INFRASTRUCTURE', 2, 60, FALSE), ('SERVICES', 3, 40, FALSE), ('PATTERNS', 4, 30, FALSE)) t(tier, code, risk, default_redact)")
def list_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return C.tiers(spark)


@query("SELECT * FROM (VALUES ('simple', 23), ('validated', 357), ('jwt', 1), ('marker', 11), ('uri', 13)) t(kind, n)")
def pattern_counts(spark: SparkSession, sf: str) -> DataFrame:
    return C.catalog(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'aws-akia' AS name, 'AKIA' AS prefix, 14 AS pattern_type, 'CRITICAL' AS tier")
def describe_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return S.describe(C.catalog(spark), "aws-akia").select("name", "prefix", "pattern_type", "tier")


@query("""SELECT * FROM (VALUES ('aws-akia', 'AKIA'), ('aws-asia', 'ASIA'), ('aws-abia', 'ABIA'), ('aws-acca', 'ACCA'), ('github-ghp', 'ghp_'), ('github-ghu', 'ghu_'), ('github-ghs', 'ghs_'), ('aws-access-token', 'AKIA'),
('aws-session-token', 'ASIA'), ('aws-secret-access-key', 'aws-secret-access-key_'), ('aws-secret-env', 'AWS_SECRET_ACCESS_KEY='), ('aws-secret-env', 'AWS_SECRET_ACCESS_KEY=')) t(name, prefix)""")
def glob_select(spark: SparkSession, sf: str) -> DataFrame:
    return C.catalog(spark).where(S.Selector.parse("patterns:aws-*,github-gh?").matches(F.col("name"), F.col("tier"))).select("name", "prefix")


@query("SELECT * FROM (VALUES ('CRITICAL', 120, 0), ('INFRASTRUCTURE', 3, 0)) t(tier, n, n_aws)")
def composite_select(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.catalog(spark).where(S.Composite.parse("CRITICAL,azure-*,!aws-*").matches(F.col("name"), F.col("tier")))
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").startswith("aws-")).alias("n_aws"))


@query("SELECT * FROM (VALUES ('CRITICAL', 129), ('API_KEYS', 20), ('INFRASTRUCTURE', 220), ('SERVICES', 35), ('PATTERNS', 1)) t(tier, n)")
def tier_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return C.catalog(spark).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 121 AS n, 'alchemy-api-key' AS first, 'zulip-api-key' AS last")
def keep_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.catalog(spark).where(S.KeepFilter(("*-key",), ("context7*",)).matches(F.col("name")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'Building') THEN 'CRITICAL' WHEN upper(c_mktsegment) = 'MACHINERY' THEN 'SERVICES' ELSE 'PATTERNS' END AS tier FROM customer""")
def tier_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([("BUILDING", "CRITICAL"), ("machinery", "SERVICES")], "name string, tier string")
    return S.with_tier(spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment"), names, "c_mktsegment").select("c_custkey", "tier")


SECRETS = f"SELECT 'VAR_' || k AS name, {secret_sql(False)} AS value, k % 12 AS kind FROM (SELECT o_orderkey AS k FROM orders) a"
HOLDER = f"""SELECT name, value, kept || 'scrd-' || substr(repeat(sha256(name || '{SEED}'), 4), 1, greatest(0, strlen(value) - strlen(kept) - 5)) AS placeholder, kept AS prefix
FROM (SELECT *, CASE WHEN kind IN (0, 11) THEN 'AKIA' WHEN kind = 1 THEN 'ghp_' WHEN kind = 2 THEN 'sk-proj-' WHEN kind = 4 THEN 'API_' WHEN kind = 9 THEN 'sk-scrd-' ELSE '' END AS kept FROM ({SECRETS}) s) s"""


def _secrets(spark: SparkSession, sf: str) -> DataFrame:
    return seeded(spark, sf).select(F.concat(F.lit("VAR_"), F.col("doc_id")).alias("name"), F.col("secret").alias("value"))


@query(HOLDER)
def placeholder_values(spark: SparkSession, sf: str) -> DataFrame:
    return placeholders.generate(_secrets(spark, sf), SEED)


@query(f"SELECT name, value AS restored, TRUE AS hidden FROM ({SECRETS}) s")
def placeholder_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Each placeholder put into a message, replaced there by its own host's secret, and put back."""
    pairs = placeholders.generate(_secrets(spark, sf), SEED)
    messages = pairs.select("name", "value", "placeholder", F.col("name").alias("host"), F.concat(F.lit("Authorization: "), F.col("placeholder")).alias("text"))
    sent = placeholders.substitute_by_host(messages, pairs.select(F.col("name").alias("host"), "placeholder", "value"), "text", "sent")
    back = sent.withColumn("back", placeholders.substitute_tracked(F.col("sent"), F.create_map("value", "placeholder"))[0])
    return back.select("name", F.substring("sent", F.lit(16), F.length("sent")).alias("restored"), (~F.col("back").contains(F.col("value")) & placeholders.is_placeholder(F.col("back"))).alias("hidden"))


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def secret_collisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("value"))
    return placeholders.collisions(rows).select("value", "n")


VALUES = "CASE k % 4 WHEN 0 THEN 'a' || chr(13) || chr(10) || 'b' || k WHEN 1 THEN 'ok' || k WHEN 2 THEN 'x' || chr(127) ELSE chr(10) || k END"


@query(f"""SELECT k, CASE k % 4 WHEN 0 THEN 'MULTIPLE' WHEN 2 THEN 'DEL' WHEN 3 THEN 'LF' END AS wrong, replace(replace(replace({VALUES}, chr(13), ''), chr(10), ''), chr(127), '') AS value FROM (SELECT c_custkey AS k FROM customer) a""")
def secret_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"{VALUES} AS v")
    wrong, clean = placeholders.validate(F.col("v"), "sanitize")
    return rows.select("k", wrong.alias("wrong"), clean.alias("value"))


RULES = (("Authorization", "replace"), ("*", "redact"), ("X-*", "passthrough"), ("X-Secret-*", "redact"), ("X-Debug", "detect"))
HEADERS = "CASE k % 6 WHEN 0 THEN 'authorization' WHEN 1 THEN 'X-Api-Id' WHEN 2 THEN 'x-secret-key' WHEN 3 THEN 'X-DEBUG' WHEN 4 THEN 'Cookie' ELSE 'Transfer-Encoding' END"
HOSTS = "CASE k % 4 WHEN 0 THEN 'v1.api.openai.com' WHEN 1 THEN 'api.github.com' WHEN 2 THEN 'internal' ELSE 'h' || k || '.corp.example' END"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"{HEADERS} AS header", f"{HOSTS} AS host")


MESSAGES = f"SELECT k, {HEADERS} AS header, {HOSTS} AS host FROM (SELECT c_custkey AS k FROM customer) a"
ACTION = "CASE k % 6 WHEN 0 THEN 'replace' WHEN 1 THEN 'passthrough' WHEN 3 THEN 'detect' ELSE 'redact' END"


@query(f"SELECT k, {ACTION} AS action FROM ({MESSAGES}) m")
def header_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).select("k", policy.header_action(F.col("header"), RULES).alias("action"))


@query(f"""SELECT host, count(*) FILTER (action = 'replace') AS n_replace, count(*) FILTER (action = 'redact') AS n_redact, count(*) FILTER (action = 'detect') AS n_detect, count(*) FILTER (action = 'passthrough') AS n_passthrough
FROM (SELECT host, {ACTION} AS action FROM ({MESSAGES}) m) x GROUP BY host""")
def process_header_counts(spark: SparkSession, sf: str) -> DataFrame:
    return policy.counts_by_action(_messages(spark, sf).withColumn("action", policy.header_action(F.col("header"), RULES)), "host")


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN '*.openai.com' WHEN 1 THEN 'api.github.com' WHEN 2 THEN 'default' ELSE 'h*.example' END AS policy FROM ({MESSAGES}) m")
def host_policies(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).select("k", policy.host_policy(F.col("host"), ["*.com", "*.openai.com", "api.github.com", "h*.example", "h*"]).alias("policy"))


@query(f"SELECT k FROM ({MESSAGES}) m WHERE host LIKE '%.com' OR host = 'internal'")
def traffic_allowed(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).where(policy.allowed(F.col("host"), ["*.com", "internal"])).select("k")


@query(f"SELECT k, header FROM ({MESSAGES}) m WHERE k % 6 <> 5")
def hop_by_hop_stripped(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).where(~policy.hop_by_hop(F.col("header"))).select("k", "header")


@query(f"""SELECT k, CASE WHEN k % 6 = 0 THEN 'Bearer ph' || k WHEN k % 6 IN (1, 3) THEN 'Bearer AKIA' || upper(substr(md5(CAST(k AS varchar)), 1, 16)) ELSE 'Bearer AKIA' || repeat('x', 16) END AS value FROM ({MESSAGES}) m""")
def process_headers(spark: SparkSession, sf: str) -> DataFrame:
    rows = _messages(spark, sf).withColumn("action", policy.header_action(F.col("header"), RULES)).withColumn("value", F.expr("'Bearer AKIA' || upper(substr(md5(CAST(k AS string)), 1, 16))"))
    done = D.redact(rows, "value", "clean")
    replaced = F.concat(F.lit("Bearer ph"), F.col("k"))
    return done.select("k", F.when(F.col("action") == "replace", replaced).when(F.col("action") == "redact", F.col("clean")).otherwise(F.col("value")).alias("value"))


@query(f"""SELECT k, CASE WHEN k % 3 = 2 THEN '/p' || k ELSE 'http://proxy:9999/p' || k END AS rewritten, CASE k % 3 WHEN 0 THEN 'https://{'{h}'}/p' || k WHEN 1 THEN 'http://other:8080/p' || k ELSE '/p' || k END AS normal, k % 3 = 0 AS own FROM (SELECT c_custkey AS k FROM customer) a""".replace("{h}", "up.example"))
def location_rewrite(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "CASE c_custkey % 3 WHEN 0 THEN 'https://up.example:443/p' || c_custkey WHEN 1 THEN 'http://other:8080/p' || c_custkey ELSE '/p' || c_custkey END AS location")
    at = F.col("location")
    return rows.select("k", http.rewrite_location(http.normalize_location(at), F.lit("http"), F.lit("proxy:9999")).alias("rewritten"), http.normalize_location(at).alias("normal"), http.should_rewrite(at, F.lit("UP.example")).alias("own"))


@query("""SELECT k, CASE WHEN k % 4 = 0 THEN 'c' || k WHEN k % 4 = 1 THEN 's' || k ELSE 'h' || k END AS host, CASE WHEN k % 4 = 0 THEN 'connect' WHEN k % 4 = 1 THEN 'sni' ELSE 'host' END AS source, k % 4 >= 2 AS consistent FROM (SELECT c_custkey AS k FROM customer) a""")
def host_identification(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "CASE WHEN c_custkey % 4 = 0 THEN 'c' || c_custkey END AS c", "CASE WHEN c_custkey % 4 < 2 THEN 's' || c_custkey END AS s", "'H' || c_custkey AS h")
    found = http.identify_host(F.col("c"), F.col("s"), F.lower("h"), F.lit(None).cast("string"))
    return rows.select("k", found.alias("f")).select("k", "f.host", "f.source", "f.consistent")


@query("SELECT status, status BETWEEN 100 AND 199 OR status IN (204, 304) AS bodyless FROM (SELECT DISTINCT CAST(100 + c_custkey % 500 AS INT) AS status FROM customer) s")
def bodyless_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("CAST(100 + c_custkey % 500 AS INT) AS status").distinct()
    return rows.select("status", http.bodyless(F.col("status")).alias("bodyless"))


@query("SELECT c_custkey AS k, 'POST' AS method, '/a/' || c_custkey AS path, 'h' || c_custkey || '.example' AS host, 8443 AS port, 5 AS length, TRUE AS alive FROM customer")
def parse_requests(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("POST /a/"), F.col("k"), F.lit("?q=1 HTTP/1.1\r\nHost: h"), F.col("k"), F.lit(".example:8443\r\ncontent-length: 5\r\n\r\nhello"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k")).withColumn("raw", raw)
    line = F.substring_index("raw", "\r\n", 1)
    all_ = http.headers(F.substring("raw", F.instr("raw", "\r\n") + 2, F.length("raw")))
    at = http.host_port(http.header(F.col("h"), "host"))
    return rows.withColumn("h", all_).select("k", http.request_line(line)["method"].alias("method"), http.path_of(line).alias("path"), at["host"].alias("host"), at["port"].alias("port"), http.content_length(F.col("h")).cast("int").alias("length"), http.keep_alive(F.col("h")).alias("alive"))


@query("SELECT c_custkey AS k, 'hello ' || c_name AS body FROM customer")
def chunked_bodies(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("c_name")
    body = F.concat(F.lit("6;x=1\r\nhello \r\n"), F.lower(F.hex(F.octet_length(name))), F.lit("\r\n"), name, F.lit("\r\n0\r\n\r\n"))
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), http.dechunk(body).alias("body"))


def _chunks(spark: SparkSession, sf: str, size: int = 37) -> DataFrame:
    """The seeded corpus, cut into chunks of a few characters each."""
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1), lambda i: F.substring("text", i * size + 1, F.lit(size)))
    return seeded(spark, sf).select(F.col("doc_id").alias("stream_id"), F.posexplode(cut).alias("chunk_seq", "data"))


@query(ORACLES["redact_text"].replace("d.doc_id,", "d.doc_id AS stream_id,").replace(", CAST(coalesce(n, 0) AS INT) AS n_matches", ", coalesce(n, 0) AS patterns_found"))
def chunk_redaction(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.redact_chunks(_chunks(spark, sf)).select("stream_id", "redacted", "patterns_found")


@query(f"SELECT sum(strlen(text)) AS bytes_read, sum(strlen(text)) AS bytes_written, CAST(sum((length(text) + 36) // 37) AS BIGINT) AS chunks_processed, (SELECT count(*) FROM ({FOUND}) f) AS patterns_found FROM ({DOCS}) d")
def stream_stats(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.merge_stats(redaction.redact_chunks(_chunks(spark, sf)))


@query()
def conversation_streams(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("chunk_seq"), F.col("text").alias("data"))
    return redaction.redact_chunks(turns)


# what is reported and what is redacted, selected apart

TOLD = f"""t AS (SELECT doc_id, string_agg(tier || '=' || cnt, ',' ORDER BY tier) AS warnings FROM (SELECT doc_id, {TIER} AS tier, count(*) AS cnt FROM ({FOUND}) f GROUP BY ALL) g WHERE tier IN ('INFRASTRUCTURE', 'SERVICES', 'PATTERNS') GROUP BY doc_id)"""
ENGINE = D.Engine(S.Selector.parse("tier:infrastructure,services,patterns"), S.Selector.parse("CRITICAL"))


@query(ORACLES["redact_critical"].replace("WITH r AS", f"WITH {TOLD},\nr AS").replace("AS n_matches FROM", "AS n_matches, coalesce(t.warnings, '') AS warnings FROM") + " LEFT JOIN t USING (doc_id)")
def detect_and_redact(spark: SparkSession, sf: str) -> DataFrame:
    found = ENGINE.detect_and_redact(seeded(spark, sf).select("doc_id", "text"))
    told = F.array_join(F.transform(F.array_sort(F.map_entries("warnings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return found.select("doc_id", "redacted", "n_matches", told.alias("warnings"))


@query(f"SELECT doc_id, {TIER} AS tier, count(*) AS cnt FROM ({FOUND}) f WHERE pattern_type >= 200 GROUP BY ALL")
def detect_only(spark: SparkSession, sf: str) -> DataFrame:
    return ENGINE.detect_only(seeded(spark, sf).select("doc_id", "text"), "doc_id")


@query("SELECT 'Detect: tiers INFRASTRUCTURE, SERVICES, PATTERNS, Redact: tiers CRITICAL' AS described")
def describe_engine(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(ENGINE.describe(),)], "described string")


@query(f"SELECT count(*) AS n_rows, sum(strlen(text)) AS bytes_read, sum(strlen(text)) AS bytes_written, (SELECT count(*) FROM ({FOUND}) f) AS patterns_found FROM ({DOCS}) d")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return texts.summary(D.redact(seeded(spark, sf).select("doc_id", "text")))


#: Placeholders stand in for these; none has both marks of a detector's prefix and a token, so only the redaction itself changes them.
@query(f"SELECT doc_id, list_contains([9], kind) AS held FROM ({DOCS}) d")
def placeholders_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose only match holds the placeholder mark: found, but not when placeholders are skipped."""
    docs = seeded(spark, sf).select("doc_id", "text")
    every, kept = (D.matches(docs, skip_placeholders=skip).groupBy("doc_id").agg(F.count(F.lit(1)).alias(n)) for skip, n in ((False, "n"), (True, "m")))
    return docs.join(every, "doc_id", "left").join(kept, "doc_id", "left").select("doc_id", (F.col("n").isNotNull() & F.col("m").isNull()).alias("held"))


AUTO = f"""CASE k % 3 WHEN 0 THEN 'API_KEY = AKIA' || upper(substr(md5(CAST(k AS {{str}})), 1, 16)) || chr(10) || 'PATH=/bin' WHEN 1 THEN 'a note on AKIA' || upper(substr(md5(CAST(k AS {{str}})), 1, 16)) || chr(10) || 'end' ELSE '' END"""


@query(f"""SELECT k, CASE k % 3 WHEN 0 THEN 'env' ELSE 'text' END AS format, CASE k % 3 WHEN 0 THEN 'API_KEY=AKIA' || repeat('x', 16) || chr(10) || 'PATH=/bin' || chr(10) WHEN 1 THEN 'a note on AKIA' || repeat('x', 16) || chr(10) || 'end' ELSE '' END AS redacted
FROM (SELECT c_custkey AS k FROM customer) a""")
def redact_auto(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", AUTO.format(str="string") + " AS text")
    return formats.redact_auto(rows).select("k", "format", "redacted")


@query("SELECT k, CASE k % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'binary' ELSE 'text' END AS format FROM (SELECT c_custkey AS k FROM customer) a")
def binary_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), F.expr("CASE c_custkey % 4 WHEN 0 THEN 'a' || chr(0) || 'b' WHEN 1 THEN repeat(chr(1), 4) || 'abc' WHEN 2 THEN 'plain words' ELSE 'one' || chr(1) || ' in many' END").alias("text"))
    return rows.select("k", formats.format_of(F.col("text")).alias("format"))


# catalog and selectors


@query("SELECT type, n FROM (VALUES ('fast', 380), ('structured', 1), ('regex', 24)) t(type, n)")
def list_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return S.by_type(C.catalog(spark)).select("type", "n")


@query("SELECT * FROM (VALUES ('CRITICAL', 95, TRUE), ('HIGH', 85, TRUE), ('MEDIUM', 65, FALSE), ('LOW', 40, FALSE), ('GENERIC', 30, FALSE), (NULL, NULL, NULL)) t(name, score, redacted)")
def severities(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("critical",), (" 85 ",), ("Medium",), ("40",), ("GENERIC",), ("worst",)], "spec string")
    return rows.select(S.severity(F.col("spec")).alias("s")).select("s.name", "s.score", "s.redacted")


@query("SELECT * FROM (VALUES ('cloud-provider,AI', 'CloudProvider|AI'), ('code-host', 'CodeHost'), ('database,nothing', NULL)) t(spec, found)")
def category_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("cloud-provider,AI",), ("code-host",), ("database,nothing",)], "spec string")
    return rows.select("spec", F.array_join(S.parsed_list(F.col("spec"), S.category), "|").alias("found"))


@query("SELECT * FROM (VALUES ('all', 'all', ''), ('flag', 'tiers', 'CRITICAL'), ('env', 'tiers', 'SERVICES'), ('globs', 'patterns', 'aws-*'), ('tags', 'tags', 'cloud*'), ('wild', 'wildcard', 'git*')) t(given, kind, chosen)")
def selector_precedence(spark: SparkSession, sf: str) -> DataFrame:
    env = {"DETECT_PATTERNS": "services"}
    found = {"all": S.resolve(env={}), "flag": S.resolve("critical", env), "env": S.resolve(env=env), "globs": S.resolve("patterns:aws-*"), "tags": S.resolve("tags:cloud*"), "wild": S.resolve("wildcard:git*")}
    return spark.createDataFrame([(k, v.kind, ",".join(v.values)) for k, v in found.items()], "given string, kind string, chosen string")


@query("SELECT * FROM (VALUES ('aws-akia', 0, 14), ('aws-asia', 0, 15), ('aws-abia', 0, 16), ('aws-acca', 0, 17), ('github-ghp', 1, 18), ('github-ghu', 1, 19), ('github-ghs', 1, 20)) t(name, first, own)")
def resolve_pattern_names(spark: SparkSession, sf: str) -> DataFrame:
    rows = C.catalog(spark).where("kind = 'simple'").withColumn("place", F.col("pattern_type"))
    return S.resolve_names(rows, ["aws-*", "github-gh?", "aws-akia"]).select("name", "place.first", "place.own")


@query("SELECT * FROM (VALUES ('-----BEGIN RSA PRIVATE KEY-----', '0'), ('-----BEGIN PGP MESSAGE-----', '10'), ('-----BEGIN CERTIFICATE', '4,5'), ('-----BEGIN other thing', ''), ('short', NULL)) t(text, candidates)")
def marker_candidates(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([("-----BEGIN RSA PRIVATE KEY-----",), ("-----BEGIN PGP MESSAGE-----",), ("-----BEGIN CERTIFICATE",), ("-----BEGIN other thing",), ("short",)], "text string")
    found = S.marker_candidates(F.col("text"), F.lit(0))
    return rows.select("text", F.when(F.length("text") >= 8, F.coalesce(F.array_join(found, ","), F.lit(""))).alias("candidates"))


@query("SELECT c_custkey AS k, CASE WHEN instr(c_name, '#') > 0 THEN CAST(instr(c_name, '#') - 1 AS INT) END AS at, 0 AS empty FROM customer")
def find_first_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k"), S.first_prefix(F.col("c_name"), "#").alias("at"), S.first_prefix(F.col("c_name"), "").alias("empty"))


# policies and exchanges

PLACE = [("ph-one-1234", "secretvalue1"), ("ph-two-5678", "secretvalue2")]
POLICY = exchange.Policy(
    exchange.HostPolicy((("Authorization", "replace"), ("X-Debug", "detect"), ("X-*", "passthrough"), ("*", "redact"))),
    {"api.github.com": exchange.HostPolicy((("*", "passthrough"),), "passthrough", "detect"), "*.openai.com": exchange.HostPolicy((), "detect", "passthrough")}, tuple(PLACE),
)
KEY = "'AKIA' || upper(substr(md5(CAST(k AS {str})), 1, 16))"


def _exchanges(spark: SparkSession, sf: str) -> DataFrame:
    key = KEY.format(str="string")
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"{HOSTS} AS host", f"{key} AS key")
    head = "array(struct('Authorization' AS k, 'Bearer ph-one-1234' AS v), struct('X-Debug' AS k, key AS v), struct('X-Id' AS k, key AS v), struct('Cookie' AS k, 'c=' || key AS v))"
    return rows.selectExpr("k", "host", f"{head} AS headers", "'use ph-two-5678 and ' || key AS body")


@query(f"""SELECT k, CASE WHEN k % 4 = 1 THEN 'Bearer ph-one-1234' ELSE 'Bearer secretvalue1' END AS auth, {KEY.format(str="varchar")} AS debug, {KEY.format(str="varchar")} AS id,
CASE WHEN k % 4 = 1 THEN 'c=' || {KEY.format(str="varchar")} ELSE 'c=AKIA' || repeat('x', 16) END AS cookie, 4 AS headers_processed, CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS placeholders_replaced,
CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS secrets_redacted, CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS secrets_detected, CASE WHEN k % 4 = 1 THEN '' ELSE 'header:X-Debug/CRITICAL/detected|header:Cookie/CRITICAL/redacted' END AS events FROM ({MESSAGES}) m""")
def process_headers_by_policy(spark: SparkSession, sf: str) -> DataFrame:
    done = exchange.process_headers(_exchanges(spark, sf), POLICY)
    v = lambda name: http.header(F.col("headers"), name)
    events = F.array_join(F.transform("events", lambda e: F.concat_ws("/", e["location"], e["name"], e["action"])), "|")
    return done.select("k", v("Authorization").alias("auth"), v("X-Debug").alias("debug"), v("X-Id").alias("id"), v("Cookie").alias("cookie"), "headers_processed", "placeholders_replaced", "secrets_redacted", "secrets_detected", events.alias("events"))


@query(f"""SELECT k, CASE WHEN k % 4 IN (0, 1) THEN 'use ph-two-5678 and ' || {KEY.format(str="varchar")} ELSE 'use ph-two-5678 and AKIA' || repeat('x', 16) END AS body, 40 AS bytes_processed,
CASE WHEN k % 4 IN (0, 1) THEN 0 ELSE 1 END AS secrets_redacted, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS secrets_detected FROM ({MESSAGES}) m""")
def process_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return exchange.process_body(_exchanges(spark, sf), POLICY).select("k", "body", "bytes_processed", "secrets_redacted", "secrets_detected")


@query(f"""SELECT k, CASE WHEN k % 4 = 1 THEN 'use ph-two-5678 and ' ELSE 'use secretvalue2 and ' END || {KEY.format(str="varchar")} AS sent, CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS replaced, CASE WHEN k % 4 = 1 THEN 'got secretvalue2' ELSE 'got ph-two-5678' END AS got,
CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS restored, CASE WHEN k % 4 <> 1 THEN '15' END AS length FROM ({MESSAGES}) m""")
def exchanges(spark: SparkSession, sf: str) -> DataFrame:
    rows = _exchanges(spark, sf).withColumnsRenamed({"headers": "request_headers", "body": "request_body"}).selectExpr("*", "200 AS status", "array(struct('Server' AS k, 's' AS v)) AS response_headers", "'got secretvalue2' AS response_body")
    done = exchange.handle(rows, POLICY)
    return done.select("k", F.col("request_body").alias("sent"), "replaced", F.col("response_body").alias("got"), "restored", http.header(F.col("response_headers"), "content-length").alias("length"))


@query(f"""SELECT k, CASE k % 3 WHEN 0 THEN 'key AKIA' || repeat('x', 16) WHEN 1 THEN 'key AK' END AS body, 'http://proxy:9999/p' AS location, 'X-Key,Location,Connection,X-Redacted' AS names, 'AKIA' || repeat('x', 16) AS x_key, CASE k % 3 WHEN 0 THEN 2 ELSE 1 END AS patterns_found
FROM (SELECT c_custkey AS k FROM customer) a""")
def stream_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"{KEY.format(str='string')} AS key")
    way = F.expr("element_at(array(struct('Transfer-Encoding' AS k, 'chunked' AS v), struct('Content-Length' AS k, '6' AS v), struct('Content-Length' AS k, '0' AS v)), CAST(k % 3 AS INT) + 1)")
    head = F.array(F.expr("struct('X-Key' AS k, key AS v)"), way, F.expr("struct('Location' AS k, 'https://up.example:443/p' AS v)"))
    body = F.when(F.col("k") % 3 == 0, http.rechunk(F.concat(F.lit("key "), F.col("key")), 7)).otherwise(F.concat(F.lit("key "), F.col("key")))
    rows = rows.select("k", F.when(F.col("k") % 3 == 2, 204).otherwise(200).alias("status"), head.alias("headers"), body.alias("body"))
    done = exchange.stream_responses(rows, upstream="up.example", proxy="proxy:9999")
    v = lambda name: http.header(F.col("headers"), name)
    return done.select("k", "body", v("location").alias("location"), F.array_join(F.transform("headers", lambda h: h["k"]), ",").alias("names"), v("x-key").alias("x_key"), "patterns_found")


@query(f"""SELECT k, CASE WHEN k % 4 = 1 THEN 'Bearer ph-one-1234' ELSE 'Bearer secretvalue1' END AS auth, 'Authorization,X-Debug,X-Id,Cookie' AS names, CASE WHEN k % 4 = 1 THEN 'use ph-two-5678 and ' ELSE 'use secretvalue2 and ' END || {KEY.format(str="varchar")} AS body,
CASE WHEN k % 4 = 1 THEN 0 ELSE 1 END AS replaced FROM ({MESSAGES}) m""")
def stream_requests(spark: SparkSession, sf: str) -> DataFrame:
    more = F.expr("array(struct('Connection' AS k, 'keep-alive' AS v), struct('TE' AS k, 'trailers' AS v))")
    done = exchange.stream_requests(_exchanges(spark, sf).withColumn("headers", F.concat("headers", more)), POLICY)
    return done.select("k", http.header(F.col("headers"), "Authorization").alias("auth"), F.array_join(F.transform("headers", lambda h: h["k"]), ",").alias("names"), "body", "replaced")


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 400 WHEN 1 THEN 405 WHEN 2 THEN 404 ELSE 200 END AS status, CASE WHEN c_custkey % 4 = 3 THEN CASE WHEN c_custkey % 8 = 3 THEN 'A=p1' || chr(10) || 'B=p2' || chr(10) ELSE '{"A":"p1","B":"p2"}' END END AS answer FROM customer""")
def discovery(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr("CASE k % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST /placeholders HTTP/1.1' WHEN 2 THEN 'GET /other HTTP/1.1' ELSE 'GET /placeholders HTTP/1.1' END || CASE WHEN k % 8 = 7 THEN '\r\nAccept: application/json' ELSE '' END || '\r\n\r\n'")
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").withColumn("raw", raw)
    known = spark.createDataFrame([("B", "p2"), ("A", "p1")], "name string, placeholder string")
    return placeholders.discovery(rows, known).select("k", "status", "answer")


@query("SELECT c_custkey AS k, '/api/v' || c_custkey % 3 || '/x' AS path, c_custkey % 3 <> 1 AS redacted FROM customer")
def path_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "'/api/v' || c_custkey % 3 || '/x' AS path")
    return rows.select("k", "path", policy.path_rule(F.col("path"), [("/api/v1/*", False), ("/api/*", True)]).alias("redacted"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN 'h' || c_custkey || ':8443' WHEN 1 THEN 'h' || c_custkey || ':80' END AS authority, CASE c_custkey % 3 WHEN 0 THEN 'GET /base/p HTTP/1.1' WHEN 1 THEN 'GET /p HTTP/1.1' END AS line FROM customer""")
def fixed_upstream(spark: SparkSession, sf: str) -> DataFrame:
    url = F.expr("CASE k % 3 WHEN 0 THEN 'https://h' || k || ':8443/base/' WHEN 1 THEN 'http://h' || k ELSE 'ftp://h' END")
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").withColumn("at", http.upstream(url))
    return rows.select("k", http.authority(F.col("at")).alias("authority"), F.when(F.col("at").isNotNull(), http.upstream_line(F.lit("GET /p HTTP/1.1"), F.col("at"))).alias("line"))


@query("SELECT c_custkey AS k, 200 AS status, 'OK then' AS reason, 'hel' AS body, 'HTTP/1.1 200 OK then' || chr(10) || 'Content-Length: 3' || chr(10) || 'hel' AS scanned FROM customer")
def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("HTTP/1.1 200 OK then\r\nContent-Length: 3\r\n\r\nhello"), F.col("k"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k")).withColumn("r", http.parse_response(raw))
    line = F.concat_ws(" ", "r.line.version", "r.line.status", "r.line.reason")
    return rows.select("k", "r.line.status", "r.line.reason", "r.body", http.all_text(line, F.col("r.headers"), F.col("r.body")).alias("scanned"))


# streams


@query(f"""SELECT doc_id AS stream_id, pattern_type, start, "end" FROM ({FOUND}) f""")
def detect_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return redaction.detect_chunks(_chunks(spark, sf)).select("stream_id", "pattern_type", "start", "end")


LONG = "'-----BEGIN RSA PRIVATE KEY-----' || chr(10) || repeat(upper({md5}) || chr(10), 50) || '-----END RSA PRIVATE KEY-----' || chr(10)"


@query(f"SELECT k AS stream_id, 'a ' || repeat('x', strlen(key)) || 'b' AS redacted, 1 AS patterns_found FROM (SELECT k, {LONG.format(md5='md5(CAST(k AS varchar))')} AS key FROM (SELECT c_custkey AS k FROM customer) a) b")
def chunk_redaction_long(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of 1.7 kB in chunks of 256 characters."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k").selectExpr("k", f"'a ' || {LONG.format(md5='md5(CAST(k AS string))')} || 'b' AS text")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 256).cast("int") - 1), lambda i: F.substring("text", i * 256 + 1, F.lit(256)))
    return redaction.redact_chunks(rows.select(F.col("k").alias("stream_id"), F.posexplode(cut).alias("chunk_seq", "data"))).select("stream_id", "redacted", "patterns_found")


@query("SELECT c_custkey AS stream_id, 'use secretvalue1 for ' || c_name || ' and secretvalue2' AS redacted, 2 AS patterns_found FROM customer")
def substitute_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/customer.parquet").selectExpr("c_custkey AS k", "'use ph-one-1234 for ' || c_name || ' and ph-two-5678' AS text")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / 7).cast("int") - 1), lambda i: F.substring("text", i * 7 + 1, F.lit(7)))
    return redaction.substitute_chunks(rows.select(F.col("k").alias("stream_id"), F.posexplode(cut).alias("chunk_seq", "data")), dict(PLACE)).select("stream_id", "redacted", "patterns_found")


@query("SELECT c_custkey AS k, 'key AKIA' || repeat('x', 16) || ' end' AS body FROM customer")
def redact_chunked_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies in chunked transfer coding, decoded and redacted as a whole, so that keys which chunks cut are found."""
    text = F.concat(F.lit("key "), F.expr(KEY.format(str="string")), F.lit(" end"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("k")).withColumn("raw", http.rechunk(text, 9))
    return D.redact(rows.withColumn("raw", http.dechunk(F.col("raw"))), "raw", "body").select("k", "body")


@query("""SELECT conv_id AS stream_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS redacted, 0 AS patterns_found, TRUE AS done FROM conversations GROUP BY conv_id""")
def stream_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as a streaming source, turns as chunks, through the stateful operator; the generated ones hold no secrets."""
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    ends = table.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    # a pattern, as a streaming source takes no path of a single file
    turns = spark.readStream.schema(table.schema).parquet(f"{sf}/conversations.parque[t]").join(ends, "conv_id")
    chunks = turns.select(F.col("conv_id").cast("long").alias("stream_id"), (F.col("turn") - F.col("first")).cast("long").alias("chunk_seq"), F.col("text").alias("data"), (F.col("turn") == F.col("last")).alias("is_eof"))
    sent = run.to_table(redaction.redact_stream(chunks))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("out_seq", "redacted"))), lambda x: x["redacted"]), "")
    return sent.groupBy("stream_id").agg(text.alias("redacted"), F.max("patterns_found").alias("patterns_found"), F.max("done").alias("done"))
