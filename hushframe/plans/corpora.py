"""Deterministic corpora with known secrets, made by SQL that Spark and other engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: By o_orderkey modulo 12. {sha} and {md5} are the key's hexadecimal digests.
SECRET = """CASE k % 12
WHEN 0 THEN 'AKIA' || upper(substr({md5}, 1, 16))
WHEN 1 THEN 'ghp_' || substr({sha}, 1, 36)
WHEN 2 THEN 'sk-proj-' || substr({sha}, 1, 24)
WHEN 3 THEN 'eyJ' || substr({sha}, 1, 20) || '.eyJ' || substr({sha}, 21, 20) || '.' || substr({sha}, 41, 20)
WHEN 4 THEN 'API_KEY=' || substr({md5}, 1, 12)
WHEN 5 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) || {sha} || chr(10) || '-----END RSA PRIVATE KEY-----'
WHEN 6 THEN 'mongodb://u' || CAST(k AS {str}) || ':' || substr({md5}, 1, 12) || '@db.example.com:27017/app'
WHEN 7 THEN 'https://hooks.slack.com/services/T' || upper(substr({md5}, 1, 8)) || '/B' || upper(substr({md5}, 9, 8)) || '/' || substr({sha}, 1, 24)
WHEN 8 THEN '-----BEGIN PGP MESSAGE-----' || chr(10) || {sha} || chr(10) || '-----END PGP MESSAGE-----'
WHEN 9 THEN 'sk-scrd-' || substr({sha}, 1, 30)
WHEN 10 THEN 'nothing to hide'
ELSE 'AKIA' || upper(substr({md5}, 1, 16)) || '/' || 'AKIA' || upper(substr({md5}, 17, 16)) END"""


def secret_sql(spark_sql: bool) -> str:
    text = "string" if spark_sql else "varchar"
    key = f"CAST(k AS {text})"
    return SECRET.format(md5=f"md5({key})", sha=f"sha2({key}, 256)" if spark_sql else f"sha256({key})", str=text)


def seeded_sql(spark_sql: bool) -> str:
    """(doc_id, kind, secret, text) of every order."""
    text = "string" if spark_sql else "varchar"
    return f"""SELECT k AS doc_id, CAST(k % 12 AS INT) AS kind, secret, 'order ' || CAST(k AS {text}) || chr(10) || secret || chr(10) || 'end' AS text
FROM (SELECT k, {secret_sql(spark_sql)} AS secret FROM (SELECT o_orderkey AS k FROM orders) a) b"""


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    return spark.sql(seeded_sql(True).replace("FROM orders", "FROM {orders}"), orders=orders)
