"""Text sources and sinks, secrets from an environment, and configuration files."""

from __future__ import annotations

import json
import os
import re
import warnings
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import TIERS

#: Globs of variables that hold secrets, unless said otherwise. Fixed values.
DEFAULT_GLOBS = ("*_API_KEY", "*_SECRET", "*_TOKEN")
#: The seed where none is given.
DEFAULT_SEED = "policy-seed"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files, each one text whatever its size; nothing is cut between files' parts."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the lines of files, for logs."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_text(df: DataFrame, path: str, text_col: str = "redacted") -> None:
    """Texts as files of lines."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def redact_files(spark: SparkSession, source: str, target: str) -> None:
    """Read texts line by line, redact them, write them; files are split and redacted in parallel."""
    from ..operators.detect import redact

    write_text(redact(lines(spark, source)), target)


def env_glob(name: str, pattern: str) -> bool:
    """A glob over names of variables: * is any run; other characters, ? and brackets too, are themselves."""
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), name, re.S) is not None


def env_secrets(
    spark: SparkSession, env: Mapping[str, str] | None = None, names: tuple[str, ...] = (), prefix: str | None = None, globs: tuple[str, ...] = DEFAULT_GLOBS, on_missing: str = "warn", on_invalid: str = "fail"
) -> DataFrame:
    """(name, value) of the variables named, with the prefix, or fitting a glob, by name.

    ``on_missing``, for names that are not there: fail, warn or ignore. ``on_invalid``, for values with characters that are dangerous in a header: fail, warn
    (they are left out) or sanitize. Two names of one value are an error, as a value must lead back to one name."""
    env = os.environ if env is None else env
    missing = sorted(n for n in names if n not in env)
    if missing and on_missing == "fail":
        raise KeyError(f"no such variables: {missing}")
    if missing and on_missing == "warn":
        warnings.warn(f"no such variables, left out: {missing}", stacklevel=2)
    found = {}
    for n, v in sorted(env.items()):
        if v and (n in names or (prefix and n.startswith(prefix)) or any(env_glob(n, g) for g in globs)):
            clean = re.sub("[\x00\r\n\x7f]", "", v)
            if clean != v and on_invalid == "fail":
                raise ValueError(f"{n} has characters that are dangerous in a header")
            if clean != v and on_invalid == "warn":
                warnings.warn(f"{n} has characters that are dangerous in a header, left out", stacklevel=2)
                continue
            found[n] = clean
    by_value: dict[str, str] = {}
    for n in sorted(found):
        if (other := by_value.setdefault(found[n], n)) != n:
            raise ValueError(f"{other} and {n} have the same value")
    return spark.createDataFrame(sorted(found.items()), "name string, value string")


def env_value(name: str, default: str | int | bool | list[str], env: Mapping[str, str] | None = None) -> str | int | bool | list[str]:
    """A variable as what its default is: text, number, truth (true, 1, yes, on and their opposites) or comma-separated list. One that is absent or
    cannot be read is the default; so is an empty list."""
    value = (os.environ if env is None else env).get(name)
    if value is None:
        return default
    if isinstance(default, bool):
        return {"true": True, "1": True, "yes": True, "on": True, "false": False, "0": False, "no": False, "off": False}.get(value.lower(), default)
    if isinstance(default, int):
        return int(value) if re.fullmatch(r"[+-]?\d+", value) else default
    if isinstance(default, list):
        return [x.strip() for x in value.split(",")] if value else default
    return value


def expand_seed(seed: str | None, env: Mapping[str, str] | None = None) -> str:
    """A seed with ${NAME} or $NAME from the environment; the default one if nothing is given."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: env.get(m[1] or m[2], DEFAULT_SEED), seed) if seed else DEFAULT_SEED


def _read_config(path: str) -> dict:
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".json"):
        return json.loads(data)
    if path.endswith(".toml"):
        import tomllib

        return tomllib.loads(data.decode())
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError(f"{path} is YAML, for which no library is installed") from missing
    return yaml.safe_load(data) or {}


#: Variables that override a place in the configuration, if the part it belongs to is there: name after the prefix, path, kind. Fixed values.
OVERRIDES = (
    ("PROXY_LISTEN_PORT", ("proxy", "listen", "port"), "port"), ("PROXY_UPSTREAM_URL", ("proxy", "upstream", "url"), "text"),
    ("CLI_STREAMING", ("cli", "streaming"), "truth"), ("MITM_LISTEN_PORT", ("mitm", "listen", "port"), "port"),
)


def load_config(paths: list[str], env: Mapping[str, str] | None = None, prefix: str = "HUSHFRAME_") -> dict:
    """The first configuration file there is (JSON, TOML, or, if its library is installed, YAML), with the environment's overrides, checked."""
    env = os.environ if env is None else env
    config = next((_read_config(p) for p in paths if os.path.exists(p)), {})
    for name, path, kind in OVERRIDES:
        value = env.get(prefix + name)
        if value is None or path[0] not in config or (kind == "port" and not (value.isdigit() and int(value) < 65_536)):
            continue
        at = config
        for k in path[:-1]:
            at = at.setdefault(k, {})
        at[path[-1]] = int(value) if kind == "port" else value.lower() == "true" if kind == "truth" else value
    return checked(config)


def checked(config: dict) -> dict:
    """A configuration whose parts fit together: an allow-list switches its traffic policy on; a proxy needs an upstream with scheme and host, and its
    path rules a path; unknown tiers are warned of."""
    from urllib.parse import urlsplit

    traffic = config.get("mitm", {}).get("traffic", {})
    if traffic.get("mode") == "allow-list":
        traffic["enabled"] = True
    if "proxy" in config:
        url = config["proxy"].get("upstream", {}).get("url")
        if not url or not urlsplit(url).scheme or not urlsplit(url).netloc:
            raise ValueError(f"the proxy has no upstream that could be reached: {url!r}")
        if any(not r.get("path") for r in config["proxy"].get("rules", [])):
            raise ValueError("a path rule has no path")
    patterns = config.get("cli", {}).get("patterns", {})
    unknown = sorted({t for k in ("detect", "redact") for t in patterns.get(k, [])} - {t for t, *_ in TIERS})
    if unknown:
        warnings.warn(f"unknown tiers: {unknown}", stacklevel=2)
    return config


def summary(redacted: DataFrame, text_col: str = "text", out_col: str = "redacted") -> DataFrame:
    """What a run did: rows, bytes read and written, matches redacted."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(c).cast("long")), F.lit(0))
    return redacted.agg(F.count(F.lit(1)).alias("n_rows"), size(text_col).alias("bytes_read"), size(out_col).alias("bytes_written"), F.coalesce(F.sum("n_matches"), F.lit(0)).cast("long").alias("patterns_found"))
