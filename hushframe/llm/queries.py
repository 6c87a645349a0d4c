"""The corpus operators' queries and their SQL, for the driver's entry."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that has a function of that name, and ORACLE_SQL where SQL can express it.
MODULES = {
    "op1_pii": "pii",
    "op2_neardup": "neardup",
    "op3_decontamination": "decontam",
    "op4_sharding": "sharding",
    "op5_toxicity": "toxicity",
    "op6_jaccard": "jaccard",
    "op7_html": "html",
    "op8_warc": "warc",
    "op9_packing": "packing",
    "op10_licenses": "licenses",
    "proximity_matches": "decontam",
}
#: Queries whose SQL has a name of its own in the module.
SQL = {"proximity_matches": "PROXIMITY_SQL"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), SQL.get(name, "ORACLE_SQL"), None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
