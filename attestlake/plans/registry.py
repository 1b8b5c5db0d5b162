"""All queries of the reference operators and their SQL, by module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple[str, ...] = ("tables", "texts", "attestation", "folds", "detectors", "app", "retrieval", "ingest", "verify", "scalars", "concepts", "streams")

#: Names kept from queries that looked at a part of the rows: they do the whole job now.
SAME = {
    "F14_relevance_prefilter": "F14_relevance_any_item", "X14_verbatim_presence": "X14_verbatim_anywhere", "T3_nulls_last_sort": "T3_nulls_last_all", "F17_exact_quote": "F17_quotes_in_turns",
    "U5_jaccard": "U5_jaccard_pairs",
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= import_module(f"attestlake.plans.{m}").QUERIES
    return out | {name: out[whole] for name, whole in SAME.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= import_module(f"attestlake.plans.{m}").ORACLE
    return out | {name: out[whole] for name, whole in SAME.items() if whole in out}
