"""All queries of the library, by name, with the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of tessera.plans that define QUERIES and ORACLES.
MODULES = ("retrieval", "graphs", "naming", "evaluation", "checking", "views", "entry", "modelling", "indexes", "histories", "words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in import_module(f"tessera.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"tessera.plans.{m}").ORACLES.items()}
