"""Registered queries, each beside the SQL that states the same result.

A query takes ``(spark, sf_dir)``; its SQL runs on the same tables.  Folds are
stated in SQL as recursions over row numbers.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MODULES = ("bars", "vpin", "detectors", "alerts", "wire", "regime", "labels", "execution", "book", "ledger",
           "operators", "health", "universe", "streams")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"tapeworks.catalog.{m}")
