"""Queries of the library over the driver-style tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from inspect import getmembers, isfunction

from pyspark.sql import DataFrame, SparkSession

from groundwork.plans import queries, queries_review
from groundwork.plans.oracle import SQL
from groundwork.plans.oracle_review import SQL as REVIEW_SQL

FLAGSHIP = "find_quotes"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for module in (queries, queries_review) for name, f in getmembers(module, isfunction) if f.__module__ == module.__name__ and not name.startswith("_")
}
ORACLE_SQL: dict[str, str] = {name: sql for name, sql in {**SQL, **REVIEW_SQL}.items() if name in QUERIES}
