"""Named queries: a function of the ledger, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import ledger

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of a Ledger. ``sql`` is a SELECT over the tables of
    ``ledger.CTES``; without it there is no oracle."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(ledger.load(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = ledger.CTES + sql
        return f

    return put
