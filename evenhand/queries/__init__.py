"""Registered queries and the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register the decorated function under its name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def load_all() -> None:
    from evenhand.queries import (  # noqa: F401
        audits,
        continuous,
        drift,
        ingest,
        mitigation,
        monitoring,
        privacy,
        reports,
    )
