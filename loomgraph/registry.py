"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}" + ",".join(parts) + " "


def r6(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]
