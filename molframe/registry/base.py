"""The list of queries: each runs over whole driver tables and, where SQL can say it, names its oracle."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


QUERIES: dict[str, Entry] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register a query under `name`; `ids` are the operators of the survey it shows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Entry(fn, sql, ids)
        return fn

    return add


def with_(*parts: str) -> str:
    """A WITH clause of the given common table expressions."""
    return "WITH RECURSIVE " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n"
