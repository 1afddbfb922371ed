from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    """A plan, and the same in DuckDB's SQL where SQL can express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
