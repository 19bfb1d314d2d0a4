"""Schema guards shared by the operators; they look at the plan's schema and run no job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")


def fail_if_any(df: DataFrame, violation: Column, message: str) -> None:
    """Raise when any row violates; one early-stopping job."""
    if not df.where(violation).limit(1).isEmpty():
        raise ValueError(message)


def fail_if_duplicated(df: DataFrame, keys: list[str], message: str) -> None:
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1)
    if not repeated.limit(1).isEmpty():
        raise ValueError(message)
