"""Job registry: name -> (spark, sf_dir) -> DataFrame, plus its DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def job(name: str, sql: str | None = None):
    def deco(fn):
        if name in JOBS:
            raise ValueError(f"duplicate job {name}")
        JOBS[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco
