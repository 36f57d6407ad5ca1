"""Registered queries over the standard tables, with the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import memory, protocols, relational, retrieval, texts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FAMILIES = (retrieval, texts, memory, relational, protocols)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for family in _FAMILIES for name, q in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for family in _FAMILIES for name, q in family.SQL.items()}
