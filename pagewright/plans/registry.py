"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its equivalent in DuckDB's SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


#: Session setting: into how many partitions a large table is spread after it is read. Unset, as on a cluster
#: whose files have many row groups, nothing is shuffled; a file of one row group else keeps one core busy.
SPREAD = "spark.pagewright.spread"
LARGE = ("documents", "pages", "conversations", "lineitem")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found, parts = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.conf.get(SPREAD, None)
    return found.repartition(int(parts)) if parts and name in LARGE else found


def _load() -> None:
    from . import page_queries, search_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
