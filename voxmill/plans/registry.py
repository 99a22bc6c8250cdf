"""All registered queries of the feedback operators and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmill.plans import counting, curating, reading, searching, surges

Query = Callable[[SparkSession, str], DataFrame]
_PARTS = (counting, surges, searching, curating, reading)


def queries() -> dict[str, Query]:
    return {name: query for part in _PARTS for name, (query, _) in part.PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, (_, sql) in part.PLANS.items() if sql}
