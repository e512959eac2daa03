"""All queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "strategy_report"
#: Decimals to which results are given: floating sums depend on the order of rows in their last digits.
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to `digits` decimals, without a negative zero; other columns as they are."""
    return df.select([(F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def register(name: str, query: Query, sql: str | None = None, doubles: str = "") -> None:
    """sql: what stands after the shared views. doubles: its columns that are rounded like the query's."""
    from loomspan.plans import views

    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    QUERIES[name].__name__ = name
    if sql:
        body = sql.strip()
        start = next((w for w in ("with recursive ", "with ") if body.startswith(w)), "")
        body = f"{start or 'with '}{views.SQL.strip()}{', ' if start else ' '}{body[len(start):]}"
        cols = ", ".join(f"round(cast({c} as double), {DIGITS}) + 0.0 as {c}" for c in doubles.split())
        ORACLES[name] = f"select * replace ({cols}) from ({body})" if cols else body


def load() -> None:
    """Registers every query once."""
    if not QUERIES:
        from loomspan.plans import linear_queries, log_queries, model_queries, panel_queries, pooled_queries, research_queries, risk_queries, series_queries, source_queries, study_queries

        for module in (series_queries, risk_queries, panel_queries, log_queries, model_queries, study_queries, research_queries, linear_queries, source_queries, pooled_queries):
            module.register_all()
