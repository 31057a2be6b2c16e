"""Named queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyframe.functions.scalars import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, body: str, needs: Sequence[str] = ()) -> None:
    CTES[name] = (tuple(needs), body)


def with_ctes(needs: Sequence[str], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for n in CTES[name][0]:
            visit(n)
        if name not in ordered:
            ordered.append(name)

    for n in needs:
        visit(n)
    if not ordered:
        return body
    parts = [f"{n} AS ({CTES[n][1]})" for n in ordered]
    return "WITH " + ",\n".join(parts) + "\n" + body


def query(name: str, sql: str | None = None, needs: Sequence[str] = (), places: int = 6):
    """Register a query; doubles are rounded, dates become text, integers are long."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(spark, sf_dir), places)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(needs, sql)
        return fn

    return register


def plain(df: DataFrame, places: int = 6) -> DataFrame:
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = rounded(c, places)
        elif kind == "date":
            c = c.cast("string")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(x: str, places: int = 6) -> str:
    """SQL rounding without negative zero."""
    return f"(CASE WHEN abs({x}) < 0.5e-{places} THEN 0.0 ELSE round({x}, {places}) END)"
