"""Small helpers shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def r6(df: DataFrame, *names: str) -> DataFrame:
    """Round the named double columns to 6 places (both engines do the same)."""
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) + F.lit(0.0) for n in names})


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def sr6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0e0 AS {alias}"


def quoted(*names: str) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]


def config_rows(spark, names: list[str], rows: list[tuple]) -> DataFrame:
    """A configuration table of a few literal rows."""
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return spark.range(1).select(F.explode(cells).alias("r")).select("r.*")
