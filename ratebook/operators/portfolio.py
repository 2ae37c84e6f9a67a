"""Portfolio-level filters and the centred benefit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portfolio_filter(df: DataFrame, type_col: str, type_value: str) -> DataFrame:
    """Filter by quote type (P12); pushed down to the Parquet scan."""
    return df.filter(F.col(type_col) == type_value)


def id_prefix(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Keep ids whose decimal text starts with ``prefix``.

    With a fixed id width the same test is the range
    ``[prefix * 10^k, (prefix + 1) * 10^k)``, which Parquet can prune.
    """
    return df.filter(F.col(key).cast("string").startswith(prefix))


def renewing_in(df: DataFrame, month: int, date_col: str = "policy_start_date") -> DataFrame:
    """Policies whose start (renewal) month is ``month``."""
    return df.filter(F.month(date_col) == month)


def missing_prices(cols: list[str]) -> Column:
    """Any of the listed prices missing."""
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def centred_benefit(df: DataFrame) -> DataFrame:
    """``advantage - mean(model_margin) + mean(own_margin)``.

    The two portfolio means are scalar subqueries: Spark runs them once and
    feeds the values into the projection (no join, no single-partition window).
    """
    means = df.agg(F.avg("model_margin").alias("mm"), F.avg("own_margin").alias("mo"))
    return df.withColumn(
        "benefit",
        F.col("advantage").cast("double") - means.select("mm").scalar() + means.select("mo").scalar())
