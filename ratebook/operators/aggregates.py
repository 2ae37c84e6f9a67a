"""Per-policy aggregates and portfolio checks.

Aggregation happens before joining (claims, earned) so that the joins see
one row per key.  All checks are single aggregations with map-side partial
aggregation; none collects a group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import to_key
from ..functions.semantics import strict_sum
from .reports import long_levels

CLAIM_PARTS = ("clmmat", "clmres", "clmpay", "regres", "regpay")


def net_claim(parts: tuple[str, ...] = CLAIM_PARTS) -> Column:
    """``matured + reserve + paid - recovery reserve - recovery paid``."""
    mat, res, pay, rres, rpay = (F.col(c) for c in parts)
    return mat + res + pay - rres - rpay


def claims_by_policy(claims: DataFrame, snapshot, key: str = "polnum",
                     snap_col: str = "sysdate") -> DataFrame:
    """Net incurred claim per policy at a snapshot (A1); R ``sum`` is strict."""
    return (claims.filter(F.col(snap_col) == F.lit(snapshot))
            .groupBy(to_key(key).alias("polref"))
            .agg(strict_sum(net_claim()).alias("claim")))


def earned_by_policy(earned: DataFrame, period: Column, key: str = "polref",
                     value: str = "earned") -> DataFrame:
    """Earned premium per policy for a period condition (A2)."""
    return earned.filter(period).groupBy(key).agg(strict_sum(value).alias(value))


def is_unique_exprs(key: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"),
            (F.count_distinct(F.col(key)) + F.max(F.col(key).isNull().cast("int"))).alias("n_distinct")]


def is_unique(df: DataFrame, key: str) -> DataFrame:
    """``N == uniqueN(key)``, a missing key counted as one value (A10)."""
    return df.agg(*is_unique_exprs(key)).withColumn("unique", F.col("n") == F.col("n_distinct"))


def varying_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Number of levels per feature and whether it varies (A11; null is a level).

    One ``unpivot`` to (feature, value), ``distinct`` (partially aggregated
    before the shuffle), then a count per feature.
    """
    lv = long_levels(df, features, []).distinct()
    return (lv.groupBy("feature").agg(F.count(F.lit(1)).alias("levels"))
            .withColumn("varies", F.col("levels") > 1))


def varying_feature_names(df: DataFrame, features: list[str]) -> list[str]:
    """Feature names with more than one level, in the given order (small result)."""
    keep = {r["feature"] for r in varying_features(df, features).filter("varies").collect()}
    return [f for f in features if f in keep]


def mean_exprs(cols: list[str]) -> list[Column]:
    return [F.avg(c).alias(f"mean_{c}") for c in cols]


def mean_prices(df: DataFrame, cols: list[str]) -> DataFrame:
    """Portfolio means, missing skipped."""
    return df.agg(*mean_exprs(cols))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))


def id_profile(df: DataFrame, key: str, width: int = 3) -> DataFrame:
    """Count of rows by the first ``width`` digits of the id, ordered."""
    prefix = F.substring(F.col(key).cast("string"), 1, width)
    return df.groupBy(prefix.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy("prefix")


def id_summary(df: DataFrame, key: str) -> DataFrame:
    """Distinct count, min and max of an id."""
    return df.agg(F.count_distinct(key).alias("n_unique"), F.min(key).alias("min_id"),
                  F.max(key).alias("max_id"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """All rows whose key occurs more than once.

    Keys are counted with a partial aggregation and semi-joined back, so a
    hot key is never gathered into one window partition; AQE splits a skewed
    side of the semi join.
    """
    dup = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(key)
    return df.join(dup, key, "left_semi")


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distribution summary (A23), a row a column: n, mean, sd, min, exact quartiles, max; missing values don't count."""
    from .metrics import radix_quantiles
    quartiles = radix_quantiles(df, cols, [0.25, 0.5, 0.75])
    q = df.sparkSession.createDataFrame([(c, *v) for c, v in quartiles.items()], "column string, q1 double, median double, q3 double")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "x")
    stats = long.groupBy("column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"),
                                       F.min("x").alias("min"), F.max("x").alias("max"))
    # a row for each column on both sides
    return stats.join(F.broadcast(q), "column").select("column", "n", "mean", "sd", "min", "q1", "median", "q3", "max")
