"""Joins of the pricing job: claims, earned, factor lookups, prices, classes.

Broadcast is used only for tables whose size is bounded by construction
(the inline factor tables) or checked against the optimizer's size estimate
(``broadcast_if_small``); everything else is left to Spark's size-checked
join selection and AQE, which switch to sort-merge joins when a side grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PricingConfig
from ..functions.pricing import to_scale
from ..functions.semantics import paste0
from ..session import cut_lineage

# largest side (bytes, optimizer estimate) we hint for broadcast
BROADCAST_LIMIT = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of a plan (file sizes x projection ratio)."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(size if isinstance(size, int) else size.toString())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Broadcast hint only when the estimated size is within ``limit``."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def broadcast_if_few(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Broadcast a table DERIVED from the data when it has at most ``max_rows`` rows.

    The optimizer's size estimate of an aggregate is its input size, so small
    derived tables (rank offsets, level tables, coefficients) would otherwise
    be joined by shuffling the big side.  The table is written once to the
    checkpoint folder, and its row bound is checked by counting at most
    ``max_rows + 1`` of its rows.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key matches a null key; the keys of the left side stay."""
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def _prefix_clashes(left: DataFrame, right: DataFrame, keys: list[str], prefix: str = "i_") -> DataFrame:
    """Rename left columns that clash with right non-key columns (Q17: ``i.`` prefix)."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    return left.withColumnsRenamed({c: prefix + c for c in clash}) if clash else left


def add_claims(pol: DataFrame, claims: DataFrame, key: str = "polref") -> DataFrame:
    """Left join of policies to per-policy claim totals.

    ``claims`` is aggregated by key first (A1), so the right key is unique and
    the left row count is kept.  Both sides are hash-partitioned on the key.
    """
    return pol.join(claims, key, "left")


def add_earned(pol: DataFrame, earned: DataFrame, key: str = "polref") -> DataFrame:
    """Left join to per-policy earned premium."""
    return pol.join(earned, key, "left")


def add_factor(pol: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left lookup on a band or territory key (J3); lookups are broadcast when small."""
    left = _prefix_clashes(pol, lookup, [key])
    return left.join(broadcast_if_small(lookup), key, "left")


def add_bonus(pol: DataFrame, lookup: DataFrame, key: str = "bmcorr") -> DataFrame:
    """Null-safe lookup: a missing bonus class matches the lookup's null row."""
    left = _prefix_clashes(pol, lookup, [key])
    rk = "__r_" + key
    right = broadcast_if_small(lookup.withColumnRenamed(key, rk))
    return left.join(right, left[key].eqNullSafe(right[rk]), "left").drop(rk)


def dedupe_prices(ext: DataFrame, key: str = "polref", price: str = "premium") -> DataFrame:
    """One price per key (largest if repeated): keeps the update join row-preserving."""
    return ext.groupBy(key).agg(F.max(price).alias(price))


def override_price(pol: DataFrame, ext: DataFrame, cfg: PricingConfig = PricingConfig(),
                   key: str = "polref", price: str = "premium", own: str = "a") -> DataFrame:
    """Update join: model price ``p`` taken from an external table.

    Policies without an external price get null; the left row count is kept.
    """
    right = dedupe_prices(ext, key, price).withColumnRenamed(price, "__ext_price")
    out = pol.drop("p").join(right, key, "left")
    return out.withColumn("p", to_scale("__ext_price", own, cfg)).drop("__ext_price")


def add_class(pol: DataFrame, cls: DataFrame, key: str = "polref", cls_key: str = "ujcid") -> DataFrame:
    """Left join of class ids; the key keeps the policy name."""
    right = cls.withColumnRenamed(cls_key, key)
    return pol.join(right, key, "left")


def with_multiplier(oneway: DataFrame, coef: DataFrame, feature: str = "feature",
                    value: str = "value") -> DataFrame:
    """Attach ``multiplier = exp(weight)`` to one-way rows by ``feature || value``.

    ``coef`` has columns ``feature_level`` (feature name followed by level)
    and ``weight``; unmatched rows get a null multiplier.
    """
    left = oneway.withColumn("__fl", paste0(feature, value))
    right = coef.select(F.col("feature_level").alias("__fl"), F.col("weight").alias("__w"))
    out = left.join(broadcast_if_few(right), "__fl", "left")
    return out.withColumn("multiplier", F.exp("__w")).drop("__fl", "__w")


def compare_coefficients(x: DataFrame, y: DataFrame, key: str = "feature_level") -> DataFrame:
    """Full outer merge of two coefficient tables by feature name."""
    return x.join(y, key, "full_outer")


def restrict_to(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Keep rows whose key appears in another table (J10; index alignment)."""
    return df.join(keys.select(key), key, "left_semi")


def complement(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """Rows not in a sample."""
    return df.join(sample.select(key), key, "left_anti")


def smooth_territory(exposure: DataFrame, distance: DataFrame, alpha: float,
                     cutoff_hours: float | None = None, zip_col: str = "zip",
                     claims: str = "claims", expo: str = "exposure") -> DataFrame:
    """Distance-weighted territory frequency.

    ``f_p = (c_p + alpha * sum_i c_i e^-d_ip) / (e_p + alpha * sum_i e_i e^-d_ip)``
    over neighbours ``i != p`` listed in the distance table
    (``zip_i``, ``zip_p``, ``hours``), optionally within a cut-off.  One join
    of the pair list to exposure and one ``groupBy(zip_p)``; no pair is
    generated that the distance table does not list.
    """
    d = distance.filter(F.col("zip_i") != F.col("zip_p"))
    if cutoff_hours is not None:
        d = d.filter(F.col("hours") <= F.lit(cutoff_hours))
    e_i = exposure.select(F.col(zip_col).alias("zip_i"), F.col(claims).alias("c_i"),
                          F.col(expo).alias("e_i"))
    w = F.exp(-F.col("hours"))
    nb = (d.join(e_i, "zip_i").groupBy("zip_p")
          .agg(F.sum(F.col("c_i") * w).alias("sc"), F.sum(F.col("e_i") * w).alias("se")))
    own = exposure.select(F.col(zip_col).alias("zip_p"), F.col(claims).alias("c_p"),
                          F.col(expo).alias("e_p"))
    out = own.join(nb, "zip_p", "left").fillna(0.0, subset=["sc", "se"])
    a = F.lit(float(alpha))
    return out.select(
        F.col("zip_p").alias(zip_col),
        ((F.col("c_p") + a * F.col("sc")) / (F.col("e_p") + a * F.col("se"))).alias("smoothed_freq"),
    )


def smooth_territories(exposure: DataFrame, hours: Callable[[Column, Column], Column], alpha: float,
                       zip_col: str = "zip", claims: str = "claims", expo: str = "exposure", block: int = 1024) -> DataFrame:
    """``smooth_territory`` over ALL other territories, for travel times that are a function of two of them.

    The territories are hashed into blocks of about ``block``.  A block is one
    row, an array; each territory meets each block once and adds up what its
    members give, so rows are made for (territory, block) and not for pairs.
    A territory without a code, or without a travel time to another one, gets
    nothing from it.
    """
    own = cut_lineage(exposure.select(F.col(zip_col).alias("p"), F.col(claims).alias("c_p"), F.col(expo).alias("e_p")))
    n_blocks = max(1, -(-own.count() // block))
    members = own.groupBy(F.pmod(F.xxhash64("p"), F.lit(n_blocks)).alias("b")).agg(
        F.collect_list(F.struct(F.col("p").alias("i"), F.col("c_p").alias("c"), F.col("e_p").alias("e"))).alias("members"))
    met = own.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))).join(members, "b")

    def total(field: str) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return acc + F.coalesce(F.when(x.i != F.col("p"), x[field] * F.exp(-hours(x.i, F.col("p")))), F.lit(0.0))
        return F.aggregate("members", F.lit(0.0), add)

    part = met.select("p", "c_p", "e_p", total("c").alias("sc"), total("e").alias("se"))
    a = F.lit(float(alpha))
    # the parts of a territory are as many as there are blocks
    whole = part.groupBy("p", "c_p", "e_p").agg(F.sum("sc").alias("sc"), F.sum("se").alias("se"))
    return whole.select(F.col("p").alias(zip_col), ((F.col("c_p") + a * F.col("sc")) / (F.col("e_p") + a * F.col("se"))).alias("smoothed_freq"))
