"""Deterministic train/test splits.

``randomSplit`` depends on partitioning and is not reproducible across
cluster layouts; here the split is a hash of the policy key, so a row lands
in the same split whatever the partitioning, on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import broadcast_if_few, null_safe
from .windows import distributed_rank

MODULUS = 1_000_003
MULTIPLIER = 48_271


def key_hash(key: str, seed: int = 1234) -> Column:
    """Portable hash in ``[0, 1000003)`` (no 64-bit overflow for 11-digit ids)."""
    return F.pmod(F.pmod(F.col(key), F.lit(MODULUS)) * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))


def split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 1234,
          col: str = "split") -> DataFrame:
    """80/20 split flag ``train``/``test`` by key hash (M3)."""
    threshold = int(frac * MODULUS)
    return df.withColumn(col, F.when(key_hash(key, seed) < threshold, "train").otherwise("test"))


def exact_split(df: DataFrame, key: str, frac: float = 0.8, seed: int = 1234, col: str = "split") -> DataFrame:
    """Split with exactly ``floor(frac * n)`` train rows (M3): those of smallest (key hash, key)."""
    return stratified_split(df.withColumn("__all", F.lit(0)), key, "__all", frac, seed, col).drop("__all")


def stratified_split(df: DataFrame, key: str, label: str, frac: float = 0.8, seed: int = 42,
                     col: str = "split") -> DataFrame:
    """Exact stratified split (M4): in every label class the ``floor(frac*n)``
    rows with the smallest (key hash, key) are train.

    No row-level sort: the hash takes at most 1 000 003 values, so the
    per-class threshold comes from a running count over (class, hash) counts
    (bounded by the modulus, whatever the row count); only the rows sharing
    the threshold hash are ranked by key.  A null label is a class.
    """
    h = df.withColumn("__h", key_hash(key, seed))
    counts = h.groupBy(label, "__h").agg(F.count(F.lit(1)).alias("__c"))
    # at most 1 000 003 rows per class whatever the data size: a class window is bounded
    whole = Window.partitionBy(label)
    running = whole.orderBy("__h").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(label, "__h", "__c", F.sum("__c").over(running).alias("__cum"),
                        F.floor(F.sum("__c").over(whole) * F.lit(frac)).alias("__k"))
    # threshold hash per class: first hash whose running count reaches k, and how many of its rows are train
    thr = (cum.filter(F.col("__cum") >= F.col("__k")).groupBy(label).agg(F.min(F.struct("__h", "__cum", "__c", "__k")).alias("t"))
           .select(label, F.col("t.__h").alias("__th"), (F.col("t.__k") - F.col("t.__cum") + F.col("t.__c")).alias("__r")))
    thr = broadcast_if_few(thr)
    tie = null_safe(h.select(label, key, "__h"), thr, [label]).filter(F.col("__h") == F.col("__th"))
    ranked = distributed_rank(tie.select(label, key, "__r"), [label], [key])
    cut_key = ranked.filter(F.col("rank") == F.col("__r")).select(label, F.col(key).alias("__kk"))
    out = null_safe(null_safe(h, thr, [label], "left"), broadcast_if_few(cut_key), [label], "left")
    train = (F.col("__h") < F.col("__th")) | ((F.col("__h") == F.col("__th")) & (F.col(key) <= F.col("__kk")))
    return (out.withColumn(col, F.when(F.coalesce(train, F.lit(False)), "train").otherwise("test"))
            .drop("__h", "__th", "__r", "__kk"))
