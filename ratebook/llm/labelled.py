"""Bounded labelled samples and logistic calibration for the two text classifiers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def sample(docs: DataFrame, labels: DataFrame, label: str, modulo: int, held_out: int, rows: int) -> tuple[DataFrame, tuple[int, int]]:
    """((doc_id, y, text, half) of at most `rows` labelled documents of each class; rows of each class).

    Held-out ids are left out before anything else.  The ids are those of smallest
    hash.  Repeated labels of an id that agree count once, ids with both labels not
    at all; of repeated documents the least text is taken.
    """
    lab = (labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
           .where(remainder(F.col("doc_id"), modulo) != held_out)
           .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_y")).where("y = _y").drop("_y"))
    counts = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(1))
    picks = lab.where("y = 0").orderBy(order).limit(rows).unionByName(lab.where("y = 1").orderBy(order).limit(rows))
    found = (docs.select("doc_id", "text").join(F.broadcast(picks), "doc_id")  # 2 x rows ids at most
             .groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
             .withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(2))))
    return checkpoint(found), (counts.get(0, 0), counts.get(1, 0))


def logistic(x: np.ndarray, y: np.ndarray, prior: tuple[int, int], ridge: float = 1e-2) -> np.ndarray:
    """Weights (one a column of x, then the intercept) by Newton steps; the intercept is put right for the classes' true sizes."""
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    base = math.log((prior[1] + 1) / (prior[0] + 1))
    if not n0 or not n1:
        return np.array([0.0] * x.shape[1] + [base])
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    keep = np.diag([ridge] * x.shape[1] + [1e-9])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep + 1e-9 * np.eye(len(w)), a.T @ (y - p) - keep @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w[-1] += base - math.log(n1 / n0)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
