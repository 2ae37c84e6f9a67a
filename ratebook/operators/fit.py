"""Additive (generalised linear) fit under any column-expression objective (F1),
scoring (F4), multipliers (F5), coefficient persistence (S7), designs (M1, M2).

The levels of all features are numbered once, densely, by a distributed rank;
a policy is then a row of integers.  Weights and the bias are one array,
looked up by these integers, so a round is ONE job over the checkpointed
table whatever the number of levels: predictions by array lookups, the
objective's (g, h) as Catalyst expressions, and their sums by integer key
with map-side partial aggregation.  The driver holds the weights as dense
vectors, as pyspark.ml's linear models do (8 bytes a level), and takes the
damped Newton step with Nesterov momentum and gradient restart (proximal
step for L1).  No row identity is used, so repeated and missing policy keys
are rows like others.  The plan of a round never refers to the previous
round's plan, so lineage does not grow.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FitConfig
from ..session import cut_lineage, spread
from .joins import broadcast_if_few
from .windows import distributed_rank

BIAS = "(bias)"
#: prediction -> (gradient, Hessian), or these in terms of further columns that are projected first
Objective = Callable[[Column], tuple[Column, Column] | tuple[Column, Column, dict[str, Column]]]


@dataclass
class AdditiveModel:
    bias: float
    weights: DataFrame  # feature, level, weight
    rounds: int = 0
    history: list = field(default_factory=list)

    def coefficients(self, spark: SparkSession) -> DataFrame:
        """Coefficient table ``(feature, level, weight)`` with the bias as a row."""
        bias = spark.createDataFrame([(BIAS, "", float(self.bias))], "feature string, level string, weight double")
        return bias.unionByName(self.weights)


def _texts(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, level) of every row and feature that isn't missing."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])
    return df.select(F.explode(pairs).alias("x")).select("x.*").filter(F.col("level").isNotNull())


def long_design(df: DataFrame, key: str, features: list[str], levels: DataFrame | None = None) -> DataFrame:
    """Sparse one-hot in long form ``(key, feature, level[, col_index])`` (M1).

    Missing values are not levels (no row).  With a level table (W6) the
    global column index of the design matrix is attached.
    """
    wide = df.select(key, *[F.col(f).cast("string").alias(f) for f in features])
    long = wide.unpivot([key], features, "feature", "level").filter(F.col("level").isNotNull())
    if levels is None:
        return long
    lv = levels.select("feature", F.col("value").alias("level"), "col_index")
    return long.join(broadcast_if_few(lv), ["feature", "level"], "left")


def _attached(df: DataFrame, table: DataFrame, features: list[str], value: str, names: list[str]) -> DataFrame:
    """The rows with a column ``names[i]`` for each feature: ``value`` of its level in a written table (feature, level, value).

    The table has a row a level at most, so rows neither multiply nor get
    lost.  A feature's part is broadcast if it is counted to be small; a
    larger one is joined by shuffle.
    """
    sizes = {r.feature: r["count"] for r in table.groupBy("feature").count().filter(F.col("feature").isin(features)).collect()}
    for f, name in zip(features, names, strict=True):
        if not sizes.get(f):
            df = df.withColumn(name, F.lit(None).cast(table.schema[value].dataType))
            continue
        side = table.filter(F.col("feature") == f).select(F.col("level").alias(f"{name}_level"), F.col(value).alias(name))
        side = F.broadcast(side) if sizes[f] <= BROADCAST_LEVELS else side
        df = df.join(side, df[f].cast("string") == side[f"{name}_level"], "left").drop(f"{name}_level")
    return df


#: levels of a feature that are broadcast to the rows; more are joined by shuffle
BROADCAST_LEVELS = 100_000


def _free(df: DataFrame, n: int) -> list[str]:
    """Column names that the table doesn't have."""
    stem = "__w"
    while any(c.startswith(stem) for c in df.columns):
        stem += "_"
    return [f"{stem}{i}" for i in range(n)]


def score(df: DataFrame, coef: DataFrame, features: list[str], out: str = "pred") -> DataFrame:
    """``bias + sum_f weight_f[level_f]`` (F4); an unseen or missing level contributes 0.

    Coefficient rows of the same level add up, so do bias rows; rows of the
    table stay as they are, repeated ones and those without a key too.
    """
    # written: its parts are counted and then joined
    table = cut_lineage(coef.filter(F.col("level").isNotNull() | (F.col("feature") == BIAS))
                        .groupBy("feature", "level").agg(F.sum("weight").alias("weight")))
    bias = table.filter(F.col("feature") == BIAS).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("b")).scalar()
    names = _free(df, len(features))
    wide = _attached(df, table.filter(F.col("feature") != BIAS), features, "weight", names)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(w), F.lit(0.0)) for w in names], bias)
    return wide.withColumn(out, total).drop(*names)


def level_numbers(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, level, at): all levels that occur, numbered 1, 2, ... over all features without gaps."""
    return distributed_rank(_texts(df, features).distinct(), [], ["feature", "level"]).withColumnRenamed("rank", "at")


def _lookup(spark: SparkSession, weights: np.ndarray) -> Column:
    """The weights as one array, a scalar subquery; element 0 is the bias."""
    flat = pa.array(np.ascontiguousarray(weights, np.float64))
    one = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
    return spark.createDataFrame(pa.table({"w": one})).select("w").scalar()


def fit_additive(df: DataFrame, features: list[str], objective: Objective,
                 keep: list[str], cfg: FitConfig = FitConfig(), bias_rounds: int = 5) -> AdditiveModel:
    """Fit level weights of ``features`` under ``objective`` (F1).

    ``objective(pred)`` returns the (grad, hess) columns, and those that it
    wants projected first; ``keep`` lists the columns it reads.  Damped step ``1/(features+1)`` for all levels at
    once, bias fitted first, Nesterov momentum with gradient restart.
    """
    spark = df.sparkSession
    levels = cut_lineage(level_numbers(df, features))
    n = levels.count() + 1
    names = [f"__at{i}" for i in range(len(features))]
    coded = _attached(df.select(*dict.fromkeys([*keep, *features])), levels, features, "at", names)
    # checkpointed (survives executor loss) and cached: every round re-reads it
    rows = cut_lineage(spread(coded.select(*keep, *[F.col(c).cast("int").alias(c) for c in names]))).persist()
    g, h, *first = objective(F.col("pred"))  # they refer to ``pred`` only: built once

    def sums(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = _lookup(spark, weights)
        pred = reduce(lambda a, c: a + F.coalesce(F.get(w, F.col(c)), F.lit(0.0)), names, F.get(w, F.lit(0)))
        priced = rows.withColumn("pred", pred)
        gh = (priced.withColumns(first[0]) if first else priced).select(*names, F.lit(0).alias("__bias"), g.alias("g"), h.alias("h"))
        long = gh.unpivot(["g", "h"], ["__bias", *names], "feature", "at").filter(F.col("at").isNotNull())
        got = long.groupBy("at").agg(F.sum("g").alias("G"), F.sum("h").alias("H")).toArrow()  # a row a level
        G, H = np.zeros(n), np.zeros(n)
        at = got.column("at").to_numpy()
        G[at], H[at] = got.column("G").to_numpy(), got.column("H").to_numpy()
        return G, np.maximum(H, cfg.hess_floor)

    eta = 1.0 / (len(features) + 1)
    x = y = np.zeros(n)
    tk = 1.0
    history = []
    for rnd in range(cfg.max_rounds):
        G, H = sums(y)
        new, grad = y.copy(), np.zeros(n)
        grad[0] = G[0]
        if rnd < bias_rounds:
            new[0] = y[0] - G[0] / H[0]
        else:
            grad[1:] = G[1:] + cfg.l2 * y[1:]
            z = y[1:] - eta * grad[1:] / (H[1:] + cfg.l2)
            new[1:] = np.sign(z) * np.maximum(np.abs(z) - eta * cfg.l1 / (H[1:] + cfg.l2), 0.0)
            new[0] = y[0] - eta * G[0] / H[0]
        step = new - x
        move = float(np.abs(step).max())
        history.append({"round": rnd, "bias": float(new[0]), "grad_norm": float(np.linalg.norm(grad)), "move": move})
        # gradient restart: momentum only while the step still descends
        restart = float(grad @ step) > 0 or rnd < bias_rounds
        t_next = 1.0 if restart else (1.0 + np.sqrt(1.0 + 4.0 * tk * tk)) / 2.0
        y = new + (0.0 if restart else (tk - 1.0) / t_next) * step
        x, tk = new, t_next
        if rnd >= bias_rounds and move < cfg.tol:
            break
    rows.unpersist()
    weights = levels.select("feature", "level", F.get(_lookup(spark, x), F.col("at").cast("int")).alias("weight"))
    return AdditiveModel(bias=float(x[0]), weights=weights, rounds=len(history), history=history)


def multipliers(coef: DataFrame) -> DataFrame:
    """Weights to multipliers ``exp(w)`` with the name ``feature || level``."""
    return coef.select(F.concat("feature", "level").alias("feature_level"), "feature", "level",
                       F.exp("weight").alias("multiplier"))


def save_coefficients(coef: DataFrame, path: str) -> None:
    """Persist a coefficient table as Parquet."""
    coef.write.mode("overwrite").parquet(path)


def load_coefficients(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def assemble(df: DataFrame, cols: list[str], label: str, out: str = "features") -> DataFrame:
    """Numeric matrix with label / base margin / weight slots as columns (M2)."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")
    return va.transform(df).withColumnRenamed(label, "label")
