"""Boosted regression trees under a custom column-expression objective (F2),
squared-error trees with a held-out stop and gain importance (F3, F6), their
storage (S7), and the pyspark.ml baseline.

pyspark.ml trees take no custom gradient, so the booster is built from
DataFrame operations.  Features are binned once by weighted quantiles (exact:
running weights over distinct values by the distributed prefix sum).  A tree
level is ONE aggregation ``groupBy(node, feature, bin).agg(sum g, sum h)`` with
map-side partial sums, over the rows of the SMALLER child of each split only:
the other child's histogram is the parent's minus its sibling's.  The result
(nodes x features x bins numbers, independent of the row count) is scanned on
the driver for the best splits.  Predictions are a running column; the table is
checkpointed every few trees so lineage stays short.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TreeConfig
from ..session import cut_lineage, spread
from .windows import prefix_sums

#: trees whose conditions are one expression; more are walked in arrays, as their code would exceed what the JVM compiles
ONE_EXPRESSION = 16
#: prediction -> (gradient, Hessian), or these in terms of further columns that are projected first
Objective = Callable[[Column], tuple[Column, Column] | tuple[Column, Column, dict[str, Column]]]


@dataclass
class Tree:
    splits: dict[int, tuple[str, int]] = field(default_factory=dict)  # node -> (feature, bin threshold)
    leaves: dict[int, float] = field(default_factory=dict)            # node -> value (eta applied)
    gains: dict[int, float] = field(default_factory=dict)             # split node -> loss reduction
    depth: int = 0


@dataclass
class TreeModel:
    features: list[str]
    split_points: dict[str, list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)
    history: list[float] = field(default_factory=list)  # held-out error after each round, if asked for
    best_round: int | None = None

    def predict(self, df: DataFrame, out: str = "pred", base: str | Column | None = None) -> DataFrame:
        """Sum of the trees and ``base`` (default: the model's); a missing value goes right at every split."""
        start = F.lit(self.base) if base is None else (F.col(base) if isinstance(base, str) else base)
        if len(self.trees) > ONE_EXPRESSION:
            return df.withColumn(out, self._walked(start.cast("double")))
        total = start
        for t in self.trees:
            total = total + F.expr(self._routing(t))
        return df.withColumn(out, total)

    def _walked(self, start: Column) -> Column:
        """The sum of the trees on start in a Python worker: each tree as arrays by node, all rows of a batch a level at once."""
        trees = []
        for t in self.trees:
            size = 1 + max([*t.leaves, *(2 * n + 2 for n in t.splits)], default=0)
            of, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            for n, (f, b) in t.splits.items():
                of[n], cut[n] = self.features.index(f), self.split_points[f][b]
            for n, v in t.leaves.items():
                value[n] = v
            trees.append((of, cut, value))

        def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for first, *columns in batches:
                x = np.stack([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
                total, row = first.to_numpy(np.float64, na_value=np.nan).copy(), np.arange(len(first))
                for of, cut, value in trees:
                    at = np.zeros(len(row), np.int64)
                    while (inner := of[at] >= 0).any():
                        at = np.where(inner, 2 * at + 2 - (x[of[at], row] < cut[at]), at)
                    total += value[at]
                yield pd.Series(total)

        return F.pandas_udf(walk, "double")(start, *(F.col(f"`{f}`").cast("double") for f in self.features))

    def _routing(self, t: Tree, n: int = 0) -> str:
        """Nested conditions on the features, linear in the tree's size; one call into the JVM a tree."""
        if n not in t.splits:
            return f"{t.leaves.get(n, 0.0)!r}D"
        f, b = t.splits[n]
        left = f"coalesce(NOT isnan(CAST(`{f}` AS DOUBLE)) AND `{f}` < {self.split_points[f][b]!r}D, false)"
        return f"if({left}, {self._routing(t, 2 * n + 1)}, {self._routing(t, 2 * n + 2)})"

    def nodes(self, spark: SparkSession) -> DataFrame:
        """``tree, node, feature, cut, gain, value``: a row for each split and each leaf."""
        rows = []
        for k, t in enumerate(self.trees):
            rows += [(k, n, f, self.split_points[f][b], t.gains[n], None) for n, (f, b) in t.splits.items()]
            rows += [(k, n, None, None, None, v) for n, v in t.leaves.items()]
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, gain double, value double")

    def importance(self, spark: SparkSession) -> DataFrame:
        """``feature, importance, splits``: mean gain of the splits on a feature and their number, best first."""
        gains: dict[str, list[float]] = {}
        for t in self.trees:
            for n, (f, _) in t.splits.items():
                gains.setdefault(f, []).append(t.gains[n])
        rows = sorted(((f, sum(g) / len(g), len(g)) for f, g in gains.items()), key=lambda r: -r[1])
        return spark.createDataFrame(rows, "feature string, importance double, splits int")


def save_trees(model: TreeModel, spark: SparkSession, path: str) -> None:
    """Node table and starting value as Parquet."""
    model.nodes(spark).withColumn("base", F.lit(float(model.base))).coalesce(1).write.mode("overwrite").parquet(path)


def load_trees(spark: SparkSession, path: str) -> TreeModel:
    """The model of a saved node table; cuts are the split points that its splits use."""
    rows = spark.read.parquet(path).collect()  # nodes of the model
    points: dict[str, list[float]] = {}
    for r in rows:
        if r.feature is not None:
            points.setdefault(r.feature, []).append(r.cut)
    points = {f: sorted(set(x)) for f, x in points.items()}
    model = TreeModel(sorted(points), points, rows[0].base if rows else 0.0)
    for k in range(1 + max((r.tree for r in rows), default=-1)):
        t = Tree()
        for r in rows:
            if r.tree == k and r.feature is not None:
                t.splits[r.node], t.gains[r.node] = (r.feature, points[r.feature].index(r.cut)), r.gain
            elif r.tree == k:
                t.leaves[r.node] = r.value
        model.trees.append(t)
    return model


def _bcol(f: str) -> str:
    return f"__bin_{f}"


def split_points(df: DataFrame, features: list[str], bins: int, weight: Column | None = None) -> dict[str, list[float]]:
    """Cuts of each feature: the least values of its weighted quantile groups but the first, at most ``bins - 1``.

    A feature of at most ``bins`` different values gets a cut for each.  Missing values don't count.
    """
    w = F.coalesce(weight.cast("double"), F.lit(0.0)) if weight is not None else F.lit(1.0)
    long = (df.select(w.alias("w"), *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(["w"], features, "feature", "x").filter(F.col("x").isNotNull() & ~F.isnan("x")))
    values = long.groupBy("feature", "x").agg(F.sum("w").alias("w")).withColumn("one", F.lit(1))
    cum = prefix_sums(values, ["feature"], ["x"], ["w", "one"])
    # a row a feature
    total = cum.groupBy("feature").agg(F.max("cum_w").alias("all_w"), F.max("cum_one").alias("n"))
    share = F.when((F.col("n") <= bins) | (F.col("all_w") <= 0), (F.col("cum_one") - 0.5) / F.greatest(F.col("n"), F.lit(1.0)) * F.least(F.col("n"), F.lit(float(bins))))
    share = share.otherwise((F.col("cum_w") - F.col("w") / 2) / F.col("all_w") * bins)
    group = F.least(F.floor(share), F.lit(bins - 1))
    cuts = cum.join(F.broadcast(total), "feature").groupBy("feature", group.alias("q")).agg(F.min("x").alias("cut"))
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in cuts.collect():  # at most bins rows a feature
        found[r.feature].append(r.cut)
    return {f: sorted(x)[1:] for f, x in found.items()}


def _bucketize(df: DataFrame, features: list[str], points: dict[str, list[float]]) -> DataFrame:
    """Bin index per feature, the number of cuts at or below the value; a missing value gets its own last bin."""
    nan_safe = df.withColumns({f"__x_{f}": F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))
                               for f in features})
    b = Bucketizer(splitsArray=[[-float("inf"), *points[f], float("inf")] if points[f] else [-float("inf"), 0.0, float("inf")] for f in features],
                   inputCols=[f"__x_{f}" for f in features], outputCols=[_bcol(f) for f in features],
                   handleInvalid="keep")
    out = b.transform(nan_safe).drop(*[f"__x_{f}" for f in features])
    return out.withColumns({_bcol(f): F.col(_bcol(f)).cast("int") for f in features})


def _node_sql(t: Tree, n: int = 0) -> str:
    """The node that a binned row ends in, as nested conditions; linear in the tree's size."""
    if n not in t.splits:
        return str(n)
    f, b = t.splits[n]
    return f"if(`{_bcol(f)}` <= {b}, {_node_sql(t, 2 * n + 1)}, {_node_sql(t, 2 * n + 2)})"


def _value_sql(t: Tree, n: int = 0) -> str:
    if n not in t.splits:
        return f"{t.leaves.get(n, 0.0)!r}D"
    f, b = t.splits[n]
    return f"if(`{_bcol(f)}` <= {b}, {_value_sql(t, 2 * n + 1)}, {_value_sql(t, 2 * n + 2)})"


def _best_split(hist: np.ndarray, cuts: list[int], cfg: TreeConfig) -> tuple[int, int, float, np.ndarray] | None:
    """(feature, bin, gain, sums of the left child) of one node; ties to the first feature, then the lowest bin.

    hist: features x bins x (gradient, Hessian); cuts: number of cuts of each feature.
    """
    total = hist[0].sum(0)
    left = hist.cumsum(1)
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + cfg.reg_lambda)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = score(left) + score(right) - score(total)
    allowed = (left[..., 1] >= cfg.min_child_hess) & (right[..., 1] >= cfg.min_child_hess)
    # a split is a cut; missing values are in the last bin and go right
    allowed &= np.arange(hist.shape[1])[None, :] < np.array(cuts)[:, None]
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(f), int(b), float(gain[f, b]), left[f, b]) if gain[f, b] > 1e-12 else None


def fit_trees(df: DataFrame, features: list[str], objective: Objective, keep: list[str],
              cfg: TreeConfig = TreeConfig(), base: float | str = 0.0, checkpoint_every: int = 10,
              held_out: DataFrame | None = None, error: Column | None = None, patience: int | None = None,
              held_base: float = 0.0) -> TreeModel:
    """Gradient-boosted trees with a custom (grad, hess) objective (F2).

    ``base``: where predictions start, a number or a margin column of ``df``.
    ``held_out``: rows for the stop; they start from ``held_base``, ``error``
    is averaged over them (a column of their own and ``__pred``), and
    boosting ends once it hasn't fallen for ``patience`` rounds.
    """
    g, h, *first = objective(F.col("__pred"))  # refers to the running prediction only: built once
    start = F.col(base).cast("double") if isinstance(base, str) else F.lit(float(base))
    seeded = df.withColumn("__pred", start)
    weight = F.greatest(h, F.lit(0.0))
    points = split_points((seeded.withColumns(first[0]) if first else seeded).withColumn("__hw", weight), features, cfg.bins, F.col("__hw"))
    model = TreeModel(features, points, float(base) if not isinstance(base, str) else held_base)
    bcols = [_bcol(f) for f in features]
    cuts = [len(points[f]) for f in features]
    width = max(cuts) + 3

    def binned(rows: DataFrame, more: list[str]) -> DataFrame:
        return cut_lineage(spread(_bucketize(rows, features, points).select(*bcols, *dict.fromkeys(more), "__pred"))).persist()

    data = binned(seeded, keep)
    held = None
    if held_out is not None:
        own = [c for c in held_out.columns if c not in features and not c.startswith("__")]
        held = binned(held_out.withColumn("__pred", F.lit(float(held_base))), own)

    def histograms(gh: DataFrame, t: Tree, nodes: list[int]) -> dict[int, np.ndarray]:
        routed = gh.withColumn("__node", F.expr(_node_sql(t))).filter(F.col("__node").isin(nodes))
        long = routed.select("__node", "__g", "__h", *bcols).unpivot(["__node", "__g", "__h"], bcols, "feature", "bin")
        got = long.groupBy("__node", "feature", "bin").agg(F.sum("__g").alias("G"), F.sum("__h").alias("H"), F.count(F.lit(1)).alias("n")).toArrow()
        out = {n: np.zeros((len(features), width, 3)) for n in nodes}
        place = {c: i for i, c in enumerate(bcols)}
        for n, f, b, *sums in zip(*(got.column(c).to_pylist() for c in ("__node", "feature", "bin", "G", "H", "n"))):
            out[n][place[f], b] = sums
        return out

    best, old_data = None, None
    for r in range(cfg.rounds):
        gh = (data.withColumns(first[0]) if first else data).withColumns({"__g": g, "__h": h})
        t = Tree(depth=cfg.max_depth)
        hist = histograms(gh, t, [0])
        if old_data is not None:
            old_data.unpersist()
        for depth in range(cfg.max_depth + 1):
            small, pairs = [], []
            for n, own in hist.items():
                total = own[0].sum(0)
                found = _best_split(own[..., :2], cuts, cfg) if depth < cfg.max_depth and total[2] else None
                if found is None:
                    t.leaves[n] = float(-cfg.eta * total[0] / (total[1] + cfg.reg_lambda)) if total[2] else 0.0
                    continue
                f, b, gain, _ = found
                t.splits[n], t.gains[n] = (features[f], b), gain
                few_left = own[f, : b + 1, 2].sum() * 2 <= total[2]
                small.append(2 * n + 1 if few_left else 2 * n + 2)
                pairs.append((n, small[-1], 4 * n + 3 - small[-1]))
            if not pairs:
                break
            if depth + 1 == cfg.max_depth:  # children are leaves: their sums are known from the split
                for n, _, _ in pairs:
                    f, b = features.index(t.splits[n][0]), t.splits[n][1]
                    left = hist[n][f, : b + 1].sum(0)
                    for child, s in ((2 * n + 1, left), (2 * n + 2, hist[n][f].sum(0) - left)):
                        t.leaves[child] = float(-cfg.eta * s[0] / (s[1] + cfg.reg_lambda))
                break
            parents, hist = hist, histograms(gh, t, small)
            hist |= {other: parents[n] - hist[child] for n, child, other in pairs}
        model.trees.append(t)
        # the next tree's first job fills the cache of the updated predictions; no other job does, so the old ones go after it
        step = F.col("__pred") + F.expr(_value_sql(t))
        if r + 1 < cfg.rounds:
            old_data, data = data, data.withColumn("__pred", step)
            data = (cut_lineage(data) if (r + 1) % checkpoint_every == 0 else data).persist()
        if held is not None:
            old, held = held, held.withColumn("__pred", step)
            held = (cut_lineage(held) if (r + 1) % checkpoint_every == 0 else held).persist()
            model.history.append(float(held.agg(F.avg(error)).first()[0]))
            old.unpersist()
            if best is None or model.history[-1] < model.history[best]:
                best = r
            elif patience is not None and r - best >= patience:
                break
    model.best_round = best
    data.unpersist()
    if old_data is not None:
        old_data.unpersist()
    if held is not None:
        held.unpersist()
    return model


def squared_objective(label: str, weight: str | None = None) -> Objective:
    """Weighted squared error: ``w (p - y)``, ``w``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return lambda p: (w * (p - F.col(label)), w + p * 0.0)


def fit_reference_trees(train: DataFrame, held_out: DataFrame, features: list[str], label: str, weight: str, margin: str,
                        cfg: TreeConfig = TreeConfig(rounds=500, max_depth=3, eta=0.1), patience: int = 50,
                        held_base: float = 0.5) -> TreeModel:
    """Squared-error trees (F3): weights and a base margin on the training rows only, the stop on unweighted
    held-out rows that start from ``held_base``."""
    error = F.pow(F.col("__pred") - F.col(label), 2)
    return fit_trees(train, features, squared_objective(label, weight), [label, weight], cfg, base=margin,
                     held_out=held_out.select(*features, label), error=error, patience=patience, held_base=held_base)


def gbt_baseline(train: DataFrame, features: list[str], label: str, weight: str | None = None,
                 validation: str | None = None, max_depth: int = 3, step: float = 0.1,
                 max_iter: int = 500, classifier: bool = False):
    """pyspark.ml gradient-boosted trees (F3; F2's logistic baseline when ``classifier``)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    kw = dict(featuresCol="features", labelCol=label, maxDepth=max_depth, stepSize=step, maxIter=max_iter,
              seed=42)
    if weight:
        kw["weightCol"] = weight
    if validation:
        kw["validationIndicatorCol"] = validation
    est = GBTClassifier(**kw) if classifier else GBTRegressor(**kw)
    model = est.fit(va.transform(train))
    return va, model
