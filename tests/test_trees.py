"""Histogram trees under a custom objective against a brute-force split search."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ratebook.config import TreeConfig
from ratebook.operators import trees as TR


def squared(p):
    return (p - F.col("y")) * 2.0, F.lit(2.0) + p * 0.0


def test_stump_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 1500
    x = rng.integers(0, 30, n).astype(float)
    y = np.where(x > 17, 3.0, -1.0) + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"x": x, "z": rng.normal(size=n), "y": y})
    df = spark.createDataFrame(pdf)
    cfg = TreeConfig(rounds=1, max_depth=1, eta=1.0, reg_lambda=0.0, min_child_hess=1.0, bins=64)
    model = TR.fit_trees(df, ["x", "z"], squared, ["y"], cfg)
    t = model.trees[0]
    f, b = t.splits[0]
    assert f == "x"
    cut = model.split_points["x"][b]  # bins are [s_i, s_i+1): left is x < cut
    assert 17 < cut <= 18
    pred = model.predict(df).toPandas()["pred"].to_numpy()
    exp = np.where(x < cut, y[x < cut].mean(), y[x >= cut].mean())
    np.testing.assert_allclose(pred, exp, atol=1e-9)


def test_boosting_reduces_squared_error(spark):
    rng = np.random.default_rng(2)
    n = 1200
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = np.sin(a) + (b > 0.5) * 2.0
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": y}))
    model = TR.fit_trees(df, ["a", "b"], squared, ["y"], TreeConfig(rounds=5, max_depth=3, eta=0.5))
    pred = model.predict(df).toPandas()["pred"].to_numpy()
    assert np.mean((pred - y) ** 2) < 0.25 * np.var(y)


def brute_trees(x, g_of, rounds, depth, eta, lam, base):
    """Exact greedy boosting over all distinct values, by full recursion on numpy arrays."""
    pred, gains = base.copy(), {}

    def grow(rows, g, h, d):
        G, H = g[rows].sum(), h[rows].sum()
        best = None
        for f in range(x.shape[1]):
            for c in np.unique(x[:, f])[1:]:
                left = rows & (x[:, f] < c)
                GL, HL = g[left].sum(), h[left].sum()
                if HL < 1 or H - HL < 1:
                    continue
                gain = GL**2 / (HL + lam) + (G - GL) ** 2 / (H - HL + lam) - G**2 / (H + lam)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, c)
        if d == 0 or best is None or best[0] <= 1e-12:
            pred[rows] += -eta * G / (H + lam)
            return
        gain, f, c = best
        gains.setdefault(f, []).append(gain)
        grow(rows & (x[:, f] < c), g, h, d - 1)
        grow(rows & ~(x[:, f] < c), g, h, d - 1)

    for _ in range(rounds):
        g, h = g_of(pred)
        grow(np.ones(len(x), bool), g, h, depth)
    return pred, gains


def test_weighted_trees_with_a_margin_equal_exact_greedy(spark):
    rng = np.random.default_rng(4)
    n = 500
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 7, n)]).astype(float)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": x[:, 0] * 0.3 + (x[:, 1] > 3) + rng.normal(0, 0.2, n), "w": rng.random(n) + 0.5, "t": rng.normal(0, 0.1, n)})
    held = pdf[:100].assign(y=rng.normal(5, 1, 100))
    model = TR.fit_reference_trees(spark.createDataFrame(pdf), spark.createDataFrame(held), ["a", "b"], "y", "w", "t",
                                   TreeConfig(rounds=3, max_depth=3, eta=0.3))
    want, gains = brute_trees(x, lambda p: ((pdf.w * (p - pdf.y)).to_numpy(), pdf.w.to_numpy()), 3, 3, 0.3, 1.0, pdf.t.to_numpy().copy())
    got = model.predict(spark.createDataFrame(pdf), base="t").toPandas()["pred"]
    np.testing.assert_allclose(got, want, atol=1e-9)
    table = {r.feature: (r.importance, r.splits) for r in model.importance(spark).collect()}
    for f, name in enumerate("ab"):
        np.testing.assert_allclose(table[name][0], np.mean(gains[f]))
        assert table[name][1] == len(gains[f])
    # held-out rows have no weight and no margin
    start = model.predict(spark.createDataFrame(held), base=F.lit(0.5)).toPandas()
    assert abs(np.mean((start.pred - held.y) ** 2) - model.history[-1]) < 1e-9


def test_boosting_stops_after_its_patience(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "y": rng.normal(size=300), "w": 1.0, "t": 0.0})
    held = pd.DataFrame({"a": pdf.a, "y": 0.5})  # any step away from the start is worse
    model = TR.fit_reference_trees(spark.createDataFrame(pdf), spark.createDataFrame(held), ["a"], "y", "w", "t",
                                   TreeConfig(rounds=40, max_depth=2, eta=0.5), patience=3)
    assert len(model.trees) <= 40 and model.best_round is not None and len(model.trees) - 1 - model.best_round == 3


def test_missing_values_go_right_and_models_are_stored(spark, tmp_path):
    rows = [(float(k % 10) if k % 4 else None, float(k % 4 == 0) * 5.0 + k % 10, 1.0) for k in range(400)] + [(float("nan"), 5.0, 1.0)] * 20
    df = spark.createDataFrame(rows, "a double, y double, one double")
    model = TR.fit_trees(df, ["a"], squared, ["y"], TreeConfig(rounds=4, max_depth=3, eta=0.5), base=1.5)
    TR.save_trees(model, spark, f"{tmp_path}/trees")
    again = TR.load_trees(spark, f"{tmp_path}/trees")
    a, b = (m.predict(df).toPandas()["pred"].to_numpy() for m in (model, again))
    assert (a == b).all() and len(again.trees) == 4
    gone = np.array([r[0] is None or r[0] != r[0] for r in rows])
    assert len(set(a[gone])) == 1


def test_quantile_cuts_of_many_values_are_weighted(spark):
    df = spark.range(10_000).selectExpr("CAST(id AS DOUBLE) AS x", "CASE WHEN id < 5000 THEN 3.0 ELSE 1.0 END AS w", "CAST(NULL AS DOUBLE) AS none")
    cuts = TR.split_points(df, ["x", "none"], 8, F.col("w"))
    assert cuts["none"] == [] and len(cuts["x"]) == 7
    total = np.cumsum(np.where(np.arange(10_000) < 5000, 3.0, 1.0))
    np.testing.assert_allclose(cuts["x"], [np.searchsorted(total, total[-1] * k / 8) for k in range(1, 8)], atol=1)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_claim_models_join_their_rows_once(spark):
    """Split, median, statistics, fits and scores read stored rows: none joins policies and claims again."""
    from ratebook.plans.claim_model import classifier_frame
    plan = _plan(classifier_frame(spark, "/root/testdata/sf0.001"))
    assert "Join" not in plan and "parquet" not in plan.lower()


def test_the_reference_trees_join_their_rows_once(spark, monkeypatch):
    """Training and held-out rows of the reference trees come from stored rows."""
    from ratebook.plans import q_models
    seen = []
    monkeypatch.setattr(TR, "fit_reference_trees", lambda train, held, *more, **kw: seen.extend([train, held]))
    q_models.reference_trees(spark, "/root/testdata/sf0.001", q_models.REFERENCE_TREES)
    assert len(seen) == 2 and all("Join" not in _plan(x) and "parquet" not in _plan(x).lower() for x in seen)


def test_the_claim_models_have_the_trees_of_the_reference(spark, monkeypatch):
    """Both models of claim_models are boosted over a hundred rounds (F2)."""
    from ratebook.plans import claim_model, q_models
    seen = []
    monkeypatch.setattr(claim_model, "compare_models", lambda spark, sf_dir, trees=TreeConfig(), baseline_iter=100: seen.append((trees, baseline_iter)))
    q_models.q_claim_models(spark, "/root/testdata/sf0.001")
    assert seen == [(TreeConfig(rounds=100, max_depth=6, eta=0.05), 100)]


def test_many_trees_are_walked_as_the_conditions_say(spark, monkeypatch):
    """A model of more trees than one expression holds gives the same bits, missing values and a start column included (F2)."""
    rng = np.random.default_rng(3)
    model = TR.TreeModel(["a", "b c"], {"a": [0.0, 1.5, 4.0], "b c": [-1.0, 2.0]}, 0.25)
    for _ in range(TR.ONE_EXPRESSION + 9):
        t = TR.Tree(splits={0: ("a", int(rng.integers(3))), 2: ("b c", int(rng.integers(2)))}, depth=3)
        t.leaves = {n: float(rng.normal()) for n in (1, 5, 6)}
        model.trees.append(t)
    model.trees.append(TR.Tree(leaves={0: 0.125}))
    rows = [(float(rng.integers(6)), float(rng.integers(-2, 4)), float(rng.normal())) for _ in range(500)]
    rows += [(None, 1.0, 0.5), (float("nan"), None, 1.0), (2.0, float("inf"), None), (None, None, 0.0)]
    df = spark.createDataFrame(rows, "a double, `b c` double, start double").coalesce(1)
    walked = [[r.pred for r in model.predict(df, base=base).collect()] for base in (None, "start")]
    monkeypatch.setattr(TR, "ONE_EXPRESSION", 10**6)
    assert [[r.pred for r in model.predict(df, base=base).collect()] for base in (None, "start")] == walked
