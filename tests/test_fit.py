"""Additive fit: closed form on one factor, stability with duplicated factors, reruns."""

import numpy as np
import pandas as pd
import pytest

from ratebook.config import FitConfig
from ratebook.functions.objectives import corridor_grad
from ratebook.operators.fit import fit_additive, score


def loss_rows(spark, n=2000, seed=5, dup=False):
    rng = np.random.default_rng(seed)
    lvl = rng.choice(["x", "y", "z"], n)
    t = rng.normal(0.5, 0.1, n) + np.where(lvl == "x", 0.3, 0.0)
    m = t - np.abs(rng.normal(0.2, 0.05, n))  # market below break-even: loss branch
    pdf = pd.DataFrame({"k": np.arange(n), "f": lvl, "t": t, "m": m, "u": m})
    if dup:
        pdf["f2"] = pdf["f"]
    return pdf, spark.createDataFrame(pdf)


def obj(p):
    return corridor_grad(p, "t", "m", "u")


def test_single_factor_closed_form(spark):
    pdf, df = loss_rows(spark)
    model = fit_additive(df, ["f"], obj, ["t", "m", "u"], FitConfig(max_rounds=200, l2=0.0, tol=1e-10))
    # loss branch optimum per level: mean of (m + t) / 2 (both weights 1)
    target = ((pdf.m + pdf.t) / 2).groupby(pdf.f).mean()
    w = model.weights.toPandas().set_index("level")["weight"]
    fitted = {lv: model.bias + w[lv] for lv in target.index}
    for lv, v in target.items():
        assert abs(fitted[lv] - v) < 1e-4


def test_duplicated_factor_does_not_diverge_and_rerun_is_equal(spark):
    pdf, df = loss_rows(spark, dup=True)
    cfg = FitConfig(max_rounds=60, l2=1e-5)
    a = fit_additive(df, ["f", "f2"], obj, ["t", "m", "u"], cfg)
    b = fit_additive(df, ["f", "f2"], obj, ["t", "m", "u"], cfg)
    wa, wb = (x.weights.toPandas().set_index(["feature", "level"]).weight.sort_index() for x in (a, b))
    assert all(np.isfinite(wa))
    assert a.history[-1]["grad_norm"] < a.history[5]["grad_norm"]
    np.testing.assert_allclose(wa.to_numpy(), wb.to_numpy(), atol=1e-9)


def brute_fit(pdf, features, rounds, l2=1e-5, bias_rounds=5):
    """The same rounds in numpy on the whole table, for the loss branch (quadratic)."""
    codes = [pd.factorize(pdf[f])[0] for f in features]
    sizes = [int(c.max()) + 1 for c in codes]
    off = np.cumsum([1, *sizes])[:-1]
    x = y = np.zeros(1 + sum(sizes))
    eta, tk = 1 / (len(features) + 1), 1.0
    for r in range(rounds):
        seen = [np.where(c >= 0, y[np.maximum(c, 0) + o], 0.0) for c, o in zip(codes, off)]
        p = y[0] + sum(seen)
        g, h = (-2 * (pdf.m - p) - 2 * (pdf.t - p)).to_numpy(), np.full(len(pdf), 4.0)
        G, H = np.zeros(len(y)), np.zeros(len(y))
        G[0], H[0] = g.sum(), h.sum()
        for c, o in zip(codes, off):
            np.add.at(G, c[c >= 0] + o, g[c >= 0])
            np.add.at(H, c[c >= 0] + o, h[c >= 0])
        new, grad = y.copy(), np.zeros(len(y))
        grad[0] = G[0]
        if r < bias_rounds:
            new[0] -= G[0] / H[0]
        else:
            grad[1:] = G[1:] + l2 * y[1:]
            new[1:] -= eta * grad[1:] / (H[1:] + l2)
            new[0] -= eta * G[0] / H[0]
        restart = grad @ (new - x) > 0 or r < bias_rounds
        t = 1.0 if restart else (1 + np.sqrt(1 + 4 * tk * tk)) / 2
        y = new + (0.0 if restart else (tk - 1) / t) * (new - x)
        x, tk = new, t
    names = {("(bias)", ""): x[0]}
    for f, o in zip(features, off):
        names |= {(f, lv): x[o + k] for k, lv in enumerate(pd.factorize(pdf[f])[1])}
    return names


def test_small_and_large_models_equal_a_plain_fit(spark):
    """Few levels and 60,000 levels; missing levels; no key is needed, so repeated rows are rows."""
    rng = np.random.default_rng(6)
    n = 70_000
    t = rng.normal(0.5, 0.1, n)
    pdf = pd.DataFrame({"t": t, "m": t - 0.1 - rng.random(n), "many": [f"z{i}" for i in rng.permutation(n) % 60_000], "few": rng.choice(["x", "y", None], n)})
    pdf["u"] = pdf.m
    pdf = pd.concat([pdf, pdf[:500]], ignore_index=True)
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "t double, m double, many string, few string, u double")
    for features, rounds in ((["few"], 20), (["many", "few"], 12)):
        model = fit_additive(df, features, obj, ["t", "m", "u"], FitConfig(max_rounds=rounds, l2=1e-5, tol=0.0))
        got = {(r.feature, r.level): r.weight for r in model.coefficients(spark).collect()}
        want = brute_fit(pdf, features, rounds)
        assert got.keys() == want.keys()
        assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    scored = score(df, model.coefficients(spark), ["many", "few"]).collect()
    assert len(scored) == len(pdf)
    for r in scored[::997]:
        assert abs(r.pred - (want[("(bias)", "")] + want[("many", r.many)] + want.get(("few", r.few), 0.0))) < 1e-9


@pytest.mark.parametrize("levels", [3, 120_000])
def test_scores_of_any_rows_and_coefficients(spark, levels):
    """Null and repeated keys, unseen and missing levels, repeated coefficients; alike above and below the broadcast size."""
    coef = [("(bias)", "", 1.0), ("a", "1", 10.0), ("a", "1", 0.5), ("a", None, 99.0), ("b", "q", 100.0), ("c", "1", 1000.0)]
    coef += [("a", f"u{i}", -1.0) for i in range(levels)]
    rows = [(None, 1, "q", 5.0), (None, 1, "q", 5.0), (7, 2, None, 5.0), (7, None, "zz", 5.0)]
    df = spark.createDataFrame(rows, "k int, a int, b string, __w0 double")
    got = score(df, spark.createDataFrame(coef, "feature string, level string, weight double"), ["a", "b"])
    assert got.columns == ["k", "a", "b", "__w0", "pred"]
    assert sorted(r.pred for r in got.collect()) == [1.0, 1.0, 111.5, 111.5]
    empty = score(df, spark.createDataFrame([], "feature string, level string, weight double"), ["a", "b"])
    assert [r.pred for r in empty.collect()] == [0.0] * 4
