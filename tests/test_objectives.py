"""Objectives and losses as column expressions vs a numpy rewrite of the formulas."""

import numpy as np
import pandas as pd
import pytest

from ratebook.config import CORRIDOR_CONVERSION, CORRIDOR_NORMALISED, CORRIDOR_PLOT, CORRIDOR_TARIFF
from ratebook.functions import objectives as O


def sig(x, a=1.0):
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-x / a))


def np_corridor(p, t, u, m, w, su, so, sm, profit):
    g = np.where(profit,
                 (w.w_under * (-2 * (t - p)) + w.w_mid * 2 * (p - u)) * su + w.w_mid * 2 * (p - u) * sm
                 + w.w_over * 2 * (p - u) * (u - t) * so,
                 w.w_loss_low * (-2 * (m - p)) + w.w_loss_high * (-2 * (t - p)))
    h = np.where(profit, 2 * (w.w_under + w.w_mid) * su + 2 * w.w_mid * sm + 2 * w.w_over * (u - t) * so,
                 2 * w.w_loss_low + 2 * w.w_loss_high)
    return g, h


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    n = 400
    t = rng.normal(0, 0.3, n)
    m = t + rng.normal(0, 0.3, n)
    u = np.maximum(m - 0.01, t)
    p = t + rng.normal(0, 0.3, n)
    pdf = pd.DataFrame({"i": np.arange(n), "p": p, "t": t, "m": m, "u": u})
    return pdf, spark.createDataFrame(pdf)


def collect(df, cols):
    out = df.orderBy("i").toPandas()
    return [out[c].to_numpy() for c in cols]


def test_o1_o2_o3(rows):
    pdf, df = rows
    p, t, m, u = (pdf[c].to_numpy() for c in "ptmu")
    g1, h1 = O.corridor_grad("p", "t", "m", "u")
    g2, h2 = O.normalised_grad("p", "t", "m")
    g3, h3 = O.conversion_grad("p", "t", "m")
    got = collect(df.select("i", g1.alias("g1"), h1.alias("h1"), g2.alias("g2"), h2.alias("h2"),
                            g3.alias("g3"), h3.alias("h3")), ["g1", "h1", "g2", "h2", "g3", "h3"])
    w = CORRIDOR_TARIFF
    su, so = sig(t - p, w.alpha_under), sig(p - u, w.alpha_over)
    e1 = np_corridor(p, t, u, m, w, su, so, 1 - su - so, u > t)
    w = CORRIDOR_NORMALISED
    su, so = sig(t - p, w.alpha_under), sig(p - m, w.alpha_over)
    sm = 1 - su - so
    tot = su + sm + so
    e2 = np_corridor(p, t, m, m, w, su / tot, so / tot, sm / tot, m > t)
    w = CORRIDOR_CONVERSION
    su, so = sig(t - p, w.alpha_under), (1 + np.tanh(-8.78002 * (p - m) + 8.32548)) / 2
    e3 = np_corridor(p, t, m, m, w, su, so, 1 - su - so, m > t)
    for a, b in zip(got, [*e1, *e2, *e3]):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_l1_gradient_matches_o2_where_masks_are_flat(rows):
    """O2 is the gradient of L1 up to the mask derivatives it ignores."""
    pdf, df = rows
    eps = 1e-6
    l0 = O.convex_loss("p", "t", "m", CORRIDOR_NORMALISED)
    lp = O.convex_loss(df.p + eps, "t", "m", CORRIDOR_NORMALISED)
    g2, _ = O.normalised_grad("p", "t", "m")
    a, b, g = collect(df.select("i", l0.alias("a"), lp.alias("b"), g2.alias("g")), ["a", "b", "g"])
    p, t, m = (pdf[c].to_numpy() for c in "ptm")
    flat = (np.abs(t - p) > 0.1) & (np.abs(p - m) > 0.1)
    fd = (b - a) / eps
    np.testing.assert_allclose(fd[flat], g[flat], rtol=1e-3, atol=1e-3)


def test_o4_o5_o6_l2(rows):
    pdf, df = rows
    d = df.withColumns({"y": (df.i % 2).cast("double"), "mk": df.m + 2.0, "wt": df.u * 0 + 0.7})
    g4, h4 = O.profit_logistic_grad("p", "y", "mk", "wt")
    g5, h5 = O.deviation_logistic_grad("p", "y", "m", "t")
    g6, h6 = O.hinge_grad("p", "t", "m")
    l2 = O.step_loss("p", "t", "m")
    got = collect(d.select("i", g4.alias("g4"), h4.alias("h4"), g5.alias("g5"), h5.alias("h5"),
                           g6.alias("g6"), h6.alias("h6"), l2.alias("l2")),
                  ["g4", "h4", "g5", "h5", "g6", "h6", "l2"])
    p, t, m = (pdf[c].to_numpy() for c in "ptm")
    y = (pdf.i % 2).to_numpy().astype(float)
    M, w = m + 2.0, 0.7
    pr = sig(np.clip(p, -35, 35))
    e4 = (w * (M * pr * (1 - pr) - y * (1 - pr)), w * (M * (1 - 2 * pr) * pr * (1 - pr) + y * pr * (1 - pr)))
    dev = np.clip(m - t, 0, 1)
    wt = np.where(dev > 0, dev ** 0.5 * np.exp(-dev), 1.0)
    pr5 = sig(p)
    e5 = ((pr5 - y) * wt, pr5 * (1 - pr5) * wt)
    s = sig((p - m) / 0.1)
    ds = s * (1 - s) / 0.1
    d2 = ds * (1 - 2 * s) / 0.1
    g6e = np.where(t >= m, -(1 - s) - (t - p) * ds, ds * (m - t) - (1 - s))
    h6e = np.maximum(np.where(t >= m, -ds + (t - p) * d2, d2 * (m - t) + ds), 1e-6)
    mx = np.maximum(m, t)
    l2e = mx - p + (m - t - (mx - p)) / (1 + np.exp(-10 * (p - (m - 0.2))))
    for a, b in zip(got, [*e4, *e5, g6e, h6e, l2e]):
        np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)


def test_l1_plot_weights(rows):
    pdf, df = rows
    got = collect(df.select("i", O.convex_loss("p", "t", "m", CORRIDOR_PLOT, 1e-5).alias("l")), ["l"])[0]
    p, t, m = (pdf[c].to_numpy() for c in "ptm")
    w = CORRIDOR_PLOT
    su, so = sig(t - p, 1e-5), sig(p - m, 1e-5)
    sm = 1 - su - so
    tot = su + sm + so
    prof = ((w.w_under * (t - p) ** 2 + w.w_mid * (p - m) ** 2) * su / tot + w.w_mid * (p - m) ** 2 * sm / tot
            + w.w_over * (p - m) ** 2 * (m - t) * so / tot)
    exp = np.where(m > t, prof, w.w_loss_low * (m - p) ** 2 + w.w_loss_high * (t - p) ** 2)
    np.testing.assert_allclose(got, exp, rtol=1e-9, atol=1e-9)


def test_each_mask_is_computed_once(rows):
    """Gradient and Hessian of the three variants: five exponentials and one tanh in the whole plan."""
    df = rows[1].sparkSession.range(400).selectExpr("id AS i", "(id % 37) / 40 AS p", "(id % 11) / 30 AS t", "(id % 13) / 25 AS m", "(id % 17) / 20 AS u")
    pulls = [O.corridor_pulls("p", "t", "m", "u"), O.normalised_pulls("p", "t", "m"), O.conversion_pulls("p", "t", "m")]
    staged, first = [x.staged(f"o{k}") for k, x in enumerate(pulls)], df
    for columns, _ in staged:
        first = first.withColumns(columns)
    out = first.select("i", *[c.alias(f"{kind}{k}") for k, (_, x) in enumerate(staged) for kind, c in zip("gh", x.grad(O.F.col("p")))])
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("exp(") == 5 and plan.count("tanh(") == 1
    inline = collect(df.select("i", *[c.alias(f"{kind}{k}") for k, x in enumerate(pulls) for kind, c in zip("gh", x.grad(O.F.col("p")))]), ["g0", "h1", "g2"])
    for a, b in zip(collect(out, ["g0", "h1", "g2"]), inline):
        np.testing.assert_allclose(a, b, rtol=1e-12)
