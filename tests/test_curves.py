"""Profit curve, parameter scan and territory smoothing against numpy brute force."""

import numpy as np
import pandas as pd

from ratebook.operators import curves as CV
from ratebook.operators import joins as J


def test_best_price_matches_numpy_argmax(spark):
    p = np.linspace(5, 60, 500)
    prod = spark.createDataFrame([(1, 10.0, 95.0, 1.8), (2, 12.5, 100.0, 2.0)], "k int, c double, b0 double, b1 double")
    got = {r.k: r for r in CV.best_price(prod, "k", "c", "b0", "b1").collect()}
    for k, c, b0, b1 in [(1, 10.0, 95.0, 1.8), (2, 12.5, 100.0, 2.0)]:
        prof = (p - c) * np.maximum(b0 - b1 * p, 0)
        i = int(np.argmax(prof))
        assert got[k].best_price == p[i] and abs(got[k].best_profit - prof[i]) < 1e-12
        assert abs(got[k].true_profit - (p[i] - c) * max(100 - 2 * p[i], 0)) < 1e-12


def test_parameter_scan_matches_numpy_loop(spark):
    p = np.linspace(5, 60, 500)
    thetas = np.linspace(1.5, 2.5, 200)
    exp = []
    for th in thetas:
        ps = p[np.argmax((p - 10) * np.maximum(100 - th * p, 0))]
        exp.append(-(ps - 10) * max(100 - 2 * ps, 0))
    got = CV.parameter_scan(spark.createDataFrame([(1, 10.0)], "prod int, c double"), "prod", "c").toPandas()
    got = got.sort_values("k")
    np.testing.assert_allclose(got.theta.to_numpy(), thetas, atol=1e-12)
    np.testing.assert_allclose(got.loss.to_numpy(), np.array(exp), atol=1e-9)


def test_territory_smoothing_formula(spark):
    ex = pd.DataFrame({"zip": [1, 2, 3], "claims": [5, 0, 2], "exposure": [100, 10, 40]})
    dist = pd.DataFrame([(i, p, abs(i - p) * 0.5) for i in range(1, 4) for p in range(1, 4)],
                        columns=["zip_i", "zip_p", "hours"])
    got = {r.zip: r.smoothed_freq for r in J.smooth_territory(
        spark.createDataFrame(ex), spark.createDataFrame(dist), alpha=0.3).collect()}
    for _, row in ex.iterrows():
        nb = dist[(dist.zip_p == row.zip) & (dist.zip_i != row.zip)].merge(ex, left_on="zip_i", right_on="zip")
        w = np.exp(-nb.hours)
        exp = (row.claims + 0.3 * (nb.claims * w).sum()) / (row.exposure + 0.3 * (nb.exposure * w).sum())
        assert abs(got[row.zip] - exp) < 1e-12


def test_best_price_of_odd_products_matches_numpy(spark):
    """Demand that rises, is flat, ends before the grid or starts in it; costs on, off and beyond the grid; repeated products."""
    p = np.linspace(5, 60, 500)
    rng = np.random.default_rng(3)
    rows = [(7, 10.0, 95.0, 0.0), (7, 10.0, 95.0, 0.0), (7, 10.0, 0.0, 1.0), (7, 80.0, 95.0, 1.8), (7, 10.0, -50.0, -3.0), (7, 10.0, 50.0, -3.0), (7, 5.0, 9.0, 1.8),
            (7, float(p[70]), 5.0, 0.3), (7, 59.0, 100.0, 1.7), (7, -40.0, 30.0, 2.0), (7, 10.0, 0.0, 0.0), (7, 61.0, 1000.0, 2.0)]
    rows += [(7, float(rng.uniform(-20, 90)), float(rng.uniform(-50, 150)), float(rng.uniform(-3, 3))) for _ in range(400)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows)], "k int, c double, b0 double, b1 double")
    best = CV.best_price(df, "k", "c", "b0", "b1")
    assert "Exchange" not in best._jdf.queryExecution().toString()
    got = {r.k: r for r in best.collect()}
    for k, (_, c, b0, b1) in enumerate(rows):
        prof = (p - c) * np.maximum(b0 - b1 * p, 0)
        i = int(np.argmax(prof))
        assert (got[k].best_price, got[k].best_profit) == (p[i], prof[i]), rows[k]
    same = spark.createDataFrame(rows, "k int, c double, b0 double, b1 double")
    assert CV.best_price(same, "k", "c", "b0", "b1").count() == len(rows)


def test_all_territories_in_blocks_equal_the_pair_list(spark):
    rng = np.random.default_rng(5)
    ex = pd.DataFrame({"zip": np.arange(50), "claims": rng.integers(0, 9, 50), "exposure": rng.integers(1, 99, 50)})
    d = spark.createDataFrame([(i, p, abs(i - p) * 0.5) for i in range(50) for p in range(50)], "zip_i int, zip_p int, hours double")
    df = spark.createDataFrame(ex)
    want = {r.zip: r.smoothed_freq for r in J.smooth_territory(df, d, alpha=0.3).collect()}
    for block in (7, 1024):
        got = {r.zip: r.smoothed_freq for r in J.smooth_territories(df, lambda i, p: CV.F.abs(i - p) * 0.5, alpha=0.3, block=block).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_histogram_shares_its_range(spark):
    a, b = np.arange(1.0, 31.0), np.full(30, 15.0)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    got = CV.density_histogram(df, ["a", "b"], 30, log=False).toPandas().sort_values(["series", "bin"])
    for series, x in (("a", a), ("b", b)):
        rows = got[got.series == series]
        edges = np.append(rows.left.to_numpy(), rows.left.max() + 1.0)
        np.testing.assert_allclose(edges[0], 0.5)
        np.testing.assert_allclose(rows.density.to_numpy(), np.histogram(x, edges)[0] / 30)
    flat = CV.density_histogram(df, ["b"], 30, log=False).collect()
    assert sorted(r.density for r in flat)[-1] == 1 / 0.1 and sum(r.density > 0 for r in flat) == 1


def test_kernel_density_of_two_series(spark):
    """Against the binned and the plain sum of kernels; a quartile range of 0 falls back to the deviation."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(10, 1, 3000), np.full(3000, 11.0)
    y[:3] = 12.5
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = CV.kernel_density(df, ["x", "y"], log=False).toPandas().sort_values(["series", "j"])
    for series, v in (("x", x), ("y", y)):
        rows = got[got.series == series]
        g = rows.g.to_numpy()
        assert len(g) == 512 and g[0] == min(x.min(), y.min()) and abs(g[-1] - max(x.max(), y.max())) < 1e-12
        q1, q3 = np.quantile(v, [0.25, 0.75])
        bw = 0.9 * (min(v.std(ddof=1), (q3 - q1) / 1.34) or v.std(ddof=1)) * len(v) ** -0.2
        kernel = lambda z: np.exp(-0.5 * (z / bw) ** 2) / (len(v) * bw * np.sqrt(2 * np.pi))
        grid = np.linspace(g[0] - 4 * bw, g[-1] + 4 * bw, 512)
        at = (v - grid[0]) / (grid[1] - grid[0])
        k = np.floor(at).astype(int)
        mass = np.bincount(k, 1 - (at - k), 512) + np.bincount(k + 1, at - k, 512)
        binned = np.interp(g, grid, (kernel(grid[:, None] - grid[None, :]) * mass).sum(1))
        np.testing.assert_allclose(rows.density.to_numpy(), binned, atol=1e-9 * binned.max())
        if series == "x":  # the bandwidth is wide against the grid there
            plain = kernel(g[:, None] - v[None, :]).sum(1)
            np.testing.assert_allclose(rows.density.to_numpy(), plain, atol=1e-3 * plain.max())
    assert CV.kernel_density(df.limit(0), ["x", "y"], log=False).count() == 0
