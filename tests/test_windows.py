"""Distributed ranks, prefix sums, curves, quantiles and AUC against brute force."""

import numpy as np
import pandas as pd

from ratebook.operators import metrics as MT
from ratebook.operators import windows as W


def skewed(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 50, n).astype(float)
    v[: n // 3] = 7.0  # one value holds a third of the rows
    g = rng.choice(["a", "b", "c"], n)
    pdf = pd.DataFrame({"k": np.arange(n), "g": g, "v": v, "x": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf)


def test_prefix_sums_and_rank_match_pandas(spark):
    pdf, df = skewed(spark)
    got = W.prefix_sums(df, ["g"], ["v", "k"], ["x"], num_partitions=5).toPandas().set_index("k")
    exp = pdf.sort_values(["g", "v", "k"]).groupby("g")["x"].cumsum()
    np.testing.assert_allclose(got.loc[exp.index, "cum_x"].to_numpy(), exp.to_numpy(), atol=1e-9)
    rk = W.distributed_rank(df, ["g"], ["v", "k"], num_partitions=7).toPandas().set_index("k")
    exp_r = pdf.sort_values(["g", "v", "k"]).groupby("g").cumcount() + 1
    assert (rk.loc[exp_r.index, "rank"].to_numpy() == exp_r.to_numpy()).all()


def test_sorted_curves_repeat_shorter_series(spark):
    pdf = pd.DataFrame({"k": range(6), "s1": [5.0, 1, 3, 2, 4, 6], "s2": [9.0, None, 7, None, 8, None]})
    df = spark.createDataFrame(pdf)
    got = W.sorted_curves(df, ["s1", "s2"], "k").toPandas().sort_values(["series", "idx"])
    assert list(got[got.series == "s1"].value) == [1, 2, 3, 4, 5, 6]
    assert list(got[got.series == "s2"].value) == [7, 8, 9, 7, 8, 9]
    grid = W.sorted_curves(df, ["s1"], "k", points=3).toPandas().sort_values("idx")
    assert list(grid.idx) == [1, 4, 6] and list(grid.value) == [1.0, 4.0, 6.0]


def test_exact_quantiles_match_numpy(spark):
    pdf, df = skewed(spark)
    q = MT.exact_quantiles(df, "x", [0.25, 0.5, 0.75], "k").first()
    np.testing.assert_allclose([q.q_0, q.q_1, q.q_2], np.quantile(pdf.x, [0.25, 0.5, 0.75]), atol=1e-12)


def test_auc_with_ties_matches_pairs(spark):
    rng = np.random.default_rng(1)
    n = 600
    s = rng.integers(0, 20, n).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(s - 10) / 4))).astype(int)
    got = MT.auc(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s").first().auc
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_exact_quantiles_fallback_when_bracket_misses(spark):
    pdf, df = skewed(spark, n=2000)
    q = MT.exact_quantiles(df, "v", [0.1, 0.5, 0.9], "k", accuracy=2).first()  # brackets too wide/narrow
    np.testing.assert_allclose([q.q_0, q.q_1, q.q_2], np.quantile(pdf.v, [0.1, 0.5, 0.9]), atol=1e-12)
    q2 = MT.exact_quantiles(df, "v", [0.1, 0.5, 0.9], "k").first()
    np.testing.assert_allclose([q2.q_0, q2.q_1, q2.q_2], np.quantile(pdf.v, [0.1, 0.5, 0.9]), atol=1e-12)


def test_stratified_split_exact_per_class(spark):
    from ratebook.operators.sampling import key_hash, stratified_split
    rng = np.random.default_rng(9)
    n = 3000
    pdf = pd.DataFrame({"k": rng.permutation(n) * 7 + 11, "y": (rng.random(n) < 0.2).astype(int)})
    out = stratified_split(spark.createDataFrame(pdf), "k", "y", 0.8, seed=42).toPandas()
    h = ((pdf.k % 1000003) * 48271 + 42) % 1000003
    exp = pdf.assign(h=h).sort_values(["y", "h", "k"])
    exp["r"] = exp.groupby("y").cumcount() + 1
    exp["n"] = exp.groupby("y")["k"].transform("size")
    exp["split"] = np.where(exp.r <= np.floor(exp.n * 0.8), "train", "test")
    got = out.set_index("k")["split"]
    assert (got.loc[exp.k].to_numpy() == exp.split.to_numpy()).all()


def test_null_groups_and_keys_above_2_to_the_53(spark):
    base = 2**60
    rows = [(None if k % 3 == 0 else "a", base + (k * 7919) % 1000) for k in range(1000)]
    df = spark.createDataFrame(rows, "g string, k long")
    want, seen = {}, {}
    for g, k in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        want[k] = seen[g]
    got = W.distributed_rank(df, ["g"], ["k"], num_partitions=6)
    assert {r.k: r["rank"] for r in got.collect()} == want
    cum = W.prefix_sums(df.withColumn("one", W.F.lit(2)), ["g"], ["k"], ["one"], num_partitions=6)
    assert {r.k: r.cum_one for r in cum.collect()} == {k: 2.0 * r for k, r in want.items()}
    assert "Python" not in got._jdf.queryExecution().toString()


def test_one_value_is_repeated_against_a_long_series(spark):
    n = 200_000
    df = spark.range(n).select("id", W.F.col("id").cast("double").alias("long"), W.F.when(W.F.col("id") == 5, 1.5).alias("short"))
    got = W.sorted_curves(df, ["long", "short"], "id").groupBy("series").agg(
        W.F.count("*").alias("n"), W.F.count_distinct("idx").alias("d"), W.F.min("idx").alias("lo"), W.F.max("idx").alias("hi"), W.F.max("value").alias("v"))
    assert {r.series: (r.n, r.d, r.lo, r.hi, r.v) for r in got.collect()} == {"long": (n, n, 1, n, n - 1.0), "short": (n, n, 1, n, 1.5)}


def test_null_label_is_a_class_of_the_stratified_split(spark):
    from ratebook.operators.sampling import stratified_split
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 4 = 0 THEN NULL ELSE id % 2 END AS y")
    out = stratified_split(df, "id", "y").groupBy("y", "split").count().collect()
    assert sorted((str(r.y), r.split, r["count"]) for r in out) == [
        ("0", "test", 50), ("0", "train", 200), ("1", "test", 100), ("1", "train", 400), ("None", "test", 50), ("None", "train", 200)]


def test_codes_order_all_doubles(spark):
    import struct
    tiny, big = 5e-324, 1.7976931348623157e308
    rng = np.random.default_rng(8)
    xs = [0.0, -0.0, tiny, -tiny, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0, np.nextafter(2, 0), big, -big,
          float("inf"), -float("inf"), *np.ldexp(1.0, np.arange(-1074, 1024, 37)), *rng.normal(size=200), *np.exp(rng.uniform(-700, 700, 200)), *-np.exp(rng.uniform(-700, 700, 200))]
    xs = [float(x) for x in xs]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", MT.ordered_code("x").alias("c")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.c == (-bits if r.x < 0 else bits) and MT.decoded(r.c) == r.x


def test_quantiles_of_several_columns_with_nulls(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"a": np.exp(rng.normal(0, 40, 5000)), "b": -rng.integers(0, 3, 5000).astype(float), "c": np.nan})
    rows = [(float(r.a), float(r.b) if k % 7 else None, None) for k, r in enumerate(pdf.itertuples())]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for few in (0, 100, 10**6):
        got = MT.radix_quantiles(df, ["a", "b", "c"], probs, few)
        np.testing.assert_allclose(got["a"], np.quantile(pdf.a, probs), rtol=1e-12)
        np.testing.assert_allclose(got["b"], np.quantile([r[1] for r in rows if r[1] is not None], probs))
        assert got["c"] == [None] * 6
