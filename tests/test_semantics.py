"""Null / NaN / rounding rules of the original scripts."""

import math

import pytest
from pyspark.sql import functions as F

from ratebook.functions import scalar as SC
from ratebook.functions import semantics as SE
from ratebook.operators import joins as J
from ratebook.operators import reports as R
from ratebook.sources import lookups as L


def test_q1_strict_and_lenient_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "g string, x int")
    out = {r.g: (r.s, r.l) for r in df.groupBy("g").agg(SE.strict_sum("x").alias("s"),
                                                          SE.lenient_sum("x").alias("l")).collect()}
    assert out["a"] == (None, 1)
    assert out["b"] == (5, 5)
    empty = df.filter("g = 'z'").agg(SE.strict_sum("x").alias("s"), SE.lenient_sum("x").alias("l")).first()
    assert (empty.s, empty.l) == (0, 0)


def test_q2_null_safe_bonus_lookup(spark):
    pol = spark.createDataFrame([(1, -4), (2, None), (3, 11)], "polref int, bmcorr int")
    out = {r.polref: r.bm_freq for r in J.add_bonus(pol, L.bm_lookup(spark)).collect()}
    assert out[1] == 3.809263194
    assert out[2] == 0.476860979  # the null class row
    assert out[3] is None


def test_q4_strict_vs_skipping_greatest(spark):
    r = spark.range(1).select(SE.strict_greatest(F.lit(1), F.lit(None).cast("int")).alias("s"),
                              SE.skip_greatest(F.lit(1), F.lit(None).cast("int")).alias("k")).first()
    assert r.s is None and r.k == 1


def test_q5_r_division(spark):
    r = spark.range(1).select(SE.r_divide(F.lit(1.0), F.lit(0.0)).alias("a"),
                              SE.r_divide(F.lit(-1.0), F.lit(0.0)).alias("b"),
                              SE.r_divide(F.lit(0.0), F.lit(0.0)).alias("c")).first()
    assert r.a == math.inf and r.b == -math.inf and math.isnan(r.c)


def test_a5_claim_ratio_change_cases(spark):
    rows = [(10, 0, 1, 1), (-10, 0, 1, 1), (0, 0, 1, 1), (30, 10, 100, 100), (50, 10, 100, 100)]
    df = spark.createDataFrame(rows, "model_claim long, own_claim long, own long, model long")
    got = [r.i for r in df.select(R.claim_ratio_change().alias("i")).collect()]
    assert got[:3] == [2.0, 0.0, 1.0]
    assert got[3] == 2.0 and got[4] == 2.0


def test_q6_half_even(spark):
    r = spark.range(1).select(SE.half_even(F.lit(2.5)).alias("a"), SE.half_even(F.lit(3.5)).alias("b")).first()
    assert (float(r.a), float(r.b)) == (2.0, 4.0)


def test_q7_bad_casts_to_null(spark):
    df = spark.createDataFrame([("81100000706",), ("x12",), (None,)], "k string")
    assert [r.k for r in df.select(SC.to_key("k").alias("k")).collect()] == [81100000706, None, None]
    d = spark.createDataFrame([("35953,00 FtT",), ("35953",)], "p string")
    fixed = d.select(SC.repair_int("p", {"35953,00 FtT": "35953"}).alias("p")).collect()
    assert [r.p for r in fixed] == [35953, 35953]
    assert d.select(SC.decimal_comma(F.lit("12,5")).alias("v")).first().v == 12.5


def test_q8_band_edges(spark):
    df = spark.createDataFrame([(0,), (37,), (38,), (100,), (101,), (500,), (None,), (-1,)], "kw int")
    got = [r.b for r in df.select(SC.band("kw", SC.KW_BREAKS, SC.KW_DEFAULT).alias("b")).collect()]
    assert got == ["[0,38)", "[0,38)", "[38,51)", "[71,101)", "[101,Inf]", "[101,Inf]", "[51,71)", None]
    age = spark.createDataFrame([(-1,), (0,), (71,), (None,)], "a int")
    got = [r.b for r in age.select(SC.band("a", SC.AGE_BREAKS, SC.AGE_DEFAULT).alias("b")).collect()]
    assert got == ["[-1,0)", "[0,26)", "[71,Inf]", "[46,51)"]


def test_q9_split_is_stable_under_repartition(spark):
    from ratebook.operators.sampling import split
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in split(df, "k").collect()}
    b = {r.k: r.split for r in split(df.repartition(7), "k").collect()}
    assert a == b
    frac = sum(v == "train" for v in a.values()) / len(a)
    assert 0.77 < frac < 0.83


def test_q10_paste0_na(spark):
    r = spark.range(1).select(SE.paste0(F.lit("kw"), F.lit(None).cast("string")).alias("x")).first()
    assert r.x == "kwNA"


def test_q12_ties_in_no_segment(spark):
    df = spark.createDataFrame([(100, 100, 90, 120), (100, 90, 80, 120)], "nm long, nt long, np long, a long")
    segs = [r.s for r in df.select(R.segment_id().alias("s")).collect()]
    assert segs == [None, 9]  # nm>nt, nm>np, nm<=a, np<nt


def test_q14_update_join_keeps_rows(spark):
    pol = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "polref long, a long")
    ext = spark.createDataFrame([(1, 50000.0), (1, 60000.0), (4, 1.0)], "polref long, premium double")
    out = {r.polref: r.p for r in J.override_price(pol, ext).collect()}
    assert len(out) == 3 and out[2] is None and abs(out[1] - (math.log(60000.0) - 10.74)) < 1e-12


def test_q16_fill_by_type(spark):
    df = spark.createDataFrame([(None, None)], "n int, s string")
    r = SC.fill_features(df, ["n", "s"]).first()
    assert r.n == -999 and r.s == "-999"


def test_q17_clashing_lookup_column_prefixed(spark):
    pol = spark.createDataFrame([("[0,38)", 9.0)], "kw_band string, kw_freq double")
    r = J.add_factor(pol, L.kw_lookup(spark), "kw_band").first()
    assert r.i_kw_freq == 9.0 and r.kw_freq == 1.0


def test_bonus_codes_and_yes_no(spark):
    df = spark.createDataFrame([("M04",), ("B1",), ("X",), (None,)], "b string")
    assert [r.x for r in df.select(SC.bonus_number("b").alias("x")).collect()] == [-4, 1, None, None]
    assert [r.x for r in df.select(SC.bonus_number("b", False).alias("x")).collect()] == [-4, None, None, None]
    yn = spark.createDataFrame([("YES",), ("no",), ("maybe",), (None,)], "v string")
    assert [r.x for r in yn.select(SC.yes_no("v").alias("x")).collect()] == [1, 0, 0, None]
    assert [r.x for r in yn.select(SC.yes_no("v", True).alias("x")).collect()] == [None, 1 - 1, None, None]


def test_ascii_name(spark):
    r = spark.range(1).select(SC.ascii_name(F.lit("Kár-rendezési költség")).alias("x")).first()
    assert r.x == "Kar_rendezesi_koltseg"


def test_portfolio_filter_and_id_prefix(spark):
    from ratebook.operators.portfolio import id_prefix, portfolio_filter
    df = spark.createDataFrame([(81100000706, "calculation"), (81200000001, "calculation"),
                                (81100000707, "offer")], "unique_id long, quote_type string")
    out = id_prefix(portfolio_filter(df, "quote_type", "calculation"), "unique_id", "811")
    assert [r.unique_id for r in out.collect()] == [81100000706]


def test_column_choice_helpers(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "price_c1 int, price_c2 int, a int, nm int")
    assert SC.cols_like(df, r"^price_c[0-9]+$") == ["price_c1", "price_c2"]
    assert SC.cols_except(df, ["a", "nm"]) == ["price_c1", "price_c2"]


def test_renewal_corridor_propagates_missing_and_chooses_by_claim(spark):
    from ratebook.functions.pricing import renewal_corridor
    rows = [(1, 100.0, 50.0, None, 80.0, 120.0),      # clean risk: min(1.2P, max(nt, max(1.05P, min comp)))
            (2, 100.0, 50.0, 10.0, 80.0, 300.0),      # claim: min(max comp, max(nt, max(mean comp, 2P)))
            (3, 100.0, 50.0, None, None, None)]       # no competitor: min comp missing -> strict pmax missing
    df = spark.createDataFrame(rows, "polref int, policy_premium double, nt double, claim double, c1 double, c2 double")
    out = {r.polref: r for r in renewal_corridor(df.withColumn("a", F.lit(100.0)), competitors=["c1", "c2"]).collect()}
    assert out[1].renewal_premium == min(120.0, max(50.0, max(105.0, 80.0)))
    assert out[2].renewal_premium == min(300.0, max(50.0, max(200.0, 200.0)))
    assert out[3].renewal_premium is None and out[3].renewal_factor is None


def test_renewal_corridor_query_returns_every_step(spark, tmp_path):
    """The whole chain of both risks, not only the two ends; a missing competitor counts nowhere, a missing break-even stops both."""
    from ratebook.plans import q_build

    rows = [(1, 100.0, 50.0, None, 80.0, 120.0), (2, 100.0, 50.0, 10.0, 80.0, 300.0), (3, 100.0, 50.0, 0.0, None, None), (4, 100.0, None, None, 90.0, 90.0)]
    pol = spark.createDataFrame(rows, "polref int, policy_premium double, nt double, claim double, price_c1 double, price_c2 double")
    pol = pol.withColumn("a", F.lit(100.0)).withColumn("policy_start_date", F.to_timestamp(F.lit("1995-06-15")))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(q_build.SI, "policy_view", lambda spark, sf_dir: pol)
        out = {r.polref: tuple(r)[1:] for r in q_build.q_renewal_corridor(spark, str(tmp_path)).collect()}
    assert out[1] == (120.0, 100.0, 80.0, 105.0, 120.0, 80.0, 105.0, 105.0, 105.0, 200.0, 200.0, 200.0, 120.0, 105.0, 1.05)
    assert out[2] == (300.0, 190.0, 80.0, 105.0, 120.0, 80.0, 105.0, 105.0, 105.0, 200.0, 200.0, 200.0, 200.0, 200.0, 2.0)
    assert out[3] == (None, None, None, 105.0, 120.0, None, None, None, None, 200.0, None, None, None, None, None)
    assert out[4] == (90.0, 90.0, 90.0, 105.0, 120.0, 90.0, 105.0, None, None, 200.0, 200.0, None, None, None, None)
