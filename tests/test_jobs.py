"""End-to-end jobs on the sf0.001 tables with few rounds."""

import math

from ratebook.config import FitConfig, TreeConfig
from ratebook.plans.claim_model import compare_models
from ratebook.plans.tariff_job import JobConfig, run_tariff_job
from ratebook.sources.files import scratch_path

from .conftest import SF_SMALL


def number(text):
    return float(text.replace(",", "."))


def test_tariff_job_runs_and_writes_sinks(spark):
    out = scratch_path(spark, "tariff-job")
    res = run_tariff_job(spark, SF_SMALL, out, JobConfig(fit=FitConfig(max_rounds=5)))
    read = lambda name: spark.read.csv(f"{out}/{name}", sep=";", header=True).collect()
    fitted = {r.polref: r for r in spark.read.parquet(f"{out}/fitted").collect()}
    np_, own = [r.np for r in fitted.values()], [r.a for r in fitted.values()]
    assert math.isclose(res["mean_model"], sum(np_) / len(np_)) and math.isclose(res["mean_own"], sum(own) / len(own))
    assert res["lost"] == sum(r.nm <= r.np for r in fitted.values() if r.nm > r.nt)
    assert spark.read.parquet(f"{out}/segments").count() == 13
    # five rounds fit the bias alone: one price for all policies, multipliers of 1
    coef = {(r.feature, r.level): r.weight for r in spark.read.parquet(f"{out}/coefficients").collect()}
    assert {r.np for r in fitted.values()} == {np_[0]} and math.isclose(np_[0], math.exp(coef[("(bias)", "")] + 10.74))
    assert {(r.feature, r.level or "", round(number(r.multiplier), 9)) for r in read("multipliers")} == {(f, lv, round(math.exp(w), 9)) for (f, lv), w in coef.items()}
    assert {int(r.polref): number(r.price) for r in read("price_list")} == {k: float(round(r.np)) for k, r in fitted.items()}
    assert {int(r.polref) for r in read("test_split")} == {k for k, r in fitted.items() if r.split == "test"}
    renewals = read("renewals")
    assert {int(r.polref) for r in renewals} == {k for k, r in fitted.items() if r.policy_start_date.month == 6}
    for r in renewals:
        f = fitted[int(r.polref)]
        assert r.renewal_premium is None and f.renewal_premium is None or math.isclose(number(r.renewal_premium), f.renewal_premium)
    assert all(0 <= number(r.improve) <= 2 for r in read("claim_changes"))


def test_tariff_job_with_external_prices(spark):
    out = scratch_path(spark, "tariff-ext")
    res = run_tariff_job(spark, SF_SMALL, out, JobConfig(use_external_price=True))
    from ratebook.sources.standin import external_price
    prices = {r.polref: r.premium for r in external_price(spark, SF_SMALL).groupBy("polref").agg({"premium": "max"}).toDF("polref", "premium").collect()}
    fitted = spark.read.parquet(f"{out}/fitted").collect()
    assert all((r.np is None) == (prices.get(r.polref) is None) for r in fitted)
    assert all(math.isclose(r.np, prices[r.polref], rel_tol=1e-9) for r in fitted if r.np is not None)
    assert math.isclose(res["mean_model"], sum(r.np for r in fitted if r.np is not None) / sum(r.np is not None for r in fitted))


def test_claim_model_comparison(spark):
    res = {r.model: r for r in compare_models(spark, SF_SMALL, TreeConfig(rounds=3, max_depth=3, eta=0.05),
                                               baseline_iter=3).collect()}
    assert set(res) == {"custom_loss", "baseline"}
    assert all(0.0 <= r.auc <= 1.0 and r.log_loss > 0 for r in res.values())
