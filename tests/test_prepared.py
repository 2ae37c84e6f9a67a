"""The prepared portfolio: filled rating factors, required columns, and what the reports make of them."""

from pyspark.sql import functions as F

from ratebook.operators import reports as R
from ratebook.plans.catalog import QUERIES
from ratebook.plans.scored import FEATURES, REQUIRED, scored_portfolio
from ratebook.sources.standin import policy_view

from .conftest import SF_SMALL


def test_missing_factors_are_a_level(spark):
    pol = policy_view(spark, SF_SMALL).dropna(subset=REQUIRED)
    lacking = {f: pol.filter(F.col(f).isNull()).count() for f in ("kw", "clientage")}
    assert all(lacking.values())
    scored = scored_portfolio(spark, SF_SMALL)
    assert scored.count() == pol.count()
    rows = {r.feature: r["count"] for r in R.one_way(scored, FEATURES).filter("value = '-999'").collect()}
    assert rows == lacking
    assert scored.filter(F.greatest(*[F.col(f).isNull().cast("int") for f in FEATURES]) == 1).isEmpty()


def test_earned_money_of_own_won_segments(spark):
    rows = QUERIES["segment_report"](spark, SF_SMALL).collect()
    assert all(r.own_earn is not None and r.model_earn is not None for r in rows)
    own_won = [r for r in rows if r["count"] and r.own_cnt]
    assert own_won and all(r.own_earn != 0 for r in own_won)
