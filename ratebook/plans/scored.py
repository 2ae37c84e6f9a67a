"""The scored stand-in portfolio every report query starts from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import PricingConfig
from ..functions.pricing import quote_profit, to_scale
from ..functions.scalar import fill_features, require
from ..sources.standin import policy_view

CFG = PricingConfig()
#: a policy without one of these takes no part in fits and reports
REQUIRED = ["nt", "nm", "earned"]
#: the rating factors; a missing one is the level -999 (P5)
FEATURES = ["zip", "kw", "clientage", "bonus_malus_current", "f_segment", "f_priority", "f_status"]


def prepared(pol: DataFrame) -> DataFrame:
    """Policies with filled rating factors, without those that lack a required column."""
    return require(fill_features(pol, FEATURES), REQUIRED)


def scored_portfolio(spark: SparkSession, sf_dir: str, cfg: PricingConfig = CFG, fill: bool = True) -> DataFrame:
    """Stand-in policies with fit-scale columns ``t``, ``m``, ``p`` and profits.

    ``np`` of the stand-in plays the fitted model price; ``p`` is it on the
    fit scale, so ``m <= p`` is the model-loses test of the reports.  The claim
    reports (A4, A6) take the factors as they are: ``fill`` is off there.
    """
    pol = policy_view(spark, sf_dir)
    pol = prepared(pol) if fill else require(pol, REQUIRED)
    pol = pol.withColumns({
        "t": to_scale("nt", "a", cfg),
        "m": to_scale("nm", "a", cfg),
        "p": to_scale("np", "a", cfg),
    })
    return quote_profit(pol)
