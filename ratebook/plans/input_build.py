"""Entry 1: build the fit input (rating factors, technical and market price).

One lazy chain: code map, banding, four lookup joins (all broadcast, their
sizes are fixed), technical premium, market minimum, drop incomplete rows.
No shuffle beyond what the policy source itself needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import market_price, technical_premium
from ..functions.scalar import (AGE_BREAKS, AGE_DEFAULT, KW_BREAKS, KW_DEFAULT, band,
                                bonus_number, require)
from ..operators.joins import add_bonus, add_factor
from ..sources.lookups import age_lookup, bm_lookup, kw_lookup
from ..sources.standin import policy_view, zip_multiplier

FREQ_SEV = ["kw_freq", "age_freq", "bm_freq", "kw_sev", "age_sev", "bm_sev"]


def rate_policies(pol: DataFrame, zips: DataFrame, competitors: list[str],
                  kw: str = "kw", age: str = "clientage", bonus: str = "bonus_malus_current",
                  short_bonus_codes: bool = True) -> DataFrame:
    """Rating factors, technical premium ``pp`` and market price ``nm`` of policies."""
    spark = pol.sparkSession
    out = pol.withColumns({
        "bmcorr": bonus_number(bonus, short_bonus_codes),
        "kw_band": band(kw, KW_BREAKS, KW_DEFAULT),
        "age_band": band(age, AGE_BREAKS, AGE_DEFAULT),
    })
    out = add_factor(out, kw_lookup(spark), "kw_band")
    out = add_factor(out, age_lookup(spark), "age_band")
    out = add_bonus(out, bm_lookup(spark), "bmcorr")
    out = add_factor(out, zips, "zip")
    out = out.withColumns({
        "pp": technical_premium(FREQ_SEV, "poli"),
        "nm": market_price(*competitors),
    })
    return require(out, ["pp"])


# the original feed's column names and the short names the pricing code uses
FEED_NAMES = {"vehicle_power": "kw", "contractor_age": "clientage", "postal_code": "zip"}


def policy_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in policy feed under the original feed column names."""
    return policy_view(spark, sf_dir).drop("nm").withColumnsRenamed({v: k for k, v in FEED_NAMES.items()})


def fit_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rated stand-in portfolio (policy feed -> fit input)."""
    from ..functions.scalar import cols_like, rename_inputs
    pol = rename_inputs(policy_feed(spark, sf_dir), FEED_NAMES)          # P1
    competitors = cols_like(pol, r"^price_c[0-9]+$")                      # P20
    rated = rate_policies(pol, zip_multiplier(spark, sf_dir), competitors)
    return rated.drop("bonus_malus_current")                              # P2: coded into bmcorr


INPUT_COLUMNS = ["polref", "zip", "bmcorr", "kw_band", "age_band", "poli", *FREQ_SEV, "pp", "nm"]


def fit_input_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_input(spark, sf_dir).select(*INPUT_COLUMNS)


def with_fit_targets(df: DataFrame) -> DataFrame:
    """Log target at loss ratio one half and log market (the raw-feature builder, P22)."""
    return df.withColumns({"tap": F.log(F.lit(2.0) * F.col("pp")), "m": F.log(F.col("nm"))})
