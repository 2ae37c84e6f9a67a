"""Entry 2: the monthly tariff job, end to end.

enriched policies -> fit-scale targets -> split -> additive fit (or an
external price table) -> model price -> profits -> renewal corridor ->
sinks (price list, renewals, scored test split, multipliers and claim changes
as decimal-comma CSV, fitted table and coefficients as Parquet) -> reports
(segments, classes, one-way with multipliers, curves).

The scored table is checkpointed once into the shared folder; every report
is then an independent job reading it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FitConfig, PricingConfig
from ..functions.objectives import corridor_objective
from ..functions.pricing import from_scale, price_list, quote_profit, renewal_corridor, targets
from ..functions.scalar import cols_like
from ..operators import fit as FT
from ..operators import joins as J
from ..operators import reports as R
from ..operators import sampling as SP
from ..operators import windows as W
from ..operators.aggregates import varying_feature_names
from ..operators.portfolio import centred_benefit, renewing_in
from ..session import cut_lineage
from ..sources import files as FL
from ..sources import standin as SI
from .scored import FEATURES, prepared


@dataclass(frozen=True)
class JobConfig:
    pricing: PricingConfig = PricingConfig()
    fit: FitConfig = FitConfig()
    renewal_month: int = 6
    use_external_price: bool = False


def renewal_columns(df: DataFrame) -> list[str]:
    """What the renewal list holds: key, start, rating factors, competitor prices and the renewal corridor."""
    corridor = ["market_low", "market_mean", "market_high", "clean_premium", "claim_premium", "renewal_premium", "renewal_factor"]
    return ["polref", "policy_start_date", *FEATURES, "policy_premium", "a", "nt", "claim", *cols_like(df, r"^price_c[0-9]+$"), *corridor]


def run_tariff_job(spark: SparkSession, sf_dir: str, out_dir: str, cfg: JobConfig = JobConfig()) -> dict:
    """Run the job; write sinks and reports under ``out_dir``; return small summaries."""
    pol = prepared(SI.policy_view(spark, sf_dir).drop("np"))
    pol = targets(pol, cfg.pricing, nt_given=True)
    pol = SP.split(pol, "polref")
    if cfg.use_external_price:
        pol = J.override_price(pol, SI.external_price(spark, sf_dir), cfg.pricing)
        coef = None
    else:
        model = FT.fit_additive(pol, varying_feature_names(pol, FEATURES), corridor_objective("t", "m", "acc"),
                                ["t", "m", "acc"], cfg.fit)
        coef = model.coefficients(spark)
        pol = FT.score(pol, coef, FEATURES, out="p")
    pol = pol.withColumn("np", from_scale("p", "a", cfg.pricing))
    pol = centred_benefit(quote_profit(pol))
    pol = renewal_corridor(pol, competitors=cols_like(pol, r"^price_c[0-9]+$"))
    scored = cut_lineage(pol)

    FL.write_decimal_comma(price_list(scored, "polref", "np"), f"{out_dir}/price_list")
    FL.write_decimal_comma(renewing_in(scored, cfg.renewal_month).select(*renewal_columns(scored)), f"{out_dir}/renewals")
    FL.write_parquet(scored, f"{out_dir}/fitted")
    test = scored.filter(F.col("split") == "test")
    FL.write_decimal_comma(test, f"{out_dir}/test_split")
    R.segment_report(scored).write.mode("overwrite").parquet(f"{out_dir}/segments")
    J.add_class(scored, SI.policy_class(spark, sf_dir)).transform(R.class_report) \
        .write.mode("overwrite").parquet(f"{out_dir}/classes")
    one_way = R.one_way(scored, FEATURES)
    if coef is not None:
        one_way = J.with_multiplier(one_way, FT.multipliers(coef).select("feature_level", F.log("multiplier").alias("weight")))
        FT.save_coefficients(coef, f"{out_dir}/coefficients")
        FL.write_decimal_comma(FT.multipliers(coef).select("feature", "level", "multiplier"), f"{out_dir}/multipliers")
    one_way.write.mode("overwrite").parquet(f"{out_dir}/one_way")
    claims = cut_lineage(R.one_way_claims(test, FEATURES))
    FL.write_decimal_comma(claims, f"{out_dir}/claim_changes")
    W.axis_scaled(claims, "improve").write.mode("overwrite").parquet(f"{out_dir}/one_way_claims")
    part = F.when(F.col("m") > F.col("t"), "profit").when(F.col("m") <= F.col("t"), "loss")
    W.sorted_curves(scored.withColumn("part", part).filter(F.col("part").isNotNull()),
                    ["nt", "nm", "np", "a"], "polref", points=200, by=["part"]) \
        .write.mode("overwrite").parquet(f"{out_dir}/curves")
    means = scored.agg(F.avg("a").alias("mean_own"), F.avg("np").alias("mean_model")).first()
    counts = R.outcome_counts(scored).first()
    return {"mean_own": means.mean_own, "mean_model": means.mean_model, **counts.asDict()}
