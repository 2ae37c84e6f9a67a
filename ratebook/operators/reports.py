"""Segment, class and one-way reports over a scored policy table.

Every report is ONE pass: a segment/level column is derived with a ``when``
chain or ``unpivot`` and a single ``groupBy`` aggregates all measures, so
Spark does a map-side partial aggregation before the (tiny) shuffle.  Hot
segments or levels therefore never meet in one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReportConfig
from ..functions.pricing import r_ifelse
from ..functions.semantics import lenient_sum, r_divide, strict_sum

C = ReportConfig()


def _wins(cfg: ReportConfig = C) -> tuple[Column, Column, Column]:
    """own wins ``nm > a``; model wins on fit scale ``m > p`` and money scale ``nm > np``."""
    own_lost = F.col(cfg.market) <= F.col(cfg.own)
    model_lost_fit = F.col(cfg.market_fit) <= F.col(cfg.model_fit)
    model_lost_money = F.col(cfg.market) <= F.col(cfg.model)
    return own_lost, model_lost_fit, model_lost_money


# names of the quote measures, in report order
MEASURES_FULL = [
    "count", "market", "technical", "value", "own", "model", "own_profit", "model_profit",
    "own_undercut", "model_undercut", "earned", "current_prem", "actual_claim", "own_cnt",
    "model_cnt", "own_prem", "model_prem", "own_earn", "model_earn", "own_cost", "model_cost",
    "own_claim", "model_claim",
]

# how each measure is summed: strict (R ``sum``), lenient (``na.rm=TRUE``) or
# derived from two other measures
_KIND = {
    "market": "strict", "technical": "strict", "own": "strict", "model": "strict",
    "own_profit": "strict", "model_profit": "strict", "own_undercut": "strict",
    "model_undercut": "strict", "own_cnt": "strict", "model_cnt": "strict",
    "own_prem": "strict", "model_prem": "strict", "own_earn": "strict",
    "model_earn": "strict", "own_cost": "strict", "model_cost": "strict",
    "earned": "lenient", "actual_earned": "lenient", "current_prem": "lenient",
    "actual_claim": "lenient", "own_claim": "lenient", "model_claim": "lenient",
}
_DERIVED = {"value": ("market", "technical", "diff"), "possprofit": ("market", "technical", "diff"),
            "mod_mul": ("model", "own", "ratio")}


def row_values(cfg: ReportConfig = C) -> dict[str, Column]:
    """Per-quote value of every summed measure (before aggregation)."""
    ol, mlf, mlm = _wins(cfg)
    nm, nt, a, np_ = (F.col(cfg.market), F.col(cfg.breakeven), F.col(cfg.own), F.col(cfg.model))
    earned, prem, claim = F.col(cfg.earned), F.col(cfg.premium), F.col(cfg.claim)
    return {
        "market": nm, "technical": nt, "own": a, "model": np_,
        "own_profit": r_ifelse(ol, 0, a - nt),
        "model_profit": r_ifelse(mlf, 0, np_ - nt),
        "own_undercut": r_ifelse(ol, 0, nm - a),
        "model_undercut": r_ifelse(mlf, 0, nm - np_),
        "earned": earned, "actual_earned": earned, "current_prem": prem, "actual_claim": claim,
        "own_cnt": r_ifelse(ol, 0, 1),
        "model_cnt": r_ifelse(mlf, 0, 1),
        "own_prem": r_ifelse(ol, 0, a),
        "model_prem": r_ifelse(mlm, 0, np_),
        "own_earn": r_ifelse(ol, 0, earned.cast("double") * a / prem),
        "model_earn": r_ifelse(mlm, 0, earned.cast("double") * np_ / prem),
        "own_cost": r_ifelse(ol, 0, nt),
        "model_cost": r_ifelse(mlf, 0, nt),
        "own_claim": r_ifelse(ol, 0, claim),
        "model_claim": r_ifelse(mlf, 0, claim),
    }


def _base_names(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for b in (_DERIVED[n][:2] if n in _DERIVED else ([] if n == "count" else [n])):
            if b not in out:
                out.append(b)
    return out


def measure_inputs(df: DataFrame, keys: list, names: list[str], cfg: ReportConfig = C) -> DataFrame:
    """Project the grouping keys and the per-quote values (``_v_<measure>``)."""
    vals = row_values(cfg)
    return df.select(*keys, *[vals[b].alias("_v_" + b) for b in _base_names(names)])


def aggregate_measures(inputs: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``groupBy(keys)`` over projected values: plain column sums only, so the
    aggregate stays small enough for whole-stage codegen."""
    aggs = [F.count(F.lit(1)).alias("count")] if "count" in names else []
    for b in _base_names(names):
        v = F.col("_v_" + b)
        agg = strict_sum(v) if _KIND[b] == "strict" else lenient_sum(v)
        aggs.append(agg.alias(b))
    out = inputs.groupBy(*keys).agg(*aggs)
    derived = {}
    for n in names:
        if n in _DERIVED:
            x, y, op = _DERIVED[n]
            derived[n] = F.col(x) - F.col(y) if op == "diff" else r_divide(x, y)
    return out.withColumns(derived).select(*keys, *names)


def quote_measures(df: DataFrame, keys: list[str], names: list[str] | None = None,
                   cfg: ReportConfig = C) -> DataFrame:
    """The reusable quote-measure aggregation (Appendix B) by key columns."""
    names = names or MEASURES_FULL
    return aggregate_measures(measure_inputs(df, keys, names, cfg), keys, names)


# fixed values: the 13 win/loss segments (id, own-wins flag, model-wins flag, label)
SEGMENTS = [
    (1, 0, 0, "both priced out of a good contract"),
    (2, 1, 0, "model priced out; own undercut so far that it loses"),
    (3, 1, 0, "model priced out; own cheapest, still profitable"),
    (4, 1, 1, "both cheapest and profitable"),
    (5, 1, 1, "both cheapest, only own price profitable"),
    (6, 1, 1, "both cheapest, only model price profitable"),
    (7, 1, 1, "both undercut into loss"),
    (8, 0, 1, "model profitably takes a good contract own priced out"),
    (9, 0, 1, "model takes it at a loss"),
    (10, 1, 1, "both cheapest on a bad contract"),
    (11, 0, 1, "only model cheapest on a bad contract"),
    (12, 1, 0, "only own cheapest on a bad contract"),
    (13, 0, 0, "both priced out of a bad contract"),
]


def segment_id(cfg: ReportConfig = C) -> Column:
    """Segment 1..13 of a quote; null for ``nm == nt`` ties or unknown prices."""
    nm, nt, a, np_ = (F.col(cfg.market), F.col(cfg.breakeven), F.col(cfg.own), F.col(cfg.model))
    good, bad = nm > nt, nm < nt
    return (
        F.when(good & (nm <= np_) & (nm <= a), 1)
        .when(good & (nm <= np_) & (nm > a) & (a < nt), 2)
        .when(good & (nm <= np_) & (nm > a) & (a >= nt), 3)
        .when(good & (nm > np_) & (nm > a) & (a >= nt) & (np_ >= nt), 4)
        .when(good & (nm > np_) & (nm > a) & (a >= nt) & (np_ < nt), 5)
        .when(good & (nm > np_) & (nm > a) & (a < nt) & (np_ >= nt), 6)
        .when(good & (nm > np_) & (nm > a) & (a < nt) & (np_ < nt), 7)
        .when(good & (nm > np_) & (nm <= a) & (np_ >= nt), 8)
        .when(good & (nm > np_) & (nm <= a) & (np_ < nt), 9)
        .when(bad & (nm > np_) & (nm > a), 10)
        .when(bad & (nm > np_) & (nm <= a), 11)
        .when(bad & (nm <= np_) & (nm > a), 12)
        .when(bad & (nm <= np_) & (nm <= a), 13)
    )


def _fill_empty(report: DataFrame, measures: list[str]) -> DataFrame:
    """A filter that selects nothing still reports a row of zeros (R semantics)."""
    missing = F.col("count").isNull()
    return report.withColumns({m: F.when(missing, F.lit(0)).otherwise(F.col(m)) for m in measures})


def segment_report(df: DataFrame, cfg: ReportConfig = C,
                   measures: list[str] | None = None) -> DataFrame:
    """13-segment win/loss report (A7), one row per segment, empty ones as zeros."""
    names = measures or MEASURES_FULL
    spark = df.sparkSession
    # the id is made non-nullable (0 = no segment): a filter on it, even the
    # ``isnotnull`` Catalyst infers from the join below, would be pushed down
    # with the whole price expression inlined into the upstream joins
    seg = df.withColumn("segment", F.coalesce(segment_id(cfg), F.lit(0)))
    agg = quote_measures(seg, ["segment"], names, cfg)
    defs = spark.createDataFrame(SEGMENTS, "segment int, own_flag int, model_flag int, label string")
    # 13-row definition table on the left; the aggregate has at most 13 rows
    out = F.broadcast(defs).join(F.broadcast(agg), "segment", "left")
    return _fill_empty(out, names).select("segment", "own_flag", "model_flag", "label", *names)


def segment_ties(df: DataFrame, cfg: ReportConfig = C) -> DataFrame:
    """Quotes in no segment because ``nm == nt`` (or a price is unknown)."""
    return (df.withColumn("segment", segment_id(cfg))
            .agg(F.count_if(F.col(cfg.market) == F.col(cfg.breakeven)).alias("ties"),
                 F.count_if(F.col("segment").isNull()).alias("unassigned")))


# fixed values: policy class labels (class id -> label); null is class 13
CLASSES = [
    (1, "large, 7 seats"),
    (2, "long-held vehicle, good bonus"),
    (3, "young holder and driver, bad bonus"),
    (4, "very heavy"),
    (5, "many domestic km, young vehicle"),
    (6, "strong, heavy"),
    (7, "young driver, small weak car"),
    (8, "older driver, small weak car"),
    (9, "high power, small engine, heavy, new"),
    (10, "old driver, old small car, long held, very good bonus"),
    (11, "old driver, newer average car, fairly good bonus"),
    (12, "very old licence, weaker bonus"),
    (13, "other, unclassified"),
]

CLASS_MEASURES = ["count", "market", "technical", "value", "own", "model", "own_profit",
                  "model_profit", "own_undercut", "model_undercut", "actual_claim", "own_cnt",
                  "model_cnt", "own_prem", "model_prem", "own_cost", "model_cost", "own_claim",
                  "model_claim"]


def class_report(df: DataFrame, class_col: str = "ujclass", cfg: ReportConfig = C) -> DataFrame:
    """Report per policy class 1..12 plus the unclassified (A9); flags are the constant 9."""
    spark = df.sparkSession
    k = F.col(class_col).cast("int")
    cls = df.withColumn("class_id", F.when(k.isNull(), F.lit(13))
                        .when(k.between(1, 12), k).otherwise(F.lit(0)))
    agg = quote_measures(cls, ["class_id"], CLASS_MEASURES, cfg)
    defs = spark.createDataFrame(CLASSES, "class_id int, label string")
    out = F.broadcast(defs).join(F.broadcast(agg), "class_id", "left")
    out = _fill_empty(out, CLASS_MEASURES).withColumns({"own_flag": F.lit(9), "model_flag": F.lit(9)})
    return out.select("class_id", "label", "own_flag", "model_flag", *CLASS_MEASURES)


def outcome_counts(df: DataFrame, m: str = "m", t: str = "t", p: str = "p",
                   cfg: ReportConfig = C) -> DataFrame:
    """Lost / won / avoided / swallowed quote counts of the model (A16), and the
    ``nm == nt`` ties that fall in no segment (Q12), in one aggregation."""
    M, T, P = F.col(m), F.col(t), F.col(p)
    return df.agg(
        F.count_if((M > T) & (M <= P)).alias("lost"),
        F.count_if((M > T) & (M > P)).alias("won"),
        F.count_if((M < T) & (M <= P)).alias("avoided"),
        F.count_if((M < T) & (M > P)).alias("swallowed"),
        F.count_if(F.col(cfg.market) == F.col(cfg.breakeven)).alias("ties"),
    )


# ---------------------------------------------------------------------------
# one-way reports

ONE_WAY_MEASURES = ["count", "market", "technical", "possprofit", "own", "model", "mod_mul",
                    "own_profit", "model_profit", "own_undercut", "model_undercut",
                    "actual_claim", "actual_earned"]
ONE_WAY_CLAIM_MEASURES = ["count", "market", "technical", "possprofit", "own", "model",
                          "mod_mul", "own_profit", "model_profit", "own_undercut",
                          "model_undercut", "actual_claim", "own_claim", "model_claim"]
ONE_WAY_BASE_MEASURES = ["count", "market", "technical", "possprofit", "own", "actual_claim"]


def long_levels(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Unpivot features to ``(feature, value)`` with the value as text, nulls kept."""
    slim = df.select(*keep, *[F.col(f).cast("string").alias(f) for f in features])
    return slim.unpivot(keep, features, "feature", "value")


def one_way(df: DataFrame, features: list[str], cfg: ReportConfig = C,
            measures: list[str] | None = None) -> DataFrame:
    """Every feature x level with the quote measures (A3).

    One ``unpivot`` + one ``groupBy(feature, value)`` replaces a scan per
    feature; partial aggregation runs before the shuffle, so the shuffle
    carries (features x levels x partitions) rows, not (policies x features).
    """
    names = measures or ONE_WAY_MEASURES
    inputs = measure_inputs(df, [F.col(f).cast("string").alias(f) for f in features], names, cfg)
    vcols = [c for c in inputs.columns if c.startswith("_v_")]
    long = inputs.unpivot(vcols, features, "feature", "value")
    return aggregate_measures(long, ["feature", "value"], names)


def one_way_claims(df: DataFrame, features: list[str], cfg: ReportConfig = C) -> DataFrame:
    """One-way with claims of won quotes and the claim-ratio change (A4, A5)."""
    rep = one_way(df, features, cfg, ONE_WAY_CLAIM_MEASURES)
    return rep.withColumn("improve", claim_ratio_change())


def one_way_base(df: DataFrame, features: list[str], cfg: ReportConfig = C) -> DataFrame:
    """Reduced one-way: market against claims."""
    return one_way(df, features, cfg, ONE_WAY_BASE_MEASURES)


def claim_ratio_change(model_claim: str = "model_claim", own_claim: str = "own_claim",
                       own: str = "own", model: str = "model") -> Column:
    """``min(2, max(0, (ModelClaim/OwnClaim) * Own / Model))``, missing -> 1 (A5).

    Division follows R: x/0 is +Inf (-> 2), -x/0 is -Inf (-> 0), 0/0 NaN (-> 1).
    """
    x = r_divide(r_divide(model_claim, own_claim) * F.col(own), model)
    return (F.when(x.isNull() | F.isnan(x), F.lit(1.0))
            .otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), x))))
