"""Registered queries: objectives, metrics, curves, densities, encoding, fits."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CORRIDOR_CONVERSION, CORRIDOR_NORMALISED, CORRIDOR_PLOT, CORRIDOR_TARIFF, FitConfig, TreeConfig
from ..functions import objectives as O
from ..functions.pricing import deviation_weight, targets
from ..functions.semantics import paste0
from ..operators import curves as CV
from ..operators import fit as FT
from ..operators import joins as J
from ..operators import metrics as MT
from ..operators import reports as R
from ..operators import sampling as SP
from ..operators import windows as W
from ..operators.aggregates import varying_feature_names
from ..session import cut_lineage
from ..sources import standin as SI
from ..sources.standin import with_standin
from .catalog import register, rounded
from .q_build import SCORED_CTE, lookup_ctes
from .q_reports import FEATURES, TEST_SPLIT
from .scored import scored_portfolio

# --- SQL text of the column expressions (oracle side) ------------------------


def lg(x: str, alpha: float = 1.0) -> str:
    return f"(1e0 / (1e0 + exp(-({x}) / {alpha!r})))"


def conv(x: str) -> str:
    return f"((1e0 + tanh(-8.78002e0 * ({x}) + 8.32548e0)) / 2e0)"


def corridor_sql(p, t, u, m, w, su, so, sm, profit) -> tuple[str, str]:
    g_under = f"({w.w_under!r} * (-2e0 * ({t} - {p})) + {w.w_mid!r} * (2e0 * ({p} - {u})))"
    g_mid = f"({w.w_mid!r} * (2e0 * ({p} - {u})))"
    g_over = f"({w.w_over!r} * (2e0 * ({p} - {u})) * ({u} - {t}))"
    h_under = f"(2e0 * ({w.w_under!r} + {w.w_mid!r}))"
    h_mid = f"(2e0 * {w.w_mid!r})"
    h_over = f"(2e0 * {w.w_over!r} * ({u} - {t}))"
    g_loss = f"({w.w_loss_low!r} * (-2e0 * ({m} - {p})) + {w.w_loss_high!r} * (-2e0 * ({t} - {p})))"
    h_loss = f"(2e0 * {w.w_loss_low!r} + 2e0 * {w.w_loss_high!r})"
    g = f"CASE WHEN {profit} THEN {g_under} * {su} + {g_mid} * {sm} + {g_over} * {so} ELSE {g_loss} END"
    h = f"CASE WHEN {profit} THEN {h_under} * {su} + {h_mid} * {sm} + {h_over} * {so} ELSE {h_loss} END"
    return g, h


def _corridor_query_sql() -> str:
    w1, w2, w3 = CORRIDOR_TARIFF, CORRIDOR_NORMALISED, CORRIDOR_CONVERSION
    g1, h1 = corridor_sql("p", "t", "acc", "m", w1, "su1", "so1", "(1e0 - su1 - so1)", "acc > t")
    tot = "(su2 + (1e0 - su2 - so2) + so2)"
    g2, h2 = corridor_sql("p", "t", "m", "m", w2, f"(su2 / {tot})", f"(so2 / {tot})",
                          f"((1e0 - su2 - so2) / {tot})", "m > t")
    g3, h3 = corridor_sql("p", "t", "m", "m", w3, "su3", "so3", "(1e0 - su3 - so3)", "m > t")
    ctes = SCORED_CTE + f""",
tg AS (SELECT polref, p, t, m,
  ln(CASE WHEN nm IS NOT NULL AND nt IS NOT NULL THEN greatest(nm - 100e0, nm * 0.992e0, nt) END) - 10.74e0 AS acc FROM scored),
mk AS (SELECT *, {lg('t - p', w1.alpha_under)} AS su1, {lg('p - acc', w1.alpha_over)} AS so1,
  {lg('t - p', w2.alpha_under)} AS su2, {lg('p - m', w2.alpha_over)} AS so2,
  {lg('t - p', w3.alpha_under)} AS su3, {conv('p - m')} AS so3 FROM tg)"""
    body = f"""SELECT polref, round({g1}, 6) AS g1, round({h1}, 6) AS h1, round({g2}, 6) AS g2,
  round({h2}, 6) AS h2, round({g3}, 6) AS g3, round({h3}, 6) AS h3 FROM mk"""
    return with_standin(body, ctes)


def with_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    return targets(s.drop("t", "m"), nt_given=True)


# --- O1, O2, O3 (+P35 logistic masks, P36 conversion curve) ---
@register("corridor_objectives", _corridor_query_sql())
def q_corridor_objectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = with_acc(spark, sf_dir)
    pulls = [O.corridor_pulls("p", "t", "m", "acc"), O.normalised_pulls("p", "t", "m"), O.conversion_pulls("p", "t", "m")]
    staged = [x.staged(f"o{k}") for k, x in enumerate(pulls, 1)]
    for columns, _ in staged:
        s = s.withColumns(columns)
    out = [c.alias(f"{kind}{k}") for k, (_, x) in enumerate(staged, 1) for kind, c in zip("gh", x.grad(F.col("p")))]
    d = s.select("polref", *out)
    return rounded(d, ["g1", "h1", "g2", "h2", "g3", "h3"])


# --- L1, L2, O6: loss values and the smooth hinge ---
def _loss_sql() -> str:
    w = CORRIDOR_PLOT
    a = w.alpha_under
    su, so = lg("t - p", a), lg("p - m", a)
    sm = f"(1e0 - {su} - {so})"
    tot = f"({su} + {sm} + {so})"
    under = f"({w.w_under!r} * pow(t - p, 2) + {w.w_mid!r} * pow(p - m, 2))"
    mid = f"({w.w_mid!r} * pow(p - m, 2))"
    over = f"({w.w_over!r} * pow(p - m, 2) * (m - t))"
    l1 = (f"CASE WHEN m > t THEN {under} * ({su} / {tot}) + {mid} * ({sm} / {tot}) + {over} * ({so} / {tot})"
          f" ELSE {w.w_loss_low!r} * pow(m - p, 2) + {w.w_loss_high!r} * pow(t - p, 2) END")
    s = lg("(p - m) / 0.1")
    ds = f"({s} * (1e0 - {s}) / 0.1)"
    d2 = f"({ds} * (1e0 - 2e0 * {s}) / 0.1)"
    g6 = f"CASE WHEN t >= m THEN -(1e0 - {s}) - (t - p) * {ds} ELSE {ds} * (m - t) - (1e0 - {s}) END"
    h6 = f"greatest(CASE WHEN t >= m THEN -{ds} + (t - p) * {d2} ELSE {d2} * (m - t) + {ds} END, 1e-6)"
    v6 = f"CASE WHEN t >= m THEN (1e0 - {s}) * (p - t) ELSE {s} * (m - t) + (1e0 - {s}) * (m - p) END"
    P, A, M = "(np / 1e4)", "(coalesce(claim, 0) / 1e4)", "(nm / 1e4)"
    mx = f"greatest({M}, {A})"
    l2 = f"{mx} - {P} + ({M} - {A} - ({mx} - {P})) * (1e0 / (1e0 + exp(-10e0 * ({P} - ({M} - 0.2e0)))))"
    body = f"""SELECT polref, round({l1}, 6) AS l1, round({l2}, 6) AS l2, round({g6}, 6) AS hinge_g,
  round({h6}, 6) AS hinge_h, round({v6}, 6) AS hinge_v FROM scored"""
    return with_standin(body, SCORED_CTE)


@register("loss_values", _loss_sql())
def q_loss_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    g6, h6 = O.hinge_grad("p", "t", "m")
    P, A, M = F.col("np") / 1e4, F.coalesce(F.col("claim"), F.lit(0)) / 1e4, F.col("nm") / 1e4
    d = s.select("polref", O.convex_loss("p", "t", "m").alias("l1"), O.step_loss(P, A, M).alias("l2"),
                 g6.alias("hinge_g"), h6.alias("hinge_h"), O.hinge_value("p", "t", "m").alias("hinge_v"))
    return rounded(d, ["l1", "l2", "hinge_g", "hinge_h", "hinge_v"])


# --- A17-A20: business metrics of the model price ---
@register("business_metrics", with_standin("""SELECT
  round(coalesce(avg(CASE WHEN m > t AND p < m THEN exp(m) - exp(p) END), 0e0), 6) AS avg_undercut,
  CAST(count_if(m > t AND p < t) AS BIGINT) AS profit_missed_count,
  round(coalesce(sum(CASE WHEN m > t AND greatest(0e0, t - p) > 0 THEN exp(t) - exp(p) END), 0e0), 6) AS profit_impact,
  CAST(count_if(m <= t AND p >= t) AS BIGINT) AS loss_got_count
FROM scored""", SCORED_CTE))
def q_business_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(MT.business_metrics(scored_portfolio(spark, sf_dir)), ["avg_undercut", "profit_impact"])


# --- P6, P8, M4, P34, A21, P35 (clipped), O4: claim classifier inputs and gradient ---
CLASSIFIER_CTES = """
cbase AS (SELECT polref, CAST(claim IS NOT NULL AS INTEGER) AS label, coalesce(kw, -1) AS kw, clientage, zip, nm, a
  FROM priced WHERE clientage IS NOT NULL AND nm IS NOT NULL),
strat AS (SELECT *, CASE WHEN r <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY ((polref % 1000003) * 48271 + 42) % 1000003, polref) AS r,
    count(*) OVER (PARTITION BY label) AS n FROM cbase)),
med AS (SELECT quantile_cont(nm, 0.5) AS med FROM strat WHERE split = 'train'),
st AS (SELECT avg(kw) AS mu_kw, CASE WHEN stddev_pop(kw) = 0 THEN 1e0 ELSE stddev_pop(kw) END AS sd_kw,
  avg(clientage) AS mu_age, CASE WHEN stddev_pop(clientage) = 0 THEN 1e0 ELSE stddev_pop(clientage) END AS sd_age,
  avg(zip) AS mu_zip, CASE WHEN stddev_pop(zip) = 0 THEN 1e0 ELSE stddev_pop(zip) END AS sd_zip
  FROM strat WHERE split = 'train')"""

CLASSIFIER_SQL = with_standin("""
SELECT polref, split, round(nm / (SELECT med FROM med), 6) AS market_scaled,
  round(typ, 6) AS typicality, round(g, 6) AS g, round(h, 6) AS h FROM (
  SELECT *, typ * (mk * pr * (1e0 - pr) - label * (1e0 - pr)) AS g,
         typ * (mk * (1e0 - 2e0 * pr) * pr * (1e0 - pr) + label * pr * (1e0 - pr)) AS h FROM (
    SELECT s.*, nm / (SELECT med FROM med) AS mk,
      exp(-0.5e0 * sqrt(pow((kw - st.mu_kw) / st.sd_kw, 2) + pow((clientage - st.mu_age) / st.sd_age, 2)
                        + pow((zip - st.mu_zip) / st.sd_zip, 2))) AS typ,
      1e0 / (1e0 + exp(-least(greatest(CAST(a - nm AS DOUBLE) / 1e4, -35e0), 35e0))) AS pr
    FROM strat s, st))""", CLASSIFIER_CTES)



def median_scaled(train: DataFrame, df: DataFrame, c: str, key: str, out: str) -> DataFrame:
    """Price divided by the TRAIN median (P34); exact median by distributed rank."""
    med = MT.exact_quantiles(train, c, [0.5], key).select("q_0").scalar()
    return df.withColumn(out, F.col(c) / med)


@register("claim_classifier", CLASSIFIER_SQL)
def q_claim_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import fill_marker, require_all_except
    pol = SI.policy_view(spark, sf_dir).select(
        "polref", F.col("claim").isNotNull().cast("int").alias("label"), "kw", "clientage", "zip", "nm", "a")
    pol = fill_marker(pol, ["kw"])
    pol = require_all_except(pol, ["kw", "clientage", "zip", "nm"], exempt=["kw"])
    st = SP.stratified_split(pol, "polref", "label", 0.8, seed=42)
    train = st.filter(F.col("split") == "train")
    d = median_scaled(train, st, "nm", "polref", "market_scaled")
    cols = ["kw", "clientage", "zip"]
    d = MT.typicality(d, MT.scaler_stats(train, cols), cols, alpha=0.5)
    g, h = O.profit_logistic_grad((F.col("a") - F.col("nm")) / 1e4, "label", "market_scaled", "typicality")
    d = d.select("polref", "split", "market_scaled", "typicality", g.alias("g"), h.alias("h"))
    return rounded(d, ["market_scaled", "typicality", "g", "h"])


# --- M3, P32, P33, O5: deviation-weighted logistic on the simulated-quote view ---
DEVIATION_SQL = with_standin(f"""
SELECT polref, split, round(v_shift, 6) AS v_shift, round(w, 6) AS weight,
  round((1e0 / (1e0 + exp(-tt)) - label) * w, 6) AS g,
  round((1e0 / (1e0 + exp(-tt))) * (1e0 - 1e0 / (1e0 + exp(-tt))) * w, 6) AS h FROM (
  SELECT *, CASE WHEN v_shift - tt IS NULL OR isnan(v_shift - tt) THEN 1e0
            WHEN least(greatest(v_shift - tt, 0e0), 1e0) > 0
              THEN pow(least(greatest(v_shift - tt, 0e0), 1e0), 0.5e0) * exp(-least(greatest(v_shift - tt, 0e0), 1e0))
            ELSE 1e0 END AS w FROM (
    SELECT *, vv + abs((SELECT min(vv) FROM q WHERE split = 'train')) + 1e-6 AS v_shift FROM q))""", f"""
q AS (SELECT polref, CAST(claim IS NOT NULL AS INTEGER) AS label, ln(nm) - ln(nt) AS tt,
  CAST(np - nm AS DOUBLE) / 1e4 AS vv, CASE WHEN {TEST_SPLIT.replace('1234', '123')} THEN 'test' ELSE 'train' END AS split
  FROM priced)""")


@register("deviation_weights", DEVIATION_SQL)
def q_deviation_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pol = SI.policy_view(spark, sf_dir).select(
        "polref", F.col("claim").isNotNull().cast("int").alias("label"),
        (F.log("nm") - F.log("nt")).alias("tt"), ((F.col("np") - F.col("nm")) / 1e4).alias("vv"))
    pol = SP.split(pol, "polref", 0.8, seed=123)
    mn = pol.filter(F.col("split") == "train").agg(F.min("vv")).scalar()
    pol = pol.withColumn("v_shift", F.col("vv") + F.abs(mn) + F.lit(1e-6))
    g, h = O.deviation_logistic_grad("tt", "label", "v_shift", "tt")
    d = pol.select("polref", "split", "v_shift", deviation_weight("v_shift", "tt").alias("weight"),
                   g.alias("g"), h.alias("h"))
    return rounded(d, ["v_shift", "weight", "g", "h"])


# --- M3: a split with exactly the share of the rows ---
@register("exact_split", with_standin("""SELECT polref, CASE WHEN r <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT polref, row_number() OVER (ORDER BY ((polref % 1000003) * 48271 + 1234) % 1000003, polref) AS r, count(*) OVER () AS n FROM priced)"""))
def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.exact_split(SI.policy_view(spark, sf_dir).select("polref"), "polref")


# --- A22: exact AUC with ties, log loss ---
AUC_SQL = with_standin("""
SELECT round(sum(pos * (cum_neg - neg * 0.5e0)) / (sum(pos) * sum(neg)), 9) AS auc,
  (SELECT round(avg(-(label * ln(least(greatest(pr, 1e-15), 1 - 1e-15))
          + (1 - label) * ln(1e0 - least(greatest(pr, 1e-15), 1 - 1e-15)))), 6) FROM sc) AS log_loss
FROM (SELECT s, pos, neg, sum(neg) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS cum_neg FROM (
  SELECT s, CAST(sum(label) AS DOUBLE) AS pos, CAST(sum(1 - label) AS DOUBLE) AS neg FROM sc GROUP BY s))""", """
sc AS (SELECT CAST(claim IS NOT NULL AS INTEGER) AS label, CAST(floor((a - nm) / 100e0) AS BIGINT) AS s,
  1e0 / (1e0 + exp(-(CAST(floor((a - nm) / 100e0) AS BIGINT) / 100e0))) AS pr FROM priced)""")


@register("auc_logloss", AUC_SQL)
def q_auc_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    pol = SI.policy_view(spark, sf_dir).select(
        F.col("claim").isNotNull().cast("int").alias("label"),
        F.floor((F.col("a") - F.col("nm")) / 100.0).alias("s"))
    pol = pol.withColumn("pr", O.logistic(F.col("s") / 100.0))
    a = rounded(MT.auc(pol, "label", "s"), ["auc"], 9)
    ll = rounded(pol.agg(MT.log_loss(pol, "label", "pr").alias("log_loss")), ["log_loss"])
    return a.select("auc", ll.select("log_loss").scalar().alias("log_loss"))


# --- W8 + G1: loss curve of one representative policy per segment ---
def _curve_sql() -> str:
    w = CORRIDOR_PLOT
    a = 1e-5
    su, so = lg("t - price", a), lg("price - m", a)
    sm = f"(1e0 - {su} - {so})"
    tot = f"({su} + {sm} + {so})"
    under = f"({w.w_under!r} * pow(t - price, 2) + {w.w_mid!r} * pow(price - m, 2))"
    mid = f"({w.w_mid!r} * pow(price - m, 2))"
    over = f"({w.w_over!r} * pow(price - m, 2) * (m - t))"
    l1 = (f"CASE WHEN m > t THEN {under} * ({su} / {tot}) + {mid} * ({sm} / {tot}) + {over} * ({so} / {tot})"
          f" ELSE {w.w_loss_low!r} * pow(m - price, 2) + {w.w_loss_high!r} * pow(t - price, 2) END")
    from . import sqltext as S
    ctes = SCORED_CTE + f""",
reps AS (SELECT min(polref) AS polref FROM (SELECT polref, coalesce({S.SEGMENT_CASE}, 0) AS seg FROM scored) GROUP BY seg),
pts AS (SELECT s.polref, s.t, s.m, least(s.t, s.m, s.p) - (greatest(s.t, s.m, s.p) - least(s.t, s.m, s.p)) / 10e0 AS lo,
  greatest(s.t, s.m, s.p) + (greatest(s.t, s.m, s.p) - least(s.t, s.m, s.p)) / 10e0 AS hi
  FROM scored s WHERE s.polref IN (SELECT polref FROM reps)),
grid AS (SELECT polref, t, m, j, CASE WHEN j = 499 THEN hi WHEN j = 0 THEN lo ELSE lo + j * ((hi - lo) / 499) END AS price
  FROM pts, (SELECT unnest(generate_series(0, 499)) AS j))"""
    body = f"SELECT polref, CAST(j AS INTEGER) AS j, round(price, 6) AS price, round({l1}, 6) AS loss, round(exp(price), 4) AS ep FROM grid"
    return with_standin(body, ctes)


@register("loss_curves", _curve_sql())
def q_loss_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    reps = (s.withColumn("seg", F.coalesce(R.segment_id(), F.lit(0)))
            .groupBy("seg").agg(F.min("polref").alias("polref")))
    chosen = J.restrict_to(s, reps, "polref")
    d = CV.loss_curve(chosen)
    return rounded(rounded(d, ["price", "loss"]), ["ep"], 4)


@register("one_policy", with_standin("""SELECT polref, a, nm, nt, np, advantage FROM (
  SELECT *, (CASE WHEN m <= p THEN 0 WHEN m > p THEN np - nt END) - (CASE WHEN nm <= a THEN 0 WHEN nm > a THEN a - nt END) AS advantage
  FROM scored) ORDER BY advantage DESC, polref DESC LIMIT 1""", SCORED_CTE))
def q_one_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy where the model gains most over the own price (W8 with a data-chosen key)."""
    s = scored_portfolio(spark, sf_dir)
    key = s.agg(F.max(F.struct("advantage", "polref")).alias("b")).select("b.polref").scalar()
    return W.one_policy(s, "polref", key).select("polref", "a", "nm", "nt", "np", "advantage")


# --- G2: profit curve and best price per product (part table) ---
def _best_price_sql(key_sql: str, cost_sql: str, b0: str, b1: str, source: str, extra: str = "") -> str:
    x = "CASE WHEN j = 499 THEN 60e0 ELSE j * (55e0 / 499) + 5e0 END"
    return f"""
SELECT {key_sql}, round(bx, 6) AS best_price, round(bp, 6) AS best_profit,
  round((bx - cost) * greatest(100e0 - 2e0 * bx, 0e0), 6) AS true_profit FROM (
  SELECT {key_sql}, cost, arg_min({x}, -profit * 1e6 + j) AS bx, max(profit) AS bp FROM (
    SELECT *, ({x} - cost) * greatest({b0} - {b1} * ({x}), 0e0) AS profit
    FROM (SELECT *, unnest(generate_series(0, 499)) AS j FROM {source})) GROUP BY {key_sql}, cost)"""


BEST_SQL = with_standin(
    _best_price_sql("p_partkey", "cost", "95e0", "b1", "prod"),
    "prod AS (SELECT p_partkey, p_retailprice / 100e0 AS cost, 1.8e0 + p_size / 500e0 AS b1 FROM part)")


@register("best_price", BEST_SQL)
def q_best_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SI.read_table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_retailprice") / 100.0).alias("cost"), F.lit(95.0).alias("b0"),
        (F.lit(1.8) + F.col("p_size") / 500.0).alias("b1"))
    d = CV.best_price(p, "p_partkey", "cost", "b0", "b1")
    return rounded(d, ["best_price", "best_profit", "true_profit"])


# --- G3: decision loss over a scan of guessed slopes, per brand ---
SCAN_SQL = with_standin("""
SELECT p_brand, CAST(k AS INTEGER) AS k, round(theta, 6) AS theta, round(bx, 6) AS best_price,
  round(-((bx - cost) * greatest(100e0 - 2e0 * bx, 0e0)), 6) AS loss FROM (
  SELECT p_brand, k, theta, cost, arg_min(x, -profit * 1e6 + j) AS bx FROM (
    SELECT *, (x - cost) * greatest(100e0 - theta * x, 0e0) AS profit FROM (
      SELECT *, CASE WHEN j = 499 THEN 60e0 ELSE j * (55e0 / 499) + 5e0 END AS x FROM (
        SELECT *, unnest(generate_series(0, 499)) AS j FROM (
          SELECT *, CASE WHEN k = 199 THEN 2.5e0 ELSE k * (1e0 / 199) + 1.5e0 END AS theta FROM (
            SELECT *, unnest(generate_series(0, 199)) AS k FROM brands)))))
  GROUP BY p_brand, k, theta, cost)""",
    "brands AS (SELECT p_brand, round(avg(p_retailprice) / 100e0, 4) AS cost FROM part GROUP BY p_brand)")


@register("parameter_scan", SCAN_SQL)
def q_parameter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = SI.read_table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice") / 100.0, 4).alias("cost"))
    d = CV.parameter_scan(brands, "p_brand", "cost").withColumn("k", F.col("k").cast("int"))
    return rounded(d, ["theta", "best_price", "loss"])


# --- H1: density histogram of log own and log model price on one range (test split) ---
LNG_CTE = f"""
lng AS (SELECT unnest(['a', 'np']) AS series, unnest([ln(a), ln(np)]) AS x FROM priced
  WHERE ({TEST_SPLIT}) AND nt IS NOT NULL AND nm IS NOT NULL AND earned IS NOT NULL)"""

HIST_SQL = with_standin("""
SELECT b.series, CAST(b.bin AS INTEGER) AS bin, round(b.first + b.bin * b.width, 6) AS "left",
  round(coalesce(c.cnt, 0) / (b.n * b.width), 6) AS density
FROM (SELECT series, n, first, width, unnest(generate_series(0, 29)) AS bin
      FROM (SELECT series, count(*) AS n FROM lng GROUP BY series), st) b
LEFT JOIN (SELECT series, CAST(least(greatest(ceil((x - first) / width) - 1, 0), 29) AS INTEGER) AS bin, count(*) AS cnt
           FROM lng, st GROUP BY 1, 2) c ON b.series = c.series AND b.bin = c.bin""", LNG_CTE + """,
st AS (SELECT min(x) - (max(x) - min(x)) / 29 / 2 AS first, (max(x) - min(x)) / 29 AS width FROM lng)""")


@register("density_histogram", HIST_SQL)
def q_density_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = SP.split(scored_portfolio(spark, sf_dir), "polref").filter(F.col("split") == "test")
    return rounded(CV.density_histogram(test, ["a", "np"], 30), ["left", "density"])


# --- H2: kernel densities of log own and log model price on one range (test split) ---
KDE_SQL = with_standin("""
SELECT series, CAST(j AS INTEGER) AS j, round(g, 6) AS g, round(exp(g)) AS price,
  round(max(CASE WHEN kk = k THEN d END) + (max(place) - max(k)) * (max(CASE WHEN kk = k + 1 THEN d END) - max(CASE WHEN kk = k THEN d END)), 6) AS density
FROM (
  SELECT o.series, o.j, o.g, o.place, o.k, o.kk, sum(m.w * exp(-0.5e0 * pow((o.kk - m.k) * o.step / o.bw, 2))) / (max(o.n) * max(o.bw) * sqrt(2e0 * pi())) AS d
  FROM (SELECT *, floor(place) AS k, unnest([floor(place), floor(place) + 1]) AS kk
        FROM (SELECT *, (g - lo) / step AS place FROM (SELECT *, x0 + j * (x1 - x0) / 511 AS g FROM (SELECT *, unnest(generate_series(0, 511)) AS j FROM st)))) o
  JOIN mass m USING (series) GROUP BY o.series, o.j, o.g, o.place, o.k, o.kk)
GROUP BY series, j, g""", LNG_CTE + """,
sides AS (SELECT min(x) AS x0, max(x) AS x1 FROM lng),
bws AS (SELECT series, count(*) AS n, stddev_samp(x) AS sd, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, min(x) AS least FROM lng GROUP BY series),
bw AS (SELECT series, n, 0.9e0 * pow(CAST(n AS DOUBLE), -0.2e0) *
  CASE WHEN least(sd, iqr / 1.34e0) > 0 THEN least(sd, iqr / 1.34e0) WHEN sd > 0 THEN sd WHEN least <> 0 THEN abs(least) ELSE 1e0 END AS bw FROM bws),
st AS (SELECT series, n, bw, x0, x1, x0 - 4 * bw AS lo, (x1 + 4 * bw - (x0 - 4 * bw)) / 511 AS step FROM bw, sides),
mass AS (SELECT series, k, sum(w) AS w FROM (
  SELECT series, unnest([floor(place), floor(place) + 1]) AS k, unnest([1e0 - (place - floor(place)), place - floor(place)]) AS w
  FROM (SELECT series, (x - lo) / step AS place FROM lng JOIN st USING (series))) GROUP BY 1, 2)""")


@register("kernel_density", KDE_SQL)
def q_kernel_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = SP.split(scored_portfolio(spark, sf_dir), "polref").filter(F.col("split") == "test")
    return rounded(CV.kernel_density(test, ["a", "np"]), ["g", "density"])


# --- coefficient tables derived from the one-way report (log model/own ratio) ---
def level_coefficients(df: DataFrame) -> DataFrame:
    """``(feature, level, weight = ln(sum np / sum a))`` per level (log of the one-way ModMul)."""
    ow = R.one_way(df, FEATURES, measures=["model", "own", "mod_mul"]).filter(F.col("value").isNotNull())
    return ow.select("feature", F.col("value").alias("level"), F.log("mod_mul").alias("weight"))


COEF_CTE = SCORED_CTE + ",\ncoef AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, ln(CAST(sum(np) AS DOUBLE) / sum(a)) AS weight "
    f"FROM scored WHERE {f} IS NOT NULL GROUP BY {f}" for f in FEATURES) + ")"


# --- F4: score every policy with a coefficient table (unseen level -> 0) ---
SCORE_SQL = with_standin(
    "SELECT s.polref, round(" + " + ".join(
        f"coalesce((SELECT weight FROM coef c WHERE c.feature = '{f}' AND c.level = CAST(s.{f} AS VARCHAR)), 0e0)"
        for f in FEATURES) + ", 5) + 0e0 AS pred FROM scored s", COEF_CTE)


@register("coefficient_score", SCORE_SQL)
def q_coefficient_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    coef = level_coefficients(s)
    return rounded(FT.score(s.select("polref", *FEATURES), coef, FEATURES).select("polref", "pred"),
                   ["pred"], 5)


# --- F5 + J7: multipliers attached to the one-way report ---
def _mult_sql() -> str:
    from .q_reports import _one_way_sql
    rep = _one_way_sql(["count", "model", "own"], "scored")
    return with_standin(f"""SELECT r.feature, r.value, r.count,
  round(exp(c.weight), 6) AS multiplier FROM ({rep}) r
LEFT JOIN coef c ON concat(c.feature, c.level) = concat(r.feature, coalesce(r.value, 'NA'))""", COEF_CTE)


@register("one_way_multipliers", _mult_sql())
def q_one_way_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    coef = FT.multipliers(level_coefficients(s)).select(
        "feature_level", F.log("multiplier").alias("weight"))
    rep = R.one_way(s, FEATURES, measures=["count", "model", "own"])
    out = J.with_multiplier(rep, coef).select("feature", "value", "count", "multiplier")
    return rounded(out, ["multiplier"])


# --- J8: full outer comparison of coefficient tables (train split vs all) ---
def _compare_sql() -> str:
    train_cte = ",\ncoef_tr AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS level, ln(CAST(sum(np) AS DOUBLE) / sum(a)) AS weight "
        f"FROM scored WHERE {f} IS NOT NULL AND NOT ({TEST_SPLIT}) GROUP BY {f}" for f in FEATURES) + ")"
    body = """SELECT coalesce(a.feature_level, b.feature_level) AS feature_level, round(a.weight_all, 6) AS weight_all,
  round(b.weight_train, 6) AS weight_train FROM
  (SELECT concat(feature, level) AS feature_level, weight AS weight_all FROM coef) a FULL OUTER JOIN
  (SELECT concat(feature, level) AS feature_level, weight AS weight_train FROM coef_tr) b ON a.feature_level = b.feature_level"""
    return with_standin(body, COEF_CTE + train_cte)


@register("coefficient_compare", _compare_sql())
def q_coefficient_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    tr = SP.split(s, "polref").filter(F.col("split") == "train")
    a = level_coefficients(s).select(paste0("feature", "level").alias("feature_level"), F.col("weight").alias("weight_all"))
    b = level_coefficients(tr).select(paste0("feature", "level").alias("feature_level"), F.col("weight").alias("weight_train"))
    return rounded(J.compare_coefficients(a, b, "feature_level"), ["weight_all", "weight_train"])


# --- M1 + W6: sparse one-hot design in long form with global column index ---
def _design_sql() -> str:
    from .q_reports import _feature_map_sql
    fm = _feature_map_sql()
    lv = fm[fm.index("lv AS ("):]
    lv_ctes = lv[:lv.index("\nSELECT l.feature")]
    longs = " UNION ALL ".join(f"SELECT polref, '{f}' AS feature, CAST({f} AS VARCHAR) AS level FROM scored WHERE {f} IS NOT NULL"
                               for f in FEATURES)
    body = f"""SELECT d.polref, d.feature, d.level, CAST(l.level - 1 + o."offset" AS BIGINT) AS col_index
FROM ({longs}) d JOIN lv l ON d.feature = l.feature AND d.level = l.value JOIN off o ON o.feature = d.feature"""
    return with_standin(body, SCORED_CTE + ",\n" + lv_ctes)


@register("design_matrix", _design_sql())
def q_design_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    lv = W.level_table(s, FEATURES)
    return FT.long_design(s, "polref", FEATURES, lv).withColumn("col_index", F.col("col_index").cast("long"))


# --- F1: additive fit of level weights under the tariff corridor objective ---
def tariff_fit(spark: SparkSession, sf_dir: str, rounds: int) -> DataFrame:
    s = with_acc(spark, sf_dir)
    model = FT.fit_additive(s, varying_feature_names(s, FEATURES), O.corridor_objective("t", "m", "acc"),
                            ["t", "m", "acc"], FitConfig(max_rounds=rounds, l2=1e-5))
    return model.coefficients(spark)


@register("additive_fit")
def q_additive_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff_fit(spark, sf_dir, 100)


def _fit_rounds_sql() -> str:
    """Five rounds for the bias and three for all levels, the last one after a step with momentum, written out."""
    w = CORRIDOR_TARIFF

    def gh(rows: str) -> str:
        su, so = lg("t - p", w.alpha_under), lg("p - acc", w.alpha_over)
        g, h = corridor_sql("p", "t", "acc", "m", w, "su", "so", "(1e0 - su - so)", "acc > t")
        return f"SELECT polref, {g} AS g, {h} AS h FROM (SELECT *, {su} AS su, {so} AS so FROM ({rows}))"

    texts = ", ".join(f"CAST({f} AS VARCHAR)" for f in FEATURES)
    ctes = [f"""tg AS MATERIALIZED (SELECT polref, t, m, acc FROM (SELECT polref, t, m,
  ln(CASE WHEN nm IS NOT NULL AND nt IS NOT NULL THEN greatest(nm - 100e0, nm * 0.992e0, nt) END) - 10.74e0 AS acc FROM scored))""",
            f"""lng AS MATERIALIZED (SELECT * FROM (SELECT polref, unnest({FEATURES!r}) AS feature, unnest([{texts}]) AS level FROM scored) WHERE level IS NOT NULL)""",
            "b0 AS (SELECT 0e0 AS b)"]
    for k in range(5):
        rows = f"SELECT tg.*, b AS p FROM tg, b{k}"
        ctes.append(f"b{k + 1} AS MATERIALIZED (SELECT any_value(b) - sum(g) / greatest(sum(h), 1e-9) AS b FROM ({gh(rows)}), b{k})")
    # x: weights after a round, y: where the next one starts; the bias is the level '' of '(bias)'
    ctes.append("""y0 AS MATERIALIZED (SELECT DISTINCT feature, level, 0e0 AS y, 0e0 AS x FROM lng
  UNION ALL SELECT '(bias)', '', b, b FROM b5),
every AS MATERIALIZED (SELECT * FROM lng UNION ALL SELECT polref, '(bias)', '' FROM tg)""")
    for k in range(3):
        rows = f"SELECT tg.*, p FROM tg JOIN (SELECT polref, sum(y) AS p FROM every JOIN y{k} USING (feature, level) GROUP BY polref) USING (polref)"
        momentum = {0: "0e0", 1: "CASE WHEN dot > 0 THEN 0e0 ELSE (t1 - 1e0) / ((1e0 + sqrt(1e0 + 4e0 * t1 * t1)) / 2e0) END", 2: "0e0"}[k]
        l2 = "CASE WHEN feature = '(bias)' THEN 0e0 ELSE 1e-5 END"
        ctes.append(f"""n{k} AS MATERIALIZED (SELECT feature, level, x, G + {l2} * y AS grad, y - (1e0 / 8) * (G + {l2} * y) / (greatest(H, 1e-9) + {l2}) AS new
  FROM y{k} JOIN (SELECT feature, level, sum(g) AS G, sum(h) AS H FROM every JOIN ({gh(rows)}) USING (polref) GROUP BY 1, 2) USING (feature, level)),
y{k + 1} AS MATERIALIZED (SELECT feature, level, new + {momentum} * (new - x) AS y, new AS x
  FROM n{k}, (SELECT sum(grad * (new - x)) AS dot, (1e0 + sqrt(5e0)) / 2e0 AS t1 FROM n{k}))""")
    return with_standin("SELECT feature, level, round(x, 6) + 0e0 AS weight FROM y3", SCORED_CTE + ",\n" + ",\n".join(ctes))


@register("additive_fit_rounds", _fit_rounds_sql())
def q_additive_fit_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tariff_fit(spark, sf_dir, 8).withColumn("weight", F.round("weight", 6) + F.lit(0.0))


# --- S6 + S1 (+S3): decimal-comma CSV round trip of the fit input ---
@register("csv_roundtrip", with_standin("SELECT * FROM rated WHERE pp IS NOT NULL", lookup_ctes()))
def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files as FL
    from . import input_build as IB
    df = IB.fit_input_columns(spark, sf_dir)
    path = FL.scratch_path(spark, "fit-input-csv")
    FL.write_decimal_comma(df, path)
    return FL.read_decimal_comma(spark, path, df.schema)


# --- S7 + F5: coefficient table persisted as Parquet, read back as multipliers ---
@register("coefficient_io", with_standin(
    "SELECT concat(feature, level) AS feature_level, feature, level, round(exp(weight), 6) AS multiplier FROM coef",
    COEF_CTE))
def q_coefficient_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files as FL
    path = FL.scratch_path(spark, "coefficients")
    FT.save_coefficients(level_coefficients(scored_portfolio(spark, sf_dir)), path)
    return rounded(FT.multipliers(FT.load_coefficients(spark, path)), ["multiplier"])


# --- A23: distribution summary of the prices, exact quartiles ---
@register("price_summary", with_standin("""
SELECT "column", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS min, quantile_cont(x, 0.25) AS q1,
  quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3, max(x) AS max
FROM (SELECT unnest(['a', 'nm', 'nt', 'np']) AS "column", unnest([CAST(a AS DOUBLE), nm, nt, np]) AS x FROM scored) GROUP BY 1""", SCORED_CTE))
def q_price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import summary
    return rounded(summary(scored_portfolio(spark, sf_dir), ["a", "nm", "nt", "np"]), ["mean", "sd"])


def sim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simulated-quote view: A label, T log margin, V price gap, three rating features."""
    pol = SI.policy_view(spark, sf_dir)
    return pol.select(
        "polref", F.col("claim").isNotNull().cast("double").alias("A"),
        (F.log("nm") - F.log("nt")).alias("T"), ((F.col("np") - F.col("nm")) / 1e4).alias("V"),
        F.col("kw").cast("double").alias("VehPower"), (F.col("polref") % 20).cast("double").alias("VehAge"),
        F.col("clientage").cast("double").alias("DrivAge"))


SIM_FEATURES = ["VehPower", "VehAge", "DrivAge"]
REFERENCE_TREES = TreeConfig(rounds=500, max_depth=3, eta=0.1)


def reference_trees(spark: SparkSession, sf_dir: str, cfg: TreeConfig):
    """weights V shifted on the training rows only (P32), base margin T, held-out stop after 50 rounds."""
    from ..functions.scalar import fill_features
    from ..operators import trees as TR
    # the least weight, the cuts, the training and the held-out rows each read these rows: joined once
    d = cut_lineage(fill_features(SP.split(sim_quotes(spark, sf_dir), "polref", 0.8, seed=123), SIM_FEATURES))
    train = MT.shift_positive(d.filter(F.col("split") == "train"), "V")
    return TR.fit_reference_trees(train, d.filter(F.col("split") == "test"), SIM_FEATURES, "A", "V", "T", cfg, patience=50)


# --- M2, P32, F3, F6 (rows only): squared-error trees with weights, base margin and a held-out stop; mean gains ---
@register("tree_importance")
def q_tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_trees(spark, sf_dir, REFERENCE_TREES).importance(spark)


def _tree_sql(rows: str, features: list[str], eta: float, ctes: str, lam: str = "1e0") -> str:
    """First tree of depth 2 over rows (g, h, features), every value a cut; its splits and leaves."""
    longs = " UNION ALL ".join(f"SELECT 0 AS node, {i} AS f, CAST({c} AS DOUBLE) AS x, g, h FROM rws" for i, c in enumerate(features))
    score = f"(G * G / (H + {lam}))"

    def best(k: int) -> str:
        """The best split of each node of level k from its sums by value."""
        return f"""
vals{k} AS MATERIALIZED (SELECT node, f, x, sum(g) AS G, sum(h) AS H FROM long{k} GROUP BY ALL),
tot{k} AS MATERIALIZED (SELECT node, sum(g) AS G, sum(h) AS H FROM long{k} WHERE f = 0 GROUP BY node),
cand{k} AS (SELECT t.node, c.f, c.x AS cut, sum(CASE WHEN v.x < c.x THEN v.G ELSE 0e0 END) AS GL, sum(CASE WHEN v.x < c.x THEN v.H ELSE 0e0 END) AS HL,
  any_value(t.G) AS G, any_value(t.H) AS H
  FROM tot{k} t JOIN cuts c ON true JOIN vals{k} v ON v.node = t.node AND v.f = c.f GROUP BY t.node, c.f, c.x),
best{k} AS MATERIALIZED (SELECT node, f, cut, gain FROM (
  SELECT *, GL * GL / (HL + {lam}) + (G - GL) * (G - GL) / (H - HL + {lam}) - {score} AS gain FROM cand{k} WHERE HL >= 1 AND H - HL >= 1)
  WHERE gain > 1e-12 QUALIFY row_number() OVER (PARTITION BY node ORDER BY round(gain, 6) DESC, f, cut) = 1)"""

    def down(k: int) -> str:
        """The rows of the split nodes, in their children."""
        side = " ".join(f"WHEN f = {i} THEN CAST({c} AS DOUBLE)" for i, c in enumerate(features))
        return f"""
rws{k + 1} AS MATERIALIZED (SELECT r.* REPLACE (2 * r.node + (CASE WHEN (CASE {side} END) < cut THEN 1 ELSE 2 END) AS node) FROM rws{k} r JOIN best{k} b USING (node))"""

    per = lambda k: " UNION ALL ".join(f"SELECT node, {i} AS f, CAST({c} AS DOUBLE) AS x, g, h FROM rws{k}" for i, c in enumerate(features))
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(features))
    return with_standin(f"""
SELECT node, CASE f {names} END AS feature, cut, round(gain, 3) AS gain, CAST(NULL AS DOUBLE) AS value FROM (SELECT * FROM best0 UNION ALL SELECT * FROM best1)
UNION ALL SELECT node, NULL, NULL, NULL, round({-eta!r} * G / (H + {lam}), 6) + 0e0 FROM (
  SELECT node, sum(g) AS G, sum(h) AS H FROM (SELECT node, g, h FROM rws2
    UNION ALL SELECT node, g, h FROM rws1 WHERE node NOT IN (SELECT node FROM best1)
    UNION ALL SELECT node, g, h FROM rws0 WHERE node NOT IN (SELECT node FROM best0)) GROUP BY node)""", f"""{ctes},
rws0 AS MATERIALIZED (SELECT CAST(0 AS INTEGER) AS node, * FROM ({rows})),
cuts AS MATERIALIZED (SELECT f, x FROM (SELECT DISTINCT f, x FROM ({per(0)})) QUALIFY row_number() OVER (PARTITION BY f ORDER BY x) > 1),
long0 AS MATERIALIZED ({per(0)}),{best(0)},{down(0)},
long1 AS MATERIALIZED ({per(1)}),{best(1)},{down(1)}""")


def first_tree(model, spark: SparkSession) -> DataFrame:
    nodes = model.nodes(spark).filter(F.col("tree") == 0).select("node", "feature", "cut", "gain", "value")
    return rounded(rounded(nodes, ["gain"], 3), ["value"]).withColumn("value", F.col("value") + F.lit(0.0))


# --- F3, F6: the first tree of the squared-error booster, written out ---
@register("reference_tree", _tree_sql(
    "SELECT V * (T - A) AS g, V AS h, VehPower, VehAge, DrivAge FROM (SELECT *, vv + abs((SELECT min(vv) FROM sim WHERE split = 'train')) + 1e-6 AS V FROM sim WHERE split = 'train')",
    SIM_FEATURES, 0.1, f"""
sim AS (SELECT CAST(claim IS NOT NULL AS DOUBLE) AS A, ln(nm) - ln(nt) AS T, CAST(np - nm AS DOUBLE) / 1e4 AS vv,
  coalesce(CAST(kw AS DOUBLE), -999e0) AS VehPower, CAST(polref % 20 AS DOUBLE) AS VehAge, coalesce(CAST(clientage AS DOUBLE), -999e0) AS DrivAge,
  CASE WHEN {TEST_SPLIT.replace('1234', '123')} THEN 'test' ELSE 'train' END AS split FROM priced)"""))
def q_reference_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_tree(reference_trees(spark, sf_dir, replace(REFERENCE_TREES, rounds=1, max_depth=2)), spark)


# --- M2: numeric matrix with its label ---
@register("numeric_matrix", with_standin("""SELECT polref, CAST(label AS INTEGER) AS label, CAST(kw AS DOUBLE) AS x0, CAST(clientage AS DOUBLE) AS x1, CAST(zip AS DOUBLE) AS x2
FROM cbase""", CLASSIFIER_CTES))
def q_numeric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    from ..functions.scalar import fill_marker, require_all_except
    cols = ["kw", "clientage", "zip"]
    pol = SI.policy_view(spark, sf_dir).select("polref", F.col("claim").isNotNull().cast("int").alias("has_claim"), *cols, "nm")
    pol = require_all_except(fill_marker(pol, ["kw"]), [*cols, "nm"], exempt=["kw"])
    matrix = FT.assemble(pol, cols, "has_claim").withColumn("x", vector_to_array("features"))
    return matrix.select("polref", "label", *[F.col("x")[i].alias(f"x{i}") for i in range(len(cols))])


# --- F2: the first tree under the profit objective, written out, and the comparison with a baseline ---
@register("claim_tree", _tree_sql(
    "SELECT typ * (mk * 0.25e0 - label * 0.5e0) AS g, typ * (label * 0.25e0) AS h, kw, clientage, zip FROM scal", ["kw", "clientage", "zip"], 0.05,
    CLASSIFIER_CTES + """,
scal AS (SELECT s.*, nm / (SELECT med FROM med) AS mk,
  exp(-0.5e0 * sqrt(pow((kw - st.mu_kw) / st.sd_kw, 2) + pow((clientage - st.mu_age) / st.sd_age, 2) + pow((zip - st.mu_zip) / st.sd_zip, 2))) AS typ
  FROM strat s, st WHERE split = 'train')"""))
def q_claim_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .claim_model import classifier_frame, custom_trees
    train = classifier_frame(spark, sf_dir).filter(F.col("split") == "train")
    return first_tree(custom_trees(train, TreeConfig(rounds=1, max_depth=2)), spark)


@register("claim_models")
def q_claim_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log loss and AUC on the test split: trees under the profit objective beside the plain baseline, the reference's hundred trees each."""
    from .claim_model import compare_models
    return compare_models(spark, sf_dir, TreeConfig(rounds=100), baseline_iter=100)


# --- S7: a tree model stored and read back gives the same prices ---
@register("tree_io", with_standin("SELECT polref, CAST(true AS BOOLEAN) AS same FROM priced WHERE clientage IS NOT NULL AND nm IS NOT NULL"))
def q_tree_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import trees as TR
    from ..sources import files as FL
    from .claim_model import classifier_frame, custom_trees
    d = classifier_frame(spark, sf_dir)
    model = custom_trees(d, TreeConfig(rounds=2, max_depth=3))
    path = FL.scratch_path(spark, "trees")
    TR.save_trees(model, spark, path)
    both = TR.load_trees(spark, path).predict(model.predict(d, "pred"), "again")
    return both.select("polref", (F.col("pred") == F.col("again")).alias("same"))


# --- A1 as a Structured Streaming job over arriving claim files ---
@register("claims_stream", with_standin("SELECT polref, CAST(claim AS BIGINT) AS claim FROM clm"))
def q_claims_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import files as FL
    from ..streaming.claims import claims_stream, publish_available
    src = FL.scratch_path(spark, "claim-files")
    snap = SI.claim_snapshot(spark, sf_dir)
    snap.repartition(4).write.mode("overwrite").parquet(src)  # four files -> four micro-batches
    out, ckpt = FL.scratch_path(spark, "claims-out"), FL.scratch_path(spark, "claims-ckpt")
    publish_available(claims_stream(spark, src, snap.schema, "F", files_per_batch=1), out, ckpt)
    return spark.read.parquet(out)


# --- S3 + A1: plain CSV claim snapshot read back with an explicit schema ---
@register("claims_from_csv", with_standin("SELECT polref, CAST(claim AS BIGINT) AS claim FROM clm"))
def q_claims_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import claims_by_policy
    from ..sources import files as FL
    snap = SI.claim_snapshot(spark, sf_dir)
    path = FL.scratch_path(spark, "claims-csv")
    snap.write.mode("overwrite").csv(path, header=True)
    return claims_by_policy(FL.read_csv(spark, path, snap.schema), "F")
