"""Registered queries: one-way, segment and split reports, windows and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import ascii_name
from ..operators import aggregates as AG
from ..operators import reports as R
from ..operators import sampling as SP
from ..operators import windows as W
from ..sources.standin import with_standin
from . import sqltext as S
from .catalog import _round2, register, rounded
from .q_build import SCORED_CTE, UNFILLED_CTE
from .scored import FEATURES, scored_portfolio

TEST_SPLIT = "((polref % 1000003) * 48271 + 1234) % 1000003 >= 800002"


def _one_way_sql(names: list[str], source: str) -> str:
    parts = [f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value,\n  {S.measures_sql(names)}\n"
             f"FROM {source} GROUP BY {f}" for f in FEATURES]
    return "\nUNION ALL\n".join(parts)


# --- A3 + U2: one-way report of every feature x level ---
@register("one_way", with_standin(_one_way_sql(R.ONE_WAY_MEASURES, "scored"), SCORED_CTE))
def q_one_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.one_way(scored_portfolio(spark, sf_dir), FEATURES)


# --- M3 + A4 + A5 + W3: one-way with claims on the test split, claim-ratio change ---
def _one_way_claims_sql() -> str:
    inner = _one_way_sql(R.ONE_WAY_CLAIM_MEASURES, "testset")
    ctes = UNFILLED_CTE + f",\ntestset AS (SELECT * FROM scored WHERE {TEST_SPLIT}),\nrep AS ({inner}),\n" + """
imp AS (SELECT *, CAST(model_claim AS DOUBLE) / own_claim * own / model AS x FROM rep),
imp2 AS (SELECT * EXCLUDE (x), CASE WHEN x IS NULL OR isnan(x) THEN 1e0 ELSE least(2e0, greatest(0e0, x)) END AS improve FROM imp)"""
    body = """SELECT *, round(count * (max(improve) OVER (PARTITION BY feature) / max(count) OVER (PARTITION BY feature)), 6) AS count_scaled
FROM imp2"""
    return with_standin(body, ctes)


@register("one_way_claims", _one_way_claims_sql())
def q_one_way_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = SP.split(scored_portfolio(spark, sf_dir, fill=False), "polref").filter(F.col("split") == "test")
    rep = R.one_way_claims(test, FEATURES)
    return rounded(W.axis_scaled(rep, "improve"), ["count_scaled"])


# --- A6 + W2 + W4 + P31: market against normalised claims, levels in plot order ---
def _one_way_base_sql() -> str:
    inner = _one_way_sql(R.ONE_WAY_BASE_MEASURES, "scored")
    body = """SELECT *,
  row_number() OVER (PARTITION BY feature ORDER BY TRY_CAST(value AS DOUBLE) IS NULL,
                     TRY_CAST(value AS DOUBLE), value) AS level_order,
  round(actual_claim * (CAST(sum(market) OVER (PARTITION BY feature) AS DOUBLE) / sum(actual_claim) OVER (PARTITION BY feature)), 4) AS actual_claim_scaled
FROM rep"""
    return with_standin(body, UNFILLED_CTE + f",\nrep AS ({inner})")


@register("one_way_base", _one_way_base_sql())
def q_one_way_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rep = R.one_way_base(scored_portfolio(spark, sf_dir, fill=False), FEATURES)
    rep = W.normalised_claims(W.ordered_levels(rep))
    return rounded(rep, ["actual_claim_scaled"], 4)


# --- A8: segment report of a sub-portfolio (one client age) ---
def _segment_sub_sql() -> str:
    from .catalog import _SEG_DEFS, _zero_fill
    return with_standin(f"""
SELECT d.segment, d.own_flag, d.model_flag, d.label,
  {_zero_fill(R.MEASURES_FULL)}
FROM {_SEG_DEFS} d(segment, own_flag, model_flag, label)
LEFT JOIN (
  SELECT {S.SEGMENT_CASE} AS segment,
  {S.measures_sql(R.MEASURES_FULL)}
  FROM priced WHERE clientage = 19 AND nt IS NOT NULL AND nm IS NOT NULL AND earned IS NOT NULL GROUP BY 1) g ON d.segment = g.segment""")


@register("segment_report_age19", _segment_sub_sql())
def q_segment_report_age19(spark: SparkSession, sf_dir: str) -> DataFrame:
    sub = scored_portfolio(spark, sf_dir).filter(F.col("clientage") == 19)
    return _round2(R.segment_report(sub), ["own_earn", "model_earn"])


# --- A16 + Q12: outcome counts and unassigned ties ---
@register("outcome_counts", with_standin("""SELECT
  CAST(count_if(m > t AND m <= p) AS BIGINT) AS lost, CAST(count_if(m > t AND m > p) AS BIGINT) AS won,
  CAST(count_if(m < t AND m <= p) AS BIGINT) AS avoided, CAST(count_if(m < t AND m > p) AS BIGINT) AS swallowed,
  CAST(count_if(nm = nt) AS BIGINT) AS ties
FROM scored""", SCORED_CTE))
def q_outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.outcome_counts(scored_portfolio(spark, sf_dir))


# --- A11 + U3: levels per feature, varying features ---
def _levels_sql() -> str:
    parts = [f"SELECT '{f}' AS feature, CAST(count(DISTINCT {f}) + max(CAST({f} IS NULL AS INTEGER)) AS BIGINT) AS levels FROM scored"
             for f in FEATURES]
    return with_standin("SELECT feature, levels, levels > 1 AS varies FROM (" + " UNION ALL ".join(parts) + ")",
                        SCORED_CTE)


@register("varying_features", _levels_sql())
def q_varying_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.varying_features(scored_portfolio(spark, sf_dir), FEATURES)


# --- W7: most frequent level per feature ---
def _baseline_sql() -> str:
    parts = [f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, count(*) AS n FROM scored GROUP BY {f}"
             for f in FEATURES]
    body = """SELECT feature, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value ASC NULLS LAST) AS r FROM c) WHERE r = 1"""
    return with_standin(body, SCORED_CTE + ",\nc AS (" + " UNION ALL ".join(parts) + ")")


@register("baseline_levels", _baseline_sql())
def q_baseline_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.baseline_level(scored_portfolio(spark, sf_dir), FEATURES)


# --- M3 + A13: split counts ---
@register("split_counts", with_standin(f"""SELECT CASE WHEN {TEST_SPLIT} THEN 'test' ELSE 'train' END AS split,
  CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY 1""", SCORED_CTE))
def q_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AG.split_counts(SP.split(scored_portfolio(spark, sf_dir), "polref"))


# --- M4: exact stratified split by claim label ---
STRAT_SQL = with_standin("""
SELECT label, CASE WHEN r <= floor(n * 0.8e0) THEN 'train' ELSE 'test' END AS split, CAST(count(*) AS BIGINT) AS n
FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY h, polref) AS r, count(*) OVER (PARTITION BY label) AS n
      FROM (SELECT polref, CAST(claim IS NOT NULL AS INTEGER) AS label, ((polref % 1000003) * 48271 + 42) % 1000003 AS h FROM scored))
GROUP BY 1, 2""", SCORED_CTE)


@register("stratified_split", STRAT_SQL)
def q_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored_portfolio(spark, sf_dir).select("polref", F.col("claim").isNotNull().cast("int").alias("label"))
    st = SP.stratified_split(s, "polref", "label", 0.8, seed=42)
    return st.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


# --- W1 + P14 + U2: distribution curves of profit- and loss-making quotes ---
def _curves_sql(points: int | None) -> str:
    long = " UNION ALL ".join(
        f"SELECT part, polref, '{s}' AS series, CAST({s} AS DOUBLE) AS value FROM parts WHERE {s} IS NOT NULL"
        for s in ["nt", "nm", "np", "a"])
    ctes = SCORED_CTE + f""",
parts AS (SELECT *, CASE WHEN m > t THEN 'profit' WHEN m <= t THEN 'loss' END AS part FROM scored WHERE m > t OR m <= t),
lng AS ({long}),
ranked AS (SELECT part, series, value, row_number() OVER (PARTITION BY part, series ORDER BY value, polref) AS r,
  count(*) OVER (PARTITION BY part, series) AS n FROM lng),
sizes AS (SELECT part, series, max(n) AS n, max(max(n)) OVER (PARTITION BY part) AS L FROM ranked GROUP BY part, series)"""
    if points is None:
        body = """SELECT k.part, CAST(k.r + g.k * k.n AS BIGINT) AS idx, k.series, k.value
FROM (SELECT r.*, s.L FROM ranked r JOIN sizes s USING (part, series)) k,
  LATERAL (SELECT unnest(generate_series(0, CAST(floor((k.L - k.r) / k.n) AS BIGINT))) AS k) g"""
    else:
        body = f"""SELECT w.part, w.idx, w.series, r.value FROM (
  SELECT part, series, idx, ((idx - 1) % n) + 1 AS rk FROM (
    SELECT part, series, n, CAST(round(1e0 + j * (1e0 * (L - 1) / {max(points - 1, 1)})) AS BIGINT) AS idx
    FROM sizes, (SELECT unnest(generate_series(0, {points - 1})) AS j))) w
JOIN ranked r ON r.part = w.part AND r.series = w.series AND r.r = w.rk"""
    return with_standin(body, ctes)


def _curves(spark: SparkSession, sf_dir: str, points: int | None) -> DataFrame:
    s = scored_portfolio(spark, sf_dir)
    # profit-making (m > t) and loss-making (m <= t) quotes; unknown comparisons drop out
    part = F.when(F.col("m") > F.col("t"), "profit").when(F.col("m") <= F.col("t"), "loss")
    s = s.withColumn("part", part).filter(F.col("part").isNotNull())
    return W.sorted_curves(s, ["nt", "nm", "np", "a"], "polref", points, by=["part"])


@register("distribution_curves", _curves_sql(None))
def q_distribution_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir, None)


@register("distribution_grid", _curves_sql(101))
def q_distribution_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _curves(spark, sf_dir, 101)


# --- W6 + S8 + P29: level index and feature map (index from 0, name, 'i') ---
def _feature_map_sql() -> str:
    num = {"zip", "kw", "clientage"}
    parts = []
    for f in FEATURES:
        n = f"CAST({f} AS DOUBLE)" if f in num else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT DISTINCT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, {n} AS num FROM scored WHERE {f} IS NOT NULL")
    pos = " UNION ALL ".join(f"SELECT '{f}' AS feature, {i} AS f_pos" for i, f in enumerate(FEATURES))
    ctes = SCORED_CTE + f""",
lv AS (SELECT feature, value, CAST(row_number() OVER (PARTITION BY feature ORDER BY num, value) + 1 AS INTEGER) AS level
       FROM ({' UNION ALL '.join(parts)})
       UNION ALL SELECT feature, ' ' AS value, CAST(1 AS INTEGER) AS level FROM ({pos})),
fp AS ({pos}),
sz AS (SELECT l.feature, count(*) AS n_levels, fp.f_pos FROM lv l JOIN fp USING (feature) GROUP BY l.feature, fp.f_pos),
off AS (SELECT feature, coalesce(sum(n_levels) OVER (ORDER BY f_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM sz)"""
    tr = "translate(concat(l.feature, l.value), ' -óöőúüűáéí', '__ooouuuaei')"
    body = f"""SELECT l.feature, l.value, l.level, CAST(l.level - 1 + o."offset" AS BIGINT) AS col_index,
  {tr} AS name, 'i' AS kind
FROM lv l JOIN off o USING (feature)"""
    return with_standin(body, ctes)


def feature_map(levels: DataFrame) -> DataFrame:
    """Feature map rows ``(col_index, name, 'i')`` with transliterated names."""
    return levels.withColumns({"name": ascii_name(F.concat("feature", "value")), "kind": F.lit("i")})


@register("feature_map", _feature_map_sql())
def q_feature_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as a tab-separated file and read back."""
    from ..sources import files as FL
    lv = W.level_table(scored_portfolio(spark, sf_dir), FEATURES)
    table = feature_map(lv).withColumn("col_index", F.col("col_index").cast("long"))
    path = FL.scratch_path(spark, "feature-map")
    # a blank level is text too: nothing is trimmed on the way
    keep = {"sep": "\t", "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    table.write.csv(path, **keep)
    return spark.read.csv(path, schema=table.schema, **keep)


# --- U1: reports appended by column name ---
def _union_sql() -> str:
    from .catalog import SEGMENT_SQL
    from .q_build import _class_sql
    seg = SEGMENT_SQL.split("\nSELECT d.segment", 1)
    cls = _class_sql()
    return (f"SELECT * FROM ({SEGMENT_SQL}) UNION ALL BY NAME SELECT * FROM ({cls})")


@register("report_union", _union_sql())
def q_report_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .catalog import q_segment_report
    from .q_build import q_class_report
    return W.union_reports([q_segment_report(spark, sf_dir), q_class_report(spark, sf_dir)])
