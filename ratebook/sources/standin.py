"""Stand-in pricing tables derived from the driver's TPC-H-like parquet.

The original scripts read a policy feed, a claim snapshot, earned premium and
competitor prices that are not public.  ``FIXTURES.md`` defines a stand-in
view over ``orders``/``customer``/``lineitem``/``nation`` so that every
operator runs on tables that grow with the scale factor.  This module builds
the same view twice: as a Spark plan (what the library runs) and as SQL text
(what the DuckDB oracle runs).  Money is floored to BIGINT in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# cut-off for the earned-premium period of the stand-in
EARNED_SINCE = "1996-01-01 00:00:00"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _floor_big(c: Column) -> Column:
    return F.floor(c).cast("bigint")


def claim_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim movements per policy: snapshot key ``sysdate`` = line status.

    Only returned items are claims.  Columns follow the original snapshot:
    matured, reserve, paid, recovery reserve, recovery paid.
    """
    li = read_table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return li.select(
        F.col("l_orderkey").alias("polnum"),
        F.col("l_linestatus").alias("sysdate"),
        _floor_big(F.col("l_extendedprice") * F.col("l_discount")).alias("clmmat"),
        _floor_big(F.col("l_extendedprice") * F.col("l_tax")).alias("clmres"),
        F.lit(0).cast("bigint").alias("clmpay"),
        _floor_big(F.col("l_quantity")).alias("regres"),
        F.lit(0).cast("bigint").alias("regpay"),
    )


def earned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earned premium rows: ``polref``, period timestamp, ``earned`` (BIGINT)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("polref"),
        F.col("l_shipdate").alias("period"),
        _floor_big(F.col("l_extendedprice") * F.lit(1e-1)).alias("earned"),
    )


def _claims_and_earned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim total and earned premium per order in ONE lineitem scan/shuffle.

    Same result as aggregating the two stand-in tables separately and
    left-joining both: a conditional sum over no matching rows is null,
    exactly like a missing right row.
    """
    li = read_table(spark, sf_dir, "lineitem")
    is_claim = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
    is_earned = F.col("l_shipdate") >= F.lit(EARNED_SINCE).cast("timestamp")
    claim_v = (_floor_big(F.col("l_extendedprice") * F.col("l_discount"))
               + _floor_big(F.col("l_extendedprice") * F.col("l_tax"))
               - _floor_big(F.col("l_quantity")))
    earned_v = _floor_big(F.col("l_extendedprice") * F.lit(1e-1))
    return (
        li.filter(is_claim | is_earned)
        .groupBy(F.col("l_orderkey").alias("polref"))
        .agg(F.sum(F.when(is_claim, claim_v)).alias("claim"),
             F.sum(F.when(is_earned, earned_v)).alias("earned"))
    )


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("o_orderkey")
    b16 = k % 16
    bonus = (
        F.when(b16 < 4, F.concat(F.lit("M0"), (F.lit(4) - b16).cast("string")))
        .when(b16 == 4, F.lit("A00"))
        .when(b16 < 14, F.concat(F.lit("B0"), (b16 - 4).cast("string")))
        .when(b16 == 14, F.lit("B10"))
        .otherwise(F.lit("X"))
    )

    def comp(base: float, lvl: float, mult: int, add: int = 0) -> Column:
        return _floor_big(F.lit(base) + F.col("o_totalprice")
                          * (F.lit(lvl) + ((k * mult + add) % 40) * F.lit(5e-3)))

    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        k.alias("polref"),
        F.col("c_nationkey").cast("int").alias("zip"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(20 + (k * 7) % 131).alias("kw"),
        F.when(F.col("o_custkey") % 23 == 0, F.lit(None))
        .otherwise(18 + (F.col("o_custkey") * 13) % 70).alias("clientage"),
        bonus.alias("bonus_malus_current"),
        F.col("c_mktsegment").alias("f_segment"),
        F.col("o_orderpriority").alias("f_priority"),
        F.col("o_orderstatus").alias("f_status"),
        F.col("o_orderdate").alias("policy_start_date"),
        _floor_big(F.lit(4e4) + F.col("o_totalprice") * F.lit(1e-1)).alias("policy_premium"),
        comp(2.0e4, 1.0e-1, 11).alias("price_c1"),
        F.when(k % 5 == 0, F.lit(None).cast("bigint")).otherwise(comp(2.2e4, 1.0e-1, 13)).alias("price_c2"),
        F.when(k % 7 == 0, F.lit(None).cast("bigint")).otherwise(comp(1.8e4, 1.2e-1, 17)).alias("price_c3"),
        comp(1.5e4, 0.9e-1, 19, 3).alias("a"),
    )


def policy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priced stand-in policy table (one row per order, ``polref`` unique)."""
    b = _base(spark, sf_dir)
    agg = _claims_and_earned(spark, sf_dir)
    nt = _floor_big(
        F.lit(6.4e4) * (F.lit(5e-1) + F.lit(2e-2) * F.col("zip"))
        * F.when(F.coalesce("kw", F.lit(51)) < 51, F.lit(1e0)).otherwise(F.lit(1.5e0))
        * F.when(F.coalesce("clientage", F.lit(46)) < 26, F.lit(1e0)).otherwise(F.lit(6e-1))
        * F.when(F.col("bonus_malus_current").like("M%"), F.lit(1.8e0)).otherwise(F.lit(7e-1))
    )
    return (
        b.join(agg, "polref", "left")
        .withColumns({
            "nm": F.least("price_c1", "price_c2", "price_c3"),
            "nt": nt,
            "np": _floor_big(F.col("a") * (F.lit(8.5e-1) + (F.col("polref") % 7) * F.lit(5e-2))),
        })
    )


def zip_multiplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("zip"),
                    (F.lit(0.5) + F.lit(0.02) * F.col("n_nationkey")).alias("poli"))


def policy_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class ids ``ujcid``/``ujclass`` 1..12, null for the unclassified."""
    o = read_table(spark, sf_dir, "orders")
    r = F.col("o_orderkey") % 13
    return o.select(F.col("o_orderkey").alias("ujcid"),
                    F.when(r == 0, F.lit(None)).otherwise(r).cast("int").alias("ujclass"))


def external_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Externally fitted premiums; finished orders only, so some policies lack one."""
    o = read_table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") != "O")
    return o.select(F.col("o_orderkey").alias("polref"),
                    _floor_big(F.lit(2.5e4) + F.col("o_totalprice") * F.lit(1.1e-1)).alias("premium"))


def zip_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and exposure per territory (nation) from the policy view."""
    pol = policy_view(spark, sf_dir)
    return pol.groupBy("zip").agg(
        F.count(F.col("claim")).cast("bigint").alias("claims"),
        F.count(F.lit(1)).cast("bigint").alias("exposure"))


def travel_hours(i: Column, p: Column) -> Column:
    """Travel time between two territories: ``abs(i - p) * 0.25`` hours."""
    return F.abs(i - p) * F.lit(0.25)


# ---------------------------------------------------------------------------
# The same stand-in as SQL text for the DuckDB oracle.
STANDIN_CTES = """
clm AS (
  SELECT l_orderkey AS polref,
         sum(CAST(floor(l_extendedprice * l_discount) AS BIGINT)
           + CAST(floor(l_extendedprice * l_tax) AS BIGINT)
           - CAST(floor(l_quantity) AS BIGINT)) AS claim
  FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'R' GROUP BY l_orderkey),
ern AS (
  SELECT l_orderkey AS polref, sum(CAST(floor(l_extendedprice * 1e-1) AS BIGINT)) AS earned
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY l_orderkey),
base AS (
  SELECT o.o_orderkey AS polref,
    CAST(c.c_nationkey AS INT) AS zip,
    CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE 20 + (o.o_orderkey * 7) % 131 END AS kw,
    CASE WHEN o.o_custkey % 23 = 0 THEN NULL ELSE 18 + (o.o_custkey * 13) % 70 END AS clientage,
    CASE WHEN o.o_orderkey % 16 < 4 THEN concat('M0', CAST(4 - o.o_orderkey % 16 AS VARCHAR))
         WHEN o.o_orderkey % 16 = 4 THEN 'A00'
         WHEN o.o_orderkey % 16 < 14 THEN concat('B0', CAST(o.o_orderkey % 16 - 4 AS VARCHAR))
         WHEN o.o_orderkey % 16 = 14 THEN 'B10' ELSE 'X' END AS bonus_malus_current,
    c.c_mktsegment AS f_segment, o.o_orderpriority AS f_priority, o.o_orderstatus AS f_status,
    o.o_orderdate AS policy_start_date,
    CAST(floor(4e4 + o.o_totalprice * 1e-1) AS BIGINT) AS policy_premium,
    CAST(floor(2.0e4 + o.o_totalprice * (1.0e-1 + ((o.o_orderkey * 11) % 40) * 5e-3)) AS BIGINT) AS price_c1,
    CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE
      CAST(floor(2.2e4 + o.o_totalprice * (1.0e-1 + ((o.o_orderkey * 13) % 40) * 5e-3)) AS BIGINT) END AS price_c2,
    CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE
      CAST(floor(1.8e4 + o.o_totalprice * (1.2e-1 + ((o.o_orderkey * 17) % 40) * 5e-3)) AS BIGINT) END AS price_c3,
    CAST(floor(1.5e4 + o.o_totalprice * (0.9e-1 + ((o.o_orderkey * 19 + 3) % 40) * 5e-3)) AS BIGINT) AS a
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
priced AS (
  SELECT b.*, clm.claim, ern.earned,
    least(price_c1, price_c2, price_c3) AS nm,
    CAST(floor(6.4e4 * (5e-1 + 2e-2 * zip)
      * CASE WHEN coalesce(kw, 51) < 51 THEN 1e0 ELSE 1.5e0 END
      * CASE WHEN coalesce(clientage, 46) < 26 THEN 1e0 ELSE 6e-1 END
      * CASE WHEN bonus_malus_current LIKE 'M%' THEN 1.8e0 ELSE 7e-1 END) AS BIGINT) AS nt,
    CAST(floor(a * (8.5e-1 + (b.polref % 7) * 5e-2)) AS BIGINT) AS np
  FROM base b LEFT JOIN clm ON b.polref = clm.polref LEFT JOIN ern ON b.polref = ern.polref)"""


def with_standin(select_sql: str, extra_ctes: str = "") -> str:
    """Prefix a SELECT (reading ``priced``) with the stand-in CTEs."""
    ctes = STANDIN_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{select_sql}"
