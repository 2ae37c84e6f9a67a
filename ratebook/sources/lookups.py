"""Inline rating-factor lookup tables.

Fixed values: frequency and severity factors by kW band, age band and bonus
class, exactly as in the original rating script.  Each table has a proven
size bound (5, 12 and 16 rows), so joins to them may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: kW band, frequency factor, severity factor
KW_FACTORS = [
    ("[0,38)", 1.0, 1.0),
    ("[38,51)", 1.38888012, 1.026556984),
    ("[51,71)", 1.473136845, 1.142958421),
    ("[71,101)", 1.516762341, 1.165422581),
    ("[101,Inf]", 1.404669543, 1.328707779),
]

# fixed values: age band, frequency factor, severity factor (first band has none)
AGE_FACTORS = [
    ("[-1,0)", None, None),
    ("[0,26)", 1.0, 1.0),
    ("[26,31)", 0.739909506, 0.918823181),
    ("[31,36)", 0.67313488, 0.824049385),
    ("[36,41)", 0.676178085, 0.836260769),
    ("[41,46)", 0.68085622, 0.832945428),
    ("[46,51)", 0.675356259, 0.924648353),
    ("[51,56)", 0.663488256, 0.808623699),
    ("[56,61)", 0.677147855, 0.835246996),
    ("[61,66)", 0.706400172, 0.806792662),
    ("[66,71)", 0.745618022, 0.845747658),
    ("[71,Inf]", 0.932103154, 0.809447474),
]

# fixed values: bonus class, frequency factor, severity factor (null class last)
BM_FACTORS = [
    (-4, 3.809263194, 0.946915244),
    (-3, 2.36651353, 0.820782963),
    (-2, 2.350580978, 1.039353992),
    (-1, 1.661957612, 0.922213984),
    (0, 1.0, 1.0),
    (1, 0.899796403, 0.944254997),
    (2, 0.787811329, 0.85438175),
    (3, 0.729202824, 0.951697059),
    (4, 0.694348435, 0.890818215),
    (5, 0.662978251, 0.899447044),
    (6, 0.653133669, 0.923377596),
    (7, 0.635783734, 0.88650593),
    (8, 0.704524095, 0.811041787),
    (9, 0.635397969, 0.876588315),
    (10, 0.476860979, 0.888564496),
    (None, 0.476860979, 0.888564496),
]


def kw_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KW_FACTORS, "kw_band string, kw_freq double, kw_sev double")


def age_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(AGE_FACTORS, "age_band string, age_freq double, age_sev double")


def bm_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BM_FACTORS, "bmcorr int, bm_freq double, bm_sev double")
