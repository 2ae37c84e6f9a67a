"""Decimal-comma CSV: a dirty literal, a non-numeric key, a round trip."""

import os
import tempfile

from pyspark.sql import types as T

from ratebook.functions import scalar as SC
from ratebook.sources import files as FL


def test_read_dirty_decimal_comma_csv(spark):
    folder = tempfile.mkdtemp(prefix="ratebook-csv-", dir="/tmp")
    path = os.path.join(folder, "input.csv")
    with open(path, "w") as fh:
        fh.write("unique_id;pp;policy_premium\n81100000706;1234,5;35953,00 FtT\nx811;12,25;40000\n")
    schema = T.StructType([T.StructField("unique_id", T.StringType()), T.StructField("pp", T.DoubleType()),
                           T.StructField("policy_premium", T.StringType())])
    df = FL.read_decimal_comma(spark, path, schema)
    df = df.select(SC.to_key("unique_id").alias("k"), "pp",
                   SC.repair_int("policy_premium", {"35953,00 FtT": "35953"}).alias("prem"))
    assert [tuple(r) for r in df.collect()] == [(81100000706, 1234.5, 35953), (None, 12.25, 40000)]


def test_decimal_comma_round_trip(spark):
    df = spark.createDataFrame([(1, 0.1, "a"), (2, 12345.678901234, None)], "k long, v double, s string")
    path = FL.scratch_path(spark, "rt")
    FL.write_decimal_comma(df, path)
    back = FL.read_decimal_comma(spark, path, df.schema).orderBy("k").collect()
    assert [tuple(r) for r in back] == [(1, 0.1, "a"), (2, 12345.678901234, None)]
