"""File sources and sinks: ``;`` CSV with decimal comma, plain CSV, Parquet.

Parquet is the default sink.  The decimal-comma CSV keeps the exchange
format of the original jobs: numbers are written with ``,`` as decimal
mark and read back by parsing text columns, never by schema inference.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import decimal_comma
from ..session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ratebook-io/{name}-{uuid.uuid4().hex[:12]}"


def read_decimal_comma(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read ``;``-separated CSV with decimal comma into ``schema``.

    Every column is read as text; numeric columns are parsed with
    ``try_cast`` after replacing the comma, so a bad value becomes null.
    """
    raw = spark.read.csv(path, sep=";", header=True,
                         schema=T.StructType([T.StructField(f.name, T.StringType()) for f in schema]))
    cols = []
    for f in schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            cols.append(decimal_comma(c).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            cols.append(c)
        else:
            cols.append(F.regexp_replace(c, ",", ".").try_cast(f.dataType).alias(f.name))
    return raw.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Plain CSV with a header and an explicit schema (S3)."""
    return spark.read.csv(path, sep=sep, header=True, schema=schema, mode="PERMISSIVE")


def to_decimal_comma(df: DataFrame) -> DataFrame:
    """Doubles as text with ``,`` as decimal mark."""
    out = []
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            out.append(F.regexp_replace(F.col(f.name).cast("string"), r"\.", ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_decimal_comma(df: DataFrame, path: str) -> None:
    """Write ``;`` CSV with decimal comma."""
    to_decimal_comma(df).write.mode("overwrite").csv(path, sep=";", header=True)


def read_policies(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    """Parquet policy feed with the chosen columns only (S2; pruned at the scan)."""
    return spark.read.parquet(path).select(*cols)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
