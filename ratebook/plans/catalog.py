"""Registered queries: one per operator of the survey, each with its oracle SQL.

Each query takes ``(spark, sf_dir)``, reads the whole driver tables and
returns a DataFrame.  Double results that are sums of doubles are rounded to
2 decimals on both sides (summation order differs between engines); ratios
of integer sums are exact and left alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources.standin import with_standin
from . import sqltext as S
from .scored import scored_portfolio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _round2(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 2) for c in cols})


def rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Round transcendental results (log/exp/tanh differ in the last ulp between engines)."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# ---------------------------------------------------------------------------
# A7 segment report (the flagship)

_SEG_DEFS = S.values_table(R.SEGMENTS, [("segment", "INTEGER"), ("own_flag", "INTEGER"),
                                         ("model_flag", "INTEGER"), ("label", "VARCHAR")])
_EARN = ["own_earn", "model_earn"]


def _zero_fill(names: list[str]) -> str:
    out = []
    for n in names:
        out.append(f"CASE WHEN g.count IS NULL THEN 0 ELSE g.{n} END AS {n}" if n not in _EARN
                   else f"round(CASE WHEN g.count IS NULL THEN 0 ELSE g.{n} END, 2) AS {n}")
    return ",\n  ".join(out)


SEGMENT_SQL = with_standin(f"""
SELECT d.segment, d.own_flag, d.model_flag, d.label,
  {_zero_fill(R.MEASURES_FULL)}
FROM {_SEG_DEFS} d(segment, own_flag, model_flag, label)
LEFT JOIN (
  SELECT {S.SEGMENT_CASE} AS segment,
  {S.measures_sql(R.MEASURES_FULL)}
  FROM priced WHERE nt IS NOT NULL AND nm IS NOT NULL AND earned IS NOT NULL GROUP BY 1) g ON d.segment = g.segment""")


@register("segment_report", SEGMENT_SQL)
def q_segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round2(R.segment_report(scored_portfolio(spark, sf_dir)), _EARN)


# the other query families register themselves on import
from . import q_build, q_reports, q_models  # noqa: E402,F401
