"""Column helpers that keep the null / NaN rules of the original scripts.

All of these are plain Catalyst expressions (no Python on the row path).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strict_sum(c: str | Column) -> Column:
    """Sum that is null when any input is null; 0 for an empty group (R ``sum``)."""
    x = col(c)
    return F.when(F.count(x) == F.count(F.lit(1)), F.coalesce(F.sum(x), F.lit(0)))


def lenient_sum(c: str | Column) -> Column:
    """Sum that skips nulls and is 0 for none (R ``sum(na.rm=TRUE)``)."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def strict_greatest(*cs: str | Column) -> Column:
    """``pmax`` without ``na.rm``: null as soon as one argument is null."""
    xs = [col(c) for c in cs]
    all_set = reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
    return F.when(all_set, F.greatest(*xs))


def strict_least(*cs: str | Column) -> Column:
    xs = [col(c) for c in cs]
    all_set = reduce(lambda a, b: a & b, [x.isNotNull() for x in xs])
    return F.when(all_set, F.least(*xs))


def skip_greatest(*cs: str | Column) -> Column:
    """``pmax(..., na.rm=TRUE)``; Spark's ``greatest`` already skips nulls."""
    return F.greatest(*[col(c) for c in cs])


def skip_least(*cs: str | Column) -> Column:
    return F.least(*[col(c) for c in cs])


def row_mean(*cs: str | Column) -> Column:
    """``rowMeans(na.rm=TRUE)``: mean of the non-null arguments, null if none."""
    xs = [col(c) for c in cs]
    total = reduce(lambda a, b: a + b, [F.coalesce(x.cast("double"), F.lit(0.0)) for x in xs])
    n = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), 1).otherwise(0) for x in xs])
    return F.when(n > 0, total / n)


def r_divide(num: str | Column, den: str | Column) -> Column:
    """R division on doubles: x/0 is +Inf, -Inf or NaN instead of an error."""
    n, d = col(num).cast("double"), col(den).cast("double")
    return (
        F.when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
        .when(d != 0, n / d)
        .when(n > 0, F.lit(float("inf")))
        .when(n < 0, F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )


def half_even(c: str | Column, digits: int = 0) -> Column:
    """R ``round``: half to even."""
    return F.bround(col(c), digits)


def paste0(*parts: str | Column) -> Column:
    """R ``paste0``: a missing value prints as ``NA``."""
    return F.concat(*[F.coalesce(col(p).cast("string"), F.lit("NA")) for p in parts])


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return f"{v}L" if abs(v) > 2**31 - 1 else str(v)
    if isinstance(v, float):
        if v != v:
            return "double('NaN')"
        if v in (float("inf"), float("-inf")):
            return f"double('{'-' if v < 0 else ''}Infinity')"
        return f"{v!r}D"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(d: dict) -> Column:
    """A map literal built in ONE call (one SQL expression, not one py4j call per entry)."""
    if not d:
        return F.expr("map()")
    return F.expr("map(" + ", ".join(f"{_sql_literal(k)}, {_sql_literal(v)}" for k, v in d.items()) + ")")
