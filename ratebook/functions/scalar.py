"""Cleaning and coding columns: keys, numbers, yes/no, bonus codes, bands, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .semantics import col


def to_key(c: str | Column) -> Column:
    """64-bit policy key; text that is not a number becomes null."""
    return col(c).cast("string").try_cast("bigint")


def to_number(c: str | Column) -> Column:
    """Numeric parse without error: bad text -> null (P31), type suffixes such as ``1d`` or ``3F`` too."""
    text = col(c).cast("string")
    return F.when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), text.try_cast("double"))


def decimal_comma(c: str | Column) -> Column:
    """Parse ``"35953,00"`` style text: decimal comma -> point, then try_cast."""
    return F.regexp_replace(F.trim(col(c).cast("string")), ",", ".").try_cast("double")


def repair_int(c: str | Column, fixes: dict[str, str] | None = None) -> Column:
    """Replace known dirty literals, then cast to int; other bad text -> null."""
    x = col(c).cast("string")
    for bad, good in (fixes or {}).items():
        x = F.when(x == F.lit(bad), F.lit(good)).otherwise(x)
    return x.try_cast("int")


def yes_no(c: str | Column, strict_spellings: bool = False) -> Column:
    """yes/no text to 1/0.

    R variant: any case, missing stays missing, other text is 0.
    pandas variant (``strict_spellings``): only yes/no/Yes/No map, others null.
    """
    x = col(c)
    if strict_spellings:
        return (F.when(x.isin("yes", "Yes"), F.lit(1))
                .when(x.isin("no", "No"), F.lit(0)).cast("int"))
    return (F.lower(x) == F.lit("yes")).cast("int")


# fixed values: bonus-malus class codes and their numeric class
BONUS_CODES = {
    "M04": -4, "M03": -3, "M02": -2, "M01": -1, "A00": 0,
    "B01": 1, "B02": 2, "B03": 3, "B04": 4, "B05": 5, "B06": 6, "B07": 7, "B08": 8, "B09": 9,
    "B10": 10,
}
# fixed values: the short spellings accepted by the rating-factor builder
BONUS_CODES_SHORT = {
    "M4": -4, "M3": -3, "M2": -2, "M1": -1, "A0": 0,
    "B1": 1, "B2": 2, "B3": 3, "B4": 4, "B5": 5, "B6": 6, "B7": 7, "B8": 8, "B9": 9,
}


def bonus_number(c: str | Column, short_spellings: bool = True) -> Column:
    """Bonus-malus code to its class number; unknown codes -> null (P10)."""
    codes = dict(BONUS_CODES)
    if short_spellings:
        codes.update(BONUS_CODES_SHORT)
    m = F.create_map(*[x for k, v in codes.items() for x in (F.lit(k), F.lit(v))])
    return m[col(c)].cast("int")


def claim_label(c: str | Column) -> Column:
    """1 when a claim date is present, else 0."""
    return col(c).isNotNull().cast("int")


def band(c: str | Column, breaks: list[float], default: float | None = None) -> Column:
    """``cut(x, breaks, right=FALSE, include.lowest=TRUE)`` with the same labels.

    Bands are ``[lo,hi)``; the last one is closed ``[lo,hi]``; outside -> null.
    A missing input takes ``default`` first (``fifelse(is.na(x), d, x)``).
    """
    x = col(c)
    if default is not None:
        x = F.coalesce(x.cast("double"), F.lit(float(default)))

    def fmt(v: float) -> str:
        if v == float("inf"):
            return "Inf"
        if v == float("-inf"):
            return "-Inf"
        return str(int(v)) if float(v).is_integer() else repr(v)

    expr = None
    n = len(breaks) - 1
    for i in range(n):
        lo, hi = breaks[i], breaks[i + 1]
        last = i == n - 1
        label = f"[{fmt(lo)},{fmt(hi)}{']' if last else ')'}"
        cond = (x >= F.lit(lo)) & ((x <= F.lit(hi)) if last else (x < F.lit(hi)))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


# fixed values: kW and age band breaks and the defaults for a missing value
KW_BREAKS = [0, 38, 51, 71, 101, float("inf")]
AGE_BREAKS = [-1, 0, 26, 31, 36, 41, 46, 51, 56, 61, 66, 71, float("inf")]
KW_DEFAULT = 51
AGE_DEFAULT = 46

# fixed values: the transliteration of feature names (accents, blank, hyphen)
ASCII_FROM = " -óöőúüűáéí"
ASCII_TO = "__ooouuuaei"


def ascii_name(c: str | Column) -> Column:
    """Feature names made safe for a feature map."""
    return F.translate(col(c), ASCII_FROM, ASCII_TO)


def fill_features(df: DataFrame, cols: list[str], value: int = -999) -> DataFrame:
    """Fill missing values of a feature list with -999 by column type (P5, Q16).

    Numeric columns get the number, text columns the level ``'-999'``.
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    num = [c for c in cols if isinstance(types[c], T.NumericType)]
    txt = [c for c in cols if isinstance(types[c], T.StringType)]
    out = df
    if num:
        out = out.fillna(value, subset=num)
    if txt:
        out = out.fillna(str(value), subset=txt)
    return out


def fill_marker(df: DataFrame, cols: list[str], value: int = -1) -> DataFrame:
    """Fill with -1 where a missing value carries meaning."""
    return df.fillna(value, subset=cols)


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows missing any of the listed columns."""
    return df.dropna(subset=cols)


def require_all_except(df: DataFrame, cols: list[str], exempt: list[str]) -> DataFrame:
    """Drop rows missing any column of ``cols`` other than the exempt ones.

    Label and price stay in the same row, so no index alignment is needed.
    """
    return df.dropna(subset=[c for c in cols if c not in set(exempt)])


def cols_like(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches a regular expression (P20)."""
    import re
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.search(c)]


def cols_except(df: DataFrame, exclude: list[str]) -> list[str]:
    return [c for c in df.columns if c not in set(exclude)]


def rename_inputs(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns."""
    return df.withColumnsRenamed(mapping)
