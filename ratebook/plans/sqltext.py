"""SQL text pieces for the DuckDB oracle (kept next to the Spark definitions).

These strings are only used to cross-check the Spark plans in another
engine; the library itself never parses or runs them.
"""

from __future__ import annotations


def ifelse(cond: str, yes: str, no: str) -> str:
    return f"CASE WHEN {cond} THEN {yes} WHEN NOT ({cond}) THEN {no} END"


def strict_sum(x: str, typ: str = "BIGINT") -> str:
    return f"CAST(CASE WHEN count({x}) = count(*) THEN coalesce(sum({x}), 0) END AS {typ})"


def lenient_sum(x: str, typ: str = "BIGINT") -> str:
    return f"CAST(coalesce(sum({x}), 0) AS {typ})"


OWN_LOST = "nm <= a"
MODEL_LOST = "nm <= np"


def measure_sql(name: str) -> str:
    ol, ml = OWN_LOST, MODEL_LOST
    d = {
        "count": "CAST(count(*) AS BIGINT)",
        "market": strict_sum("nm"),
        "technical": strict_sum("nt"),
        "value": f"{strict_sum('nm')} - {strict_sum('nt')}",
        "possprofit": f"{strict_sum('nm')} - {strict_sum('nt')}",
        "own": strict_sum("a"),
        "model": strict_sum("np"),
        "own_profit": strict_sum(ifelse(ol, "0", "a - nt")),
        "model_profit": strict_sum(ifelse(ml, "0", "np - nt")),
        "own_undercut": strict_sum(ifelse(ol, "0", "nm - a")),
        "model_undercut": strict_sum(ifelse(ml, "0", "nm - np")),
        "earned": lenient_sum("earned"),
        "actual_earned": lenient_sum("earned"),
        "current_prem": lenient_sum("policy_premium"),
        "actual_claim": lenient_sum("claim"),
        "own_cnt": strict_sum(ifelse(ol, "0", "1")),
        "model_cnt": strict_sum(ifelse(ml, "0", "1")),
        "own_prem": strict_sum(ifelse(ol, "0", "a")),
        "model_prem": strict_sum(ifelse(ml, "0", "np")),
        "own_earn": strict_sum(ifelse(ol, "0e0", "CAST(earned AS DOUBLE) * a / policy_premium"), "DOUBLE"),
        "model_earn": strict_sum(ifelse(ml, "0e0", "CAST(earned AS DOUBLE) * np / policy_premium"), "DOUBLE"),
        "own_cost": strict_sum(ifelse(ol, "0", "nt")),
        "model_cost": strict_sum(ifelse(ml, "0", "nt")),
        "own_claim": lenient_sum(ifelse(ol, "0", "claim")),
        "model_claim": lenient_sum(ifelse(ml, "0", "claim")),
        "mod_mul": f"CAST({strict_sum('np')} AS DOUBLE) / {strict_sum('a')}",
    }
    return d[name]


def measures_sql(names: list[str]) -> str:
    return ",\n  ".join(f"{measure_sql(n)} AS {n}" for n in names)


SEGMENT_CASE = """CASE
  WHEN nm > nt AND nm <= np AND nm <= a THEN 1
  WHEN nm > nt AND nm <= np AND nm > a AND a < nt THEN 2
  WHEN nm > nt AND nm <= np AND nm > a AND a >= nt THEN 3
  WHEN nm > nt AND nm > np AND nm > a AND a >= nt AND np >= nt THEN 4
  WHEN nm > nt AND nm > np AND nm > a AND a >= nt AND np < nt THEN 5
  WHEN nm > nt AND nm > np AND nm > a AND a < nt AND np >= nt THEN 6
  WHEN nm > nt AND nm > np AND nm > a AND a < nt AND np < nt THEN 7
  WHEN nm > nt AND nm > np AND nm <= a AND np >= nt THEN 8
  WHEN nm > nt AND nm > np AND nm <= a AND np < nt THEN 9
  WHEN nm < nt AND nm > np AND nm > a THEN 10
  WHEN nm < nt AND nm > np AND nm <= a THEN 11
  WHEN nm < nt AND nm <= np AND nm > a THEN 12
  WHEN nm < nt AND nm <= np AND nm <= a THEN 13 END"""


def values_table(rows: list[tuple], cols: list[tuple[str, str]]) -> str:
    """``(VALUES ...) t(cols)`` with explicit casts."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(f"CAST({lit(v)} AS {t})" for v, (_, t) in zip(r, cols)) + ")"
                     for r in rows)
    return f"(VALUES {body})"
