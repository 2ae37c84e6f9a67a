"""Business metrics, typicality weights, AUC / log loss, exact quantiles.

All are single aggregations (map-side partial, one tiny shuffle) or use the
distributed rank; none gathers a column on the driver or in one task.
"""

from __future__ import annotations

import math
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import prefix_sums


def business_metrics(df: DataFrame, pred: str = "p", label: str = "t", margin: str = "m") -> DataFrame:
    """The four fit metrics on the fit scale (A17-A20), one row.

    avg_undercut: mean ``exp(m) - exp(p)`` over profitable quotes with ``p < m`` (0 if none);
    profit_missed_count: profitable quotes priced under break-even;
    profit_impact: money lost on them ``sum(exp(t) - exp(p))``;
    loss_got_count: loss-making quotes priced at or over break-even.
    """
    p, t, m = F.col(pred), F.col(label), F.col(margin)
    profit = m > t
    under = profit & (p < m)
    missed = profit & (F.greatest(F.lit(0.0), t - p) > 0)
    return df.agg(
        F.coalesce(F.avg(F.when(under, F.exp(m) - F.exp(p))), F.lit(0.0)).alias("avg_undercut"),
        F.count_if(profit & (p < t)).alias("profit_missed_count"),
        F.coalesce(F.sum(F.when(missed, F.exp(t) - F.exp(p))), F.lit(0.0)).alias("profit_impact"),
        F.count_if((m <= t) & (p >= t)).alias("loss_got_count"),
    )


def scaler_stats(train: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation per column (zero deviation -> 1), one row."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    st = train.agg(*aggs)
    return st.withColumns({f"sd_{c}": F.when(F.col(f"sd_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"sd_{c}"))
                           for c in cols})


def typicality(df: DataFrame, stats: DataFrame, cols: list[str], alpha: float = 0.5) -> DataFrame:
    """``exp(-alpha * ||standardised x||)`` with train statistics reused.

    The statistics are scalar subqueries over the one-row ``stats`` table.
    """
    z2 = reduce(lambda a, b: a + b, [
        F.pow((F.col(c) - stats.select(f"mu_{c}").scalar()) / stats.select(f"sd_{c}").scalar(), 2)
        for c in cols])
    return df.withColumn("typicality", F.exp(F.lit(-alpha) * F.sqrt(z2)))


def ordered_code(c: str | Column) -> Column:
    """A long whose order is that of the doubles: their IEEE bits, negated below zero, NaN last.

    Built from the exponent and the fraction, which are exact: a division by a
    power of two loses nothing.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    size = F.abs(x)
    # the logarithm may be off by one next to a power of two; the quotient tells
    near = F.least(F.greatest(F.floor(F.log2(size)), F.lit(-1022)), F.lit(1023))
    part = size / F.pow(F.lit(2.0), near)
    exponent = F.when(part >= 2, near + 1).when((part < 1) & (near > -1022), near - 1).otherwise(near)
    part = size / F.pow(F.lit(2.0), exponent)
    unit = F.lit(float(1 << 52))
    bits = F.when(part >= 1, (exponent + 1023) * F.lit(1 << 52) + ((part - 1) * unit).cast("long")).otherwise((part * unit).cast("long"))
    top = F.lit(2047 << 52)
    bits = F.when(size == 0, F.lit(0).cast("long")).when(F.isnan(x), top + 1).when(size == float("inf"), top).otherwise(bits)
    return F.when(x < 0, -bits).otherwise(bits)


def decoded(code: int) -> float:
    """The double of an ``ordered_code``."""
    size = struct.unpack("<d", struct.pack("<q", abs(code)))[0]
    return -size if code < 0 else size


#: bits of a code that a pass leaves undecided, and values that are counted one by one at once
SHIFTS, FEW_VALUES = (48, 32, 16, 0), 200_000


def radix_quantiles(df: DataFrame, cols: list[str], probs: list[float], few: int = FEW_VALUES) -> dict[str, list[float | None]]:
    """Exact type-7 quantiles (numpy/R default) of several columns at once, null for a column without values.

    A pass counts rows by the leading 16 bits of their code (at most 65536
    counts a column reach the driver), the next one only the rows whose
    leading bits are those of a wanted rank, by 16 bits more.  Once no more
    than ``few`` rows share them, their values are counted one by one.  So two
    or three scans with partial sums and no sort give all quantiles; missing
    values don't count, NaN is the largest value.
    """
    codes = df.select(*[ordered_code(c).alias(f"__c{i}") for i, c in enumerate(cols)])
    rows = codes.select(F.explode(F.array(*[F.struct(F.lit(i).alias("col"), F.col(f"__c{i}").alias("code")) for i in range(len(cols))])).alias("r"))
    rows = rows.select("r.*").filter(F.col("code").isNotNull())
    chosen: dict[int, list[int]] | None = None  # leading bits of the wanted ranks, by column
    wanted: dict[int, dict[int, tuple[int, int]]] = {}  # column -> rank from 0 -> (leading bits, rows below them)
    sizes: dict[int, int] = {}
    shift, level, shared = SHIFTS[0], 0, None
    while True:
        some = rows
        if chosen is not None:
            keep = [(F.col("col") == i) & F.shiftright("code", prev).isin(bins) for i, bins in chosen.items()]
            some = rows.filter(reduce(lambda a, b: a | b, keep))
        counts = some.groupBy("col", F.shiftright("code", shift).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        by: dict[int, list[tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r["col"], []).append((r["bin"], r["n"]))
        if chosen is None:
            for i, bins in by.items():
                sizes[i] = n = sum(x for _, x in bins)
                ranks = {f((n - 1) * p) for p in probs for f in (math.floor, math.ceil)}
                wanted[i] = {k: (0, 0) for k in ranks}
        shared = 0
        for i, bins in by.items():
            bins.sort()
            for k, (lead, below) in wanted[i].items():
                at = below
                for b, n in bins:
                    if chosen is not None and b >> (prev - shift) != lead:
                        continue
                    if at + n > k:
                        wanted[i][k] = (b, at)
                        break
                    at += n
            hit = {b for b, _ in wanted[i].values()}
            shared += sum(n for b, n in bins if b in hit)
        if shift == 0 or not by:
            break
        chosen = {i: sorted({b for b, _ in w.values()}) for i, w in wanted.items()}
        prev, level = shift, level + 1
        shift = 0 if shared <= few else SHIFTS[level]
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        values: list[float | None] = []
        for p in probs:
            h = (sizes.get(i, 0) - 1) * p
            if i not in sizes:
                values.append(None)
                continue
            low, high = (decoded(wanted[i][f(h)][0]) for f in (math.floor, math.ceil))
            values.append(low if low == high else low + (h - math.floor(h)) * (high - low))
        out[c] = values
    return out


def exact_quantiles(df: DataFrame, c: str, probs: list[float], key: str | None = None,
                    accuracy: int = FEW_VALUES) -> DataFrame:
    """Type-7 quantiles of one column, one row ``q_0, q_1, ...``; exact for any ``accuracy``,
    the number of rows whose values are counted one by one at once.  ``key`` isn't needed."""
    schema = ", ".join(f"q_{i} double" for i in range(len(probs)))
    return df.sparkSession.createDataFrame([tuple(radix_quantiles(df, [c], probs, accuracy)[c])], schema)


def shift_positive(df: DataFrame, c: str, eps: float = 1e-6) -> DataFrame:
    """``V + |min V| + 1e-6`` (P32); the minimum is a scalar subquery."""
    mn = df.agg(F.min(c).alias("mn")).scalar()
    return df.withColumn(c, F.col(c) + F.abs(mn) + F.lit(eps))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact ROC AUC with ties (rank-sum over distinct scores), one row.

    Per distinct score: positives and negatives (partial aggregation), then
    the running count of negatives below each score by the distributed
    prefix sum; AUC = sum(pos * (neg_below + neg/2)) / (P * N).
    """
    by = df.groupBy(F.col(score).alias("s")).agg(
        F.sum(F.col(label).cast("double")).alias("pos"),
        F.sum((F.lit(1) - F.col(label)).cast("double")).alias("neg"))
    cum = prefix_sums(by, [], ["s"], ["neg"])
    return cum.agg(
        (F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") * F.lit(0.5)))
         / (F.sum("pos") * F.sum("neg"))).alias("auc"))


def log_loss(df: DataFrame, label: str, prob: str, eps: float = 1e-15) -> Column:
    """Mean binary log loss with probabilities clipped to ``[eps, 1-eps]``."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return F.avg(-(y * F.log(p) + (F.lit(1) - y) * F.log(F.lit(1.0) - p)))
