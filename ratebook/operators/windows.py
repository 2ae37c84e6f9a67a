"""Ordered computations: distributed ranks / prefix sums, curves, level order.

A global rank or running total must not go through a single-partition
window.  The rows are range-partitioned on the order (with a unique
tie-breaker, so even a value that holds a third of all rows is split across
tasks), sorted inside each partition and numbered by
``monotonically_increasing_id``, whose high bits are the partition and whose
low bits the place in it.  A rank is then the place plus an offset from a
table of (partition, group) counts, whose size is bounded by the partitions
plus the groups.  Everything runs in the JVM on the columns' own types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import to_number
from ..session import cut_lineage
from .joins import broadcast_if_few, null_safe

PID, POS = "__pid", "__pos"
#: bits of a row's number that are its place in the partition
PLACE_BITS = 33


def _placed(df: DataFrame, keys: list[str], num_partitions: int | None) -> DataFrame:
    """The rows sorted by ``keys`` over range partitions and written, with partition and place."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    rows = cut_lineage(rows.withColumn(POS, F.monotonically_increasing_id()))
    return rows.withColumns({PID: F.shiftright(POS, PLACE_BITS), POS: F.col(POS).bitwiseAND((1 << PLACE_BITS) - 1)})


def _before(group: list[str]):
    """What earlier partitions hold of a group; over a table of a row for each partition and group."""
    w = Window.partitionBy(*group) if group else Window.partitionBy()
    return w.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], values: list[str],
                num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within ``group``, ordered by ``order``.

    ``order`` must make the row order total (end it with a unique key); a null
    group is a group, a null value adds nothing.  Output: input columns plus
    ``cum_<value>`` for each value column.
    """
    placed = _placed(df, [*group, *order], num_partitions)
    number = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    totals = placed.groupBy(PID, *group).agg(*[F.sum(x).alias(f"__tot_{v}") for v, x in number.items()])
    offsets = totals.select(PID, *group, *[F.coalesce(F.sum(f"__tot_{v}").over(_before(group)), F.lit(0.0)).alias(f"__off_{v}")
                                           for v in values])
    # a window here is a range partition's part of a group
    inside = Window.partitionBy(PID, *group).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({f"__loc_{v}": F.sum(x).over(inside) for v, x in number.items()})
    joined = null_safe(local, broadcast_if_few(offsets), [PID, *group], "left")
    return joined.select(*df.columns, *[(F.col(f"__loc_{v}") + F.col(f"__off_{v}")).alias(f"cum_{v}") for v in values])


def distributed_rank(df: DataFrame, group: list[str], order: list[str],
                     num_partitions: int | None = None) -> DataFrame:
    """1-based row number within ``group`` by ``order`` (total order), scalably; a null group is a group."""
    placed = _placed(df, [*group, *order], num_partitions)
    spans = placed.groupBy(PID, *group).agg(F.count(F.lit(1)).alias("__n"), F.min(POS).alias("__first"))
    earlier = F.coalesce(F.sum("__n").over(_before(group)), F.lit(0))
    offsets = spans.select(PID, *group, (earlier - F.col("__first") + 1).alias("__add"))
    ranked = null_safe(placed, broadcast_if_few(offsets), [PID, *group])
    return ranked.select(*df.columns, (F.col(POS) + F.col("__add")).alias("rank"))


#: repeats of a row that are listed at once
RUN = 1024


def _repeated(df: DataFrame, times: str, out: str) -> DataFrame:
    """Each row for ``out`` = 0 .. times; a row of many repeats is dealt out in blocks first, so no task lists them all."""
    k = F.col(times)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(k / RUN)))
    many = df.where(k >= RUN).withColumn("__block", block).repartition("__block", *df.columns)
    last = F.least(F.lit(RUN - 1).cast("long"), k - F.col("__block") * RUN)
    many = many.withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), last)) ).withColumn(out, F.col(out) + F.col("__block") * RUN)
    few = df.where(k < RUN).withColumn(out, F.explode(F.sequence(F.lit(0).cast("long"), k)))
    return few.unionByName(many.drop("__block"))


def sorted_curves(df: DataFrame, series: list[str], key: str, points: int | None = None,
                  by: list[str] | None = None) -> DataFrame:
    """Distribution curves (W1): each series sorted on its own, aligned by rank.

    Missing values are dropped per series (R ``sort``); a shorter series
    repeats from its start up to the longest length (within each ``by``
    group).  Long form ``(*by, idx, series, value)``.  With ``points`` only
    that many evenly spaced ranks are returned per series (exact ranks).
    All groups and series are ranked in ONE distributed rank.
    """
    by = by or []
    long = (df.select(*by, key, *[F.col(s).cast("double").alias(s) for s in series])
            .unpivot([*by, key], series, "series", "value").filter(F.col("value").isNotNull()))
    grp = [*by, "series"]
    ranked = distributed_rank(long, grp, ["value", key])
    # one row per (group, series): its length n and the group's longest length L
    wl = Window.partitionBy(*by) if by else Window.partitionBy()
    # sizes from the ranked (checkpointed) rows: no second pass over the source
    sizes = (ranked.groupBy(*grp).agg(F.max("rank").alias("n"))
             .withColumn("L", F.max("n").over(wl)))
    if points is None:
        # rank r of a series of length n fills idx r, r+n, r+2n, ... <= L
        rep = null_safe(ranked, broadcast_if_few(sizes), grp)
        rep = _repeated(rep.withColumn("__times", F.floor((F.col("L") - F.col("rank")) / F.col("n"))), "__times", "k")
        return rep.select(*by, (F.col("rank") + F.col("k") * F.col("n")).alias("idx"), "series", "value")
    step = F.lit(1.0) * (F.col("L") - 1) / F.lit(max(points - 1, 1))
    want = (sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
            .withColumn("idx", F.round(F.lit(1.0) + F.col("j") * step).cast("long"))
            .withColumn("rank", F.pmod(F.col("idx") - 1, F.col("n")) + 1)
            .select(*grp, "rank", "idx"))
    return null_safe(ranked, broadcast_if_few(want), [*grp, "rank"]).select(*by, "idx", "series", "value")


def ordered_levels(report: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Level order for plotting (W2): numeric levels by number, then text levels by text."""
    num = to_number(value)
    w = Window.partitionBy(feature).orderBy(num.isNull(), num, F.col(value))
    return report.withColumn("level_order", F.row_number().over(w))


def axis_scaled(report: DataFrame, measure: str, feature: str = "feature",
                count: str = "count") -> DataFrame:
    """Counts scaled to a measure's axis: ``count * max(measure)/max(count)`` per feature."""
    w = Window.partitionBy(feature)
    return report.withColumn(
        f"{count}_scaled",
        F.col(count) * (F.max(measure).over(w) / F.max(count).over(w)))


def normalised_claims(report: DataFrame, feature: str = "feature", market: str = "market",
                      claim: str = "actual_claim") -> DataFrame:
    """Claims scaled so that they sum to the market per feature."""
    w = Window.partitionBy(feature)
    return report.withColumn(f"{claim}_scaled",
                             F.col(claim) * (F.sum(market).over(w) / F.sum(claim).over(w)))


def level_table(df: DataFrame, features: list[str]) -> DataFrame:
    """Factor levels (W6): per feature a blank level first, then the sorted values.

    Columns: ``feature``, ``value`` (text), ``level`` (1 = blank), ``col_index``
    (0-based global column of the one-hot design = level - 1 + feature offset).
    Missing values are not levels.  Numeric features sort by number.
    """
    spark = df.sparkSession
    num_types = (T.NumericType,)
    kinds = {f.name: isinstance(f.dataType, num_types) for f in df.schema.fields}
    # one pass: every row emits its (feature, value, number) triples, then distinct
    triples = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value"),
                                 (F.col(f).cast("double") if kinds[f] else F.lit(None).cast("double")).alias("num"))
                        for f in features])
    lv = (df.select(F.explode(triples).alias("t")).select("t.*")
          .filter(F.col("value").isNotNull()).distinct())
    # level order per feature by the distributed rank: a feature with very many
    # levels (postal code, correction key) is not gathered into one task
    lv = distributed_rank(lv, ["feature"], ["num", "value"]).withColumn("level", F.col("rank") + 1).drop("num", "rank")
    blanks = spark.createDataFrame([(f, " ", 1) for f in features], "feature string, value string, level int")
    lv = lv.select("feature", "value", F.col("level").cast("int")).unionByName(blanks)
    order = spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, f_pos int")
    sizes = lv.groupBy("feature").agg(F.count(F.lit(1)).alias("n_levels")).join(order, "feature")
    wo = Window.orderBy("f_pos").rowsBetween(Window.unboundedPreceding, -1)
    # one row per feature: the offset window is tiny
    offs = sizes.select("feature", F.coalesce(F.sum("n_levels").over(wo), F.lit(0)).alias("offset"))
    return (lv.join(F.broadcast(offs), "feature")  # one row per feature
            .select("feature", "value", "level", (F.col("level") - 1 + F.col("offset")).alias("col_index")))


def baseline_level(df: DataFrame, features: list[str]) -> DataFrame:
    """Most frequent level of each feature, ties to the smaller text."""
    from .reports import long_levels
    counts = long_levels(df, features, []).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    # an aggregation, not a window: highest count, then the smallest level, null last
    order = F.struct((-F.col("n")).alias("a"), F.col("value").isNull().alias("b"), F.col("value").alias("c"))
    best = counts.groupBy("feature").agg(F.min_by(F.struct("value", "n"), order).alias("best"))
    return best.select("feature", "best.value", "best.n")


def union_reports(reports: list[DataFrame]) -> DataFrame:
    """Append reports by column name, missing columns filled with null."""
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def one_policy(df: DataFrame, key: str, value) -> DataFrame:
    """One policy by key."""
    return df.filter(F.col(key) == F.lit(value))
