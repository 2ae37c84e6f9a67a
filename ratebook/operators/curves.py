"""Plot data: loss curves, profit curves and best prices, histograms, densities.

Loss curves list their grid a row at a time with ``explode(sequence(...))``;
best prices compare a fixed number of grid points in closed form; histograms
and densities reduce the data to bins in one partial aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CORRIDOR_PLOT, CorridorWeights, DemandConfig
from ..functions.objectives import convex_loss
from .metrics import radix_quantiles


def _grid_point(lo: Column, hi: Column, j: Column, n: int) -> Column:
    """``seq(lo, hi, length.out=n)`` / ``linspace``: ``lo + j*step``, last point exactly ``hi``."""
    step = (hi - lo) / F.lit(n - 1)
    return F.when(j == n - 1, hi).when(j == 0, lo).otherwise(lo + j * step)


def _linspace(lo: float, hi: float, j: Column, n: int) -> Column:
    """numpy ``linspace``: ``j*step + lo``, the last point exactly ``hi``."""
    step = (hi - lo) / (n - 1)
    return F.when(j == n - 1, F.lit(hi)).otherwise(j * F.lit(step) + F.lit(lo))


def loss_curve(df: DataFrame, key: str = "polref", t: str = "t", m: str = "m", p: str = "p",
               n: int = 500, w: CorridorWeights = CORRIDOR_PLOT, alpha: float = 1e-5) -> DataFrame:
    """Loss of each given policy on a price grid padded by a tenth of its range (G1)."""
    lo0 = F.least(F.col(t), F.col(m), F.col(p))
    hi0 = F.greatest(F.col(t), F.col(m), F.col(p))
    pad = (hi0 - lo0) / F.lit(10.0)
    g = (df.select(key, t, m, (lo0 - pad).alias("__lo"), (hi0 + pad).alias("__hi"))
         .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    g = g.withColumn("price", _grid_point(F.col("__lo"), F.col("__hi"), F.col("j"), n))
    return g.select(key, "j", "price", convex_loss("price", t, m, w, alpha).alias("loss"),
                    F.exp("price").alias("ep"))


def best_price(products: DataFrame, key: str, cost: str, intercept: str, slope: str,
               cfg: DemandConfig = DemandConfig()) -> DataFrame:
    """Best price of the profit curve ``(x - c) * max(b0 - b1 x, 0)`` on the price grid.

    No grid is listed.  The profit is a parabola where there is demand and 0
    elsewhere, so on the grid it is greatest next to the vertex, next to the
    price at which demand ends, next to the cost (where the profit changes
    its sign) or at an end of the grid.  Those points alone are compared.
    Ties go to the lowest price (``argmax`` takes the first).  One row for
    each input row; the true-demand profit at the chosen price is reported too.
    """
    n = cfg.n_prices
    c, b0, b1 = F.col(cost), F.col(intercept), F.col(slope)
    sloped = F.when(b1 != 0, b1)
    near = [(b0 + b1 * c) / (sloped * 2), b0 / sloped, c]
    step = (cfg.price_hi - cfg.price_lo) / (n - 1)
    places = [F.lit(0), F.lit(n - 1)]
    for x in near:
        # two places on each side: the quotient may round across a grid point
        at = F.least(F.greatest(F.floor((x - F.lit(cfg.price_lo)) / step), F.lit(-2)), F.lit(n + 1))
        places += [F.least(F.greatest(F.coalesce(at + d, F.lit(0)), F.lit(0)), F.lit(n - 1)).cast("int") for d in (-1, 0, 1, 2)]

    def point(j: Column) -> Column:
        x = _linspace(cfg.price_lo, cfg.price_hi, j, n)
        return F.struct(((x - c) * F.greatest(b0 - b1 * x, F.lit(0.0))).alias("profit"), (-j).alias("nj"))

    best = products.select(key, c.alias("__c"), F.array_max(F.transform(F.array(*places), point)).alias("__b"))
    bx = _linspace(cfg.price_lo, cfg.price_hi, -F.col("__b.nj"), n)
    true_profit = (bx - F.col("__c")) * F.greatest(
        F.lit(cfg.true_intercept) - F.lit(cfg.true_slope) * bx, F.lit(0.0))
    return best.select(key, bx.alias("best_price"), F.col("__b.profit").alias("best_profit"),
                       true_profit.alias("true_profit"))


def parameter_scan(products: DataFrame, key: str, cost: str,
                   cfg: DemandConfig = DemandConfig()) -> DataFrame:
    """Decision loss over guessed demand slopes.

    For every product and slope ``theta`` on the scan grid: the best price
    under ``max(100 - theta x, 0)``, and ``-(true profit)`` there.
    """
    th = products.select(key, cost).withColumn("__ti", F.explode(F.sequence(F.lit(0), F.lit(cfg.n_thetas - 1))))
    th = th.withColumn("__theta", _linspace(cfg.theta_lo, cfg.theta_hi, F.col("__ti"), cfg.n_thetas))
    th = th.withColumn("__b0", F.lit(cfg.true_intercept))
    pk = F.struct(F.col(key).alias("__key"), "__ti", "__theta")
    best = best_price(th.withColumn("__pk", pk), "__pk", cost, "__b0", "__theta", cfg)
    return best.select(F.col("__pk.__key").alias(key), F.col("__pk.__ti").alias("k"),
                       F.col("__pk.__theta").alias("theta"), "best_price",
                       (-F.col("true_profit")).alias("loss"))


def _series(df: DataFrame, cols: list[str], log: bool) -> DataFrame:
    """(series, x) of the values that aren't missing; logarithms of positive ones."""
    x = {c: F.log(F.when(F.col(c) > 0, F.col(c))) if log else F.col(c).cast("double") for c in cols}
    return df.select(*[v.alias(c) for c, v in x.items()]).unpivot([], cols, "series", "x").filter(F.col("x").isNotNull())


def density_histogram(df: DataFrame, cols: list[str], bins: int = 30, log: bool = True) -> DataFrame:
    """Density histogram of several series on ONE range (H1), as the plot layers share their scale.

    The width is ``range / (bins - 1)`` and the first bin is centred on the
    least value of all series; bins are closed on the right; empty bins are 0.
    Where all values are equal the width is 0.1.
    """
    long = _series(df, cols, log)
    sides = long.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    lo, span = sides.select("lo").scalar(), sides.select(F.col("hi") - F.col("lo")).scalar()
    width = F.when(span > 0, span / F.lit(bins - 1)).otherwise(F.lit(0.1))
    first = lo - width / 2
    at = F.least(F.greatest(F.ceil((F.col("x") - first) / width) - 1, F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = long.groupBy("series", at.alias("bin")).agg(F.count(F.lit(1)).alias("cnt"))
    total = counts.groupBy("series").agg(F.sum("cnt").alias("n"))
    # one row for each listed series and bin
    every = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, ["series", "bin"], "left").fillna(0, subset=["cnt"])
    return out.select("series", "bin", (first + F.col("bin") * width).alias("left"), (F.col("cnt") / (F.col("n") * width)).alias("density"))


def bandwidth(sd: float | None, iqr: float, n: int, first: float) -> float:
    """R's ``bw.nrd0``: 0.9 min(sd, iqr / 1.34) n^-0.2; where that is 0 the deviation, then |first|, then 1 take its place."""
    spread = min(sd or 0.0, iqr / 1.34) or sd or abs(first) or 1.0
    return 0.9 * spread * n ** -0.2


def kernel_density(df: DataFrame, cols: list[str], n_grid: int = 512, log: bool = True) -> DataFrame:
    """Gaussian kernel densities of several series on ONE range, from the least to the greatest value of all (H2).

    As R does it: a value's weight is split between the two points of a grid
    that it lies between (linear binning), the grid reaches four bandwidths
    beyond the range, the weights are convolved with the kernel, and the
    result is interpolated at ``n_grid`` points of the range.  The data are
    reduced to at most ``n_grid`` weights a series in one partial aggregation;
    what follows doesn't depend on the number of rows.  Columns ``series, j,
    g, price, density``; a series without values has no rows.
    """
    spark = df.sparkSession
    long = _series(df, cols, log)
    stats = {r.series: r for r in long.groupBy("series").agg(  # one row a listed series
        F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    quartiles = radix_quantiles(df.select(*[(F.log(F.when(F.col(c) > 0, F.col(c))) if log else F.col(c)).alias(c) for c in cols]), cols, [0.25, 0.75])
    kind = "series string, n long, bw double, lo double, step double, x0 double, span double"
    if not stats:
        return spark.createDataFrame([], "series string, j int, g double, price double, density double")
    x0, x1 = min(r.lo for r in stats.values()), max(r.hi for r in stats.values())
    rows = []
    for c, r in stats.items():
        bw = bandwidth(r.sd, quartiles[c][1] - quartiles[c][0], r.n, r.lo)
        lo, hi = x0 - 4 * bw, x1 + 4 * bw
        rows.append((c, r.n, bw, lo, (hi - lo) / (n_grid - 1), x0, x1 - x0))
    grid = F.broadcast(spark.createDataFrame(rows, kind))  # one row a listed series
    place = (F.col("x") - F.col("lo")) / F.col("step")
    k = F.floor(place).cast("int")
    share = long.join(grid, "series").select("series", F.explode(F.array(F.struct(k.alias("k"), (1 - (place - k)).alias("w")),
                                                                        F.struct((k + 1).alias("k"), (place - k).alias("w")))).alias("p"))
    mass = share.groupBy("series", F.col("p.k").alias("k")).agg(F.sum("p.w").alias("w"))
    mass = mass.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("mass"))  # n_grid weights at most

    def smoothed(at: Column) -> Column:
        def add(total: Column, m: Column) -> Column:
            z = (at - m.k) * F.col("step") / F.col("bw")
            return total + m.w * F.exp(z * z * F.lit(-0.5))
        return F.aggregate("mass", F.lit(0.0), add) / (F.col("n") * F.col("bw") * F.lit(math.sqrt(2 * math.pi)))

    out = grid.join(mass, "series").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))))
    out = out.withColumn("g", F.col("x0") + F.col("j") * F.col("span") / F.lit(n_grid - 1))
    out = out.withColumn("at", (F.col("g") - F.col("lo")) / F.col("step")).withColumn("k", F.floor("at").cast("int"))
    low, high = smoothed(F.col("k")), smoothed(F.col("k") + 1)
    density = low + (F.col("at") - F.col("k")) * (high - low)
    return out.select("series", "j", "g", F.round(F.exp("g") if log else F.col("g")).alias("price"), density.alias("density"))
