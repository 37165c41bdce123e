"""Least squares from sufficient statistics: one pass over the rows, then closed forms or a small solve."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The second moments that a regression on two terms needs.
_PAIRS = {"c11": ("x1", "x1"), "c22": ("x2", "x2"), "c12": ("x1", "x2"), "c1y": ("x1", "y"), "c2y": ("x2", "y")}


def moments(x1: Column, x2: Column, y: Column) -> list[Column]:
    """Rows, means and centred sums of products that determine the regression of y on 1, x1, x2.

    Centred as they are gathered, so that a large mean costs no digits. Rows with a missing value must be out already.
    """
    of = {"x1": x1, "x2": x2, "y": y}
    n = F.count("*").cast("double")
    return [n.alias("n"), *(F.avg(v).alias(f"mean_{k}") for k, v in of.items()), *((F.covar_pop(of[a], of[b]) * n).alias(k) for k, (a, b) in _PAIRS.items())]


def slopes() -> dict[str, Column]:
    """beta1, beta2, alpha from the columns of ``moments``; null where the design has no full rank."""
    c = F.col
    det = c("c11") * c("c22") - c("c12") * c("c12")
    b1, b2 = F.try_divide(c("c1y") * c("c22") - c("c2y") * c("c12"), det), F.try_divide(c("c2y") * c("c11") - c("c1y") * c("c12"), det)
    return {"beta1": b1, "beta2": b2, "alpha": c("mean_y") - b1 * c("mean_x1") - b2 * c("mean_x2")}


def standardised(df: DataFrame, value: str, name: str, by: list[str], where: Column) -> DataFrame:
    """(value - mean) / sample deviation, both from the rows ``where`` holds (the development split) of each group."""
    scale = df.groupBy(*by).agg(F.avg(F.when(where, F.col(value))).alias("_center"), F.stddev_samp(F.when(where, F.col(value))).alias("_scale"))
    joined = df.join(scale, by) if by else df.crossJoin(F.broadcast(scale))  # one row
    return joined.withColumn(name, F.try_divide(F.col(value) - F.col("_center"), F.col("_scale"))).drop("_center", "_scale")


def residualized_two(features: DataFrame, y: str, x1: str, x2: str) -> DataFrame:
    """fitted, residual and residual_z by symbol, from a fit on the development split; nothing leaves Spark."""
    dev = F.col("sample_split") == "development"
    fit = features.where(dev).groupBy("symbol").agg(*moments(F.col(x1), F.col(x2), F.col(y))).select("symbol", *(v.alias(k) for k, v in slopes().items()))
    done = features.join(fit, "symbol").withColumn("fitted", F.col("alpha") + F.col("beta1") * F.col(x1) + F.col("beta2") * F.col(x2)).withColumn("residual", F.col(y) - F.col("fitted"))
    return standardised(done.drop("alpha", "beta1", "beta2"), "residual", "residual_z", ["symbol"], dev)


def residualized(features: DataFrame, y: str, terms: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The full design: (rows with fitted, residual, residual_z; coefficients by symbol and term).

    Each symbol's Gram matrix is aggregated in Spark; the driver gets terms^2 numbers a symbol and solves for the
    coefficients of least norm, so a design without full rank is no error.
    """
    k = len(terms)
    x = F.array(*terms)
    dev = F.col("sample_split") == "development"
    rows = features.withColumn("_x", x)
    sums = [F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("_x")[i] * F.col(y)).alias(f"v{i}") for i in range(k)]
    fits = []
    for row in rows.where(dev).groupBy("symbol").agg(*sums).collect():
        gram = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                gram[i, j] = gram[j, i] = row[f"g{i}_{j}"]
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))  # columns of like size, so that small ones aren't taken for none
        beta = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-12) @ (np.array([row[f"v{i}"] for i in range(k)]) / scale) / scale
        fits.append((row["symbol"], beta.tolist()))
    fit = features.sparkSession.createDataFrame(fits, "symbol string, _beta array<double>")
    done = rows.join(F.broadcast(fit), "symbol")  # a row a symbol
    done = done.withColumn("fitted", F.aggregate(F.zip_with("_x", "_beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).withColumn("residual", F.col(y) - F.col("fitted"))
    return standardised(done.drop("_x", "_beta"), "residual", "residual_z", ["symbol"], dev), fit.select("symbol", F.posexplode("_beta").alias("term", "coefficient"))


def diagnostics(rows: DataFrame, y: str) -> DataFrame:
    """How the fit of each symbol went: rows of either split, R squared, center and scale of the development residuals, mean and deviation of the scores out of sample."""
    dev, oos = F.col("sample_split") == "development", F.col("sample_split") == "oos"
    within = lambda split, c: F.when(split, F.col(c))
    total = F.var_pop(within(dev, y)) * F.count_if(dev)
    return rows.groupBy("symbol").agg(
        F.count_if(dev).alias("development_rows"),
        F.count_if(oos).alias("oos_rows"),
        (1 - F.try_divide(F.sum(within(dev, "residual") * within(dev, "residual")), total)).alias("development_r_squared"),
        F.avg(within(dev, "residual")).alias("development_residual_center"),
        F.stddev_samp(within(dev, "residual")).alias("development_residual_scale"),
        F.avg(within(oos, "residual_z")).alias("oos_residual_z_mean"),
        F.stddev_samp(within(oos, "residual_z")).alias("oos_residual_z_std"),
    )


def hac(df: DataFrame, y: str, x1: str, x2: str, order: str, lags: int, by: list[str] | None = None) -> DataFrame:
    """n, beta, se, t of x1 (and group columns): Bartlett-weighted covariance over ``lags`` positions in ``order``.

    A row's score for beta is one number, its centred terms weighed by the inverse moments times its residual. Each lag is an
    equi-join on the row's position, so the work is rows x (lags + 1), and one sum leaves it. Positions are numbered within a
    group; a series is as long as its calendar, not as its trades.
    """
    by = by or []
    ok = df.dropna(subset=[y, x1, x2])
    fit = ok.groupBy(*by).agg(*moments(F.col(x1), F.col(x2), F.col(y))).withColumns(slopes())
    at = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(order))
    joined = ok.join(F.broadcast(fit), by) if by else ok.crossJoin(F.broadcast(fit))  # a row a group
    c = F.col
    d1, d2 = c(x1) - c("mean_x1"), c(x2) - c("mean_x2")
    residual = c(y) - c("mean_y") - c("beta1") * d1 - c("beta2") * d2
    weighed = F.try_divide(c("c22") * d1 - c("c12") * d2, c("c11") * c("c22") - c("c12") * c("c12"))
    score = joined.select(*by, at.alias("_at"), (residual * weighed).alias("_u"))
    ahead = score.select(*by, c("_at").alias("_to"), c("_u").alias("_w"))
    lagged = score.withColumn("_lag", F.explode(F.sequence(F.lit(0), F.lit(lags)))).withColumn("_to", c("_at") - c("_lag")).join(ahead, [*by, "_to"])
    weight = (1 - c("_lag") / (lags + 1)) * F.when(c("_lag") == 0, 1.0).otherwise(2.0)
    spread = lagged.groupBy(*by).agg(F.sum(weight * c("_u") * c("_w")).alias("_var"))
    both = fit.join(spread, by) if by else fit.crossJoin(spread)
    return both.select(*by, c("n").cast("long").alias("n"), c("beta1").alias("beta"), F.sqrt("_var").alias("se")).withColumn("t", F.try_divide("beta", "se"))


def lead_design(flows: DataFrame, source: str, target: str, steps: int, same_day: bool, order: str = "bucket_start") -> DataFrame:
    """bucket_start, y (the target ``steps`` rows ahead), x1 (source), x2 (target now). With ``same_day``, without pairs that cross midnight."""
    w = Window.orderBy(order)  # one row a bucket: the calendar's length
    out = flows.select(F.col(order), F.lead(target, steps).over(w).alias("y"), F.lead(order, steps).over(w).alias("_to"), F.col(source).alias("x1"), F.col(target).alias("x2")).dropna()
    out = out.where(F.to_date(order) == F.to_date("_to")) if same_day else out
    return out.drop("_to")


def halved(design: DataFrame, order: str = "bucket_start") -> DataFrame:
    """``design`` with half: 1 up to the midpoint of time (itself included), 2 after it."""
    at = F.unix_micros(F.col(order).cast("timestamp"))
    bounds = design.agg(F.min(at).alias("_a"), F.max(at).alias("_b"))
    return design.crossJoin(F.broadcast(bounds)).withColumn("half", F.when(2 * at <= F.col("_a") + F.col("_b"), 1).otherwise(2)).drop("_a", "_b")


def half_betas(design: DataFrame, order: str = "bucket_start") -> DataFrame:
    """half (1, 2), beta."""
    return halved(design, order).groupBy("half").agg(*moments(F.col("x1"), F.col("x2"), F.col("y"))).withColumns(slopes()).select("half", F.col("beta1").alias("beta"))


def half_fits(design: DataFrame, lags: int, order: str = "bucket_start") -> DataFrame:
    """half, n, beta, se, t: each half with errors of its own."""
    return hac(halved(design, order), "y", "x1", "x2", order, lags, ["half"])


def shared_days(one: DataFrame, two: DataFrame, order: str = "bucket_start") -> DataFrame:
    """day, day_index: the days that both designs have, numbered from 0, so that one draw means the same days in either."""
    days = one.select(F.to_date(order).alias("day")).intersect(two.select(F.to_date(order).alias("day")))
    return days.withColumn("day_index", F.row_number().over(Window.orderBy("day")) - 1)  # a row a day


def day_bootstrap(design: DataFrame, draws: DataFrame, order: str = "bucket_start", days: DataFrame | None = None) -> DataFrame:
    """draw, beta of resampled days: ``draws`` (draw, day_index, times) meets one row of moments a day, not the observations. ``days`` (day, day_index) numbers the days; without it, those of the design are numbered in turn."""
    names = ("x1", "x2", "y")
    center = design.agg(*(F.avg(v).alias(f"_{v}") for v in names))  # a shift of all days moves no slope, and keeps the sums small
    moved = design.crossJoin(F.broadcast(center)).select(F.to_date(order).alias("day"), *((F.col(v) - F.col(f"_{v}")).alias(v) for v in names))
    sums = moved.groupBy("day").agg(*moments(*map(F.col, names)))
    sums = sums.withColumn("day_index", F.row_number().over(Window.orderBy("day")) - 1) if days is None else sums.join(F.broadcast(days), "day")
    whole = {k: F.col(k) + F.col("n") * F.col(f"mean_{a}") * F.col(f"mean_{b}") for k, (a, b) in _PAIRS.items()}
    drawn = sums.join(F.broadcast(draws), "day_index").groupBy("draw").agg(
        F.sum(F.col("n") * F.col("times")).alias("n"), *(F.sum(F.col("n") * F.col(f"mean_{v}") * F.col("times")).alias(f"s_{v}") for v in names), *(F.sum(v * F.col("times")).alias(k) for k, v in whole.items())
    )
    drawn = drawn.withColumns({f"mean_{v}": F.col(f"s_{v}") / F.col("n") for v in names})
    return drawn.withColumns({k: F.col(k) - F.col("n") * F.col(f"mean_{a}") * F.col(f"mean_{b}") for k, (a, b) in _PAIRS.items()}).withColumns(slopes()).select("draw", F.col("beta1").alias("beta"))
