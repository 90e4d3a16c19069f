"""Kernel density, local quadratic fit and straight-line fit, all as aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.operators.running import lookup


def _grid(points: int, low: Column, high: Column) -> Column:
    """Array of (i, x): evenly spaced points from low to high."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.struct(i.alias("i"), (low + (high - low) * i / F.lit(points - 1)).alias("x")),
    )


def density(
    df: DataFrame,
    strata: Sequence[str],
    value: str,
    limits: tuple[float, float] = (0.0, 1.0),
    points: int = 512,
    bins: int = 2048,
) -> DataFrame:
    """Gaussian kernel density on a grid over ``limits``; values outside are dropped first.

    The width is 0.9 * min(sd, IQR / 1.34) * n^(-1/5), of the values as they are. Each value
    is then shared linearly between the two of ``bins`` evenly spaced places beside it, so a
    stratum meets the grid with ``bins`` rows at most, however many values it has. That adds
    less than a quarter of the squared spacing to the squared width.
    """
    low, high = limits
    kept = df.select(*strata, F.col(value).cast("double").alias("_v")).filter(F.col("_v").between(low, high))
    stats = kept.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("_v").alias("_least"),
        F.stddev_samp("_v").alias("_sd"),
        F.percentile("_v", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"),
    )
    iqr = (F.col("_q")[1] - F.col("_q")[0]) / 1.34
    narrow = F.least(F.col("_sd"), iqr)
    # All values nearly equal: fall back to the sd, then to the value itself, then to 1.
    usable = F.coalesce(
        F.when(narrow > 0, narrow),
        F.when(F.col("_sd") > 0, F.col("_sd")),
        F.when(F.col("_least") != 0, F.abs(F.col("_least"))),
        F.lit(1.0),
    )
    stats = stats.select(*strata, "n", (usable * 0.9 * F.pow(F.col("n"), F.lit(-0.2))).alias("bw"))
    step = (high - low) / (bins - 1)
    place = (F.col("_v") - low) / step
    below = F.least(F.floor(place), F.lit(bins - 2))
    shares = F.array(
        F.struct(below.alias("_bin"), (below + 1 - place).alias("_w")),
        F.struct((below + 1).alias("_bin"), (place - below).alias("_w")),
    )
    binned = kept.select(*strata, F.inline(shares)).groupBy(*strata, "_bin").agg(F.sum("_w").alias("_w"))
    spots = lookup(binned, stats, strata).select(
        *strata, (low + F.col("_bin") * step).alias("_v"), "_w", "n", "bw",
        F.inline(_grid(points, F.lit(low), F.lit(high))),
    )
    z = (F.col("x") - F.col("_v")) / F.col("bw")
    kernel = F.exp(-0.5 * z * z) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return spots.groupBy(*strata, "i", "x").agg(F.sum(F.col("_w") * kernel).alias("density")).drop("i")


def local_fit(
    df: DataFrame,
    strata: Sequence[str],
    x: str,
    y: str,
    x_limits: tuple[float, float] = (0.1, 1000.0),
    y_limits: tuple[float, float] = (0.0, 1.0),
    points: int = 80,
) -> DataFrame:
    """Local quadratic fit of y on log10(x) with tricube weights over all points of a stratum (span 1).

    Points outside the limits are dropped before the fit. Each row is sent to the
    grid points as eight weighted sums that are added up before the shuffle.
    """
    kept = (
        df.filter(F.col(x).between(*x_limits) & F.col(y).between(*y_limits))
        .select(*strata, F.log10(F.col(x)).alias("_x"), F.col(y).cast("double").alias("_y"))
    )
    span = kept.groupBy(*strata).agg(F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    rows = lookup(kept, span, strata).select(
        *strata, "_x", "_y", "_low", "_high",
        F.inline(_grid(points, F.col("_low"), F.col("_high"))),
    )
    reach = F.greatest(F.col("x") - F.col("_low"), F.col("_high") - F.col("x"))
    u = F.col("_x") - F.col("x")
    closeness = 1 - F.pow(F.abs(u) / reach, 3)
    weight = F.when(F.abs(u) < reach, F.pow(closeness, 3)).otherwise(0.0)
    rows = rows.select(*strata, "i", F.col("x").alias("log10_x"), "_y", u.alias("_u"), weight.alias("_w"))
    sums = [F.sum(F.col("_w") * F.pow(F.col("_u"), k)).alias(f"_s{k}") for k in range(5)]
    sums += [F.sum(F.col("_w") * F.col("_y") * F.pow(F.col("_u"), k)).alias(f"_t{k}") for k in range(3)]
    fitted = rows.groupBy(*strata, "i", "log10_x").agg(*sums)
    s0, s1, s2, s3, s4 = (F.col(f"_s{k}") for k in range(5))
    t0, t1, t2 = (F.col(f"_t{k}") for k in range(3))
    # Value at u = 0 of the weighted quadratic, by Cramer's rule.
    top = t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)
    bottom = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    return fitted.select(*strata, "log10_x", F.try_divide(top, bottom).alias("fit"))


EXACT_T_DEGREES = 200


def t_quantile(degrees: int, tail: float = 0.975) -> float:
    """Quantile of Student's t for whole degrees of freedom, by bisection on its finite series."""
    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        if _t_cdf(middle, degrees) < tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def _t_cdf(t: float, degrees: int) -> float:
    theta = math.atan(t / math.sqrt(degrees))
    term, total = (math.cos(theta), math.cos(theta)) if degrees % 2 else (1.0, 1.0)
    for k in range(3 if degrees % 2 else 2, degrees - 1, 2):
        term *= (k - 1) / k * math.cos(theta) ** 2
        total += term
    if degrees % 2 == 0:
        return 0.5 + 0.5 * math.sin(theta) * total
    inner = theta if degrees == 1 else theta + math.sin(theta) * total
    return 0.5 + inner / math.pi


def t_975(degrees: Column) -> Column:
    """97.5 % quantile of Student's t: exact up to 200 degrees of freedom, expanded in 1/df beyond."""
    exact = F.array(*[F.lit(t_quantile(d)) for d in range(1, EXACT_T_DEGREES + 1)])
    z = 1.959963984540054
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    expanded = z + g1 / degrees + g2 / (degrees * degrees) + g3 / (degrees * degrees * degrees)
    return F.when(degrees < 1, F.lit(None)).when(
        degrees <= EXACT_T_DEGREES, F.try_element_at(exact, degrees.cast("int"))
    ).otherwise(expanded)


def line_fit(
    df: DataFrame,
    strata: Sequence[str],
    x: str,
    y: str,
    x_limits: tuple[float, float] = (0.1, 1000.0),
    y_limits: tuple[float, float] = (0.0, 1.0),
    points: int = 80,
) -> DataFrame:
    """Straight line of y on log10(x) per stratum on a grid, with its 95 % band."""
    kept = (
        df.filter(F.col(x).between(*x_limits) & F.col(y).between(*y_limits))
        .select(*strata, F.log10(F.col(x)).alias("_x"), F.col(y).cast("double").alias("_y"))
    )
    fit = kept.groupBy(*strata).agg(
        F.count(F.lit(1)).alias("_n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_intercept("_y", "_x").alias("intercept"),
        F.regr_avgx("_y", "_x").alias("_mean"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
        F.regr_sxy("_y", "_x").alias("_sxy"),
        F.min("_x").alias("_low"),
        F.max("_x").alias("_high"),
    )
    degrees = (F.col("_n") - 2).cast("double")
    left_over = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    fit = fit.withColumns({
        "_sigma": F.when(degrees >= 1, F.sqrt(left_over / degrees)),
        "_t": t_975(degrees),
    })
    grid = fit.select("*", F.inline(_grid(points, F.col("_low"), F.col("_high"))))
    centre = F.col("intercept") + F.col("slope") * F.col("x")
    distance = F.col("x") - F.col("_mean")
    half = F.col("_t") * F.col("_sigma") * F.sqrt(1 / F.col("_n") + F.try_divide(distance * distance, F.col("_sxx")))
    return grid.select(
        *strata,
        F.col("x").alias("log10_x"),
        "slope",
        "intercept",
        centre.alias("fit"),
        (centre - half).alias("lower"),
        (centre + half).alias("upper"),
    )
