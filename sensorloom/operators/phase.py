"""By how much one signal follows another: cross-correlation of series of any length, by sums of products over blocks.

Each block of a series is given a margin of its neighbours' rows as wide as
the longest lag and adds up its products lag by lag; Spark adds up the blocks.
What crosses a shuffle is one number for each block and lag.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import cells
from sensorloom.operators.ranks import joined
from sensorloom.sources.shared import materialise

#: Rows of a block; a longer lag makes blocks as long as itself.
BLOCK = 8192


def straightened(rows: DataFrame, by: list[str], place: str, signals: list[str]) -> DataFrame:
    """The signals less their straight lines over the place, over the deviation of what is left (+ 1e-12)."""
    i = F.col(place).cast("double")
    lines = rows.groupBy(*by).agg(*[f(F.col(s), i).alias(f"_{n}_{s}") for s in signals for n, f in (("slope", F.regr_slope), ("from", F.regr_intercept))])
    flat = joined(rows, materialise(lines, "lines"), by).withColumns({s: F.col(s) - F.coalesce(F.col(f"_slope_{s}") * i + F.col(f"_from_{s}"), F.lit(0.0)) for s in signals})
    scales = materialise(flat.groupBy(*by).agg(*[F.stddev_pop(s).alias(f"_std_{s}") for s in signals]), "scales")
    return joined(flat, scales, by).withColumns({s: F.col(s) / (F.col(f"_std_{s}") + 1e-12) for s in signals}).select(*rows.columns)


def _block_sums(pdf: pd.DataFrame, keys: list[str], most: int) -> pd.DataFrame:
    """The products of one block's commands with the rows of the first signal up to `most` places off, summed by lag."""
    pdf = pdf.sort_values("_place")
    own = pdf[pdf._own]
    first, last = int(own._place.iloc[0]), int(own._place.iloc[-1])
    f = np.zeros(last - first + 1 + 2 * most)
    f[pdf._place.to_numpy() - first + most] = pdf._f.to_numpy()
    sums = np.correlate(f, own._c.to_numpy(), "valid")
    out = pd.DataFrame({"lag": np.arange(-most, most + 1), "part": sums})
    return out.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "lag", "part"]]


def correlation(rows: DataFrame, by: list[str], place: str, f: str, c: str, most: int) -> DataFrame:
    """(by, lag, corr): the sum over i of f at i + lag times c at i, for lags up to `most` places either way.

    Places count from 0 without gaps in each series; keys are not null.
    """
    size = max(BLOCK, most)
    own, at = F.floor(F.col(place) / size), F.col(place) % size
    blocks = F.array_compact(F.array(own, F.when(at >= size - most, own + 1), F.when((at < most) & (own > 0), own - 1)))
    spread = rows.select(*by, F.col(place).alias("_place"), F.col(f).cast("double").alias("_f"), F.col(c).cast("double").alias("_c"), own.alias("_home"), F.explode(blocks).alias("_block")).withColumn("_own", F.col("_home") == F.col("_block"))
    # beyond a series' end there is no block of its own
    ends = materialise(rows.groupBy(*by).agg(F.floor(F.max(place) / size).alias("_end")), "ends")
    spread = joined(spread, ends, by).where("_block <= _end").drop("_home", "_end")
    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*by).dtypes)
    parts = spread.groupBy(*by, "_block").applyInPandas(partial(_block_sums, keys=by, most=most), f"{kinds}, lag long, part double")
    return parts.groupBy(*by, "lag").agg(F.sum("part").alias("corr"))


def phase_lags(df: DataFrame, by: list[str], order: list[str], f: str, c: str, dt: float, longest: float = 1.0) -> DataFrame:
    """(by, n, phase_lag_ms, area) for series of even steps dt.

    The lag is that of the largest correlation of the straightened signals
    (the first among equals), refined by the parabola through its neighbours;
    null below eight rows and where it lies at an edge.  The area sums the
    first signal, less its mean, by the sign of the second one's steps.
    """
    rows = materialise(cells.placed(cells.dealt(df.select(*by, *order, F.col(f).cast("double").alias(f), F.col(c).cast("double").alias(c)), by, order), by, order), "placed")
    sizes = materialise(rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(f).alias("_mean")), "sizes")
    most = round(longest / dt)
    corr = correlation(straightened(rows, by, "_place", [f, c]), by, "_place", f, c, most)
    within = joined(corr, sizes, by).where((F.col("n") >= 8) & (F.abs("lag") < F.col("n")))
    w = Window.partitionBy(*by).orderBy("lag")  # as many rows as there are lags
    around = within.withColumns({"_a": F.lag("corr").over(w), "_d": F.lead("corr").over(w)})
    top = around.groupBy(*by).agg(F.min_by(F.struct("lag", "_a", F.col("corr").alias("_b"), "_d"), F.struct(-F.col("corr"), "lag")).alias("_m")).select(*by, "_m.*")
    bend = F.col("_a") - 2 * F.col("_b") + F.col("_d")
    shift = F.coalesce(F.try_divide(0.5 * (F.col("_a") - F.col("_d")), bend), F.lit(0.0))
    inside = F.col("_a").isNotNull() & F.col("_d").isNotNull()
    lags = top.select(*by, F.when(inside, (F.col("lag") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift))) * dt * 1000).alias("phase_lag_ms"))
    stepped = joined(cells.scan(rows, by, order, lags={"_before": F.col(c)}), sizes, by)
    area = stepped.groupBy(*by).agg((F.sum((F.col(f) - F.col("_mean")) * F.signum(F.col(c) - F.col("_before"))) * dt).alias("area"))
    return joined(joined(sizes.drop("_mean"), lags, by, "left"), area, by)
