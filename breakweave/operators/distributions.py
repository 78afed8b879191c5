"""Exact quantiles and kernel densities of very many values, without one task a key."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import dense_ids, prefix_sum

#: Bins of a bandwidth, and bandwidths to which the kernel reaches.
BINS, REACH = 8, 4


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, __v, __k``: the distinct values of each key, as doubles, with their counts. Null and NaN are left out."""
    x = df.select(*keys, F.col(value).cast("double").alias("__v"))
    return x.where(F.col("__v").isNotNull() & ~F.isnan("__v")).groupBy(*keys, "__v").agg(F.count("*").alias("__k"))


def counted_up(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` with ``upto``, the rows up to each value over all keys, ``before``, those before its key, and ``n``, the key's."""
    # dense ids put keys one after another, so one running count over all serves every key
    ranked = prefix_sum(dense_ids(counts, [*keys, "__v"], "i").withColumn("all", F.lit(0)), "all", "i", "__k", "upto")
    own = ranked.groupBy(*keys).agg(F.min(F.col("upto") - F.col("__k")).alias("before"), F.sum("__k").alias("n"))
    return ranked.join(own, keys)


def lower_medians(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, median``: the least value up to which half of a key's rows lie."""
    half = (F.col("upto") - F.col("before")) * 2 >= F.col("n")
    return counted_up(counts, keys).where(half).groupBy(*keys).agg(F.min("__v").alias("median"))


def quantiles_of_counts(counts: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """``keys, n, q0, q1, ...`` of :func:`value_counts`: quantiles interpolated between ranks, like SQL's ``percentile_cont``.

    Distinct values are dealt by range and counted up in buckets of their ranks, so neither a key with
    most of the rows nor one value of it is a task. A key without values has no row.
    """
    if not keys:
        return quantiles_of_counts(counts.withColumn("__one", F.lit(0)), ["__one"], probabilities).drop("__one")
    x = counted_up(counts, keys)
    last, first = F.col("upto") - F.col("before"), F.col("upto") - F.col("before") - F.col("__k")
    aggs, out = [], []
    for j, p in enumerate(probabilities):
        at = (F.col("n") - 1) * F.lit(float(p))
        for name, rank in ((f"lo{j}", F.floor(at)), (f"hi{j}", F.ceil(at))):
            aggs.append(F.max(F.when((first <= rank) & (rank < last), F.col("__v"))).alias(name))
        lo, hi = F.col(f"lo{j}"), F.col(f"hi{j}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"q{j}"))
    return x.groupBy(*keys, "n").agg(*aggs).select(*keys, "n", *out)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """See :func:`quantiles_of_counts`."""
    return quantiles_of_counts(value_counts(df, keys, value), keys, probabilities)


def density_mode(df: DataFrame, keys: list[str], value: str, around: float | None = 5.0) -> DataFrame:
    """``keys, median, bandwidth, mode``: where a Gaussian kernel density of the values is greatest, on a grid.

    Only values from ``median / around`` to ``median * around`` count, if given. The bandwidth is Silverman's
    rule of thumb: 0.9 n^(-1/5) times the lesser of the standard deviation and the interquartile range
    over 1.34; without spread it is 1. Values are split linearly between the two nearest points of a grid of
    an eighth of the bandwidth, and the histogram is convolved with the kernel up to four bandwidths away: work
    follows the number of filled bins, not of rows. Equal densities (to 1e-9 of a row) give the least point.
    """
    from ..plans.scratch import materialize

    counts = materialize(value_counts(df, keys, value), "value-counts")
    median = quantiles_of_counts(counts, keys, [0.5]).select(*keys, F.col("q0").alias("median"))
    near = counts.join(median, keys)
    if around:
        near = near.where(F.col("__v").between(F.col("median") / around, F.col("median") * around))
    near = materialize(near, "near-values")
    spread = quantiles_of_counts(near.select(*keys, "__v", "__k"), keys, [0.25, 0.75])
    # deviations from the median keep the sums of squares small
    d = F.col("__v") - F.col("median")
    s = near.groupBy(*keys, "median").agg(F.sum("__k").alias("m"), F.sum(F.col("__k") * d).alias("s1"), F.sum(F.col("__k") * d * d).alias("s2"))
    variance = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("m")) / F.nullif(F.col("m") - 1, F.lit(0))
    sd, iqr = F.sqrt(F.greatest(variance, F.lit(0.0))), (F.col("q1") - F.col("q0")) / 1.34
    least = F.when(iqr > 0, F.least(sd, iqr)).otherwise(sd)
    width = F.when(least > 0, 0.9 * least * F.pow(F.col("m").cast("double"), F.lit(-0.2))).otherwise(1.0)
    bands = s.join(spread, keys).select(*keys, width.alias("bandwidth"))
    x = near.join(bands, keys)
    at = F.col("__v") / (F.col("bandwidth") / BINS)
    part = at - F.floor(at)
    two = F.array(F.struct(F.floor(at).alias("bin"), (F.col("__k") * (1 - part)).alias("c")), F.struct((F.floor(at) + 1).alias("bin"), (F.col("__k") * part).alias("c")))
    bins = x.select(*keys, "median", "bandwidth", F.explode(two).alias("b")).groupBy(*keys, "median", "bandwidth", "b.bin").agg(F.sum("b.c").alias("c"))
    far = BINS * REACH
    kernel = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(math.exp(-0.5 * (j / BINS) ** 2)).alias("w")) for j in range(-far, far + 1)])
    spreads = bins.where("c > 0").select(*keys, "median", "bandwidth", "bin", "c", F.explode(kernel).alias("e"))
    grid = spreads.groupBy(*keys, "median", "bandwidth", (F.col("bin") + F.col("e.j")).alias("point")).agg(F.sum(F.col("c") * F.col("e.w")).alias("density"))
    best = grid.groupBy(*keys, "median", "bandwidth").agg(F.min(F.struct((-F.round("density", 9)).alias("d"), "point")).alias("b"))
    return best.select(*keys, "median", "bandwidth", (F.col("b.point") * F.col("bandwidth") / BINS).alias("mode"))
