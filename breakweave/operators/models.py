"""Statistics and models of counts, copy number, rates and adapters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import log_nbinom_pmf
from .distributions import lower_medians
from .joins import overlap_fraction
from .ordered import dense_ids, prefix_sum, run_length_segments


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def quadratic_fit(df: DataFrame, keys: list[str], x: str, y: str, w: str) -> DataFrame:
    """``keys, b0, b1, b2``: weighted least squares of y on 1, x, x^2, from summed powers and Cramer's rule."""
    X, Y, W = F.col(x), F.col(y), F.col(w)
    s = df.groupBy(*keys).agg(
        *[F.sum(W * F.pow(X, F.lit(float(k)))).alias(f"s{k}") for k in range(5)], *[F.sum(W * Y * F.pow(X, F.lit(float(k)))).alias(f"t{k}") for k in range(3)]
    )
    m = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    d = det3(m)

    def solved(k: int) -> Column:
        return det3([[F.col(f"t{i}") if j == k else m[i][j] for j in range(3)] for i in range(3)]) / F.nullif(d, F.lit(0.0))

    return s.select(*keys, *[solved(k).alias(f"b{k}") for k in range(3)])


def gc_bias_fit(df: DataFrame, keys: list[str], gc: str = "gc_index", n: str = "n", most_theta: float = 10_000.0) -> DataFrame:
    """Per key and GC percent: rows, mean and dispersion of counts, and the quadratic fit of the means.

    Dispersion by moments: mean^2 / (variance - mean), at most ``most_theta``. Strata of fewer than five rows weigh
    a tenth.
    """
    strata = df.groupBy(*keys, gc).agg(F.count("*").alias("n_bins"), F.avg(n).alias("mean"), F.var_samp(n).alias("var"))
    theta = F.when(F.col("var") > F.col("mean"), F.least(F.lit(most_theta), F.col("mean") * F.col("mean") / (F.col("var") - F.col("mean")))).otherwise(most_theta)
    strata = strata.withColumn("theta", theta).withColumn("weight", F.when(F.col("n_bins") < 5, F.col("n_bins") / 10).otherwise(F.col("n_bins").cast("double")))
    fit = quadratic_fit(strata, keys, gc, "mean", "weight")
    x = F.col(gc).cast("double")
    return strata.join(fit, keys).withColumn("fitted", F.col("b0") + F.col("b1") * x + F.col("b2") * x * x).drop("weight", "var")


def gc_normalize(counts: DataFrame, model: DataFrame, keys: list[str], gc: str = "gc_index") -> DataFrame:
    """``cn``: counts over the reads of one allele that the model predicts; GC is held to the fitted range.

    The predictions stand for two alleles.
    """
    limits = model.groupBy(*keys).agg(F.min(gc).alias("__lo"), F.max(gc).alias("__hi"), F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.first("b2").alias("b2"))
    x = counts.join(limits, keys).withColumn("__g", F.greatest("__lo", F.least("__hi", gc)).cast("double"))
    per_allele = (F.col("b0") + F.col("b1") * F.col("__g") + F.col("b2") * F.col("__g") * F.col("__g")) / 2
    return x.withColumn("cn", F.col("n") / F.nullif(per_allele, F.lit(0.0))).drop("__lo", "__hi", "__g", "b0", "b1", "b2")


def count_percentile(df: DataFrame, n: str, mu: str, theta: str) -> DataFrame:
    """``percentile``: P(X <= n) of a negative binomial, computed once for each distinct (n, mu, theta) by the
    recurrence of its terms."""
    k, m, t = F.col(n).cast("int"), F.col(mu), F.col(theta)
    first = F.pow(t / (t + m), t)
    start = F.struct(first.alias("p"), first.alias("c"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * (i - 1 + t) / i * m / (t + m)
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"))

    terms = F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    cases = df.select(n, mu, theta).distinct().withColumn("percentile", F.least(F.lit(1.0), F.aggregate(terms, start, step, lambda acc: acc["c"])))
    return df.join(cases, [n, mu, theta])


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, tie: str) -> DataFrame:
    """The least value at which the cumulative weight reaches half of the whole."""
    w = Window.partitionBy(*keys)
    x = df.withColumn("__c", F.sum(weight).over(w.orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0))).withColumn("__s", F.sum(weight).over(w))
    return x.where(F.col("__c") * 2 >= F.col("__s")).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def batch_shape(df: DataFrame, window: list[str]) -> DataFrame:
    """``shape``: weighted median over cells of CN over the sample's mode, weight 2^-(power - least power), held to 1/3 .. 3.

    Input: window columns, ``cell_id, cn, mode_cn, power``.
    """
    least = F.min("power").over(Window.partitionBy(*window))
    x = df.where("mode_cn > 0").withColumn("ratio", F.col("cn") / F.col("mode_cn")).withColumn("w", F.pow(F.lit(2.0), -(F.col("power") - least).cast("double")))
    m = weighted_median(x, window, "ratio", "w", "cell_id")
    return m.withColumn("shape", F.greatest(F.lit(1 / 3), F.least(F.lit(3.0), F.col("weighted_median")))).drop("weighted_median")


def batch_median_percentile(df: DataFrame, bins: list[str]) -> DataFrame:
    """Median percentile of each bin over samples. Input of :func:`count_percentile`."""
    return df.groupBy(*bins).agg(F.median("percentile").alias("median_percentile"), F.count("*").alias("n_samples"))


def sample_profile(df: DataFrame, window: list[str], cn: str, ploidy: int) -> DataFrame:
    """The most frequent copy number of each window; ties go to the one nearest the ploidy, then the lower."""
    n = df.groupBy(*window, cn).agg(F.count("*").alias("n"))
    return n.groupBy(*window).agg(F.min(F.struct((-F.col("n")).alias("a"), F.abs(F.col(cn) - ploidy).alias("b"), F.col(cn).alias("mode_cn"))).alias("m")).select(*window, "m.mode_cn")


def window_power(df: DataFrame, keys: list[str], order: str, powers: int, n_sd: float, factor: float, max_zero: float) -> DataFrame:
    """The least power p at which windows of 2^p bins have a mean count of (n_sd / (factor - 1))^2 and few zeros; the greatest where none does."""
    i = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    x = df.withColumn("__i", i).withColumn("power", F.explode(F.sequence(F.lit(0), F.lit(powers))))
    w = x.groupBy(*keys, "power", F.floor(F.col("__i") / F.pow(F.lit(2.0), F.col("power").cast("double"))).alias("w")).agg(F.sum("n").alias("n"))
    s = w.groupBy(*keys, "power").agg(F.avg("n").alias("mean"), F.avg((F.col("n") == 0).cast("double")).alias("zeros"))
    ok = (F.col("mean") >= (n_sd / (factor - 1)) ** 2) & (F.col("zeros") <= max_zero)
    return s.groupBy(*keys).agg(F.coalesce(F.min(F.when(ok, F.col("power"))), F.lit(powers)).alias("power"))


def chromosome_shape(df: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """``shape``: centred rolling mean of a value over its mean, so that totals are kept."""
    w = Window.partitionBy(*keys)
    return df.withColumn("shape", F.avg(value).over(w.orderBy(order).rowsBetween(-half, half)) / F.nullif(F.avg(value).over(w), F.lit(0.0)))


def replication_mixture(df: DataFrame, cell: str, steps: int = 20) -> DataFrame:
    """``fraction_s, rmsd`` of each cell: of a fixed grid, the share of replicating cells whose mixture of three
    negative binomials (unreplicated, half, replicated) comes nearest to the histogram of counts.

    The grid and the histogram are small tables of one cell each.
    """
    hist = df.groupBy(cell, "n").agg(F.count("*").alias("k"))
    w = Window.partitionBy(cell)
    hist = hist.withColumn("density", F.col("k") / F.sum("k").over(w)).withColumn("mean", F.sum(F.col("k") * F.col("n")).over(w) / F.sum("k").over(w))
    grid = hist.withColumn("fraction_s", F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: i / steps)))
    base = F.col("mean") / (1 + F.col("fraction_s"))
    p = lambda m: F.exp(log_nbinom_pmf(F.col("n").cast("double"), m, F.lit(20.0)))
    f = F.col("fraction_s")
    model = (1 - f) * (1 - f) * p(base) + 2 * f * (1 - f) * p(base * 1.5) + f * f * p(base * 2)
    r = grid.withColumn("d", F.col("density") - model).groupBy(cell, "fraction_s").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmsd"))
    return r.groupBy(cell).agg(F.min(F.struct("rmsd", "fraction_s")).alias("m")).select(cell, "m.fraction_s", "m.rmsd")


def replication_state_gc(df: DataFrame, states: list[int], gc: str = "gc_index") -> DataFrame:
    """``state, gc, p``: share of each GC percent within a replication state, 0 where there are none."""
    n = df.groupBy("state", gc).agg(F.count("*").alias("n"))
    return n.where(F.col("state").isin(states)).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state"))).drop("n")


#: Which states of the copy-neutral tables, in which shares, stand for a copy number and its number of
#: replicated alleles, by ploidy. ``any`` is every replicated state together, ``all`` all windows.
STATE_MIXES = {
    1: {
        (0, 0): {"all": 1.0},
        (1, 0): {"0": 1.0}, (1, 1): {"1": 1.0},
        (2, 0): {"0": 1.0}, (2, 1): {"0": 1 / 2, "1": 1 / 2}, (2, 2): {"1": 1.0},
        (3, 0): {"0": 1.0}, (3, 1): {"0": 2 / 3, "1": 1 / 3}, (3, 2): {"0": 1 / 3, "1": 2 / 3}, (3, 3): {"1": 1.0},
        (4, 0): {"0": 1.0}, (4, 1): {"0": 3 / 4, "1": 1 / 4}, (4, 2): {"0": 1 / 2, "1": 1 / 2}, (4, 3): {"0": 1 / 4, "1": 3 / 4}, (4, 4): {"1": 1.0},
    },
    2: {
        (0, 0): {"all": 1.0},
        (1, 0): {"0": 1.0}, (1, 1): {"any": 1.0},
        (2, 0): {"0": 1.0}, (2, 1): {"1": 1.0}, (2, 2): {"2": 1.0},
        (3, 0): {"0": 1.0}, (3, 1): {"0": 1 / 2, "1": 1 / 2}, (3, 2): {"1": 1 / 4, "2": 3 / 4}, (3, 3): {"2": 1.0},
        (4, 0): {"0": 1.0}, (4, 1): {"0": 1 / 2, "1": 1 / 2}, (4, 2): {"1": 1.0}, (4, 3): {"1": 1 / 2, "2": 1 / 2}, (4, 4): {"2": 1.0},
    },
}


def replication_state_tables(df: DataFrame, keys: list[str], gc: str = "gc_index", replicated: str = "nar", ploidy: int = 2, least: float = 0.01) -> DataFrame:
    """``keys, cn, nar, gc, p``: how likely each GC percent is in a state of ``cn`` copies, ``nar`` of them replicated.

    Input: copy-neutral windows with their number of replicated alleles, 0 to ``ploidy``. Its tables are
    shares of at least ``least``; those of other copy numbers lie between them (``STATE_MIXES``), scaled to
    sum to 1 over the key's percentages. In a diploid key without windows of one replicated allele that table
    lies halfway between the other two; any other state without windows is ``least`` throughout.
    """
    states = [str(j) for j in range(ploidy + 1)]
    counts = df.where(F.col(replicated).isNotNull() & F.col(gc).isNotNull()).groupBy(*keys, gc).agg(
        *[F.sum((F.col(replicated) == j).cast("int")).alias(f"n_{j}") for j in states], F.count("*").alias("n_all")
    )
    counts = counts.withColumn("n_any", F.col("n_all") - F.col("n_0"))
    names = [*states, "all", "any"]
    w = Window.partitionBy(*keys)  # one row a percentage
    share = lambda j: F.greatest(F.lit(least), F.coalesce(F.col(f"n_{j}") / F.nullif(F.sum(f"n_{j}").over(w), F.lit(0)), F.lit(0.0)))
    x = counts.select(*keys, gc, *[share(j).alias(f"p_{j}") for j in names], *[F.sum(f"n_{j}").over(w).alias(f"t_{j}") for j in states])
    if ploidy == 2:
        half = (F.col("p_0") + F.col("p_2")) / 2
        x = x.withColumn("p_1", F.when(F.col("t_1") == 0, half / F.sum(half).over(w)).otherwise(F.col("p_1")))
    mixed = lambda mix: sum(F.col(f"p_{j}") * v for j, v in mix.items())
    rows = [F.struct(F.lit(cn).alias("cn"), F.lit(nar).alias("nar"), mixed(mix).alias("p"), F.lit(len(mix) > 1).alias("is_mix")) for (cn, nar), mix in STATE_MIXES[ploidy].items()]
    x = x.select(*keys, gc, F.explode(F.array(*rows)).alias("s")).select(*keys, gc, "s.*")
    total = F.sum("p").over(Window.partitionBy(*keys, "cn", "nar"))
    return x.select(*keys, "cn", "nar", gc, F.when(F.col("is_mix"), F.col("p") / total).otherwise(F.col("p")).alias("p"))


def welch_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """Welch's t and its degrees of freedom for two groups, the lesser name first."""
    s = df.groupBy(group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n"))
    x = s.agg(F.array_sort(F.collect_list(F.struct(group, "m", "v", "n"))).alias("g"))  # two rows
    a, b = F.col("g")[0], F.col("g")[1]
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    return x.select((a["m"] - b["m"]).alias("difference"), ((a["m"] - b["m"]) / F.sqrt(va + vb)).alias("t"), ((va + vb) * (va + vb) / (va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1))).alias("df"))


def rate_comparison(df: DataFrame, group: str, n: str, coverage: str) -> DataFrame:
    """Poisson regression of counts on group with log coverage as offset: ``term, estimate`` (log rates).

    For a single factor the maximum-likelihood rates are sums of counts over sums of coverage.
    ``dispersion`` is Pearson's, by which standard errors are widened.
    """
    rates = df.groupBy(group).agg(F.sum(n).alias("n"), F.sum(coverage).alias("c"), F.count("*").alias("k")).withColumn("rate", F.col("n") / F.col("c"))
    x = df.select(group, F.col(n).alias("y"), F.col(coverage).alias("cov")).join(rates.select(group, "rate"), group)
    mu = F.col("rate") * F.col("cov")
    chi = x.groupBy().agg(F.sum((F.col("y") - mu) * (F.col("y") - mu) / mu).alias("chi"), F.count("*").alias("m"), F.count_distinct(group).alias("g"))
    out = rates.crossJoin(F.broadcast(chi))  # one row
    return out.select(F.col(group), F.log("rate").alias("estimate"), (F.col("chi") / F.nullif(F.col("m") - F.col("g"), F.lit(0))).alias("dispersion"), F.sqrt(F.col("chi") / F.nullif(F.col("m") - F.col("g"), F.lit(0)) / F.col("n")).alias("std_error"))


def adapter_classifier(train: DataFrame, features: list[str], label: str, max_iter: int = 20):
    """A fitted pipeline of scaled logistic regression on adapter scores against matched controls."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=features, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        LogisticRegression(labelCol=label, maxIter=max_iter, regParam=0.001),
    ]
    return Pipeline(stages=stages).fit(train)


#: Resampling weights that a task adds up before it hands them on.
RESAMPLED = 4_000_000


def bootstrap_median(df: DataFrame, group: str, id_col: str, value: str, rounds: int, seed: str = "0") -> DataFrame:
    """``group, low, median, high``: limits (2.5 and 97.5 percent) of medians over hash-seeded Poisson resamples.

    A row's weight in a round is 0 to 4 by inverting a Poisson distribution of mean 1. A row carries its
    weights of all rounds as one array; arrays are added up by value inside each task, so what is shuffled
    follows the number of distinct values and rounds, not that of rows. Null values take no part.
    """
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462]

    def weight(r: Column) -> Column:
        u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"), r.cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)
        return sum((u > c).cast("int") for c in cuts)

    x = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("__v"), F.transform(F.sequence(F.lit(1), F.lit(rounds)), weight).alias("w"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = [group, "__v", "w"], None
        for batch in batches:
            part = pa.table({group: batch.column(0), "__v": batch.column(1)}).append_column("at", pa.array(np.arange(batch.num_rows)))
            w = batch.column(2).flatten().to_numpy().reshape(-1, rounds).astype(np.int64)
            if held is not None:
                part = pa.concat_tables([held[0].append_column("at", pa.array(np.arange(held[0].num_rows) + len(w))), part])
                w = np.concatenate([w, held[1]])
            same = part.group_by([group, "__v"]).aggregate([("at", "list")])
            lists = same.column("at_list").combine_chunks()
            order, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            held = same.select([group, "__v"]), np.add.reduceat(w[order], starts, axis=0) if len(order) else w[:0]
            if held[1].size > RESAMPLED:
                yield from _weights(held, names)
                held = None
        if held is not None:
            yield from _weights(held, names)

    kinds = dict(df.dtypes)
    summed = x.mapInArrow(add_up, f"{group} {kinds[group]}, __v double, w array<long>")
    y = summed.select(group, "__v", F.posexplode("w").alias("round", "k")).where("k > 0").groupBy(group, "round", "__v").agg(F.sum("k").alias("__k"))
    m = lower_medians(y, [group, "round"])
    return m.groupBy(group).agg(F.percentile("median", F.lit(0.025)).alias("low"), F.percentile("median", F.lit(0.5)).alias("median"), F.percentile("median", F.lit(0.975)).alias("high"))


def _weights(held: tuple[pa.Table, np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    keys, w = held
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
    yield from pa.table([*keys.columns, lists], names).to_batches()


def rank_sum(df: DataFrame, group: str, value: str) -> DataFrame:
    """Rank sums with mid-ranks of ties: ``group, n, rank_sum``. Ranks come from counts of distinct values."""
    n = dense_ids(df.groupBy(value).agg(F.count("*").alias("k")), [value], "i")
    # the running count by the rank of the value, in buckets of ranks: no task takes all values
    ranks = prefix_sum(n.withColumn("all", F.lit(0)), "all", "i", "k", "upto").select(value, (F.col("upto") - F.col("k") + (F.col("k") + 1) / 2).alias("mid"))
    return df.groupBy(group, value).agg(F.count("*").alias("k")).join(ranks, value).groupBy(group).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("mid")).alias("rank_sum"))


def cell_quality(df: DataFrame, most: float) -> DataFrame:
    """Weighted sd of CN over allele counts per cell, and whether the cell is kept. Input: ``cell_id, n_alleles, cn``."""
    s = df.groupBy("cell_id", "n_alleles").agg(F.stddev_samp("cn").alias("sd"), F.count("*").alias("k")).where("sd is not null")
    q = s.groupBy("cell_id").agg((F.sum(F.col("sd") * F.col("k")) / F.sum("k")).alias("cn_sd"))
    return q.withColumn("is_kept", F.col("cn_sd") <= most)


def cnv_calls(df: DataFrame, reference: str, min_windows: int) -> DataFrame:
    """Runs of equal difference between a cell's CN and a reference that are not 0: gains and losses."""
    x = df.withColumn("diff", F.col("cn") - F.col(reference))
    runs = run_length_segments(x, ["cell_id", "chrom"], "window_n", "diff")
    return runs.where((F.col("diff") != 0) & (F.col("n") >= min_windows)).withColumn("type", F.when(F.col("diff") > 0, "gain").otherwise("loss"))


def suppress_false_cnvs(calls: DataFrame, other: DataFrame, keys: list[str], min_overlap: float, whole: Column, min_windows: int) -> DataFrame:
    """``is_kept``: calls that another model supports, or that span a chromosome, or more than ``min_windows`` windows."""
    x = overlap_fraction(calls, other, keys)
    return x.withColumn("is_kept", (F.col("overlap") >= min_overlap) | whole | (F.col("last") - F.col("first") + 1 > min_windows))


def composite_cn(df: DataFrame, batch: DataFrame, bins: list[str]) -> DataFrame:
    """Copy number after batch correction: counts over the batch's expectation for the bin, times two."""
    return df.join(batch, bins).withColumn("cn", 2 * F.col("n") / F.nullif(F.col("expected"), F.lit(0.0)))
