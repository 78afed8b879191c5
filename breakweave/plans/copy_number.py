"""Bin counts of single cells to copy numbers and copy-number variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import log_nbinom_pmf
from ..operators.loess import local_shape
from ..operators.models import cnv_calls, gc_bias_fit
from ..operators.ordered import viterbi_cn
from .scratch import materialize


def cell_copy_numbers(counts: DataFrame, most: int = 4, theta: float = 4.0, least_mu: float = 0.05, persistence: float = 0.99) -> DataFrame:
    """``cell_id, chrom, bin_n, cn``: the copy-number path of each cell's chromosomes; null where there is one bin only.

    ``counts``: cell_id, chrom, bin_n, n, gc_index. Each cell's GC bias is fitted first; a state's
    expected count is its alleles times the fitted count of one, which is half of that of two.
    """
    model = gc_bias_fit(counts, ["cell_id"]).select("cell_id", "gc_index", "fitted")
    x = counts.join(model, ["cell_id", "gc_index"])
    n, one = F.col("n").cast("double"), F.col("fitted") / 2
    emissions = F.array(*[log_nbinom_pmf(n, F.greatest(F.lit(least_mu), k * one), F.lit(theta)) for k in range(most + 1)])
    return viterbi_cn(x.withColumn("e", emissions), ["cell_id", "chrom"], "bin_n", "e", persistence).withColumnRenamed("state", "cn")


def shaped_counts(counts: DataFrame, cn: DataFrame, ploidy: int, span: float = 1.0) -> DataFrame:
    """``counts`` with ``n`` divided by the trend of its cell and chromosome, total kept.

    The trend is that of counts brought to ``ploidy`` by the copy numbers found so far, so that it does not take
    in a gain or loss; bins without a copy number, or with none, have no weight in it.
    """
    key = ["cell_id", "chrom"]
    level = F.when(F.col("cn") > 0, F.col("n") * ploidy / F.col("cn"))
    x = counts.join(cn.select(*key, "bin_n", "cn"), [*key, "bin_n"], "left").withColumn("level", level)
    shape = local_shape(x.select(*key, "bin_n", "level"), key, "bin_n", "level", span).select(*key, "bin_n", "shape")
    x = counts.join(shape, [*key, "bin_n"])
    w = Window.partitionBy(*key)  # the bins of one chromosome of one cell
    flat = F.when(F.col("shape") > 0, F.col("n") / F.col("shape")).otherwise(F.col("n"))
    total = F.sum("n").over(w) / F.nullif(F.sum("flat").over(w), F.lit(0.0))
    return x.withColumn("flat", flat).withColumn("n", F.coalesce(F.col("flat") * total, F.col("n").cast("double"))).select(*counts.columns)


def call_cnvs(counts: DataFrame, ploidy: int = 2, min_bins: int = 2, shape_span: float | None = None, **model) -> DataFrame:
    """``cell_id, chrom, diff, first, last, n, type``: runs of at least ``min_bins`` bins whose copy number differs from
    ``ploidy``. See :func:`cell_copy_numbers` for the rest.

    With ``shape_span`` the copy numbers are found twice: the second time from counts without the trends of
    chromosomes, which the first ones leave (see :func:`shaped_counts`). A trend so strong that the first
    pass takes it for copy numbers stays."""
    cn = materialize(cell_copy_numbers(counts, **model).where("cn is not null"), "copy-numbers")
    if shape_span is not None:
        flat = materialize(shaped_counts(counts, cn, ploidy, shape_span), "shaped-counts")
        cn = materialize(cell_copy_numbers(flat, **model).where("cn is not null"), "copy-numbers")
    runs = cn.withColumnRenamed("bin_n", "window_n").withColumn("ploidy", F.lit(ploidy))
    return cnv_calls(runs, "ploidy", min_bins)
