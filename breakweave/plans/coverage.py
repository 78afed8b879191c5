"""Molecules to a coverage map: depth changes, and mean depth of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import SWEEP, chunk_mean_coverage, coverage_steps, expand_spans


def coverage_map(molecules: DataFrame, chunk: int = SWEEP) -> DataFrame:
    """``chrom, start0, end1, depth, chunk_n, mean_depth``: stretches of equal depth above 0, with the mean depth of
    the chunk that each starts in.

    Molecules give their covered stretches (see :func:`expand_spans`), these the depth. The sweep is
    carried out once; chunks are cut from the steps.
    """
    from .scratch import materialize

    steps = materialize(coverage_steps(expand_spans(molecules)), "coverage-steps")
    chunks = chunk_mean_coverage(steps, chunk)
    return steps.withColumn("chunk_n", F.floor(F.col("start0") / chunk)).join(chunks, ["chrom", "chunk_n"]).select(
        "chrom", "start0", "end1", "depth", "chunk_n", "mean_depth"
    )
