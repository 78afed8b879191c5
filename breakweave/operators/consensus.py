"""Consensus sequences of read families: by strand, then of both strands, with ambiguity codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import base_rows
from .aggregates import families
from .ordered import downsample_per_group

#: Codes of sets of bases, in the order of the sums of A = 1, C = 2, G = 4, T = 8.
CODES = "-ACMGRSVTWYHKDBN"


def base_set(base: Column) -> Column:
    """The sum of the bases that a code stands for; 0 for anything else."""
    return F.greatest(F.lit(0), F.instr(F.lit(CODES), base) - 1)


def code_of(bases: Column) -> Column:
    """The code of a set of bases; N where there is none."""
    return F.when(bases == 0, "N").otherwise(F.substr(F.lit(CODES), bases + 1, F.lit(1)))


def merge_codes(a: Column, b: Column) -> Column:
    """Two aligned sequences as one: at each position the code of all bases that either has. What one has
    beyond the end of the other is left out."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    both = lambda i: base_set(F.substr(a, i, F.lit(1))).bitwiseOR(base_set(F.substr(b, i, F.lit(1))))
    return F.array_join(F.transform(at, lambda i: code_of(both(i))), "")


def consensus_quality(seq: Column, phred: int) -> Column:
    """One character a base: ``phred`` for A, C, G and T, 0 for codes of several bases."""
    good = F.regexp_replace(seq, "[^ACGT]", "!")
    return F.translate(good, "ACGT", chr(33 + phred) * 4)


def mask_low_quality(seq: Column, quality: Column, least: int) -> Column:
    """Bases whose quality is below ``least`` become ``-``, which has no vote."""
    at = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))).otherwise(F.array().cast("array<int>"))
    good = lambda i: F.ascii(F.substr(quality, i, F.lit(1))) >= 33 + least
    return F.array_join(F.transform(at, lambda i: F.when(good(i), F.substr(seq, i, F.lit(1))).otherwise("-")), "")


def strand_consensus_codes(reads: DataFrame, keys: list[str], seq: str, whole: float = 0.7, each: float = 0.667) -> DataFrame:
    """``keys, consensus, n_reads`` of aligned reads of one strand.

    Reads of one sequence give it. Two reads that differ give the code of both bases at each position. Of
    three or more, a sequence with ``whole`` of the reads wins; else each position takes the base that
    ``each`` of its votes have, or the code of all its bases. ``-`` is no vote; a position without votes is N.

    Reads are counted by sequence before anything else, so a family of very many reads is a few rows.
    """
    n = families(reads.groupBy(*keys, seq).agg(F.count("*").alias("n")), reads.count(), keys)
    top = F.min(F.struct((-F.col("n")).alias("m"), F.col(seq).alias("s"))).alias("t")
    family = n.groupBy(*keys).agg(F.sum("n").alias("n_reads"), F.count("*").alias("k"), top)
    is_whole = ~F.contains(F.col("t.s"), F.lit("-")) & ((F.col("k") == 1) | (F.col("n_reads") > 2) & (-F.col("t.m") >= whole * F.col("n_reads")))
    family = family.withColumn("whole", is_whole)
    split = family.where("not whole").select(*keys, "n_reads")
    bases = base_rows(n.join(split.hint("merge"), keys), [*keys, "n", "n_reads"], seq)
    votes = bases.groupBy(*keys, "n_reads", "base_pos", "base").agg(F.sum("n").alias("n"))
    vote = F.col("base") != "-"
    place = votes.groupBy(*keys, "n_reads", "base_pos").agg(
        F.sum(F.when(vote, F.col("n")).otherwise(0)).alias("all"),
        F.bit_or(base_set(F.col("base"))).alias("set"),
        F.min(F.when(vote, F.struct((-F.col("n")).alias("m"), F.col("base").alias("b")))).alias("t"),
    )
    wins = (F.col("n_reads") > 2) & (-F.col("t.m") >= each * F.col("all"))
    place = place.select(*keys, F.struct("base_pos", F.when(wins, F.col("t.b")).otherwise(code_of(F.col("set"))).alias("b")).alias("p"))
    built = place.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["b"]), "").alias("built"))
    x = family.join(built.hint("merge"), keys, "left")
    return x.select(*keys, F.when(F.col("whole"), F.col("t.s")).otherwise(F.coalesce("built", F.lit(""))).alias("consensus"), "n_reads")


def duplex_consensus(
    reads: DataFrame,
    mol: str,
    strand: str,
    seq: str,
    quality: str | None = None,
    min_quality: int = 0,
    most_reads: int | None = None,
    read_id: str | None = None,
    whole: float = 0.7,
    each: float = 0.667,
) -> DataFrame:
    """``mol, consensus, quality, is_duplex, n_reads0, n_reads1``: one sequence a molecule from both strands of its reads.

    ``strand`` is 0 or 1. Each strand has its consensus (:func:`strand_consensus_codes`); two strands give
    the codes of what either has, with a quality of 40 at plain bases, one strand its own with 38. Bases of
    less than ``min_quality`` have no vote where ``quality`` names a column; with ``most_reads`` only so many
    reads of a strand count, in an order hashed from ``read_id``. Rows without a sequence take no part.
    """
    x = reads.where(F.col(seq).isNotNull() & F.col(strand).isin(0, 1))
    if most_reads is not None:
        x = downsample_per_group(x, [mol, strand], most_reads, read_id)
    own = mask_low_quality(F.col(seq), F.col(quality), min_quality) if quality else F.col(seq)
    each_strand = strand_consensus_codes(x.select(mol, strand, own.alias("s")), [mol, strand], "s", whole, each)
    of = lambda k, c: F.max(F.when(F.col(strand) == k, F.col(c)))
    x = each_strand.groupBy(mol).agg(*[of(k, "consensus").alias(f"c{k}") for k in (0, 1)], *[of(k, "n_reads").alias(f"n_reads{k}") for k in (0, 1)])
    a, b = F.col("c0"), F.col("c1")
    both = a.isNotNull() & b.isNotNull()
    x = x.withColumn("consensus", F.when(both & (a == b), a).when(both, merge_codes(a, b)).otherwise(F.coalesce(a, b)))
    marks = F.when(both, consensus_quality(F.col("consensus"), 40)).otherwise(consensus_quality(F.col("consensus"), 38))
    n = [F.coalesce(f"n_reads{k}", F.lit(0)).alias(f"n_reads{k}") for k in (0, 1)]
    return x.select(mol, "consensus", marks.alias("quality"), both.alias("is_duplex"), *n)
