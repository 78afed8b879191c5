"""Columns of call analysis: views of junctions, alleles, probabilities, templates and counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sequences import chars, common_prefix_length


def shift_inline_junction(kind: Column, query_bases: Column, ref_bases: Column) -> Column:
    """Bases by which an indel inside a CIGAR string can be moved to the right: for a deletion the common
    prefix of the read after it and the deleted reference, else 0."""
    return F.when(kind == "D", common_prefix_length(query_bases, ref_bases)).otherwise(0)


def dinucleotide_profile(df: DataFrame, keys: list[str], seq: str, angles: dict[str, float]) -> DataFrame:
    """``keys, base_pos, flexibility``: the mean angle of the steps into and out of each base (1-based)."""
    lookup = F.create_map(*[F.lit(v) for kv in angles.items() for v in kv])
    n = F.length(seq)
    step = lambda i: lookup[F.substr(F.col(seq), i, F.lit(2))]
    at = F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))
    x = df.select(*keys, seq, at.alias("base_pos"))
    entering = F.when(F.col("base_pos") > 1, step(F.col("base_pos") - 1))
    leaving = F.when(F.col("base_pos") < n, step(F.col("base_pos")))
    both = F.coalesce((entering + leaving) / 2, entering, leaving)
    return x.select(*keys, "base_pos", both.alias("flexibility"))


def max_of_list(text: Column) -> Column:
    """The greatest of a comma-joined list of integers."""
    return F.array_max(F.transform(F.split(text, ","), lambda v: v.cast("int")))


def junction_view(df: DataFrame) -> DataFrame:
    """Calls as the common junction view: strands, insert size, least of the two best MAPQs, flank, centre, size.

    Input: ``sv_id, chrom1, side1, pos1, chrom2, side2, pos2, jxn_type, microhomology, mapqs1, mapqs2, flank1, flank2``.
    """
    same = F.col("chrom1") == F.col("chrom2")
    return df.select(
        "sv_id",
        "chrom1",
        "chrom2",
        F.when(F.col("side1") == "L", "+").otherwise("-").alias("strand1"),
        F.when(F.col("side2") == "R", "+").otherwise("-").alias("strand2"),
        (-F.col("microhomology")).alias("insert_size"),
        F.least(max_of_list(F.col("mapqs1")), max_of_list(F.col("mapqs2"))).alias("mapq"),
        F.least("flank1", "flank2").alias("flank_length"),
        F.when(same, (F.col("pos1") + F.col("pos2")) / 2).alias("centre"),
        F.when(same, F.abs(F.col("pos2") - F.col("pos1"))).otherwise(0).alias("size"),
    )


def amplicon_end_patch(seq: Column, at: Column, index: Column, is_left: Column) -> Column:
    """A read end brought to its amplicon's index position: trimmed beyond it, padded with # short of it."""
    beyond = F.when(is_left, index - at).otherwise(at - index)
    trimmed = F.when(is_left, F.substr(seq, beyond + 1, F.length(seq))).otherwise(F.substr(seq, F.lit(1), F.length(seq) - beyond))
    pad = F.repeat(F.lit("#"), F.abs(beyond))
    return F.when(beyond > 0, trimmed).otherwise(F.when(is_left, F.concat(pad, seq)).otherwise(F.concat(seq, pad)))


def haplotype_alleles(df: DataFrame) -> DataFrame:
    """``chrom, pos, ref_base, hap1, hap2``: genotype alleles expanded to the reference positions they cover.

    Input: ``chrom, pos, ref, allele1, allele2``. Positions that an allele lacks are ``-``; the last
    position of an allele holds all its further bases.
    """
    x = df.select("*", F.posexplode(F.sequence(F.col("pos"), F.col("pos") + F.length("ref") - 1)).alias("i", "at"))
    last = F.col("i") == F.length("ref") - 1

    def base(allele: str) -> Column:
        a = F.col(allele)
        here = F.substr(a, F.col("i") + 1, F.when(last, F.length(a)).otherwise(F.lit(1)))
        return F.when(F.length(a) > F.col("i"), here).otherwise("-")

    return x.select("chrom", F.col("at").alias("pos"), F.substr("ref", F.col("i") + 1, F.lit(1)).alias("ref_base"), base("allele1").alias("hap1"), base("allele2").alias("hap2"))


#: Ranks of base comparisons, so that the greatest is the most telling.
COMPARISONS = ("UNSEQUENCED", "UNINFORMATIVE", "HAPLOTYPE", "REFERENCE", "MISMATCH")


def compare_bases(base: Column, ref: Column, hap1: Column, hap2: Column) -> Column:
    """Index into ``COMPARISONS`` of a sequenced base against the reference and two haplotypes."""
    return (
        F.when(base.isNull() | (base == " "), 0)
        .when(base == "N", 1)
        .when((base == hap1) | (base == hap2), F.when((hap1 == ref) & (hap2 == ref), 3).otherwise(2))
        .when(base == ref, 3)
        .otherwise(4)
    )


def lgamma(x: Column) -> Column:
    """Log of the gamma function for x > 0: a Stirling series after shifting the argument by 8."""
    z = x + 8
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    i = 1 / z
    i2 = i * i
    series = i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def digamma(x: Column) -> Column:
    """Derivative of :func:`lgamma` for x > 0: its asymptotic series after shifting the argument by 8."""
    z = x + 8
    i2 = 1 / (z * z)
    series = F.log(z) - 1 / (2 * z) - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 * (1 / 240 - i2 / 132))))
    for k in range(8):
        series = series - 1 / (x + k)
    return series


def trigamma(x: Column) -> Column:
    """Second derivative of :func:`lgamma` for x > 0."""
    z = x + 8
    i2 = 1 / (z * z)
    series = 1 / z + i2 / 2 + i2 / z * (1 / 6 - i2 * (1 / 30 - i2 * (1 / 42 - i2 * (1 / 30 - i2 * 5 / 66))))
    for k in range(8):
        series = series + 1 / ((x + k) * (x + k))
    return series


def log_nbinom_pmf(x: Column, mu: Column, size: Column) -> Column:
    """Log density of a negative binomial count by mean and dispersion."""
    return (
        lgamma(x + size) - lgamma(size) - lgamma(x + 1.0) + size * F.log(size / (size + mu)) + F.when(x > 0, x * F.log(mu / (size + mu))).otherwise(0.0)
    )


def poisson_success(mu: Column) -> Column:
    return 1 - F.exp(-mu)


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X > k) of a binomial count, by the recurrence of its terms."""
    start = F.struct(F.pow(1 - p, n.cast("double")).alias("t"), F.pow(1 - p, n.cast("double")).alias("c"))
    below = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")),
        start,
        lambda acc, i: F.struct(
            (acc["t"] * (n - i + 1) / i * p / (1 - p)).alias("t"), (acc["c"] + acc["t"] * (n - i + 1) / i * p / (1 - p)).alias("c")
        ),
        lambda acc: acc["c"],
    )
    return F.greatest(F.lit(0.0), 1 - below)


def orient_by_gene(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Junction ends as offsets from the gene's centre, read along the gene's strand.

    Input: ``sv_id, name, side1, pos1, side2, pos2``; targets: ``name, start0, end1, strand``. On the
    minus strand offsets change sign, sides change, and the ends change places.
    """
    t = targets.select("name", ((F.col("start0") + F.col("end1")) / 2).alias("centre"), (F.col("strand") == "-").alias("minus"))
    x = df.join(t, "name")
    minus = F.col("minus")
    off = lambda c: F.when(minus, F.col("centre") - F.col(c)).otherwise(F.col(c) - F.col("centre"))
    turn = lambda c: F.when(minus, F.when(F.col(c) == "L", "R").otherwise("L")).otherwise(F.col(c))
    return x.select(
        "sv_id",
        "name",
        F.when(minus, off("pos2")).otherwise(off("pos1")).alias("offset1"),
        F.when(minus, turn("side2")).otherwise(turn("side1")).alias("side1"),
        F.when(minus, off("pos1")).otherwise(off("pos2")).alias("offset2"),
        F.when(minus, turn("side1")).otherwise(turn("side2")).alias("side2"),
    )


def amplicon_junction_size(kind: Column, pos1: Column, pos2: Column) -> Column:
    """Size by type: deletion less one, duplication and merge failure plus one, inversion as is, else 0."""
    d = F.abs(pos2 - pos1)
    return F.when(kind == "D", d - 1).when(kind.isin("U", "M"), d + 1).when(kind == "V", d).otherwise(0)


def adjust_counts(n: Column, mappability: Column, excluded: Column, least: float = 0.5) -> Column:
    """Counts scaled up for unmappable and excluded bases; null where too little is mappable."""
    return F.when(mappability >= least, n / mappability / F.nullif(1 - excluded, F.lit(0.0)))


def signed_template_position(kind: Column, breakpoint_n: Column, distance: Column, is_rc: Column) -> tuple[Column, Column]:
    """(signed position, lane): into the retained side is negative at breakpoint 1, positive at 2; an
    inversion's second side is mirrored; the lane tells strands apart."""
    sign = F.when(breakpoint_n == 1, -1).otherwise(F.when(kind == "I", -1).otherwise(1))
    return sign * distance, F.when(is_rc == 1, -1).otherwise(1)


def base_rows(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """``keys, base_pos, base``: one row a base, from 1."""
    return df.select(*keys, F.posexplode(chars(F.col(seq))).alias("p", "base")).select(*keys, (F.col("p") + 1).alias("base_pos"), "base")
