"""Columns of alignments: flags, CIGAR strings, clips and molecule ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the alignment flag.
PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND, SUPPLEMENTARY = 1, 2, 4, 16, 64, 128, 2048
#: CIGAR operations that advance the reference or the query when a string is walked.
ADVANCE_REF, ADVANCE_QUERY = "DM", "SHIM"
#: CIGAR operations that span reference bases.
SPAN = "MDN=X"


def has_bit(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def decode_flag(flag: Column) -> dict[str, Column]:
    """Named booleans of a flag, and the strand of the source molecule: read 2 of an FR pair is flipped."""
    names = ("is_paired", "is_proper", "is_unmapped", "is_reverse", "is_first", "is_second", "is_supplementary")
    bits = (PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND, SUPPLEMENTARY)
    out = {n: has_bit(flag, b) for n, b in zip(names, bits)}
    reverse = F.shiftright(flag.bitwiseAND(F.lit(REVERSE)), 4)
    second = F.shiftright(flag.bitwiseAND(F.lit(SECOND)), 7)
    out["strand"] = reverse.bitwiseXOR(second).cast("int")
    return out


def cigar_ops(cigar: Column) -> Column:
    """The operations of a CIGAR string as an array of (size, op)."""
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)[A-Z=]"), F.lit(1)), lambda x: x.cast("int"))
    kinds = F.regexp_extract_all(cigar, F.lit(r"[0-9]+([A-Z=])"), F.lit(1))
    return F.zip_with(sizes, kinds, lambda s, k: F.struct(s.alias("size"), k.alias("op")))


def op_sum(cigar: Column, kinds: str) -> Column:
    """Summed sizes of the operations of the given kinds."""
    return F.aggregate(
        cigar_ops(cigar),
        F.lit(0),
        lambda acc, x: acc + F.when(x["op"].isin(*kinds), x["size"]).otherwise(0),
    )


def ref_span(cigar: Column) -> Column:
    return op_sum(cigar, SPAN)


def aln_end(pos: Column, cigar: Column) -> Column:
    """The last aligned reference base of an alignment that starts at ``pos`` (both 1-based)."""
    return pos + ref_span(cigar) - 1


def clip_lengths(cigar: Column) -> tuple[Column, Column]:
    """Soft-clipped bases at the left and the right end."""

    def one(pattern: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(cigar, pattern, 1), F.lit("")).cast("int"), F.lit(0))

    return one("^([0-9]+)S"), one("([0-9]+)S$")


def clip_sequence(seq: Column, cigar: Column, min_clip: int = 5) -> tuple[Column, Column]:
    """Bases of the two clips, null where a clip is shorter than ``min_clip``."""
    left, right = clip_lengths(cigar)
    return (
        F.when(left >= min_clip, F.substr(seq, F.lit(1), left)),
        F.when(right >= min_clip, F.substr(seq, F.length(seq) - right + 1, right)),
    )


def explode_cigar(df: DataFrame, keys: list[str], cigar: str = "cigar") -> DataFrame:
    """One row an operation: ``op_index, size, op`` and the reference and query offsets where it starts.

    Offsets are running sums inside the array, so nothing is shuffled.
    """
    ops = cigar_ops(F.col(cigar))
    start = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<size:int,op:string,ref_offset:int,qry_offset:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["size"].alias("size"), x["op"].alias("op"), acc["r"].alias("ref_offset"), acc["q"].alias("qry_offset"))
        return F.struct(
            (acc["r"] + F.when(x["op"].isin(*ADVANCE_REF), x["size"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(x["op"].isin(*ADVANCE_QUERY), x["size"]).otherwise(0)).alias("q"),
            F.concat(acc["out"], F.array(here)).alias("out"),
        )

    walked = F.aggregate(ops, start, step, lambda acc: acc["out"])
    return df.select(*keys, F.posexplode(walked).alias("op_index", "o")).select(*keys, "op_index", "o.*")


def molecule_strand(strand1: Column, strand2: Column, chrom1: Column, chrom2: Column, pos1: Column, pos2: Column) -> Column:
    """0 or 1 by the outer alignments: their common strand, else the order of chromosomes or positions."""
    return (
        F.when(strand1 == strand2, strand1)
        .when(chrom1 != chrom2, (chrom1 > chrom2).cast("int"))
        .otherwise((pos1 > pos2).cast("int"))
    )


def strand_of_counts(count1: Column, count2: Column) -> Column:
    """2 where both strands were read (duplex), else the one that was."""
    return F.when((count1 > 0) & (count2 > 0), 2).when(count2 > 0, 1).otherwise(0)


def outer_pos(pos: Column, side: Column, clip: Column, floor: bool = False) -> Column:
    """Where a molecule would end had its clip been aligned; ``floor`` keeps it at 1 or above."""
    p = pos + F.when(side == "L", clip).otherwise(-clip)
    return F.greatest(F.lit(1), p) if floor else p


def endpoint_signature(umi: Column, chrom: Column, side: Column, pos: Column, clip: Column, min_clip: int = 5) -> Column:
    return F.concat_ws(
        ":", umi.cast("string"), chrom.cast("string"), side, outer_pos(pos, side, clip, floor=True).cast("string"), (clip >= min_clip).cast("int").cast("string")
    )


def proper_molecule_spans(df: DataFrame, min_mapq: int = 20) -> DataFrame:
    """Per molecule of two alignments on opposite strands of one chromosome in order: its clip-extended
    span, least MAPQ and mapped length. Input: ``qname, chrom, pos, is_reverse, mapq, cigar``."""
    left, right = clip_lengths(F.col("cigar"))
    a = df.select(
        "qname", "chrom", "pos", "is_reverse", "mapq", aln_end(F.col("pos"), F.col("cigar")).alias("end"), left.alias("lc"), right.alias("rc")
    )
    one = a.groupBy("qname").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("is_reverse") == 1).alias("n_reverse"),
        F.min("chrom").alias("chrom"),
        F.max("chrom").alias("chrom2"),
        F.min("mapq").alias("mapq"),
        F.max(F.when(F.col("is_reverse") == 0, F.col("pos"))).alias("fwd_pos"),
        F.max(F.when(F.col("is_reverse") == 0, F.col("lc"))).alias("fwd_clip"),
        F.max(F.when(F.col("is_reverse") == 1, F.col("end"))).alias("rev_end"),
        F.max(F.when(F.col("is_reverse") == 1, F.col("rc"))).alias("rev_clip"),
        F.max(F.when(F.col("is_reverse") == 1, F.col("pos"))).alias("rev_pos"),
    )
    ok = (F.col("n") == 2) & (F.col("n_reverse") == 1) & (F.col("chrom") == F.col("chrom2")) & (F.col("fwd_pos") <= F.col("rev_pos")) & (F.col("mapq") >= min_mapq)
    return one.where(ok).select(
        "qname",
        "chrom",
        (F.col("fwd_pos") - F.col("fwd_clip") - 1).alias("start0"),
        (F.col("rev_end") + F.col("rev_clip")).alias("end1"),
        "mapq",
        (F.col("rev_end") - F.col("fwd_pos") + 1).alias("mapped_length"),
    )


def molecule_keys(df: DataFrame, collapse_strands: bool = False) -> DataFrame:
    """``qname, molecule_key, group_strand``: a key of both outer ends in strand-independent order.

    The outermost alignment of each end is the first and the last by (aln_n); positions are
    projected across clips; ends on two chromosomes are ordered by chromosome, else by position.
    """
    left, right = clip_lengths(F.col("cigar"))
    side = F.when(F.col("is_reverse") == 1, "R").otherwise("L")
    a = df.withColumn("side", side).withColumn("clip", F.when(F.col("is_reverse") == 1, right).otherwise(left))
    raw = F.when(F.col("is_reverse") == 1, aln_end(F.col("pos"), F.col("cigar"))).otherwise(F.col("pos"))
    # the clip lies before a forward start and after a reverse end
    p = F.when(F.col("is_reverse") == 1, raw + F.col("clip")).otherwise(raw - F.col("clip"))
    end = F.struct(F.col("chrom"), p.alias("p"), F.col("side"), (F.col("clip") > 0).cast("int").alias("clipped"), F.col("is_reverse"))
    ends = a.groupBy("qname").agg(F.min_by(end, "aln_n").alias("a"), F.max_by(end, "aln_n").alias("b"))
    swap = F.when(F.col("a.chrom") != F.col("b.chrom"), F.col("a.chrom") > F.col("b.chrom")).otherwise(F.col("a.p") > F.col("b.p"))
    x, y = F.when(swap, F.col("b")).otherwise(F.col("a")), F.when(swap, F.col("a")).otherwise(F.col("b"))
    e = ends.select("qname", x.alias("x"), y.alias("y"), swap.cast("int").alias("swapped"))
    parts = [F.col(f"{v}.{c}").cast("string") for v in "xy" for c in ("chrom", "side", "p", "clipped")]
    strand = F.lit(0) if collapse_strands else F.col("swapped")
    return e.select("qname", F.concat_ws(":", *parts).alias("molecule_key"), strand.alias("group_strand"))


def running(df: DataFrame, partition: list[str], order: list, value: Column) -> Column:
    """Sum of ``value`` over the rows up to this one."""
    return F.sum(value).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
