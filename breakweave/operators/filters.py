"""Filters of molecules, junctions, calls, bins and reads. Unknown conditions count as false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import fraction_matching, hamming
from .joins import interval_flag


def true(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def molecules_all_mapq(df: DataFrame, key: str, min_mapq: int, excluded: str | None = None) -> DataFrame:
    """Rows of molecules whose every segment reaches ``min_mapq`` and none is excluded."""
    w = Window.partitionBy(key)
    ok = F.min("mapq").over(w) >= min_mapq
    if excluded:
        ok = ok & ~F.max(F.coalesce(F.col(excluded), F.lit(False))).over(w)
    return df.withColumn("__ok", ok).where("__ok").drop("__ok")


def molecules_any_mapq(df: DataFrame, key: str, min_mapq: int) -> DataFrame:
    return df.withColumn("__m", F.max("mapq").over(Window.partitionBy(key))).where(F.col("__m") >= min_mapq).drop("__m")


def junction_nodes(df: DataFrame) -> DataFrame:
    """Gap and split nodes of true junctions."""
    return df.where(true(F.col("node_class").isin(0, 1) & (F.col("jxn_type") != "P")))


def outer_clips(df: DataFrame, min_clip: int = 5) -> DataFrame:
    return df.where(true((F.col("clip_len1") >= min_clip) | (F.col("clip_len2") >= min_clip)))


def on_target(df: DataFrame, level: int, column: str = "target_class") -> DataFrame:
    """Level 2 wants both ends in a region, 1 wants one, 0 wants none."""
    if level == 2:
        return df.where(true(~F.col(column).contains("-")))
    return df.where(true(F.col(column) != "--")) if level == 1 else df


def no_foldback(df: DataFrame, least: int) -> DataFrame:
    """Inversions must span at least ``least`` bases."""
    return df.where(true((F.col("jxn_type") != "I") | (F.abs(F.col("pos2") - F.col("pos1")) >= least)))


def sv_size(df: DataFrame, least: int, factor: float = 0.0, max_tlen: int = 0) -> DataFrame:
    """Calls of at least a minimum size, or ``factor * max_tlen`` where a factor is given; T is exempt."""
    limit = factor * max_tlen if factor else least
    return df.where(true((F.col("jxn_type") == "T") | (F.abs(F.col("pos2") - F.col("pos1")) >= limit)))


def sv_evidence(df: DataFrame, sv: str, min_coverage: int = 1, both: int = 20, one: int = 30) -> DataFrame:
    """Molecules of calls with enough molecules and good best MAPQs on both and on one side."""
    agg = df.groupBy(sv).agg(F.count("*").alias("n"), F.max("mapq1").alias("m1"), F.max("mapq2").alias("m2"))
    ok = agg.where(
        (F.col("n") >= min_coverage) & (F.least("m1", "m2") >= both) & (F.greatest("m1", "m2") >= one)
    ).select(sv)
    return df.join(ok, sv, "left_semi")


def quality_flags(df: DataFrame, min_mapq: int = 20, min_size: int = 100, min_identity: float = 0.9) -> DataFrame:
    """``high_quality, matchable, fusable`` of long-read junctions; null for alignments."""
    j = F.col("edge_type") != "A"
    high = true((F.col("mapq") >= min_mapq) & (F.col("aln_size") >= min_size) & (F.col("identity") >= min_identity))
    clean = ~F.col("has_adapter5") & ~F.col("has_adapter3")
    matchable = high & true(F.col("passed_bandwidth") & clean)
    fusable = true(clean & (~F.col("passed_bandwidth") | high & ((F.col("n_canonical") > 1) | (F.col("n_noncanonical") > 1))))
    return df.withColumns({k: F.when(j, v) for k, v in (("high_quality", high), ("matchable", matchable), ("fusable", fusable))})


def reads_with(df: DataFrame, read: str, flag: Column) -> DataFrame:
    """All edges of reads that have one for which ``flag`` holds."""
    return df.withColumn("__f", F.max(true(flag)).over(Window.partitionBy(read))).where("__f").drop("__f")


def bandwidth(df: DataFrame, read: str, order: str, most: int) -> DataFrame:
    """``passed_bandwidth``: false for a junction inside a span of high-quality junctions that moves the read
    and the reference by nearly the same (their difference is below ``most``).

    Input: ``high_quality, qry_pos, ref_pos`` (``ref_pos`` after the junction). The spans of a
    read are pairs of its few junctions: an array of them is searched in each row.
    """
    w = Window.partitionBy(read).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct(F.col(order).alias("o"), F.col("qry_pos").alias("q"), F.col("ref_pos").alias("r"))
    x = df.withColumn("__all", F.collect_list(F.when(F.col("high_quality"), point)).over(w))
    inside = F.exists(
        F.filter("__all", lambda a: a["o"] <= F.col(order)),
        lambda a: F.exists(
            F.filter("__all", lambda b: (b["o"] >= F.col(order)) & (b["o"] > a["o"])),
            lambda b: F.abs((b["q"] - a["q"]) - (b["r"] - a["r"])) < most,
        ),
    )
    return x.withColumn("passed_bandwidth", ~(F.col("high_quality") & inside)).drop("__all")


def amplicon_candidates(df: DataFrame, min_size: int) -> DataFrame:
    """``is_candidate``: not too small, not a balanced indel, not the failure of a merge."""
    small = F.col("size") < min_size
    balanced = (F.col("kind") == "D") & (F.abs(F.col("size") - F.col("insert_size")) < min_size)
    return df.withColumn("is_candidate", true(~small & ~balanced & (F.col("kind") != "M")))


def sv_filters(
    df: DataFrame,
    types: list[str] | None = None,
    min_size: int = 0,
    max_size: int | None = None,
    max_samples: int | None = None,
    min_split: int = 0,
    min_molecules: int = 0,
    min_mapq: int = 0,
    min_mapq_molecules: int = 1,
    sample: str | None = None,
) -> DataFrame:
    """Calls by type, size, samples, evidence, and molecules with enough MAPQ on both sides.

    Input: ``jxn_type, sv_size, n_samples, n_splits, n_total, mapqs1, mapqs2`` (arrays), ``samples`` (array).
    """
    ok = (F.col("sv_size") >= min_size) | (F.col("jxn_type") == "T")
    if types:
        ok = ok & F.col("jxn_type").isin(types)
    if max_size is not None:
        ok = ok & (F.col("sv_size") <= max_size)
    if max_samples is not None:
        ok = ok & (F.col("n_samples") <= max_samples)
    ok = ok & (F.col("n_splits") >= min_split) & (F.col("n_total") >= min_molecules)
    if min_mapq:
        good = F.zip_with("mapqs1", "mapqs2", lambda a, b: (a >= min_mapq) & (b >= min_mapq))
        ok = ok & (F.size(F.filter(good, lambda v: v)) >= min_mapq_molecules)
    if sample is not None:
        ok = ok & F.array_contains("samples", sample)
    return df.where(true(ok))


def capture_filters(df: DataFrame, classes: list[str] | None = None, min_strands: int = 0, max_shared: float | None = None, duplex: str = "any") -> DataFrame:
    """Calls by target class, strand count, shared proper ends (halved) and duplex support."""
    ok = F.col("strand_count") >= min_strands
    if classes:
        ok = ok & F.col("target_class").isin(classes)
    if max_shared is not None:
        ok = ok & (F.col("shared_proper") / 2 <= max_shared)
    if duplex != "any":
        ok = ok & ((F.col("n_duplex") > 0) if duplex == "duplex" else (F.col("n_duplex") == 0))
    return df.where(true(ok))


def junction_filters(df: DataFrame, chrom_m: int, policy: str = "always", unique_to_sample: bool = False, min_instances: int = 1, min_flank: int = 0, min_cnc: float | None = None) -> DataFrame:
    """Generic junction filters; ``policy`` says when junctions with chrM are kept: always, translocations, never."""
    m1, m2 = F.col("chrom1") == chrom_m, F.col("chrom2") == chrom_m
    ok = (F.col("n_instances") >= min_instances) & (F.col("flank_length") >= min_flank)
    if policy == "never":
        ok = ok & ~m1 & ~m2
    elif policy == "translocations":
        ok = ok & ~(m1 & m2)
    if unique_to_sample:
        ok = ok & (F.col("n_samples") == 1)
    if min_cnc is not None:
        ok = ok & (F.abs(F.col("flank_cnc")) >= min_cnc)
    return df.where(true(ok))


def in_range(df: DataFrame, mode: str, chrom: int, first: int, last: int) -> DataFrame:
    """Junctions of a window by ``centre``, by ``endpoint`` (either end inside), or ``all``."""
    if mode == "all":
        return df
    one = (F.col("chrom1") == chrom) & F.col("pos1").between(first, last)
    two = (F.col("chrom2") == chrom) & F.col("pos2").between(first, last)
    if mode == "endpoint":
        return df.where(true(one | two))
    centre = (F.col("pos1") + F.col("pos2")) / 2
    return df.where(true((F.col("chrom1") == chrom) & (F.col("chrom2") == chrom) & centre.between(first, last)))


def assembly_filters(df: DataFrame, skip: list[str], min_samples: int = 1) -> DataFrame:
    """Skipped samples leave the lists; calls left with too few samples go."""
    kept = F.filter("samples", lambda s: ~s.isin(skip))
    return df.withColumn("samples", kept).where(F.size("samples") >= min_samples)


def low_quality_bins(df: DataFrame, bad: DataFrame, max_excluded: float = 0.1, min_mappability: float = 0.0) -> DataFrame:
    """Bins with few excluded bases, enough mappability and no bad region."""
    flagged = interval_flag(df, bad, "__bad")
    return flagged.where(true((F.col("excluded") <= max_excluded) & (F.col("mappability") >= min_mappability) & ~F.col("__bad"))).drop("__bad")


def without_outliers(df: DataFrame, keys: list[str], column: str, low: float = 0.025, high: float = 0.975, least: float | None = None) -> DataFrame:
    """Rows between two quantiles of their group, and at least ``least``."""
    q = df.groupBy(*keys).agg(F.percentile(column, F.lit(low)).alias("__lo"), F.percentile(column, F.lit(high)).alias("__hi"))
    x = df.join(q, keys).where(F.col(column).between(F.col("__lo"), F.col("__hi")))
    return (x.where(F.col(column) >= least) if least is not None else x).drop("__lo", "__hi")


def primer_matches(df: DataFrame, primer1: str, primer2: str, most: int) -> DataFrame:
    """Reads whose start and end are within ``most`` mismatches of two primers."""
    seq = F.col("seq")
    head, tail = F.substr(seq, F.lit(1), F.lit(len(primer1))), F.substr(seq, F.length(seq) - len(primer2) + 1, F.lit(len(primer2)))
    return df.where((hamming(head, F.lit(primer1)) <= most) & (hamming(tail, F.lit(primer2)) <= most))


def good_cells(df: DataFrame, whitelist: DataFrame, tags: str = "tags") -> DataFrame:
    """Reads of listed barcodes, with the number of the barcode; untagged reads go. ``whitelist``: ``barcode, cell_n``."""
    from .joins import small

    return df.withColumn("barcode", F.regexp_extract(tags, "CB:Z:([ACGTN]+)", 1)).join(small(whitelist), "barcode")


def collapse_foldbacks(df: DataFrame, read: str, order: str) -> DataFrame:
    """Reads cut at the first inversion whose flanking alignments overlap on the reference.

    Input rows are alignments with ``chrom, strand, start0, end1``. The alignments from that
    inversion on go; ``is_foldback`` marks the reads that were cut.
    """
    w = Window.partitionBy(read).orderBy(order)
    turned = (F.lag("chrom").over(w) == F.col("chrom")) & (F.lag("strand").over(w) != F.col("strand"))
    over = (F.lag("start0").over(w) < F.col("end1")) & (F.lag("end1").over(w) > F.col("start0"))
    x = df.withColumn("__cut", F.when(turned & over, F.col(order)))
    x = x.withColumn("__first", F.min("__cut").over(Window.partitionBy(read)))
    return x.withColumn("is_foldback", F.col("__first").isNotNull()).where(F.col("__first").isNull() | (F.col(order) < F.col("__first"))).drop("__cut", "__first")


def without_duplex_segments(df: DataFrame, read: str, order: str, path: str) -> DataFrame:
    """Segments whose path, reversed and negated, is that of a later segment of the read go."""
    back = F.array_join(F.reverse(F.transform(path, lambda v: (-v).cast("string"))), ":")
    own = df.select(F.col(read).alias("__r"), F.col(order).alias("__o"), F.array_join(F.transform(path, lambda v: v.cast("string")), ":").alias("__p"))
    last = own.groupBy("__r", "__p").agg(F.max("__o").alias("__o"))
    x = df.withColumn("__back", back)
    return x.join(last, (x[read] == last["__r"]) & (x["__back"] == last["__p"]) & (last["__o"] > x[order]), "left_anti").drop("__back")


def outer_primers(df: DataFrame, primer1: int, primer2: int, tolerance: int) -> DataFrame:
    """Segments whose outer nodes lie at the two primers, in either order."""
    near = lambda c, p: F.abs(F.col(c) - p) <= tolerance
    return df.where(true(near("node1", primer1) & near("node2", primer2) | near("node1", primer2) & near("node2", primer1)))


def nuclear_only(df: DataFrame, path: str = "chroms", chrom_m: int = 25) -> DataFrame:
    """Paths that leave chrM."""
    return df.where(~F.forall(path, lambda v: v == chrom_m))


def valid_clips(clips: DataFrame, references: DataFrame, density: float) -> DataFrame:
    """Clip evidence of calls with a junction sequence, whose bases match the reference molecule's clip well enough.

    clips: ``sv_id, side, clip_seq``; references: ``sv_id, jxn_seq, clip_seq1, clip_seq2``.
    """
    x = clips.join(references, "sv_id")
    ref = F.when(F.col("side") == 1, F.col("clip_seq1")).otherwise(F.col("clip_seq2"))
    match = F.when(F.col("side") == 1, fraction_matching(F.col("clip_seq"), ref, "left")).otherwise(fraction_matching(F.col("clip_seq"), ref, "right"))
    return x.where(F.col("jxn_seq").isNotNull() & true(match >= density)).select(*clips.columns)


def bin_filters(df: DataFrame, min_mappability: float, gc: tuple[float, float], max_excluded: float) -> DataFrame:
    """Bins by mappability, GC range and excluded share, without the last bin of each chromosome."""
    last = F.max("start0").over(Window.partitionBy("chrom"))
    x = df.withColumn("__last", last).where(F.col("start0") < F.col("__last")).drop("__last")
    ok = (F.col("mappability") >= min_mappability) & F.col("gc_fraction").between(*gc) & (F.col("excluded") / (F.col("end1") - F.col("start0")) <= max_excluded)
    return x.where(true(ok))


def reject_unmapped(df: DataFrame, key: str = "qname") -> DataFrame:
    """Molecules without an unmapped read; an unmerged pair gets a merge-failure edge between its reads.

    Input: ``qname, read_n, is_unmapped, is_merged, chrom, pos``. Output: ``qname, edge_type, read_n,
    chrom1, pos1, chrom2, pos2`` with A rows for alignments and one M row a pair.
    """
    kept = df.withColumn("__u", F.max("is_unmapped").over(Window.partitionBy(key))).where(~F.col("__u"))
    a = kept.select(key, F.lit("A").alias("edge_type"), "read_n", F.col("chrom").alias("chrom1"), F.col("pos").alias("pos1"), F.col("chrom").alias("chrom2"), F.col("pos").alias("pos2"))
    pairs = kept.where(~F.col("is_merged")).groupBy(key).agg(
        F.count("*").alias("n"), F.min_by(F.struct("chrom", "pos"), "read_n").alias("x"), F.max_by(F.struct("chrom", "pos"), "read_n").alias("y")
    )
    m = pairs.where("n > 1").select(key, F.lit("M").alias("edge_type"), F.lit(None).cast("long").alias("read_n"), F.col("x.chrom").alias("chrom1"), F.col("x.pos").alias("pos1"), F.col("y.chrom").alias("chrom2"), F.col("y.pos").alias("pos2"))
    return a.unionByName(m)
