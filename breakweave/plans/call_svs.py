"""Junction molecules to structural-variant calls with counts by sample, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.junctions import breakend_fields, junction_structure, junction_type
from ..operators.aggregates import characterize_sv
from ..operators.filters import sv_evidence, sv_size
from ..operators.graph import combined, purge_ranked, ranked
from ..operators.joins import outer_clip_evidence
from ..operators.ordered import continuity_groups, dense_ids, downsample_per_group
from ..operators.seeding import TYPE_COLUMNS, assign_types
from .scratch import materialize, scratch_tables

KEYS = ["chrom1", "chrom2", "side1", "side2"]


def node_name(k: int) -> F.Column:
    """``chrom:side:pos`` of one end of a junction."""
    return F.concat_ws(":", *(F.col(f"{c}{k}").cast("string") for c in ("chrom", "side", "pos")))


def sv_molecules(
    molecules: DataFrame, max_tlen: int, read_len: int, min_size: int, min_coverage: int, min_mapq_both: int, min_mapq_one: int, purge: int, purge_limit: int | None = None
) -> DataFrame:
    """``molecules`` of calls with ``jxn_type, group_id, sv_n, sv_id, is_ambiguous, n_collapsed``: one row for each
    call and unique molecule.

    Molecules are typed and filtered by size before the first shuffle, grouped by continuity, and kept by
    the group's evidence. Junction types are assigned to SVs within their groups; molecules of one type, sample
    and outer ends, which are duplicates in every call, become one row before rows are multiplied by calls, and
    the rest is purged of duplicates within each call and sample. With ``purge_limit`` a call takes at most so
    many molecules of a sample, in an order hashed from their ids: a pile-up then lengthens no list of a call.
    """
    kind = junction_type(*[F.col(c) for c in ("chrom1", "side1", "pos1", "chrom2", "side2", "pos2", "node_class")], max_tlen, read_len)
    typed = sv_size(molecules.withColumn("jxn_type", kind).where("jxn_type <> 'P'"), min_size)
    order = [-F.col("node_class"), -(F.col("strand_count1") + F.col("strand_count2")), -(F.col("mapq1") + F.col("mapq2")), F.col("mol_id")]
    counts, of_type, ends = ["strand_count1", "strand_count2"], ["group_id", *TYPE_COLUMNS], ["sample", "out_pos1", "out_pos2"]
    with scratch_tables(molecules.sparkSession):
        grouped = materialize(continuity_groups(typed, KEYS, max_tlen, min_coverage), "sv-grouped")
        grouped = sv_evidence(grouped, "group_id", min_coverage, min_mapq_both, min_mapq_one).withColumn("is_split", F.col("node_class") == 1)
        svs = assign_types(grouped, "group_id", purge, max_tlen)
        ids = dense_ids(svs.select("group_id", "sv_n").distinct(), ["group_id", "sv_n"], "sv_id")
        svs = materialize(svs.join(ids, ["group_id", "sv_n"]), "sv-types")
        if purge_limit is None:
            placed = combined(ranked(grouped, order, "mol_id"), [*of_type, *ends], counts).join(svs, of_type)
        else:
            placed = downsample_per_group(grouped.join(svs, of_type), ["sample", "sv_id"], purge_limit, "mol_id")
            placed = combined(ranked(placed, order, "mol_id"), ["sv_id", *ends], counts)
        unique = purge_ranked(placed, ["sample", "sv_id"], float(purge), counts)
        if min_coverage > 1:
            unique = materialize(unique, "sv-unique")
            enough = unique.groupBy("sv_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_coverage)
            unique = unique.join(enough.select("sv_id"), "sv_id", "left_semi")
        return materialize(unique, "sv-molecules", result=True)


def call_svs(
    molecules: DataFrame,
    samples: list[str],
    clips: DataFrame | None = None,
    max_tlen: int = 762,
    read_len: int = 151,
    min_size: int = 1000,
    min_coverage: int = 1,
    min_mapq_both: int = 20,
    min_mapq_one: int = 30,
    purge: int = 5,
    purge_limit: int | None = None,
) -> DataFrame:
    """One row a call: evidence, reference junction, size, a count column for each sample, and ``n_clips``.

    See :func:`sv_molecules`. The reference molecule is a split where there is one, the one with the
    longest clip on its shorter side, else the gap with the longest clip on either side. Molecules of
    ``clips`` (node, mol_id, sample, clip_len) that end at a clipped node of it, and are no evidence
    of the call yet, are counted as outer clips.
    """
    unique = sv_molecules(molecules, max_tlen, read_len, min_size, min_coverage, min_mapq_both, min_mapq_one, purge, purge_limit)
    split = F.col("node_class") == 1
    scored = unique.withColumns(
        {"ref_clip": F.when(split, F.least("clip_len1", "clip_len2")).otherwise(F.greatest("clip_len1", "clip_len2")), "ref_tie": -F.col("mol_id")}
    )
    more = [F.count_if("is_ambiguous").alias("n_ambiguous"), F.sum("n_collapsed").alias("n_collapsed"), F.first("group_id").alias("group_id")]
    more += [F.count_if(F.col("sample") == s).alias(f"n_{s}") for s in samples]
    calls = characterize_sv(scored, "sv_id", ["node_class", "ref_clip", "ref_tie"], more, ["clip_len1", "clip_len2"])
    if clips is None:
        return calls.withColumnsRenamed({"clip_len1": "ref_clip1", "clip_len2": "ref_clip2"}).withColumn("n_clips", F.lit(0).cast("long"))
    calls = materialize(calls, "sv-calls")
    ends = F.array(*(F.struct(F.lit(k).alias("node_n"), node_name(k).alias("node"), node_name(3 - k).alias("other_node"), F.col(f"clip_len{k}").alias("clip")) for k in (1, 2)))
    references = calls.select("sv_id", F.explode(ends).alias("e")).select("sv_id", "e.*").where("clip > 0").drop("clip")
    found = outer_clip_evidence(clips, references).select("sv_id", "mol_id").distinct()
    found = found.join(unique.select("sv_id", "mol_id"), ["sv_id", "mol_id"], "left_anti").groupBy("sv_id").agg(F.count("*").alias("n_clips"))
    out = calls.withColumnsRenamed({"clip_len1": "ref_clip1", "clip_len2": "ref_clip2"}).join(found, "sv_id", "left")
    return out.withColumn("n_clips", F.coalesce("n_clips", F.lit(0)))


def call_breakends(calls: DataFrame, sequences: DataFrame) -> DataFrame:
    """Breakend records of calls (see :func:`breakend_fields`), for ``write_vcf_rows``.

    ``sequences``: mol_id, seq, len1, merge_len, ref1, ref2 of the reference molecules: the read across the
    junction, the bases of its first part, the overlap of a merged pair (0 where one read crosses it), and
    the reference bases at the two ends. Calls whose reference molecule has none are left out.
    """
    x = calls.join(sequences.withColumnRenamed("mol_id", "ref_mol_id"), "ref_mol_id")
    found = junction_structure(F.col("seq"), F.col("len1"), F.col("ref_clip1"), F.col("ref_clip2"), F.col("merge_len"))
    return breakend_fields(x.withColumns({"microhomology": found["microhomology"], "bases": found["bases"]}))
