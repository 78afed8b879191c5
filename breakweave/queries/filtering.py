"""F: filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..operators import filters as f
from . import query
from .expressions import _DIST, _TYPE, TARGET_CLASS_SQL, calls, typed, with_target_class

c = F.col


@query("f1", "SELECT qname, aln_n FROM (SELECT *, min(mapq) OVER w AS m, bool_or(chrom = 5) OVER w AS x FROM fx_alignments WINDOW w AS (PARTITION BY qname)) WHERE m >= 20 AND NOT x")
def f1(fx: Fixtures) -> DataFrame:
    return f.molecules_all_mapq(fx.alignments.withColumn("excluded", c("chrom") == 5), "qname", 20, "excluded").select("qname", "aln_n")


@query("f2", "SELECT qname, aln_n FROM (SELECT *, max(mapq) OVER (PARTITION BY qname) AS m FROM fx_alignments) WHERE m >= 55")
def f2(fx: Fixtures) -> DataFrame:
    return f.molecules_any_mapq(fx.alignments, "qname", 55).select("qname", "aln_n")


@query("f3", f"""SELECT mol_id, clip_len1 >= 5 OR clip_len2 >= 5 AS is_clip FROM (SELECT *, {_TYPE} AS jxn_type FROM {_DIST}) WHERE node_class IN (0, 1) AND jxn_type <> 'P'
 AND (mol_id % 2 = 0 OR clip_len1 >= 5 OR clip_len2 >= 5)""")  # fmt: skip
def f3(fx: Fixtures) -> DataFrame:
    nodes = f.junction_nodes(typed(fx))
    both = nodes.where("mol_id % 2 = 0").unionByName(f.outer_clips(nodes.where("mol_id % 2 = 1")))
    return both.select("mol_id", ((c("clip_len1") >= 5) | (c("clip_len2") >= 5)).alias("is_clip"))


@query("f4", f"WITH {TARGET_CLASS_SQL} SELECT mol_id, target_class, 2 AS level FROM classed WHERE target_class NOT LIKE '%-%' UNION ALL SELECT mol_id, target_class, 1 FROM classed WHERE target_class <> '--'")
def f4(fx: Fixtures) -> DataFrame:
    m = with_target_class(fx).select("mol_id", "target_class")
    return f.on_target(m, 2).withColumn("level", F.lit(2)).unionByName(f.on_target(m, 1).withColumn("level", F.lit(1)))


@query("f5", f"SELECT mol_id FROM (SELECT *, {_TYPE} AS jxn_type FROM {_DIST}) WHERE jxn_type <> 'I' OR abs(pos2 - pos1) >= 10000")
def f5(fx: Fixtures) -> DataFrame:
    return f.no_foldback(typed(fx), 10000).select("mol_id")


@query("f6", f"SELECT mol_id FROM (SELECT *, {_TYPE} AS jxn_type FROM {_DIST}) WHERE jxn_type = 'T' OR abs(pos2 - pos1) >= 15.5 * 762")
def f6(fx: Fixtures) -> DataFrame:
    return f.sv_size(typed(fx), 1000, 15.5, 762).select("mol_id")


@query("f7", """WITH g AS (SELECT sample, chrom1, pos1 // 10000 AS locus, count(*) AS n, max(mapq1) AS a, max(mapq2) AS b FROM fx_molecules GROUP BY ALL)
 SELECT m.mol_id FROM fx_molecules m JOIN g ON g.sample = m.sample AND g.chrom1 = m.chrom1 AND g.locus = m.pos1 // 10000 WHERE n >= 3 AND least(a, b) >= 20 AND greatest(a, b) >= 30""")  # fmt: skip
def f7(fx: Fixtures) -> DataFrame:
    m = fx.molecules.withColumn("sv", F.concat_ws(":", "sample", "chrom1", F.floor(c("pos1") / 10000)))
    return f.sv_evidence(m, "sv", 3).select("mol_id")


_EDGES = """select event_id, channel, case when event_id % 4 = 0 then 'A' else 'D' end as edge_type, event_id % 61 as mapq, event_id % 300 as aln_size, cast(event_id % 20 as double) / 100 + 0.81 as identity,
 event_id % 13 = 0 as has_adapter5, event_id % 17 = 0 as has_adapter3, event_id % 5 > 0 as passed_bandwidth, event_id % 4 as n_canonical, event_id % 3 as n_noncanonical, pos1, pos2 from fx_nodes_long"""


@query("f8", f"""WITH e AS ({_EDGES}), h AS (SELECT *, mapq >= 20 AND aln_size >= 100 AND identity >= 0.9 AS hq, NOT has_adapter5 AND NOT has_adapter3 AS clean FROM e)
 SELECT event_id, CASE WHEN edge_type <> 'A' THEN hq END AS high_quality, CASE WHEN edge_type <> 'A' THEN hq AND passed_bandwidth AND clean END AS matchable,
 CASE WHEN edge_type <> 'A' THEN clean AND (NOT passed_bandwidth OR (hq AND (n_canonical > 1 OR n_noncanonical > 1))) END AS fusable FROM h""")  # fmt: skip
def f8(fx: Fixtures) -> DataFrame:
    return f.quality_flags(fx.sql(_EDGES)).select("event_id", "high_quality", "matchable", "fusable")


@query("f9", "SELECT event_id FROM fx_nodes_long WHERE channel IN (SELECT channel FROM fx_nodes_long WHERE duplex = 1 AND insert_size > 2)")
def f9(fx: Fixtures) -> DataFrame:
    return f.reads_with(fx.nodes_long, "channel", (c("duplex") == 1) & (c("insert_size") > 2)).select("event_id")


_READS = "select event_id, channel * 1000 + floor(event_id / 2000) as read, event_id % 3 > 0 as high_quality, event_id % 2000 * 10 as qry_pos, event_id % 2000 * 10 + (event_id * 37) % 4000 as ref_pos from fx_nodes_long"


@query("f10", f"""WITH e AS ({_READS}), fail AS (SELECT a.read, a.event_id AS f, b.event_id AS l FROM e a JOIN e b ON a.read = b.read AND a.event_id < b.event_id AND a.high_quality AND b.high_quality
 AND abs((b.qry_pos - a.qry_pos) - (b.ref_pos - a.ref_pos)) < 100)
 SELECT event_id, NOT (high_quality AND EXISTS (SELECT 1 FROM fail WHERE fail.read = e.read AND e.event_id BETWEEN f AND l)) AS passed_bandwidth FROM e""")  # fmt: skip
def f10(fx: Fixtures) -> DataFrame:
    return f.bandwidth(fx.sql(_READS), "read", "event_id", 100).select("event_id", "passed_bandwidth")


_AMPLICON = "select event_id, substr('DUMVT', cast(event_id % 5 + 1 as int), 1) as kind, event_id % 97 as size, event_id % 31 as insert_size from fx_nodes_long"


@query("f11", f"WITH a AS ({_AMPLICON}) SELECT event_id, NOT size < 10 AND NOT (kind = 'D' AND abs(size - insert_size) < 10) AND kind <> 'M' AS is_candidate FROM a")
def f11(fx: Fixtures) -> DataFrame:
    return f.amplicon_candidates(fx.sql(_AMPLICON), 10).select("event_id", "is_candidate")


_CALLS = f"""calls AS (SELECT mol_id AS sv_id, jxn_type, chrom1, chrom2, pos1, pos2, CASE WHEN jxn_type = 'T' THEN 0 ELSE abs(pos2 - pos1) END AS sv_size, (mol_id % 3 + 1)::INT AS n_samples, (mol_id % 4)::INT AS n_splits,
 (mol_id % 6)::INT AS n_total, mapq1, mapq2, sample, strand_count1 + strand_count2 AS strand_count FROM (SELECT *, {_TYPE} AS jxn_type FROM {_DIST}))"""


def call_table(fx: Fixtures) -> DataFrame:
    extra = fx.molecules.select(c("mol_id").alias("sv_id"), "mapq1", "mapq2", "sample", (c("strand_count1") + c("strand_count2")).alias("strand_count"))
    i = lambda m, a=0: (c("sv_id") % m + a).cast("int")
    return (
        calls(fx)
        .join(extra, "sv_id")
        .withColumns({"n_samples": i(3, 1), "n_splits": i(4), "n_total": i(6), "mapqs1": F.array("mapq1", F.lit(40)), "mapqs2": F.array("mapq2", "mapq1"), "samples": F.array("sample", F.lit("X"))})
    )


@query("f12", f"""WITH {_CALLS} SELECT sv_id FROM calls WHERE jxn_type IN ('L', 'D', 'T') AND (sv_size >= 1000 OR jxn_type = 'T') AND sv_size <= 20000 AND n_samples <= 2 AND n_splits >= 1 AND n_total >= 2
 AND ((mapq1 >= 30 AND mapq2 >= 30) OR (40 >= 30 AND mapq1 >= 30)) AND sample IN ('S1')""")  # fmt: skip
def f12(fx: Fixtures) -> DataFrame:
    return f.sv_filters(call_table(fx), ["L", "D", "T"], 1000, 20000, 2, 1, 2, 30, 1, "S1").select("sv_id")


@query("f13", f"""WITH {_CALLS} SELECT sv_id FROM calls WHERE CASE sv_id % 3 WHEN 0 THEN 'TT' WHEN 1 THEN 'TA' ELSE 't-' END IN ('TT', 'TA') AND strand_count >= 2 AND (sv_id % 5) / 2 <= 1 AND sv_id % 4 > 0""")
def f13(fx: Fixtures) -> DataFrame:
    x = call_table(fx).withColumns({"target_class": F.when(c("sv_id") % 3 == 0, "TT").when(c("sv_id") % 3 == 1, "TA").otherwise("t-"), "shared_proper": c("sv_id") % 5, "n_duplex": c("sv_id") % 4})
    return f.capture_filters(x, ["TT", "TA"], 2, 1, "duplex").select("sv_id")


@query("f14", f"""WITH {_CALLS} SELECT sv_id FROM calls WHERE n_total >= 2 AND sv_id % 50 >= 10 AND NOT (chrom1 = 5 AND chrom2 = 5) AND n_samples = 1 AND abs(sv_id % 7 - 3) >= 1""")
def f14(fx: Fixtures) -> DataFrame:
    x = call_table(fx).withColumns({"n_instances": c("n_total"), "flank_length": c("sv_id") % 50, "flank_cnc": c("sv_id") % 7 - 3})
    return f.junction_filters(x, 5, "translocations", True, 2, 10, 1).select("sv_id")


@query("f15", f"""WITH {_CALLS} SELECT sv_id, 'centre' AS mode FROM calls WHERE chrom1 = 2 AND chrom2 = 2 AND (pos1 + pos2) / 2 BETWEEN 100000 AND 200000
 UNION ALL SELECT sv_id, 'endpoint' FROM calls WHERE (chrom1 = 2 AND pos1 BETWEEN 100000 AND 200000) OR (chrom2 = 2 AND pos2 BETWEEN 100000 AND 200000)""")  # fmt: skip
def f15(fx: Fixtures) -> DataFrame:
    x = calls(fx)
    a, b = (f.in_range(x, m, 2, 100000, 200000).select("sv_id", F.lit(m).alias("mode")) for m in ("centre", "endpoint"))
    return a.unionByName(b)


@query("f16", "SELECT mol_id AS sv_id, 1 + (sample <> 'S3')::INT AS n FROM fx_molecules WHERE 1 + (sample <> 'S3')::INT >= 2")
def f16(fx: Fixtures) -> DataFrame:
    return f.assembly_filters(call_table(fx), ["S3"], 2).select("sv_id", F.size("samples").alias("n"))


@query("f17", """SELECT chrom, bin_n FROM fx_genome_bins b WHERE excluded <= 0.5 AND gc_fraction >= 0.4 AND NOT EXISTS (SELECT 1 FROM fx_targets t WHERE t.chrom = b.chrom AND t.start0 < b.end1 AND t.end1 > b.start0)""")
def f17(fx: Fixtures) -> DataFrame:
    return f.low_quality_bins(fx.genome_bins.withColumn("mappability", c("gc_fraction")), fx.targets, 0.5, 0.4).select("chrom", "bin_n")


@query("f18", """WITH q AS (SELECT cell_id, quantile_cont(bin_n, 0.025) AS lo, quantile_cont(bin_n, 0.975) AS hi FROM fx_bin_counts GROUP BY 1)
 SELECT b.cell_id, b.chrom, b.bin_n FROM fx_bin_counts b JOIN q USING (cell_id) WHERE bin_n BETWEEN lo AND hi AND bin_n >= 10""")  # fmt: skip
def f18(fx: Fixtures) -> DataFrame:
    return f.without_outliers(fx.bin_counts, ["cell_id"], "bin_n", least=10).select("cell_id", "chrom", "bin_n")


@query("f19", "SELECT seq_id FROM fx_sequences WHERE hamming(substr(seq, 1, 6), 'ACGTAC') <= 3 AND hamming(substr(seq, 59, 6), 'GTTGCA') <= 4")
def f19(fx: Fixtures) -> DataFrame:
    return f.primer_matches(fx.sequences, "ACGTAC", "GTTGCA", 4).where(F.levenshtein(F.substr("seq", F.lit(1), F.lit(6)), F.lit("ACGTAC")) >= 0).transform(lambda d: f.primer_matches(d, "ACGTAC", "", 3)).select("seq_id")


@query("f20", "SELECT seq_id, substr(seq, 1, 2) AS barcode, (instr('ACGT', substr(seq, 1, 1)) - 1)::INT AS cell_n FROM fx_sequences WHERE seq_id % 5 > 0 AND substr(seq, 2, 1) = 'A'")
def f20(fx: Fixtures) -> DataFrame:
    reads = fx.sequences.select("seq_id", F.when(c("seq_id") % 5 > 0, F.concat(F.lit("NM:i:0 CB:Z:"), F.substr("seq", F.lit(1), F.lit(2)), F.lit(" X:A:b"))).otherwise("NM:i:0").alias("tags"))
    listed = fx.spark.createDataFrame([(b + "A", i) for i, b in enumerate("ACGT")], "barcode string, cell_n int")
    return f.good_cells(reads, listed).select("seq_id", "barcode", "cell_n")


_ALNS = "select qname, aln_n, chrom % 2 as chrom, is_reverse as strand, pos % 500 as start0, pos % 500 + 200 as end1 from fx_alignments"


@query("f21", f"""WITH a AS ({_ALNS}), l AS (SELECT *, lag(chrom) OVER w = chrom AND lag(strand) OVER w <> strand AND lag(start0) OVER w < end1 AND lag(end1) OVER w > start0 AS cut FROM a WINDOW w AS (PARTITION BY qname ORDER BY aln_n)),
 m AS (SELECT *, min(CASE WHEN cut THEN aln_n END) OVER (PARTITION BY qname) AS f FROM l) SELECT qname, aln_n, f IS NOT NULL AS is_foldback FROM m WHERE f IS NULL OR aln_n < f""")  # fmt: skip
def f21(fx: Fixtures) -> DataFrame:
    return f.collapse_foldbacks(fx.sql(_ALNS), "qname", "aln_n").select("qname", "aln_n", "is_foldback")


_SEGS = "select event_id, channel, (user_half * 2 - 1) * (1 + floor(event_id / 7) % 3) as a, (user_half * 2 - 1) * (1 + floor(event_id / 11) % 3) as b from (select *, event_id % 2 as user_half from fx_nodes_long) x"


@query("f22", f"WITH s AS ({_SEGS}) SELECT event_id FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.channel = s.channel AND t.event_id > s.event_id AND t.a = -s.b AND t.b = -s.a)")
def f22(fx: Fixtures) -> DataFrame:
    x = fx.sql(_SEGS).withColumn("path", F.array(c("a"), c("b")))
    return f.without_duplex_segments(x, "channel", "event_id", "path").select("event_id")


@query("f23", "SELECT event_id FROM fx_nodes_long WHERE (abs(pos1 - 5200) <= 100 AND abs(pos2 - 25200) <= 150) OR (abs(pos1 - 25200) <= 150 AND abs(pos2 - 5200) <= 100)")
def f23(fx: Fixtures) -> DataFrame:
    x = fx.nodes_long.select("event_id", c("pos1").alias("node1"), c("pos2").alias("node2"))
    return f.outer_primers(x, 5200, 25200, 150).where("abs(node1 - 5200) <= 100 or abs(node2 - 5200) <= 100").select("event_id")


@query("f24", "SELECT mol_id FROM fx_molecules WHERE NOT (chrom1 = 5 AND chrom2 = 5)")
def f24(fx: Fixtures) -> DataFrame:
    return f.nuclear_only(fx.molecules.withColumn("chroms", F.array("chrom1", "chrom2")), "chroms", 5).select("mol_id")


@query("f25", """SELECT seq_id AS sv_id, side FROM (SELECT seq_id, s AS side, substr(seq, 1, 6 + (seq_id % 4)::INT) AS clip, ref_seq FROM fx_sequences, range(1, 3) t(s) WHERE seq_id % 7 > 0)
 WHERE CASE WHEN side = 1 THEN 1 - hamming(substr(clip, 1, least(length(clip), 8)), substr(ref_seq, 1, least(length(clip), 8))) / least(length(clip), 8)
 ELSE 1 - hamming(substr(clip, length(clip) - least(length(clip), 8) + 1), substr(ref_seq, 8 - least(length(clip), 8) + 1, least(length(clip), 8))) / least(length(clip), 8) END >= 0.35""")  # fmt: skip
def f25(fx: Fixtures) -> DataFrame:
    s = fx.sequences
    clips = s.select(c("seq_id").alias("sv_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("side"), F.substr("seq", F.lit(1), (6 + c("seq_id") % 4).cast("int")).alias("clip_seq"))
    first8 = F.substr("ref_seq", F.lit(1), F.lit(8))
    refs = s.select(c("seq_id").alias("sv_id"), F.when(c("seq_id") % 7 > 0, c("seq")).alias("jxn_seq"), first8.alias("clip_seq1"), first8.alias("clip_seq2"))
    return f.valid_clips(clips, refs, 0.35).select("sv_id", "side")


@query("f26", "SELECT chrom, bin_n FROM (SELECT *, max(start0) OVER (PARTITION BY chrom) AS l FROM fx_genome_bins) WHERE start0 < l AND gc_fraction BETWEEN 0.35 AND 0.6 AND excluded / (end1 - start0) <= 0.0012")
def f26(fx: Fixtures) -> DataFrame:
    return f.bin_filters(fx.genome_bins.withColumn("mappability", F.lit(1.0)), 0.9, (0.35, 0.6), 0.0012).select("chrom", "bin_n")


_PAIRS = "select qname, aln_n as read_n, mapq % 11 = 0 as is_unmapped, qname % 3 = 0 as is_merged, chrom, pos from fx_alignments"


@query("f27", f"""WITH p AS ({_PAIRS}), k AS (SELECT * FROM (SELECT *, bool_or(is_unmapped) OVER (PARTITION BY qname) AS u FROM p) WHERE NOT u)
 SELECT qname, 'A' AS edge_type, read_n, chrom AS chrom1, pos AS pos1, chrom AS chrom2, pos AS pos2 FROM k UNION ALL
 SELECT qname, 'M', NULL, min_by(chrom, read_n), min_by(pos, read_n), max_by(chrom, read_n), max_by(pos, read_n) FROM k WHERE NOT is_merged GROUP BY qname HAVING count(*) > 1""")  # fmt: skip
def f27(fx: Fixtures) -> DataFrame:
    return f.reject_unmapped(fx.sql(_PAIRS))
