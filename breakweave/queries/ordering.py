"""W: windows and ordered operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..functions.analysis import log_nbinom_pmf
from ..operators import ordered as o
from . import query

c = F.col

BREAKS_SQL = """ev AS (SELECT chrom, start0 AS pos, 1 AS d FROM fx_spans UNION ALL SELECT chrom, end1, -1 FROM fx_spans),
 ch AS (SELECT chrom, pos, sum(d) AS d FROM ev GROUP BY ALL HAVING sum(d) <> 0), br AS (SELECT chrom, pos, (sum(d) OVER (PARTITION BY chrom ORDER BY pos))::BIGINT AS depth FROM ch),
 steps AS (SELECT * FROM (SELECT chrom, pos AS start0, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end1, depth FROM br) WHERE depth > 0)"""


@query("w1", f"WITH {BREAKS_SQL} SELECT chrom, pos, depth FROM br")
def w1(fx: Fixtures) -> DataFrame:
    return o.coverage_breaks(fx.spans)


@query("w2", f"""WITH {BREAKS_SQL}, x AS (SELECT chrom, k AS chunk_n, depth * (least(end1, (k + 1) * 65536) - greatest(start0, k * 65536)) AS a FROM steps, range(0, 3) t(k) WHERE start0 < (k + 1) * 65536 AND end1 > k * 65536)
 SELECT chrom, chunk_n, floor(sum(a) * 10 / 65536 + 0.5) / 10 AS mean_depth FROM x GROUP BY ALL""")  # fmt: skip
def w2(fx: Fixtures) -> DataFrame:
    return o.chunk_mean_coverage(o.coverage_steps(fx.spans))


@query("w3", """SELECT mol_id, chrom, start0, end1 FROM fx_spans WHERE mol_class = 'P' AND mol_id % 4 > 0 UNION ALL SELECT mol_id, chrom, start0 + 3, end1 - 2 FROM fx_spans WHERE mol_class = 'P' AND mol_id % 4 = 0
 UNION ALL SELECT mol_id, chrom, start0, start0 + 40 FROM fx_spans WHERE mol_class = 'V' UNION ALL SELECT mol_id, chrom, end1 - 40, end1 FROM fx_spans WHERE mol_class = 'V'""")  # fmt: skip
def w3(fx: Fixtures) -> DataFrame:
    aln = lambda a, b: F.struct(a.alias("start0"), b.alias("end1"))
    x = fx.spans.withColumns({"is_clipped": c("mol_id") % 4 == 0, "mapped0": c("start0") + 3, "mapped1": c("end1") - 2, "alns": F.array(aln(c("start0"), c("start0") + 40), aln(c("end1") - 40, c("end1")))})
    return o.expand_spans(x)


@query("w4", """WITH s AS (SELECT chrom, start0 // 1000 AS a, (end1 - 1) // 1000 AS b, CASE WHEN mol_id % 17 = 0 THEN -1 ELSE 1 END AS w FROM fx_spans), g AS (SELECT DISTINCT chrom, i AS window_n FROM fx_spans, range(0, 101) t(i))
 SELECT g.chrom, g.window_n, coalesce(sum(w), 0)::BIGINT AS depth FROM g LEFT JOIN s ON s.chrom = g.chrom AND g.window_n BETWEEN s.a AND s.b GROUP BY ALL""")  # fmt: skip
def w4(fx: Fixtures) -> DataFrame:
    grid = fx.spans.select("chrom").distinct().select("chrom", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("window_n"))
    spans = fx.spans.withColumn("w", F.when(c("mol_id") % 17 == 0, -1).otherwise(1))
    return o.window_coverage(spans, 1000, grid.withColumn("window_n", c("window_n").cast("long")), "w")


@query("w5", "SELECT sample, mol_id, chrom1, side1, pos1, chrom2, side2, pos2 FROM fx_molecules")
def w5(fx: Fixtures) -> DataFrame:
    m = fx.molecules
    one = m.select("sample", "mol_id", F.lit(1).alias("node_n"), c("chrom1").alias("chrom"), c("side1").alias("side"), c("pos1").alias("pos"))
    two = m.select("sample", "mol_id", F.lit(2).alias("node_n"), c("chrom2").alias("chrom"), c("side2").alias("side"), c("pos2").alias("pos"))
    return o.pair_nodes(one.unionByName(two), ["sample", "mol_id"])


@query("w6", """SELECT mol_id, (sum(g) OVER (PARTITION BY sample, chrom1 ORDER BY pos1, mol_id))::BIGINT AS group_n FROM (SELECT *, coalesce((pos1 - lag(pos1) OVER (PARTITION BY sample, chrom1 ORDER BY pos1, mol_id) > 1)::INT, 0) AS g FROM fx_molecules)""")
def w6(fx: Fixtures) -> DataFrame:
    return o.gap_group(fx.molecules, ["sample", "chrom1"], "pos1", 1, "group_n").select("mol_id", "group_n")


def _two(keys: str, limit: int) -> str:
    return f"""g1 AS (SELECT *, sum(g) OVER (PARTITION BY {keys} ORDER BY pos1, mol_id) AS group1 FROM (SELECT *, coalesce((pos1 - lag(pos1) OVER (PARTITION BY {keys} ORDER BY pos1, mol_id) > {limit})::INT, 0) AS g FROM fx_molecules)),
 g2 AS (SELECT *, sum(h) OVER (PARTITION BY {keys}, group1 ORDER BY pos2, mol_id) AS group2 FROM (SELECT *, coalesce((pos2 - lag(pos2) OVER (PARTITION BY {keys}, group1 ORDER BY pos2, mol_id) > {limit})::INT, 0) AS h FROM g1))"""


@query("w7", f"WITH {_two('sample, chrom1, chrom2', 1)} SELECT mol_id, group1::BIGINT AS group1, group2::BIGINT AS group2 FROM g2")
def w7(fx: Fixtures) -> DataFrame:
    return o.gap_group_2d(fx.molecules, ["sample", "chrom1", "chrom2"], "pos1", "pos2", 1).select("mol_id", "group1", "group2")


GROUPS_SQL = f"""{_two('chrom1, chrom2, side1, side2', 762)}, n AS (SELECT chrom1, chrom2, side1, side2, group1, group2 FROM g2 GROUP BY ALL HAVING count(*) >= 3),
 groups AS (SELECT m.*, k.group_id FROM g2 m JOIN (SELECT *, row_number() OVER (ORDER BY chrom1, chrom2, side1, side2, group1, group2) AS group_id FROM n) k USING (chrom1, chrom2, side1, side2, group1, group2))"""


@query("w8", f"WITH {GROUPS_SQL} SELECT mol_id, group_id FROM groups")
def w8(fx: Fixtures) -> DataFrame:
    return o.continuity_groups(fx.molecules, ["chrom1", "chrom2", "side1", "side2"], 762, 3).select("mol_id", "group_id")


@query("w9", """SELECT qname, k AS jxn_n, chrom AS chrom1, pos AS pos1, chrom2, pos2 FROM (SELECT *, row_number() OVER w AS k, lead(chrom) OVER w AS chrom2, lead(pos) OVER w AS pos2 FROM fx_alignments WINDOW w AS (PARTITION BY qname ORDER BY split_part(cigar, 'S', 1)::INT, aln_n)) WHERE pos2 IS NOT NULL""")
def w9(fx: Fixtures) -> DataFrame:
    clip = F.split("cigar", "S")[0].cast("int")
    return o.adjacent_junctions(fx.alignments, "qname", [clip, "aln_n"], ["chrom", "pos"])


@query("w10", """SELECT qname, aln_n, CASE WHEN aln_n % 2 = 1 THEN mapq ELSE least(lag(mapq) OVER w, lead(mapq) OVER w) END AS mapq FROM fx_alignments WINDOW w AS (PARTITION BY qname ORDER BY aln_n)""")
def w10(fx: Fixtures) -> DataFrame:
    x = fx.alignments.withColumn("edge_type", F.when(c("aln_n") % 2 == 1, "A").otherwise("J"))
    return o.flank_min(x, "qname", "aln_n", ["mapq"]).select("qname", "aln_n", "mapq")


@query("w11", """WITH a AS (SELECT qname, aln_n, regexp_extract_all(cigar, '([0-9]+)[A-Z]', 1) AS s, regexp_extract(cigar, '[DI]') AS op FROM fx_alignments), b AS (SELECT qname, aln_n, s[2]::INT AS m1, s[3]::INT AS x, s[4]::INT AS m2, op FROM a),
 d AS (SELECT *, CASE WHEN op = 'D' THEN x ELSE 0 END AS dl, CASE WHEN op = 'I' THEN x ELSE 0 END AS il FROM b)
 SELECT qname, aln_n, 1 AS edge_n, 'A' AS edge_type, 0 AS ref_start, CASE WHEN x >= 20 THEN m1 ELSE m1 + dl + m2 END AS ref_end, CASE WHEN x >= 20 THEN m1 ELSE m1 + dl + m2 END AS size, 0 AS insert_size FROM d
 UNION ALL SELECT qname, aln_n, 2, 'J', m1, m1 + dl, dl, il FROM d WHERE x >= 20 UNION ALL SELECT qname, aln_n, 3, 'A', m1 + dl, m1 + dl + m2, m2, 0 FROM d WHERE x >= 20""")  # fmt: skip
def w11(fx: Fixtures) -> DataFrame:
    return o.split_cigar_svs(fx.alignments, ["qname", "aln_n"], 20)


@query("w12", """SELECT event_id, (1 + sum(b) OVER (PARTITION BY channel ORDER BY event_id))::BIGINT AS block_n FROM (SELECT *, k + coalesce(lag(k) OVER (PARTITION BY channel ORDER BY event_id), 0) AS b FROM (SELECT *, (event_id % 5 = 0)::INT AS k FROM fx_nodes_long))""")
def w12(fx: Fixtures) -> DataFrame:
    return o.block_numbers(fx.nodes_long, "channel", "event_id", c("event_id") % 5 == 0).select("event_id", "block_n")


SEGMENTS_SQL = """edges AS (SELECT event_id, channel, pos1, pos2, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'D' END AS edge_type, event_id % 3 > 0 AS fusable FROM fx_nodes_long),
 segs AS (SELECT *, CASE WHEN edge_type = 'A' OR fusable THEN 1 + sum((edge_type <> 'A' AND NOT fusable)::INT) OVER (PARTITION BY channel ORDER BY event_id) END::BIGINT AS segment_n FROM edges)"""


def segments(fx: Fixtures) -> DataFrame:
    x = fx.nodes_long.select("event_id", "channel", "pos1", "pos2", F.when(c("event_id") % 2 == 0, "A").otherwise("D").alias("edge_type"), (c("event_id") % 3 > 0).alias("fusable"))
    return o.split_to_segments(x, "channel", "event_id", "fusable")


@query("w13", f"WITH {SEGMENTS_SQL} SELECT event_id, segment_n FROM (SELECT *, bool_or(pos1 % 10 = 0) OVER (PARTITION BY channel, segment_n) AS h FROM segs WHERE segment_n IS NOT NULL) WHERE h")
def w13(fx: Fixtures) -> DataFrame:
    return o.segments_with(segments(fx), "channel", c("pos1") % 10 == 0).select("event_id", "segment_n")


@query("w14", f"WITH {GROUPS_SQL} SELECT group_id, mol_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY node_class DESC, mapq1 + mapq2 DESC, mol_id) AS k FROM groups) WHERE k = 1")
def w14(fx: Fixtures) -> DataFrame:
    x = o.continuity_groups(fx.molecules, ["chrom1", "chrom2", "side1", "side2"], 762, 3)
    return o.first_in_group(x, ["group_id"], [F.desc("node_class"), F.desc(c("mapq1") + c("mapq2")), "mol_id"]).select("group_id", "mol_id")


@query("w15", """WITH b AS (SELECT cell_id, chrom, bin_n, n, n % 2 + 1 AS cn FROM fx_bin_counts), r AS (SELECT *, bin_n - row_number() OVER () AS z, (row_number() OVER (PARTITION BY cell_id, chrom ORDER BY bin_n)) - (row_number() OVER (PARTITION BY cell_id, chrom, cn ORDER BY bin_n)) AS run FROM b)
 SELECT cell_id, chrom, cn, min(bin_n) AS first, max(bin_n) AS last, count(*) AS n, round(avg(n), 6) AS mean_n FROM r GROUP BY cell_id, chrom, cn, run""")  # fmt: skip
def w15(fx: Fixtures) -> DataFrame:
    x = fx.bin_counts.withColumn("cn", c("n") % 2 + 1)
    return o.run_length_segments(x, ["cell_id", "chrom"], "bin_n", "cn", "n").withColumn("mean_n", F.round("mean_n", 6))


@query("w16", """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY cell_id, chrom ORDER BY bin_n) - 1) // 8 AS w FROM fx_bin_counts), s AS (SELECT cell_id, chrom, w AS window_n, sum(n) * 8 / count(*) AS n FROM r GROUP BY ALL)
 SELECT cell_id, chrom, window_n, window_n * 8 + i AS bin_n, round(n, 6) AS n FROM s, range(0, 8) t(i)""")  # fmt: skip
def w16(fx: Fixtures) -> DataFrame:
    w = o.collapse_bins(fx.bin_counts, ["cell_id", "chrom"], "bin_n", "n", 8)
    return o.expand_windows(w, 8).select("cell_id", "chrom", "window_n", "bin_n", F.round("n", 6).alias("n"))


def viterbi_sql(source: str, k: int, persistence: float) -> str:
    """Common table expressions to ``path``: the best states of ``cell_id, chrom, bin_n, e`` (list of k log densities)."""
    import math

    stay, move = math.log(persistence), math.log((1 - persistence) / max(1, k - 1))
    to = [f"[{', '.join(f's[{j}] + {stay if i == j else move}::DOUBLE' for j in range(1, k + 1))}]" for i in range(1, k + 1)]
    score = ", ".join(f"list_max({t}) + b.e[{i}]" for i, t in enumerate(to, 1))
    back = ", ".join(f"list_position({t}, list_max({t}))" for t in to)
    return f"""vb AS (SELECT *, row_number() OVER (PARTITION BY cell_id, chrom ORDER BY bin_n) AS i, count(*) OVER (PARTITION BY cell_id, chrom) AS n_rows FROM {source}),
 vf(cell_id, chrom, bin_n, i, n_rows, s, back) AS (SELECT cell_id, chrom, bin_n, i, n_rows, e, NULL::BIGINT[] FROM vb WHERE i = 1
 UNION ALL SELECT b.cell_id, b.chrom, b.bin_n, b.i, b.n_rows, [{score}], [{back}]::BIGINT[] FROM vf JOIN vb b ON b.cell_id = vf.cell_id AND b.chrom = vf.chrom AND b.i = vf.i + 1),
 vp(cell_id, chrom, bin_n, i, back, st) AS (SELECT cell_id, chrom, bin_n, i, back, list_position(s, list_max(s))::BIGINT FROM vf WHERE i = n_rows
 UNION ALL SELECT v.cell_id, v.chrom, v.bin_n, v.i, v.back, vp.back[vp.st] FROM vp JOIN vf v ON v.cell_id = vp.cell_id AND v.chrom = vp.chrom AND v.i = vp.i - 1),
 path AS (SELECT vp.cell_id, vp.chrom, vp.bin_n, CASE WHEN vb.n_rows > 1 THEN (vp.st - 1)::INT END AS state FROM vp JOIN vb USING (cell_id, chrom, bin_n))"""


_W17 = ", ".join(f"lgamma(n + 4.0) - lgamma(4.0) - lgamma(n + 1.0) + 4.0 * ln(4.0 / (4.0 + {max(0.05, 0.5 * k)})) + n * ln({max(0.05, 0.5 * k)} / (4.0 + {max(0.05, 0.5 * k)}))" for k in range(5))


@query("w17", f"WITH RECURSIVE em AS (SELECT cell_id, chrom, bin_n, [{_W17}] AS e FROM fx_bin_counts), {viterbi_sql('em', 5, 0.99)} SELECT cell_id, chrom, bin_n, state FROM path")
def w17(fx: Fixtures) -> DataFrame:
    """Copy-number paths of bin counts by negative-binomial emissions of five states."""
    n = c("n").cast("double")
    p = F.array(*[log_nbinom_pmf(n, F.lit(max(0.05, 0.5 * k)), F.lit(4.0)) for k in range(5)])
    return o.viterbi_cn(fx.bin_counts.withColumn("e", p), ["cell_id", "chrom"], "bin_n", "e", 0.99)


@query("w18", "SELECT sample, chrom1, mol_id FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom1 ORDER BY md5('7|' || mol_id), mol_id) AS k FROM fx_molecules) WHERE k <= 11")
def w18(fx: Fixtures) -> DataFrame:
    return o.downsample_per_group(fx.molecules, ["sample", "chrom1"], 11, "mol_id", "7").select("sample", "chrom1", "mol_id")


@query("w18_balanced", """WITH r AS (SELECT mol_id, side1, row_number() OVER (PARTITION BY side1 ORDER BY md5('0|' || mol_id), mol_id) AS k FROM fx_molecules), n AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM fx_molecules GROUP BY side1))
 SELECT mol_id, side1 FROM r, n WHERE k <= n.n""")  # fmt: skip
def w18_balanced(fx: Fixtures) -> DataFrame:
    """As many molecules of each side as there are of the rarer one."""
    return o.balanced_sample(fx.molecules.select("mol_id", "side1"), "side1", "mol_id")


@query("w19", "SELECT chrom1, pos1, n, row_number() OVER (ORDER BY n DESC, chrom1, pos1) AS junction_n FROM (SELECT chrom1, pos1, count(*) AS n FROM fx_molecules GROUP BY ALL)")
def w19(fx: Fixtures) -> DataFrame:
    x = fx.molecules.groupBy("chrom1", "pos1").agg(F.count("*").alias("n"))
    return o.dense_ids(x, [F.desc("n"), c("chrom1"), c("pos1")], "junction_n")


@query("w20", """SELECT cell_id, chrom, bin_n, (sum(n) OVER w)::BIGINT AS rolling_n, round(avg(bin_n) OVER w, 6) AS rolling_bin_n FROM fx_bin_counts WINDOW w AS (PARTITION BY cell_id, chrom ORDER BY bin_n ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def w20(fx: Fixtures) -> DataFrame:
    x = o.rolling_bins(fx.bin_counts, ["cell_id", "chrom"], "bin_n", 2, ["n"], ["bin_n"])
    return x.select("cell_id", "chrom", "bin_n", "rolling_n", F.round("rolling_bin_n", 6).alias("rolling_bin_n"))


@query("w21", """WITH s AS (SELECT mol_id, mol_id % 50 AS read, chrom, start0, end1 FROM fx_spans), n AS (SELECT *, coalesce((start0 > max(end1) OVER (PARTITION BY read, chrom ORDER BY start0, end1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100)::INT, 0) AS k FROM s)
 SELECT mol_id, (sum(k) OVER (PARTITION BY read, chrom ORDER BY start0, end1 ROWS UNBOUNDED PRECEDING))::BIGINT AS locus_n FROM n""")  # fmt: skip
def w21(fx: Fixtures) -> DataFrame:
    return o.alignment_loci(fx.spans.withColumn("read", c("mol_id") % 50), ["read"], 100).select("mol_id", "locus_n")


@query("w22", "SELECT mol_id, row_number() OVER (PARTITION BY side1, node_class ORDER BY abs(pos2 - pos1) DESC, mol_id) AS row_n FROM fx_molecules")
def w22(fx: Fixtures) -> DataFrame:
    return o.pileup_rows(fx.molecules, ["side1", "node_class"], [F.desc(F.abs(c("pos2") - c("pos1"))), "mol_id"]).select("mol_id", "row_n")
