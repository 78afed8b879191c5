"""E: expressions of one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..functions import analysis as an
from ..functions import junctions as jx
from ..functions import reads as rd
from ..functions import sequences as sq
from . import query

c = F.col


def r6(x):
    return F.round(x, 6)


@query("e1", """SELECT o_orderkey AS id, (f & 1) <> 0 AS is_paired, (f & 2) <> 0 AS is_proper, (f & 4) <> 0 AS is_unmapped,
 (f & 16) <> 0 AS is_reverse, (f & 64) <> 0 AS is_first, (f & 128) <> 0 AS is_second, (f & 2048) <> 0 AS is_supplementary,
 (((f & 16) <> 0)::INT + ((f & 128) <> 0)::INT) % 2 AS strand FROM (SELECT o_orderkey, o_orderkey % 4096 AS f FROM orders)""")  # fmt: skip
def e1(fx: Fixtures) -> DataFrame:
    return fx.table("orders").select(c("o_orderkey").alias("id"), *[v.alias(k) for k, v in rd.decode_flag(c("o_orderkey") % 4096).items()])


_OPS = """ops AS (SELECT qname, aln_n, chrom, pos, is_reverse, mapq, cigar, unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1))::INT AS size,
 unnest(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 2)) AS op, generate_subscripts(regexp_extract_all(cigar, '([0-9]+)([A-Z])', 1), 1) - 1 AS op_index FROM fx_alignments)"""


@query("e2", f"""WITH {_OPS} SELECT qname, aln_n, op_index, size, op,
 coalesce(sum(CASE WHEN op IN ('D', 'M') THEN size ELSE 0 END) OVER w, 0)::BIGINT AS ref_offset,
 coalesce(sum(CASE WHEN op IN ('S', 'H', 'I', 'M') THEN size ELSE 0 END) OVER w, 0)::BIGINT AS qry_offset FROM ops
 WINDOW w AS (PARTITION BY qname, aln_n ORDER BY op_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")  # fmt: skip
def e2(fx: Fixtures) -> DataFrame:
    return rd.explode_cigar(fx.alignments, ["qname", "aln_n"])


@query("e3", f"""WITH {_OPS} SELECT qname, aln_n, sum(size) FILTER (WHERE op IN ('M', 'D'))::BIGINT AS ref_span,
 any_value(pos) + sum(size) FILTER (WHERE op IN ('M', 'D'))::BIGINT - 1 AS aln_end FROM ops GROUP BY ALL""")  # fmt: skip
def e3(fx: Fixtures) -> DataFrame:
    return fx.alignments.select("qname", "aln_n", rd.ref_span(c("cigar")).alias("ref_span"), rd.aln_end(c("pos"), c("cigar")).alias("aln_end"))


@query("e4", """SELECT qname, aln_n, split_part(cigar, 'S', 1)::INT AS left_clip, regexp_extract(cigar, '([0-9]+)S$', 1)::INT AS right_clip,
 CASE WHEN split_part(cigar, 'S', 1)::INT >= 5 THEN substr('ACGTTGCAACGTTGCA', 1, split_part(cigar, 'S', 1)::INT) END AS left_seq FROM fx_alignments""")  # fmt: skip
def e4(fx: Fixtures) -> DataFrame:
    left, right = rd.clip_lengths(c("cigar"))
    seq, _ = rd.clip_sequence(F.lit("ACGTTGCAACGTTGCA"), c("cigar"))
    return fx.alignments.select("qname", "aln_n", left.alias("left_clip"), right.alias("right_clip"), seq.alias("left_seq"))


@query("e5", "SELECT mol_id, chrom1 || ':' || side1 || ':' || pos1 AS node, chrom1 AS chrom, side1 AS side, pos1 AS pos FROM fx_molecules")
def e5(fx: Fixtures) -> DataFrame:
    x = fx.molecules.select("mol_id", jx.pack_node(c("chrom1"), c("side1"), c("pos1")).alias("node"))
    chrom, side, pos = jx.unpack_node(c("node"))
    return x.select("mol_id", "node", chrom.alias("chrom"), side.alias("side"), pos.alias("pos"))


def chromosome_sizes(fx: Fixtures) -> DataFrame:
    return fx.spark.range(1, 6).select(c("id").cast("int").alias("chrom"), (c("id") * 1000000).alias("size"))


@query("e6", """SELECT mol_id, n AS node, chrom1 AS chrom, pos1 AS pos, strand FROM (SELECT *, (side1 = 'R')::INT AS strand,
 (CASE WHEN side1 = 'R' THEN -1 ELSE 1 END) * (pos1 + 500000 * chrom1 * (chrom1 - 1)) AS n FROM fx_molecules)""")  # fmt: skip
def e6(fx: Fixtures) -> DataFrame:
    x = fx.molecules.select("mol_id", "chrom1", "pos1", (c("side1") == "R").cast("int").alias("s"))
    sizes = chromosome_sizes(fx)
    x = jx.with_signed_node(x, sizes, "chrom1", "pos1", "s").select("mol_id", "node")
    return jx.with_node_position(x, sizes, "node").select("mol_id", "node", "chrom", "pos", "strand")


@query("e7", "SELECT mol_id, (pos1 - 1) // 1000 AS window_i, ((pos1 - 1) // 1000) * 1000 + 1 AS window_start FROM fx_molecules")
def e7(fx: Fixtures) -> DataFrame:
    i = jx.window_index(c("pos1"), 1000)
    return fx.molecules.select("mol_id", i.alias("window_i"), jx.window_start(i, 1000).alias("window_start"))


_SIGNED = "CASE WHEN event_id % 3 = 0 THEN -pos1 ELSE pos1 END AS n1, CASE WHEN event_id % 5 < 2 THEN -pos2 ELSE pos2 END AS n2"


@query("e8", f"""SELECT event_id, is_canonical, CASE WHEN is_canonical THEN n1 ELSE -n2 END AS node1, CASE WHEN is_canonical THEN n2 ELSE -n1 END AS node2,
 (CASE WHEN is_canonical THEN n1 ELSE -n2 END) || ':' || (CASE WHEN is_canonical THEN n2 ELSE -n1 END) || ':' || insert_size AS junction_key
 FROM (SELECT *, CASE WHEN abs(n1) <= abs(n2) THEN n1 > 0 ELSE n2 > 0 END AS is_canonical FROM (SELECT event_id, insert_size, {_SIGNED} FROM fx_nodes_long))""")  # fmt: skip
def e8(fx: Fixtures) -> DataFrame:
    x = fx.nodes_long.selectExpr("event_id", "insert_size", *_SIGNED.split(", "))
    ok, a, b = jx.canonical_nodes(c("n1"), c("n2"))
    return x.select("event_id", ok.alias("is_canonical"), a.alias("node1"), b.alias("node2"), jx.junction_key(a, b, c("insert_size")).alias("junction_key"))


_TYPE = """CASE WHEN chrom1 <> chrom2 THEN 'T' WHEN side1 = side2 THEN 'I' ELSE CASE WHEN node_class = 0 THEN
 CASE WHEN dist < -302 THEN 'D' WHEN dist > 1222 THEN 'L' ELSE 'P' END ELSE CASE WHEN dist <= 0 THEN 'D' WHEN dist > 1 THEN 'L' ELSE 'P' END END END"""
_DIST = "(SELECT *, CASE WHEN side1 = 'L' THEN pos2 - pos1 ELSE pos1 - pos2 END AS dist FROM fx_molecules)"


def typed(fx: Fixtures) -> DataFrame:
    m = fx.molecules
    return m.withColumn("jxn_type", jx.junction_type(*[c(x) for x in ("chrom1", "side1", "pos1", "chrom2", "side2", "pos2", "node_class")], 762, 151))


@query("e9", f"""SELECT mol_id, CASE WHEN side1 = side2 THEN CASE WHEN jxn_type = 'I' THEN pos1 < pos2 ELSE chrom1 < chrom2 END ELSE side1 = 'L' END AS is_canonical
 FROM (SELECT *, {_TYPE} AS jxn_type FROM {_DIST})""")
def e9(fx: Fixtures) -> DataFrame:
    ok = jx.is_canonical_pair(*[c(x) for x in ("chrom1", "side1", "pos1", "chrom2", "side2", "pos2", "jxn_type")])
    return typed(fx).select("mol_id", ok.alias("is_canonical"))


@query("e10", f"SELECT mol_id, {_TYPE} AS jxn_type FROM {_DIST}")
def e10(fx: Fixtures) -> DataFrame:
    return typed(fx).select("mol_id", "jxn_type")


@query("e11", f"""SELECT event_id, CASE WHEN c1 <> c2 THEN 'T' WHEN sign(n1) <> sign(n2) THEN 'V' WHEN n2 - n1 <= 0 THEN 'U' WHEN n2 - n1 > 1 THEN 'D' ELSE '?' END AS kind,
 CASE WHEN c1 <> c2 THEN 0 WHEN sign(n1) <> sign(n2) THEN abs(n1 + n2) WHEN n2 - n1 <= 0 THEN 1 - (n2 - n1) ELSE n2 - n1 - 1 END AS size
 FROM (SELECT event_id, event_id % 4 // 3 AS c1, event_id % 7 // 6 AS c2, {_SIGNED} FROM fx_nodes_long)""")  # fmt: skip
def e11(fx: Fixtures) -> DataFrame:
    x = fx.nodes_long.selectExpr("event_id", "event_id % 4 div 3 as c1", "event_id % 7 div 6 as c2", *_SIGNED.split(", "))
    kind, size = jx.long_read_edge(c("n1"), c("n2"), c("c1"), c("c2"))
    return x.select("event_id", kind.alias("kind"), size.alias("size"))


@query("e12", """SELECT event_id, CASE WHEN insert_size > 0 AND k IN ('D', 'I') THEN CASE WHEN s > 0 THEN 'D' ELSE 'I' END ELSE k END AS kind
 FROM (SELECT event_id, insert_size, substr('TDIV', (event_id % 4 + 1)::INT, 1) AS k, event_id % 3 * 50 AS s FROM fx_nodes_long)""")  # fmt: skip
def e12(fx: Fixtures) -> DataFrame:
    x = fx.nodes_long.selectExpr("event_id", "insert_size", "substr('TDIV', cast(event_id % 4 + 1 as int), 1) as k", "event_id % 3 * 50 as s")
    return x.select("event_id", jx.edge_type_with_insertion(c("k"), c("s"), c("insert_size")).alias("kind"))


@query("e13", """SELECT mol_id, CASE WHEN s1 = s2 THEN s1 WHEN chrom1 <> chrom2 THEN (chrom1 > chrom2)::INT ELSE (pos1 > pos2)::INT END AS strand,
 CASE WHEN strand_count1 > 0 AND strand_count2 > 0 THEN 2 WHEN strand_count2 > 0 THEN 1 ELSE 0 END AS count_strand
 FROM (SELECT *, (side1 = 'R')::INT AS s1, (side2 = 'L')::INT AS s2 FROM fx_molecules)""")  # fmt: skip
def e13(fx: Fixtures) -> DataFrame:
    s = rd.molecule_strand((c("side1") == "R").cast("int"), (c("side2") == "L").cast("int"), c("chrom1"), c("chrom2"), c("pos1"), c("pos2"))
    return fx.molecules.select("mol_id", s.alias("strand"), rd.strand_of_counts(c("strand_count1"), c("strand_count2")).alias("count_strand"))


@query("e14", """SELECT mol_id, CASE WHEN side1 = 'L' THEN out_pos1 + clip_len1 ELSE out_pos1 - clip_len1 END AS outer_pos,
 '1:' || chrom1 || ':' || side1 || ':' || greatest(1, CASE WHEN side1 = 'L' THEN out_pos1 + clip_len1 ELSE out_pos1 - clip_len1 END) || ':' || (clip_len1 >= 5)::INT AS signature FROM fx_molecules""")  # fmt: skip
def e14(fx: Fixtures) -> DataFrame:
    return fx.molecules.select(
        "mol_id",
        rd.outer_pos(c("out_pos1"), c("side1"), c("clip_len1")).alias("outer_pos"),
        rd.endpoint_signature(F.lit(1), c("chrom1"), c("side1"), c("out_pos1"), c("clip_len1")).alias("signature"),
    )


@query("e15", """SELECT s.seq_id, reverse(translate(s.seq, 'ACGT', 'TGCA')) AS rc, a.cigar_rc FROM fx_sequences s LEFT JOIN (SELECT qname,
 array_to_string(list_reverse(regexp_extract_all(min(cigar), '[0-9]+[A-Z]')), '') AS cigar_rc FROM fx_alignments GROUP BY qname) a ON a.qname = s.seq_id""")  # fmt: skip
def e15(fx: Fixtures) -> DataFrame:
    a = fx.alignments.groupBy("qname").agg(F.min("cigar").alias("cigar"))
    x = fx.sequences.join(a, c("qname") == c("seq_id"), "left")
    return x.select("seq_id", sq.reverse_complement(c("seq")).alias("rc"), sq.reverse_cigar(c("cigar")).alias("cigar_rc"))


@query("e16", """SELECT seq_id, p1 AS read_pos1, p2 AS read_pos2, p1 - p2 + 1 AS microhomology,
 CASE WHEN p1 - p2 + 1 > 0 THEN substr(seq, p2, p1 - p2 + 1) WHEN p1 - p2 + 1 < 0 THEN substr(seq, p1 + 1, p2 - p1 - 1) ELSE '' END AS bases
 FROM (SELECT seq_id, seq, 64 - (seq_id % 40)::INT AS p1, CASE WHEN seq_id % 3 = 0 THEN (seq_id % 37)::INT + 1 ELSE 64 - 20 + (seq_id % 17)::INT + 1 END AS p2 FROM fx_sequences)""")  # fmt: skip
def e16(fx: Fixtures) -> DataFrame:
    clip2 = F.when(c("seq_id") % 3 == 0, c("seq_id") % 37).otherwise(c("seq_id") % 17).cast("int")
    merge = F.when(c("seq_id") % 3 == 0, 0).otherwise(20)
    s = jx.junction_structure(c("seq"), F.lit(64), (c("seq_id") % 40).cast("int"), clip2, merge)
    return fx.sequences.select("seq_id", *[v.alias(k) for k, v in s.items()])


@query("e17", """SELECT seq_id, CASE WHEN seq_id % 2 = 0 THEN coalesce((SELECT min(i) - 1 FROM range(1, 11) t(i) WHERE substr(seq, i, 1) <> substr(ref_seq, i, 1)), 10) ELSE 0 END AS shift FROM fx_sequences""")
def e17(fx: Fixtures) -> DataFrame:
    kind = F.when(c("seq_id") % 2 == 0, "D").otherwise("I")
    return fx.sequences.select("seq_id", an.shift_inline_junction(kind, F.substr("seq", F.lit(1), F.lit(10)), F.substr("ref_seq", F.lit(1), F.lit(10))).alias("shift"))


@query("e18", """SELECT seq_id, hamming(substr(seq, 1, 32), ref_seq) AS n_apart, round(1 - hamming(substr(seq, 33, 32), ref_seq) / 32, 6) AS matching FROM fx_sequences""")
def e18(fx: Fixtures) -> DataFrame:
    return fx.sequences.select("seq_id", sq.hamming(c("seq"), c("ref_seq")).alias("n_apart"), r6(sq.fraction_matching(c("seq"), c("ref_seq"), "right")).alias("matching"))


@query("e19", """WITH reg AS (SELECT seq_id, a, b, n, 1 - hamming(substr(a, 16 - n + 1, n), substr(b, 1, n)) / n AS score FROM
 (SELECT seq_id, substr(seq, 1, 16) AS a, substr(seq, 9 + (seq_id % 4)::INT, 16) AS b FROM fx_sequences), range(4, 17) t(n)),
 best AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY score DESC, n) AS k FROM reg)
 SELECT seq_id, n, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN substr(a, 1, 16 - n) || b END AS merged FROM best WHERE k = 1""")  # fmt: skip
def e19(fx: Fixtures) -> DataFrame:
    a, b = F.substr("seq", F.lit(1), F.lit(16)), F.substr("seq", 9 + (c("seq_id") % 4).cast("int"), F.lit(16))
    n, score, merged = sq.best_overlap(c("a"), c("b"), 4)
    return fx.sequences.select("seq_id", a.alias("a"), b.alias("b")).select("seq_id", n.alias("n"), r6(score).alias("score"), merged.alias("merged"))


@query("e20", "SELECT seq_id, round((64 - length(translate(seq, 'GC', ''))) / 64, 6) AS gc FROM fx_sequences")
def e20(fx: Fixtures) -> DataFrame:
    return fx.sequences.select("seq_id", r6(sq.gc_fraction(c("seq"))).alias("gc"))


@query("e21", """SELECT seq_id, round((SELECT avg(ascii(substr(seq, i, 1)) - 33) FROM range(5, 25) t(i)), 6) AS mean_qual FROM fx_sequences""")
def e21(fx: Fixtures) -> DataFrame:
    return fx.sequences.select("seq_id", r6(sq.mean_base_quality(c("seq"), 5, F.lit(20))).alias("mean_qual"))


@query("e22", """SELECT seq_id, (SELECT string_agg(CASE WHEN i <= 20 THEN greatest(substr(seq, i, 1), substr(ref_seq, i, 1)) ELSE substr(ref_seq, i, 1) END, '' ORDER BY i) FROM range(1, 33) t(i)) AS best FROM fx_sequences""")
def e22(fx: Fixtures) -> DataFrame:
    return fx.sequences.select("seq_id", sq.max_quality_string(F.array(F.substr("seq", F.lit(1), F.lit(20)), c("ref_seq"))).alias("best"))


@query("e23", """SELECT seq_id, CASE WHEN d > 5 THEN 6 ELSE d END AS distance FROM (SELECT seq_id,
 levenshtein(substr(seq, 33, 12 + (seq_id % 5)::INT), substr(ref_seq, 1 + (seq_id % 3)::INT, 12)) AS d FROM fx_sequences)""")  # fmt: skip
def e23(fx: Fixtures) -> DataFrame:
    a, b = F.substr("seq", F.lit(33), (12 + c("seq_id") % 5).cast("int")), F.substr("ref_seq", (1 + c("seq_id") % 3).cast("int"), F.lit(12))
    return fx.sequences.select("seq_id", sq.edit_distance(a, b, 5).alias("distance"))


_CALL = """SELECT mol_id AS sv_id, jxn_type, chrom1, side1, pos1, substr('ACGT', (pos1 % 4 + 1)::INT, 1) AS ref1, chrom2, side2, pos2, substr('ACGT', (pos2 % 4 + 1)::INT, 1) AS ref2,
 (mol_id % 9 - 4)::INT AS mh, substr('ACGTT', 1, abs(mol_id % 9 - 4)::INT) AS bases, CASE WHEN jxn_type = 'T' THEN 0 ELSE abs(pos2 - pos1) END AS sv_size"""


def calls(fx: Fixtures) -> DataFrame:
    mh = (c("mol_id") % 9 - 4).cast("int")
    letter = lambda p: F.substr(F.lit("ACGT"), (c(p) % 4 + 1).cast("int"), F.lit(1))
    return typed(fx).select(
        c("mol_id").alias("sv_id"), "jxn_type", "chrom1", "side1", "pos1", letter("pos1").alias("ref1"), "chrom2", "side2", "pos2", letter("pos2").alias("ref2"),
        mh.alias("microhomology"), F.substr(F.lit("ACGTT"), F.lit(1), F.abs(mh)).alias("bases"),
        F.when(c("jxn_type") == "T", 0).otherwise(F.abs(c("pos2") - c("pos1"))).alias("sv_size"),
    )


BREAKENDS_SQL = f"""WITH calls AS ({_CALL} FROM (SELECT *, {_TYPE} AS jxn_type FROM {_DIST})),
 two AS (SELECT *, 1 AS n, chrom1 AS chrom, side1 AS side, pos1 AS here, ref1 AS ref, chrom2 AS mc, side2 AS ms, pos2 AS mp FROM calls
 UNION ALL SELECT *, 2, chrom2, side2, pos2, ref2, chrom1, side1, pos1 FROM calls),
 x AS (SELECT *, CASE WHEN mh < 0 THEN bases ELSE '' END AS ins, (CASE ms WHEN 'L' THEN ']' ELSE '[' END) || mc || ':' ||
 (CASE WHEN mh > 0 AND side = 'R' THEN CASE WHEN ms = 'L' THEN mp - mh ELSE mp + mh END ELSE mp END) || (CASE ms WHEN 'L' THEN ']' ELSE '[' END) AS mate FROM two),
 y AS (SELECT *, reverse(translate(ins, 'ACGT', 'TGCA')) AS rc FROM x)
 SELECT sv_id || ':' || n AS id, chrom, CASE WHEN mh > 0 AND side = 'L' THEN here - mh ELSE here END AS pos, ref,
 CASE WHEN side = ms AND n = 1 AND side = 'L' THEN ref || ins || mate WHEN side = ms AND n = 1 THEN mate || rc || ref
  WHEN side = ms AND side = 'L' THEN ref || rc || mate WHEN side = ms THEN mate || ins || ref WHEN n = 1 THEN ref || ins || mate ELSE mate || ins || ref END AS alt,
 sv_id || ':' || (3 - n) AS mate_id, CASE WHEN jxn_type = 'L' THEN -sv_size ELSE sv_size END AS svlen, CASE WHEN mh > 0 THEN '0,' || mh ELSE '0,0' END AS cipos,
 greatest(0, mh) AS homlen, CASE WHEN mh > 0 THEN bases ELSE '.' END AS homseq FROM y"""


@query("e24", BREAKENDS_SQL)
def e24(fx: Fixtures) -> DataFrame:
    return jx.breakend_fields(calls(fx))


@query("e25", "SELECT mol_id, round(sqrt((mapq1 * mapq1 + mapq2 * mapq2) / 2), 6) AS mq FROM fx_molecules")
def e25(fx: Fixtures) -> DataFrame:
    return fx.molecules.select("mol_id", r6(jx.rms(F.array("mapq1", "mapq2"))).alias("mq"))


_TARGETED = """x AS (SELECT m.mol_id, a.name AS n1, b.name AS n2, a.name IS NOT NULL AND NOT (m.pos1 > a.start0 AND m.pos1 <= a.end1) AS j1,
 b.name IS NOT NULL AND NOT (m.pos2 > b.start0 AND m.pos2 <= b.end1) AS j2 FROM fx_molecules m
 LEFT JOIN fx_targets a ON a.chrom = m.chrom1 AND m.pos1 > a.start0 - 1000 AND m.pos1 <= a.end1 + 1000
 LEFT JOIN fx_targets b ON b.chrom = m.chrom2 AND m.pos2 > b.start0 - 1000 AND m.pos2 <= b.end1 + 1000)"""
TARGET_CLASS_SQL = f"""{_TARGETED}, y AS (SELECT *, CASE WHEN n1 IS NULL THEN '-' WHEN j1 THEN 'A' ELSE 'T' END AS c1, CASE WHEN n2 IS NULL THEN '-' WHEN j2 THEN 'A' ELSE 'T' END AS c2 FROM x),
 z AS (SELECT *, CASE WHEN c2 > c1 THEN c2 || c1 ELSE c1 || c2 END AS cc FROM y),
 classed AS (SELECT mol_id, CASE WHEN n1 IS NOT DISTINCT FROM n2 THEN cc ELSE lower(cc) END AS target_class FROM z)"""


def with_target_class(fx: Fixtures) -> DataFrame:
    """Molecules with the class of their two ends; regions are padded by 1000 bases."""
    from ..operators.joins import position_in_target

    m = fx.molecules
    for k in "12":
        m = position_in_target(m, fx.targets, f"chrom{k}", f"pos{k}", padding=1000, prefix=f"t{k}_")
    return m.withColumn("target_class", jx.target_class(c("t1_name"), c("t2_name"), c("t1_adjacent"), c("t2_adjacent")))


@query("e26", f"WITH {TARGET_CLASS_SQL} SELECT mol_id, target_class FROM classed")
def e26(fx: Fixtures) -> DataFrame:
    return with_target_class(fx).select("mol_id", "target_class")


@query("e27", """SELECT seq_id, CASE WHEN l THEN substr(seq, greatest(1, p - 9), least(p, 10)) ELSE reverse(translate(substr(seq, p, 10), 'ACGT', 'TGCA')) END AS retained,
 CASE WHEN l THEN substr(seq, p + 1, 10) ELSE reverse(translate(substr(seq, greatest(1, p - 10), least(p - 1, 10)), 'ACGT', 'TGCA')) END AS lost
 FROM (SELECT *, (5 + seq_id % 50)::INT AS p, seq_id % 2 = 0 AS l FROM fx_sequences)""")  # fmt: skip
def e27(fx: Fixtures) -> DataFrame:
    kept, lost = jx.breakpoint_flanks(c("seq"), (5 + c("seq_id") % 50).cast("int"), F.when(c("seq_id") % 2 == 0, "L").otherwise("R"), 10)
    return fx.sequences.select("seq_id", kept.alias("retained"), lost.alias("lost"))


@query("e28", """WITH s AS (SELECT seq_id, substr(seq, 30, 5) AS ins, substr(seq, 1, 29) AS f1, substr(seq, 35, 30) AS f2 FROM fx_sequences),
 q AS (SELECT *, f AS flank, rc, CASE WHEN rc = 1 THEN reverse(translate(ins, 'ACGT', 'TGCA')) ELSE ins END AS q, CASE WHEN f = 1 THEN f1 ELSE f2 END AS t FROM s, range(1, 3) a(f), range(0, 2) b(rc)),
 m AS (SELECT *, i AS "at", CASE WHEN flank = 1 THEN length(t) - (i + 4) ELSE i - 1 END AS distance FROM q, range(1, 31) r(i) WHERE i <= length(t) - 4 AND substr(t, i, 5) = q),
 k AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY distance, flank, rc, "at") AS nth, count(*) OVER (PARTITION BY seq_id) AS n_matches FROM m)
 SELECT seq_id, n_matches, flank, rc AS is_rc, "at", distance, CASE WHEN ins = reverse(translate(ins, 'ACGT', 'TGCA')) THEN 'palindrome' WHEN rc = 1 AND flank = 1 THEN 'foldback'
 WHEN rc = 1 THEN 'strandSwitch' WHEN distance = 0 THEN 'slippage' WHEN flank = 2 THEN 'crossJxn' ELSE 'other' END AS kind FROM k WHERE nth = 1""")  # fmt: skip
def e28(fx: Fixtures) -> DataFrame:
    x = fx.sequences.select("seq_id", F.substr("seq", F.lit(30), F.lit(5)).alias("insertion"), F.substr("seq", F.lit(1), F.lit(29)).alias("flank1"), F.substr("seq", F.lit(35), F.lit(30)).alias("flank2"))
    return jx.insertion_templates(x, ["seq_id"])


#: Made-up step angles; the published table is a parameter.
ANGLES = {a + b: 1.0 + i + 4 * j for i, a in enumerate("ACGT") for j, b in enumerate("ACGT")}


@query("e29", """WITH b AS (SELECT seq_id, i AS base_pos, CASE WHEN i > 1 THEN instr('ACGT', substr(ref_seq, i - 1, 1)) + 4 * (instr('ACGT', substr(ref_seq, i, 1)) - 1) END::DOUBLE AS e,
 CASE WHEN i < 32 THEN instr('ACGT', substr(ref_seq, i, 1)) + 4 * (instr('ACGT', substr(ref_seq, i + 1, 1)) - 1) END::DOUBLE AS l FROM fx_sequences, range(1, 33) t(i))
 SELECT seq_id, base_pos::INT AS base_pos, coalesce((e + l) / 2, e, l) AS flexibility FROM b""")  # fmt: skip
def e29(fx: Fixtures) -> DataFrame:
    return an.dinucleotide_profile(fx.sequences, ["seq_id"], "ref_seq", ANGLES)


@query("e30", f"""SELECT mol_id AS sv_id, chrom1, chrom2, CASE WHEN side1 = 'L' THEN '+' ELSE '-' END AS strand1, CASE WHEN side2 = 'R' THEN '+' ELSE '-' END AS strand2,
 -(mol_id % 9 - 4)::INT AS insert_size, least(greatest(mapq1, 20), greatest(mapq2, 25)) AS mapq, least(clip_len1, clip_len2) AS flank_length,
 CASE WHEN chrom1 = chrom2 THEN (pos1 + pos2) / 2 END AS centre, CASE WHEN chrom1 = chrom2 THEN abs(pos2 - pos1) ELSE 0 END AS size FROM fx_molecules""")  # fmt: skip
def e30(fx: Fixtures) -> DataFrame:
    x = typed(fx).select(
        c("mol_id").alias("sv_id"), "chrom1", "side1", "pos1", "chrom2", "side2", "pos2", "jxn_type", (c("mol_id") % 9 - 4).cast("int").alias("microhomology"),
        F.concat_ws(",", c("mapq1").cast("string"), F.lit("20")).alias("mapqs1"), F.concat_ws(",", F.lit("25"), c("mapq2").cast("string")).alias("mapqs2"),
        c("clip_len1").alias("flank1"), c("clip_len2").alias("flank2"),
    )
    return an.junction_view(x)


@query("e31", f"""WITH {_OPS}, a AS (SELECT qname, aln_n, any_value(chrom) AS chrom, any_value(pos) AS pos, any_value(is_reverse) AS r, any_value(mapq) AS mapq,
 any_value(pos) + sum(size) FILTER (WHERE op IN ('M', 'D'))::BIGINT - 1 AS e, split_part(any_value(cigar), 'S', 1)::INT AS lc, regexp_extract(any_value(cigar), '([0-9]+)S$', 1)::INT AS rc FROM ops GROUP BY qname, aln_n),
 m AS (SELECT qname, count(*) AS n, sum(r) AS nr, min(chrom) AS chrom, max(chrom) AS chrom2, min(mapq) AS mapq, max(pos) FILTER (WHERE r = 0) AS fp, max(lc) FILTER (WHERE r = 0) AS fc,
 max(e) FILTER (WHERE r = 1) AS re, max(rc) FILTER (WHERE r = 1) AS rcl, max(pos) FILTER (WHERE r = 1) AS rp FROM a GROUP BY qname)
 SELECT qname, chrom, fp - fc - 1 AS start0, re + rcl AS end1, mapq, re - fp + 1 AS mapped_length FROM m WHERE n = 2 AND nr = 1 AND chrom = chrom2 AND fp <= rp AND mapq >= 20""")  # fmt: skip
def e31(fx: Fixtures) -> DataFrame:
    return rd.proper_molecule_spans(fx.alignments)


@query("e32", """SELECT seq_id, CASE WHEN l AND i > p THEN substr(ref_seq, i - p + 1) WHEN l THEN repeat('#', p - i) || ref_seq WHEN p > i THEN substr(ref_seq, 1, 32 - (p - i)) ELSE ref_seq || repeat('#', i - p) END AS patched
 FROM (SELECT seq_id, ref_seq, seq_id % 2 = 0 AS l, (100 + seq_id % 7)::INT AS p, (98 + seq_id % 11)::INT AS i FROM fx_sequences)""")  # fmt: skip
def e32(fx: Fixtures) -> DataFrame:
    at, index = (100 + c("seq_id") % 7).cast("int"), (98 + c("seq_id") % 11).cast("int")
    return fx.sequences.select("seq_id", an.amplicon_end_patch(c("ref_seq"), at, index, c("seq_id") % 2 == 0).alias("patched"))


_VCF = "SELECT cast(seq_id % 5 + 1 as int) as chrom, seq_id * 10 as pos, substr(seq, 1, cast(1 + seq_id % 3 as int)) as ref, substr(seq, 2, cast(1 + seq_id % 2 as int)) as allele1, substr(seq, 1, cast(1 + seq_id % 4 as int)) as allele2 from fx_sequences"
HAPLOTYPES_SQL = f"""alleles AS ({_VCF}), hap AS (SELECT chrom, pos + i AS pos, substr(ref, (i + 1)::INT, 1) AS ref_base,
 CASE WHEN length(allele1) > i THEN CASE WHEN i = length(ref) - 1 THEN substr(allele1, (i + 1)::INT) ELSE substr(allele1, (i + 1)::INT, 1) END ELSE '-' END AS hap1,
 CASE WHEN length(allele2) > i THEN CASE WHEN i = length(ref) - 1 THEN substr(allele2, (i + 1)::INT) ELSE substr(allele2, (i + 1)::INT, 1) END ELSE '-' END AS hap2
 FROM alleles, range(0, 3) t(i) WHERE i < length(ref))"""


def haplotype_map(fx: Fixtures) -> DataFrame:
    return an.haplotype_alleles(fx.sql(_VCF))


@query("e33", f"WITH {HAPLOTYPES_SQL} SELECT * FROM hap")
def e33(fx: Fixtures) -> DataFrame:
    return haplotype_map(fx)


COMPARED_SQL = f"""WITH {HAPLOTYPES_SQL}, sequenced AS (SELECT *, substr('ACGTN ', (pos % 6 + 1)::INT, 1) AS base FROM hap),
 compared AS (SELECT *, CASE WHEN base = ' ' THEN 0 WHEN base = 'N' THEN 1 WHEN base IN (hap1, hap2) THEN CASE WHEN hap1 = ref_base AND hap2 = ref_base THEN 3 ELSE 2 END
 WHEN base = ref_base THEN 3 ELSE 4 END AS cmp FROM sequenced)"""


def compared(fx: Fixtures) -> DataFrame:
    base = F.substr(F.lit("ACGTN "), (c("pos") % 6 + 1).cast("int"), F.lit(1))
    return haplotype_map(fx).withColumn("base", base).withColumn("cmp", an.compare_bases(c("base"), c("ref_base"), c("hap1"), c("hap2")))


@query("e34", f"{COMPARED_SQL} SELECT chrom, pos, ref_base, cmp FROM compared")
def e34(fx: Fixtures) -> DataFrame:
    return compared(fx).select("chrom", "pos", "ref_base", "cmp")


@query("e35", """SELECT cell_id, chrom, bin_n, round(lgamma(n + 2.5) - lgamma(2.5) - lgamma(n + 1.0) + 2.5 * ln(2.5 / (2.5 + mu)) + n * ln(mu / (2.5 + mu)), 6) AS log_p
 FROM (SELECT *, 1.0 + bin_n % 7 AS mu FROM fx_bin_counts)""")  # fmt: skip
def e35(fx: Fixtures) -> DataFrame:
    p = an.log_nbinom_pmf(c("n").cast("double"), 1.0 + c("bin_n") % 7, F.lit(2.5))
    return fx.bin_counts.select("cell_id", "chrom", "bin_n", r6(p).alias("log_p"))


@query("e36", """WITH x AS (SELECT seq_id, 0.1 + (seq_id % 10) / 10 AS mu, (seq_id % 5)::INT AS k FROM fx_sequences), y AS (SELECT *, 1 - exp(-mu) AS p FROM x)
 SELECT seq_id, round(p, 6) AS expected, round(1 - (SELECT sum(factorial(8) / factorial(i::INT) / factorial((8 - i)::INT) * pow(p, i) * pow(1 - p, 8 - i)) FROM range(0, 5) t(i) WHERE i <= k), 6) AS tail FROM y""")  # fmt: skip
def e36(fx: Fixtures) -> DataFrame:
    p = an.poisson_success(0.1 + (c("seq_id") % 10) / 10)
    return fx.sequences.select("seq_id", p.alias("p")).select("seq_id", r6("p").alias("expected"), r6(an.binomial_tail((c("seq_id") % 5).cast("int"), F.lit(8), c("p"))).alias("tail"))


@query("e37", f"""WITH {_OPS}, a AS (SELECT qname, aln_n, any_value(chrom) AS chrom, any_value(pos) AS pos, any_value(is_reverse) AS r,
 any_value(pos) + sum(size) FILTER (WHERE op IN ('M', 'D'))::BIGINT - 1 AS e, split_part(any_value(cigar), 'S', 1)::INT AS lc, regexp_extract(any_value(cigar), '([0-9]+)S$', 1)::INT AS rc FROM ops GROUP BY qname, aln_n),
 b AS (SELECT qname, aln_n, chrom, CASE WHEN r = 1 THEN 'R' ELSE 'L' END AS side, CASE WHEN r = 1 THEN e + rc ELSE pos - lc END AS p, ((CASE WHEN r = 1 THEN rc ELSE lc END) > 0)::INT AS k FROM a),
 ends AS (SELECT qname, min_by(chrom, aln_n) AS c1, min_by(side, aln_n) AS s1, min_by(p, aln_n) AS p1, min_by(k, aln_n) AS k1, max_by(chrom, aln_n) AS c2, max_by(side, aln_n) AS s2, max_by(p, aln_n) AS p2, max_by(k, aln_n) AS k2 FROM b GROUP BY qname),
 s AS (SELECT *, CASE WHEN c1 <> c2 THEN c1 > c2 ELSE p1 > p2 END AS sw FROM ends)
 SELECT qname, CASE WHEN sw THEN concat_ws(':', c2, s2, p2, k2, c1, s1, p1, k1) ELSE concat_ws(':', c1, s1, p1, k1, c2, s2, p2, k2) END AS molecule_key, sw::INT AS group_strand FROM s""")  # fmt: skip
def e37(fx: Fixtures) -> DataFrame:
    return rd.molecule_keys(fx.alignments)


_GENES = "SELECT name, start0, end1, case when length(name) % 2 = 0 then '-' else '+' end as strand from fx_targets"


@query("e38", f"""WITH g AS ({_GENES}), x AS (SELECT m.mol_id AS sv_id, t.name, (t.start0 + t.end1) / 2 AS ctr, t.strand = '-' AS minus, m.* FROM fx_molecules m JOIN fx_targets f ON f.chrom = m.chrom1 AND m.pos1 > f.start0 AND m.pos1 <= f.end1 JOIN g t ON t.name = f.name)
 SELECT sv_id, name, CASE WHEN minus THEN ctr - pos2 ELSE pos1 - ctr END AS offset1, CASE WHEN minus THEN CASE side2 WHEN 'L' THEN 'R' ELSE 'L' END ELSE side1 END AS side1,
 CASE WHEN minus THEN ctr - pos1 ELSE pos2 - ctr END AS offset2, CASE WHEN minus THEN CASE side1 WHEN 'L' THEN 'R' ELSE 'L' END ELSE side2 END AS side2 FROM x""")  # fmt: skip
def e38(fx: Fixtures) -> DataFrame:
    from ..operators.joins import position_in_target

    m = position_in_target(fx.molecules, fx.targets, "chrom1", "pos1").where("name is not null").withColumn("sv_id", c("mol_id"))
    return an.orient_by_gene(m.select("sv_id", "name", "side1", "pos1", "side2", "pos2"), fx.sql(_GENES))


@query("e39", """SELECT event_id, k AS kind, CASE k WHEN 'D' THEN abs(pos2 - pos1) - 1 WHEN 'U' THEN abs(pos2 - pos1) + 1 WHEN 'M' THEN abs(pos2 - pos1) + 1 WHEN 'V' THEN abs(pos2 - pos1) ELSE 0 END AS size
 FROM (SELECT *, substr('DUMVT', (event_id % 5 + 1)::INT, 1) AS k FROM fx_nodes_long)""")  # fmt: skip
def e39(fx: Fixtures) -> DataFrame:
    x = fx.nodes_long.withColumn("kind", F.substr(F.lit("DUMVT"), (c("event_id") % 5 + 1).cast("int"), F.lit(1)))
    return x.select("event_id", "kind", an.amplicon_junction_size(c("kind"), c("pos1"), c("pos2")).alias("size"))


@query("e40", """SELECT b.cell_id, b.chrom, b.bin_n, CASE WHEN g.gc_fraction >= 0.5 THEN round(b.n / g.gc_fraction / nullif(1 - g.excluded, 0), 6) END AS adjusted
 FROM fx_bin_counts b JOIN fx_genome_bins g USING (chrom, bin_n)""")  # fmt: skip
def e40(fx: Fixtures) -> DataFrame:
    x = fx.bin_counts.join(fx.genome_bins, ["chrom", "bin_n"])
    return x.select("cell_id", "chrom", "bin_n", r6(an.adjust_counts(c("n"), c("gc_fraction"), c("excluded"))).alias("adjusted"))


@query("e41", f"""SELECT mol_id, CASE WHEN n = 1 OR jxn_type = 'I' THEN -d ELSE d END AS template_pos, CASE WHEN mol_id % 3 = 0 THEN -1 ELSE 1 END AS lane
 FROM (SELECT mol_id, mol_id % 2 + 1 AS n, mol_id % 23 AS d, {_TYPE} AS jxn_type FROM {_DIST})""")  # fmt: skip
def e41(fx: Fixtures) -> DataFrame:
    pos, lane = an.signed_template_position(c("jxn_type"), c("mol_id") % 2 + 1, c("mol_id") % 23, (c("mol_id") % 3 == 0).cast("int"))
    return typed(fx).select("mol_id", pos.alias("template_pos"), lane.alias("lane"))
