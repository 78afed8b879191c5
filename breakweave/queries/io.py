"""S and O: sources, sinks, sorting and sets. Files are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixtures import Fixtures
from ..functions.junctions import breakend_fields
from ..operators import sets as st
from ..plans.scratch import shared_dir
from ..sources import readers as r
from ..sources import writers as w
from . import query
from .expressions import BREAKENDS_SQL, calls

c = F.col


def folder(fx: Fixtures, name: str) -> str:
    return f"{shared_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


def lines(fx: Fixtures, df: DataFrame, name: str, *columns) -> str:
    path = folder(fx, name)
    df.select(F.concat_ws("\t", *[x.cast("string") for x in columns])).write.text(path)
    return path


@query("s1", "SELECT qname::VARCHAR AS qname, (aln_n + 16 * is_reverse)::INT AS flag, chrom::VARCHAR AS rname, pos, mapq::INT AS mapq, cigar, NULL::VARCHAR AS seq FROM fx_alignments")
def s1(fx: Fixtures) -> DataFrame:
    star, zero = F.lit("*"), F.lit(0)
    path = lines(fx, fx.alignments, "sam", c("qname"), c("aln_n") + 16 * c("is_reverse"), c("chrom"), c("pos"), c("mapq"), c("cigar"), star, zero, zero, star, F.lit("extra\ttag"))
    return r.read_alignments(fx.spark, path).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq")


@query("s2", "SELECT qname::VARCHAR AS qname, pos AS rstart, mapq::INT AS mapq, cigar, round(mapq / 100, 6) AS divergence FROM fx_alignments")
def s2(fx: Fixtures) -> DataFrame:
    n = [F.lit(i) for i in range(3)]
    path = lines(fx, fx.alignments, "paf", c("qname"), *n, F.lit("+"), c("chrom"), F.lit(9), c("pos"), c("pos") + 1, F.lit(1), F.lit(2), c("mapq"), F.lit("tp:A:P"), F.concat(F.lit("de:f:"), c("mapq") / 100), F.concat(F.lit("cg:Z:"), "cigar"))
    return r.read_paf(fx.spark, path).select("qname", "rstart", "mapq", "cigar", F.round("divergence", 6).alias("divergence"))


@query("s3", "SELECT mol_id, sample, chrom1, NULL::INT AS missing FROM fx_molecules")
def s3(fx: Fixtures) -> DataFrame:
    path = folder(fx, "table")
    fx.molecules.select("mol_id", "sample", "chrom1", F.lit("NA")).write.csv(path, sep="\t", compression="gzip")
    return r.read_table(fx.spark, path, "mol_id long, sample string, chrom1 int, missing int")


@query("s4", "SELECT 'chr' || chrom AS chrom, start0, end1, name FROM fx_targets")
def s4(fx: Fixtures) -> DataFrame:
    return r.read_bed(fx.spark, lines(fx, fx.targets, "bed", F.concat(F.lit("chr"), c("chrom").cast("string")), c("start0"), c("end1"), c("name")))


@query("s5", "SELECT 'chr' || seq_id % 5 AS chrom, seq_id AS pos, substr(seq, 1, 1) AS ref, substr(seq, 2, 1) AS alt, (seq_id % 60)::DOUBLE AS qual, (seq_id % 90)::INT AS dp, substr(seq, 1, 1) AS allele1, substr(seq, 2, 1) AS allele2 FROM fx_sequences")
def s5(fx: Fixtures) -> DataFrame:
    one = lambda i: F.substr("seq", F.lit(i), F.lit(1))
    dot = F.lit(".")
    path = lines(fx, fx.sequences, "vcf", F.concat(F.lit("chr"), (c("seq_id") % 5).cast("string")), c("seq_id"), dot, one(1), one(2), c("seq_id") % 60, dot, F.concat(F.lit("AF=0.5;DP="), (c("seq_id") % 90).cast("string")), F.lit("GT:AD"), F.lit("0|1:3,4"))
    return r.read_vcf_rows(fx.spark, path)


@query("s6", "SELECT mol_id, sample, CASE WHEN sample = 'S1' THEN mapq1 END AS mapq1 FROM fx_molecules WHERE sample IN ('S0', 'S1')")
def s6(fx: Fixtures) -> DataFrame:
    base = folder(fx, "samples")
    fx.molecules.where("sample = 'S0'").select("mol_id").write.parquet(f"{base}/S0")
    fx.molecules.where("sample = 'S1'").select("mol_id", "mapq1").write.parquet(f"{base}/S1")
    return r.read_samples(fx.spark, [f"{base}/S0", f"{base}/S1"]).select("mol_id", "sample", "mapq1")


@query("s7", "SELECT mol_id, sample, mapq1 || ',' || mapq2 AS mapqs FROM fx_molecules")
def s7(fx: Fixtures) -> DataFrame:
    path = folder(fx, "calls")
    w.write_calls(fx.molecules.select("mol_id", "sample", F.array("mapq1", "mapq2").alias("mapqs")), path, "tsv")
    return fx.spark.read.schema("mol_id long, sample string, mapqs string").csv(path, sep="\t", header=True)


@query("s8", f"SELECT chrom || chr(9) || pos || chr(9) || id || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'SVTYPE=BND;MATEID=' || mate_id || ';SVLEN=' || svlen || ';CIPOS=' || cipos || ';HOMLEN=' || homlen || ';HOMSEQ=' || homseq AS value FROM ({BREAKENDS_SQL})")
def s8(fx: Fixtures) -> DataFrame:
    path = folder(fx, "vcf-out")
    w.write_vcf_rows(breakend_fields(calls(fx)), path)
    return fx.spark.read.text(path).where(~c("value").startswith("#"))


@query("s9", "SELECT unnest(['@' || seq_id || ':1:' || seq_id % 4, substr(seq, 1, 20), '+', repeat('I', 20)]) AS value FROM fx_sequences")
def s9(fx: Fixtures) -> DataFrame:
    path = folder(fx, "fastq")
    x = fx.sequences.select("seq_id", F.substr("seq", F.lit(1), F.lit(20)).alias("seq"), F.lit("I" * 20).alias("qual"))
    w.write_fastq(x, F.concat_ws(":", c("seq_id").cast("string"), F.lit("1"), (c("seq_id") % 4).cast("string")), path)
    return fx.spark.read.text(path)


@query("s10", """WITH e AS (SELECT *, bool_or(insert_size = 4 AND duplex = 1) OVER (PARTITION BY channel) AS sv FROM fx_nodes_long), f AS (SELECT channel FROM e WHERE NOT sv GROUP BY channel ORDER BY min(event_id), channel LIMIT 5)
 SELECT event_id, 'sv' AS output FROM e WHERE sv UNION ALL SELECT event_id, 'training' FROM e WHERE NOT sv AND channel IN (SELECT channel FROM f)""")  # fmt: skip
def s10(fx: Fixtures) -> DataFrame:
    sv, rest = w.split_outputs(fx.nodes_long, "channel", (c("insert_size") == 4) & (c("duplex") == 1), "event_id", 5)
    return sv.select("event_id", F.lit("sv").alias("output")).unionByName(rest.select("event_id", F.lit("training").alias("output")))


@query("s11", "SELECT mol_id, chrom FROM fx_spans WHERE chrom IN (2, 3)")
def s11(fx: Fixtures) -> DataFrame:
    path = folder(fx, "by-chrom")
    w.write_partitioned(fx.spans.select("mol_id", "chrom"), path)
    return fx.spark.read.parquet(path).where("chrom in (2, 3)")


@query("s12", """SELECT 'alignments' AS counter, count(*) AS n FROM fx_alignments UNION ALL SELECT 'low_mapq', count(*) FILTER (WHERE mapq < 20) FROM fx_alignments UNION ALL SELECT 'reverse', count(*) FILTER (WHERE is_reverse = 1) FROM fx_alignments""")
def s12(fx: Fixtures) -> DataFrame:
    return w.run_counts(fx.alignments, {"alignments": F.lit(True), "low_mapq": c("mapq") < 20, "reverse": c("is_reverse") == 1})


@query("o1", "SELECT mol_id, row_number() OVER (PARTITION BY chrom1 ORDER BY pos1, mol_id) AS n FROM fx_molecules")
def o1(fx: Fixtures) -> DataFrame:
    """Rows numbered by the order in which their partition holds them."""
    from pyspark.sql import Window

    x = st.sort_within(fx.molecules, ["chrom1"], ["pos1", "mol_id"]).select("chrom1", "mol_id", F.monotonically_increasing_id().alias("i"))
    return x.select("mol_id", F.row_number().over(Window.partitionBy("chrom1").orderBy("i")).alias("n"))


@query("o2", """SELECT mol_id, CASE v WHEN 'X' THEN 23 WHEN 'Y' THEN 24 WHEN 'M' THEN 25 ELSE v::INT END AS chrom_index FROM (SELECT mol_id, CASE mol_id % 7 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' WHEN 2 THEN 'M' ELSE (mol_id % 22 + 1)::VARCHAR END AS v FROM fx_molecules)""")
def o2(fx: Fixtures) -> DataFrame:
    k = c("mol_id") % 7
    v = F.when(k == 0, "X").when(k == 1, "Y").when(k == 2, "M").otherwise((c("mol_id") % 22 + 1).cast("string"))
    return fx.molecules.select("mol_id", st.chrom_index(F.concat(F.lit("chr"), v)).alias("chrom_index"))


@query("o3", "SELECT mol_id, mapq1 FROM fx_molecules ORDER BY mapq1 DESC, mol_id LIMIT 100")
def o3(fx: Fixtures) -> DataFrame:
    return st.top_k(fx.molecules, [F.desc("mapq1"), "mol_id"], 100).select("mol_id", "mapq1")


@query("o4", "SELECT mol_id AS id, mapq1, NULL::BIGINT AS start0 FROM fx_molecules UNION ALL SELECT mol_id, NULL, start0 FROM fx_spans")
def o4(fx: Fixtures) -> DataFrame:
    return st.union_all([fx.molecules.select(c("mol_id").alias("id"), "mapq1"), fx.spans.select(c("mol_id").alias("id"), "start0")])


@query("o5", "SELECT chrom1, pos1, min(mol_id) AS mol_id FROM fx_molecules GROUP BY ALL")
def o5(fx: Fixtures) -> DataFrame:
    return st.unique_by(fx.molecules.select("chrom1", "pos1", "mol_id"), ["chrom1", "pos1"], "mol_id")


@query("o6", "SELECT mol_id, 'in' AS side FROM fx_molecules WHERE chrom1 IN (SELECT chrom FROM fx_targets WHERE start0 < 60000 AND chrom < 3) UNION ALL SELECT mol_id, 'out' FROM fx_molecules WHERE chrom1 NOT IN (SELECT chrom FROM fx_targets WHERE start0 < 60000 AND chrom < 3)")
def o6(fx: Fixtures) -> DataFrame:
    t = fx.targets.where("start0 < 60000 and chrom < 3").select(c("chrom").alias("chrom1"))
    m = fx.molecules.select("mol_id", "chrom1")
    a, b = st.in_set(m, t, ["chrom1"]), st.in_set(m, t, ["chrom1"], negate=True)
    return a.select("mol_id", F.lit("in").alias("side")).unionByName(b.select("mol_id", F.lit("out").alias("side")))


@query("o7", "SELECT chrom1, s AS sample, count(m.mol_id) AS n FROM (SELECT DISTINCT chrom1 FROM fx_molecules) k CROSS JOIN (VALUES ('S0'), ('S1'), ('S2')) v(s) LEFT JOIN fx_molecules m USING (chrom1) WHERE m.sample = s GROUP BY ALL")
def o7(fx: Fixtures) -> DataFrame:
    one = fx.molecules.select("chrom1", "sample", F.lit(1).cast("long").alias("n"))
    wide = st.widen(one, ["chrom1"], "sample", ["S0", "S1", "S2"], "n")
    return st.lengthen(wide, ["chrom1"], ["S0", "S1", "S2"], "sample", "n").where("n > 0")


@query("o8", """SELECT mol_id, 'chr' || chrom1 AS chrom, 'g' || mol_id % 2 AS genome, CASE WHEN mol_id % 2 <> mol_id % 3 % 2 THEN 'G' ELSE 'D' END AS edge_type FROM fx_molecules""")
def o8(fx: Fixtures) -> DataFrame:
    g = lambda e: F.concat(F.lit("g"), e.cast("string"))
    x = fx.molecules.select("mol_id", F.concat(F.lit("chr"), c("chrom1").cast("string"), F.lit("_"), g(c("mol_id") % 2)).alias("name"), g(c("mol_id") % 3 % 2).alias("other"))
    return st.split_genome(x, "name").select("mol_id", "chrom", "genome", st.intergenome_type(c("genome"), c("other"), F.lit("D")).alias("edge_type"))
