"""Readers of alignment, interval, variant and sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAM = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string"
PAF = "qname string, qlen long, qstart long, qend long, strand string, rname string, rlen long, rstart long, rend long, n_matches long, n_bases long, mapq int"
VCF = "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, format string, gt string"
#: Columns of the 11-column bin tables.
BINS = "chrom string, start0 long, end1 long, cum_index long, gc double, strand string, excluded long, gap long, bad long, umap double, genmap double"
BED = "chrom string, start0 long, end1 long, name string"
NULLS = ("*", "NA")


def read_table(spark: SparkSession, path: str, schema: str, null: str = "NA") -> DataFrame:
    """A headerless tab-separated table, compressed or not, with declared types."""
    return spark.read.schema(schema).csv(path, sep="\t", nullValue=null, quote="")


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Decoded alignments: the first ten fields of each row; ``*`` is null; header rows are left out."""
    text = spark.read.text(path).where(~F.col("value").startswith("@"))
    f = F.split("value", "\t", 11)
    names = [c.split() for c in SAM.split(", ")]
    return text.select(*[F.nullif(f[i], F.lit("*")).cast(t).alias(n) for i, (n, t) in enumerate(names)])


def read_paf(spark: SparkSession, path: str) -> DataFrame:
    """Long-read alignments with the ``cg:Z`` CIGAR and the ``de:f`` divergence of their tags."""
    text = spark.read.text(path)
    f = F.split("value", "\t", 13)
    names = [c.split() for c in PAF.split(", ")]
    tag = lambda p: F.nullif(F.regexp_extract(F.concat(F.lit("\t"), f[12]), p, 1), F.lit(""))
    return text.select(*[f[i].cast(t).alias(n) for i, (n, t) in enumerate(names)], tag(r"\tcg:Z:([^\t]+)").alias("cigar"), tag(r"\tde:f:([^\t]+)").cast("double").alias("divergence"))


def read_bed(spark: SparkSession, path: str, schema: str = BED) -> DataFrame:
    """Intervals of three, four or more columns (``BINS`` for bin tables); missing columns are null."""
    return spark.read.schema(schema).csv(path, sep="\t", nullValue="NA", comment="#", mode="PERMISSIVE")


def read_vcf_rows(spark: SparkSession, path: str) -> DataFrame:
    """Variant rows: ``chrom, pos, ref, alt, qual, dp, allele1, allele2``; alleles are bases of the genotype."""
    v = spark.read.schema(VCF).csv(path, sep="\t", comment="#", nullValue=".")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    alleles = F.concat(F.array("ref"), F.split("alt", ","))
    at = lambda i: F.element_at(alleles, F.regexp_extract_all(F.split("gt", ":")[0], F.lit("([0-9]+)"), F.lit(1))[i].cast("int") + 1)
    return v.select("chrom", "pos", "ref", "alt", "qual", info["DP"].cast("int").alias("dp"), at(0).alias("allele1"), at(1).alias("allele2"))


def read_samples(spark: SparkSession, paths: list[str], pattern: str = r"([^/]+)/[^/]*$") -> DataFrame:
    """Parquet tables of several samples as one, ``sample`` taken from each file's path; absent columns are null."""
    out = None
    for p in paths:
        one = spark.read.parquet(p).withColumn("sample", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
