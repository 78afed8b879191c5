"""Writers of call tables, variant records, reads and per-chromosome outputs, and run counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

VCF_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
VCF_HEADER = (
    "##fileformat=VCFv4.3",
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=MATEID,Number=1,Type=String,Description="ID of mate breakend">',
    '##INFO=<ID=SVLEN,Number=1,Type=Integer,Description="Length of the variant">',
    '##INFO=<ID=CIPOS,Number=2,Type=Integer,Description="Confidence interval around POS">',
    '##INFO=<ID=HOMLEN,Number=1,Type=Integer,Description="Length of microhomology">',
    '##INFO=<ID=HOMSEQ,Number=1,Type=String,Description="Sequence of microhomology">',
)


def write_calls(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, or gzipped tab-separated text with a header; arrays are joined by commas there."""
    if form == "parquet":
        df.write.mode("overwrite").parquet(path)
        return
    joined = [F.array_join(F.col(n), ",").alias(n) if t.startswith("array") else F.col(n) for n, t in df.dtypes]
    df.select(*joined).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip", nullValue="NA")


def vcf_lines(records: DataFrame) -> DataFrame:
    """``chrom, pos, line``: breakend records as text. Input of ``breakend_fields``."""
    info = F.concat_ws(
        ";",
        F.lit("SVTYPE=BND"),
        F.concat(F.lit("MATEID="), "mate_id"),
        F.concat(F.lit("SVLEN="), F.col("svlen").cast("string")),
        F.concat(F.lit("CIPOS="), "cipos"),
        F.concat(F.lit("HOMLEN="), F.col("homlen").cast("string")),
        F.concat(F.lit("HOMSEQ="), "homseq"),
    )
    return records.select("chrom", "pos", F.concat_ws("\t", F.col("chrom").cast("string"), F.col("pos").cast("string"), "id", "ref", "alt", F.lit("."), F.lit("PASS"), info).alias("line"))


def write_vcf_rows(records: DataFrame, path: str) -> None:
    """Header and sorted records as text: the header rows sort first."""
    spark = records.sparkSession
    head = spark.createDataFrame([(i, line) for i, line in enumerate((*VCF_HEADER, VCF_COLUMNS))], "n int, line string")
    rows = vcf_lines(records).select(F.lit(1).alias("k"), "chrom", "pos", "line").unionByName(head.select(F.lit(0).alias("k"), F.lit(0).alias("chrom"), F.col("n").cast("long").alias("pos"), "line"))
    rows.orderBy("k", "chrom", "pos", "line").select("line").write.mode("overwrite").text(path)


def fastq_records(df: DataFrame, name: Column, seq: str = "seq", qual: str = "qual") -> DataFrame:
    """``record``: four lines a read, named by its molecule's attributes."""
    return df.select(F.concat_ws("\n", F.concat(F.lit("@"), name), F.col(seq), F.lit("+"), F.col(qual)).alias("record"))


def write_fastq(df: DataFrame, name: Column, path: str) -> None:
    fastq_records(df, name).write.mode("overwrite").text(path)


def split_outputs(df: DataFrame, read: str, is_sv: Column, order: str, n_training: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(rows of reads with an SV, rows of the first ``n_training`` reads without one)."""
    marked = df.withColumn("__sv", F.max(F.coalesce(is_sv, F.lit(False))).over(Window.partitionBy(read)))
    rest = marked.where("not __sv").drop("__sv")
    first = rest.groupBy(read).agg(F.min(order).alias("__o")).orderBy("__o", read).limit(n_training).select(read)
    return marked.where("__sv").drop("__sv"), rest.join(first, read, "left_semi")


def write_partitioned(df: DataFrame, path: str, column: str = "chrom") -> None:
    """One folder a chromosome; a reader that filters on it opens no other."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def run_counts(df: DataFrame, counters: dict[str, Column]) -> DataFrame:
    """``counter, n``: how many rows fulfil each named condition."""
    one = df.agg(*[F.count_if(c).alias(k) for k, c in counters.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in counters]), F.array(*[F.col(k) for k in counters]))).alias("counter", "n"))


def observed_counts(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` that counts while another action runs; ``observation.get`` has the figures afterwards."""
    seen = Observation("run")
    return df.observe(seen, *[F.count_if(c).alias(k) for k, c in counters.items()]), seen
