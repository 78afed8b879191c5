"""Views over the driver's tables that stand for genomic inputs; the same text runs in both engines."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_molecules": """select o_orderkey as mol_id, concat('S', cast(o_custkey % 4 as string)) as sample,
 cast(o_custkey % 5 + 1 as int) as chrom1,
 cast(case when o_orderkey % 10 = 0 then (o_custkey + 1) % 5 + 1 else o_custkey % 5 + 1 end as int) as chrom2,
 case when o_custkey % 6 = 5 then 'R' else 'L' end as side1,
 case when o_custkey % 6 in (4) then 'L' else 'R' end as side2,
 (o_custkey % 50) * 10000 + (o_orderkey * 7) % 300 + 1 as pos1,
 (o_custkey % 50) * 10000 + 5000 + (o_custkey % 7) * 3000 + (o_orderkey * 11) % 200 + 1 as pos2,
 cast(o_orderkey % 3 % 2 as int) as node_class,
 cast(floor(o_totalprice) as bigint) % 61 as mapq1, o_orderkey % 61 as mapq2,
 o_orderkey % 4 as strand_count1, o_orderkey % 3 as strand_count2,
 (o_custkey % 50) * 10000 + (o_orderkey * 7) % 300 - 100 - o_orderkey % 9 as out_pos1,
 (o_custkey % 50) * 10000 + 5200 + (o_custkey % 7) * 3000 + (o_orderkey * 11) % 200 + o_orderkey % 9 as out_pos2,
 cast(o_orderkey % 12 as int) as clip_len1, cast(o_orderkey % 7 as int) as clip_len2
 from orders""",
    "fx_alignments": """select l_orderkey as qname, l_linenumber as aln_n,
 cast(min(l_suppkey) % 5 + 1 as int) as chrom, min(l_partkey) * 37 + 1 as pos,
 cast(floor(min(l_quantity)) as bigint) % 2 as is_reverse,
 cast(floor(max(l_quantity)) as bigint) + 10 as mapq,
 concat(cast(min(l_suppkey) % 9 as string),'S', cast(min(l_partkey) % 90 + 20 as string),'M',
  cast(l_orderkey % 40 + 1 as string), case when l_orderkey % 2 = 0 then 'D' else 'I' end,
  cast(min(l_partkey) % 50 + 10 as string),'M', cast(max(l_suppkey) % 7 as string),'S') as cigar
 from lineitem group by l_orderkey, l_linenumber""",
    "fx_spans": """select event_id as mol_id, cast(user_id % 5 + 1 as int) as chrom,
 (event_id * 37) % 100000 as start0,
 (event_id * 37) % 100000 + 100 + cast(floor(value) as bigint) as end1,
 case when event_type = 'error' then 'V' else 'P' end as mol_class from events""",
    "fx_bin_counts": """select user_id % 20 as cell_id, cast(event_id % 5 + 1 as int) as chrom,
 (event_id * 13) % 200 as bin_n, count(*) as n from events
 group by user_id % 20, cast(event_id % 5 + 1 as int), (event_id * 13) % 200""",
    "fx_genome_bins": """select cast(p_partkey % 5 + 1 as int) as chrom, cast(floor(p_partkey / 5) as bigint) as bin_n,
 cast(floor(p_partkey / 5) as bigint) * 500 as start0, cast(floor(p_partkey / 5) as bigint) * 500 + 500 as end1,
 cast(p_size % 41 + 30 as double) / 100 as gc_fraction, cast(p_partkey % 10 as double) / 10 as excluded from part""",
    "fx_targets": """select n_name as name, cast(n_nationkey % 5 + 1 as int) as chrom,
 cast(n_nationkey as bigint) * 20000 as start0, cast(n_nationkey as bigint) * 20000 + 8000 as end1 from nation""",
    "fx_sequences": """select o_orderkey as seq_id,
 translate(concat(md5(cast(o_orderkey as string)), md5(cast(o_custkey as string))),'0123456789abcdef','ACGTACGTACGTACGT') as seq,
 translate(md5(cast(o_custkey as string)),'0123456789abcdef','ACGTACGTACGTACGT') as ref_seq from orders""",
    "fx_nodes_long": """select event_id, cast(user_id as bigint) as channel, cast(user_id % 3 as int) as strand_key,
 (user_id % 30) * 5000 + (event_id * 7) % 400 as pos1, (user_id % 30) * 5000 + 20000 + (event_id * 13) % 400 as pos2,
 cast(event_id % 9 - 4 as int) as insert_size, cast(case when event_id % 17 = 0 then 1 else 0 end as int) as duplex from events""",
}

TABLES = ("orders", "lineitem", "events", "part", "nation", "customer", "supplier", "region")


class Fixtures:
    """Tables and views of one data folder as DataFrames: ``fx.molecules``, ``fx.table("orders")``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and views it names."""
        named = {t: self.table(t) for t in TABLES if re.search(rf"\b(from|join) {t}\b", text, re.I)}
        views = {v: self.view(v) for v in VIEWS if re.search(rf"\b(from|join) {v}\b", text, re.I)}
        for n in (*named, *views):
            text = re.sub(rf"\b(from|join) {n}\b", rf"\1 {{{n}}}", text, flags=re.I)
        return self.spark.sql(text, **named, **views)

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name])

    def __getattr__(self, name: str) -> DataFrame:
        if f"fx_{name}" not in VIEWS:
            raise AttributeError(name)
        return self.view(f"fx_{name}")


def with_views(sql: str) -> str:
    """DuckDB SQL with the views it names as leading common table expressions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    m = re.match(r"\s*WITH (RECURSIVE )?", sql, re.I)
    rest = sql[m.end() :] if m else sql
    head = "WITH RECURSIVE " if m and m[1] else "WITH "
    if not ctes:
        return sql
    return f"{head}{ctes}{',' if m else ''}\n{rest}"
