"""Sorting, limits, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_within(df: DataFrame, keys: list[str], order: list, n: int | None = None) -> DataFrame:
    """Rows of a key together and in order, without a global sort."""
    return (df.repartition(n, *keys) if n else df.repartition(*keys)).sortWithinPartitions(*keys, *order)


def chrom_index(name: Column) -> Column:
    """Natural order of chromosome names: 1 .. 22, X 23, Y 24, M 25; others null."""
    s = F.upper(F.regexp_replace(name, "(?i)^chr", ""))
    return F.when(s == "X", 23).when(s == "Y", 24).when(s.isin("M", "MT"), 25).when(s.rlike("^[0-9]{1,2}$"), s.cast("int"))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def unique_by(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row (least ``order``) of each combination of columns."""
    rest = [c for c in df.columns if c not in columns]
    return df.groupBy(*columns).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*columns, "r.*")


def in_set(df: DataFrame, other: DataFrame, on: list[str], negate: bool = False) -> DataFrame:
    return df.join(other.select(*on).distinct(), on, "left_anti" if negate else "left_semi")


def widen(df: DataFrame, keys: list[str], name: str, names: list, value: str) -> DataFrame:
    return df.groupBy(*keys).pivot(name, names).agg(F.sum(value)).fillna(0, [str(n) for n in names])


def lengthen(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def split_genome(df: DataFrame, column: str) -> DataFrame:
    """``chrom`` and ``genome`` of composite names such as ``chr1_hg38``."""
    return df.withColumns({"chrom": F.split_part(F.col(column), F.lit("_"), F.lit(1)), "genome": F.nullif(F.split_part(F.col(column), F.lit("_"), F.lit(2)), F.lit(""))})


def intergenome_type(genome1: Column, genome2: Column, kind: Column) -> Column:
    return F.when(genome1 != genome2, "G").otherwise(kind)
