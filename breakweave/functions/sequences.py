"""Columns of DNA sequences and base qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chars(s: Column) -> Column:
    """The characters of a string as an array; empty for an empty string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def reverse_cigar(cigar: Column) -> Column:
    return F.array_join(F.reverse(F.regexp_extract_all(cigar, F.lit("([0-9]+[A-Z=])"), F.lit(1))), "")


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings differ, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return F.aggregate(
        F.zip_with(chars(F.substr(a, F.lit(1), n)), chars(F.substr(b, F.lit(1), n)), lambda x, y: (x != y).cast("int")),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def fraction_matching(a: Column, b: Column, side: str = "left") -> Column:
    """Share of equal bases after trimming both strings to the shorter one, kept on ``side``."""
    n = F.least(F.length(a), F.length(b))
    if side == "right":
        a, b = F.substr(a, F.length(a) - n + 1, n), F.substr(b, F.length(b) - n + 1, n)
    return F.when(n > 0, 1 - hamming(a, b) / n)


def best_overlap(a: Column, b: Column, least: int, density: float = 0.9) -> tuple[Column, Column, Column]:
    """(length, score, merged): the end of ``a`` laid over the start of ``b`` in the register of the
    highest share of equal bases, the shortest at ties; merged is null below ``density``."""
    most = F.least(F.length(a), F.length(b))
    lengths = F.when(most >= least, F.sequence(F.lit(least), most)).otherwise(F.array().cast("array<int>"))
    scored = F.transform(
        lengths,
        lambda n: F.struct(
            (1 - hamming(F.substr(a, F.length(a) - n + 1, n), F.substr(b, F.lit(1), n)) / n).alias("score"), (-n).alias("minus_n")
        ),
    )
    best = F.array_max(scored)
    n = -best["minus_n"]
    merged = F.when(best["score"] >= density, F.concat(F.substr(a, F.lit(1), F.length(a) - n), b))
    return n, best["score"], merged


def gc_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, (F.length(seq) - F.length(F.translate(seq, "GCgc", ""))) / F.length(seq))


def phred(qual: Column) -> Column:
    """Base qualities of an offset-33 string."""
    return F.transform(chars(qual), lambda c: F.ascii(c) - 33)


def mean_base_quality(qual: Column, start: Column | int = 1, length: Column | None = None) -> Column:
    part = F.substr(qual, F.lit(start) if isinstance(start, int) else start, length if length is not None else F.length(qual))
    q = phred(part)
    return F.when(F.size(q) > 0, F.aggregate(q, F.lit(0), lambda acc, x: acc + x) / F.size(q))


def max_quality_string(quals: Column) -> Column:
    """The greatest quality at each position over an array of strings; short ones end early."""

    def merge(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: F.greatest(x, y))  # greatest skips the nulls of the shorter

    return F.array_join(F.aggregate(quals, F.array().cast("array<string>"), lambda acc, q: merge(acc, chars(q))), "")


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Levenshtein distance where it is at most ``most``, else ``most + 1``; lengths are compared first."""
    far = F.abs(F.length(a) - F.length(b)) > most
    d = F.levenshtein(a, b, most)
    return F.when(far, most + 1).otherwise(F.when(d < 0, most + 1).otherwise(d))


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    equal = F.zip_with(chars(F.substr(a, F.lit(1), n)), chars(F.substr(b, F.lit(1), n)), lambda x, y: x == y)
    first = F.array_position(equal, False)
    return F.when(first == 0, n).otherwise(first - 1).cast("int")


def find_all(text: Column, q: Column) -> Column:
    """Every 1-based position at which ``q`` occurs in ``text``, overlaps included."""
    last = F.length(text) - F.length(q) + 1
    at = F.when((last >= 1) & (F.length(q) > 0), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(at, lambda i: F.substr(text, i, F.length(q)) == q)
