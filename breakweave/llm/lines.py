"""Line deduplication by pairwise alignment: patience diff against earlier documents."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import materialize, scratch_tables

#: A shorter line (trimmed) never makes documents overlap, nor is it deleted alone.
MIN_CHARS = 20
#: A line of so many words makes documents overlap however often it occurs.
LONG_WORDS = 50
#: Another line does so where at most this many documents have it. Beyond that, pairs of lines do that
#: have at most short lines between them, so that blocks in large groups of near copies are found and
#: lone stock lines are not.
RARE = 10


#: What a line is trimmed of.
BLANKS = " \t\r\x0b\x0c"


def _trimmed(text_col: str) -> F.Column:
    return F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, t, h, w, all``: the text's hash, hashes of its trimmed lines, 0 for short, 1 for plain and 2
    for long lines, and a hash of all lines, equal for documents that are equal line by line."""
    words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    weight = lambda x: F.when(F.length(x) < MIN_CHARS, 0).when(words(x) < LONG_WORDS, 1).otherwise(2)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("t"), _trimmed(text_col).alias("l"))
    hashed = rows.select("id", "t", F.transform("l", lambda x: F.xxhash64(x)).alias("h"), F.transform("l", weight).alias("w"))
    return hashed.withColumn("all", F.xxhash64("h"))


def patience_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the common blocks that a patience diff aligns, in order.

    Lines that are unique in both ranges and common are chained by a longest increasing sequence;
    each chained line grows over equal neighbours, and the gaps are searched again.
    """
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_a = {a[i]: i for i in range(a0, a1) if in_a[a[i]] == 1 and in_b.get(a[i]) == 1}
        pairs = [(at_a[b[j]], j) for j in range(b0, b1) if b[j] in at_a]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (i, _) in enumerate(pairs):
            k = bisect_left(tails, i)
            back.append(ends[k - 1] if k else -1)
            tails[k : k + 1], ends[k : k + 1] = [i], [n]
        chain, n = [], ends[-1] if ends else -1
        while n >= 0:
            chain.append(pairs[n])
            n = back[n]
        if chain:
            chain.reverse()
            matched += chain
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if i + 1 < k and j + 1 < m]
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def deleted_lines(h: list[int], w: list[int], other: list[int], other_w: list[int], keys: set[int]) -> list[int]:
    """Lines of a document that blocks aligned with an earlier one cover. ``keys``: the lone lines that
    made the two overlap. A block counts if it has one of them or two lines that are not short; one
    such line is enough where the next block has another and only short lines lie between, in both
    documents."""
    gone: set[int] = set()
    reached, lone = (0, 0), range(0)
    for a, start, n in patience_blocks(other, h):
        block = range(start, start + n)
        plain_lines = sum(w[i] > 0 for i in block)
        if any(x > 0 for x in other_w[reached[0] : a]) or any(x > 0 for x in w[reached[1] : start]):
            lone = range(0)
        if any(h[i] in keys for i in block) or plain_lines >= 2 or plain_lines and lone:
            gone.update(block)
            gone.update(lone)
        if plain_lines:
            lone = block
        reached = a + n, start + n
    return sorted(gone)


def ranges(lines: list[int]) -> str:
    """Ascending line numbers as ``0-2,5``."""
    out: list[list[int]] = []
    for i in lines:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return ",".join(f"{a}-{b}" if a < b else f"{a}" for a, b in out)


def overlapping_pairs(own: DataFrame, rare: int = RARE) -> DataFrame:
    """``all, first, keys``: each document with the first one that has each of its shared keys, and the
    lone lines among these. ``own``: ``id, all, h, w``, one row a document.

    Keys are lines and pairs of lines with at most short ones between. One partner a key keeps the
    number of pairs below the number of lines, however large the group. The shared keys are a table
    of their own, so that a key that very many documents have meets one row, and the join's crowded
    partitions can be split.
    """
    long_enough = own.select("id", "all", F.filter(F.arrays_zip("h", "w"), lambda x: x["w"] > 0).alias("l"))
    single = F.transform("l", lambda x: F.struct(x["h"].alias("k"), (x["w"] - 1).alias("kind")))
    pair = F.transform(
        F.when(F.size("l") > 1, F.sequence(F.lit(1), F.size("l") - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(F.element_at("l", i)["h"], F.element_at("l", i + 1)["h"]).alias("k"), F.lit(2).alias("kind")),
    )
    keys = long_enough.select("id", "all", F.explode(F.array_distinct(F.concat(single, pair))).alias("key")).select("id", "all", "key.*")
    shared = (
        keys.groupBy("k", "kind")
        .agg(F.min(F.struct("id", "all")).alias("f"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & ((F.col("kind") > 0) | (F.col("n") <= rare)))
        .select("k", "kind", F.col("f.id").alias("first_id"), F.col("f.all").alias("first"))
    )
    shared = materialize(shared, "dedup-shared")
    met = keys.join(shared, ["k", "kind"]).where("id > first_id")
    return met.groupBy("all", "first").agg(F.collect_set(F.when(F.col("kind") < 2, F.col("k"))).alias("keys"))


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``all, lines`` of the pairs in (all, keys, h, w, other, other_w)."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            keys, h, w, other, other_w = (c.to_pylist() for c in batch.columns[1:])
            gone = [deleted_lines(b, c, d, e, set(a)) for a, b, c, d, e in zip(keys, h, w, other, other_w)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["all", "lines"])


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """``id, t, whole, lines``: for each document that loses lines, its id, its text's hash, and which go.

    ``whole`` documents equal an earlier one line by line. Of the others, one for each class of equal
    ones, each pair is aligned in a row of its own; the lines that its pairs delete are then united.
    """
    written = docs.where(F.col(id_col).cast("long").isNotNull() & F.col(text_col).rlike(r"\S"))
    lines = materialize(_lines(written, id_col, text_col), "dedup-lines")
    classes = materialize(lines.groupBy("all").agg(F.min("id").alias("first_id")), "dedup-classes")
    firsts = lines.join(classes, "all").where("id = first_id")
    own = firsts.where(F.exists("w", lambda x: x > 0)).select("id", "all", "h", "w").dropDuplicates(["all"])
    own = materialize(own, "dedup-own")
    pairs = materialize(overlapping_pairs(own, rare), "dedup-pairs")
    mine = own.select("all", "h", "w")
    theirs = own.select(F.col("all").alias("first"), F.col("h").alias("other"), F.col("w").alias("other_w"))
    rows = pairs.join(theirs, "first").join(mine, "all").select("all", "keys", "h", "w", "other", "other_w")
    gone = rows.mapInArrow(_aligned, "`all` long, lines array<int>").select("all", F.explode("lines").alias("line"))
    gone = gone.groupBy("all").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    texts = lines.select("id", "t", "all").distinct().join(classes, "all")
    whole = texts.where("id <> first_id").select("id", "t", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("lines"))
    return whole.unionByName(texts.where("id = first_id").join(gone, "all").select("id", "t", F.lit(False).alias("whole"), "lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = RARE) -> DataFrame:
    """``docs`` with blocks of lines deleted that an earlier document (by id) has too.

    Adds ``n_lines``, ``n_removed`` and ``removed`` (line numbers from 0); ``text`` keeps the other
    lines. Documents equal to an earlier one lose all lines. Lines are compared without blanks and
    carriage returns at their ends. The result has the input's rows. A null text stays null and
    counts as one empty line; documents without an id or without any text stay whole, those without a
    line that is long enough go only where they equal an earlier one. Rows that share an id have one
    place in the order: none of them is earlier than another, and equal ones lose the same lines;
    different texts of one id are documents of their own (told apart by a 64-bit hash), each compared
    with those of smaller ids. Input columns named like the added ones are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "removed")
    with scratch_tables(docs.sparkSession):
        plans = materialize(deletions(docs, id_col, text_col, rare), "dedup-plans", result=True)
    plans = plans.withColumnsRenamed({"id": "__id", "t": "__t", "whole": "__whole", "lines": "__lines"})
    same = (F.col(id_col).cast("long") == F.col("__id")) & (F.xxhash64(text_col) == F.col("__t"))
    # the same plan at every size: beyond a small corpus the plans are too many to broadcast
    joined = docs.join(plans.hint("merge"), same, "left").select(*docs.columns, "__whole", "__lines")
    at_text = docs.columns.index(text_col)
    added = [("n_lines", LongType()), ("n_removed", LongType()), ("removed", StringType())]
    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in added)])
    width = len(docs.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for i in range(0, whole_batch.num_rows, 256):
                batch = whole_batch.slice(i, 256)
                texts, counts, gone, said = [], [], [], []
                for t, whole, lines in zip(batch.column(at_text), batch.column(width), batch.column(width + 1)):
                    text = t.as_py()
                    n = (text or "").count("\n") + 1
                    lost = list(range(n)) if whole.as_py() else lines.as_py() or []
                    if lost:
                        drop = set(lost)
                        text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop)
                    texts.append(text)
                    counts.append(n)
                    gone.append(len(lost))
                    said.append(ranges(lost))
                columns = list(batch.columns[:width])
                columns[at_text] = pa.array(texts, pa.string())
                columns += [pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return joined.mapInArrow(apply, schema)
