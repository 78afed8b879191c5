"""Vector code compression: product codes whose assignment walks a lexicographic trie of distinct parts.

Vectors become integers and are cut into parts. The distinct parts of each position, sorted, are a
trie; going through them in order is its depth-first traversal. Each node holds the distances of its
prefix from all entries of the codebook, added up from its parent's, so parts share the distances of
common prefixes; a leaf takes the nearest entry, and its count weighs it in the entry's new mean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import small
from .common import materialize
from .whitening import finite_vectors, matrix, scaled

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Distances are summed in longs up to this size of a component, and in Python integers beyond.
_SAFE = 1 << 26


class TrieWalk:
    """Distances of sorted parts from the entries of one codebook, shared along common prefixes.

    Blocks of parts come in lexicographic order; the path to the last part is kept from block to block.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.path: np.ndarray | None = None  # the last part
        self.sums: list[np.ndarray] = []  # its prefixes' distances

    def distances(self, parts: np.ndarray) -> np.ndarray:
        """(parts x entries) squared distances of a block of sorted parts, not empty."""
        wide = max(int(np.abs(parts).max()), int(np.abs(self.entries).max())) >= _SAFE
        parts, entries = (a.astype(object if wide else np.int64) for a in (parts, self.entries))
        n, width = parts.shape
        # a row that differs from the one before, in the dimensions so far, opens a node
        opens = np.zeros(n, bool)
        opens[0] = self.path is None
        node = np.zeros(n, dtype=np.int64)  # of the parents; number 0 is the root
        above = np.zeros((1, len(entries)), dtype=parts.dtype)
        kept = []
        for level in range(width):
            column = parts[:, level]
            opens[1:] |= column[1:] != column[:-1]
            opens[0] |= self.path is not None and column[0] != self.path[level]
            at = np.flatnonzero(opens)
            step = column[at, None] - entries[None, :, level]
            here = above[node[at]] + step * step
            if not opens[0]:  # the first node goes on from the last block
                here = np.concatenate([self.sums[level][None, :].astype(parts.dtype), here])
            node = np.cumsum(opens) - int(opens[0])
            above = here
            kept.append(here[-1])
        self.path, self.sums = parts[-1], kept
        return above[node]


def nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part, ties to the lower index, and its distance."""
    if distances.dtype == object:
        best = np.array([min(range(len(d)), key=d.__getitem__) for d in distances], dtype=np.int64)
    else:
        best = distances.argmin(axis=1)
    return best, distances[np.arange(len(best)), best]


def part_trie(rows: DataFrame, parts: int) -> DataFrame:
    """``part, v, n``: the distinct parts of each position with their counts, in lexicographic ranges.

    Equal parts are counted before they are shuffled, so no part's rows meet in one task.
    """
    width = F.size("x") / parts
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("x", (p * width).cast("int") + 1, width.cast("int")))
    counted = rows.select(F.posexplode(cut).alias("part", "v")).groupBy("part", "v").agg(F.count("*").alias("n"))
    return counted.repartitionByRange("part", "v").sortWithinPartitions("part", "v")


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width) integers: the vectors of the smallest ids, of one id the least vector."""
    some = rows.where(F.col("vec_id").isNotNull())
    ids = [r[0] for r in some.select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    least = some.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
    x = np.array([r["x"] for r in least], dtype=np.int64)
    if len(x) and x.shape[1] % parts:
        raise ValueError(f"vectors of {x.shape[1]} components have no {parts} equal parts")
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2) if len(x) else np.empty((parts, 0, 0), dtype=np.int64)


def weighted_sums(v: np.ndarray, n: np.ndarray, best: np.ndarray, entries: int) -> np.ndarray:
    """(entries x (width + 1)) sums of the parts of each entry, each ``n`` times, and of ``n``; exactly, as Python integers."""
    one = np.concatenate([v, np.ones((len(v), 1), dtype=np.int64)], axis=1)
    if max(int(np.abs(v).max()), 1) * int(n.max()) * len(v) >= 1 << 62:
        one, n = one.astype(object), n.astype(object)
    return ((best[:, None] == np.arange(entries)).T.astype(one.dtype) @ (one * n[:, None])).astype(object)


def refine(trie: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: every distinct part goes to its nearest entry, and entries become floored means.

    Sums are exact; the driver sees one row an entry.
    """
    width = codebooks.shape[2]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks: dict[int, TrieWalk] = {}
        sums = np.zeros((*codebooks.shape[:2], width + 1), dtype=object)
        for batch in batches:
            part, v, n = batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy()
            for p in np.unique(part):
                own = part == p
                walk = walks.setdefault(int(p), TrieWalk(codebooks[p]))
                best, _ = nearest(walk.distances(v[own]))
                sums[p] += weighted_sums(v[own], n[own], best, codebooks.shape[1])
        p, e = np.nonzero(sums[:, :, width])
        columns = [pa.array([Decimal(int(s)) for s in sums[p, e, i]], pa.decimal128(38, 0)) for i in range(width + 1)]
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), *columns], ["p", "e", *[f"s{i}" for i in range(width + 1)]])

    schema = "p long, e long, " + ", ".join(f"s{i} decimal(38,0)" for i in range(width + 1))
    summed = trie.mapInArrow(assign, schema).groupBy("p", "e").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width + 1)])
    out = codebooks.copy()
    for r in summed.collect():  # parts x entries rows
        out[r["p"], r["e"]] = [int(r[f"s{i}"]) // int(r[f"s{width}"]) for i in range(width)]
    return out


def encode(rows: DataFrame, codebooks: np.ndarray, *more: str) -> DataFrame:
    """``vec_id, code, error`` and more columns: each vector's nearest entries, two hex digits a part.

    Every Arrow batch walks the trie of its own distinct parts.
    """
    n_parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            codes, error = [], np.zeros(len(x), dtype=object)
            for p in range(n_parts):
                own, back = np.unique(x[:, p * width : (p + 1) * width], axis=0, return_inverse=True)
                best, apart = nearest(TrieWalk(codebooks[p]).distances(own))
                codes.append(best[back.ravel()])
                error = error + apart[back.ravel()]
            code = ["".join(f"{c:02x}" for c in row) for row in np.stack(codes, axis=1)]
            error = [min(int(e), (1 << 63) - 1) for e in error]
            kept = [batch.column(c) for c in ("vec_id", *more)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code), pa.array(error, pa.int64())], ["vec_id", *more, "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in ("vec_id", *more)) + ", code string, error long")


def digest(codebooks: np.ndarray) -> str:
    """sha256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in codebooks.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """(``vec_id, label, code, error, label_error`` of every vector, codebooks (parts, entries, width)).

    Components become floor(scale * component). Codebooks start as the parts of the smallest ids and are
    refined ``rounds`` times; an entry without parts stays. ``error`` is the squared distance from the
    coded vector; ``label_error`` sums it over equal labels, nulls together. All of it is exact: neither
    partitions nor lost tasks change a digit. At most 256 entries fit a code.

    Rows whose vector is null, empty or holds null or non-finite components, or has another length than
    most, have no result. A null id is no start of a codebook; of an id's several vectors the least is;
    fewer ids than entries give fewer entries, and without any id there is no result. Repeated rows count
    and come as often as they are. Errors past the largest long stop there; ``scale *`` component saturates
    at 2^40. ValueError where the length of vectors is no multiple of ``parts``.

    The distinct parts and the coded rows are written to the shared folder, once each.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code holds up to 256 entries")
    found = finite_vectors(vectors, id_col, vec_col, F.col(label_col).alias("label"))
    rows = found.select("vec_id", "label", scaled("v", scale).alias("x"))
    codebooks = first_codebooks(rows, parts, entries)
    if not codebooks.shape[1]:
        kind = rows.schema["label"].dataType.simpleString()
        empty = f"vec_id long, label {kind}, code string, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], empty), codebooks
    trie = materialize(part_trie(rows, parts), "code-parts")
    for _ in range(rounds):
        codebooks = refine(trie, codebooks)
    coded = materialize(encode(rows, codebooks, "label"), "codes")
    # labels can be many or few, and one can have most rows: sums first, then a join that can be split
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(str((1 << 63) - 1)).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("l")).agg(total.alias("label_error"))
    joined = coded.join(small(by_label), F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "label", "code", "error", "label_error"), codebooks
