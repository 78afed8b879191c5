"""Benchmark decontamination: latent semantic candidates, then subsequence and answer checks."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize
from .wordhash import word_arrays

#: Log2 of the hashed vocabulary; dimensions kept by the decomposition; extra ones while it is found.
VOCAB_BITS, RANK, EXTRA = 14, 160, 8
#: A passage is two runs of so many words; runs follow each other without gaps, so passages overlap by half.
RUN = 16
#: Multiplications by the matrix of items and passages, and items in one of them at once.
STEPS, ITEMS_AT_ONCE = 4, 256
#: Rows of the sketch of all passages, pieces in which tasks hand it on, and how many times as much as all
#: passages the items weigh.
SKETCH_ROWS, SKETCH_PARTS, ITEM_WEIGHT = 512, 64, 4.0
#: Least cosine of a candidate in the latent space.
MIN_COSINE = 0.50
#: Items of more than so many words make candidates of passages by shared runs of that many words too:
#: a copy that replaces or drops at most 1 - COPY_SHARE of the words keeps one such run at least.
GRAM_WORDS = ((20, 3), (2, 2), (0, 1))
#: Share of an item's words that a document must hold in order: a copy, or a paraphrase that also
#: holds this share of the answer's words.
COPY_SHARE, PARAPHRASE_SHARE, ANSWER_SHARE = 0.7, 0.5, 0.8
#: Items searched in about one pass over the documents, each with its own decomposition, so that its
#: rank keeps items apart; a larger benchmark takes several passes.
ITEMS_A_PASS = 2_000
#: A longer item is cut into windows of so many words, and leaks where one of them does.
WINDOW = 512
#: Runs of words whose vectors are summed at once.
RUNS_AT_ONCE = 256

WORD = re.compile(r"[^\W\d_]+")
D = 1 << VOCAB_BITS


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased runs of letters of a text, in order."""
    return word_arrays(pa.array([text], pa.string()))[0]


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - VOCAB_BITS)).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


def corpus_statistics(docs: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray, np.ndarray]:
    """Number of documents, of those with each hashed word, and a sketch of all their passages: one pass.

    The sketch is S X, where X has a row for every passage (``2 * RUN`` words, cut one behind the other) that
    marks the words it holds, and S adds each row to one of ``SKETCH_ROWS`` sums with a random sign: the expected
    (S X)'(S X) is X'X. Numbers are whole, so their sum over the tasks is exact.
    """
    width = SKETCH_ROWS * D // SKETCH_PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, sums, rng = np.zeros(D, np.int64), 0, None, np.random.default_rng([7, TaskContext.get().partitionId()])
        for part in blocks(batches, 0):
            found = word_arrays(part.column(0))
            n += len(found)
            sizes = np.array([len(f) for f in found], np.int64)
            if not sizes.sum():
                continue
            sums = np.zeros(SKETCH_ROWS * D, np.int32) if sums is None else sums
            rows, begin = -(-sizes // (2 * RUN)), np.cumsum(sizes) - sizes
            first = np.cumsum(rows) - rows
            place = np.arange(sizes.sum()) - np.repeat(begin, sizes)
            held = _distinct((np.repeat(first, sizes) + place // (2 * RUN)) * D + bucket(np.concatenate(found)))
            row, word = held >> VOCAB_BITS, held & (D - 1)
            text = np.repeat(np.arange(len(rows)), rows)
            df += np.bincount(_distinct(text[row] * D + word) & (D - 1), minlength=D)
            to, sign = rng.integers(0, SKETCH_ROWS, rows.sum()), rng.integers(0, 2, rows.sum(), dtype=np.int32) * 2 - 1
            np.add.at(sums, to[row] * D + word, sign[row])
        if not n:
            return
        parts, at, values = [-1], [None], [np.append(df, n).astype("<i8").tobytes()]
        for i in range(SKETCH_PARTS if sums is not None else 0):
            own = sums[i * width : (i + 1) * width]
            some = np.flatnonzero(own)
            sparse = 2 * len(some) < width
            parts.append(i)
            at.append(some.astype("<i4").tobytes() if sparse else None)
            values.append((own[some] if sparse else own).astype("<i4").tobytes())
        kinds = [pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((parts, at, values), kinds)], ["part", "at", "v"])

    def summed(part: pa.Table) -> pa.Table:
        i = part.column("part")[0].as_py()
        total = np.zeros(D + 1 if i < 0 else width, np.int64)
        for at, v in zip(part.column("at"), part.column("v")):
            v = np.frombuffer(v.as_buffer(), "<i8" if i < 0 else "<i4")
            if at.is_valid:
                total[np.frombuffer(at.as_buffer(), "<i4")] += v
            else:
                total += v
        total = total if i < 0 else total.astype(np.float32)
        return pa.table({"part": pa.array([i], pa.int64()), "v": pa.array([total.tobytes()], pa.binary())})

    # as many sketches as the session has cores, twice over, whatever the corpus
    texts = docs.select(text_col).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    rows = texts.mapInArrow(count, "part long, at binary, v binary").groupBy("part").applyInArrow(summed, "part long, v binary")
    n, df, sketch = 0, np.zeros(D), np.zeros(SKETCH_ROWS * D, np.float32)
    for r in materialize(rows, "corpus-statistics").collect():  # one sketch, whatever the data
        if r.part < 0:
            n, df = int(np.frombuffer(r.v, np.int64)[-1]), np.frombuffer(r.v, np.int64)[:-1].astype(float)
        else:
            sketch[r.part * width : (r.part + 1) * width] = np.frombuffer(r.v, np.float32)
    return n, df, sketch.reshape(SKETCH_ROWS, D)


def padded(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of several texts' words, each filled up to whole runs with the empty bucket D, and the
    number of runs of each text."""
    runs = np.array([-(-len(f) // RUN) for f in found], dtype=np.int64)
    out = np.full(int(runs.sum()) * RUN, D, dtype=np.int64)
    at = np.concatenate([[0], np.cumsum(runs)]) * RUN
    for f, a in zip(found, at):
        out[a : a + len(f)] = bucket(f)
    return out, runs


def passages(found: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent TF-IDF vectors of the texts' overlapping passages, and each text's number of them.

    ``vectors`` has a row of zeros at the empty bucket.
    """
    b, runs = padded(found)
    sums = np.empty((len(b) // RUN, vectors.shape[1]), np.float32)
    for i in range(0, len(sums), RUNS_AT_ONCE):
        part = b[i * RUN : (i + RUNS_AT_ONCE) * RUN]
        sums[i : i + RUNS_AT_ONCE] = vectors[part].reshape(-1, RUN, vectors.shape[1]).sum(axis=1)
    ends = np.cumsum(runs)
    last = np.zeros(len(sums), bool)
    last[ends[runs > 0] - 1] = True
    both = np.where(last[:, None], sums, sums + np.concatenate([sums[1:], sums[:1]]))
    alone = np.repeat(runs == 1, runs)
    return both[~last | alone], np.where(runs > 1, runs - 1, runs)


def _normal_product(b: np.ndarray, starts: np.ndarray, scale: np.ndarray, idf: np.ndarray, q: np.ndarray, into: np.ndarray) -> None:
    """Add A'(A q) to ``into``, where row i of A is the scaled TF-IDF vector of the words from starts[i]."""
    y = np.add.reduceat(q[b] * idf[b][:, None], starts, axis=0) * (scale**2)[:, None]
    row = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(b))))
    order = np.argsort(b, kind="stable")
    terms, first = np.unique(b[order], return_index=True)
    into[terms] += np.add.reduceat(y[row[order]] * idf[b[order]][:, None], first, axis=0)


def _unit_scale(b: np.ndarray, starts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return 1.0 / np.sqrt(np.maximum(np.add.reduceat(idf[b] ** 2, starts), 1e-12))


def orthonormal(total: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` leading left singular vectors of a tall matrix, from its small Gram matrix; zeros beyond its rank."""
    wide = total.astype(np.float64)
    values, v = np.linalg.eigh(wide.T @ wide)
    order = np.argsort(values)[::-1][:width]
    kept = values[order] > values.max() * 1e-10
    scale = np.where(kept, 1.0 / np.sqrt(np.where(kept, values[order], 1.0)), 0.0)
    return (wide @ (v[:, order] * scale)).astype(np.float32)


def latent_basis(items: list[np.ndarray], idf: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """D x RANK right singular vectors of the TF-IDF matrix of all items of a pass and all passages of all documents.

    A seeded random start is multiplied ``STEPS`` times by A'A and orthonormalised in between. The items' part of
    A'A is exact, the passages' part is that of their sketch (:func:`corpus_statistics`), to whose columns ``idf``
    is applied. Items together weigh ``ITEM_WEIGHT`` times as much as the passages, whatever their numbers.
    """
    q = np.random.default_rng(7).standard_normal((D, RANK + EXTRA), dtype=np.float32)
    flat = [bucket(i) for i in items if len(i)]
    if not flat:
        return np.zeros((D, RANK), np.float32)
    corpus = sketch * idf.astype(np.float32)
    weight = float((corpus**2).sum(dtype=np.float64))  # items' rows have length 1, so weigh as many as they are
    corpus *= np.float32(np.sqrt(len(flat) / ITEM_WEIGHT / weight) if weight else 0.0)
    for step in range(1, STEPS + 1):
        total = corpus.T @ (corpus @ q)
        for k in range(0, len(flat), ITEMS_AT_ONCE):
            part = flat[k : k + ITEMS_AT_ONCE]
            b, starts = np.concatenate(part), np.cumsum([0, *map(len, part)])[:-1]
            _normal_product(b, starts, _unit_scale(b, starts, idf), idf, q, total)
        q = orthonormal(total, RANK if step == STEPS else RANK + EXTRA)
    return q


GRAM_BASE, SEEN_BITS = np.uint64(0x9E3779B97F4A7C15), 18


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words, by the run's first word."""
    many = max(0, len(hashes) - n + 1)
    out = hashes[:many].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = out * GRAM_BASE + hashes[k : k + many]
    return out


def gram_index(items: list[np.ndarray]) -> list[tuple]:
    """For each run length (n, runs in order, first and number of each run's items, items, leading bits seen)."""
    size = [next((n for least, n in GRAM_WORDS if len(i) > least), 0) for i in items]
    out = []
    for n in sorted({*size} - {0}):
        runs = [(i, np.unique(grams(words, n))) for i, words in enumerate(items) if size[i] == n]
        keys, which = np.concatenate([r for _, r in runs]), np.repeat([i for i, _ in runs], [len(r) for _, r in runs])
        order = np.argsort(keys, kind="stable")
        keys, first, many = np.unique(keys[order], return_index=True, return_counts=True)
        seen = np.zeros(1 << SEEN_BITS, bool)
        seen[keys >> np.uint64(64 - SEEN_BITS)] = True
        out.append((n, keys, first, many, which[order], seen))
    return out


def gram_candidates(found: list[np.ndarray], n_passages: np.ndarray, index: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(passage, item) wherever a text holds a run of an item's words; passages count on over the texts."""
    flat, sizes = np.concatenate(found), np.array([len(f) for f in found])
    of = np.repeat(np.arange(len(found)), sizes)
    begin, passage = np.cumsum(sizes) - sizes, np.cumsum(n_passages) - n_passages
    rows, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, keys, first, many, items, seen in index:
        g = grams(flat, n)
        at = np.flatnonzero(seen[g >> np.uint64(64 - SEEN_BITS)])
        at = at[of[at] == of[at + n - 1]]
        k = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
        at, k = at[keys[k] == g[at]], k[keys[k] == g[at]]
        d = of[at]
        row = passage[d] + np.minimum((at - begin[d]) // RUN, n_passages[d] - 1)
        c = many[k]
        rows.append(np.repeat(row, c))
        which.append(items[np.arange(c.sum()) + np.repeat(first[k] - np.cumsum(c) + c, c)])
    return np.concatenate(rows), np.concatenate(which)


@dataclass
class Item:
    """An item, or a window of a long one. ``answer`` is none in a window that does not have it."""

    item_id: int
    number: int
    length: int
    masks: dict[int, int]
    answer: frozenset[int] | None


def answer_of(text: str) -> str:
    """What follows the last question mark, else the last sentence."""
    tail = (text or "").rpartition("?")[2]
    if tail.strip() and "?" in (text or ""):
        return tail
    sentences = [s for s in re.split(r"[.!?]\s+|\n", (text or "").strip()) if WORD.search(s)]
    return sentences[-1] if sentences else ""


def prepare(item_id: int, found: np.ndarray, answer: frozenset[int] | None, number: int = 0) -> Item:
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(found.tolist()):
        masks[w] |= 1 << i
    return Item(item_id, number, len(found), dict(masks), answer)


def windows(item_id: int, text: str | None, number: int = 0) -> list[tuple[np.ndarray, Item]]:
    """The hashed words of an item, in windows of about ``WINDOW`` if it has more, each with its item."""
    found = words(text)
    answer = frozenset(words(answer_of(text or "")).tolist())
    parts = np.array_split(found, -(-len(found) // WINDOW) or 1)
    return [(p, prepare(item_id, p, answer if i == len(parts) - 1 else None, number)) for i, p in enumerate(parts)]


def common_subsequence(item: Item, region: list[int]) -> int:
    """Length of the longest common subsequence of an item and a region, 64-bit words at a time."""
    full = (1 << item.length) - 1
    v = full
    masks = item.masks
    for w in region:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return item.length - v.bit_count()


def check(item: Item, region: list[int]) -> tuple[float, float]:
    """(share of the item's words held in order, share of its answer's words held)."""
    if not item.length:
        return 0.0, 0.0
    share = common_subsequence(item, region) / item.length
    if item.answer is None:
        return share, 0.0
    held = len(item.answer.intersection(region)) / len(item.answer) if item.answer else 1.0
    return share, held


def is_leak(share: float, answer: float) -> bool:
    return share >= COPY_SHARE or share >= PARAPHRASE_SHARE and answer >= ANSWER_SHARE


def leaks(listed: list[int], at: np.ndarray, which: np.ndarray, cosine: np.ndarray, items: list[Item]) -> list[tuple]:
    """(item id, share, answer share, cosine, start, length) of the candidates of one document that leak.

    ``listed``: its word hashes; ``at`` and ``which``: passage and item of each candidate. Passages
    of one item that follow each other are first looked at together: too few of the item's words in
    their joint surroundings leave none of them a chance.
    """
    order = np.lexsort((at, which))
    at, which, cosine = at[order], which[order], cosine[order]
    cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(at) > 1)) + 1
    best: dict[int, tuple] = {}
    for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
        if a == z:
            continue
        i = int(which[a])
        item = items[i]
        first, last = int(at[a]), int(at[z - 1])
        region = set(listed[max(0, first * RUN - item.length) : (last + 2) * RUN + item.length])
        if sum(m.bit_count() for w, m in item.masks.items() if w in region) < PARAPHRASE_SHARE * item.length:
            continue
        for p, cos in zip(at[a:z].tolist(), cosine[a:z].tolist()):
            start = max(0, p * RUN - item.length)
            part = listed[start : (p + 2) * RUN + item.length]
            share, answer = check(item, part)
            if is_leak(share, answer) and (item.number not in best or share > best[item.number][1]):
                best[item.number] = (item.item_id, share, answer, cos, start, len(part))
    return [best[i] for i in sorted(best)]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """``doc_id, item_id, share, answer_share, cosine, start, length``: items that documents leak.

    Word frequencies cover all documents, and the latent space is that of all items and of all passages of all
    documents. Every passage is compared with every item by cosine in the latent space; passages that hold a run of an item's words are candidates whatever
    their cosine. Each candidate's surroundings, an item's length to both sides, are then aligned with
    the item word by word. ``start`` and ``length`` are in words, of the region that holds the largest
    share. An item of more than ``WINDOW`` words is searched window by window, and ``share`` is then
    that of the window. Null, empty and wordless texts and items leak nothing; a null id stays null;
    repeated rows each give their rows, repeated items each count; an item id of null stays.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, share double, answer_share double, cosine double, start long, length long"
    n_items = benchmark.count()
    if not n_items:
        return spark.createDataFrame([], schema)
    n_docs, df, sketch = corpus_statistics(docs)
    idf = np.log1p((n_docs + 1.0) / (df + 0.5)).astype(np.float32)
    passes = -(-n_items // ITEMS_A_PASS)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    found = []
    for k in range(passes):
        mine = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else rows
        texts = [(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()]  # about ITEMS_A_PASS
        if texts:
            leaking, shared = _search(docs, texts, idf, sketch, min_cosine, schema)
            if passes > 1:  # one pass's vectors at a time
                leaking = materialize(leaking, "leaks")
                shared.destroy()
            found.append(leaking)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _search(docs: DataFrame, texts: list[tuple], idf: np.ndarray, sketch: np.ndarray, min_cosine: float, schema: str) -> tuple[DataFrame, Broadcast]:
    cut = [w for number, (i, t) in enumerate(texts) for w in windows(i, t, number)]
    hashed, items = [h for h, _ in cut], [i for _, i in cut]
    basis = latent_basis(hashed, idf, sketch)
    vectors = np.concatenate([basis * idf[:, None], np.zeros((1, RANK), np.float32)]).astype(np.float32)
    latent = np.stack([vectors[bucket(h)].sum(axis=0) if len(h) else np.zeros(RANK, np.float32) for h in hashed])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, np.ascontiguousarray(latent.T, dtype=np.float32), items, gram_index(hashed)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, latent, items, index = shared.value
        for part in blocks(batches, 1, 32, 1 << 18):
            ids, out = part.column(0), []
            found = word_arrays(part.column(1))
            x, n = passages(found, vectors)
            cosine = (x @ latent) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            near = cosine >= min_cosine
            near[gram_candidates(found, n, index)] = True
            rows, which = np.nonzero(near)
            ends = np.cumsum(n)
            of = np.searchsorted(ends, rows, "right")
            for d in np.unique(of).tolist():
                mine = of == d
                at, listed = rows[mine] - (ends[d] - n[d]), found[d].tolist()
                for hit in leaks(listed, at, which[mine], cosine[rows[mine], which[mine]], items):
                    out.append((ids[d].as_py(), *hit))
            if out:
                kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64(), pa.int64()]
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.mapInArrow(apply, schema), shared
