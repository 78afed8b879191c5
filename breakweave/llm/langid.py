"""Language identification with hyperdimensional profiles of letter trigrams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Dimensions of all vectors.
DIMENSIONS = 1024
#: About so many labelled documents at most train the prototypes, chosen by a hash of the id.
MAX_TRAIN = 50_000
#: A worker keeps the vectors of so many trigrams.
CACHE_TRIGRAMS = 12_000
#: Documents whose vectors are made at once.
BLOCK = 64
#: Unit vectors are summed as integers of this scale, so sums do not depend on their order.
SCALE = 1 << 16

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(1 << 16)])
    if len(points) and points.max() >= 1 << 16:
        high = {int(c) for c in np.unique(points) if c >= 1 << 16 and unicodedata.category(chr(c))[0] == "L"}
        return np.where(points < 1 << 16, _letters[np.minimum(points, 65535)], np.isin(points, list(high)))
    return _letters[points]


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the lower-cased letters, with words bounded by a blank, and their counts.

    A trigram is three code points of 21 bits in one integer, 0 for the blank.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _is_letter(points)
    points = np.where(letter, points, 0)
    if len(points):
        keep = letter | np.append(True, letter[:-1])
        points = points[keep]
    points = np.concatenate([[0], points, [0]])
    grams = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
    return np.unique(grams[points[1:-1] > 0], return_counts=True)


def letter_vector(point: int) -> np.ndarray:
    """The random +1/-1 vector of a letter, drawn from a generator seeded by the letter itself."""
    if point not in _vectors:
        if len(_vectors) > 20_000:
            _vectors.clear()
        draw = np.random.Generator(np.random.Philox(key=point)).integers(0, 2, DIMENSIONS)
        _vectors[point] = (2 * draw - 1).astype(np.int8)
    return _vectors[point]


def gram_vector(gram: int) -> np.ndarray:
    """Letters bound by multiplication, each permuted (rotated) by its distance from the last."""
    a, b, c = (gram >> 42) & 0x1FFFFF, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
    return np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)


class Bundler:
    """Bundles blocks of texts into one vector each."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((1024, DIMENSIONS), dtype=np.float32)

    def _row(self, gram: int) -> int:
        row = self.rows.get(gram)
        if row is None:
            row = self.rows[gram] = len(self.rows)
            if row >= len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[row] = gram_vector(gram)
        return row

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        if len(self.rows) > CACHE_TRIGRAMS:
            self.__init__()
        found = [trigrams(t) for t in texts]
        every = np.unique(np.concatenate([g for g, _ in found])) if found else np.zeros(0, np.int64)
        rows = np.array([self._row(g) for g in every.tolist()], dtype=np.int64)
        counts = np.zeros((len(texts), len(every)), dtype=np.float32)
        for i, (grams, n) in enumerate(found):
            counts[i, np.searchsorted(every, grams)] = n
        return counts @ self.matrix[rows]


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BLOCK):
            yield batch.slice(i, BLOCK)


def train(docs: DataFrame, max_train: int = MAX_TRAIN, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes (unit rows) from all given rows with ``text`` and ``lang``.

    Above ``max_train`` labelled rows a sample of about that size, by a hash of the id, is used.
    Prototypes are the bundled unit vectors of the language's documents, less the mean of all
    languages. One row a language and dimension reaches the driver.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.count()
    if not n:
        return [], np.zeros((0, DIMENSIONS))
    draw = F.pmod(F.xxhash64(id_col, F.lit("lang")), F.lit(1 << 20))
    known = known.where(draw < int(np.ceil((1 << 20) * min(1.0, max_train / n))))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for block in _blocks(batches):
            vectors = np.rint(unit(bundler.bundle(block.column(0).to_pylist())) * SCALE).astype(np.int64)
            for lang, v in zip(block.column(1).to_pylist(), vectors):
                sums[lang] = sums.get(lang, 0) + v
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([v.tolist()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = known.select("text", "lang").mapInArrow(bundle, "lang string, v array<long>")
    rows = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("v")).collect()
    langs = sorted({r.lang for r in rows})
    sums = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        sums[langs.index(r.lang), r.pos] = r.v
    prototypes = unit(sums)
    if len(langs) > 1:
        prototypes = unit(prototypes - prototypes.mean(axis=0))
    return langs, prototypes


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the nearest prototype and its cosine, at least 0.

    Texts that are null or hold no letter, and all texts where nothing was learned, get ``und`` and
    0. Ties go to the first language by name. Input columns of these names are replaced.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    docs = docs.drop("lang_pred", "score")
    names, at_text = docs.columns, docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes.astype(np.float32)))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names_of, rows = shared.value
        bundler = Bundler()
        for block in _blocks(batches):
            vectors = unit(bundler.bundle(block.column(at_text).to_pylist()))
            known = (vectors != 0).any(axis=1) & bool(names_of)
            cosine = vectors @ rows.T if names_of else np.zeros((len(vectors), 1))
            best = cosine.argmax(axis=1)
            lang = [names_of[b] if k else "und" for b, k in zip(best, known)]
            top = np.where(known, np.clip(cosine.max(axis=1), 0.0, 1.0), 0.0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(lang), pa.array(top)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(apply, schema)
