"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-Proximal updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .wordhash import CHUNK, column_bytes, word_codes

#: Log2 of the number of weights.
BITS = 18
#: At most about so many labelled rows, chosen by a hash of the id, train the model.
MAX_TRAIN = 20_000
#: One trainer for so many rows, and the most trainers; their weights are averaged.
ROWS_PER_TRAINER, MAX_TRAINERS = 2_500, 8
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01

_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.array([0], dtype=np.int64), np.array([1.0])


def _hash(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


def _grams(w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        same = (w[1:] == w[:-1]).astype(np.uint64)
        w2 = (w[:-1] * _MIX) ^ w[1:] ^ np.uint64(1)
        s2 = (s[:-1] * _MIX) ^ s[1:] ^ (same << np.uint64(7))
        s3 = (s2[:-1] * _MIX) ^ s[2:]
        grams = np.concatenate([w, w2, s, s2, s3]) * np.uint64(0xBF58476D1CE4E5B9)
    at, n = np.unique((grams >> np.uint64(64 - BITS)).astype(np.int32), return_counts=True)
    return at.astype(np.int64), np.sqrt(n / len(grams))


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices and values of each text's n-grams: words and word pairs, shapes up to triples.

    A value is the square root of the n-gram's share, so each text has length 1. An empty or null
    text has one feature of its own.
    """
    if not len(column):
        return
    data, off = column_bytes(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        w, s, first = word_codes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
            yield _grams(w[a:z], s[a:z]) if z > a else _EMPTY
        i = j


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


class Ftrl:
    """FTRL-Proximal state: ``z`` and ``n`` of each weight, and of the bias at the end."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_train: int = MAX_TRAIN, id_col: str = "doc_id"
) -> np.ndarray:
    """Weights fitted on documents joined with ``labels`` (id, 0/1 label); the last one is the bias.

    About ``max_train`` labels at most are used, chosen by a hash of the id; each of a few trainers
    makes ``EPOCHS`` passes over its share and the weights are averaged. Null labels are left out;
    an id with several labels takes the smallest. Without labelled rows all weights are 0.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("train_id"))
        .agg(F.min(label_col).cast("int").alias("y"))
    )
    known = materialize(known, "quality-labels")
    n = known.count()
    if not n:
        return np.zeros((1 << BITS) + 1)
    draw = F.pmod(F.xxhash64("train_id", F.lit("quality")), F.lit(1 << 20))
    chosen = known.where(draw < int(np.ceil((1 << 20) * min(1.0, max_train / n))))
    trainers = int(np.clip(n // ROWS_PER_TRAINER, 1, MAX_TRAINERS))
    # max_train bounds the broadcast side
    texts = docs.select(F.col(id_col).alias("train_id"), "text")
    rows = texts.join(F.broadcast(chosen), "train_id").select(F.pmod(F.xxhash64("train_id"), F.lit(trainers)).alias("trainer"), "train_id", "text", "y")

    def fit(part: pa.Table) -> pa.Table:
        ids, texts, ys = (part.column(c).to_pylist() for c in ("train_id", "text", "y"))
        order = sorted(range(len(ids)), key=lambda i: _hash(f"{ids[i]}|{texts[i]}"))
        cases = [(*x, ys[i]) for i, x in zip(order, features(pa.array([texts[i] for i in order], pa.string())))]
        model = Ftrl()
        for _ in range(EPOCHS):
            for at, x, y in cases:
                model.learn(at, x, y)
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        return pa.table({"at": pa.array(at, pa.int64()), "w": pa.array(w[at], pa.float64())})

    fitted = rows.groupBy("trainer").applyInArrow(fit, "at long, w double")
    mean = fitted.groupBy("at").agg(F.sum("w").alias("w")).collect()  # one row a weight at most
    out = np.zeros((1 << BITS) + 1)
    for r in mean:
        out[r["at"]] = r["w"] / trainers
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the probability of label 1, by a sparse dot product of each whole text.

    A null text counts as empty; an input column of that name is replaced.
    """
    docs = docs.drop(score_col)
    names, at_text = docs.columns, docs.columns.index(text_col)
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(score_col, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            p = []
            for at, x in features(batch.column(at_text)):
                p.append(float(sigmoid(float(w[at] @ x) + float(w[-1]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*names, score_col])

    return docs.mapInArrow(apply, schema)
