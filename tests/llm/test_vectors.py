"""Whitening and product codes: against plain computations, odd rows and ties."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.llm import codes, queries, spectrum, whitening

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, embedding array<float>, label int, x int, v string, n int, part int, code int, l int, i int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", 2, 3, 4, 5, 6) for i, v, label in rows], KIND)


def odd(d=16, n=40):
    r = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in r.normal(0, 1, d)], int(i % 3)) for i in range(n)]
    rows += [(None, rows[3][1], None), (n, rows[4][1], None), (4, rows[4][1], 1), (4, rows[4][1], 1), (5, rows[6][1], 0)]
    rows += [(100, None, 1), (101, [float("nan")] + [0.0] * (d - 1), 1), (102, [float("inf")] * d, 1), (103, [None] + [1.0] * (d - 1), 1)]
    rows += [(104, [], 1), (105, [1.0] * (d + 1), 1), (106, [0.0] * d, None), (-7, [-0.001] * d, 2), (107, [1e30] + [0.0] * (d - 1), 2)]
    return rows


# spectrum


def matrices():
    r = np.random.default_rng(1)
    for t in range(60):
        d = int(r.integers(1, 50))
        q, _ = np.linalg.qr(r.standard_normal((d, d)))
        e = [r.random(d) * 9, np.repeat(r.random(d) * 9, 3)[:d], np.full(d, 3.0), 10.0 ** -np.arange(d), np.where(np.arange(d) < d // 2, 0.0, 1 + r.random(d))][t % 5]
        a = (q * e) @ q.T
        yield (a + a.T) / 2


def test_inertia_counts_eigenvalues():
    r = np.random.default_rng(2)
    for a in matrices():
        a = a - np.eye(len(a)) * r.uniform(0, 5)  # indefinite ones too
        w = np.linalg.eigvalsh(a)
        for s in r.uniform(w[0] - 1, w[-1] + 1, 5):
            assert spectrum.count_above(a, s) == (w > s).sum()
    assert spectrum.count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1  # needs a two-row pivot


def test_eigenpairs_match_a_dense_solver():
    for a in matrices():
        w = np.linalg.eigvalsh(a)[::-1]
        values, vectors = spectrum.leading_eigenpairs(a, 16)
        k = len(values)
        assert k >= min(16, (w > 1e-9 * w[0]).sum())
        assert np.abs(values - w[:k]).max(initial=0) <= 1e-12 * max(w[0], 1)
        assert np.abs(vectors.T @ vectors - np.eye(k)).max(initial=0) < 1e-10
        assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-12 * max(w[0], 1)
    assert spectrum.leading_eigenpairs(np.zeros((3, 3)), 2)[0].size == 0


# whitening


def plain_white(rows, k=16):
    good = [(i, v) for i, v, _ in rows if v and len(v) == 16 and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    x = [[min(int(np.floor(64 * float(np.float32(c)))), 1 << 40) + 1_000_000 for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * a - s) / n for a, s in zip(f, total)] for f in fit])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    return good, x, n, total, cov, values[::-1][:k], axes[:, ::-1][:, :k]


def test_whitening_matches_a_plain_one(spark):
    rows = [r for r in odd() if r[0] != 107]
    good, x, n, total, cov, values, axes = plain_white(rows)
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 16 * len(good)
    assert {r.n for r in got} == {n} and {r.identity_error for r in got}.pop() < 1e-10
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.deviation), {})[r.component] = (r.whitened, r.explained)
    signs = {}
    for (i, _), e in zip(good, x):
        deviation = sum((n * a - s) ** 2 for a, s in zip(e, total))
        parts = mine[i, deviation]
        white = np.array([(n * a - s) / n for a, s in zip(e, total)]) @ axes / np.sqrt(values)
        for c in range(16):
            assert abs(abs(parts[c + 1][0]) - abs(white[c])) < 1e-8
            assert abs(parts[c + 1][1] - values[c] / np.trace(cov)) < 1e-12
            if abs(white[c]) > 1e-6:
                assert signs.setdefault(c, parts[c + 1][0] * white[c] > 0) == (parts[c + 1][0] * white[c] > 0)


def test_whitening_of_few_vectors_and_huge_entries(spark):
    one = [(i, [1.0] * 16, 0) for i in range(9)]
    empty = whitening.whiten(table(spark, one))
    assert empty.collect() == [] and whitening.whiten(table(spark, [])).collect() == []
    two = whitening.whiten(table(spark, one + [(10, [2.0] + [1.0] * 15, 0)])).collect()
    assert {r.component for r in two} == {1} and {round(abs(r.whitened), 9) for r in two} == {1.0} and len(two) == 10
    # sums past a long are exact, and saturate only in the deviation
    huge = whitening.whiten(table(spark, odd())).where("vec_id = 107 and component = 1").collect()
    assert huge[0].deviation == (1 << 63) - 1 and huge[0].explained > 0.99


def test_exact_products_beyond_doubles():
    z = np.array([[1 << 40, 3], [-(1 << 39), 5]], dtype=np.int64)
    assert whitening.exact_products(z).tolist() == [[(1 << 80) + (1 << 78), 3 * (1 << 40) - 5 * (1 << 39)], [3 * (1 << 40) - 5 * (1 << 39), 34]]


# codes


def plain_codes(rows, d=16):
    good = [(i, [int(np.floor(4096 * float(np.float32(c)))) for c in v], label) for i, v, label in rows if v and len(v) == d and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    good = [(i, [min(c, 1 << 40) for c in v], label) for i, v, label in good]
    first = {}
    for i, v, _ in good:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    w = d // 8
    books = [[first[i][p * w : p * w + w] for i in sorted(first)[:16]] for p in range(8)]

    def assign(v, p):
        apart = [sum((a - b) ** 2 for a, b in zip(v[p * w : p * w + w], e)) for e in books[p]]
        return min(range(len(apart)), key=apart.__getitem__), min(apart)

    for _ in range(6):
        for p in range(8):
            held = {}
            for _, v, _ in good:
                held.setdefault(assign(v, p)[0], []).append(v[p * w : p * w + w])
            for e, vs in held.items():
                books[p][e] = [sum(c) // len(vs) for c in zip(*vs)]
    out, by_label = [], {}
    for i, v, label in good:
        at = [assign(v, p) for p in range(8)]
        error = sum(a for _, a in at)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{c:02x}" for c, _ in at), min(error, (1 << 63) - 1), label))
    return sorted(map(str, ((i, c, e, min(by_label[label], (1 << 63) - 1)) for i, c, e, label in out))), books


@pytest.mark.parametrize("with_huge", [False, True])
def test_codes_match_a_plain_computation(spark, with_huge):
    rows = [r for r in odd() if with_huge or r[0] != 107]
    want, books = plain_codes(rows)
    coded, mine = codes.compress(table(spark, rows))
    assert mine.tolist() == books
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in coded.collect()) == want
    assert codes.digest(mine) == hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()


def test_ties_and_unused_entries(spark):
    # the same vector under the first ids: later entries tie and are never used, so they stay
    rows = [(i, [0.5] * 16, None) for i in range(20)] + [(i, [1.0] * 16, 1) for i in range(20, 30)]
    coded, books = codes.compress(table(spark, rows))
    want, plain = plain_codes(rows)
    assert books.tolist() == plain and sorted(str((r.vec_id, r.code, r.error, r.label_error)) for r in coded.collect()) == want


def test_few_no_and_uneven_vectors(spark):
    coded, books = codes.compress(table(spark, []))
    assert coded.collect() == [] and coded.columns == ["vec_id", "label", "code", "error", "label_error"]
    assert codes.compress(table(spark, [(None, [1.0] * 16, 1)]))[0].count() == 0
    coded, books = codes.compress(table(spark, odd()[:3]))
    assert books.shape == (8, 3, 2) and coded.agg(F.sum("error")).head()[0] == 0
    with pytest.raises(ValueError):
        codes.compress(table(spark, [(1, [1.0] * 9, 1)]))


def test_trie_walk_shares_prefixes_across_blocks():
    r = np.random.default_rng(3)
    parts = np.unique(r.integers(-3, 3, (500, 4)), axis=0)
    entries = r.integers(-3, 3, (5, 4))
    walk = codes.TrieWalk(entries)
    blocks = [walk.distances(b) for b in np.array_split(parts, 37)]
    assert np.array_equal(np.concatenate(blocks), ((parts[:, None] - entries) ** 2).sum(axis=2))
    # in any order of blocks, only the sharing is lost
    walk = codes.TrieWalk(entries)
    assert np.array_equal(np.concatenate([walk.distances(b) for b in np.array_split(parts[::-1], 9)]), ((parts[::-1][:, None] - entries) ** 2).sum(axis=2))


def test_a_hot_part_is_counted_before_it_moves(spark):
    rows = spark.range(3000).select(F.array(*[F.lit(i).cast("long") for i in range(16)]).alias("x"))
    trie = codes.part_trie(rows, 8)
    assert {(r.part, r.n) for r in trie.collect()} == {(p, 3000) for p in range(8)}
    assert "partial_count" in trie._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_queries_cover_all_rows(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert queries.QUERIES["op13_vector_codes"](spark, SF).count() == n
    white = queries.QUERIES["op11_whitening"](spark, SF)
    assert white.count() == 16 * n and white.agg(F.max("identity_error")).head()[0] <= 1e-4
