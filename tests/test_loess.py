"""Local regression against plain weighted fits."""

import numpy as np
import pytest

from breakweave.operators import loess


def plain(x, y, at, span):
    n = len(x)
    q = min(n, max(1, int(np.floor(n * span + 1e-9))))
    out = []
    for x0 in at:
        d = np.abs(x - x0)
        h = np.sort(d)[q - 1] * max(span, 1)
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0)
        a = np.stack([np.ones(n), x - x0, (x - x0) ** 2], axis=1) * np.sqrt(w)[:, None]
        out.append(np.linalg.lstsq(a, y * np.sqrt(w), rcond=None)[0][0])
    return np.array(out)


@pytest.mark.parametrize("span", [0.2, 0.75, 1.0, 1.5])
def test_fits_match_plain_ones(span, monkeypatch):
    r = np.random.default_rng(1)
    x = np.sort(r.uniform(0, 50, 80))
    y = np.sin(x / 9) * 3 + 10 + r.normal(0, 0.3, 80)
    at = np.concatenate([x, [1.5, 33.3]])
    want = plain(x, y, at, span)
    assert np.abs(loess.local_fit(x, y, at, span) - want).max() < 1e-9
    monkeypatch.setattr(loess, "BLOCK", 300)
    assert np.abs(loess.local_fit(x, y, at, span) - want).max() < 1e-9


def test_a_quadratic_is_kept():
    x = np.arange(30.0)
    assert np.allclose(loess.local_fit(x, 3 + x - 0.1 * x * x, x, 0.5), 3 + x - 0.1 * x * x)
    assert np.allclose(loess.local_fit(x[:2], np.array([5.0, 5.0]), x[:2]), 5.0)  # too few for a quadratic


def test_shapes_of_keys(spark):
    rows = [("a", i, float(20 + i % 3 + i * i / 100)) for i in range(60)] + [("b", i, 7.0) for i in range(20)] + [("few", i, float(i)) for i in range(4)] + [("a", 60, None)]
    got = loess.local_shape(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v").collect()
    assert len(got) == len(rows)
    of = {(r.k, r.i): r for r in got}
    y = np.array([of["a", i].v for i in range(60)])
    want = plain(np.arange(60.0), y, np.arange(61.0), 1.0) / y.mean()
    assert np.allclose([of["a", i].shape for i in range(61)], want) and of["a", 60].v is None and of["a", 60].corrected is None
    assert np.isclose(sum(of["a", i].corrected for i in range(60)), y.sum())
    assert all(abs(of["b", i].shape - 1) < 1e-9 for i in range(20)) and all(of["few", i].shape == 1 and of["few", i].corrected == i for i in range(4))
    assert loess.local_shape(spark.createDataFrame([], "k string, i int, v double"), ["k"], "i", "v").collect() == []


def test_counts_lose_the_trend_of_a_chromosome_and_keep_their_gains(spark):
    from breakweave.plans.copy_number import call_cnvs, shaped_counts

    r = np.random.default_rng(4)
    trend = lambda chrom, i: 0.82 + 0.36 * i / 149 if chrom == 0 else 1.0
    copies = lambda cell, chrom, i: 3 if (cell, chrom) == (0, 0) and 40 <= i < 60 else 2
    rows = [(cell, chrom, i, int(r.poisson(200 * copies(cell, chrom, i) * trend(chrom, i))), 36 + i % 7) for cell in range(2) for chrom in range(2) for i in range(150)]
    counts = spark.createDataFrame(rows, "cell_id int, chrom int, bin_n int, n long, gc_index int")
    cn = spark.createDataFrame([(*x[:3], copies(*x[:3])) for x in rows if x[2] != 7], "cell_id int, chrom int, bin_n int, cn int")
    flat = {(x.cell_id, x.chrom, x.bin_n): x.n for x in shaped_counts(counts, cn, 2).collect()}
    assert len(flat) == len(rows)
    for cell in range(2):
        for chrom in range(2):
            own = [x for x in rows if x[:2] == (cell, chrom)]
            assert np.isclose(sum(flat[x[:3]] for x in own), sum(x[3] for x in own))
            level = np.array([flat[x[:3]] / copies(*x[:3]) for x in own])
            assert abs(np.polyfit(np.arange(150), level / level.mean(), 1)[0] * 149) < 0.03  # no slope is left
    shaped = call_cnvs(counts, min_bins=5, shape_span=1.0, theta=200.0, persistence=0.999).collect()
    assert [(x.cell_id, x.chrom, x.type) for x in shaped] == [(0, 0, "gain")] and abs(shaped[0].first - 40) <= 2 and abs(shaped[0].last - 59) <= 2
