"""Quantiles and densities against plain ones."""

import numpy as np
import pytest

from breakweave.operators import distributions as d


def values():
    r = np.random.default_rng(3)
    return {
        "two": [*r.normal(10, 1, 400), *r.normal(16, 2, 300)],
        "tail": [*r.gamma(3, 4, 900)],
        "hot": [5.0] * 3000 + [*r.normal(5, 1, 200)],
        "one": [7.5],
        "pair": [1.0, 4.0],
        "same": [2.0] * 9,
    }


def frame(spark):
    rows = [(k, float(x)) for k, v in values().items() for x in v] + [(None, 3.0), (None, 5.0), ("tail", None), ("gone", None), ("hot", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double")


def test_quantiles_are_exact(spark):
    p = [0, 0.025, 0.25, 0.5, 0.9, 1]
    got = {r.k: r for r in d.exact_quantiles(frame(spark).where("k is not null"), ["k"], "v", p).collect()}
    assert set(got) == set(values())
    for k, v in values().items():
        assert got[k].n == len(v) and np.allclose([got[k][f"q{j}"] for j in range(len(p))], np.quantile(v, p), rtol=1e-12)
    whole = d.exact_quantiles(frame(spark).where("k = 'tail'"), [], "v", [0.5]).collect()
    assert len(whole) == 1 and np.isclose(whole[0].q0, np.median(values()["tail"]))


def test_modes_are_those_of_a_plain_density(spark):
    got = {r.k: r for r in d.density_mode(frame(spark).where("k is not null"), ["k"], "v").collect()}
    for k, v in values().items():
        v = np.array(v)
        m = np.median(v)
        near = v[(v >= m / 5) & (v <= m * 5)]
        sd = near.std(ddof=1) if len(near) > 1 else 0.0
        iqr = (np.quantile(near, 0.75) - np.quantile(near, 0.25)) / 1.34
        least = min(sd, iqr) if iqr > 0 else sd
        bw = 0.9 * least * len(near) ** -0.2 if least > 0 else 1.0
        assert np.isclose(got[k].median, m) and np.isclose(got[k].bandwidth, bw, rtol=1e-9)
        grid = np.arange(near.min() - bw, near.max() + bw, bw / 200)
        plain = np.exp(-0.5 * ((grid[:, None] - near) / bw) ** 2).sum(axis=1)
        assert abs(got[k].mode - grid[plain.argmax()]) <= bw / d.BINS / 2 + bw / 200 or plain[np.abs(grid - got[k].mode).argmin()] > plain.max() * (1 - 1e-4), k


def test_no_window_spans_a_key(spark):
    x = d.density_mode(frame(spark), ["k"], "v")
    assert x.where("1 = 0").collect() == []
    plan = d.exact_quantiles(frame(spark), ["k"], "v", [0.5])._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "__b" in line or "__p" in line or "windowspecdefinition(__b" in line
    assert "Median" not in plan and "percentile" not in plan.lower()


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_nothing_gives_nothing(spark, rows):
    x = spark.createDataFrame(rows, "k string, v double")
    assert d.density_mode(x, ["k"], "v").collect() == [] and d.exact_quantiles(x, ["k"], "v", [0.5]).collect() == []
