"""Regression of counts against plain solvers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakweave.functions.analysis import digamma, trigamma
from breakweave.operators import regression


def poisson_draw(r, mu):
    if mu > 50:
        return max(0, round(r.gauss(mu, math.sqrt(mu))))
    n, p, limit = 0, r.random(), math.exp(-mu)
    while p > limit:
        n, p = n + 1, p * r.random()
    return n


def counts(seed, theta, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        g, p = r.choice("AB"), r.choice("xyz")
        cov = r.uniform(5, 500)
        mu = cov * math.exp(-2 + (g == "B") * 0.7 + (p == "y") * -0.4 + (p == "z") * 0.2)
        rows.append((g, p, poisson_draw(r, mu * (r.gammavariate(theta, 1 / theta) if theta else 1)), cov))
    return rows + rows[:10]


def design(rows):
    x = np.array([[1, g == "B", p == "y", p == "z"] for g, p, _, _ in rows], dtype=float)
    return x, np.array([r[2] for r in rows], dtype=float), np.log([r[3] for r in rows])


def plain_poisson(x, y, off):
    b = np.zeros(x.shape[1])
    b[0] = math.log(y.sum() / np.exp(off).sum())
    for _ in range(100):
        mu = np.exp(x @ b + off)
        b += np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu))
    return b, np.exp(x @ b + off)


def log_likelihood(b, theta, x, y, off):
    mu = np.exp(x @ b + off)
    return sum(math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1) + theta * math.log(theta / (theta + m)) + v * math.log(m / (theta + m)) for v, m in zip(y, mu))


def fitted(spark, rows, family):
    df = spark.createDataFrame(rows, "grp string, project string, n long, cov double")
    got = regression.rate_model(df, ["grp", "project"], "n", "cov", family).collect()
    assert [(r.term, r.level) for r in got] == [("(intercept)", None), ("grp", "B"), ("project", "y"), ("project", "z")]
    return got


@pytest.mark.parametrize("family", ["poisson", "quasipoisson"])
def test_two_factors_match_a_plain_poisson_regression(spark, family):
    rows = counts(1, 4)
    x, y, off = design(rows)
    b, mu = plain_poisson(x, y, off)
    got = fitted(spark, rows, family)
    dispersion = ((y - mu) ** 2 / mu).sum() / (len(y) - 4)
    error = np.sqrt(np.diag(np.linalg.inv((x * mu[:, None]).T @ x)) * (dispersion if family == "quasipoisson" else 1))
    assert np.allclose([r.estimate for r in got], b, atol=1e-7)
    assert np.allclose([r.std_error for r in got], error, rtol=1e-6)
    assert all(r.n_rows == len(y) and abs(r.dispersion - dispersion) < 1e-6 * dispersion for r in got)


def test_negative_binomial_is_the_greatest_likelihood(spark):
    rows = counts(2, 3)
    x, y, off = design(rows)
    got = fitted(spark, rows, "negative_binomial")
    b, theta = np.array([r.estimate for r in got]), got[0].theta
    top = log_likelihood(b, theta, x, y, off)
    for i in range(4):  # flat in every direction, and lower around
        for d in (1e-4, -1e-4):
            assert log_likelihood(b + d * np.eye(4)[i], theta, x, y, off) < top
    assert log_likelihood(b, theta * 1.002, x, y, off) < top and log_likelihood(b, theta / 1.002, x, y, off) < top
    mu = np.exp(x @ b + off)
    error = np.sqrt(np.diag(np.linalg.inv((x * (mu / (1 + mu / theta))[:, None]).T @ x)))
    assert np.allclose([r.std_error for r in got], error, rtol=1e-5)
    # the planted values lie within the usual errors
    for r, planted in zip(got, (-2, 0.7, -0.4, 0.2)):
        assert abs(r.estimate - planted) < 4 * r.std_error
        assert abs(r.p_value - math.erfc(abs(r.statistic) / math.sqrt(2))) < 1e-12
    assert 2 < theta < 4.5


def test_counts_without_overdispersion_fall_back(spark):
    rows = [(g, p, round(cov * (0.5 if g == "A" else 1.0)), cov) for g in "AB" for p in "xyz" for cov in (10.0, 20.0, 40.0)]
    got = fitted(spark, rows, "negative_binomial")
    assert got[0].family == "quasipoisson" and got[0].theta is None and abs(got[1].estimate - math.log(2)) < 0.02


def test_odd_tables(spark):
    kind = "grp string, project string, n long, cov double"
    empty = regression.rate_model(spark.createDataFrame([], kind), ["grp"], "n", "cov")
    assert empty.collect() == []
    rows = [("a", "p", 5, 1.0), (None, "p", 10, 1.0), ("a", "p", None, 1.0), ("a", "p", 3, 0.0), ("a", "p", 3, None), ("a", "p", 5, 1.0), (None, "p", 11, 1.0)]
    got = regression.rate_model(spark.createDataFrame(rows, kind), ["grp", "project"], "n", "cov", "poisson").collect()
    assert [(r.term, r.level, round(math.exp(r.estimate), 6)) for r in got] == [("(intercept)", None, 5.0), ("grp", None, 2.1)]
    with pytest.raises(ValueError):
        regression.rate_model(spark.createDataFrame(rows, kind), ["grp"], "n", "cov", "gamma")
    # a project that has one group only: the model fits, though its two coefficients are not told apart
    rows = [("a", "p", 5, 1.0), ("b", "q", 9, 1.0), ("a", "p", 7, 1.0), ("b", "q", 11, 1.0)]
    got = regression.rate_model(spark.createDataFrame(rows, kind), ["grp", "project"], "n", "cov", "poisson").collect()
    assert abs(sum(r.estimate for r in got) - math.log(10)) < 1e-6


def test_special_functions(spark):
    for t, df, p in ((2.0, 5, 0.101939), (0.0, 3, 1.0), (12.706205, 1, 0.05), (-1.0, 30, 0.325312)):
        assert abs(regression.student_tails(t, df) - p) < 1e-5
    x = [1e-3, 0.3, 1.0, 2.5, 40.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", digamma(F.col("x")).alias("d"), trigamma(F.col("x")).alias("t")).collect()
    for r in got:
        d = -0.5772156649015329 + sum(1 / (k + 1) - 1 / (k + r.x) for k in range(400_000)) - math.log(1 - 0)
        t = sum(1 / (k + r.x) ** 2 for k in range(400_000))
        assert abs(r.d - d) < 1e-3 and abs(r.t - t) < 1e-4 * max(1, t)
