"""Dispersions and mixtures against planted values and plain likelihoods."""

import numpy as np
import pytest

from breakweave.operators import likelihood as lk


def drawn(r, mu, theta, size):
    return r.poisson(mu * r.gamma(theta, 1 / theta, size))


def histogram(x):
    n, k = np.unique(x, return_counts=True)
    return n.astype(float), k.astype(float)


@pytest.mark.parametrize(("mu", "theta"), [(3.0, 0.5), (20.0, 5.0), (400.0, 60.0), (1.2, 2.0)])
def test_dispersion_is_the_greatest_likelihood(mu, theta):
    n, k = histogram(drawn(np.random.default_rng(1), mu, theta, 4000))
    mean, found, ll = lk.fit_dispersion(n, k)
    of = lambda m, t: (k * lk.nbinom_log_pmf(n, m, t)).sum()
    assert abs(ll - of(mean, found)) < 1e-6
    for m, t in ((mean * 1.01, found), (mean / 1.01, found), (mean, found * 1.02), (mean, found / 1.02)):
        assert of(m, t) < ll
    assert abs(mean / mu - 1) < 0.1 and abs(np.log(found / theta)) < 0.25


def test_no_overdispersion_gives_the_limit():
    n, k = histogram(np.repeat([4, 5, 6], 100))
    assert lk.fit_dispersion(n, k)[1] == lk.MOST_THETA and lk.fit_dispersion(np.array([0.0]), np.array([9.0])) == (0.0, lk.MOST_THETA, 0.0)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.6, 0.9])
def test_replication_recovers_planted_shares(share):
    r = np.random.default_rng(7)
    state = (r.random((2, 6000)) < share).sum(axis=0)
    n, k = histogram(drawn(r, 60 * np.array(lk.STATES)[state], 200.0, 6000))
    f, base, trace = lk.fit_replication(n, k, 200.0)
    assert all(b >= a - 1e-9 * abs(a) for a, b in zip(trace, trace[1:]))  # the likelihood never falls
    assert abs(f - share) < 0.04 and abs(base / 60 - 1) < 0.04


def test_keys_side_by_side(spark):
    r = np.random.default_rng(2)
    rows = [("a", int(v)) for v in drawn(r, 30.0, 4.0, 500)] + [("b", int(v)) for v in drawn(r, 5.0, 50.0, 300)] + [("c", 0)] * 5 + [("a", None), ("d", None), ("b", -3)]
    df = spark.createDataFrame(rows, "k string, n int")
    got = {x.k: x for x in lk.nbinom_dispersion(df, ["k"], "n").collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].mean == 0
    for key in "ab":
        n, k = histogram([v for q, v in rows if q == key and v is not None and v >= 0])
        assert np.allclose([got[key].n_rows, got[key].mean, got[key].theta, got[key].log_likelihood], [k.sum(), *lk.fit_dispersion(n, k)], rtol=1e-6)
    mixed = {x.k: x for x in lk.replication_likelihood(df, ["k"], "n").collect()}
    assert set(mixed) == {"a", "b", "c"} and all(0 <= x.fraction_s <= 1 for x in mixed.values())
    assert lk.nbinom_dispersion(df.where("1 = 0"), ["k"], "n").collect() == []
