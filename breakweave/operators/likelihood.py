"""Dispersions and mixtures of counts by greatest likelihood, from histograms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dispersion parameter beyond this is none: counts vary no more than Poisson's.
MOST_THETA = 10_000.0
#: Copies of the unreplicated, half replicated and replicated state, against the first.
STATES = (1.0, 1.5, 2.0)

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _digamma(x: np.ndarray) -> np.ndarray:
    z = x + 8
    i2 = 1 / (z * z)
    out = np.log(z) - 1 / (2 * z) - i2 * (1 / 12 - i2 * (1 / 120 - i2 * (1 / 252 - i2 / 240)))
    return out - sum(1 / (x + k) for k in range(8))


def nbinom_log_pmf(n: np.ndarray, mu: np.ndarray | float, theta: float) -> np.ndarray:
    """Log probabilities of counts by mean and dispersion."""
    mu = np.maximum(mu, 1e-300)
    return _lgamma(n + theta) - math.lgamma(theta) - _lgamma(n + 1.0) + theta * np.log(theta / (theta + mu)) + n * np.log(mu / (theta + mu))


def fit_dispersion(n: np.ndarray, k: np.ndarray, most: float = MOST_THETA) -> tuple[float, float, float]:
    """(mean, theta, log likelihood) of a negative binomial for counts ``n`` seen ``k`` times.

    The mean's likelihood is greatest at the average. Theta is the root of the score on a logarithmic
    scale: secant steps inside a bracket, which is halved where they leave it. ``most`` where the score
    is still positive there.
    """
    total = k.sum()
    mean = float((k * n).sum() / total)
    if mean == 0:
        return 0.0, most, 0.0

    def score(log_theta: float) -> float:
        t = math.exp(log_theta)
        own = _digamma(n + t) - _digamma(np.array(t)) + log_theta + 1 - np.log(t + mean) - (n + t) / (t + mean)
        return float((k * own).sum()) * t

    low, high = math.log(1e-6), math.log(most)
    theta = most
    if score(high) < 0:
        f_low, f_high = score(low), score(high)
        for _ in range(200):
            at = (low * f_high - high * f_low) / (f_high - f_low)
            if not low + 0.01 * (high - low) < at < high - 0.01 * (high - low):
                at = (low + high) / 2
            f = score(at)
            if f > 0:
                low, f_low = at, f
            else:
                high, f_high = at, f
            if high - low < 1e-12 or f == 0:
                break
        theta = math.exp((low + high) / 2)
    return mean, theta, float((k * nbinom_log_pmf(n, mean, theta)).sum())


def fit_replication(n: np.ndarray, k: np.ndarray, theta: float, rounds: int = 2000) -> tuple[float, float, list[float]]:
    """(share of replicated alleles, mean of the unreplicated state, log likelihoods of all rounds).

    The states are negative binomials at 1, 1.5 and 2 times a base mean, in the shares of two alleles that
    are replicated independently. Expectation-maximisation: the share has a closed form, the base takes a
    scoring step that is halved until the expected likelihood grows, so the likelihood never falls.
    """
    total, mean = k.sum(), float((k * n).sum() / k.sum())
    if mean == 0:
        return 0.0, 0.0, [0.0]
    best: tuple[float, float, list[float]] | None = None
    for start in (0.05, 0.5, 0.95):  # likelihoods can have several tops
        f, base, trace = start, mean / (1 + start), []
        for _ in range(rounds):
            logs = np.stack([nbinom_log_pmf(n, base * m, theta) for m in STATES]) + np.log(np.maximum([[(1 - f) ** 2], [2 * f * (1 - f)], [f * f]], 1e-300))
            top = logs.max(axis=0)
            density = top + np.log(np.exp(logs - top).sum(axis=0))
            trace.append(float((k * density).sum()))
            if len(trace) > 1 and trace[-1] - trace[-2] < 1e-10 * (1 + abs(trace[-1])):
                break
            r = np.exp(logs - density) * k
            f = float((r[1] + 2 * r[2]).sum() / (2 * total))
            expected = lambda b: sum((r[j] * nbinom_log_pmf(n, b * m, theta)).sum() for j, m in enumerate(STATES))  # noqa: E731, B023
            slope = sum((r[j] * (n - base * m) * theta / (base * (theta + base * m))).sum() for j, m in enumerate(STATES))
            bend = sum((r[j] * m * theta / (base * (theta + base * m))).sum() for j, m in enumerate(STATES))
            step, now = slope / bend, expected(base)
            while abs(step) > 1e-14 * base and (base + step <= 0 or expected(base + step) < now):
                step /= 2
            base += step if base + step > 0 else 0.0
        if best is None or trace[-1] > best[2][-1] + 1e-9:
            best = f, base, trace
    return best


def _histogram(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``keys, n, k``: one row a distinct count, which bounds what a key's fit holds, however many rows it has."""
    return df.where(F.col(n).isNotNull() & (F.col(n) >= 0)).groupBy(*keys, F.col(n).cast("double").alias("__n")).agg(F.count("*").cast("double").alias("__k"))


def nbinom_dispersion(df: DataFrame, keys: list[str], n: str, most: float = MOST_THETA) -> DataFrame:
    """``keys, n_rows, mean, theta, log_likelihood`` of each key's counts, by greatest likelihood. Null and negative
    counts take no part; keys without others have no row."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", n_rows long, mean double, theta double, log_likelihood double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        own, k = part["__n"].to_numpy(), part["__k"].to_numpy()
        mean, theta, ll = fit_dispersion(own, k, most)
        return part[keys].head(1).assign(n_rows=int(k.sum()), mean=mean, theta=theta, log_likelihood=ll)

    return _histogram(df, keys, n).groupBy(*keys).applyInPandas(fit, schema)


def replication_likelihood(df: DataFrame, keys: list[str], n: str, theta: float = 20.0) -> DataFrame:
    """``keys, fraction_s, base, log_likelihood`` of each key's counts: see :func:`fit_replication`."""
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keys) + ", fraction_s double, base double, log_likelihood double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        f, base, trace = fit_replication(part["__n"].to_numpy(), part["__k"].to_numpy(), theta)
        return part[keys].head(1).assign(fraction_s=f, base=base, log_likelihood=trace[-1])

    return _histogram(df, keys, n).groupBy(*keys).applyInPandas(fit, schema)
