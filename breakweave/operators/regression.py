"""Regression of counts on several factors with coverage as offset, by scoring steps whose sums Spark takes."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import digamma, lgamma, trigamma
from ..plans.scratch import materialize, scratch_tables

#: Levels of one factor, at most: coefficients and their equations are solved on the driver.
MOST_LEVELS = 200
#: A dispersion parameter beyond this is none: counts vary no more than Poisson's.
MOST_THETA = 1e6
FAMILIES = ("poisson", "quasipoisson", "negative_binomial")
_RESULT = "term string, level string, estimate double, std_error double, statistic double, p_value double, family string, theta double, dispersion double, n_rows long"


def _levels(df: DataFrame, factors: list[str]) -> list[list[str | None]]:
    """Sorted levels of each factor; the first is its reference, and null is a level of its own, the last."""
    out = []
    for f in factors:
        found = [r[0] for r in df.select(F.col(f).cast("string")).distinct().limit(MOST_LEVELS + 1).collect()]
        if len(found) > MOST_LEVELS:
            raise ValueError(f"{f} has more than {MOST_LEVELS} levels")
        out.append(sorted(found, key=lambda v: (v is None, v)))
    return out


class _Fit:
    """The sums of one model over ``x`` (``i0, i1, ...`` level numbers, ``y``, ``off``, ``k`` equal rows)."""

    def __init__(self, x: DataFrame, sizes: list[int]):
        self.x, self.sizes = x, sizes
        self.starts = np.cumsum([1, *[s - 1 for s in sizes]])
        self.p = int(self.starts[-1])
        self.cells = [f"i{j}" for j in range(len(sizes))]

    def design(self, cell: list[int]) -> np.ndarray:
        row = np.zeros(self.p)
        row[0] = 1
        for j, i in enumerate(cell):
            if i:
                row[self.starts[j] + i - 1] = 1
        return row

    def linear(self, b: np.ndarray) -> Column:
        """The linear predictor without offset: one literal array a factor."""
        eta = F.lit(float(b[0]))
        for j, s in enumerate(self.sizes):
            own = [0.0, *map(float, b[self.starts[j] : self.starts[j] + s - 1])]
            eta = eta + F.get(F.array(*map(F.lit, own)), F.col(f"i{j}"))
        return eta

    def sums(self, b: np.ndarray | None, theta: float | None) -> dict:
        """Normal equations of the next step, log likelihood, Pearson's sum, and the score and information of theta.

        Without coefficients, means start from the counts themselves.
        """
        y, off, k = F.col("y"), F.col("off"), F.col("k")
        eta = F.log(y + 0.1) - off if b is None else self.linear(b)
        x = self.x.withColumn("eta", eta).withColumn("mu", F.exp(F.col("eta") + off))
        mu, eta = F.col("mu"), F.col("eta")
        t = F.lit(theta)
        var = mu if theta is None else mu + mu * mu / t
        w = mu * mu / var
        if theta is None:
            ll = y * F.log(mu) - mu - lgamma(y + 1.0)
            more = [F.sum(k * (y / mu - 1) * (y / mu - 1)).alias("u"), F.lit(0.0).alias("i")]
        else:
            ll = lgamma(y + t) - lgamma(t) - lgamma(y + 1.0) + t * F.log(t / (t + mu)) + y * F.log(mu / (t + mu))
            u = digamma(y + t) - digamma(t) + F.log(t) + 1 - F.log(t + mu) - (y + t) / (t + mu)
            i = trigamma(t) - trigamma(y + t) - 1 / t + 2 / (t + mu) - (y + t) / ((t + mu) * (t + mu))
            more = [F.sum(k * u).alias("u"), F.sum(k * i).alias("i")]
        rows = x.groupBy(*self.cells).agg(
            F.sum(k * w).alias("w"), F.sum(k * w * (eta + (y - mu) / mu)).alias("z"), F.sum(k * ll).alias("ll"),
            F.sum(k * (y - mu) * (y - mu) / var).alias("chi"), F.sum("k").alias("n"), *more,
        )
        a, v = np.zeros((self.p, self.p)), np.zeros(self.p)
        out = dict(ll=0.0, chi=0.0, n=0, u=0.0, i=0.0)
        for r in rows.collect():  # one row a combination of levels
            d = self.design([r[c] for c in self.cells])
            a += r["w"] * np.outer(d, d)
            v += r["z"] * d
            for name in out:
                out[name] += r[name]
        return out | dict(a=a, v=v)

    def coefficients(self, theta: float | None = None, b: np.ndarray | None = None, with_theta: bool = False, rounds: int = 100) -> tuple[np.ndarray, float | None, dict]:
        """Scoring steps to the greatest likelihood, halved where one would lower it; theta moves with the coefficients."""
        at = self.sums(b, theta)
        if b is None:
            b = _solve(at["a"], at["v"])
            at = self.sums(b, theta)
        for _ in range(rounds):
            to = _solve(at["a"], at["v"])
            to_theta = theta
            if with_theta:
                step = at["u"] / at["i"] if at["i"] > 0 else math.copysign(theta, at["u"])
                to_theta = min(max(theta + step, theta / 5), theta * 5)
                if to_theta > MOST_THETA:
                    return b, math.inf, at
            for _ in range(30):
                new = self.sums(to, to_theta)
                if new["ll"] >= at["ll"] - 1e-9 * (1 + abs(at["ll"])):
                    break
                to = (to + b) / 2
                to_theta = (to_theta + theta) / 2 if with_theta else theta
            moved = np.abs(to - b).max() / (1 + np.abs(b).max()) + (abs(to_theta / theta - 1) if with_theta else 0.0)
            b, theta, at = to, to_theta, new
            if moved < 1e-9:
                return b, theta, at
        raise ArithmeticError("the regression did not converge")


def _solve(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(a, v, rcond=1e-12)[0]


def normal_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_tails(t: float, df: float) -> float:
    """Both tails of Student's t: the incomplete beta function by its continued fraction."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(1 - x, b, a) * front / b
    return _beta_fraction(x, a, b) * front / a


def _beta_fraction(x: float, a: float, b: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 500):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def rate_model(df: DataFrame, factors: list[str], n: str, coverage: str, family: str = "negative_binomial") -> DataFrame:
    """``term, level, estimate, std_error, statistic, p_value, family, theta, dispersion, n_rows``: log rates of counts
    by several factors, with log coverage as offset.

    The first row is the intercept (the first level of every factor), then one row for each other level. A negative
    binomial model estimates its ``theta`` by likelihood together with the coefficients; where counts vary no more
    than Poisson's it becomes ``quasipoisson``, as ``family`` tells. Quasi-Poisson standard errors are widened
    by Pearson's ``dispersion`` and tested with Student's t, the others with the normal distribution.

    Equal rows are counted once; a step takes one aggregation, whose result has a row for each combination
    of levels. Rows with a null count or without coverage take no part; of levels that others determine (a project
    with one group), the shares are those of the least coefficients. An empty table gives no rows.
    """
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    used = df.where(F.col(n).isNotNull() & (F.col(coverage) > 0))
    with scratch_tables(df.sparkSession):
        levels = _levels(used, factors)
        if not all(levels):
            return df.sparkSession.createDataFrame([], _RESULT)
        numbers = []
        for j, (f, found) in enumerate(zip(factors, levels)):
            at = F.lit(len(found) - 1) if found[-1] is None else F.lit(None).cast("int")
            for i, level in enumerate(found):
                if level is not None:
                    at = F.when(F.col(f).cast("string") == level, i).otherwise(at)
            numbers.append(at.alias(f"i{j}"))
        x = used.select(*numbers, F.col(n).cast("double").alias("y"), F.log(F.col(coverage).cast("double")).alias("off"))
        x = materialize(x.groupBy(*x.columns).agg(F.count("*").alias("k")), "rates")
        fit = _Fit(x, [len(v) for v in levels])
        b, _, at = fit.coefficients()
        theta, free = None, max(int(at["n"] - np.linalg.matrix_rank(at["a"])), 1)
        if family == "negative_binomial":
            b_nb, theta, at_nb = fit.coefficients(theta=at["n"] / max(at["u"], 1e-9), b=b, with_theta=True)
            if math.isinf(theta):
                family, theta = "quasipoisson", None
            else:
                b, at = b_nb, at_nb
    dispersion = float(at["chi"] / free)
    wide = dispersion if family == "quasipoisson" else 1.0
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(at["a"], hermitian=True)), 0) * wide)
    names = [("(intercept)", None)] + [(f, v) for f, found in zip(factors, levels) for v in found[1:]]
    out = []
    for (term, level), estimate, e in zip(names, b, error):
        z = float(estimate / e) if e > 0 else 0.0
        p = student_tails(z, free) if family == "quasipoisson" else normal_tails(z)
        out.append((term, level, float(estimate), float(e), z, float(p), family, None if theta is None else float(theta), dispersion, int(at["n"])))
    return df.sparkSession.createDataFrame(out, _RESULT)
