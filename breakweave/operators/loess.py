"""Local quadratic regression of ordered values, key by key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a block of the distance matrix: bounds what a task holds for one key.
BLOCK = 1 << 20


def local_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 1.0) -> np.ndarray:
    """Values at ``at`` of quadratics fitted around each point with tricube weights of the nearest ``span`` of all points.

    From a span of 1 on all points count, with a reach of ``span`` times the farthest distance. Points that
    leave the quadratic open (fewer than three with weight) get the least-squares solution of least norm.
    """
    n = len(x)
    nearest = min(n, max(1, int(np.floor(n * span + 1e-9))))
    out = np.empty(len(at))
    rows = max(1, BLOCK // max(n, 1))
    for i in range(0, len(at), rows):
        apart = x[None, :] - at[i : i + rows, None]
        far = np.abs(apart)
        reach = np.partition(far, nearest - 1, axis=1)[:, nearest - 1 : nearest] * max(span, 1.0)
        u = apart / np.where(reach > 0, reach, 1.0)
        w = np.clip(1 - np.abs(u) ** 3, 0, None) ** 3
        powers = [w]
        for _ in range(4):
            powers.append(powers[-1] * u)
        s = np.stack([p.sum(axis=1) for p in powers], axis=1)
        t = np.stack([(p * y).sum(axis=1) for p in powers[:3]], axis=1)
        a = s[:, [[0, 1, 2], [1, 2, 3], [2, 3, 4]]]
        good = (np.count_nonzero(w > 0, axis=1) >= 3) & (np.linalg.cond(a) < 1e12)
        fit = np.empty(len(a))
        if good.any():
            fit[good] = np.linalg.solve(a[good], t[good][:, :, None])[:, 0, 0]
        for j in np.flatnonzero(~good):
            root = np.sqrt(w[j])
            fit[j] = np.linalg.lstsq(np.stack([root, root * u[j], root * u[j] ** 2], axis=1), root * y, rcond=None)[0][0]
        out[i : i + rows] = fit
    return out


def local_shape(df: DataFrame, keys: list[str], order: str, value: str, span: float = 1.0, least: int = 10) -> DataFrame:
    """``keys, order, value, shape, corrected``: the trend of a value along each key, over its mean, and the values divided
    by it and scaled to keep their total.

    Rows with a null value get a shape but no weight in it; keys of fewer than ``least`` values keep a shape
    of 1. A key is one chromosome of one cell, whose windows its length bounds; keys are fitted side by side.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*keys, order]) + f", {value} double, shape double, corrected double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        y = part[value].to_numpy(dtype=float, na_value=np.nan)
        x = part[order].to_numpy(dtype=float)
        used = ~np.isnan(y)
        shape = np.ones(len(y))
        if used.sum() >= least and y[used].mean() != 0:
            shape = local_fit(x[used], y[used], x, span) / y[used].mean()
        with np.errstate(divide="ignore", invalid="ignore"):
            corrected = np.where(shape > 0, y / shape, np.nan)
        total = np.nansum(corrected)
        corrected = corrected * (y[used].sum() / total) if total else corrected
        return part[[*keys, order]].assign(**{value: pd.array(y, dtype="Float64"), "shape": shape, "corrected": pd.array(corrected, dtype="Float64")})

    rows = df.select(*keys, order, F.col(value).cast("double").alias(value)).where(F.col(order).isNotNull())
    out = rows.groupBy(*keys).applyInPandas(fit, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in (value, "corrected")})
