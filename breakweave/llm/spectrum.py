"""Leading eigenpairs of a small symmetric matrix by slicing its spectrum.

The inertia of ``A - s`` counts the eigenvalues above ``s``, whatever ``A``'s order of rows. Bisection on
these counts isolates one eigenvalue after the other; Rayleigh quotient iteration then converges
cubically inside the slice, and counts on both sides of the result certify its number.
"""

from __future__ import annotations

import numpy as np

#: Bunch and Kaufman's constant, which bounds the growth of entries: (1 + sqrt(17)) / 8.
_PIVOT = (1 + 17**0.5) / 8


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of symmetric ``a`` above ``shift``: positive ones of D in P(A - shift)P' = LDL'.

    Pivots have one or two rows, the larger by Bunch and Kaufman's rule; a zero pivot counts as below.
    """
    w = a - shift * np.eye(len(a))
    above, k, n = 0, 0, len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            w[[i, j]] = w[[j, i]]
            w[:, [i, j]] = w[:, [j, i]]

    while k < n:
        size = 1
        column = np.abs(w[k + 1 :, k])
        if column.size and (most := column.max()) > 0 and abs(w[k, k]) < _PIVOT * most:
            r = k + 1 + int(column.argmax())
            row = np.abs(w[r, k:])
            row[r - k] = 0
            widest = row.max()
            if abs(w[k, k]) * widest >= _PIVOT * most**2:
                pass
            elif abs(w[r, r]) >= _PIVOT * widest:
                swap(k, r)
            else:
                swap(k + 1, r)
                size = 2
        rest = slice(k + size, n)
        if size == 2:
            # a two-row pivot of this rule is indefinite: one eigenvalue on each side
            above += 1
            block = w[k : k + 2, k : k + 2]
            w[rest, rest] -= w[rest, k : k + 2] @ np.linalg.solve(block, w[k : k + 2, rest])
        elif w[k, k] != 0:
            above += w[k, k] > 0
            w[rest, rest] -= np.outer(w[rest, k], w[k, rest] / w[k, k])
        k += size
    return int(above)


def leading_eigenpairs(a: np.ndarray, most: int, least: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above ``least`` times the largest, falling, and unit vectors as columns.

    Values within rounding of zero are left out. The largest component of each vector is positive. Eigenvalues that rounding cannot tell
    apart get orthogonal vectors of their common space. Raises ArithmeticError where a count contradicts
    the number of an eigenvalue, which rounding alone cannot cause.
    """
    d = len(a)
    top = float(np.abs(a).sum(axis=1).max()) if d else 0.0  # Gershgorin's bound
    if top == 0:
        return np.empty(0), np.empty((d, 0))
    fuzz = 32 * d * np.finfo(float).eps * top
    counts: dict[float, int] = {-top - fuzz: d, top + fuzz: 0}

    def count(s: float) -> int:
        if s not in counts:
            counts[s] = count_above(a, s)
        return counts[s]

    values: list[float] = []
    vectors: list[np.ndarray] = []
    rng = np.random.default_rng(0)
    while len(values) < min(most, d):
        number = len(values) + 1
        # the slice (lo, hi] that holds eigenvalue ``number``: at least so many above lo, fewer above hi
        lo = max(s for s, c in counts.items() if c >= number)
        hi = min(s for s, c in counts.items() if c < number)
        while hi - lo > fuzz and count(lo) - count(hi) > 1:
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if count(middle) >= number else (lo, middle)
        least_value = max(4 * fuzz, least * values[0] if values else 0.0)
        found = None
        while found is None and hi > least_value:
            near = [v for x, v in zip(values, vectors) if x - hi <= 1e-3 * top]
            found = _rayleigh(a, lo, hi, near, rng, fuzz)
            if found and not count(found[0] - fuzz) >= number > count(found[0] + fuzz):
                found = None
            if found is None:  # it left the slice, or has another number: halve the slice
                if hi - lo <= fuzz / 4:
                    raise ArithmeticError(f"eigenvalue {number} is not certified between {lo} and {hi}")
                middle = (lo + hi) / 2
                lo, hi = (middle, hi) if count(middle) >= number else (lo, middle)
        if found is None or found[0] <= least_value:
            break  # what is left is rounding
        value, vector = found
        values.append(value)
        vectors.append(vector * (1.0 if vector[np.argmax(np.abs(vector))] > 0 else -1.0))
    return np.array(values), np.array(vectors).reshape(len(vectors), d).T


def _rayleigh(a: np.ndarray, lo: float, hi: float, others: list[np.ndarray], rng: np.random.Generator, fuzz: float) -> tuple[float, np.ndarray] | None:
    """The eigenpair of the slice, orthogonal to vectors found close by; None where the iteration leaves it."""
    def apart(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            for u in others:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    def solved(v: np.ndarray, shift: float) -> np.ndarray:
        try:
            return np.linalg.solve(a - shift * np.eye(len(a)), v)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            return np.linalg.solve(a - (shift + fuzz / 64) * np.eye(len(a)), v)

    v, shift = rng.standard_normal(len(a)), (lo + hi) / 2
    for step in range(40):
        v = apart(v)
        if step >= 2:
            shift = float(v @ a @ v)
            if not lo - fuzz <= shift <= hi + fuzz:
                return None
            if np.linalg.norm(a @ v - shift * v) <= fuzz / 8:
                v = apart(solved(v, shift))  # one step more reaches the precision of doubles
                return float(v @ a @ v), v
        v = solved(v, shift)
    return None
