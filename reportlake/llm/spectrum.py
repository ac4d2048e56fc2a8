"""Leading eigenpairs of a symmetric matrix by spectrum slicing: inertia counts of LDL' factorings isolate each eigenvalue,
Rayleigh quotient iteration refines it, and counts on both sides of it certify its number. The matrix is small (as wide as
a vector), so this is driver-side arithmetic; what it comes from is summed by Spark."""

from __future__ import annotations

import numpy as np

#: Bound of element growth for symmetric pivoting with blocks of one and two.
PIVOT = (1 + 17**0.5) / 8


def count_above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of v above the shift: positive ones in D of the factoring PLDL'P' of v - shift, which has as many (law of
    inertia). Pivots are the largest diagonal entry, or a block of two around the largest entry beside the diagonal, one of
    whose eigenvalues is positive and one negative."""
    a = v - shift * np.eye(len(v))
    above = 0
    while len(a):
        d = np.abs(np.diagonal(a))
        k = int(d.argmax())
        off = np.abs(a)
        np.fill_diagonal(off, 0.0)
        i, j = divmod(int(off.argmax()), len(a))
        if d[k] == 0 and off[i, j] == 0:
            return above
        block = [k] if d[k] >= PIVOT * off[i, j] else [i, j]
        above += 1 if len(block) == 2 else int(a[k, k] > 0)
        rest = np.delete(np.arange(len(a)), block)
        side = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(block, block)], side.T)
        a = (a + a.T) / 2
    return above


def _solve(v: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    """(v - shift) \\ x; an exactly singular matrix is moved by a rounding."""
    for move in (0.0, 1e-15 * scale, 1e-13 * scale):
        try:
            y = np.linalg.solve(v - (shift + move) * np.eye(len(v)), x)
            if np.isfinite(y).all():
                return y
        except np.linalg.LinAlgError:
            pass
    return x


def _rayleigh(v: np.ndarray, lo: float, hi: float, against: np.ndarray, scale: float) -> tuple[float, np.ndarray] | None:
    """The eigenpair in (lo, hi), which holds one eigenvalue, or None if the iteration leaves the interval."""
    x = np.cos(1.0 + np.arange(len(v)) * 1.7)  # any fixed start that is not special
    shift = (lo + hi) / 2
    for step in range(40):
        x = x - against @ (against.T @ x)
        x = _solve(v, shift, x / np.linalg.norm(x), scale)
        x = x - against @ (against.T @ x)
        x = x / np.linalg.norm(x)
        rho = float(x @ v @ x)
        if np.linalg.norm(v @ x - rho * x) <= 4e-16 * len(v) ** 0.5 * scale:
            return (rho, x) if lo <= rho <= hi else None
        if step >= 2:  # the first steps, at the middle of the interval, turn x towards the pair that is in it
            if not lo <= rho <= hi:
                return None
            shift = rho
    return (rho, x) if lo <= rho <= hi else None


def _cluster(v: np.ndarray, at: float, size: int, against: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Ritz pairs of the space of `size` eigenvalues that no shift parts, by inverse iteration on a block."""
    block = np.cos(np.outer(np.arange(1, len(v) + 1), np.arange(1, size + 1)) * 1.3)
    for _ in range(6):
        block = block - against @ (against.T @ block)
        block = _solve(v, at, np.linalg.qr(block)[0], scale)
    block = np.linalg.qr(block - against @ (against.T @ block))[0]
    small = block.T @ v @ block
    e, u = np.linalg.eigh((small + small.T) / 2)
    return e[::-1], block @ u[:, ::-1]


def leading_eigenpairs(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues (fewer if v is smaller or the rest is zero to rounding), falling, and unit vectors as
    columns. Equal eigenvalues take some orthonormal basis of their space. The largest entry of a vector is positive."""
    d = len(v)
    scale = float(np.abs(v).sum(axis=1).max()) if d else 0.0
    values, vectors = np.zeros(0), np.zeros((d, 0))
    if not scale:
        return values, vectors
    v = (v + v.T) / 2
    zero = d * 1e-14 * scale
    least, apart = zero, 1e-13 * scale
    known: dict[float, int] = {}

    def above(s: float) -> int:
        if s not in known:
            known[s] = count_above(v, s)
        return known[s]

    most = min(most, above(least))
    while len(values) < most:
        k = len(values)
        # isolate: the k+1-th eigenvalue in (lo, hi], with none further down inside if a shift can part them
        hi = min([s for s, n in known.items() if n <= k], default=scale * (1 + 1e-12))
        lo = max(s for s, n in known.items() if n > k)
        pair = None
        while pair is None and hi - lo > apart:
            if above(lo) == k + 1:
                pair = _rayleigh(v, lo, hi, vectors, scale)
                if pair is not None:
                    slack = 64 * np.finfo(float).eps * scale
                    if not (above(pair[0] - slack) >= k + 1 and above(pair[0] + slack) <= k):
                        pair = None
            if pair is None:
                middle = (lo + hi) / 2
                lo, hi = (middle, hi) if above(middle) > k else (lo, middle)
        if pair is not None:
            e, u = np.array([pair[0]]), pair[1][:, None]
        else:
            e, u = _cluster(v, (lo + hi) / 2, max(1, above(lo) - k), vectors, scale)
        values, vectors = np.concatenate([values, e]), np.concatenate([vectors, u], axis=1)
    values, vectors = values[:most], vectors[:, :most]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)])
    return values, vectors * sign
