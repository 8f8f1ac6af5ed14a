"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The pivots of A - sI = L D Lᵀ have as many positive ones as A has eigenvalues above s (inertia), so
counts at chosen shifts isolate each leading eigenvalue in an interval of its own. Rayleigh quotient
iteration then converges cubically inside it, and counts on both sides of what it found certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bound of growth in pivoting by Bunch and Kaufman.
ALPHA = (1 + 17 ** 0.5) / 8
EPS = float(np.finfo(float).eps)
ROUNDS = 60


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of `a` above `shift`: the positive pivots of a symmetric factorisation with pivots of one or two rows."""
    a = a - shift * np.eye(len(a))
    positive, k, n = 0, 0, len(a)
    while k < n:
        column = np.abs(a[k + 1:, k])
        largest = column.max(initial=0.0)
        if largest == 0.0:
            positive += a[k, k] > 0
            k += 1
            continue
        r = k + 1 + int(column.argmax())
        pair = False
        if abs(a[k, k]) < ALPHA * largest:
            row = np.abs(a[k:, r])
            row[r - k] = 0.0
            if abs(a[k, k]) * row.max() < ALPHA * largest ** 2:
                pair = abs(a[r, r]) < ALPHA * row.max()
                _swap(a, k + 1 if pair else k, r)
        if pair:
            # A pivot of two rows is taken where its determinant is negative: one eigenvalue of each sign.
            positive += 1
            block, below = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            a[k + 2:, k + 2:] -= below @ np.linalg.solve(block, below.T)
            k += 2
        else:
            positive += a[k, k] > 0
            below = a[k + 1:, k]
            a[k + 1:, k + 1:] -= np.outer(below, below / a[k, k])
            k += 1
    return int(positive)


def _swap(a: np.ndarray, i: int, j: int) -> None:
    a[[i, j]] = a[[j, i]]
    a[:, [i, j]] = a[:, [j, i]]


class Slices:
    """Counts at the shifts seen so far."""

    def __init__(self, a: np.ndarray):
        self.a = a
        self.scale = max(float(np.abs(a).sum(axis=1).max(initial=0.0)), np.finfo(float).tiny)
        self.counts = {-2 * self.scale: len(a), 2 * self.scale: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.a, shift)
        return self.counts[shift]

    def interval(self, number: int) -> tuple[float, float]:
        """The narrowest interval known to hold the eigenvalue of this number."""
        return (max(s for s, c in self.counts.items() if c >= number), min(s for s, c in self.counts.items() if c < number))

    def isolate(self, number: int, width: float) -> tuple[float, float, bool]:
        """Halve until the interval holds no other eigenvalue, or is narrower than `width`."""
        while True:
            low, high = self.interval(number)
            alone = self.above(low) == number and self.above(high) == number - 1
            if alone or high - low <= width:
                return low, high, alone
            self.above((low + high) / 2)


def _solve(a: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, EPS * scale, 8 * EPS * scale):
        try:
            y = np.linalg.solve(a - (shift + nudge) * np.eye(len(a)), x)
        except np.linalg.LinAlgError:
            continue
        norm = np.linalg.norm(y)
        if np.isfinite(norm) and norm > 0:
            return y / norm
    raise ArithmeticError("no shift near an eigenvalue can be solved for")


def leading(a: np.ndarray, most: int) -> Iterator[tuple[float, np.ndarray]]:
    """The `most` largest eigenpairs in falling order; eigenvalues that are zero to rounding are left out."""
    slices = Slices(a)
    width = len(a) * EPS * slices.scale
    found = np.zeros((0, len(a)))
    draw = np.random.default_rng(0)
    for number in range(1, min(most, slices.above(width)) + 1):
        for _ in range(ROUNDS):
            low, high, alone = slices.isolate(number, width)
            value, x = _iterate(a, low, high, alone, _apart(draw.standard_normal(len(a)), found), found, slices.scale)
            if slices.above(value + 8 * width) < number <= slices.above(value - 8 * width):
                break
            # It went to another eigenvalue: start from half of the interval.
            slices.above((low + high) / 2)
        else:
            raise ArithmeticError(f"the counts do not confirm eigenvalue {number}")
        found = np.vstack([found, x])
        yield value, x


def _iterate(a: np.ndarray, low: float, high: float, alone: bool, x: np.ndarray, found: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """Inverse iteration whose shift is the Rayleigh quotient, or the middle while that lies outside the interval."""
    middle = shift = (low + high) / 2
    best = (np.inf, middle, x)
    for _ in range(ROUNDS):
        x = _apart(_solve(a, shift, x, scale), found)
        value = float(x @ a @ x)
        residual = float(np.linalg.norm(a @ x - value * x))
        if residual >= best[0] / 2 and best[0] <= len(a) * EPS * scale:
            break
        best = min(best, (residual, value, x), key=lambda b: b[0])
        shift = value if alone and low < value < high else middle
    return best[1:]


def _apart(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """x without its share of the vectors found, of unit length; twice, against cancellation."""
    for _ in range(2):
        x = x - found.T @ (found @ x)
        x = x / np.linalg.norm(x)
    return x
