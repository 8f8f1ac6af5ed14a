"""Whitening against numpy on whole tables, spectrum slicing against its eigenvalues, odd tables."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tabuloom.llm import whitening
from tabuloom.llm.spectrum import count_above, leading

DRAW = np.random.default_rng(1)
BASIS = np.linalg.qr(DRAW.standard_normal((40, 40)))[0]


def spread(values):
    values = np.concatenate([values, np.zeros(40 - len(values))])
    return BASIS @ np.diag(values) @ BASIS.T


CASES = {
    "random": (lambda b: b.T @ b)(DRAW.standard_normal((90, 40))), "low rank": spread([9, 5, 4, 1, 1e-6]), "equal": np.eye(12), "none": np.zeros((5, 5)),
    "repeated": spread([5, 5, 5, 4, 4, 4 - 1e-12, 3]), "close": spread(np.concatenate([[5, 5 + 1e-13, 4], np.linspace(1, 1 + 1e-9, 30)])),
    "one": np.array([[3.0]]), "off the diagonal": np.array([[0.0, 1], [1, 0]]), "scales": np.diag([1e12, 1e12, 1, 1e-3, 0])}


@pytest.mark.parametrize("name", CASES)
def test_slicing(name):
    a = (CASES[name] + CASES[name].T) / 2
    want = np.linalg.eigvalsh(a)[::-1]
    got = list(leading(a, 16))
    tiny = len(a) * np.finfo(float).eps * max(np.abs(a).sum(axis=1).max(), 1e-300)
    assert len(got) == min(16, int((want > tiny).sum()))
    for (value, vector), e in zip(got, want):
        assert abs(value - e) <= 4 * tiny and np.linalg.norm(a @ vector - value * vector) <= 4 * tiny
    stack = np.array([v for _, v in got]).reshape(-1, len(a))
    assert np.abs(stack @ stack.T - np.eye(len(got))).max(initial=0) < 1e-12
    for shift in DRAW.uniform(-1, want[0] + 1, 20):
        assert count_above(a, shift) == int((want > shift).sum())


def plain(rows, components=16):
    """By numpy's own eigenvalues, over vectors of the length that most distinct ones have."""
    usable = [(k, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = {}
    for x in {tuple(x) for _, x in usable}:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    size = min(sizes, key=lambda s: (-sizes[s], s))
    distinct = [list(x) for x in {tuple(x) for _, x in usable if len(x) == size}]
    n, sums = len(distinct), [sum(column) for column in zip(*distinct)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    kept = [(k, x, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for k, x in usable if len(x) == size]
    return n, sums, values[::-1], vectors.T[::-1], kept


def table(n=300, d=20):
    draw = np.random.default_rng(4)
    scales = np.linspace(3, 0.2, d)
    rows = [(i, [float(np.float32(c)) for c in draw.standard_normal(d) * scales]) for i in range(n)]
    rows += [(1000 + i, rows[i][1]) for i in range(50)] + [(None, rows[3][1]), (7, rows[9][1]), (7, rows[9][1])]
    odd = [None, [], [None] * d, [0.1] * (d - 1) + [float("nan")], [float("inf")] * d, [0.5] * (d + 1), [1e300] * d]
    return rows + [(2000 + i, v) for i, v in enumerate(odd)]


SCHEMA = "vec_id long, embedding array<double>, x string, component int, packed int"


def test_against_numpy(frame):
    rows = table()
    vectors = frame(SCHEMA, [(*r, "x", 1, 2) for r in rows])
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    n, sums, values, axes, kept = plain([r for r in rows if r[0] != 2006])
    assert len(got) == 16 * len(kept) and {r.n for r in got} == {n}
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = {}
    for key, x, deviation in kept:
        centred = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)])
        for c in range(16):
            want = centred @ axes[c] / math.sqrt(values[c])
            mine = by[key, c + 1]
            assert {int(r.deviation) for r in mine} >= {deviation}
            assert all(abs(r.explained - values[c] / values.sum()) < 1e-9 for r in mine)
            sign = signs.setdefault(c, 1 if min(abs(r.whitened - want) for r in mine) < 1e-6 else -1)
            assert min(abs(r.whitened - sign * want) for r in mine) < 1e-6
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("rows, expected", [
    ([], 0), ([(1, None), (2, [])], 0), ([(1, [0.5, 0.25])], 2), ([(1, [0.5]), (2, [0.5])], 2), ([(1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [0.0, 4.0])], 6)])
def test_little_or_no_variance(frame, rows, expected):
    vectors = frame("vec_id long, embedding array<float>", rows)
    got = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    assert len(got) == expected
    spread_of = len({tuple(v) for _, v in rows if v}) > 1
    for r in got:
        if spread_of and r.component == 1:
            assert abs(r.explained - 1) < 1e-12 and r.whitened is not None and r.identity_error < 1e-9
        else:
            assert r.whitened is None and r.explained == (0 if spread_of else None)


def test_large_values_stay_exact(frame):
    draw = random.Random(2)
    rows = [(str(i), [draw.uniform(-1, 1) * 10.0 ** draw.randint(0, 15) for _ in range(4)]) for i in range(60)]
    vectors = frame("vec_id string, embedding array<double>", rows)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(vectors, whitening.fit(vectors)).collect()}
    assert got == {k: deviation for k, _, deviation in plain(rows)[4]}
