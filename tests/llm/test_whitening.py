import math
import random
from fractions import Fraction

import numpy as np
import pytest

from linewright.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, n string, v int, component string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def exact(rows):
    """``(n, S, C)`` of the distinct vectors of whole numbers."""
    found = sorted({tuple(math.floor(256 * x) for x in v) for _, v in rows})
    sums = [sum(c) for c in zip(*found)]
    n, d = len(found), len(sums)
    return n, sums, [[n * sum(x[i] * x[j] for x in found) - sums[i] * sums[j] for j in range(d)] for i in range(d)]


def polynomial(c):
    """By traces of powers, in fractions."""
    d = len(c)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(c[i][l] * m[l][j] for l in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(c[i][l] * m[l][i] for i in range(d) for l in range(d)) / k)
    return [int(x) for x in reversed(out)]


def check(spark, rows, components=4):
    usable = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    n, sums, c = exact(usable)
    variances, q = np.linalg.eigh(np.array([[x / n**2 for x in row] for row in c], float))
    variances, q = variances[::-1], q[:, ::-1]
    k = min(components, int((variances > 1e-9 * variances[0]).sum()))
    out = W.whiten(table(spark, rows), components).collect()
    assert len(out) == k * len(usable) and {r["n"] for r in out} == {n}
    at = {}
    for r in out:
        at.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert max(abs(r["identity_error"]) for r in out) < 1e-9
    for j in range(k):
        assert at[usable[0][0], j + 1][0]["explained"] == pytest.approx(variances[j] / variances.sum(), rel=1e-9)
    for vec_id, v in usable:
        x = [math.floor(256 * e) for e in v]
        gap = [n * a - s for a, s in zip(x, sums)]
        assert sum(g * g for g in gap) in [r["deviation"] for r in at[vec_id, 1]]
        for j in range(k):
            alone = all(abs(variances[j] - o) > 1e-6 * variances[0] for i, o in enumerate(variances) if i != j)
            if alone:
                want = sum(g / n * w for g, w in zip(gap, q[:, j])) / math.sqrt(variances[j])
                assert any(abs(r["whitened"]) == pytest.approx(abs(want), abs=1e-7) for r in at[vec_id, j + 1])
    return out


def test_equals_dense_eigenvectors(spark):
    draw = random.Random(1)
    mix = [[draw.gauss(0, 1) for _ in range(7)] for _ in range(7)]
    rows = [(i, [sum(a * draw.gauss(0, 0.3) for a in m) for m in mix]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 7) for i in range(100)] + [(5, [1.0] * 7), (5, [2.0] * 7), (None, [0.25] * 7)]  # a common vector counts once
    rows += [(2000, None), (2001, []), (2002, [1.0] * 6 + [None]), (2003, [float("nan")] * 7), (2004, [float("inf")] * 7)]
    check(spark, rows)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.5])], [(1, [1.0]), (2, [-3.0]), (3, [0.25])], [(i, [float(i % 2), 1.0]) for i in range(9)]])
def test_fewer_components_than_asked(spark, rows):
    check(spark, rows)


def test_equal_variances(spark):
    rows = [(i, [4.0 * (i == a) - 4.0 * (i == a + 3) for a in range(3)]) for i in range(6)]
    out = check(spark, rows)
    assert {round(r["explained"], 12) for r in out} == {round(1 / 3, 12)}


def test_large_numbers_stay_exact(spark):
    draw = random.Random(2)
    rows = [(i, [draw.uniform(-1, 1) * 2.0**45, draw.uniform(-1, 1), float(i)]) for i in range(50)]
    usable = [(i, v) for i, v in rows]
    n, sums, c = exact(usable)
    out = W.whiten(table(spark, rows)).collect()
    assert {r["component"] for r in out} == {1, 2, 3}
    deviations = {r["vec_id"]: r["deviation"] for r in out}
    for i, v in usable:
        assert deviations[i] == sum((n * math.floor(256 * x) - s) ** 2 for x, s in zip(v, sums))
    assert out[0]["identity_error"] < 1e-6


def test_nothing_to_whiten(spark):
    assert W.whiten(table(spark, [])).collect() == []
    assert W.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert W.whiten(table(spark, [(1, None)])).collect() == []


def test_widths_are_fitted_apart(spark):
    rows = [(i, [float(i), 1.0]) for i in range(3)] + [(10 + i, [float(i), 1.0, float(i * i)]) for i in range(4)]
    out = W.whiten(table(spark, rows)).collect()
    assert {(r["vec_id"] >= 10, r["n"]) for r in out} == {(False, 3), (True, 4)}


def test_polynomial_is_exact(spark):
    draw = random.Random(4)
    for d in (1, 2, 5, 9):
        x = [[draw.randint(-10**6, 10**6) for _ in range(d)] for _ in range(max(2, d - 1))]
        c = [[sum(r[i] * r[j] for r in x) for j in range(d)] for i in range(d)]
        assert W.characteristic_polynomial(spark, c) == polynomial(c)


def product_of(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
    return out


def test_roots_are_isolated():
    roots = [10**12 + 1, 10**12, 10**12, 7, 3, 0, 0]
    found = W.largest_roots(product_of(roots), 5)
    assert [(round(r), m) for r, m in found] == [(10**12 + 1, 1), (10**12, 2), (7, 1), (3, 1)]
    assert all(abs(r - round(r)) < Fraction(1, 2**80) for r, _ in found)
    assert W.largest_roots(product_of([0, 0]), 3) == []


def test_null_space_of_a_multiple_root():
    c = [[2, 0, 0, 0], [0, 5, 0, 0], [0, 0, 5, 0], [0, 0, 0, 1]]
    one, two = W.null_space(c, Fraction(5), 2)
    for v in (one, two):
        assert abs(float(v[0])) < 1e-20 and abs(float(v[3])) < 1e-20
        assert float(sum(x * x for x in v)) == pytest.approx(1, abs=1e-15)
    assert abs(float(sum(x * y for x, y in zip(one, two)))) < 1e-20
