import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, cell string, place int, low string"


def expected(rows, every):
    usable = []
    for vec_id, v, label in rows:
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    anchors = {}
    for vec_id, label, v in usable:
        if vec_id % every == 0:
            anchors[vec_id] = min(anchors.get(vec_id, (label, v)), (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), c, other) for c, other, w in usable if c != a and len(w) == len(v))
        for score, positive, other in [s for s in scored if s[2] == label][:5]:
            inside = [(-s, c) for s, c, l in scored if l != label and -30 * score <= -100 * s <= -90 * score]
            out += [(a, positive, i + 1, c, -score, s) for i, (s, c) in enumerate(inside[:10])]
    return sorted(out)


def found(spark, rows, every):
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in H.hard_negatives(table, F.col("vec_id") % every == 0).collect())


@pytest.mark.parametrize("section, block", [(4096, 512), (50, 3)])
def test_equals_brute_force(spark, monkeypatch, section, block):
    monkeypatch.setattr(H, "SECTION", section)
    monkeypatch.setattr(H, "BLOCK", block)
    draw = random.Random(section)
    centers = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, 0.5) for c in draw.choice(centers)], draw.randrange(4)) for i in range(500)]
    rows += [(1000 + i, [0.5] * 6, i % 2) for i in range(150)]  # one common vector
    rows += [(2000 + i, [0.0] * 6, 1) for i in range(5)] + [(3000, [-40.0] * 6, 2), (3010, [0.25] * 6, 77)]
    rows += [(20, [0.1] * 6, 0), (20, [0.1] * 6, 0), (30, [0.3] * 6, 3), (30, [0.2] * 6, 2)]
    assert found(spark, rows, 10) == expected(rows, 10)


def test_unusable_rows_widths_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [], 1), (6, [1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0], 1), (7, [1.0, 1.5], 1), (8, [0.5, 0.5], 2), (9, [0.3, 0.5], 3), (10, [1.0, 2.0, 3.0], 1), (11, [1.0, 2.0, 3.0], 1), (12, [1.0, 1.0, 1.0], 0)]
    assert found(spark, rows, 10) == expected(rows, 10) != []
    assert found(spark, [], 10) == []
    assert found(spark, rows[:1], 10) == []


def test_bounds_hold_and_leave_rows_out():
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(8, 12))
    rows = np.floor(256 * (centers[draw.integers(8, size=3000)] + 0.1 * draw.normal(size=(3000, 12)))).astype(np.int64)
    rows[:3] = [[0] * 12, [1] + [0] * 11, [30_000] * 12]
    references = H.directions(rows)
    angles, norms = H.angles_to(rows, references), np.linalg.norm(rows.astype(float), axis=1)
    left = 0
    for i in range(0, 3000, 100):
        low, high = H.score_bounds(angles[i], norms[i], angles.T, norms)
        scores = rows @ rows[i]
        assert (low <= scores).all() and (scores <= high).all()
        left += (high < 0.5 * norms[i] * norms).sum()
    assert left > 30 * 1000  # a third of all rows cannot reach half the largest product


def test_large_numbers_stay_exact(spark):
    rows = [(i, [float(2**20 + i), 1.0 - i], i % 3) for i in range(40)]
    assert found(spark, rows, 10) == expected(rows, 10)
