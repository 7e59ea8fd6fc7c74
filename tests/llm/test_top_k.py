import math
import random

import pytest
from pyspark.sql import functions as F

from linewright.llm import top_k

SCHEMA = "vec_id long, embedding array<float>, rank string"


def expected(rows, every, k):
    usable = []
    for vec_id, v, _ in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((vec_id, [math.floor(256 * x) for x in v]))
    queries = {}
    for vec_id, v in usable:
        if vec_id % every == 0:
            queries[vec_id] = min(queries.get(vec_id, v), v)
    out = set()
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in usable if c != q and len(w) == len(v))
        out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])}
    return out


def found(spark, rows, every, k):
    out = top_k.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, k)
    return {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()}


@pytest.mark.parametrize("page, leaves", [(8, 4096), (16, 3), (256, 4096)])
def test_equals_brute_force(spark, monkeypatch, page, leaves):
    monkeypatch.setattr(top_k, "PAGE", page)
    monkeypatch.setattr(top_k, "MAX_LEAVES", leaves)
    draw = random.Random(page)
    centers = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + draw.gauss(0, 0.1) for c in draw.choice(centers)], "x") for i in range(400)]
    rows += [(1000 + i, [0.5] * 6, "x") for i in range(120)]  # one common vector
    rows += [(2000 + i, [0.0] * 6, "x") for i in range(5)] + [(3000, [-40.0] * 6, "x")]
    assert found(spark, rows, 10, 5) == expected(rows, 10, 5)


def test_unusable_vectors_widths_and_few(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [], "x")]
    rows += [(None, [1.0, 1.0], "x"), (6, [-0.001, 0.001], "x"), (10, [1.0, 2.0, 3.0], "x"), (20, [3.0, 1.0], "x")]
    assert found(spark, rows, 10, 5) == expected(rows, 10, 5)


def test_the_tree_leaves_nodes_out(spark, monkeypatch):
    monkeypatch.setattr(top_k, "PAGE", 8)
    draw = random.Random(1)
    rows = [[100 * c + draw.randint(0, 5), 1] for c in range(40) for _ in range(8)]
    import numpy as np

    data = np.array(rows)
    top = float((data**2).sum(axis=1).max())
    nodes = top_k.Nodes.of(data[::8], top)
    distance = nodes.lifted(data, nodes.objects)
    leaf = distance.argmin(axis=1)
    own = distance[np.arange(len(data)), leaf]
    ids = np.unique(leaf)
    nodes.cover(ids, np.array([own[leaf == i].max() for i in ids]), np.array([own[leaf == i].min() for i in ids]), np.bincount(leaf)[ids])
    assert len(nodes.walk(np.array([1000, 0]), 2000.0)) < len(ids)
    assert len(nodes.walk(np.array([1000, 0]), np.inf)) == len(ids)


def test_repeats_and_none(spark):
    rows = [(0, [1.0], "x"), (0, [1.0], "x"), (1, [2.0], "x"), (1, [2.0], "x")]
    out = top_k.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, out)) == [(0, 1, 1, 131072), (0, 2, 1, 131072)]
    none = spark.createDataFrame([], SCHEMA)
    assert top_k.top_k(none, F.col("vec_id") % 50 == 0).collect() == []
    one = spark.createDataFrame(rows[:1], SCHEMA)
    assert top_k.top_k(one, F.col("vec_id") % 50 == 0).collect() == []
