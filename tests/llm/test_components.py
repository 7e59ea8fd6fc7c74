import random

from linewright.llm.components import connected_components


def expected(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {x: root(x) for x in parent}


def found(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    return {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}


def test_random_graphs(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(120), draw.randrange(120)) for _ in range(90)]
    assert found(spark, edges) == expected(edges)


def test_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 60)]
    assert found(spark, edges) == expected(edges)


def test_nulls_loops_repeats_and_none(spark):
    edges = [(1, None), (None, 2), (3, 3), (5, 4), (4, 5), (5, 4)]
    assert found(spark, edges) == {4: 4, 5: 4}
    assert found(spark, []) == {}


def test_names_as_nodes(spark):
    assert found(spark, [("b", "a"), ("c", "b")], "string") == {"a": "a", "b": "a", "c": "a"}
