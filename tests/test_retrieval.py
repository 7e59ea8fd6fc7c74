"""Retrieval against brute force on small random catalogs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewright.functions import similarity as S
from linewright.operators import retrieval as R
from linewright.operators import vectors
from linewright.operators.scans import running_sum
from linewright.options import MatchOptions
from linewright.operators import rerank as RR

WORDS = "red blue green pump pipe bolt steel насос труба кабель 25 40 3x2.5 m12 плита".split()


def grams(text):
    out = set()
    for w in re.findall(r"[^\W_]+", text.lower()):
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(w) + 1)}
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(11)
    names = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    products = []
    for i in range(300):
        name = names[0] if i % 3 == 0 else rng.choice(names)  # one name on a third of all products
        products.append((f"p{i:03d}", name, f"{name} | {rng.choice(['acme', 'bolts ltd', 'насосы'])}", i % 17 != 0))
    queries = sorted({" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(40)})
    catalog = spark.createDataFrame(products, "product_id string, normalized_name string, search_document string, is_active boolean")
    return products, queries, catalog, spark.createDataFrame([(q, q) for q in queries], "query_id string, text string")


def expected(spark, world, name_t, doc_t, cap):
    products, queries, catalog, _ = world
    live = [p for p in products if p[3]]
    tokens = lambda t: re.findall(r"\d+\.\d+|\w+", t.lower())
    pairs = [(q, list(dict.fromkeys(tokens(q))), p[0], tokens(p[2])) for q in queries for p in live]
    df = spark.createDataFrame(pairs, "q string, t array<string>, p string, d array<string>")
    ranks = {(r.q, r.p): r.r for r in df.select("q", "p", S.text_rank(F.col("t"), S.lexeme_positions(F.col("d"))).alias("r")).collect()}
    out = {}
    for q in queries:
        rows = []
        for pid, name, doc, _ in live:
            ns, ds = jaccard(grams(q), grams(name)), jaccard(grams(q), grams(doc))
            if set(tokens(q)) <= set(tokens(doc)) or ns > name_t or ds > doc_t:
                rows.append((-round(max(ranks[q, pid], ns * 0.8, ds * 0.5), 9), pid))
        for rank, (s, pid) in enumerate(sorted(rows)[:cap], 1):
            out[q, pid] = (rank, pytest.approx(-s, abs=2e-9))
    return out


@pytest.mark.parametrize("name_t, doc_t, cap, floors", [(0.15, 0.10, 20, (0.4, 0.2)), (0.15, 0.10, 200, ()), (0.08, 0.05, 10, (0.35,))])
def test_lexical_matches_equal_brute_force(spark, world, name_t, doc_t, cap, floors):
    index = R.build_index(world[2], 200)
    found = R.lexical_matches(world[3], index, name_t, doc_t, cap, floors=floors).collect()
    got = {(r.query_id, r.product_id): (r.lex_rank, r.lex_score) for r in found}
    assert got == expected(spark, world, name_t, doc_t, cap)


def test_hot_postings_are_split(spark, world, monkeypatch):
    monkeypatch.setattr(R, "HOT_ROWS", 5)
    test_lexical_matches_equal_brute_force(spark, world, 0.15, 0.10, 20, (0.4,))


def test_similar_texts(spark, world):
    products, queries, catalog, frame = world
    left = frame.select(F.col("query_id").alias("id"), "text")
    right = catalog.select(F.col("product_id").alias("id"), F.col("search_document").alias("text"))
    got = {(r.l_id, r.r_id) for r in R.similar_texts(left, right, 0.3).collect()}
    assert got == {(q, p[0]) for q in queries for p in products if jaccard(grams(q), grams(p[2])) > 0.3}


def test_whole_catalog_and_relaxed_search(spark, world):
    products, queries, catalog, frame = world
    none = F.lit(None).cast("string")
    extra = {c: none for c in ["name", "article", "code", "brand", "normalized_brand", "manufacturer_code", "category_id", "category_path", "unit", "packaging"]}
    full = catalog.withColumns(extra).withColumn("name", F.col("normalized_name")).withColumn("code", F.col("product_id"))
    hinted = frame.withColumn("article_hint", F.lit("p001"))
    small = R.rank_whole_catalog(hinted, full, options=MatchOptions(retrieval_top_n=5)).collect()
    assert len(small) == 5 * len(queries)
    assert {r.query_id for r in small if r.product_id == "p001" and r.exact_match} == set(queries)
    odd = spark.createDataFrame([("x", "zzzz pump-like"), ("y", "zz 1")], "query_id string, text string")
    large = R.hybrid_search(odd, full, options=MatchOptions(name_threshold=0.99, document_threshold=0.99)).collect()
    assert {r.query_id for r in large} == {"x"} and len(large) <= 25
    with pytest.raises(ValueError):
        R.rank_whole_catalog(hinted, full, most=10)


@pytest.mark.parametrize("n", [1, 500, 501])
def test_answers_do_not_depend_on_the_catalog_size(spark, n):
    none = F.lit(None).cast("string")
    columns = ["article", "code", "brand", "normalized_brand", "manufacturer_code", "category_id", "category_path", "unit", "packaging"]
    base = spark.range(n).select(
        F.format_string("p%05d", "id").alias("product_id"), F.format_string("valve %05d", "id").alias("name"),
        F.format_string("valve %05d", "id").alias("normalized_name"), F.format_string("valve %05d", "id").alias("search_document"),
        F.lit(True).alias("is_active"), *[none.alias(c) for c in columns],
    )
    queries = spark.createDataFrame([("near", "valve 00000"), ("far", "qqqqqq")], "query_id string, text string")
    rows = R.hybrid_search(queries, base).collect()
    assert {r.query_id for r in rows} == {"near"}
    assert min(rows, key=lambda r: r.retrieval_rank).product_id == "p00000"


def test_lexeme_lookup(spark):
    documents = spark.createDataFrame([("p", "насосы для воды"), ("r", "труба")], "product_id string, search_document string")
    queries = spark.createDataFrame([("q", "насос для вода")], "query_id string, text string")
    lexemes = spark.createDataFrame([("насосы", "насос"), ("воды", "вод"), ("вода", "вод"), ("для", None)], "token string, lexeme string")
    assert R.text_matches(queries, documents).count() == 0
    row = R.text_matches(queries, documents, lexemes).collect()
    assert [r.product_id for r in row] == ["p"]


def test_equal_texts_are_looked_at_once(spark, monkeypatch):
    texts = ["pump red 5", "pump red 6", "valve red 5", None]
    documents = [(f"p{i:03d}", texts[i % 4]) for i in range(400)] + [("p000", "pump red 5"), ("p000", "red pump 5"), (None, "pump red 5")]
    documents = spark.createDataFrame(documents, "product_id string, search_document string")
    queries = spark.createDataFrame([("a", "5 red pump"), ("b", "red valve"), ("c", "blue"), ("d", ""), (None, "red")], "query_id string, text string")
    sides = []
    plain = R._salted_join
    monkeypatch.setattr(R, "_salted_join", lambda left, right, key: sides.append(right.count()) or plain(left, right, key))
    found = sorted((r.query_id, r.product_id) for r in R.text_matches(queries, documents).collect())
    pumps, valves = [f"p{i:03d}" for i in range(0, 400, 4)], [f"p{i:03d}" for i in range(2, 400, 4)]
    assert found == sorted([("a", p) for p in [*pumps, "p000", "p000"]] + [("b", p) for p in valves])
    assert sides == [4 * 3]  # three terms of four different texts, not of 400 products


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_vectors(spark, clustered):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(6, 8)) * (5 if clustered else 0)
    base = (centers[rng.integers(0, 6, 400)] + rng.normal(size=(400, 8))).astype(np.float32)
    base[10] = base[11]
    probes = (centers[rng.integers(0, 6, 30)] + rng.normal(size=(30, 8))).astype(np.float32)
    items = [(f"p{i:03d}", v.tolist()) for i, v in enumerate(base)] + [("zero", [0.0] * 8), ("short", [1.0])]
    items_df = spark.createDataFrame(items, "product_id string, vector array<float>").orderBy("product_id")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(probes)], "query_id int, vector array<float>")
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit(probes) @ unit(base).T, 9)
    want = {}
    for q, row in enumerate(scores):
        order = sorted(range(400), key=lambda i: (-row[i], f"p{i:03d}"))[:12]
        want[q] = [f"p{i:03d}" for i in order]
    found = vectors.nearest(queries, items_df, 12, block_rows=50).collect()
    got = {q: [r.product_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.sem_rank)] for q in want}
    assert got == want


def test_a_query_leaves_a_slice_with_its_best_only(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 16))
    items = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(base)], "product_id string, vector array<double>")
    queries = items.selectExpr("product_id AS query_id", "vector").limit(60)
    # 30 groups without order share one slice, so a query lists its 5 best, not some of each group
    assert vectors._scored(queries, items, 900, 5, None).count() == 60 * 5
    assert vectors._scored(queries, items, 900, 5, 300).count() <= 60 * 5 * 30


def test_slices_hold_whole_cells_or_parts_of_one():
    rng = np.random.default_rng(3)
    pivots = rng.normal(size=(40, 4))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    counts = rng.integers(0, 60, 40)
    counts[7], counts[8] = 950, 0
    first, parts = vectors._slices(counts, pivots, 100)
    assert parts[7] == 10 and parts.sum() == 49
    held = np.zeros((first + parts).max())
    for cell, n in enumerate(counts):
        held[first[cell] : first[cell] + parts[cell]] += n / parts[cell]
    assert held.max() <= 100 and held.sum() == counts.sum() and len(held) < 40


def test_rerank(spark):
    rows = [("q", "a", 0.5, 1), ("q", "b", 0.4, 2), ("q", "c", 0.3, 3), ("r", "a", 0.2, 1)]
    candidates = spark.createDataFrame(rows, "query_id string, product_id string, rrf_score double, retrieval_rank int")
    scores = spark.createDataFrame([("q", 0, 2.0), ("q", 2, 6.0), ("q", 9, 1.0), ("r", 0, 3.0)], "query_id string, candidate_index int, score double")
    got = {(r.query_id, r.product_id): r.rerank_score for r in RR.scale(RR.by_scores(candidates, scores)).collect()}
    assert got == {("q", "a"): 0.0, ("q", "c"): 1.0, ("r", "a"): 3.0}
    same = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 2.0), ("z", "a", 0.0), ("z", "b", 0.0)], "query_id string, product_id string, rerank_score double")
    assert sorted(r.rerank_score for r in RR.scale(same).collect()) == [0.0, 0.0, 1.0, 1.0]


def test_running_sum_of_a_hot_key(spark):
    rows = [("hot" if i % 10 else "cold", i, i % 7) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    got = {(r.k, r.at): r.s for r in running_sum(df, ["k"], "at", {"s": F.col("v")}).collect()}
    total = {"hot": 0, "cold": 0}
    for k, at, v in rows:
        total[k] += v
        assert got[k, at] == total[k]


def test_a_gram_of_all_queries_and_products_is_a_grid(spark, monkeypatch):
    """No task meets more than about ``HOT_ROWS`` rows of either side of one key, and no pair is lost."""
    monkeypatch.setattr(R, "HOT_ROWS", 50)
    left = spark.range(300).select(F.col("id").alias("l_id"), F.lit("red").alias("gram"), F.lit(400).cast("long").alias("cnt"))
    right = spark.range(400).select(F.col("id").alias("r_id"), F.lit("red").alias("gram"), F.lit(400).cast("long").alias("cnt"))
    rare = spark.createDataFrame([(7, "axle", 1)], "l_id long, gram string, cnt long")
    once = spark.createDataFrame([(9, "axle", 1)], "r_id long, gram string, cnt long")
    pairs = R._salted_join(left.union(rare), right.union(once), "gram").cache()
    assert pairs.count() == pairs.select("l_id", "r_id", "gram").distinct().count() == 300 * 400 + 1
    cells = pairs.groupBy("gram", "l_part", "r_part").agg(F.count_distinct("l_id").alias("l"), F.count_distinct("r_id").alias("r")).collect()
    assert len([c for c in cells if c["gram"] == "red"]) == 6 * 8
    assert max(c["l"] for c in cells) < 100 and max(c["r"] for c in cells) < 100
    pairs.unpersist()


def test_names_are_compared_once_for_all_classes(spark, world):
    index = R.build_index(world[2], 200)
    names = index.name_grams.count()
    assert names == index.names.select("name_id").distinct().count() < index.classes.count()
    assert index.names.count() == index.classes.count()
