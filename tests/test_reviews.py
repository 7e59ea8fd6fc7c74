"""What reviews settle and what is learned from them: odd rows, and how often rows move."""

import random
import re

import pytest

from linewright.operators import normalize as N
from linewright.operators import review as V

REVIEWS = "request_item_id string, final_decision string, final_product_id string, reviewer string, at timestamp, create_supplier_mapping boolean"
ITEMS = "request_item_id string, request_id string, raw_text string, normalized_text string, best_product_id string, confidence double, status string"


@pytest.fixture(scope="module")
def world(spark):
    """Few values, so that ids, products and texts repeat; each may be null."""
    from datetime import datetime

    dice = random.Random(5)
    one = lambda *values: dice.choice([*values, None])
    reviews = [
        (one(*[f"i{k}" for k in range(12)]), one("accepted", "corrected", "rejected"), one("p1", "p2", "gone", ""), f"r{n}", datetime(2024, 1, 1 + n % 9), one(True, True, False))
        for n in range(150)
    ]
    items = [(f"i{k}", one("q1", "q2", "q3"), one("Болт  M8", "nut 5 mm", ""), None, one("p1", "p9", ""), one(0.0, 0.5), "x") for k in range(10)]
    products = [("p1",), ("p2",), ("p2",), (None,)]
    return reviews, items, spark.createDataFrame(reviews, REVIEWS), spark.createDataFrame(items, ITEMS), spark.createDataFrame(products, "product_id string")


def settled(reviews, items):
    """Brute force: ``(review, item, product)`` of all reviews that stay."""
    for r in reviews:
        for i in (i for i in items if i[0] == r[0]):
            product = (r[2] or i[4]) if r[1] == "accepted" else r[2]
            if not (r[1] in ("corrected", None) and product and product not in ("p1", "p2")):
                yield r, i, product


def test_resolved_reviews_equal_brute_force(world):
    reviews, items, *tables = world
    found = V.resolve_reviews(*tables)
    assert "decision" in found.columns and found.columns[0] == "settled_product_id"
    found = [(r["request_item_id"], r["decision"], r["settled_product_id"], r["reviewer"], r["raw_text"]) for r in found.collect()]
    key = lambda r: tuple(map(str, r))
    wanted = [(r[0], r[1], product, r[3], i[2]) for r, i, product in settled(reviews, items)]
    assert sorted(found, key=key) == sorted(wanted, key=key) and any(r[2] == "p2" for r in found)


def test_derived_mappings_equal_brute_force(spark, world):
    reviews, items, *tables = world
    requests = spark.createDataFrame([("q1", "s1"), ("q2", "s2"), ("q3", "")], "request_id string, supplier_id string")
    last = {}
    for r, i, product in settled(reviews, items):
        supplier = {"q1": "s1", "q2": "s2"}.get(i[1])
        if r[5] and product and supplier:
            last[supplier, i[2]] = max(last.get((supplier, i[2]), ()), (r[4], r[0], r[3], product, i[5] or None), key=lambda x: x[:2])
    found = V.derived_mappings(V.resolve_reviews(*tables), requests).collect()
    assert {(r["supplier_id"], r["supplier_raw_text"]) for r in found} == set(last) and len(found) == len(last)
    texts = N.normalize(spark.createDataFrame([(i[2],) for i in items], "raw_text string")).collect()
    texts = {r["raw_text"]: r["n_text"] or r["raw_text"] for r in texts}
    for r in found:
        at, item, *_ = last[r["supplier_id"], r["supplier_raw_text"]]
        tied = {(x[3], p, i[5] or None) for x, i, p in settled(reviews, items) if (x[4], x[0], i[2]) == (at, item, r["supplier_raw_text"]) and x[5] and p}
        assert (r["approved_by"], r["product_id"], r["confidence"]) in tied
        assert r["normalized_supplier_text"] == texts[r["supplier_raw_text"]]


def test_reviews_move_to_item_request_and_mapping_only(spark, world):
    """Neither to their product nor to their text, and nothing is made twice."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        requests = spark.createDataFrame([("q1", "s1")], "request_id string, supplier_id string")
        plan = V.derived_mappings(V.resolve_reviews(*world[2:]), requests)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [m.split(",")[0].split("#")[0] for m in re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)]
    assert "settled_product_id" not in moved and "raw_text" not in moved
    assert moved.count("request_id") == 2 and moved.count("request_item_id") == 2 and moved.count("supplier_id") == 1
