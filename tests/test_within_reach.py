"""Only classes that can enter a list are opened into their products."""

from linewright.operators import retrieval as R


def test_classes_behind_a_full_list_are_not_opened(spark):
    rows = [
        ("q", "a", 2, 0.9), ("q", "b", 3, 0.8), ("q", "c", 200, 0.8), ("q", "d", 1, 0.7),  # b and c tie: both may enter
        ("r", "a", 4, 0.5), ("r", "b", 1, 0.4), ("r", "c", 1, 0.3),  # a and b fill the list
        ("s", "a", 1, 0.1),
    ]
    listed = spark.createDataFrame(rows, "query_id string, class_id string, members long, lex_score double")
    kept = sorted((r.query_id, r.class_id) for r in R._within_reach(listed, 5).collect())
    assert kept == [("q", "a"), ("q", "b"), ("q", "c"), ("r", "a"), ("r", "b"), ("s", "a")]


def test_a_list_opens_no_more_than_it_can_hold(spark):
    words = ["bolt", "nut", "ring"]
    products = [(f"p{i:03}", words[i // 40], f"{words[i // 40]} of steel", True) for i in range(120)]
    catalog = spark.createDataFrame(products, "product_id string, normalized_name string, search_document string, is_active boolean")
    queries = spark.createDataFrame([("q", "bolt of steel")], "query_id string, text string")
    found = R.lexical_matches(queries, R.build_index(catalog, 30), cap=30)
    assert sorted(r.product_id for r in found.collect()) == [f"p{i:03}" for i in range(30)]
    assert "_ahead" in found._jdf.queryExecution().analyzed().toString()
