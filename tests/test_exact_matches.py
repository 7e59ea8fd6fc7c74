"""Codes that many products and queries share: every pair once, made by many tasks."""

from pyspark.sql import functions as F

from linewright.operators import retrieval as R


def test_pairs_of_a_shared_code_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "spread", lambda df, *keys: df.repartition(4, *keys))
    row = lambda i: (f"p{i}", "same" if i % 2 else f"a{i}", "same" if i % 3 else None, f"m{i % 7}", i % 5 != 0)
    schema = "product_id string, article string, code string, manufacturer_code string, is_active boolean"
    rows = [row(i) for i in range(200)] + [row(1)]
    hints = [("q1", "same"), ("q2", "same"), ("q2", "m1"), ("q3", "m1"), ("q4", "a2"), ("q5", ""), ("q6", None), ("q2", "same")]
    catalog = spark.createDataFrame(rows, schema).coalesce(1)
    queries = spark.createDataFrame(hints, "query_id string, article_hint string")
    expected = {(q, r[0]) for q, h in hints for r in rows if h and r[4] and h in r[1:4]}
    found = R.exact_matches(queries, catalog)
    assert sorted(map(tuple, found.collect())) == sorted(expected)

    made = found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(made) == 4
    # the pairs themselves do not move: they are told apart where they are made
    plan = R.exact_matches(F.broadcast(queries), catalog)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
