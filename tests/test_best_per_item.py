"""The best candidate of an item: ties, alternatives, trace, and what moves between tasks."""

import json
import random

from pyspark.sql import functions as F

from linewright.functions import scoring
from linewright.plans import batch_match as B

SCORES = ["lexical_score", "semantic_score", "rerank_score", "base_score", "bonus", "penalty"]


def decided(spark):
    dice = random.Random(3)
    rows = [
        (dice.randrange(6), dice.choice([0.1, 0.5, 0.9]), dice.randrange(3), f"p{dice.randrange(3)}", dice.choice(["a", None]), ["r"],
         *[dice.choice([0.0, 0.25, 0.5]) for _ in SCORES])
        for _ in range(60)
    ]
    schema = "item_id int, final_score double, retrieval_rank int, product_id string, short_circuit string, reasons array<string>, "
    df = spark.createDataFrame(rows, schema + ", ".join(f"{c} double" for c in SCORES))
    df = df.withColumns({c: F.concat(F.lit(c), "product_id") for c in ("name", "article", "brand", "category_path")})
    df = df.withColumns({"status": F.when(F.col("final_score") > 0.4, "yes").otherwise("no"), "auto_match_forbidden": F.col("bonus") > 0})
    return df.withColumns({c: F.col("penalty") for c in scoring.FEATURES if c not in df.columns})


def test_best_alternatives_and_trace_follow_one_order(spark):
    df = decided(spark)
    groups = {}
    for r in df.collect():
        groups.setdefault(r.item_id, []).append(r)
    none_first = lambda v: (v is not None, v or "")
    order = lambda r: (
        -r.final_score, r.retrieval_rank, r.product_id, r.lexical_score, r.semantic_score, r.rerank_score, r.bonus + r.penalty,
        r.base_score, r.bonus, r.penalty, none_first(r.short_circuit),
    )
    for out in B.best_per_item(df, 3).collect():
        rows = sorted(groups.pop(out.item_id), key=order)
        best, trace = rows[0], json.loads(out.trace)
        assert (out.status, out.confidence, out.best_product_id, out.best_name) == (best.status, best.final_score, best.product_id, best.name)
        assert out.candidates_reranked == len(rows)
        assert [a["product_id"] for a in out.alternatives] == [r.product_id for r in rows[:3]]
        assert [a["rules_score"] for a in out.alternatives] == [r.bonus + r.penalty for r in rows[:3]]
        assert list(trace) == [
            c for c in ("base_score", "bonus", "penalty", "final_score", "short_circuit", "auto_match_forbidden", "features", "decision")
            if c != "short_circuit" or best.short_circuit is not None
        ]
        assert (trace["base_score"], trace["bonus"], trace["penalty"]) == (best.base_score, best.bonus, best.penalty)
        assert trace["features"]["lexical_score"] == best.lexical_score
        assert trace["decision"] == {"status": best.status, "confidence": best.final_score}
    assert not groups


def test_rows_move_before_they_are_listed_and_without_unread_columns(spark):
    plan = B.best_per_item(decided(spark)).select("item_id", "alternatives")._jdf.queryExecution().executedPlan().toString()
    listed, moved = plan.index("partial_collect_list"), plan.index("Exchange hashpartitioning(item_id")
    assert listed < moved and "base_score" not in plan[:moved]
