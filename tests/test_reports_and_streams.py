"""Metrics, reviews and stateful streams against hand-worked cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from linewright.operators import reporting as R
from linewright.operators import review as V
from linewright.operators import verdicts as VD
from linewright.session import scratch_path
from linewright.streaming import guards, runs, windows

ITEM = "request_item_id string, request_id string, status string, final_decision string, final_product_id string"


def metrics(spark, decisions, latency_ms):
    rows = [(str(i), "r", s, d, None) for i, (s, d) in enumerate(decisions)]
    start = dt.datetime(2024, 1, 1)
    end = None if latency_ms is None else start + dt.timedelta(milliseconds=latency_ms)
    requests = spark.createDataFrame([("r", "s", start, end)], "request_id string, supplier_id string, started_at timestamp, finished_at timestamp")
    return R.quality_metrics(spark.createDataFrame(rows, ITEM), requests)


def test_quality_metrics(spark):
    decisions = [("auto_match", "accepted")] * 4 + [("auto_match", "rejected")] + [("review_needed", "accepted")] * 3 + [("no_match", "corrected")] * 2
    m = metrics(spark, decisions + [("auto_match", None)], 1234.56).first()
    assert (m.total_cases, m.top1_accuracy, m.precision_at_1, m.auto_match_fp_rate, m.review_acceptance_rate, m.avg_latency_ms) == (10, 0.7, 1.4, 0.2, 0.7, 1234.6)
    m = metrics(spark, [("no_match", "accepted"), ("no_match", "rejected"), ("no_match", "rejected")], None).first()
    assert (m.top1_accuracy, m.precision_at_1, m.auto_match_fp_rate, m.avg_latency_ms) == (0.3333, None, None, None)
    assert metrics(spark, [("auto_match", None)], None).first().total_cases == 0


def gate(spark, now, before, cases=10):
    current = spark.createDataFrame([(cases, now, None)], "total_cases long, top1_accuracy double, auto_match_fp_rate double")
    t = dt.datetime(2024, 1, 1)
    rows = [("old", "all", 0.1, None, None, t)] + ([("new", "all", before, None, None, t + dt.timedelta(days=1))] if before else [])
    reports = spark.createDataFrame(rows, "report_id string, scope string, top1_accuracy double, top3_recall double, auto_match_fp_rate double, created_at timestamp")
    return R.quality_gate(current, reports if before else reports.limit(0)).first()


def test_quality_gate(spark):
    assert gate(spark, 0.91, 0.92).passed
    failed = gate(spark, 0.89, 0.92)
    assert not failed.passed and failed.regressions == ["Top-1 accuracy dropped 3.0% (prev=92.0%, now=89.0%)"]
    assert gate(spark, 0.95, 0.92).improvements == ["Top-1 accuracy improved by 3.0%"]
    assert gate(spark, 0.1, None).passed and gate(spark, 0.1, 0.92, cases=0).passed


def test_costs(spark):
    calls = spark.createDataFrame(
        [("gpt-4o", 1000, 500, None), ("openai/gpt-4o-mini", 10, 0, 15), ("qwen3-235b-a22b", 1_000_000, 0, None), ("mystery", 2, 2, None)],
        "model string, prompt_tokens int, completion_tokens int, total_tokens int",
    )
    got = {r.model: (float(r.estimated_cost_usd), r.total_tokens) for r in R.token_log(calls).collect()}
    assert got["gpt-4o"] == (0.0075, 1500)
    assert got["openai/gpt-4o-mini"] == (0.000025, 15)  # the first known name it contains is gpt-4o
    assert got["qwen3-235b-a22b"] == (0.2, 1_000_000) and got["mystery"] == (0.000004, 4)


def test_reviews_and_what_is_learned(spark):
    items = spark.createDataFrame(
        [("i1", "r", "Насос Грундфос", "насос grundfos", "p1", 0.8, "review_needed", None, None, None, None, None), ("i2", "r", "Труба", None, "p2", 0.0, "auto_match", "accepted", "p2", "ann", None, "note"),
         ("i3", "r", "Клей", "клей", None, 0.5, "no_match", None, None, None, None, None)],
        "request_item_id string, request_id string, raw_text string, normalized_text string, best_product_id string, confidence double, status string, final_decision string, final_product_id string, reviewed_by string, reviewed_at timestamp, review_notes string",
    )
    requests = spark.createDataFrame([("r", "s1")], "request_id string, supplier_id string")
    catalog = spark.createDataFrame([("p1",), ("p3",)], "product_id string")
    t = dt.datetime(2024, 1, 1)
    reviews = spark.createDataFrame(
        [("i1", "accepted", None, "bob", t, True, True, None), ("i2", "corrected", "p3", "bob", t, False, False, None), ("i3", "corrected", "p9", "bob", t, False, False, None), ("i9", "accepted", "p1", "bob", t, False, False, None)],
        "request_item_id string, final_decision string, final_product_id string, reviewer string, at timestamp, create_alias boolean, create_supplier_mapping boolean, comment string",
    )
    kept, refused = V.first_reviewer(reviews, items)
    assert [r.request_item_id for r in refused.collect()] == ["i2"]
    resolved = V.resolve_reviews(kept, items, catalog)
    assert {r.request_item_id: r.settled_product_id for r in resolved.collect()} == {"i1": "p1"}
    done = {r.request_item_id: r for r in V.apply_reviews(items, resolved).collect()}
    assert (done["i1"].final_decision, done["i1"].final_product_id, done["i1"].reviewed_by) == ("accepted", "p1", "bob")
    assert (done["i2"].reviewed_by, done["i2"].review_notes) == ("ann", "note")
    label = V.golden_labels(resolved, requests).first()
    assert (label.label_type, label.product_id, label.supplier_id) == ("positive", "p1", "s1")
    assert V.derived_aliases(resolved).first().normalized_alias_text == "насос grundfos"
    mapping = V.derived_mappings(resolved, requests).first()
    assert (mapping.supplier_id, mapping.mapping_type, mapping.confidence) == ("s1", "approved", 0.8)
    assert V.derived_mappings(resolved, requests, V.derived_mappings(resolved, requests)).count() == 0


def test_reply_repair(spark):
    replies = [
        ("fence", '```json\n[{"item_index": 0, "product_id": "a", "confidence": 0.9,}]\n```'),
        ("cut", '[{"item_index": 0, "product_id": "a"}, {"item_index": 1, "pro'),
        ("range", '[{"item_index": 7, "product_id": "a"}, {"product_id": "b"}]'),
        ("junk", "sorry"),
        ("last", '[{"item_index": 1, "product_id": "a"}, {"item_index": 1, "product_id": "b"}]'),
    ]
    df = spark.createDataFrame([(k, r, 2) for k, r in replies], "id string, reply string, items int")
    got = {(r.id, r.item_index): r.product_id for r in VD.parse_verdicts(df, ["id"]).collect()}
    assert got == {("fence", 0): "a", ("cut", 0): "a", ("last", 1): "b"}


def events(spark, rows):
    path = scratch_path(spark, "events")
    schema = "id long, key string, ts timestamp, bad boolean"
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, k, t + dt.timedelta(seconds=s), b) for i, (k, s, b) in enumerate(rows)], schema)
    for part in range(3):  # three files make three micro-batches, in time order
        df.filter((F.col("id") >= part * len(rows) // 3) & (F.col("id") < (part + 1) * len(rows) // 3)).coalesce(1).write.mode("append").parquet(path)
    return runs.parquet_stream(spark, path, "*.parquet", df.schema, 1), t.replace(tzinfo=dt.timezone.utc).timestamp()


def test_guards_across_batches(spark):
    rng = random.Random(2)
    rows = sorted(((rng.choice("ab"), rng.randrange(3000), rng.random() < 0.8) for _ in range(240)), key=lambda r: r[1])
    rows = [(k, s + i / 1000, b) for i, (k, s, b) in enumerate(rows)]
    stream, t0 = events(spark, rows)
    got = sorted((r.key, round(r.at - t0, 3), r.failures) for r in runs.drain_appended(guards.circuit_openings(stream, "key", "ts", F.col("bad")), "c").collect())
    want, run = [], {"a": 0, "b": 0}
    for k, s, b in rows:
        run[k] = run[k] + 1 if b else 0
        if run[k] >= 5:
            want.append((k, round(s, 3), run[k]))
    assert got == sorted(want)

    stream, t0 = events(spark, rows)
    alerts = sorted((r.key, round(r.at - t0, 3)) for r in runs.drain_appended(guards.slow_alerts(stream, "key", "ts", F.col("bad")), "a").collect())
    want, run, last = [], {"a": 0, "b": 0}, {}
    for k, s, b in rows:
        run[k] = run[k] + 1 if b else 0
        if run[k] >= 3 and s - last.get(k, -1e9) >= 600:
            want.append((k, round(s, 3)))
            last[k] = s
    assert alerts == sorted(want)

    stream, t0 = events(spark, rows)
    blocks = sorted((r.key, round(r.at - t0, 3), r.outcome) for r in runs.drain_appended(guards.login_blocks(stream, "key", "ts", F.col("bad")), "b").collect())
    want, state = [], {}
    for k, s, b in rows:
        count, end, until = state.get(k, (0, 0, 0))
        if s < until:
            want.append((k, round(s, 3), "refused"))
            continue
        if not b:
            state[k] = (0, 0, 0)
            continue
        if s >= end:
            count, end = 0, s + 60
        count += 1
        if count >= 5:
            until = s + 300
            want.append((k, round(s, 3), "blocked"))
        state[k] = (count, end, until)
    assert blocks == sorted(want)


def test_stream_windows_equal_batch(spark):
    rows = [("a", i * 7.0, False) for i in range(300)] + [("z", 90000.0, False)]
    stream, _ = events(spark, rows)
    found = runs.drain_appended(windows.rate_breaches(stream, "key", "ts", 8), "w")
    t = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(k, t + dt.timedelta(seconds=s)) for k, s, _ in rows], "key string, ts timestamp")
    want = windows.rate_breaches(batch, "key", "ts", 8)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
