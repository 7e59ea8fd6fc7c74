"""F: counters, metrics, costs, listings and review feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import CATALOG, ITEMS, LOG, MAPPINGS, REQUESTS, catalog, calls, items, log, mappings, query, requests, seconds, table, text, with_sql
from linewright.operators import mappings as M
from linewright.operators import reporting as R
from linewright.operators import review as V

COUNTERS = """SELECT request_id, count(*) AS processed_items,
  count(*) FILTER (status = 'auto_match') AS auto_matched_items,
  count(*) FILTER (status = 'review_needed') AS review_needed_items,
  count(*) FILTER (status = 'no_match') AS no_match_items FROM items GROUP BY request_id"""


@query("F1_status_counters", with_sql(ITEMS, body=COUNTERS))
def f1(spark, sf):
    return R.status_counters(items(spark, sf))


@query("F2_progress", with_sql(ITEMS, body="""
SELECT request_id, CASE WHEN count(*) > 0 THEN CAST(floor(count(final_decision) / count(*) * 100 + 0.5) AS BIGINT) ELSE 0 END AS percent
FROM items GROUP BY request_id"""))
def f2(spark, sf):
    return items(spark, sf).groupBy("request_id").agg(
        R.progress_percent(F.count("final_decision"), F.count("*")).alias("percent")
    )


METRICS = """counted AS (
  SELECT {by} count(*) AS total_cases, count(*) FILTER (final_decision = 'accepted') AS acc,
         count(*) FILTER (i.status = 'auto_match') AS au,
         count(*) FILTER (i.status = 'auto_match' AND final_decision IN ('corrected', 'rejected')) AS wrong
  FROM items i JOIN requests r USING (request_id) WHERE final_decision IS NOT NULL {group}),
latency AS (SELECT {by} avg((epoch_us(finished_at) - epoch_us(started_at)) / 1000.0) AS ms
  FROM requests WHERE finished_at IS NOT NULL AND started_at IS NOT NULL {group}),
metrics AS (SELECT {by} total_cases, round(acc / total_cases, 4) AS top1_accuracy,
  CASE WHEN au > 0 THEN round(acc / au, 4) END AS precision_at_1,
  CASE WHEN au > 0 THEN round(wrong / au, 4) END AS auto_match_fp_rate,
  round(acc / total_cases, 4) AS review_acceptance_rate, round(ms, 1) AS avg_latency_ms
  FROM counted {join} latency {using})"""
ALL_METRICS = METRICS.format(by="", group="", join="CROSS JOIN", using="")
SUPPLIER_METRICS = METRICS.format(by="supplier_id,", group="GROUP BY supplier_id", join="LEFT JOIN", using="USING (supplier_id)")


@query("F3_quality_metrics", with_sql(ITEMS, REQUESTS, ALL_METRICS, body="SELECT * FROM metrics"))
def f3(spark, sf):
    return R.quality_metrics(items(spark, sf), requests(spark, sf))


@query("F3_quality_metrics_by_supplier", with_sql(ITEMS, REQUESTS, SUPPLIER_METRICS, body="SELECT * FROM metrics"))
def f3_by_supplier(spark, sf):
    return R.quality_metrics(items(spark, sf), requests(spark, sf), ["supplier_id"])


CANDIDATES = """candidates AS (
  SELECT request_item_id, product_id, CAST(1 + row_number() OVER (PARTITION BY request_item_id, product_id ORDER BY product_id) * 0 + n AS BIGINT) AS retrieval_rank
  FROM (SELECT request_item_id, unnest([best_product_id, 'P' || position, 'P' || (position + 1), final_product_id]) AS product_id,
               unnest([0, 1, 2, 3]) AS n FROM items))"""


def _candidates(spark, sf):
    rows = items(spark, sf)
    position = lambda n: F.concat(F.lit("P"), (F.col("position") + n).cast("string"))
    return rows.select(
        "request_item_id", F.posexplode(F.array("best_product_id", position(0), position(1), "final_product_id")).alias("n", "product_id")
    ).select("request_item_id", "product_id", (F.col("n") + 1).cast("bigint").alias("retrieval_rank"))


@query("F4_top3_recall", with_sql(ITEMS, CANDIDATES, body="""
SELECT count(*) AS cases, round(avg(CASE WHEN EXISTS (SELECT 1 FROM candidates c WHERE c.request_item_id = i.request_item_id
  AND c.product_id = i.final_product_id AND c.retrieval_rank <= 3) THEN 1.0 ELSE 0.0 END), 4) AS top3_recall
FROM items i WHERE final_decision IS NOT NULL AND final_product_id IS NOT NULL"""))
def f4(spark, sf):
    return R.top3_recall(items(spark, sf), _candidates(spark, sf))


# daily accuracy of labelled documents stands for a table of saved reports
REPORTS = """reports AS (
  SELECT 'rep' || o_orderkey AS report_id,
         CASE WHEN o_orderpriority < '3' THEN 'all' ELSE 'supplier' END AS scope,
         CASE WHEN o_orderpriority < '3' THEN NULL ELSE 'S' || o_custkey END AS scope_value,
         round(o_totalprice / 500000, 4) AS top1_accuracy, round(o_totalprice / 510000, 4) AS top3_recall,
         round(1 - o_totalprice / 400000, 4) AS auto_match_fp_rate, CAST(o_orderdate AS TIMESTAMP) AS created_at
  FROM orders)"""


def _reports(spark, sf):
    urgent = F.col("o_orderpriority") < "3"
    return table(spark, sf, "orders").select(
        F.concat(F.lit("rep"), text("o_orderkey")).alias("report_id"),
        F.when(urgent, "all").otherwise("supplier").alias("scope"),
        F.when(~urgent, F.concat(F.lit("S"), text("o_custkey"))).alias("scope_value"),
        F.round(F.col("o_totalprice") / 500000, 4).alias("top1_accuracy"),
        F.round(F.col("o_totalprice") / 510000, 4).alias("top3_recall"),
        F.round(1 - F.col("o_totalprice") / 400000, 4).alias("auto_match_fp_rate"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
    )


@query("F5_quality_history", with_sql(REPORTS, body="""
SELECT report_id, scope, nullif(top1_accuracy, 0) AS top1_accuracy, top3_recall, nullif(auto_match_fp_rate, 0) AS auto_match_fp_rate,
  epoch_us(created_at) AS created_at
FROM reports WHERE scope = 'all' AND created_at >= TIMESTAMP '1998-01-01'"""))
def f5(spark, sf):
    return R.quality_history(_reports(spark, sf), F.lit("1998-01-01").cast("timestamp")).select(
        "report_id", "scope", "top1_accuracy", "top3_recall", "auto_match_fp_rate", seconds("created_at")
    )


@query("F5_quality_snapshot", with_sql(ITEMS, REQUESTS, ALL_METRICS, body="""
SELECT 'report_1' AS report_id, 'all' AS scope, CAST(NULL AS VARCHAR) AS scope_value, * FROM metrics"""))
def f5_snapshot(spark, sf):
    metrics = R.quality_metrics(items(spark, sf), requests(spark, sf))
    return R.quality_snapshot(metrics, "report_1", "all", None, F.lit("2024-01-01").cast("timestamp")).drop("created_at")


def _gate_sql(name, label, sign, verb, limit):
    worse = f"({sign} * (b.{name} - c.{name}))"
    return (
        f"CASE WHEN b.{name} <> 0 AND {worse} > {limit} THEN '{label} {verb} ' || printf('%.1f', {worse} * 100) || '% (prev=' || "
        f"printf('%.1f', b.{name} * 100) || '%, now=' || printf('%.1f', c.{name} * 100) || '%)' END"
    ), f"CASE WHEN b.{name} <> 0 AND {worse} < -0.005 THEN '{label} improved by ' || printf('%.1f', -{worse} * 100) || '%' END"


_A = _gate_sql("top1_accuracy", "Top-1 accuracy", 1, "dropped", 0.02)
_P = _gate_sql("auto_match_fp_rate", "FP rate", -1, "increased", 0.01)
_R = _gate_sql("top3_recall", "Top-3 recall", 1, "dropped", 0.03)


@query("F6_quality_gate", with_sql(ITEMS, REQUESTS, ALL_METRICS, REPORTS, f"""latest AS (
  SELECT * FROM reports WHERE scope = 'all' ORDER BY created_at DESC, report_id DESC LIMIT 1),
judged AS (SELECT {_A[0]} AS a, {_P[0]} AS p, {_A[1]} AS ai, {_P[1]} AS pi FROM metrics c, latest b)""", body="""
SELECT a IS NULL AND p IS NULL AS passed, concat_ws('; ', a, p) AS regressions, concat_ws('; ', ai, pi) AS improvements FROM judged"""))
def f6(spark, sf):
    gate = R.quality_gate(R.quality_metrics(items(spark, sf), requests(spark, sf)), _reports(spark, sf))
    return gate.select("passed", F.array_join("regressions", "; ").alias("regressions"), F.array_join("improvements", "; ").alias("improvements"))



def _since():
    return F.lit("2024-01-10").cast("timestamp")


RECENT = "FROM log WHERE created_at >= TIMESTAMP '2024-01-10'"
SUMS = """CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens"""


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("F7_token_totals", with_sql(LOG, body=f"""
SELECT {SUMS}, round(sum(estimated_cost_usd), 6) AS total_cost_usd, count(*) AS api_calls {RECENT}"""))
def f7(spark, sf):
    return _rounded(R.token_totals(log(spark, sf), _since()), "total_cost_usd")


@query("F8_tokens_by_provider", with_sql(LOG, body=f"""
SELECT provider, {SUMS}, round(sum(estimated_cost_usd), 6) AS cost_usd, count(*) AS calls {RECENT} GROUP BY provider"""))
def f8(spark, sf):
    return _rounded(R.tokens_by(log(spark, sf), ["provider"], _since()), "cost_usd")


@query("F9_tokens_by_model", with_sql(LOG, body=f"""
SELECT provider, model, operation, {SUMS}, round(sum(estimated_cost_usd), 6) AS cost_usd, count(*) AS calls {RECENT}
GROUP BY provider, model, operation"""))
def f9(spark, sf):
    return _rounded(R.tokens_by(log(spark, sf), ["provider", "model", "operation"], _since()), "cost_usd")


@query("F7_F10_token_summary", with_sql(LOG, body="""
SELECT provider, model, operation, strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS day,
  CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(estimated_cost_usd), 6) AS cost_usd, count(*) AS calls
FROM log GROUP BY GROUPING SETS ((), (provider), (provider, model, operation), (CAST(created_at AS DATE)))"""))
def f7_f10(spark, sf):
    out = R.token_summary(log(spark, sf)).drop("breakdown").withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return _rounded(out, "cost_usd")


@query("F10_tokens_daily", with_sql(LOG, body=f"""
SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
  round(sum(estimated_cost_usd), 6) AS cost_usd {RECENT} GROUP BY 1"""))
def f10(spark, sf):
    return _rounded(R.tokens_daily(log(spark, sf), _since()), "cost_usd").withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("F11_cost_estimate", with_sql(LOG, body="SELECT event_id, model, estimated_cost_usd FROM log"))
def f11(spark, sf):
    return R.with_cost(calls(spark, sf)).select("event_id", "model", "estimated_cost_usd")


@query("F12_usage_bars", with_sql(LOG, body="""
SELECT provider, total_tokens, CAST(floor(total_tokens / calls + 0.5) AS BIGINT) AS avg_tokens,
  round(total_tokens / greatest(max(total_tokens) OVER (), 1) * 100, 6) AS width_pct
FROM (SELECT provider, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, count(*) AS calls FROM log GROUP BY provider)"""))
def f12(spark, sf):
    grouped = log(spark, sf).groupBy("provider").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("calls"))
    return R.usage_bars(grouped).drop("calls")


@query("F13_duplicate_lines", """
SELECT lower(line) AS text_key, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
GROUP BY 1 HAVING count(*) > 1""")
def f13(spark, sf):
    lines = table(spark, sf, "documents").select(F.explode(F.split("text", "\n")).alias("raw_text"))
    return R.duplicate_lines(lines)


@query("F14_request_list", with_sql(REQUESTS, body="""
SELECT request_id, supplier_id, status, epoch_us(created_at) AS created_at, count(*) OVER () AS total
FROM requests WHERE status = 'done' AND created_at >= TIMESTAMP '1997-01-01'
ORDER BY requests.created_at DESC, request_id LIMIT 50 OFFSET 50"""))
def f14(spark, sf):
    return R.list_requests(requests(spark, sf), status="done", created_after="1997-01-01", page=2).select(
        "request_id", "supplier_id", "status", seconds("created_at"), "total"
    )


@query("F15_request_sort", with_sql(REQUESTS, body="""
SELECT request_id, status, CAST(CASE status WHEN 'pending' THEN 0 WHEN 'queued' THEN 1 WHEN 'running' THEN 2 WHEN 'done' THEN 3 WHEN 'failed' THEN 4 ELSE 99 END AS INTEGER) AS sort_key
FROM requests WHERE contains(lower(request_id), 'r1')"""))
def f15(spark, sf):
    return R.sort_requests(requests(spark, sf), "R1").select("request_id", "status", "sort_key")


@query("F16_request_items", with_sql(ITEMS, body="""
SELECT request_item_id, status, count(*) OVER () AS total FROM items WHERE request_id = 'R3' AND status = 'no_match'
ORDER BY created_at, request_item_id LIMIT 50"""))
def f16(spark, sf):
    return R.request_items(items(spark, sf), "R3", "no_match").select("request_item_id", "status", "total")


@query("F17_item_candidates", with_sql(ITEMS, CANDIDATES, CATALOG, body="""
SELECT c.request_item_id, c.product_id, p.name, p.article, p.brand, c.retrieval_rank
FROM candidates c JOIN catalog p USING (product_id)"""))
def f17(spark, sf):
    return R.item_candidates(_candidates(spark, sf), catalog(spark, sf)).select(
        "request_item_id", "product_id", "name", "article", "brand", "retrieval_rank"
    )


@query("F18_review_queue", with_sql(ITEMS, REQUESTS, body="""
SELECT request_item_id, request_id, supplier_id, file_name, confidence, count(*) OVER () AS total
FROM items i JOIN requests USING (request_id) WHERE i.status = 'review_needed' AND final_decision IS NULL
ORDER BY confidence DESC, request_item_id LIMIT 100"""))
def f18(spark, sf):
    return V.review_queue(items(spark, sf), requests(spark, sf), page_size=100).select(
        "request_item_id", "request_id", "supplier_id", "file_name", "confidence", "total"
    )


# reviews: shipped lines judged by their supplier's clerk
REVIEWS = """reviews AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS request_item_id,
         CASE WHEN l_tax < 0.03 THEN 'accepted' WHEN l_tax < 0.06 THEN 'corrected' ELSE 'rejected' END AS decision,
         CASE WHEN l_tax < 0.03 THEN NULL ELSE 'P' || (l_suppkey * 10) END AS given,
         'reviewer' || (l_suppkey % 5) AS reviewer, CAST(l_shipdate AS TIMESTAMP) AS at_, l_quantity > 25 AS create_alias, l_quantity > 10 AS create_supplier_mapping
  FROM lineitem),
one_item AS (SELECT DISTINCT ON (request_item_id) * FROM items),
resolved AS (
  SELECT r.*, i.request_id, i.raw_text, i.normalized_text, i.confidence,
         CASE WHEN decision = 'accepted' THEN coalesce(given, best_product_id) ELSE given END AS settled_product_id
  FROM reviews r JOIN one_item i USING (request_item_id)
  WHERE decision <> 'corrected' OR given IN (SELECT product_id FROM catalog))"""


def _reviews(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("request_item_id"),
        F.when(F.col("l_tax") < 0.03, "accepted").when(F.col("l_tax") < 0.06, "corrected").otherwise("rejected").alias("final_decision"),
        F.when(F.col("l_tax") >= 0.03, F.concat(F.lit("P"), (F.col("l_suppkey") * 10).cast("string"))).alias("final_product_id"),
        F.concat(F.lit("reviewer"), (F.col("l_suppkey") % 5).cast("string")).alias("reviewer"),
        F.col("l_shipdate").cast("timestamp").alias("at"),
        (F.col("l_quantity") > 25).alias("create_alias"),
        (F.col("l_quantity") > 10).alias("create_supplier_mapping"),
        F.lit(None).cast("string").alias("comment"),
    )


def _resolved(spark, sf):
    # ids hardly repeat: sent to their task first, items are not sorted by id in large files only to find no copies there
    one_item = items(spark, sf).repartition("request_item_id").dropDuplicates(["request_item_id"])
    return V.resolve_reviews(_reviews(spark, sf), one_item, catalog(spark, sf))


@query("F19_apply_reviews", with_sql(ITEMS, CATALOG, REVIEWS, body="""
SELECT request_item_id, decision, settled_product_id, reviewer FROM resolved"""))
def f19(spark, sf):
    return _resolved(spark, sf).select("request_item_id", "decision", "settled_product_id", "reviewer")


@query("F19_reviewed_items", with_sql(ITEMS, CATALOG, REVIEWS, """last_review AS (
  SELECT request_item_id, arg_max({'d': decision, 'p': settled_product_id, 'r': reviewer}, {'a': at_, 'r': reviewer}) AS v FROM resolved GROUP BY 1)""", body="""
SELECT i.request_item_id, CASE WHEN v IS NOT NULL THEN v.d ELSE final_decision END AS final_decision,
  CASE WHEN v IS NOT NULL THEN v.r ELSE reviewed_by END AS reviewed_by
FROM one_item i LEFT JOIN last_review USING (request_item_id)"""))
def f19_items(spark, sf):
    return V.apply_reviews(items(spark, sf).dropDuplicates(["request_item_id"]), _resolved(spark, sf)).select(
        "request_item_id", "final_decision", "reviewed_by"
    )


# every event is a claim on a user's case: who acts first owns it
@query("F20_review_conflicts", """
WITH claims AS (SELECT 'case' || user_id AS request_item_id, event_type AS reviewer, CAST(ts AS TIMESTAMP) AS at_ FROM events)
SELECT request_item_id, reviewer, count(*) AS refused FROM claims c
WHERE reviewer <> (SELECT arg_min(reviewer, at_) FROM claims f WHERE f.request_item_id = c.request_item_id)
GROUP BY ALL""")
def f20(spark, sf):
    claims = table(spark, sf, "events").select(
        F.concat(F.lit("case"), text("user_id")).alias("request_item_id"), F.col("event_type").alias("reviewer"), F.col("ts").alias("at")
    )
    stored = spark.createDataFrame([], "request_item_id string, final_decision string, reviewed_by string")
    _, refused = V.first_reviewer(claims, stored)
    return refused.groupBy("request_item_id", "reviewer").agg(F.count("*").alias("refused"))


@query("F21_golden_labels", with_sql(ITEMS, CATALOG, REQUESTS, REVIEWS, body="""
SELECT raw_text AS raw_query, normalized_text AS normalized_query, supplier_id, settled_product_id AS product_id,
  CASE WHEN decision IN ('accepted', 'corrected') THEN 'positive' ELSE 'negative' END AS label_type, 'review' AS source
FROM resolved LEFT JOIN requests USING (request_id)"""))
def f21(spark, sf):
    return V.golden_labels(_resolved(spark, sf), requests(spark, sf))


@query("F22_derived_aliases", with_sql(ITEMS, CATALOG, REVIEWS, body="""
SELECT settled_product_id AS product_id, raw_text AS alias_text, lower(raw_text) AS normalized_alias_text,
  'user_added' AS alias_type, reviewer AS created_by FROM resolved WHERE create_alias AND settled_product_id <> ''"""))
def f22(spark, sf):
    return V.derived_aliases(_resolved(spark, sf))


@query("F23_derived_mappings", with_sql(ITEMS, CATALOG, REQUESTS, REVIEWS, body="""
SELECT supplier_id, raw_text AS supplier_raw_text, lower(raw_text) AS normalized_supplier_text,
  arg_max(settled_product_id, {'a': at_, 'i': request_item_id}) AS product_id, 'approved' AS mapping_type,
  nullif(arg_max(confidence, {'a': at_, 'i': request_item_id}), 0) AS confidence,
  arg_max(reviewer, {'a': at_, 'i': request_item_id}) AS approved_by
FROM resolved JOIN requests USING (request_id) WHERE create_supplier_mapping AND settled_product_id <> ''
GROUP BY supplier_id, raw_text"""))
def f23(spark, sf):
    return V.derived_mappings(_resolved(spark, sf), requests(spark, sf))


@query("F24_entered_mappings", with_sql(MAPPINGS, body="""
SELECT mapping_id, product_id, supplier_raw_text, lower(supplier_raw_text) AS normalized_supplier_text FROM mappings"""))
def f24(spark, sf):
    rows = mappings(spark, sf).select("mapping_id", "product_id", "supplier_raw_text")
    return V.mappings_from_input(rows).select("mapping_id", "product_id", "supplier_raw_text", "normalized_supplier_text")


def _audit(spark, sf):
    return table(spark, sf, "events").select(
        text("event_id").alias("log_id"), F.col("event_type").alias("action"), F.lit("user").alias("entity_type"),
        text("user_id").alias("user_id"), F.col("ts").cast("timestamp").alias("created_at"),
    )


@query("F25_audit_list", """
SELECT CAST(event_id AS VARCHAR) AS log_id, event_type AS action, count(*) OVER () AS total FROM events
WHERE event_type = 'signup' ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 50 OFFSET 20""")
def f25(spark, sf):
    return R.audit_page(_audit(spark, sf), 20, 50, action="signup", entity_type="user").select("log_id", "action", "total")


@query("F26_result_search", with_sql(ITEMS, body="""
SELECT request_item_id, raw_text FROM items
WHERE (contains(lower(raw_text), 'line 12') OR contains(lower(normalized_text), 'line 12')) AND final_decision IS NULL"""))
def f26(spark, sf):
    return R.search_results(items(spark, sf), "Line 12", "pending").select("request_item_id", "raw_text")


@query("F27_label_composition", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def f27(spark, sf):
    return R.golden_composition(table(spark, sf, "labels"), ["quality", "toxic"])


@query("F28_recoverable_requests", with_sql(REQUESTS, body="""
SELECT request_id, status, job_name FROM requests WHERE status IN ('pending', 'queued', 'running') AND job_name IN ('batch_match', 'smart_upload')"""))
def f28(spark, sf):
    return R.recoverable_requests(requests(spark, sf)).select("request_id", "status", "job_name")


@query("F29_supplier_list", "SELECT 'S' || s_suppkey AS supplier_id, s_name AS supplier_name FROM supplier WHERE s_acctbal > 0")
def f29(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), text("s_suppkey")).alias("supplier_id"), F.col("s_name").alias("supplier_name"), (F.col("s_acctbal") > 0).alias("is_active")
    )
    return M.list_suppliers(suppliers).drop("is_active")


@query("F29_mapping_list", with_sql(MAPPINGS, body="""
SELECT mapping_id, product_id FROM mappings WHERE supplier_id = 'S3' ORDER BY created_at DESC, mapping_id LIMIT 50 OFFSET 10"""))
def f29_mappings(spark, sf):
    return M.list_mappings(mappings(spark, sf), "S3", 50, 10).select("mapping_id", "product_id")


@query("F30_request_lifecycle", """
WITH c AS (SELECT 'R' || user_id AS request_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'queued' END AS status, CAST(ts AS TIMESTAMP) AS at_ FROM events),
t AS (SELECT request_id, arg_max(status, at_) AS status, max(at_) FILTER (status IN ('pending', 'queued')) AS w,
  max(at_) FILTER (status = 'running') AS r, max(at_) FILTER (status IN ('done', 'failed')) AS e FROM c GROUP BY 1)
SELECT request_id, status, epoch_us(CASE WHEN w IS NULL OR r > w THEN r END) AS started_at,
  epoch_us(CASE WHEN greatest(w, r) IS NULL OR e > greatest(w, r) THEN e END) AS finished_at FROM t""")
def f30(spark, sf):
    kind = F.col("event_type")
    changes = table(spark, sf, "events").select(
        F.concat(F.lit("R"), text("user_id")).alias("request_id"),
        F.when(kind == "view", "pending").when(kind == "click", "running").when(kind == "purchase", "done").when(kind == "error", "failed").otherwise("queued").alias("status"),
        F.col("ts").cast("timestamp").alias("at"),
    )
    return R.request_lifecycle(changes).select("request_id", "status", seconds("started_at"), seconds("finished_at"))


@query("F31_review_progress", with_sql(ITEMS, body="""
SELECT request_id, count(*) AS total, count(final_decision) AS decided, round(count(final_decision) / count(*) * 100, 6) AS percent
FROM items GROUP BY request_id"""))
def f31(spark, sf):
    return V.review_progress(items(spark, sf), ["request_id"])


@query("F32_bulk_acceptance", with_sql(ITEMS, body="""
SELECT request_item_id, 'accepted' AS final_decision, best_product_id AS final_product_id, 'me' AS reviewer FROM items
WHERE status = 'auto_match' AND final_decision IS NULL"""))
def f32(spark, sf):
    return V.bulk_acceptance(items(spark, sf), "me", F.lit("2024-01-01").cast("timestamp")).drop("at")


@query("F33_mapping_search", with_sql(MAPPINGS, body="""
SELECT mapping_id, product_id FROM mappings WHERE contains(lower(supplier_raw_text), 'e 11') OR contains(lower(product_id), 'e 11') OR contains(lower(supplier_article), 'e 11')"""))
def f33(spark, sf):
    return M.search_mappings(mappings(spark, sf), " E 11 ").select("mapping_id", "product_id")


@query("F34_product_page", with_sql(CATALOG, body="""
SELECT product_id, name, CAST(greatest(ceil(count(*) OVER () / 50), 1) AS BIGINT) AS total_pages FROM catalog
WHERE is_active ORDER BY name, product_id LIMIT 50 OFFSET 50"""))
def f34(spark, sf):
    return R.products_page(catalog(spark, sf), "active", page=2).select("product_id", "name", "total_pages")


@query("F35_token_estimate", """
SELECT role, count(*) AS calls, CAST(sum(2 * len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS BIGINT) AS tokens
FROM conversations GROUP BY role""")
def f35(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("calls"), F.sum(R.estimated_embedding_tokens(F.col("text"))).alias("tokens")
    )


@query("F6_quality_gate_with_recall", with_sql(ITEMS, REQUESTS, ALL_METRICS, CANDIDATES, REPORTS, f"""latest AS (
  SELECT * FROM reports WHERE scope = 'all' ORDER BY created_at DESC, report_id DESC LIMIT 1),
recall AS (SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM candidates c WHERE c.request_item_id = i.request_item_id
  AND c.product_id = i.final_product_id AND c.retrieval_rank <= 3) THEN 1.0 ELSE 0.0 END), 4) AS top3_recall
  FROM items i WHERE final_decision IS NOT NULL AND final_product_id IS NOT NULL),
judged AS (SELECT {_A[0]} AS a, {_R[0]} AS r, {_P[0]} AS p, {_A[1]} AS ai, {_R[1]} AS ri, {_P[1]} AS pi FROM (SELECT * EXCLUDE (top3_recall) FROM metrics, (SELECT NULL AS top3_recall) LIMIT 1) m, recall, LATERAL (SELECT m.*, recall.top3_recall) c, latest b)""", body="""
SELECT a IS NULL AND r IS NULL AND p IS NULL AS passed, concat_ws('; ', a, r, p) AS regressions, concat_ws('; ', ai, ri, pi) AS improvements FROM judged"""))
def f6_recall(spark, sf):
    rows = items(spark, sf)
    metrics = R.with_recall(R.quality_metrics(rows, requests(spark, sf)), rows, _candidates(spark, sf))
    gate = R.quality_gate(metrics, _reports(spark, sf))
    return gate.select("passed", F.array_join("regressions", "; ").alias("regressions"), F.array_join("improvements", "; ").alias("improvements"))


@query("F35_rerank_estimate", """
WITH asked AS (SELECT conv_id, text AS q FROM conversations WHERE turn = 0),
told AS (SELECT conv_id, list(text) AS docs FROM conversations WHERE turn > 0 GROUP BY 1)
SELECT conv_id, CAST(len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) + list_sum(list_transform(docs, lambda d: len(list_filter(string_split_regex(d, '\\s+'), lambda w: w <> '')))) AS BIGINT) AS tokens
FROM asked JOIN told USING (conv_id)""")
def f35_rerank(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.filter("turn = 0").select("conv_id", F.col("text").alias("q"))
    told = turns.filter("turn > 0").groupBy("conv_id").agg(F.collect_list("text").alias("docs"))
    return asked.join(told, "conv_id").select("conv_id", R.estimated_rerank_tokens(F.col("q"), F.col("docs")).alias("tokens"))
