"""Counters, quality metrics, cost reports and listings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D

# --- fixed values: largest tolerated regressions ---
MAX_ACCURACY_DROP = 0.02
MAX_RECALL_DROP = 0.03
MAX_FALSE_POSITIVE_RISE = 0.01
IMPROVEMENT = 0.005
REQUEST_STATUS_ORDER = ["pending", "queued", "running", "done", "failed"]
# --- end of fixed values ---


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits))


# --- requests ---


def status_counters(items: DataFrame) -> DataFrame:
    """Items per request and status; anything but auto and review counts as no match."""
    auto, review = F.col("status") == "auto_match", F.col("status") == "review_needed"
    return items.groupBy("request_id").agg(
        F.count("*").alias("processed_items"),
        F.count_if(auto).alias("auto_matched_items"),
        F.count_if(review).alias("review_needed_items"),
        F.count_if(~F.coalesce(auto | review, F.lit(False))).alias("no_match_items"),
    )


def progress_percent(processed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(processed / total * 100 + 0.5)).otherwise(F.lit(0)).cast("long")


def list_requests(
    requests: DataFrame, status: str | None = None, supplier_id: str | None = None, created_after: str | None = None,
    page: int = 1, limit: int = 50,
) -> DataFrame:
    """A page of requests, newest first, each row with the total number of hits."""
    rows = requests
    if status and status != "all":
        rows = rows.filter(F.col("status") == status)
    if supplier_id and supplier_id != "all":
        rows = rows.filter(F.col("supplier_id") == supplier_id)
    if created_after is not None:
        rows = rows.filter(F.col("created_at") >= F.lit(created_after).cast("timestamp"))
    return paged(rows, [F.desc("created_at"), F.col("request_id")], page, limit)


def paged(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One page in the given order, with the total; sorts no more than the page needs."""
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit).withColumn("total", total)


def sort_requests(requests: DataFrame, needle: str = "", by: str = "status", ascending: bool = True) -> DataFrame:
    """Requests whose id contains ``needle``, in a custom order; unknown states go last."""
    needle = needle.strip().lower()
    rows = requests.filter(F.contains(F.lower("request_id"), F.lit(needle))) if needle else requests
    key = F.col(by)
    if by == "status":
        key = F.lit(99)
        for rank, name in enumerate(REQUEST_STATUS_ORDER):
            key = F.when(F.col("status") == name, rank).otherwise(key)
    return rows.withColumn("sort_key", key).orderBy(
        F.asc("sort_key") if ascending else F.desc("sort_key"), "request_id"
    )


def request_items(items: DataFrame, request_id: str, status: str | None = None, page: int = 1, page_size: int = 50):
    rows = items.filter(F.col("request_id") == request_id)
    if status:
        rows = rows.filter(F.col("status") == status)
    return paged(rows, [F.col("created_at"), F.col("request_item_id")], page, page_size)


def item_candidates(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates with product names; zero scores show as missing."""
    scores = ["lexical_score", "semantic_score", "rerank_score", "rules_score", "final_score"]
    return candidates.join(catalog.select("product_id", "name", "article", "brand"), "product_id").withColumns(
        {s: F.nullif(F.col(s).cast("double"), F.lit(0.0)) for s in scores if s in candidates.columns}
    )


def recoverable_requests(requests: DataFrame) -> DataFrame:
    return requests.filter(
        F.col("status").isin("pending", "queued", "running") & F.col("job_name").isin("batch_match", "smart_upload")
    )


def request_lifecycle(changes: DataFrame) -> DataFrame:
    """Current status and times per request from status changes ``(request_id, status, at)``.

    Going back to waiting clears both times, a new run clears the end.
    """
    latest = lambda *states: F.max(F.when(F.col("status").isin(*states), F.col("at")))
    times = changes.groupBy("request_id").agg(
        F.max_by("status", "at").alias("status"),
        latest("pending", "queued").alias("_reset"),
        latest("running").alias("_run"),
        latest("done", "failed").alias("_end"),
    )
    started = F.when(F.col("_reset").isNull() | (F.col("_run") > F.col("_reset")), F.col("_run"))
    cleared = F.greatest("_reset", "_run")
    finished = F.when(cleared.isNull() | (F.col("_end") > cleared), F.col("_end"))
    return times.select("request_id", "status", started.alias("started_at"), finished.alias("finished_at"))


def duplicate_lines(lines: DataFrame, text: str = "raw_text") -> DataFrame:
    """Texts that occur more than once, letter case aside."""
    return lines.groupBy(F.lower(text).alias("text_key")).agg(F.count("*").alias("n")).filter("n > 1")


def search_results(items: DataFrame, needle: str = "", review: str = "all") -> DataFrame:
    """Items whose raw or normalized text contains ``needle``, reviewed or still pending."""
    rows = items
    if needle.strip():
        wanted = F.lit(needle.lower())
        hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), wanted)
        rows = rows.filter(hit("raw_text") | hit("normalized_text"))
    decided = F.coalesce(F.col("final_decision") != "", F.lit(False))
    if review == "reviewed":
        rows = rows.filter(decided)
    elif review == "pending":
        rows = rows.filter(~decided)
    return rows


def products_page(catalog: DataFrame, status: str = "all", page: int = 1, page_size: int = 50) -> DataFrame:
    """A page of products by activity, with the number of pages."""
    rows = catalog if status == "all" else catalog.filter(F.col("is_active") == (status == "active"))
    pages = rows.agg(F.greatest(F.ceil(F.count("*") / page_size), F.lit(1)).cast("long")).scalar()
    page_rows = rows.orderBy("name", "product_id").offset((page - 1) * page_size).limit(page_size)
    return page_rows.withColumn("total_pages", pages)


def golden_composition(labels: DataFrame, by: list[str]) -> DataFrame:
    return labels.groupBy(*by).agg(F.count("*").alias("n"))


def audit_page(logs: DataFrame, page_offset: int = 0, limit: int = 50, **equal: str | None) -> DataFrame:
    """Audit rows that match the given fields, newest first, with the total."""
    rows = logs
    for column, value in equal.items():
        if value:
            rows = rows.filter(F.col(column) == value)
    total = rows.agg(F.count("*")).scalar()
    page_rows = rows.orderBy(F.desc("created_at"), "log_id").offset(page_offset).limit(limit)
    return page_rows.withColumn("total", total)


# --- quality ---


def quality_metrics(items: DataFrame, requests: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Quality of reviewed items, over all or per group of requests (for example per supplier).

    ``precision_at_1`` divides accepted items of any status by automatic ones,
    so it can exceed one.
    """
    by = by or []
    reviewed = items.filter("final_decision is not null").join(requests.select("request_id", *by), "request_id")
    decided, auto = F.col("final_decision"), F.col("status") == "auto_match"
    counts = reviewed.groupBy(*by).agg(
        F.count("*").alias("total_cases"),
        F.count_if(decided == "accepted").alias("_accepted"),
        F.count_if(auto).alias("_auto"),
        F.count_if(auto & decided.isin("corrected", "rejected")).alias("_wrong"),
    )
    latency = (
        requests.filter("finished_at is not null and started_at is not null")
        .groupBy(*by)
        .agg(F.avg((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000.0).alias("_latency"))
    )
    joined = counts.join(latency, by, "left") if by else counts.withColumn("_latency", latency.scalar())
    any_case = F.col("total_cases") > 0
    return joined.select(
        *by,
        "total_cases",
        share(F.col("_accepted"), F.col("total_cases")).alias("top1_accuracy"),
        share(F.col("_accepted"), F.col("_auto")).alias("precision_at_1"),
        share(F.col("_wrong"), F.col("_auto")).alias("auto_match_fp_rate"),
        share(F.col("_accepted"), F.col("total_cases")).alias("review_acceptance_rate"),
        F.when(any_case, F.round(F.nullif("_latency", F.lit(0.0)), 1)).alias("avg_latency_ms"),
    )


def top3_recall(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Share of reviewed items whose final product is among the first three candidates."""
    reviewed = items.filter("final_decision is not null and final_product_id is not null")
    top = (
        candidates.filter("retrieval_rank <= 3")
        .select("request_item_id", F.col("product_id").alias("final_product_id"), F.lit(1).alias("_hit"))
        .distinct()
    )
    hits = reviewed.join(top, ["request_item_id", "final_product_id"], "left")
    return hits.agg(
        F.count("*").alias("cases"), F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 4).alias("top3_recall")
    )


def with_recall(metrics: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Metrics of all items with their top-3 recall, as the quality gate reads them."""
    recall = top3_recall(items, candidates).select("top3_recall")
    kept = [c for c in metrics.columns if c != "top3_recall"]
    return metrics.select(*kept).withColumn("top3_recall", recall.scalar())


def quality_snapshot(metrics: DataFrame, report_id: str, scope: str, scope_value: str | None, at: Column) -> DataFrame:
    """Metrics as one report row, to be appended to the reports table."""
    return metrics.select(
        F.lit(report_id).alias("report_id"),
        F.lit(scope).alias("scope"),
        F.lit(scope_value).cast("string").alias("scope_value"),
        "*",
        at.alias("created_at"),
    )


def quality_history(reports: DataFrame, since: Column, scope: str = "all", scope_value: str | None = None):
    """Reports of a scope since a time, oldest first; zero rates show as missing."""
    rows = reports.filter((F.col("created_at") >= since) & (F.col("scope") == scope))
    if scope != "all":
        rows = rows.filter(F.col("scope_value") == scope_value)
    rates = ["top1_accuracy", "precision_at_1", "auto_match_fp_rate", "review_acceptance_rate"]
    return rows.withColumns({r: F.nullif(F.col(r), F.lit(0.0)) for r in rates if r in reports.columns}).orderBy(
        "created_at", "report_id"
    )


def quality_gate(current: DataFrame, reports: DataFrame) -> DataFrame:
    """One row ``passed, regressions, improvements``: current metrics against the latest full report.

    Without cases or without a report the gate passes. Zero rates of a report
    count as missing.
    """
    latest = reports.filter("scope = 'all'").agg(
        F.max_by(
            F.struct("top1_accuracy", "top3_recall", "auto_match_fp_rate"), F.struct("created_at", "report_id")
        ).alias("prev")
    )
    rows = current.withColumn("prev", latest.scalar())

    def percent(value: Column) -> Column:
        return F.concat(F.format_number(value * 100, 1), F.lit("%"))

    def judge(column: str, label: str, sign: int, verb: str, limit: float):
        now = F.col(column) if column in current.columns else F.lit(None).cast("double")
        before = F.nullif(F.col(f"prev.{column}").cast("double"), F.lit(0.0))
        worse = (before - now) * sign
        active = (F.col("total_cases") > 0) & F.col("prev").isNotNull() & worse.isNotNull()
        text = F.concat(
            F.lit(f"{label} {verb} "), percent(worse), F.lit(" (prev="), percent(before), F.lit(", now="), percent(now),
            F.lit(")"),
        )
        better = F.concat(F.lit(f"{label} improved by "), percent(-worse))
        return F.when(active & (worse > limit), text), F.when(active & (worse < -IMPROVEMENT), better)

    judged = [
        judge("top1_accuracy", "Top-1 accuracy", 1, "dropped", MAX_ACCURACY_DROP),
        judge("top3_recall", "Top-3 recall", 1, "dropped", MAX_RECALL_DROP),
        judge("auto_match_fp_rate", "FP rate", -1, "increased", MAX_FALSE_POSITIVE_RISE),
    ]
    return rows.select(
        F.array_compact(F.array(*[bad for bad, _ in judged])).alias("regressions"),
        F.array_compact(F.array(*[good for _, good in judged])).alias("improvements"),
    ).select((F.size("regressions") == 0).alias("passed"), "regressions", "improvements")


# --- tokens ---


def with_cost(
    calls: DataFrame,
    prices: dict[str, tuple[float, float]] = D.TOKEN_PRICES,
    default: tuple[float, float] = D.DEFAULT_TOKEN_PRICE,
) -> DataFrame:
    """Add ``estimated_cost_usd``: the exact model's price, else the first whose name overlaps, else the default.

    The price list is a constant, so this is a projection without any join.
    """
    rows = [{"model": m, "prompt": p, "completion": c} for m, (p, c) in prices.items()]
    listed = F.from_json(F.lit(json.dumps(rows)), "array<struct<model: string, prompt: double, completion: double>>")
    model = F.col("model")
    exact = F.filter(listed, lambda p: p["model"] == model)
    close = F.filter(listed, lambda p: F.contains(model, p["model"]) | F.contains(p["model"], model))
    known = F.get(F.concat(exact, close), F.lit(0))
    priced = calls.withColumn("_price", known)
    prompt = F.coalesce("_price.prompt", F.lit(default[0]))
    completion = F.coalesce("_price.completion", F.lit(default[1]))
    # prices are per million tokens, so the sum is in millionths of a dollar
    micros = F.round(F.col("prompt_tokens") * prompt + F.col("completion_tokens") * completion, 4)
    return priced.withColumn("estimated_cost_usd", F.round(micros) / 1_000_000).drop("_price")


def token_log(calls: DataFrame, prices: dict[str, tuple[float, float]] = D.TOKEN_PRICES) -> DataFrame:
    """Log rows of calls: a missing total is the sum of prompt and completion."""
    filled = calls.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("prompt_tokens", "completion_tokens")})
    filled = filled.withColumn(
        "total_tokens", F.coalesce("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    )
    return with_cost(filled, prices).withColumn("estimated_cost_usd", F.col("estimated_cost_usd").cast("decimal(12,6)"))


def _recent(log: DataFrame, since: Column | None, provider: str | None) -> DataFrame:
    rows = log if since is None else log.filter(F.col("created_at") >= since)
    return rows.filter(F.col("provider") == provider) if provider else rows


def token_totals(log: DataFrame, since: Column | None = None, provider: str | None = None) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return _recent(log, since, provider).agg(
        total("prompt_tokens").alias("prompt_tokens"),
        total("completion_tokens").alias("completion_tokens"),
        total("total_tokens").alias("total_tokens"),
        total("estimated_cost_usd").alias("total_cost_usd"),
        F.count("*").alias("api_calls"),
    )


def tokens_by(log: DataFrame, keys: list[str], since: Column | None = None, provider: str | None = None) -> DataFrame:
    return _recent(log, since, provider).groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("estimated_cost_usd").alias("cost_usd"),
        F.count("*").alias("calls"),
    )


def token_summary(log: DataFrame, since: Column | None = None) -> DataFrame:
    """All four breakdowns in one pass over the log: total, provider, provider/model/operation, day."""
    rows = _recent(log, since, None).withColumn("day", F.to_date("created_at"))
    return rows.groupingSets(
        [[], [F.col("provider")], [F.col("provider"), F.col("model"), F.col("operation")], [F.col("day")]],
        F.col("provider"), F.col("model"), F.col("operation"), F.col("day"),
    ).agg(
        F.grouping_id().alias("breakdown"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("estimated_cost_usd").alias("cost_usd"),
        F.count("*").alias("calls"),
    )


def tokens_daily(log: DataFrame, since: Column | None = None) -> DataFrame:
    return _recent(log, since, None).groupBy(F.to_date("created_at").alias("date")).agg(
        F.sum("total_tokens").alias("total_tokens"), F.sum("estimated_cost_usd").alias("cost_usd")
    ).orderBy("date")


def usage_bars(grouped: DataFrame) -> DataFrame:
    """Average tokens per call and each row's width relative to the largest, in percent."""
    most = grouped.agg(F.greatest(F.max("total_tokens"), F.lit(1))).scalar()
    return (
        grouped.withColumn("_most", most)
        .withColumn("avg_tokens", F.floor(F.col("total_tokens") / F.col("calls") + 0.5).cast("long"))
        .withColumn("width_pct", F.round(F.col("total_tokens") / F.col("_most") * 100, 6))
        .drop("_most")
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")).cast("long")


def estimated_embedding_tokens(text: Column) -> Column:
    """Two tokens per word, for calls that report none."""
    return word_count(text) * 2


def estimated_rerank_tokens(query: Column, documents: Column) -> Column:
    """One token per word of the query and of all its documents."""
    words = F.transform(F.coalesce(documents, F.array().cast("array<string>")), word_count)
    return word_count(query) + F.aggregate(words, F.lit(0).cast("long"), lambda total, n: total + n)
