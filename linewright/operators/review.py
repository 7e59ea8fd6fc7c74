"""Human review: the queue, applying decisions, and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.operators import normalize as N
from linewright.operators.reporting import paged
from linewright.session import materialize


def review_queue(items: DataFrame, requests: DataFrame, supplier_id: str | None = None, page: int = 1, page_size: int = 50):
    """Undecided items that need review with their request, most confident first."""
    rows = items.filter("status = 'review_needed' and final_decision is null").join(
        requests.select("request_id", "supplier_id", "file_name"), "request_id"
    )
    if supplier_id:
        rows = rows.filter(F.col("supplier_id") == supplier_id)
    return paged(rows, [F.desc_nulls_first("confidence"), F.col("request_item_id")], page, page_size)


def first_reviewer(reviews: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split reviews into accepted ones and conflicts.

    An item belongs to whoever decided it first; later reviews by others are
    refused. ``reviews`` is ``(request_item_id, reviewer, at, ...)``; a
    decision already stored on the item counts as first.
    """
    stored = items.filter("final_decision is not null").select("request_item_id", F.col("reviewed_by").alias("_stored"))
    earliest = reviews.groupBy("request_item_id").agg(F.min_by("reviewer", F.struct("at", "reviewer")).alias("_first"))
    owned = reviews.join(earliest, "request_item_id").join(stored, "request_item_id", "left")
    mine = F.col("reviewer").eqNullSafe(F.coalesce("_stored", "_first"))
    return owned.filter(mine).drop("_first", "_stored"), owned.filter(~mine).drop("_first", "_stored")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The last review of each item."""
    fields = [c for c in reviews.columns if c != "request_item_id"]
    last = reviews.groupBy("request_item_id").agg(F.max_by(F.struct(*fields), F.struct("at", "reviewer")).alias("r"))
    return last.select("request_item_id", "r.*")


def resolve_reviews(reviews: DataFrame, items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reviews joined to their items with the final product settled.

    An acceptance without product takes the best one; a correction must name a
    catalog product. Reviews of unknown items and bad corrections drop out.
    The few products that corrections name are compared with the catalog first,
    so reviews need not move to their product.
    """
    reviews = _good_corrections(reviews.withColumnRenamed("final_decision", "decision"), catalog)
    item = items.select(
        "request_item_id", "request_id", "raw_text", "normalized_text", "best_product_id", "confidence", "status"
    )
    given = F.nullif(F.col("final_product_id"), F.lit(""))
    settled = F.when(F.col("decision") == "accepted", F.coalesce(given, F.col("best_product_id"))).otherwise(
        F.col("final_product_id")
    )
    rows = reviews.join(item, "request_item_id").withColumn("settled_product_id", settled)
    return rows.select("settled_product_id", *[c for c in rows.columns if c != "settled_product_id"])


def _good_corrections(reviews: DataFrame, catalog: DataFrame) -> DataFrame:
    """Reviews without the corrections to a product that the catalog does not have; no decision counts as one."""
    corrected = F.coalesce(F.col("decision") == "corrected", F.lit(True))
    named = corrected & F.coalesce(F.col("final_product_id") != "", F.lit(False))
    asked = reviews.filter(named).select(F.col("final_product_id").alias("_asked")).distinct()
    known = catalog.select(F.col("product_id").alias("_asked"))
    # written, so that Spark knows its size when it plans what follows
    unknown = materialize(asked.join(known, "_asked", "left_anti"), "unknown-products")
    corrections = reviews.filter(named).join(unknown, F.col("final_product_id") == F.col("_asked"), "left_anti")
    return corrections.unionByName(reviews.filter(~named))


def apply_reviews(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Items with the latest review written into their final columns."""
    last = latest_reviews(resolved.select("request_item_id", "decision", "settled_product_id", "reviewer", "at", "comment"))
    r = last.select(
        "request_item_id", F.col("decision").alias("_d"), F.col("settled_product_id").alias("_p"),
        F.col("reviewer").alias("_r"), F.col("at").alias("_a"), F.col("comment").alias("_c"),
    )
    done = F.col("_d").isNotNull()
    put = {
        "final_decision": F.when(done, F.col("_d")), "final_product_id": F.when(done, F.col("_p")),
        "reviewed_by": F.when(done, F.col("_r")), "reviewed_at": F.when(done, F.col("_a")),
        "review_notes": F.when(done & F.col("_c").isNotNull(), F.col("_c")),
    }
    joined = items.join(r, "request_item_id", "left")
    columns = []
    for c in items.columns:
        if c not in put:
            columns.append(F.col(c))
        elif c == "review_notes":
            columns.append(F.coalesce(put[c], F.col(c)).alias(c))
        else:
            columns.append(F.when(done, put[c]).otherwise(F.col(c)).alias(c))
    return joined.select(*columns)


def golden_labels(resolved: DataFrame, requests: DataFrame, source: str = "review") -> DataFrame:
    """Training labels: accepted and corrected are positive, rejected negative."""
    return resolved.join(requests.select("request_id", "supplier_id"), "request_id", "left").select(
        F.col("raw_text").alias("raw_query"),
        F.coalesce(F.nullif("normalized_text", F.lit("")), "raw_text").alias("normalized_query"),
        "supplier_id",
        F.col("settled_product_id").alias("product_id"),
        F.when(F.col("decision").isin("accepted", "corrected"), "positive").otherwise("negative").alias("label_type"),
        F.lit(source).alias("source"),
    )


def _normalized(rows: DataFrame) -> DataFrame:
    """Add the normalized form of ``raw_text``; each distinct text is worked on once."""
    texts = N.normalize(rows.select("raw_text").distinct(), "raw_text")
    texts = texts.select("raw_text", F.coalesce(F.nullif("n_text", F.lit("")), "raw_text").alias("_normalized"))
    return rows.join(texts, "raw_text", "left")


def _has_product() -> Column:
    return F.coalesce(F.col("settled_product_id") != "", F.lit(False))


def derived_aliases(resolved: DataFrame) -> DataFrame:
    """Aliases from reviews that ask for one."""
    rows = _normalized(resolved.filter(F.col("create_alias") & _has_product()))
    return rows.select(
        F.col("settled_product_id").alias("product_id"),
        F.col("raw_text").alias("alias_text"),
        F.col("_normalized").alias("normalized_alias_text"),
        F.lit("user_added").alias("alias_type"),
        F.col("reviewer").alias("created_by"),
    )


def derived_mappings(resolved: DataFrame, requests: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Approved mappings from reviews that ask for one; one per supplier and raw text.

    They are normalized where they are: moving all of them to their text, and
    making the texts by the same joins once more, costs more than to work on
    the text of several suppliers several times.
    """
    rows = resolved.filter(F.col("create_supplier_mapping") & _has_product()).join(
        requests.select("request_id", "supplier_id").filter("supplier_id is not null and supplier_id != ''"), "request_id"
    )
    last = rows.groupBy("supplier_id", "raw_text").agg(
        F.max_by(
            F.struct("settled_product_id", "confidence", "reviewer"), F.struct("at", "request_item_id")
        ).alias("r")
    )
    if existing is not None:
        taken = existing.select("supplier_id", F.col("supplier_raw_text").alias("raw_text")).distinct()
        last = last.join(taken, ["supplier_id", "raw_text"], "left_anti")
    return N.normalize(last, "raw_text").select(
        "supplier_id",
        F.col("raw_text").alias("supplier_raw_text"),
        F.coalesce(F.nullif("n_text", F.lit("")), "raw_text").alias("normalized_supplier_text"),
        F.col("r.settled_product_id").alias("product_id"),
        F.lit("approved").alias("mapping_type"),
        F.nullif(F.col("r.confidence").cast("double"), F.lit(0.0)).alias("confidence"),
        F.col("r.reviewer").alias("approved_by"),
    )


def mappings_from_input(rows: DataFrame) -> DataFrame:
    """Mappings entered by hand: the raw text, if any, is normalized."""
    texts = N.normalize(rows.select("supplier_raw_text").filter("supplier_raw_text != ''").distinct(), "supplier_raw_text")
    return rows.join(
        texts.select("supplier_raw_text", F.col("n_text").alias("normalized_supplier_text")), "supplier_raw_text", "left"
    )


def review_audit(resolved: DataFrame) -> DataFrame:
    """Audit rows of applied reviews."""
    return resolved.select(
        F.concat(F.lit("audit_"), F.md5(F.concat_ws("|", "request_item_id", "reviewer", F.col("at").cast("string")))).alias("log_id"),
        F.lit("review").alias("action"),
        F.lit("match_request_item").alias("entity_type"),
        F.col("request_item_id").alias("entity_id"),
        F.col("reviewer").alias("username"),
        F.to_json(F.struct("decision", F.col("settled_product_id").alias("final_product_id"))).alias("details"),
        F.col("at").alias("created_at"),
    )


def bulk_acceptance(items: DataFrame, reviewer: str, at: Column) -> DataFrame:
    """Review rows that accept every automatic, undecided match."""
    undecided = ~F.coalesce(F.col("final_decision") != "", F.lit(False))
    return items.filter((F.col("status") == "auto_match") & undecided).select(
        "request_item_id",
        F.lit("accepted").alias("final_decision"),
        F.col("best_product_id").alias("final_product_id"),
        F.lit(reviewer).alias("reviewer"),
        at.alias("at"),
    )


def review_progress(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    decided = F.count_if(F.coalesce(F.col("final_decision") != "", F.lit(False)))
    return items.groupBy(*(by or [])).agg(
        F.count("*").alias("total"),
        decided.alias("decided"),
        F.when(F.count("*") > 0, F.round(decided / F.count("*") * 100, 6)).otherwise(F.lit(0.0)).alias("percent"),
    )
