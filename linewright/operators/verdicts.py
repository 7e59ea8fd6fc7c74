"""Prompts for, and verdicts from, an external language model, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions.text import let
from linewright.operators.scans import running_position

DASH = "—"
VERDICT_SCHEMA = (
    "array<struct<item_index int, product_id string, confidence double, reasoning string, "
    "alternatives array<struct<product_id string, confidence double, reasoning string>>>>"
)


def _or_dash(column: str) -> Column:
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(DASH))


def catalog_line() -> Column:
    """One row of the catalog table in a prompt."""
    return F.concat_ws(
        " | ", "product_id", "name", *[_or_dash(c) for c in ("article", "brand", "unit", "category_path")]
    )


def item_line() -> Column:
    """One numbered line of a batch prompt, from ``item_index raw_text brand article numbers unit``."""
    numbers = F.array_join(F.transform("numbers", lambda n: n.cast("string")), ", ")
    numbers = F.coalesce(F.nullif(numbers, F.lit("")), F.lit(DASH))
    return F.concat(
        F.col("item_index").cast("string"), F.lit('. "'), "raw_text", F.lit('" (бренд='), _or_dash("brand"),
        F.lit(", артикул="), _or_dash("article"), F.lit(", числа="), numbers, F.lit(", ед.изм="), _or_dash("unit"),
        F.lit(")"),
    )


def batch_prompts(items: DataFrame) -> DataFrame:
    """Lines of each ``(request_id, batch)`` joined in item order; batches are bounded by packing."""
    rows = items.withColumn("line", item_line())
    return rows.groupBy("request_id", "batch").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("item_index", "line"))), lambda x: x["line"]), "\n"
        ).alias("items_list"),
        F.count("*").alias("items"),
    )


def pack_batches(
    items: DataFrame,
    system_chars: int,
    min_batch: int = 1,
    budget: int = 100_000,
    order: str = "position",
) -> DataFrame:
    """Add ``batch`` and ``item_index``: consecutive items that fit one prompt.

    Three characters count as a token, 40 tokens are added per line and the
    catalog table takes ``system_chars`` of the budget. Items are
    ``(request_id, position, raw_text)`` and are numbered without gaps.
    """
    sizes = items.groupBy("request_id").agg(
        F.count("*").alias("_n"), F.sum(F.length(F.coalesce("raw_text", F.lit("")))).alias("_chars")
    )
    per_item = F.greatest(F.lit(80), F.floor(F.col("_chars") / F.col("_n")))
    tokens = F.floor(per_item / 3) + 40
    fitting = F.greatest(F.lit(1), F.floor((F.lit(budget) - F.lit(system_chars // 3)) / tokens))
    size = F.greatest(F.lit(min_batch), F.least(fitting, F.col("_n"))).cast("long")
    numbered = running_position(items, ["request_id"], order, "_at")
    return (
        numbered.join(sizes.withColumn("_size", size), "request_id")
        .withColumn("batch", F.floor((F.col("_at") - 1) / F.col("_size")))
        .withColumn("item_index", F.pmod(F.col("_at") - 1, F.col("_size")).cast("int"))
        .drop("_n", "_chars", "_size", "_at")
    )


def clean_reply(reply: Column) -> Column:
    """Undo the usual damage in a model's JSON: fences, trailing commas, a cut-off end."""
    text = F.trim(reply)
    fenced = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^```json", ""), r"(?s)```(?!.*```).*$", ""))
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", ""))
    text = F.when(F.startswith(text, F.lit("```json")), fenced).when(F.startswith(text, F.lit("```")), plain).otherwise(text)
    text = F.regexp_replace(text, r",\s*([}\]])", "$1")

    def close(t: Column) -> Column:
        cut = F.regexp_extract(t, r"(?s)^(.+[}\]])", 1)
        opens, closes = F.regexp_count(cut, F.lit(r"\[")), F.regexp_count(cut, F.lit(r"\]"))
        return (
            F.when(t.rlike(r"(?s)[}\]]$") | (t == "") | (cut == ""), t)
            .when(opens > closes, F.concat(cut, F.lit("]")))
            .otherwise(cut)
        )

    return let(text, close)


def parse_verdicts(replies: DataFrame, keys: list[str], size: str = "items") -> DataFrame:
    """Verdicts of batch replies: one row per entry whose index lies in the batch.

    ``replies`` holds ``keys``, ``reply`` and the number of items sent. Replies
    that are not a JSON array give no rows; a repeated index keeps its last entry.
    """
    parsed = replies.withColumn("_v", F.from_json(clean_reply(F.col("reply")), VERDICT_SCHEMA))
    entries = parsed.select(*keys, size, F.posexplode("_v").alias("_at", "v")).filter("v is not null")
    index = F.coalesce("v.item_index", F.lit(-1))
    return (
        entries.filter((index >= 0) & (index < F.col(size)))
        .groupBy(*keys, F.col("v.item_index").alias("item_index"))
        .agg(F.max(F.struct("_at", "v")).alias("last"))
        .select(
            *keys,
            "item_index",
            "last.v.product_id",
            F.coalesce("last.v.confidence", F.lit(0.0)).alias("confidence"),
            F.coalesce("last.v.reasoning", F.lit("")).alias("reasoning"),
            F.coalesce("last.v.alternatives", F.array()).alias("alternatives"),
        )
    )


def resolve_ids(verdicts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Map the ids a model returned to products: exact, then as a suffix, then with ``prd_``.

    The suffix step is an equality join too: ids are offered under each of
    their endings, but only endings as long as some returned id. Adds
    ``resolved_id``, null when nothing fits.
    """
    wanted = verdicts.select("product_id").filter("product_id is not null and product_id != ''").distinct()
    ids = catalog.filter("is_active").select(F.col("product_id").alias("id")).distinct()
    exact = wanted.join(ids, F.col("product_id") == F.col("id")).select("product_id", F.lit(1).alias("step"), "id")
    open_ids = wanted.join(exact, "product_id", "left_anti")
    # one row with the distinct lengths of the open ids
    lengths = open_ids.agg(F.collect_set(F.length("product_id")).alias("lengths"))
    shorter = F.filter("lengths", lambda n: n < F.length("id"))
    endings = ids.join(F.broadcast(lengths)).select(
        "id", F.explode(F.transform(shorter, lambda n: F.right(F.col("id"), n))).alias("product_id")
    )
    suffix = open_ids.join(endings, "product_id").select("product_id", F.lit(2).alias("step"), "id")
    prefixed = (
        open_ids.filter(~F.startswith("product_id", F.lit("prd_")))
        .join(ids, F.concat(F.lit("prd_"), "product_id") == F.col("id"))
        .select("product_id", F.lit(3).alias("step"), "id")
    )
    best = exact.union(suffix).union(prefixed).groupBy("product_id").agg(F.min(F.struct("step", "id")).alias("b"))
    return verdicts.join(best.select("product_id", F.col("b.id").alias("resolved_id")), "product_id", "left")


def named_alternatives(verdicts: DataFrame, catalog: DataFrame, limit: int = 5) -> DataFrame:
    """``(line_id, alternatives)``: the first alternatives of a verdict with catalog names."""
    listed = verdicts.select("line_id", F.posexplode(F.slice("alternatives", 1, limit)).alias("at", "a"))
    named = listed.select("line_id", "at", F.col("a.product_id").alias("product_id"), "a").join(
        catalog.filter("is_active").select("product_id", "name", "article", "brand"), "product_id", "left"
    )
    entry = F.struct(
        "at",
        "product_id",
        F.coalesce("name", F.lit("")).alias("name"),
        "article",
        "brand",
        F.coalesce("a.confidence", F.lit(0.0)).alias("final_score"),
        F.array(F.coalesce("a.reasoning", F.lit(""))).alias("reasons"),
    )
    return named.groupBy("line_id").agg(F.sort_array(F.collect_list(entry)).alias("alternatives"))
