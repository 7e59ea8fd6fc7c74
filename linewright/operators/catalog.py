"""Building and refreshing the product catalog."""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D
from linewright.operators import normalize as N
from linewright.session import materialize

RAW_COLUMNS = {
    "product_id": "string", "onec_ref": "string", "code": "string", "article": "string", "name": "string",
    "full_name": "string", "brand": "string", "manufacturer": "string", "manufacturer_code": "string",
    "category_id": "string", "category_path": "string", "unit": "string", "packaging": "string",
    "size_value": "double", "size_unit": "string", "weight_value": "double", "weight_unit": "string",
    "volume_value": "double", "volume_unit": "string", "attributes": "map<string,string>",
    "extra": "map<string,string>",
}


def raw_items(df: DataFrame) -> DataFrame:
    """Bring any source to the raw item columns; missing ones become null.

    A catalog source is any function that returns such a DataFrame.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c).cast(t) if c in have else F.lit(None).cast(t)).alias(c)
            for c, t in RAW_COLUMNS.items()
        ],
        *[c for c in df.columns if c not in RAW_COLUMNS],
    )


def _filled(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(""))


def search_document() -> Column:
    """Filled key fields joined by bars: the text that retrieval reads."""
    rest = ["full_name", "brand", "article", "manufacturer", "manufacturer_code", "category_path"]
    return F.concat_ws(" | ", F.col("name"), *[_filled(c) for c in rest])


def _json_text(column: str) -> Column:
    """A JSON string literal of a text, or ``null``; non-ASCII stays readable."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col(column).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(F.col(column).isNull(), F.lit("null")).otherwise(F.replace(quoted, F.lit("\\/"), F.lit("/")))


def content_hash() -> Column:
    """First 16 hex digits of the SHA-256 of name, article, brand and code as sorted-key JSON."""
    body = F.concat(
        F.lit('{"article": '), _json_text("article"), F.lit(', "brand": '), _json_text("brand"),
        F.lit(', "code": '), _json_text("code"), F.lit(', "name": '), _json_text("name"), F.lit("}"),
    )
    return F.substring(F.sha2(body, 256), 1, 16)


def product_id(hash_column: str = "source_hash") -> Column:
    """A native id stays; file imports get one from the content, so reimports do not duplicate."""
    generated = F.coalesce(_filled("product_id").isNull() | F.startswith("product_id", F.lit("prd_")), F.lit(True))
    return F.when(_filled("onec_ref").isNull() & generated, F.concat(F.lit("prd_"), hash_column)).otherwise(
        F.col("product_id")
    )


def transform_items(raw: DataFrame) -> DataFrame:
    """Raw items as catalog rows: normalized texts, search document, content hash, stable id.

    Each distinct brand is normalized once and joined back.
    """
    items = N.normalize(raw_items(raw), "name")
    items = items.select(*raw_items(raw).columns, F.col("n_text").alias("normalized_name"))
    items = N.normalize(items, "full_name").select(*items.columns, F.col("n_text").alias("normalized_full_name"))
    brands = N.normalize(raw_items(raw).select("brand").filter("brand is not null and brand != ''").distinct(), "brand")
    brands = brands.select("brand", F.coalesce(_filled("n_brand"), "n_text").alias("normalized_brand"))
    return (
        items.join(brands, "brand", "left")
        .withColumn("normalized_full_name", F.when(_filled("full_name").isNotNull(), F.col("normalized_full_name")))
        .withColumn("search_document", search_document())
        .withColumn("source_hash", content_hash())
        .withColumn("product_id", product_id())
        .withColumn("is_active", F.lit(True))
    )


# --- tables ---


def upsert(base: DataFrame, new: DataFrame, key: str = "product_id", order: str | None = None) -> DataFrame:
    """``base`` with the rows of ``new`` replacing those of the same key.

    Of repeated keys in ``new`` the row with the highest ``order`` wins.
    """
    rows = new
    if order is not None:
        fields = [c for c in new.columns if c != key]
        rows = new.groupBy(key).agg(F.max_by(F.struct(*fields), F.col(order)).alias("_r")).select(key, "_r.*")
    rows = rows.select(*[c for c in rows.columns if c in base.columns])
    return base.join(rows.select(key), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def deduplicate(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep the earliest product per content hash; also ``(product_id, keep_id)`` of the dropped.

    An aggregate, not a window: copies of one product may be any share of the catalog.
    """
    earliest = catalog.filter("source_hash is not null").groupBy("source_hash").agg(
        F.min(F.struct("created_at", "product_id")).alias("first")
    )
    earliest = earliest.select("source_hash", F.col("first.product_id").alias("keep_id"))
    dropped = (
        catalog.join(earliest, "source_hash").filter(F.col("product_id") != F.col("keep_id"))
        .select("product_id", "keep_id")
    )
    return catalog.join(dropped.select("product_id"), "product_id", "left_anti"), dropped


def repoint(table: DataFrame, dropped: DataFrame, column: str) -> DataFrame:
    """Point references to dropped products at the product that was kept."""
    moved = dropped.select(F.col("product_id").alias(column), F.col("keep_id").alias("_keep"))
    return table.join(moved, column, "left").select(
        *[F.coalesce("_keep", column).alias(column) if c == column else F.col(c) for c in table.columns]
    )


def delete_with_children(parents: DataFrame, children: list[tuple[DataFrame, str]], keys: DataFrame, key: str):
    """Remove the parents listed in ``keys`` and all rows that refer to them."""
    gone = keys.select(key).distinct()
    kept = [
        child.join(gone.withColumnRenamed(key, column), column, "left_anti") for child, column in children
    ]
    return parents.join(gone, key, "left_anti"), kept


def valid_embeddings(embeddings: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Embeddings of the right width, and the rejected rest."""
    ok = F.coalesce(F.size("vector") == width, F.lit(False))
    return embeddings.filter(ok), embeddings.filter(~ok)


# --- categories ---


def category_paths(folders: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(category_id, path)`` from parent links ``(category_id, name, parent_id)``.

    One join per level. A chain ends at a root, or where it would come to a
    folder for the second time; with ``max_depth`` it ends after that many
    steps instead, cycles or not. The all-zero reference and unknown parents are
    roots.
    """
    nodes = folders.filter(F.col("category_id") != D.EMPTY_REFERENCE).select("category_id", "name", "parent_id")
    up = nodes.select(
        F.col("category_id").alias("_at"), F.coalesce("name", F.lit("")).alias("_name"), F.col("parent_id").alias("_next")
    )
    walk = nodes.select(
        "category_id",
        F.coalesce("name", F.lit("")).alias("path"),
        F.col("parent_id").alias("_at"),
        F.array("category_id").alias("_seen"),
    )
    done = []
    for depth in itertools.count():
        if max_depth is None:
            again = F.coalesce(F.array_contains("_seen", F.col("_at")), F.lit(False))
        else:
            again = F.lit(depth == max_depth)
        done.append(walk.filter(again).select("category_id", "path"))
        walk = walk.filter(~again)
        step = materialize(walk.join(up, "_at", "left"), "categories")
        done.append(step.filter("_next is null and _name is null").select("category_id", "path"))
        walk = step.filter("_name is not null").select(
            "category_id",
            F.concat_ws("/", "_name", "path").alias("path"),
            F.col("_next").alias("_at"),
            F.array_append("_seen", F.col("_at")).alias("_seen"),
        )
        if walk.isEmpty():
            break
    # ancestors without a name at the top leave no mark
    return reduce(DataFrame.unionByName, done).withColumn("path", F.regexp_replace("path", "^/+", ""))


# --- index upkeep ---


def changed_documents(catalog: DataFrame, indexed: DataFrame) -> DataFrame:
    """Products whose search document differs from the one last indexed."""
    digest = F.sha2(F.coalesce("search_document", F.lit("")), 256).alias("digest")
    return catalog.withColumn("digest", digest).join(
        indexed.select("product_id", "digest"), ["product_id", "digest"], "left_anti"
    )


def missing_embeddings(catalog: DataFrame, embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """Active products without a vector of this model and version."""
    have = embeddings.filter((F.col("embedding_model") == model) & (F.col("embedding_version") == version))
    return catalog.filter("is_active").join(have.select("product_id"), "product_id", "left_anti")


def new_index_version(versions: DataFrame, version: DataFrame) -> DataFrame:
    """Append a version and make it the only active one."""
    return versions.withColumn("is_active", F.lit(False)).unionByName(
        version.withColumn("is_active", F.lit(True)), allowMissingColumns=True
    )


def activate_index_version(versions: DataFrame, version_id: str) -> DataFrame:
    """Make a version the only active one; an unknown id changes nothing."""
    target = F.col("index_version_id") == version_id
    known = versions.filter(target).agg(F.count("*") > 0).scalar()
    return versions.withColumn("is_active", F.when(known, target).otherwise(F.col("is_active")))


def catalog_coverage(catalog: DataFrame, embeddings: DataFrame, versions: DataFrame) -> DataFrame:
    """One row: active products, embedded products, share in percent, active model."""
    total = catalog.filter("is_active").agg(F.count("*").alias("total_products"))
    embedded = embeddings.agg(F.count_distinct("product_id")).scalar()
    model = versions.filter("is_active").agg(
        F.max_by("embedding_model", F.struct("created_at", "index_version_id"))
    ).scalar()
    share = F.when(
        F.col("total_products") > 0, F.round(F.col("embedded_products") / F.col("total_products") * 100, 1)
    ).otherwise(F.lit(0.0))
    one_row = total.withColumn("embedded_products", embedded).withColumn("embedding_model", model)
    return one_row.withColumn("embedding_coverage_pct", share)


def active_catalog(catalog: DataFrame) -> DataFrame:
    """The matching columns of active products, by name."""
    columns = [
        "product_id", "name", "normalized_name", "article", "brand", "normalized_brand", "manufacturer_code",
        "category_id", "category_path", "unit", "packaging", "search_document",
    ]
    return catalog.filter("is_active").select(*columns).orderBy("name", "product_id")
