"""Catalog import and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.operators import catalog as C
from linewright.operators import segments


def split_import(raw: DataFrame, row: str = "row_number") -> tuple[DataFrame, DataFrame]:
    """Rows that can become products, and rejects with their error."""
    error = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "name is missing")
    judged = raw.withColumn("error", error)
    return judged.filter("error is null").drop("error"), judged.filter("error is not null").select(row, "error")


def import_summary(parsed: DataFrame, products: DataFrame, rejects: DataFrame, dry_run: bool = False) -> DataFrame:
    """One row: status, rows read, products written, number of errors and the first 20 of them."""
    read = parsed.agg(F.count("*").alias("parsed_count"))
    if dry_run:
        return read.select(F.lit("done").alias("status"), "parsed_count", F.lit(True).alias("dry_run"))
    written = products.agg(F.count_distinct("product_id")).scalar()
    errors = rejects.agg(F.count("*")).scalar()
    first = rejects.orderBy("row_number").limit(20).agg(F.sort_array(F.collect_list(F.struct("row_number", "error")))).scalar()
    summary = read.withColumn("upserted", written).withColumn("errors", errors)
    status = F.when((F.col("parsed_count") == 0) | (F.col("upserted") == 0), "failed").otherwise("done")
    message = F.when(F.col("parsed_count") == 0, "import produced 0 rows").when(
        F.col("upserted") == 0, "import produced 0 valid products"
    )
    return summary.withColumn("error_details", first).select(
        status.alias("status"), "parsed_count", "upserted", "errors", "error_details", message.alias("error")
    )


def import_catalog(base: DataFrame, raw: DataFrame) -> DataFrame:
    """The catalog after an import: transformed, repeats within the import removed, upserted.

    Of rows that end up with the same id the last one by ``row_number`` wins.
    """
    return C.upsert(base, C.transform_items(raw), order="row_number")


def items_as_catalog(items: DataFrame) -> DataFrame:
    """Catalog rows from the reference tables found in a spreadsheet."""
    return items.filter("role = 'catalog_reference'").select(
        F.col("raw_text").alias("name"), "unit", F.lit(None).cast("string").alias("product_id")
    )


def refresh_index(
    index: segments.Segments,
    catalog: DataFrame,
    versions: DataFrame,
    version: DataFrame,
    lexemes: DataFrame | None = None,
    merge_share: float = 0.25,
) -> tuple[segments.Segments, DataFrame]:
    """The index with what changed in one more segment, and the versions with the new one active.

    Segments are merged when those after the first hold more than ``merge_share`` of it.
    """
    index = segments.refresh(index, catalog, lexemes)
    if segments.share_of_deltas(index) > merge_share:
        index = segments.merge(index)
    return index, C.new_index_version(versions, version)
