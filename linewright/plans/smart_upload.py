"""From a messy spreadsheet to matched lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.operators import catalog as C
from linewright.operators import grid
from linewright.options import MatchOptions
from linewright.plans.batch_match import MatchInputs, batch_match
from linewright.plans.ingest import items_as_catalog
from linewright.session import materialize


def smart_upload(cells: DataFrame, inputs: MatchInputs, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Add the reference tables of the sheets to the catalog, then match their supplier lines."""
    _, items = grid.analyze(cells)
    items = materialize(items, "sheet-items")
    added = C.transform_items(items_as_catalog(items)).withColumn("created_at", F.current_timestamp())
    merged = materialize(C.upsert(inputs.catalog, added, order="name"), "catalog")
    lines = items.filter("role = 'supplier_input'").select(
        F.concat_ws(":", "file_id", "sheet", F.col("region").cast("string"), "line_id").alias("line_id"),
        "raw_text",
        "original_row",
    )
    return batch_match(lines, MatchInputs(**{**inputs.__dict__, "catalog": merged, "index": None}), options)
