"""Catalog pages exported by an ERP system as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D

OBJECT = "map<string,string>"


def page_rows(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per record of ``{"value": []}``, ``{"d": {"results": []}}`` or bare array pages.

    Adds ``record``, the JSON text of each; other columns stay.
    """
    text = F.col(body)
    wrapped = F.get_json_object(text, "$.value")
    nested = F.get_json_object(text, "$.d.results")
    bare = F.when(F.startswith(F.ltrim(text), F.lit("[")), text)
    items = F.from_json(F.coalesce(bare, wrapped, nested), "array<string>")
    return pages.select(*[c for c in pages.columns if c != body], F.explode(items).alias("record"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of all landed page files under ``path``; one file is one bounded page."""
    return page_rows(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


def _value(fields: Column, key: str) -> Column:
    return F.nullif(F.nullif(fields[key], F.lit("")), F.lit("null"))


def _first(fields: Column, keys: list[str]) -> Column:
    return F.coalesce(*[_value(fields, k) for k in keys])


def _described(value: Column) -> Column:
    """A reference object shows its description."""
    is_object = F.startswith(F.ltrim(value), F.lit("{"))
    return F.when(
        is_object,
        F.coalesce(F.get_json_object(value, "$.Description"), F.get_json_object(value, "$.Наименование"), value),
    ).otherwise(value)


def _number(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit(".")).try_cast("double")


def map_records(records: DataFrame, paths: DataFrame | None = None, record: str = "record") -> DataFrame:
    """Records as raw catalog items.

    Deleted rows, folders and rows without name drop out. Each field takes the
    first filled of its known keys; keys unknown to all fields are kept in
    ``extra``. The parent's path comes from ``paths``; without that table the
    parent key itself stands in.
    """
    rows = records.withColumn("_f", F.from_json(F.col(record), OBJECT))
    fields = F.col("_f")
    flagged = lambda k: F.coalesce(F.lower(fields[k]) == "true", F.lit(False))
    rows = rows.filter(~flagged("DeletionMark") & ~flagged("IsFolder"))
    known = [k for keys in D.ERP_FIELDS.values() for k in keys] + D.ERP_SYSTEM_FIELDS
    picked = {f: _first(fields, keys) for f, keys in D.ERP_FIELDS.items()}
    out = {f: F.trim(v) for f, v in picked.items()}
    for f in ("brand", "manufacturer", "unit"):
        out[f] = F.trim(_described(picked[f]))
    for f in ("weight_value", "volume_value"):
        out[f] = _number(picked[f])
    out["onec_ref"], out["category_id"] = picked["onec_ref"], picked["category_id"]
    listed = F.array(*[F.lit(k) for k in known])
    items = rows.select(
        *[c for c in records.columns if c != record],
        picked["onec_ref"].alias("product_id"),
        *[v.alias(f) for f, v in out.items()],
        F.map_filter(fields, lambda k, v: ~F.array_contains(listed, k)).alias("extra"),
    ).filter("name != ''")
    parent = F.nullif(F.col("category_id"), F.lit(D.EMPTY_REFERENCE))
    if paths is None:
        return items.withColumn("category_path", parent)
    joined = items.join(paths.select("category_id", F.col("path").alias("_path")), "category_id", "left")
    return joined.withColumn("category_path", F.when(parent.isNotNull(), F.coalesce("_path", F.lit("")))).drop("_path")
