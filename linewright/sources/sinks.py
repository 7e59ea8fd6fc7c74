"""Writing results, logs and exports; tables are swapped whole or appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS_LABELS = {"auto_match": "Найдено", "review_needed": "На проверку", "no_match": "Не найдено"}
TEMPLATE_COLUMNS = ("Номенклатура.1", "Товар 1С")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions that ``df`` holds, so a rerun leaves no doubles."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def merge_results(items: DataFrame, results: DataFrame, key: str = "request_item_id") -> DataFrame:
    """Items with new result columns; a null never overwrites a value."""
    new = [c for c in results.columns if c != key]
    renamed = results.select(key, *[F.col(c).alias(f"_new_{c}") for c in new])
    joined = items.join(renamed, key, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in new else F.col(c) for c in items.columns],
        *[F.col(f"_new_{c}").alias(c) for c in new if c not in items.columns],
    )


def clear_results(items: DataFrame, candidates: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reset the items of the listed requests and drop their candidates."""
    reset = requests.select("request_id").distinct().withColumn("_reset", F.lit(True))
    marked = items.join(reset, "request_id", "left")
    is_reset = F.coalesce("_reset", F.lit(False))
    blank = {c: F.when(~is_reset, F.col(c)) for c in ("best_product_id", "confidence", "normalized_text") if c in items.columns}
    cleared = marked.withColumns({**blank, "status": F.when(is_reset, "no_match").otherwise(F.col("status"))})
    gone = marked.filter(is_reset).select("request_item_id")
    return cleared.drop("_reset"), candidates.join(gone, "request_item_id", "left_anti")


def audit_rows(events: DataFrame) -> DataFrame:
    """Audit rows with an id made from their content; missing details become an empty object."""
    content = [c for c in events.columns if c != "log_id"]
    return events.withColumn(
        "log_id", F.concat(F.lit("audit_"), F.md5(F.to_json(F.struct(*content))))
    ).withColumn("details", F.coalesce("details", F.lit("{}")))


def percent_text(confidence: Column) -> Column:
    return F.coalesce(
        F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%")), F.lit("—")
    )


def export_rows(results: DataFrame) -> DataFrame:
    """Result rows for download, each as ``(line_id, row map<string,string>)``.

    With an original row its columns stay and the template column, if there is
    one, takes the found name; otherwise a fixed set of columns is written.
    """
    label = F.col("status")
    for status, text in STATUS_LABELS.items():
        label = F.when(F.col("status") == status, text).otherwise(label)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    why = F.array_join("reasons", "; ")
    original = F.coalesce("original_row", F.create_map().cast("map<string,string>"))
    first, second = (F.map_contains_key(original, F.lit(c)) for c in TEMPLATE_COLUMNS)
    target = F.when(first, TEMPLATE_COLUMNS[0]).when(second, TEMPLATE_COLUMNS[1]).otherwise("Найдено в 1С (Товар)")
    added = F.create_map(
        target, text("name"),
        F.lit("Найдено в 1С (ID)"), text("best_product_id"),
        F.lit("Найдено в 1С (Артикул)"), text("article"),
        F.lit("Найдено в 1С (Бренд)"), text("brand"),
        F.lit("Уверенность"), percent_text(F.col("confidence")),
        F.lit("Статус"), label,
        F.lit("Причины"), why,
    )
    kept = F.map_filter(original, lambda k, v: ~F.map_contains_key(added, k))
    plain = F.create_map(
        F.lit("Строка"), text("line_id"),
        F.lit("Исходный текст"), text("raw_text"),
        F.lit("Нормализованный"), text("normalized_text"),
        F.lit("Статус"), label,
        F.lit("Уверенность"), percent_text(F.col("confidence")),
        F.lit("Найденный товар"), text("name"),
        F.lit("Артикул"), text("article"),
        F.lit("Бренд"), text("brand"),
        F.lit("ID товара"), text("best_product_id"),
        F.lit("Причины"), why,
    )
    return results.select(
        "line_id", F.when(F.size(original) > 0, F.map_concat(kept, added)).otherwise(plain).alias("row")
    )


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Write map rows as CSV files with the given columns."""
    rows.select(*[F.coalesce(F.col("row")[c], F.lit("")).alias(c) for c in columns]).write.csv(path, header=True)
