"""Finding tables in messy spreadsheets, for many sheets in one job.

Input is ``cells(file_id, sheet, row, col, value)`` with positions from zero.
A sheet is as wide and as tall as its farthest cell; missing and null cells
are empty. Everything is grouped by sheet, row or column, and no sheet is ever
gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D
from linewright.functions.text import let
from linewright.session import materialize

SHEET = ["file_id", "sheet"]
REGION = [*SHEET, "region"]

# --- fixed values: shares, row counts and patterns of the detection rules ---
EMPTY_SHARE = 0.85
HEADER_ROWS, TITLE_ROWS, NAME_ROWS, SAMPLE_ROWS = 20, 3, 5, 20
NUMERIC_CELL = r"(?U)^-?\d+(?:[\.,]\d+)?\s*(?:руб|₽|шт|кг|л)?\.?$"
PLAIN_NUMBER = r"(?U)^-?\d+(?:[\.,]\d+)?\s*$"
TOTAL_ROW = r"(?iuU)^\s*(?:итого|всего|total|subtotal|сумма|итог)\b"
# a header row: known words, filled cells, variety, brevity against this mean length
HEADER_HIT, HEADER_CELL, HEADER_VARIETY, HEADER_BREVITY, HEADER_LENGTH = 5, 1.5, 3, 4, 15
SUPPLIER_PATTERNS = [
    (r"(?iuU)(?:номенклатура\s+клиента)\s*[=:–—-]\s*(.+)", 1),
    (r"(?iuU)(?:клиент|поставщик|заказчик)\s*[=:]\s*(.+)", 1),
    (r"(?iuU)(?:номенклатура\s+(?:клиента|поставщика))\s*[=:–—-]\s*(.+)", 1),
    (r"(?iuU)^(ООО|ОАО|АО|ИП|ЗАО)\s+.+", 1),
]
# --- end of fixed values ---


def _has_any(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return F.coalesce(hit, F.lit(False))


def sheet_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*SHEET).agg(
        (F.max("row") + 1).alias("height"),
        (F.max("col") + 1).alias("width"),
        F.count("value").alias("filled"),
    )


def best_sheets(cells: DataFrame) -> DataFrame:
    """Per file the sheet with the largest filled cells times rows; the first wins ties."""
    scored = sheet_sizes(cells).withColumn("score", F.col("filled") * F.col("height"))
    return scored.groupBy("file_id").agg(
        F.min_by(F.struct("sheet", "score"), F.struct(-F.col("score"), F.col("sheet"))).alias("b")
    ).select("file_id", "b.sheet", "b.score")


def _positions(sizes: DataFrame, extent: str, out: str) -> DataFrame:
    return sizes.select(*SHEET, "height", "width", F.explode(F.sequence(F.lit(0), F.col(extent) - 1)).alias(out))


def column_gaps(cells: DataFrame, threshold: float = EMPTY_SHARE) -> DataFrame:
    """Columns that are almost empty."""
    counts = cells.groupBy(*SHEET, "col").agg(F.count("value").alias("n"))
    columns = _positions(sheet_sizes(cells), "width", "col").join(counts, [*SHEET, "col"], "left")
    empty = (F.col("height") - F.coalesce("n", F.lit(0))) / F.col("height")
    return columns.filter(empty >= threshold).select(*SHEET, "col")


def row_gaps(cells: DataFrame, threshold: float = EMPTY_SHARE) -> DataFrame:
    """Rows that are almost empty."""
    counts = cells.groupBy(*SHEET, "row").agg(F.count("value").alias("n"))
    rows = _positions(sheet_sizes(cells), "height", "row").join(counts, [*SHEET, "row"], "left")
    empty = (F.col("width") - F.coalesce("n", F.lit(0))) / F.col("width")
    return rows.filter(empty >= threshold).select(*SHEET, "row")


def column_groups(cells: DataFrame) -> DataFrame:
    """Runs of columns between separator columns: ``(file_id, sheet, region, col_start, col_end)``."""
    gaps = column_gaps(cells).withColumn("gap", F.lit(1))
    columns = _positions(sheet_sizes(cells), "width", "col").join(gaps, [*SHEET, "col"], "left")
    across = Window.partitionBy(*SHEET).orderBy("col")  # the columns of one sheet
    runs = (
        columns.withColumn("island", F.sum(F.coalesce("gap", F.lit(0))).over(across))
        .filter("gap is null")
        .groupBy(*SHEET, "island")
        .agg(F.min("col").alias("col_start"), F.max("col").alias("col_end"))
    )
    order = Window.partitionBy(*SHEET).orderBy("col_start")
    return runs.withColumn("region", F.row_number().over(order)).select(*REGION, "col_start", "col_end")


def whole_sheets(cells: DataFrame) -> DataFrame:
    """Each sheet as a single region."""
    return sheet_sizes(cells).select(
        *SHEET, F.lit(1).alias("region"), F.lit(0).alias("col_start"), (F.col("width") - 1).alias("col_end")
    )


def region_cells(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Filled cells with the region their column belongs to."""
    spans = regions.withColumn("col", F.explode(F.sequence("col_start", "col_end")))
    return cells.filter("value is not null").join(spans, [*SHEET, "col"])


def header_scores(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Score of each of the first rows of a region as a header.

    Header words weigh most, then filled cells, variety and brevity; rows
    whose several cells are all equal are titles and get no score.
    """
    words = D.NAME_WORDS + D.UNIT_WORDS + D.PRICE_WORDS + D.ARTICLE_WORDS
    text = F.col("text")
    known = F.lit(False)
    for word in words:
        fits = (F.lit(float(len(word))) >= F.length(text) * 0.3) | (F.length(text) < 30)
        known = known | (F.contains(text, F.lit(word)) & fits)
    rows = (
        region_cells(cells.filter(F.col("row") < HEADER_ROWS), regions)
        .withColumn("text", F.lower(F.trim("value")))
        .withColumn("known", known)
        .groupBy(*REGION, "col_start", "col_end", "row")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("text").alias("variety"),
            F.count_if("known").alias("hits"),
            F.count_if(F.col("text") != "").alias("cells"),
            F.avg(F.length("text")).alias("mean_length"),
        )
        .filter("not (variety = 1 and n > 1)")
    )
    brevity = F.greatest(F.lit(0.0), 2.0 - F.col("mean_length") / HEADER_LENGTH)
    score = (
        F.col("hits") * HEADER_HIT
        + F.col("cells") * HEADER_CELL
        + F.col("variety") / F.col("n") * HEADER_VARIETY
        + brevity * HEADER_BREVITY
    )
    return rows.withColumn("score", F.round(score, 9))


def header_rows(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions with their ``header_row``: the best score, the first row on ties, row 0 without any."""
    best = header_scores(cells, regions).groupBy(*REGION).agg(
        F.min_by("row", F.struct(-F.col("score"), F.col("row"))).alias("_row")
    )
    return regions.join(best, REGION, "left").withColumn("header_row", F.coalesce("_row", F.lit(0))).drop("_row")


def column_types(cells: DataFrame, headed: DataFrame) -> DataFrame:
    """``(file_id, sheet, region, col, header, column_type)`` from header words or the first data rows."""
    columns = headed.withColumn("col", F.explode(F.sequence("col_start", "col_end")))
    data = cells.filter("value is not null").join(columns, [*SHEET, "col"])
    after = (F.col("row") > F.col("header_row")) & (F.col("row") <= F.col("header_row") + SAMPLE_ROWS)
    text = F.trim("value")
    sample = F.when(after & (text != ""), text)
    digits = F.replace(F.regexp_replace(sample, r"(?U)[^\d.,]", ""), F.lit(","), F.lit("."))
    number = F.when(sample.isNotNull(), F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0)))
    facts = data.groupBy(*REGION, "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.lower(text))).alias("header"),
        F.count(sample).alias("n"),
        F.count_if(sample.rlike(NUMERIC_CELL)).alias("numeric"),
        F.avg(number).alias("mean_value"),
        F.avg(F.length(sample)).alias("mean_length"),
        F.max(F.length(sample)).alias("longest"),
    )
    # an empty header cell reads as "nan", which holds none of the words
    header = F.coalesce("header", F.lit("nan"))
    by_content = (
        F.when(F.coalesce("n", F.lit(0)) == 0, "other")
        .when(F.col("numeric") / F.col("n") > 0.8, F.when(F.col("mean_value") > 10, "price").otherwise("number"))
        .when(F.col("mean_length") > 15, "name")
        .when(F.col("mean_length") < 5, F.when(F.col("longest") < 8, "unit").otherwise("article"))
        .otherwise("other")
    )
    kind = (
        F.when(_has_any(header, D.NAME_WORDS), "name")
        .when(_has_any(header, D.UNIT_WORDS), "unit")
        .when(_has_any(header, D.PRICE_WORDS), "price")
        .when(_has_any(header, D.ARTICLE_WORDS), "article")
        .otherwise(by_content)
    )
    return columns.join(facts, [*REGION, "col"], "left").select(*REGION, "col", "header", kind.alias("column_type"))


def longest_text_columns(cells: DataFrame, headed: DataFrame) -> DataFrame:
    """Per region the column with the longest mean text below the header; ties to the left."""
    data = region_cells(cells, headed).filter(F.col("row") > F.col("header_row"))
    means = data.groupBy(*REGION, "col").agg(F.avg(F.length("value")).alias("mean_length")).filter("mean_length > 0")
    return means.groupBy(*REGION).agg(
        F.min_by("col", F.struct(-F.col("mean_length"), F.col("col"))).alias("longest_col")
    )


def region_columns(cells: DataFrame, headed: DataFrame) -> DataFrame:
    """Regions with ``name_col unit_col price_col article_col``: the leftmost column of each type."""
    first = lambda kind: F.min(F.when(F.col("column_type") == kind, F.col("col")))
    typed = column_types(cells, headed).groupBy(*REGION).agg(
        first("name").alias("_name"), first("unit").alias("unit_col"),
        first("price").alias("price_col"), first("article").alias("article_col"),
    )
    return (
        headed.join(typed, REGION, "left")
        .join(longest_text_columns(cells, headed), REGION, "left")
        .withColumn("name_col", F.coalesce("_name", "longest_col", "col_start"))
        .drop("_name", "longest_col")
    )


def region_roles(cells: DataFrame, headed: DataFrame) -> DataFrame:
    """``(file_id, sheet, region, role)`` from hint words in the header and the titles above it."""
    near = (F.col("row") <= F.col("header_row")) & (F.col("row") >= F.col("header_row") - TITLE_ROWS)
    text = F.lower("value")
    hints = (
        region_cells(cells, headed)
        .filter(near)
        .groupBy(*REGION)
        .agg(
            F.max(_has_any(text, D.SUPPLIER_WORDS)).alias("supplier"),
            F.max(_has_any(text, D.CATALOG_WORDS)).alias("catalog"),
        )
    )
    # no word holds a blank, so looking at cells one by one equals looking at the joined text
    catalog = F.coalesce(~F.col("supplier") & F.col("catalog"), F.lit(False))
    return headed.join(hints, REGION, "left").select(
        *REGION, F.when(catalog, "catalog_reference").otherwise("supplier_input").alias("role")
    )


def supplier_name(text: Column) -> Column:
    """The name a title cell gives, by the first pattern that fits."""
    out = F.lit(None).cast("string")
    for pattern, group in reversed(SUPPLIER_PATTERNS):
        out = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group)).otherwise(out)
    return F.trim(F.trim(out), F.lit("\"'«»"))


def supplier_names(cells: DataFrame, headed: DataFrame) -> DataFrame:
    """``(file_id, sheet, region, supplier_name)``: the first hit in the rows above the header."""
    above = (F.col("row") < F.col("header_row")) & (F.col("row") >= F.col("header_row") - NAME_ROWS)
    named = region_cells(cells, headed).filter(above).withColumn("name", supplier_name(F.trim("value")))
    return named.filter("name is not null").groupBy(*REGION).agg(
        F.min_by("name", F.struct("row", "col")).alias("supplier_name")
    )


def _unique_headers(names: Column) -> Column:
    """Repeated headers get ``_1``, ``_2`` and so on."""
    return F.transform(
        names,
        lambda h, i: let(
            F.size(F.filter(F.slice(names, F.lit(1), i), lambda x: x == h)),
            lambda k: F.when(k > 0, F.concat(h, F.lit("_"), k.cast("string"))).otherwise(h),
        ),
    )


def _header_names(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """``(region, col, header)`` with unique names; empty header cells are called by position."""
    columns = regions.select(
        *REGION, "header_row", "col_start", F.explode(F.sequence("col_start", "col_end")).alias("col")
    )
    heads = cells.filter("value is not null").select(*SHEET, F.col("row").alias("header_row"), "col", "value")
    named = columns.join(heads, [*SHEET, "header_row", "col"], "left").withColumn(
        "name",
        F.coalesce(F.trim("value"), F.concat(F.lit("col_"), (F.col("col") - F.col("col_start")).cast("string"))),
    )
    listed = named.groupBy(*REGION, "col_start").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]).alias("names")
    )
    return listed.select(*REGION, "col_start", F.posexplode(_unique_headers(F.col("names"))).alias("at", "header")).select(
        *REGION, (F.col("col_start") + F.col("at")).alias("col"), "header"
    )


def _row_map(cells: Column) -> Column:
    """``map<header, value>`` of one row; of equal headers the last one counts."""
    last = F.filter(
        cells, lambda x: ~F.exists(cells, lambda y: (y["header"] == x["header"]) & (y["col"] > x["col"]))
    )
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["header"], x["value"])))


def usable_text(text: Column) -> Column:
    """Neither blank, a single character, a placeholder nor a total."""
    return (F.length(text) > 1) & ~F.lower(text).isin("nan", "none") & ~text.rlike(TOTAL_ROW)


def region_items(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Items of each region: text, unit, price and the original row, repeats dropped.

    ``regions`` carries ``col_start col_end header_row name_col unit_col
    price_col``. Of rows with the same text, letter case aside, the first stays.
    """
    regions = regions.filter((F.col("name_col") >= F.col("col_start")) & (F.col("name_col") <= F.col("col_end")))
    data = region_cells(cells, regions).filter(F.col("row") > F.col("header_row"))
    pick = lambda c: F.max(F.when(F.col("col") == F.col(c), F.trim("value")))
    rows = data.groupBy(*REGION, "row").agg(
        pick("name_col").alias("raw_text"), pick("unit_col").alias("unit"), pick("price_col").alias("price")
    )
    kept = rows.filter(usable_text(F.col("raw_text")))
    first = kept.groupBy(*REGION, F.lower("raw_text").alias("_key")).agg(
        F.min(F.struct("row", "raw_text", "unit", "price")).alias("r")
    ).select(*REGION, "r.*")
    noted = lambda c: F.when((F.col(c) != "") & ~F.lower(c).isin("nan", "none"), F.col(c))
    headers = _header_names(cells, regions)
    wide = (
        first.select(*REGION, "row")
        .join(headers, REGION)
        .join(cells.select(*SHEET, "row", "col", "value"), [*SHEET, "row", "col"], "left")
        .groupBy(*REGION, "row")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("col", "header", F.coalesce("value", F.lit("")).alias("value")))
            ).alias("cells")
        )
        .select(*REGION, "row", _row_map(F.col("cells")).alias("original_row"))
    )
    return first.join(wide, [*REGION, "row"]).select(
        *REGION,
        F.col("row").cast("string").alias("line_id"),
        "raw_text",
        noted("unit").alias("unit"),
        noted("price").alias("price"),
        "original_row",
    )


def target_columns(cells: DataFrame, headed: DataFrame) -> DataFrame:
    """Per sheet the column that holds the product text, when the sheet is one table.

    An exact phrase in the header wins, then a header word, then the densest
    text; the first column if no text is dense enough.
    """
    columns = headed.withColumn("col", F.explode(F.sequence("col_start", "col_end")))
    data = cells.filter("value is not null").join(columns, [*SHEET, "col"])
    text = F.nullif(F.trim("value"), F.lit(""))
    below = F.col("row") > F.col("header_row")
    sample = F.when(below, text)
    words = F.when(~sample.rlike(PLAIN_NUMBER), sample)
    facts = data.groupBy(*REGION, "col").agg(
        F.max(F.when(F.col("row") == F.col("header_row"), F.lower(F.trim("value")))).alias("header"),
        (F.count(words) / F.nullif(F.count(sample), F.lit(0)) * F.coalesce(F.avg(F.length(words)), F.lit(0.0))).alias("density"),
    )
    header = F.coalesce("header", F.lit(""))
    first = lambda hit: F.min(F.when(hit, F.col("col")))
    dense = F.min(F.when(F.col("density") > 1.5, F.struct(-F.round("density", 9), F.col("col"))))
    picked = facts.groupBy(*REGION).agg(
        first(_has_any(header, D.TARGET_PHRASES)).alias("phrase"),
        first(_has_any(header, D.NAME_WORDS)).alias("word"),
        dense.alias("dense"),
    )
    return headed.join(picked, REGION, "left").select(
        *REGION, "col_start", "col_end", "header_row",
        F.coalesce("phrase", "word", F.col("dense")["col"], "col_start").alias("name_col"),
    )


def single_table_items(cells: DataFrame) -> DataFrame:
    """Items of sheets read as one table."""
    headed = header_rows(cells, whole_sheets(cells))
    none = F.lit(None).cast("int")
    regions = target_columns(cells, headed).withColumn("unit_col", none).withColumn("price_col", none)
    return region_items(cells, regions).drop("unit", "price")


def column_index(letters: Column) -> Column:
    """Zero-based index of a column letter such as ``A`` or ``AB``."""
    chars = F.filter(F.split(F.upper(F.trim(letters)), ""), lambda c: c != "")
    return F.when(
        letters.isNotNull() & (F.trim(letters) != ""),
        F.aggregate(chars, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1,
    )


def specified_regions(specs: DataFrame) -> DataFrame:
    """Regions from outside: column letters and a header row counted from one."""
    order = Window.partitionBy(*SHEET).orderBy("ord")  # the few tables named for one sheet
    return specs.select(
        *SHEET,
        F.row_number().over(order).alias("region"),
        column_index(F.col("col_start")).alias("col_start"),
        column_index(F.col("col_end")).alias("col_end"),
        (F.col("header_row").cast("int") - 1).alias("header_row"),
        column_index(F.col("name_col")).alias("name_col"),
        column_index(F.col("unit_col")).alias("unit_col"),
        column_index(F.col("price_col")).alias("price_col"),
        F.coalesce("role", F.lit("supplier_input")).alias("role"),
    )


def analyze(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions with columns, role and supplier name, and the items they hold.

    Cells and headers are read by many of the steps, so both are written once.
    """
    cells = materialize(cells, "cells")
    headed = materialize(header_rows(cells, column_groups(cells)), "headers")
    regions = materialize(
        region_columns(cells, headed)
        .join(region_roles(cells, headed), REGION)
        .join(supplier_names(cells, headed), REGION, "left"),
        "regions",
    )
    items = region_items(cells, regions).join(regions.select(*REGION, "role"), REGION)
    return regions, items


def file_summary(regions: DataFrame, items: DataFrame) -> DataFrame:
    """Per sheet: tables found, items by role, and the first supplier name."""
    tables = regions.groupBy(*SHEET).agg(
        F.count("*").alias("tables_detected"),
        F.min_by(
            F.when(F.col("role") == "supplier_input", F.col("supplier_name")),
            F.when((F.col("role") == "supplier_input") & F.col("supplier_name").isNotNull(), F.col("region")),
        ).alias("supplier_name"),
    )
    counts = items.groupBy(*SHEET).agg(
        F.count_if(F.col("role") == "supplier_input").alias("supplier_items"),
        F.count_if(F.col("role") == "catalog_reference").alias("catalog_items"),
    )
    return tables.join(counts, SHEET, "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("supplier_items", "catalog_items")}
    )
