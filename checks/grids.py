"""G: tables in messy sheets. Documents stand for sheets, commas for cell borders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import query, table, text, with_sql
from linewright.functions import dictionaries as D
from linewright.operators import grid as G
from linewright.plans.ingest import items_as_catalog
from linewright.operators import catalog as C
from linewright.session import materialize
from linewright.sources.grids import text_cells

# some words of the prose become header and hint words
SWAPS = [("the", "товар"), ("und", "цена"), ("que", "клиент: "), ("las", "каталог")]


def _swapped(expr):
    for old, new in SWAPS:
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


CELLS = f"""lines AS (SELECT doc_id, list_filter(string_split_regex({_swapped('text')}, '\\r?\\n|\\r'), lambda l: trim(l) <> '') AS ls FROM documents),
one AS (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS n FROM lines),
masked AS (SELECT doc_id, n, list_aggregate(list_transform(string_split(l, '"'), lambda p, i: CASE WHEN (len(string_split(l, '"')) - i) % 2 = 0 THEN replace(p, ',', chr(1)) ELSE p END), 'string_agg', '"') AS m FROM one),
fields AS (SELECT doc_id, n, string_split(m, chr(1)) AS fs FROM masked),
good AS (SELECT doc_id, n, fs, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS row FROM (SELECT *, first(len(fs)) OVER (PARTITION BY doc_id ORDER BY n) AS w FROM fields) WHERE len(fs) <= w),
raw AS (SELECT doc_id, row, unnest(fs) AS f, unnest(range(len(fs))) AS col FROM good),
cells AS (SELECT doc_id, row, col, CASE WHEN trim(v) <> '' THEN v END AS value FROM (SELECT *, CASE WHEN regexp_matches(f, '(?s)^\\s*".*"\\s*$') THEN replace(regexp_extract(f, '(?s)^\\s*"(.*)"\\s*$', 1), '""', '"') ELSE f END AS v FROM raw)),
sizes AS (SELECT doc_id, max(row) + 1 AS height, max(col) + 1 AS width, count(value) AS filled FROM cells GROUP BY 1),
cols AS (SELECT doc_id, height, width, unnest(range(width)) AS col FROM sizes),
colfill AS (SELECT doc_id, height, col, coalesce(n, 0) AS n FROM cols LEFT JOIN (SELECT doc_id, col, count(value) AS n FROM cells GROUP BY 1, 2) USING (doc_id, col)),
colgap AS (SELECT doc_id, col FROM colfill WHERE (height - n) / height >= 0.85),
runs AS (SELECT doc_id, col, col - row_number() OVER (PARTITION BY doc_id ORDER BY col) AS island FROM (SELECT doc_id, col FROM colfill ANTI JOIN colgap USING (doc_id, col))),
groups AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(col)) AS region, min(col) AS col_start, max(col) AS col_end FROM runs GROUP BY doc_id, island)"""

WORDS = D.NAME_WORDS + D.UNIT_WORDS + D.PRICE_WORDS + D.ARTICLE_WORDS


def _any(expr, words):
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


KNOWN = "(" + " OR ".join(f"(contains(t, '{w}') AND ({len(w)}.0 >= length(t) * 0.3 OR length(t) < 30))" for w in WORDS) + ")"


def analysis(regions="groups"):
    return f"""rc AS (SELECT c.doc_id, region, col_start, col_end, row, c.col, value FROM cells c JOIN {regions} g ON c.doc_id = g.doc_id AND c.col BETWEEN col_start AND col_end WHERE value IS NOT NULL),
hs AS (SELECT doc_id, region, row, round(count(*) FILTER ({KNOWN}) * 5 + count(*) FILTER (t <> '') * 1.5 + count(DISTINCT t) / count(*) * 3 + greatest(0.0, 2.0 - avg(length(t)) / 15) * 4, 9) AS score
  FROM (SELECT *, lower(trim(value)) AS t FROM rc WHERE row < 20) GROUP BY 1, 2, 3 HAVING NOT (count(DISTINCT t) = 1 AND count(*) > 1)),
headed AS (SELECT g.doc_id, g.region, col_start, col_end, coalesce(hr, 0) AS header_row FROM {regions} g LEFT JOIN (SELECT doc_id, region, arg_min(row, {{'s': -score, 'r': row}}) AS hr FROM hs GROUP BY 1, 2) USING (doc_id, region)),
hc AS (SELECT doc_id, region, col_start, col_end, header_row, unnest(range(col_start, col_end + 1)) AS col FROM headed),
facts AS (SELECT h.doc_id, h.region, h.col, max(lower(trim(value))) FILTER (row = header_row) AS header, count(s) AS n, count(*) FILTER (regexp_matches(s, '^-?\\d+(?:[\\.,]\\d+)?\\s*(?:руб|₽|шт|кг|л)?\\.?$')) AS num,
  avg(CASE WHEN s IS NOT NULL THEN coalesce(TRY_CAST(nullif(replace(regexp_replace(s, '[^\\d.,]', '', 'g'), ',', '.'), '') AS DOUBLE), 0) END) AS mv, avg(length(s)) AS ml, max(length(s)) AS longest
  FROM hc h LEFT JOIN (SELECT r.*, CASE WHEN r.row > hd.header_row AND r.row <= hd.header_row + 20 AND trim(value) <> '' THEN trim(value) END AS s FROM rc r JOIN headed hd USING (doc_id, region)) x ON x.doc_id = h.doc_id AND x.region = h.region AND x.col = h.col GROUP BY 1, 2, 3),
types AS (SELECT *, CASE WHEN {_any("coalesce(header, 'nan')", D.NAME_WORDS)} THEN 'name' WHEN {_any("coalesce(header, 'nan')", D.UNIT_WORDS)} THEN 'unit' WHEN {_any("coalesce(header, 'nan')", D.PRICE_WORDS)} THEN 'price'
  WHEN {_any("coalesce(header, 'nan')", D.ARTICLE_WORDS)} THEN 'article' WHEN n = 0 THEN 'other' WHEN num / n > 0.8 THEN CASE WHEN mv > 10 THEN 'price' ELSE 'number' END WHEN ml > 15 THEN 'name'
  WHEN ml < 5 THEN CASE WHEN longest < 8 THEN 'unit' ELSE 'article' END ELSE 'other' END AS column_type FROM facts),
longest AS (SELECT doc_id, region, arg_min(col, {{'l': -ml, 'c': col}}) AS longest_col FROM (SELECT r.doc_id, r.region, r.col, avg(length(value)) AS ml FROM rc r JOIN headed h ON r.doc_id = h.doc_id AND r.region = h.region AND r.row > header_row GROUP BY 1, 2, 3) GROUP BY 1, 2),
named AS (SELECT h.doc_id, h.region, h.col_start, h.col_end, h.header_row, coalesce(min(t.col) FILTER (column_type = 'name'), any_value(longest_col), any_value(h.col_start)) AS name_col, min(t.col) FILTER (column_type = 'unit') AS unit_col, min(t.col) FILTER (column_type = 'price') AS price_col
  FROM headed h LEFT JOIN types t USING (doc_id, region) LEFT JOIN longest USING (doc_id, region) GROUP BY 1, 2, 3, 4, 5),
roles AS (SELECT h.doc_id, h.region, CASE WHEN NOT bool_or({_any("lower(coalesce(value, ''))", D.SUPPLIER_WORDS)}) AND bool_or({_any("lower(coalesce(value, ''))", D.CATALOG_WORDS)}) THEN 'catalog_reference' ELSE 'supplier_input' END AS role
  FROM headed h LEFT JOIN rc r ON r.doc_id = h.doc_id AND r.region = h.region AND r.row BETWEEN header_row - 3 AND header_row GROUP BY 1, 2)"""


def items_sql(regions):
    return f"""rowtext AS (SELECT r.doc_id, r.region, row, max(CASE WHEN col = name_col THEN trim(value) END) AS raw_text, max(CASE WHEN col = unit_col THEN trim(value) END) AS unit, max(CASE WHEN col = price_col THEN trim(value) END) AS price
  FROM rc r JOIN {regions} n ON n.doc_id = r.doc_id AND n.region = r.region WHERE row > header_row GROUP BY 1, 2, 3),
kept AS (SELECT * FROM rowtext WHERE length(raw_text) > 1 AND lower(raw_text) NOT IN ('nan', 'none') AND NOT regexp_matches(raw_text, '(?i)^\\s*(итого|всего|total|subtotal|сумма|итог)($|[^\\p{{L}}\\p{{N}}_])')),
items AS (SELECT doc_id, region, row, raw_text, CASE WHEN unit <> '' AND lower(unit) NOT IN ('nan', 'none') THEN unit END AS unit, CASE WHEN price <> '' AND lower(price) NOT IN ('nan', 'none') THEN price END AS price
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, region, lower(raw_text) ORDER BY row) AS k FROM kept) WHERE k = 1)"""


def grid_cells(spark, sf):
    column = F.col("text")
    for old, new in SWAPS:
        column = F.replace(column, F.lit(old), F.lit(new))
    docs = table(spark, sf, "documents").select(text("doc_id").alias("file_id"), column.alias("text"))
    return materialize(text_cells(docs, ","), "cells")


def _regions(spark, sf):
    cells = grid_cells(spark, sf)
    return cells, G.header_rows(cells, G.column_groups(cells))


FILE = "CAST(doc_id AS VARCHAR) AS file_id, CAST(region AS INTEGER) AS region"


@query("G1_best_sheet", with_sql(CELLS, body="""
SELECT source AS file_id, arg_min(CAST(doc_id AS VARCHAR), {'s': -filled * height, 'd': CAST(doc_id AS VARCHAR)}) AS sheet, max(filled * height) AS score FROM sizes JOIN documents USING (doc_id) GROUP BY 1"""))
def g1(spark, sf):
    source = table(spark, sf, "documents").select(text("doc_id").alias("sheet"), "source")
    cells = grid_cells(spark, sf).drop("sheet").withColumnRenamed("file_id", "sheet").join(source, "sheet").withColumnRenamed("source", "file_id")
    return G.best_sheets(cells)


@query("G2_column_gaps", with_sql(CELLS, body="SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(col AS INTEGER) AS col FROM colgap"))
def g2(spark, sf):
    return G.column_gaps(grid_cells(spark, sf)).drop("sheet")


@query("G3_row_gaps", with_sql(CELLS, """rows_ AS (SELECT doc_id, width, unnest(range(height)) AS row FROM sizes)""", body="""
SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(row AS INTEGER) AS row FROM rows_ LEFT JOIN (SELECT doc_id, row, count(value) AS n FROM cells GROUP BY 1, 2) USING (doc_id, row) WHERE (width - coalesce(n, 0)) / width >= 0.85"""))
def g3(spark, sf):
    return G.row_gaps(grid_cells(spark, sf)).drop("sheet")


@query("G4_column_groups", with_sql(CELLS, body=f"SELECT {FILE}, CAST(col_start AS INTEGER) AS col_start, CAST(col_end AS INTEGER) AS col_end FROM groups"))
def g4(spark, sf):
    return G.column_groups(grid_cells(spark, sf)).drop("sheet")


@query("G5_header_rows", with_sql(CELLS, analysis(), body=f"SELECT {FILE}, CAST(header_row AS INTEGER) AS header_row FROM headed"))
def g5(spark, sf):
    return _regions(spark, sf)[1].select("file_id", "region", "header_row")


@query("G6_column_types", with_sql(CELLS, analysis(), body=f"SELECT {FILE}, CAST(col AS INTEGER) AS col, column_type FROM types"))
def g6(spark, sf):
    cells, headed = _regions(spark, sf)
    return G.column_types(cells, headed).select("file_id", "region", "col", "column_type")


@query("G7_region_roles", with_sql(CELLS, analysis(), body=f"SELECT {FILE}, role FROM roles"))
def g7(spark, sf):
    cells, headed = _regions(spark, sf)
    return G.region_roles(cells, headed).drop("sheet")


@query("G8_supplier_names", with_sql(CELLS, analysis(), body=f"""
SELECT {FILE}, arg_min(trim(trim(regexp_extract(trim(value), '(?i)(?:клиент|поставщик|заказчик)\\s*[=:]\\s*(.+)', 1)), '"''«»'), {{'r': row, 'c': col}}) AS supplier_name
FROM rc JOIN headed USING (doc_id, region) WHERE row < header_row AND row >= header_row - 5 AND regexp_matches(trim(value), '(?i)(?:клиент|поставщик|заказчик)\\s*[=:]\\s*(.+)') GROUP BY doc_id, region"""))
def g8(spark, sf):
    cells, headed = _regions(spark, sf)
    return G.supplier_names(cells, headed).drop("sheet")


@query("G9_longest_text_column", with_sql(CELLS, analysis(), body=f"SELECT {FILE}, CAST(longest_col AS INTEGER) AS longest_col FROM longest"))
def g9(spark, sf):
    cells, headed = _regions(spark, sf)
    return G.longest_text_columns(cells, headed).drop("sheet")


@query("G10_region_items", with_sql(CELLS, analysis(), items_sql("named"), body=f"SELECT {FILE}, CAST(row AS VARCHAR) AS line_id, raw_text, unit, price FROM items"))
def g10(spark, sf):
    cells, headed = _regions(spark, sf)
    return G.region_items(cells, G.region_columns(cells, headed)).select("file_id", "region", "line_id", "raw_text", "unit", "price")


WHOLE = "whole AS (SELECT doc_id, 1 AS region, 0 AS col_start, width - 1 AS col_end FROM sizes)"
TARGET = f"""tfacts AS (SELECT h.doc_id, h.region, h.col, coalesce(max(lower(trim(value))) FILTER (row = header_row), '') AS header, count(*) FILTER (row > header_row AND trim(value) <> '') AS n,
  count(*) FILTER (row > header_row AND trim(value) <> '' AND NOT regexp_matches(trim(value), '^-?\\d+(?:[\\.,]\\d+)?\\s*$')) AS w,
  avg(length(trim(value))) FILTER (row > header_row AND trim(value) <> '' AND NOT regexp_matches(trim(value), '^-?\\d+(?:[\\.,]\\d+)?\\s*$')) AS wl FROM hc h JOIN rc r ON r.doc_id = h.doc_id AND r.region = h.region AND r.col = h.col GROUP BY 1, 2, 3),
target AS (SELECT h.doc_id, h.region, h.header_row, coalesce(min(col) FILTER ({_any('header', D.TARGET_PHRASES)}), min(col) FILTER ({_any('header', D.NAME_WORDS)}),
  arg_min(col, {{'d': -round(w / n * coalesce(wl, 0), 9), 'c': col}}) FILTER (w / nullif(n, 0) * coalesce(wl, 0) > 1.5), any_value(h.col_start)) AS name_col, CAST(NULL AS BIGINT) AS unit_col, CAST(NULL AS BIGINT) AS price_col
  FROM headed h LEFT JOIN tfacts USING (doc_id, region) GROUP BY 1, 2, 3)"""


@query("G11_target_column", with_sql(CELLS, WHOLE, analysis("whole"), TARGET, body="SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(header_row AS INTEGER) AS header_row, CAST(name_col AS INTEGER) AS name_col FROM target"))
def g11(spark, sf):
    cells = grid_cells(spark, sf)
    headed = G.header_rows(cells, G.whole_sheets(cells))
    return G.target_columns(cells, headed).select("file_id", "header_row", "name_col")


@query("G12_single_table_items", with_sql(CELLS, WHOLE, analysis("whole"), TARGET, items_sql("target"), body="SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(row AS VARCHAR) AS line_id, raw_text FROM items"))
def g12(spark, sf):
    return G.single_table_items(grid_cells(spark, sf)).select("file_id", "line_id", "raw_text")


SPEC = """specs AS (SELECT doc_id, 1 AS region, 0 AS col_start, 27 AS col_end, 0 AS header_row, 0 AS name_col, 1 AS unit_col, CAST(NULL AS BIGINT) AS price_col, CASE WHEN lang = 'en' THEN 'catalog_reference' ELSE 'supplier_input' END AS role FROM documents),
rc AS (SELECT c.doc_id, region, row, col, value FROM cells c JOIN specs s ON c.doc_id = s.doc_id AND c.col BETWEEN col_start AND col_end WHERE value IS NOT NULL)"""


def _specified(spark, sf):
    none = F.lit(None).cast("string")
    specs = table(spark, sf, "documents").select(
        text("doc_id").alias("file_id"), F.lit("Sheet1").alias("sheet"), F.lit(1).alias("ord"), F.lit(" a").alias("col_start"), F.lit("AB").alias("col_end"),
        F.lit("1").alias("header_row"), F.lit("A").alias("name_col"), F.lit("b").alias("unit_col"), none.alias("price_col"),
        F.when(F.col("lang") == "en", "catalog_reference").alias("role"),
    )
    return G.specified_regions(specs)


@query("G13_specified_regions", with_sql(CELLS, SPEC, items_sql("specs"), body="""
SELECT CAST(doc_id AS VARCHAR) AS file_id, role, CAST(row AS VARCHAR) AS line_id, raw_text, unit FROM items JOIN specs USING (doc_id, region)"""))
def g13(spark, sf):
    regions = _specified(spark, sf)
    found = G.region_items(grid_cells(spark, sf), regions)
    return found.join(regions.select(*G.REGION, "role"), G.REGION).select("file_id", "role", "line_id", "raw_text", "unit")


@query("G14_sheet_analysis", with_sql(CELLS, analysis(), items_sql("named"), body="""
SELECT CAST(g.doc_id AS VARCHAR) AS file_id, g.n AS tables_detected, coalesce(s, 0) AS supplier_items, coalesce(c, 0) AS catalog_items FROM (SELECT doc_id, count(*) AS n FROM groups GROUP BY 1) g
LEFT JOIN (SELECT doc_id, count(*) FILTER (role = 'supplier_input') AS s, count(*) FILTER (role = 'catalog_reference') AS c FROM items JOIN roles USING (doc_id, region) GROUP BY 1) USING (doc_id)"""))
def g14(spark, sf):
    return G.file_summary(*G.analyze(grid_cells(spark, sf))).select("file_id", "tables_detected", "supplier_items", "catalog_items")


@query("C13_catalog_from_sheets", with_sql(CELLS, analysis(), items_sql("named"), body="""
SELECT 'prd_' || substr(sha256('{"article": null, "brand": null, "code": null, "name": ' || to_json(raw_text) || '}'), 1, 16) AS product_id, raw_text AS name, unit, raw_text AS search_document FROM items JOIN roles USING (doc_id, region) WHERE role = 'catalog_reference'"""))
def c13(spark, sf):
    _, items = G.analyze(grid_cells(spark, sf))
    return C.transform_items(items_as_catalog(items)).select("product_id", "name", "unit", "search_document")
