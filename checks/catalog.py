"""A and C: sources, sinks and the catalog build."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import CATALOG, ITEMS, LOG, REQUESTS, calls, catalog, items, query, requests, table, text, with_sql
from checks.grids import CELLS, grid_cells
from linewright.functions import dictionaries as D
from linewright.operators import catalog as C
from linewright.operators import mappings as M
from linewright.operators import reporting as R
from linewright.plans import ingest
from linewright.session import scratch_path
from linewright.sources import catalog_files, catalog_source, erp, grids, lines, sinks


def _csv_export(spark, sf, sep):
    """The part table as a delimited file with Russian headers."""
    path = scratch_path(spark, "catalog-csv")
    part = table(spark, sf, "part")
    part.select(
        text("p_partkey").alias("Код"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("Наименование"), F.col("p_brand").alias("Бренд"),
        F.col("p_type").alias("Группа"), F.replace(text("p_retailprice"), F.lit("."), F.lit(",")).alias("Вес"), F.col("p_size").alias("лишнее"),
    ).write.csv(path, header=True, sep=sep)
    return path


CSV_SQL = """SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, p_brand AS brand, p_type AS category_path, p_retailprice AS weight_value FROM part"""


@query("A1_catalog_csv_scan", CSV_SQL)
def a1(spark, sf):
    return catalog_files.read_catalog(spark, _csv_export(spark, sf, ";")).drop("product_id")


@query("A1_catalog_tsv_scan", CSV_SQL)
def a1_tsv(spark, sf):
    return catalog_files.read_catalog(spark, _csv_export(spark, sf, "\t")).drop("product_id")


@query("A2_header_fields", "SELECT count(*) AS n, count(DISTINCT p_name) AS names FROM part")
def a2(spark, sf):
    headers = ["Код", " Наименование", "Бренд ", "Группа", "ВЕС", "лишнее"]
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice", "p_size")
    fields = catalog_files.field_map(headers)
    return part.select(*[F.col(part.columns[i]).alias(f) for i, f in fields.items()]).agg(
        F.count("code").alias("n"), F.count_distinct("name").alias("names")
    )


@query("A3_row_cleanup", """
SELECT CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_brand END AS brand, p_name AS name,
  CASE WHEN p_size > 40 THEN NULL ELSE p_retailprice END AS weight_value, 'P' || p_partkey AS product_id FROM part WHERE p_size > 2""")
def a3(spark, sf):
    part = table(spark, sf, "part")
    raw = part.select(
        F.when(F.col("p_size") > 2, F.concat(F.lit("  "), "p_name")).otherwise("  ").alias("name"),
        F.when(F.col("p_type") == "PROMO", " ").otherwise(F.col("p_brand")).alias("brand"),
        F.when(F.col("p_size") > 40, "n/a").otherwise(F.replace(text("p_retailprice"), F.lit("."), F.lit(","))).alias("weight_value"),
        F.concat(F.lit("P"), text("p_partkey")).alias("product_id"),
    )
    return catalog_files.clean_rows(raw)


@query("A4_grid_cells", with_sql(CELLS, body="""
SELECT CAST(doc_id AS VARCHAR) AS file_id, count(*) AS cells, CAST(max(row) AS INTEGER) AS last_row, CAST(max(col) AS INTEGER) AS last_col,
  count(value) AS filled, CAST(sum(length(value)) AS BIGINT) AS chars FROM cells GROUP BY 1"""))
def a4(spark, sf):
    return grid_cells(spark, sf).groupBy("file_id").agg(
        F.count("*").alias("cells"), F.max("row").alias("last_row"), F.max("col").alias("last_col"),
        F.count("value").alias("filled"), F.sum(F.length("value")).alias("chars"),
    )


@query("A4_delimiter_vote", """
SELECT doc_id, CASE WHEN t > s AND t > c AND t >= b THEN 'tab' WHEN b > s AND b > c THEN '|' WHEN s > c THEN ';' ELSE ',' END AS sep FROM (
  SELECT doc_id, len(regexp_extract_all(x, '\\t')) AS t, len(regexp_extract_all(x, ';')) AS s, len(regexp_extract_all(x, ',')) AS c, len(regexp_extract_all(x, '\\|')) AS b
  FROM (SELECT doc_id, text AS x FROM documents))""")
def a4_vote(spark, sf):
    sep = grids.vote_delimiter(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.when(sep == "\t", "tab").otherwise(sep).alias("sep"))


def _pages(spark, sf):
    """Events of a user as one JSON page; the page form depends on the user."""
    record = F.to_json(F.struct(text("event_id").alias("Ref_Key"), F.col("event_type").alias("Description"), F.col("value").alias("Вес")))
    joined = F.array_join(F.array_sort(F.collect_list(record)), ",")
    events = table(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(joined.alias("records"))
    form = F.col("user_id") % 3
    return events.select(
        "user_id",
        F.when(form == 0, F.concat(F.lit('{"value":['), "records", F.lit("]}")))
        .when(form == 1, F.concat(F.lit('{"d":{"results":['), "records", F.lit("]}}")))
        .otherwise(F.concat(F.lit("["), "records", F.lit("]"))).alias("body"),
    )


@query("A5_erp_pages", "SELECT user_id, CAST(event_id AS VARCHAR) AS ref, event_type AS name FROM events")
def a5(spark, sf):
    rows = erp.page_rows(_pages(spark, sf))
    return rows.select("user_id", F.get_json_object("record", "$.Ref_Key").alias("ref"), F.get_json_object("record", "$.Description").alias("name"))


@query("A6_erp_items", """
SELECT CAST(event_id AS VARCHAR) AS product_id, upper(event_type) AS name, 'B' || user_id AS brand,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS weight_value, CASE WHEN user_id % 2 = 0 THEN NULL ELSE 'P' || user_id END AS category_path,
  '{"k":' || json_extract_string(props, '$.k') || '}' AS extra
FROM events WHERE event_type NOT IN ('signup', 'purchase')""")
def a6(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    record = F.to_json(
        F.struct(
            text("event_id").alias("Ref_Key"), F.lit("").alias("Description"), F.concat(F.lit(" "), F.upper(kind)).alias("Наименование"),
            F.struct(F.concat(F.lit("B"), text("user_id")).alias("Description")).alias("Бренд"),
            F.when(kind == "view", "bad").otherwise(F.replace(text("value"), F.lit("."), F.lit(","))).alias("Вес"),
            F.when(F.col("user_id") % 2 == 0, D.EMPTY_REFERENCE).otherwise(F.concat(F.lit("P"), text("user_id"))).alias("Родитель_Key"),
            (kind == "signup").alias("DeletionMark"), (kind == "purchase").alias("IsFolder"),
            F.get_json_object("props", "$.k").alias("k"),
        )
    )
    return erp.map_records(e.select(record.alias("record"))).select(
        "product_id", "name", "brand", "weight_value", "category_path",
        F.concat(F.lit('{"k":'), F.col("extra")["k"], F.lit("}")).alias("extra"),
    )


@query("A7_tabular_lines", """
SELECT CAST(l_orderkey AS VARCHAR) AS line_id, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE 'Line ' || l_partkey END AS raw_text FROM lineitem""")
def a7(spark, sf):
    l = table(spark, sf, "lineitem")
    rows = l.select(
        F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag"),
        F.when(F.col("l_linestatus") != "O", F.concat(F.lit(" Line "), text("l_partkey"))).alias("Номенклатура"), F.col("l_orderkey").alias("id"),
    )
    return lines.tabular_lines(rows, rows.columns, F.lit(0)).drop("original_row")


@query("A8_pasted_lines", """
SELECT conv_id, turn, CAST(i + 1 AS VARCHAR) AS line_id, trim(l, ' ' || chr(9) || chr(13) || chr(160)) AS raw_text FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations)
WHERE trim(l, ' ' || chr(9) || chr(13) || chr(160)) <> ''""")
def a8(spark, sf):
    return lines.pasted_lines(table(spark, sf, "conversations").select("conv_id", "turn", "text"))


@query("A8_valid_lines", with_sql(ITEMS, body="""
SELECT count(*) FILTER (fits) AS valid, CAST(count(*) FILTER (NOT fits) AS INTEGER) AS rejected FROM (
  SELECT length(raw_text) <= 8 AND length(raw_text) > 0 AND count(*) OVER (PARTITION BY request_id) <= 5 AS fits FROM items)"""))
def a8_valid(spark, sf):
    good, bad = lines.split_valid(items(spark, sf), max_chars=8, max_lines=5)
    return good.agg(F.count("*").alias("valid")).withColumn("rejected", bad.agg(F.count("*").cast("int")).scalar())


@query("A9_active_catalog", with_sql(CATALOG, body="SELECT product_id, name, article, brand, normalized_brand, category_path, search_document FROM catalog WHERE is_active"))
def a9(spark, sf):
    return C.active_catalog(catalog(spark, sf)).select(
        "product_id", "name", "article", "brand", "normalized_brand", "category_path", "search_document"
    )


@query("A10_dictionary_use", """
SELECT CASE WHEN p_size % 3 < 2 THEN 'unit' ELSE 'none' END AS kind, CASE p_size % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'mm' END AS target, count(*) AS lines FROM part GROUP BY 1, 2""")
def a10(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("кг", "мм", "слово")]), F.col("p_size") % 3 + 1)
    rows = table(spark, sf, "part").select(F.concat_ws(" ", unit, "p_name").alias("line"))
    first = F.regexp_extract("line", r"(?U)^[а-я]+", 0)
    known = rows.withColumn("source", first).join(_units(spark), "source", "left")
    return known.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "target").agg(F.count("*").alias("lines"))


def _units(spark):
    return D.dictionary_frame(spark).filter("kind = 'unit'").select("source", "kind", "target")


@query("I2_catalog_sources", """
SELECT 'T' || p_partkey AS product_id, p_name AS name, NULL AS unit FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT 'F' || p_partkey, p_name, 'шт' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT 'E' || p_partkey, p_name, NULL FROM part WHERE p_partkey % 3 = 2""")
def i2(spark, sf):
    part = table(spark, sf, "part")
    third = lambda i: part.filter(F.col("p_partkey") % 3 == i)
    files, pages = scratch_path(spark, "files"), scratch_path(spark, "pages")
    third(1).select(F.concat(F.lit("F"), text("p_partkey")).alias("id"), F.col("p_name").alias("name"), F.lit("шт").alias("ед")).write.csv(files, sep=";", header=True)
    record = F.to_json(F.struct(F.concat(F.lit("E"), text("p_partkey")).alias("Ref_Key"), F.col("p_name").alias("Description")))
    body = third(2).groupBy(F.col("p_partkey") % 5).agg(F.array_join(F.collect_list(record), ",").alias("r"))
    body.select(F.concat(F.lit('{"value": ['), "r", F.lit("]}")).alias("value")).coalesce(1).write.option("maxRecordsPerFile", 1).text(pages)
    raw = third(0).select(F.concat(F.lit("T"), text("p_partkey")).alias("product_id"), F.col("p_name").alias("name"))
    sources = [catalog_source.CatalogTable(raw), catalog_source.CatalogFiles(files), catalog_source.ErpPages(pages), catalog_source.ErpPages(files + "-absent")]
    rows = catalog_source.read_sources(spark, sources)
    return rows.select(F.coalesce("product_id", "onec_ref").alias("product_id"), "name", "unit")


@query("A11_catalog_upsert", with_sql(CATALOG, body="""
SELECT product_id, CASE WHEN p_size >= 25 THEN 'new ' || brand ELSE brand END AS brand FROM catalog JOIN part USING (p_partkey)"""))
def a11(spark, sf):
    base = catalog(spark, sf)
    new = base.join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").filter("p_size >= 25")
    new = new.withColumn("brand", F.concat(F.lit("new "), "brand")).drop("p_size")
    twice = new.withColumn("brand", F.lit("stale")).withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    return C.upsert(base, twice, order="seq").select("product_id", "brand")


def _embeddings(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("P"), text("vec_id")).alias("product_id"), F.lit("m1").alias("embedding_model"),
        F.when(F.col("label") < 7, "v1").otherwise("v2").alias("embedding_version"), F.col("embedding").alias("vector"), "label",
    )


@query("A12_embedding_upsert", """
SELECT 'P' || vec_id AS product_id, CASE WHEN label >= 5 THEN 'm2' ELSE 'm1' END AS embedding_model, CAST(len(embedding) AS INTEGER) AS width FROM embeddings""")
def a12(spark, sf):
    base = _embeddings(spark, sf)
    good, _ = C.valid_embeddings(base.filter("label >= 5").withColumn("embedding_model", F.lit("m2")), 64)
    return C.upsert(base, good).select("product_id", "embedding_model", F.size("vector").alias("width"))


@query("A13_merge_results", with_sql(ITEMS, body="""
SELECT request_item_id, CASE WHEN status = 'auto_match' THEN 'done' ELSE status END AS status,
  CASE WHEN status = 'auto_match' THEN 1.0 ELSE confidence END AS confidence FROM (SELECT DISTINCT ON (request_item_id) * FROM items)"""))
def a13(spark, sf):
    base = items(spark, sf).dropDuplicates(["request_item_id"])
    new = base.filter("status = 'auto_match'").select(
        "request_item_id", F.lit("done").alias("status"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("raw_text")
    )
    return sinks.merge_results(base, new).select("request_item_id", "status", "confidence")


@query("A13_result_write", with_sql(ITEMS, body="SELECT status, count(*) AS n FROM items GROUP BY status"))
def a13_write(spark, sf):
    path = scratch_path(spark, "results")
    rows = items(spark, sf).select("request_item_id", "status", "confidence")
    for _ in range(2):  # a rerun replaces, it does not add
        sinks.replace_partitions(rows, path, ["status"])
    return spark.read.parquet(path).groupBy("status").agg(F.count("*").alias("n"))


@query("A14_export_rows", with_sql(ITEMS, CATALOG, body="""
SELECT request_item_id AS line_id, coalesce(c.name, '') AS "found", CAST(floor(confidence * 100 + 0.5) AS BIGINT) || '%' AS "percent",
  CASE status WHEN 'auto_match' THEN 'Найдено' WHEN 'review_needed' THEN 'На проверку' ELSE 'Не найдено' END AS "label"
FROM items LEFT JOIN catalog c ON best_product_id = product_id"""))
def a14(spark, sf):
    found = catalog(spark, sf).select(F.col("product_id").alias("best_product_id"), "name", "article", "brand")
    rows = items(spark, sf).join(found, "best_product_id", "left").withColumn("line_id", F.col("request_item_id"))
    rows = rows.withColumn("original_row", F.create_map(F.lit("Товар 1С"), F.lit("")))
    out = sinks.export_rows(rows.withColumn("reasons", F.array(F.lit("a"), F.lit("b"))))
    row = F.col("row")
    return out.select("line_id", row["Товар 1С"].alias("found"), row["Уверенность"].alias("percent"), row["Статус"].alias("label"))


@query("A15_audit_append", "SELECT event_type AS action, count(*) AS n FROM events GROUP BY 1")
def a15(spark, sf):
    path = scratch_path(spark, "audit")
    events = table(spark, sf, "events").select(
        F.col("event_type").alias("action"), text("user_id").alias("user_id"), F.col("props").alias("details"), text("event_id").alias("entity_id"), "ts"
    )
    sinks.append(sinks.audit_rows(events), path)
    return spark.read.parquet(path).groupBy("action").agg(F.count_distinct("log_id").alias("n"))


def _parsed(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("row_number"), F.when(F.col("p_size") != 13, F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"),
        text("p_partkey").alias("code"),
    )


@query("A16_import_dry_run", "SELECT 'done' AS status, count(*) AS parsed_count, true AS dry_run FROM part")
def a16(spark, sf):
    return ingest.import_summary(_parsed(spark, sf), None, None, dry_run=True)


@query("A17_import_summary", """
SELECT 'done' AS status, count(*) AS parsed_count, count(*) FILTER (p_size <> 13) AS upserted, count(*) FILTER (p_size = 13) AS errors,
  least(count(*) FILTER (p_size = 13), 20) AS listed FROM part""")
def a17(spark, sf):
    parsed = _parsed(spark, sf)
    good, rejects = ingest.split_import(parsed)
    products = C.transform_items(good)
    return ingest.import_summary(parsed, products, rejects).select(
        "status", "parsed_count", "upserted", "errors", F.size("error_details").cast("bigint").alias("listed")
    )


@query("A18_cascade_delete", with_sql(REQUESTS, ITEMS, body="""
SELECT (SELECT count(*) FROM requests WHERE status <> 'done') AS requests,
  (SELECT count(*) FROM items WHERE request_id NOT IN (SELECT request_id FROM requests WHERE status = 'done')) AS items"""))
def a18(spark, sf):
    parents = requests(spark, sf)
    gone = parents.filter("status = 'done'")
    left, (children,) = C.delete_with_children(parents, [(items(spark, sf), "request_id")], gone, "request_id")
    return left.agg(F.count("*").alias("requests")).withColumn("items", children.agg(F.count("*")).scalar())


@query("A19_clear_results", with_sql(REQUESTS, ITEMS, body="""
SELECT count(*) FILTER (r.status = 'pending') AS cleared, count(best_product_id) FILTER (r.status <> 'pending') AS kept,
  count(*) FILTER (i.status = 'no_match' OR r.status = 'pending') AS no_match FROM items i JOIN requests r USING (request_id)"""))
def a19(spark, sf):
    rows = items(spark, sf)
    waiting = requests(spark, sf).filter("status = 'pending'")
    candidates = rows.select("request_item_id", F.col("best_product_id").alias("product_id"))
    cleared, _ = sinks.clear_results(rows, candidates, waiting)
    return cleared.agg(
        F.count_if(F.col("best_product_id").isNull()).alias("cleared"), F.count("best_product_id").alias("kept"),
        F.count_if(F.col("status") == "no_match").alias("no_match"),
    )


@query("A20_token_log_append", with_sql(LOG, body="SELECT event_id, total_tokens, estimated_cost_usd FROM log"))
def a20(spark, sf):
    path = scratch_path(spark, "token-log")
    sinks.append(R.token_log(calls(spark, sf)), path)
    return spark.read.parquet(path).select("event_id", "total_tokens", F.col("estimated_cost_usd").cast("double").alias("estimated_cost_usd"))


# --- C ---


def _raw(spark, sf):
    return table(spark, sf, "part").select(
        F.concat_ws(" ", F.upper("p_name"), text("p_size")).alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category_path"),
        F.when(F.col("p_size") > 25, text("p_partkey")).alias("code"), F.lit("").alias("article"), F.col("p_partkey").alias("row_number"),
    )


RAW = """raw AS (SELECT upper(p_name) || ' ' || p_size AS name, p_brand AS brand, p_type AS category_path,
  CASE WHEN p_size > 25 THEN CAST(p_partkey AS VARCHAR) END AS code, '' AS article, p_partkey AS row_number FROM part),
hashed AS (SELECT *, substr(sha256('{"article": "", "brand": "' || brand || '", "code": ' || coalesce('"' || code || '"', 'null') || ', "name": "' || name || '"}'), 1, 16) AS source_hash FROM raw)"""


@query("C1_transform", with_sql(RAW, body="""
SELECT row_number, lower(name) AS normalized_name, lower(brand) AS normalized_brand, name || ' | ' || brand || ' | ' || category_path AS search_document,
  source_hash, 'prd_' || source_hash AS product_id FROM hashed"""))
def c1(spark, sf):
    return C.transform_items(_raw(spark, sf)).select(
        "row_number", "normalized_name", "normalized_brand", "search_document", "source_hash", "product_id"
    )


@query("C2_search_document", """
SELECT s_suppkey, s_name || CASE WHEN s_acctbal > 0 THEN ' | ' || s_nationkey ELSE '' END || ' | ' || s_suppkey AS search_document FROM supplier""")
def c2(spark, sf):
    raw = table(spark, sf, "supplier").select(
        "s_suppkey", F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 0, text("s_nationkey")).otherwise("").alias("brand"), text("s_suppkey").alias("article")
    )
    return C.raw_items(raw).select("s_suppkey", C.search_document().alias("search_document"))


@query("C3_content_hash", """
SELECT doc_id, substr(sha256('{"article": ' || coalesce(json_quote(lang), 'null') || ', "brand": null, "code": ' || json_quote(source) || ', "name": ' || json_quote(text) || '}'), 1, 16) AS source_hash FROM documents""".replace("json_quote(", "to_json("))
def c3(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("article"), F.col("source").alias("code"), F.col("text").alias("name"))
    return C.raw_items(raw).select("doc_id", C.content_hash().alias("source_hash"))


@query("C4_product_id", with_sql(RAW, body="""
SELECT row_number, CASE WHEN row_number % 3 = 0 THEN 'native' || row_number ELSE 'prd_' || source_hash END AS product_id FROM hashed"""))
def c4(spark, sf):
    n = F.col("row_number") % 3
    raw = _raw(spark, sf).withColumn("product_id", F.when(n == 0, F.concat(F.lit("native"), text("row_number"))).when(n == 1, "prd_old"))
    return C.raw_items(raw).withColumn("source_hash", C.content_hash()).select("row_number", C.product_id().alias("product_id"))


NAMED = """named AS (SELECT 'D' || doc_id AS product_id, md5(text) AS source_hash, TIMESTAMP '2024-01-01' + to_seconds(CAST(n_chars AS BIGINT)) AS created_at FROM documents),
kept AS (SELECT source_hash, arg_min(product_id, {'c': created_at, 'p': product_id}) AS keep_id FROM named GROUP BY 1)"""


def _copies(spark, sf):
    return table(spark, sf, "documents").select(
        F.concat(F.lit("D"), text("doc_id")).alias("product_id"), F.md5("text").alias("source_hash"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_chars")).alias("created_at"),
    )


@query("C5_deduplicate", with_sql(NAMED, body="SELECT keep_id AS product_id, source_hash FROM kept"))
def c5(spark, sf):
    return C.deduplicate(_copies(spark, sf))[0].select("product_id", "source_hash")


@query("C5_repoint", with_sql(NAMED, body="""
SELECT l.doc_id, coalesce(keep_id, 'D' || l.doc_id) AS product_id FROM labels l LEFT JOIN named ON product_id = 'D' || l.doc_id LEFT JOIN kept USING (source_hash)"""))
def c5_repoint(spark, sf):
    _, dropped = C.deduplicate(_copies(spark, sf))
    refs = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("D"), text("doc_id")).alias("product_id"))
    return C.repoint(refs, dropped, "product_id")


@query("C6_category_paths", """
WITH RECURSIVE nodes AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, CAST(p_partkey // 10 AS VARCHAR) AS parent FROM part),
walk AS (SELECT id AS category_id, name AS path, parent AS nxt, 0 AS depth FROM nodes
  UNION ALL SELECT category_id, n.name || '/' || path, n.parent, depth + 1 FROM walk JOIN nodes n ON n.id = nxt WHERE depth < 10)
SELECT category_id, arg_max(path, depth) AS path FROM walk GROUP BY 1""")
def c6(spark, sf):
    folders = table(spark, sf, "part").select(
        text("p_partkey").alias("category_id"), F.col("p_name").alias("name"), F.floor(F.col("p_partkey") / 10).cast("string").alias("parent_id")
    )
    return C.category_paths(folders, max_depth=10)


@query("C7_changed_documents", with_sql(CATALOG, body="SELECT product_id FROM catalog WHERE brand <> 'Brand#7'"))
def c7(spark, sf):
    products = catalog(spark, sf)
    digest = F.sha2(F.when(F.col("brand") == "Brand#7", F.col("search_document")).otherwise("old"), 256)
    return C.changed_documents(products, products.select("product_id", digest.alias("digest"))).select("product_id")


@query("C8_missing_embeddings", with_sql(CATALOG, body="""
SELECT product_id FROM catalog WHERE is_active AND product_id NOT IN (SELECT 'P' || vec_id FROM embeddings WHERE label < 7)"""))
def c8(spark, sf):
    return C.missing_embeddings(catalog(spark, sf), _embeddings(spark, sf), "m1", "v1").select("product_id")


VERSIONS = """versions AS (SELECT 'idx' || n_nationkey AS index_version_id, 'model' || n_regionkey AS embedding_model, n_nationkey = 3 AS is_active,
  TIMESTAMP '2024-01-01' + to_seconds(CAST(n_nationkey AS BIGINT)) AS created_at FROM nation)"""


def _versions(spark, sf):
    return table(spark, sf, "nation").select(
        F.concat(F.lit("idx"), text("n_nationkey")).alias("index_version_id"), F.concat(F.lit("model"), text("n_regionkey")).alias("embedding_model"),
        (F.col("n_nationkey") == 3).alias("is_active"), F.timestamp_seconds(F.lit(1704067200) + F.col("n_nationkey")).alias("created_at"),
    )


@query("C9_new_index_version", with_sql(VERSIONS, CATALOG, body="""
SELECT index_version_id, false AS is_active, CAST(NULL AS BIGINT) AS product_count FROM versions
UNION ALL SELECT 'idx_new', true, count(*) FILTER (is_active) FROM catalog"""))
def c9(spark, sf):
    new = catalog(spark, sf).agg(F.count_if("is_active").alias("product_count")).withColumn("index_version_id", F.lit("idx_new"))
    return C.new_index_version(_versions(spark, sf), new).select("index_version_id", "is_active", "product_count")


@query("C10_activate_version", with_sql(VERSIONS, body="SELECT index_version_id, index_version_id = 'idx7' AS is_active FROM versions"))
def c10(spark, sf):
    known = C.activate_index_version(_versions(spark, sf), "idx7")
    return C.activate_index_version(known, "no such version").select("index_version_id", "is_active")


@query("C11_coverage", with_sql(VERSIONS, CATALOG, body="""
SELECT t AS total_products, e AS embedded_products, (SELECT embedding_model FROM versions WHERE is_active) AS embedding_model,
  round(e / t * 100, 1) AS embedding_coverage_pct FROM (SELECT count(*) FILTER (is_active) AS t FROM catalog), (SELECT count(DISTINCT vec_id) AS e FROM embeddings)"""))
def c11(spark, sf):
    return C.catalog_coverage(catalog(spark, sf), _embeddings(spark, sf), _versions(spark, sf))


@query("C12_ensure_suppliers", """
SELECT c_custkey AS ordinal, CASE WHEN c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) THEN 'S' || c_custkey ELSE 'sup_supplier-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS supplier_id,
  c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) AS is_new FROM customer""")
def c12(spark, sf):
    known = table(spark, sf, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("S"), text("s_suppkey")).alias("supplier_id"), F.col("s_name").alias("supplier_name"))
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("ordinal"), F.replace(F.upper("c_name"), F.lit("CUSTOMER"), F.lit(" SUPPLIER")).alias("name"))
    return M.ensure_suppliers(names, known).drop("supplier_name")
