"""D and E: retrieval, pair features, scores, decisions and the whole match."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.common import CATALOG, MAPPINGS, catalog, mappings, query, table, text, with_sql
from linewright.functions import scoring as SC

from linewright.operators import mappings as M
from linewright.operators import rerank as RR
from linewright.operators import retrieval as R
from linewright.operators import segments
from linewright.operators import verdicts as VD
from linewright.options import MatchOptions
from linewright.plans import batch_match as B
from linewright.plans import ingest


def grams(expr: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '\\d+\\.\\d+|[\\p{{L}}\\p{{N}}_]+')"


# queries: what buyers write, one per distinct text
QUERIES_SQL = "q AS (SELECT DISTINCT p_name || ' ' || p_size AS q FROM part)"


def _queries(spark, sf):
    rows = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", text("p_size")).alias("text")).distinct()
    return rows.withColumn("query_id", F.col("text"))


def lexical_sql(name_t=0.15, doc_t=0.10, cap=200, terms=None):
    terms = terms or f"list_distinct({tokens('q')})"
    return [
        f"qg AS (SELECT q, unnest({grams('q')}) AS g FROM q)",
        "qn AS (SELECT q, count(*) AS n FROM qg GROUP BY q)",
        "act AS (SELECT * FROM catalog WHERE is_active)",
        f"nset AS (SELECT name, unnest({grams('name')}) AS g FROM (SELECT DISTINCT normalized_name AS name FROM act))",
        "nn AS (SELECT name, count(*) AS n FROM nset GROUP BY name)",
        "ns AS (SELECT q, name, count(*) AS s FROM qg JOIN nset USING (g) GROUP BY q, name)",
        "nsim AS (SELECT q, name, s / (qn.n + nn.n - s) AS sim FROM ns JOIN qn USING (q) JOIN nn USING (name))",
        f"dset AS (SELECT doc, unnest({grams('doc')}) AS g FROM (SELECT DISTINCT search_document AS doc FROM act))",
        "dn AS (SELECT doc, count(*) AS n FROM dset GROUP BY doc)",
        "ds AS (SELECT q, doc, count(*) AS s FROM qg JOIN dset USING (g) GROUP BY q, doc)",
        "dsim AS (SELECT q, doc, s / (qn.n + dn.n - s) AS sim FROM ds JOIN qn USING (q) JOIN dn USING (doc))",
        f"qt AS (SELECT q, unnest(t) AS t, unnest(range(len(t))) AS i, len(t) AS n FROM (SELECT q, {terms} AS t FROM q))",
        f"dp AS (SELECT doc, unnest(t) AS t, unnest(range(1, len(t) + 1)) AS pos FROM (SELECT doc, {tokens('doc')} AS t FROM (SELECT DISTINCT search_document AS doc FROM act)))",
        "hit AS (SELECT q, doc, i, n, pos FROM qt JOIN dp USING (t))",
        "matched AS (SELECT q, doc, count(DISTINCT i) = max(n) AS all_terms, max(n) AS n, count(*) AS c FROM hit GROUP BY q, doc)",
        """prox AS (SELECT a.q, a.doc, 1 - product(1 - 0.1 * sqrt(CASE WHEN abs(a.pos - b.pos) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.pos - b.pos) / 1.5 - 2)) END)) AS r
  FROM hit a JOIN hit b ON a.q = b.q AND a.doc = b.doc AND a.i < b.i AND a.pos <> b.pos GROUP BY a.q, a.doc)""",
        """ranked AS (SELECT m.q, m.doc, all_terms, CASE WHEN n = 1 THEN list_sum(list_transform(range(1, c + 1), lambda j: 0.1 / (j * j))) / 1.64493406685 ELSE coalesce(r, 0) END AS r
  FROM matched m LEFT JOIN prox USING (q, doc))""",
        f"""lexall AS (SELECT q.q, product_id, coalesce(all_terms, false) AS all_terms, coalesce(r, 0) AS r, coalesce(nsim.sim, 0) AS ns, coalesce(dsim.sim, 0) AS ds,
  round(greatest(coalesce(r, 0), coalesce(nsim.sim, 0) * 0.8, coalesce(dsim.sim, 0) * 0.5), 9) AS lex
  FROM q CROSS JOIN act LEFT JOIN ranked ON ranked.q = q.q AND ranked.doc = search_document
  LEFT JOIN nsim ON nsim.q = q.q AND nsim.name = normalized_name LEFT JOIN dsim ON dsim.q = q.q AND dsim.doc = search_document
  WHERE coalesce(all_terms, false) OR coalesce(nsim.sim, 0) > {name_t} OR coalesce(dsim.sim, 0) > {doc_t})""",
        f"lexical AS (SELECT q, product_id, lex, lr FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY lex DESC, product_id) AS lr FROM lexall) WHERE lr <= {cap})",
    ]


LEX = lexical_sql()


@query("D1_exact_codes", with_sql(CATALOG, body="""
SELECT DISTINCT 'C' || p_name AS query_id, product_id FROM part p, catalog c WHERE is_active AND (c.article = 'C' || p_name OR c.code = 'C' || p_name OR c.manufacturer_code = 'C' || p_name)
UNION SELECT lpad(CAST(l_partkey AS VARCHAR), 8, '0'), product_id FROM lineitem l JOIN catalog c ON c.article = lpad(CAST(l_partkey AS VARCHAR), 8, '0') WHERE is_active"""))
def d1(spark, sf):
    names = table(spark, sf, "part").select(F.concat(F.lit("C"), "p_name").alias("query_id"))
    keys = table(spark, sf, "lineitem").select(F.lpad(text("l_partkey"), 8, "0").alias("query_id"))
    queries = names.union(keys).distinct().withColumn("article_hint", F.col("query_id"))
    return R.exact_matches(queries, catalog(spark, sf))


@query("D2_text_match", with_sql(CATALOG, QUERIES_SQL, *LEX, body="""
SELECT q AS query_id, product_id, round(r, 9) AS text_rank FROM ranked JOIN catalog ON search_document = doc WHERE all_terms AND is_active"""))
def d2(spark, sf):
    documents = catalog(spark, sf).filter("is_active").select("product_id", "search_document")
    return R.text_matches(_queries(spark, sf), documents)


@query("D3_trigram_similarity", with_sql(CATALOG, QUERIES_SQL, *LEX, body="""
SELECT q AS l_id, doc AS r_id, round(sim, 9) AS similarity FROM dsim WHERE sim > 0.3"""))
def d3(spark, sf):
    left = _queries(spark, sf).select(F.col("query_id").alias("id"), "text")
    right = catalog(spark, sf).filter("is_active").select(F.col("search_document").alias("id"), F.col("search_document").alias("text")).distinct()
    return R.similar_texts(left, right, 0.3).withColumn("similarity", F.round("similarity", 9))


@query("D4_lexical_top200", with_sql(CATALOG, QUERIES_SQL, *LEX, body="SELECT q AS query_id, product_id, lex AS lex_score, lr AS lex_rank FROM lexical"))
def d4(spark, sf):
    return R.lexical_matches(_queries(spark, sf), R.build_index(catalog(spark, sf)))


@query("C7_refreshed_index", with_sql(CATALOG, QUERIES_SQL, *LEX, body="SELECT q AS query_id, product_id, lex AS lex_score, lr AS lex_rank FROM lexical"))
def c7_refreshed(spark, sf):
    """Half of the products, some with texts of their own and some that go, refreshed to the catalog and searched."""
    now = catalog(spark, sf)
    turn = F.pmod(F.xxhash64("product_id"), F.lit(20))
    before = now.where(turn < 10).withColumn("search_document", F.when(turn == 3, F.concat("name", F.lit(" as it was"))).otherwise(F.col("search_document")))
    gone = now.where(turn == 0).withColumn("product_id", F.concat(F.lit("gone-"), "product_id"))
    index = segments.refresh(segments.open_segments(spark, segments.new_folder(spark)), before.unionByName(gone))
    versions = spark.createDataFrame([], "index_version_id string, is_active boolean")
    version = spark.createDataFrame([("v2",)], "index_version_id string")
    index, _ = ingest.refresh_index(index, now, versions, version, merge_share=1e9)
    return R.lexical_matches(_queries(spark, sf), segments.catalog_index(segments.open_segments(spark, index.path)))


@query("D5_vector_top200", """
WITH p AS (SELECT a.vec_id AS query_id, 'P' || b.vec_id AS product_id,
  round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS sem_score
  FROM embeddings a, embeddings b WHERE b.label <> 3)
SELECT query_id, product_id, sem_score, sem_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sem_score DESC, product_id) AS sem_rank FROM p) WHERE sem_rank <= 200""")
def d5(spark, sf):
    e = table(spark, sf, "embeddings")
    product = F.concat(F.lit("P"), text("vec_id")).alias("product_id")
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    live = e.select(product, (F.col("label") != 3).alias("is_active"))
    found = R.semantic_matches(queries, e.select(product, F.col("embedding").alias("vector")), live)
    return found.withColumn("sem_rank", F.col("sem_rank").cast("bigint"))


FUSED = """exact AS (SELECT DISTINCT q.q, product_id FROM q JOIN part ON q.q = p_name || ' ' || p_size JOIN catalog c ON c.code = 'C' || p_name WHERE is_active),
fused AS (SELECT coalesce(e.q, l.q) AS q, coalesce(e.product_id, l.product_id) AS product_id, e.q IS NOT NULL AS exact_match, coalesce(lex, 0) AS lex,
  CASE WHEN e.q IS NOT NULL THEN CAST(1.0 AS DOUBLE) / 60 ELSE 0 END + coalesce(CAST(1.0 AS DOUBLE) / (60 + lr), 0) AS rrf
  FROM lexical l FULL JOIN exact e ON e.q = l.q AND e.product_id = l.product_id)"""


def _hinted(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        F.concat_ws(" ", "p_name", text("p_size")).alias("text"), F.concat(F.lit("C"), "p_name").alias("article_hint")
    ).distinct().withColumn("query_id", F.col("text"))


def _fused(spark, sf):
    queries, products = _hinted(spark, sf), catalog(spark, sf)
    lexical = R.lexical_matches(queries.select("query_id", "text"), R.build_index(products))
    return R.fuse(lexical, None, R.exact_matches(queries, products))


@query("D6_rank_fusion", with_sql(CATALOG, QUERIES_SQL, *LEX, FUSED, body="SELECT q AS query_id, product_id, exact_match, lex AS lexical_score, round(rrf, 9) AS rrf_score FROM fused"))
def d6(spark, sf):
    return _fused(spark, sf).select("query_id", "product_id", "exact_match", "lexical_score", F.round("rrf_score", 9).alias("rrf_score"))


@query("D7_filtered_top_n", with_sql(CATALOG, QUERIES_SQL, *LEX, FUSED, body="""
SELECT q AS query_id, product_id, name, rk AS retrieval_rank FROM (
  SELECT f.*, c.name, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, f.product_id) AS rk FROM fused f JOIN catalog c USING (product_id)
  WHERE is_active AND category_id = 'ECONOMY') WHERE rk <= 50"""))
def d7(spark, sf):
    queries = _hinted(spark, sf).withColumn("category_filter", F.lit("ECONOMY")).withColumn("brand_filter", F.lit(""))
    fused = _fused(spark, sf).withColumn("rrf_score", F.round("rrf_score", 12))
    return R.hydrate(fused, catalog(spark, sf), queries).select(
        "query_id", "product_id", "name", F.col("retrieval_rank").cast("bigint").alias("retrieval_rank")
    )


NATIONS = """catalog AS (SELECT n_name AS product_id, lower(n_name) AS normalized_name, n_name || ' | ' || r_name AS search_document, true AS is_active
  FROM nation JOIN region ON n_regionkey = r_regionkey),
q AS (SELECT DISTINCT n_name || ' market ' || c_mktsegment AS q FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("D8_small_catalog", with_sql(NATIONS, *lexical_sql(-1, -1, 500), body="""
SELECT q AS query_id, product_id, lex AS lexical_score, lr AS retrieval_rank FROM lexical WHERE lr <= 10"""))
def d8(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    names = ["article", "code", "brand", "normalized_brand", "manufacturer_code", "category_id", "category_path", "unit", "packaging"]
    small = n.select(
        F.col("n_name").alias("product_id"), F.col("n_name").alias("name"), F.lower("n_name").alias("normalized_name"),
        F.concat_ws(" | ", "n_name", "r_name").alias("search_document"), F.lit(True).alias("is_active"), *[none.alias(c) for c in names],
    )
    queries = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(" ", "n_name", F.lit("market"), "c_mktsegment").alias("text")
    ).distinct().withColumn("query_id", F.col("text"))
    found = R.rank_whole_catalog(queries, small, options=MatchOptions(retrieval_top_n=10))
    return found.select("query_id", "product_id", "lexical_score", F.col("retrieval_rank").cast("bigint").alias("retrieval_rank"))


LEAD = "list_filter(string_split(lower(q), ' '), lambda w: length(w) > 3 AND regexp_full_match(w, '\\p{L}+'))[1:1]"


@query("D9_relaxed_search", with_sql(CATALOG, "q AS (SELECT DISTINCT p_type || ' ' || p_name || ' ' || p_size AS q FROM part)", *lexical_sql(0.08, 0.05, 100, LEAD), body="""
SELECT q AS query_id, product_id, lex AS lex_score, lr AS lex_rank FROM lexical"""))
def d9(spark, sf):
    texts = table(spark, sf, "part").select(F.concat_ws(" ", "p_type", "p_name", text("p_size")).alias("text")).distinct()
    queries = R.relaxed_queries(texts.withColumn("query_id", F.col("text")))
    return R.lexical_matches(queries, R.build_index(catalog(spark, sf)), 0.08, 0.05, 100)


@query("D10_product_search", with_sql(CATALOG, body="""
SELECT product_id, name FROM catalog WHERE is_active AND (contains(lower(name), 'bolt 4') OR contains(lower(article), 'bolt 4') OR contains(lower(brand), 'bolt 4')) ORDER BY name, product_id LIMIT 50"""))
def d10(spark, sf):
    return R.search_products(catalog(spark, sf), "Bolt 4").select("product_id", "name")


@query("D11_alias_lookup", with_sql(CATALOG, body="""
SELECT DISTINCT p_name AS query_id, product_id FROM part JOIN catalog ON code = 'C' || p_name"""))
def d11(spark, sf):
    aliases = catalog(spark, sf).select(F.expr("substring(code, 2)").alias("normalized_alias_text"), "product_id")
    queries = table(spark, sf, "part").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("text")).distinct()
    return R.alias_hits(queries, aliases)


LINES_SQL = """lines AS (SELECT DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_linestatus || CAST(round(l_tax * 100) AS INTEGER) AS line_id, 'S' || l_suppkey AS supplier_id,
  CASE l_linestatus WHEN 'O' THEN 'sku' || l_partkey ELSE 'Line ' || l_partkey END AS raw_text, 'line ' || l_partkey AS n_text,
  CASE WHEN l_tax > 0.04 THEN lpad(CAST(l_partkey AS VARCHAR), 8, '0') ELSE '' END AS article FROM lineitem)"""


def _told(spark, sf):
    """The few columns of lines all others follow from, copies too."""
    part = F.col("l_partkey").isNotNull()
    return table(spark, sf, "lineitem").select(
        F.concat_ws(
            "-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
            F.concat("l_linestatus", F.round(F.col("l_tax") * 100).cast("int").cast("string")),
        ).alias("line_id"),
        "l_partkey", "l_suppkey",
        F.coalesce(part & (F.col("l_linestatus") == "O"), F.lit(False)).alias("as_sku"),
        F.coalesce(F.col("l_tax") > 0.04, F.lit(False)).alias("with_article"),
    )


def _lines(spark, sf):
    """One row per line."""
    return _written_out(_told(spark, sf).distinct())


def _written_out(told):
    return told.select(
        "line_id",
        F.concat(F.lit("S"), text("l_suppkey")).alias("supplier_id"),
        F.concat(F.when(F.col("as_sku"), "sku").otherwise("Line "), text("l_partkey")).alias("raw_text"),
        F.concat(F.lit("line "), text("l_partkey")).alias("n_text"),
        F.when(F.col("with_article"), F.lpad(text("l_partkey"), 8, "0")).otherwise("").alias("article"),
    )


OVERRIDES = """hits AS (SELECT line_id, mapping_id, product_id, mapping_type, confidence,
  CASE mapping_type WHEN 'exact' THEN 1 WHEN 'approved' THEN 2 WHEN 'manual' THEN 3 ELSE 4 END AS rk
  FROM lines l JOIN mappings m ON l.supplier_id = m.supplier_id AND m.is_active
  AND (supplier_sku = raw_text OR (article <> '' AND supplier_article = article) OR supplier_raw_text = raw_text OR normalized_supplier_text = n_text)),
override AS (SELECT line_id, v.product_id, v.mapping_type, coalesce(nullif(v.confidence, 0), 0.995) AS confidence FROM (
  SELECT line_id, arg_min({'product_id': product_id, 'mapping_type': mapping_type, 'confidence': confidence}, {'r': rk, 'm': mapping_id}) AS v FROM hits GROUP BY 1))"""


@query("D12_supplier_override", with_sql(LINES_SQL, MAPPINGS, OVERRIDES, body="SELECT * FROM override"))
def d12(spark, sf):
    return M.supplier_overrides(_lines(spark, sf), mappings(spark, sf))


@query("D13_find_mapping", with_sql(LINES_SQL, MAPPINGS, """keyed AS (SELECT *, CASE WHEN article <> '' THEN 'a' ELSE 'n' END AS kind FROM lines)""", body="""
SELECT line_id AS lookup_id, min(mapping_id) AS mapping_id FROM keyed l JOIN mappings m ON l.supplier_id = m.supplier_id AND m.is_active
  AND CASE WHEN kind = 'a' THEN supplier_article = article ELSE normalized_supplier_text = n_text END GROUP BY 1"""))
def d13(spark, sf):
    lookups = _lines(spark, sf).select("supplier_id", "article", F.col("n_text").alias("normalized_text"), "raw_text", F.col("line_id").alias("lookup_id"))
    return M.find_mapping(lookups, mappings(spark, sf)).select("lookup_id", "mapping_id")


# candidates of an order: the parts it holds, once each
SHORTLIST = """shortlist AS (SELECT query_id, product_id, rrf_score, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, product_id) AS retrieval_rank
  FROM (SELECT l_orderkey AS query_id, 'P' || l_partkey AS product_id, max(l_quantity) AS rrf_score FROM lineitem GROUP BY 1, 2))"""


def _shortlist(spark, sf):
    from pyspark.sql import Window

    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id"), F.concat(F.lit("P"), text("l_partkey")).alias("product_id")).agg(F.max("l_quantity").alias("rrf_score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "product_id")
    return rows.withColumn("retrieval_rank", F.row_number().over(order))


@query("D14_rerank_by_fusion", with_sql(SHORTLIST, body="SELECT query_id, product_id, rrf_score AS rerank_score FROM shortlist WHERE retrieval_rank <= 3"))
def d14(spark, sf):
    return RR.by_fusion(_shortlist(spark, sf), 3).select("query_id", "product_id", "rerank_score")


SCORED = """scores AS (SELECT DISTINCT l_orderkey AS query_id, l_linenumber AS candidate_index, 1.0 * (l_linenumber % 3) AS score FROM lineitem),
attached AS (SELECT s.query_id, product_id, CAST(score AS DOUBLE) AS rerank_score FROM shortlist s JOIN scores c ON s.query_id = c.query_id AND s.retrieval_rank - 1 = c.candidate_index)"""


def _attached(spark, sf, top_n=10):
    scores = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("candidate_index"), (F.col("l_linenumber") % 3).cast("double").alias("score")
    ).distinct()
    return RR.by_scores(_shortlist(spark, sf), scores, top_n)


@query("D15_external_scores", with_sql(SHORTLIST, SCORED, body="""
SELECT query_id, product_id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, product_id) AS n FROM attached) WHERE n <= 2"""))
def d15(spark, sf):
    return _attached(spark, sf, 2).select("query_id", "product_id", "rerank_score")


@query("D16_score_scaling", with_sql(SHORTLIST, SCORED, body="""
SELECT query_id, product_id, round(CASE WHEN n = 1 THEN rerank_score WHEN hi > lo THEN (rerank_score - lo) / (hi - lo) WHEN hi > 0 THEN 1.0 ELSE rerank_score END, 9) AS rerank_score
FROM (SELECT *, min(rerank_score) OVER w AS lo, max(rerank_score) OVER w AS hi, count(*) OVER w AS n FROM attached WINDOW w AS (PARTITION BY query_id))"""))
def d16(spark, sf):
    return RR.scale(_attached(spark, sf, 1000)).select("query_id", "product_id", F.round("rerank_score", 9).alias("rerank_score"))


@query("D17_candidate_document", with_sql(CATALOG, body="SELECT product_id, brand || ' | ' || name || ' | ' || article || ' | ' || category_path AS document FROM catalog"))
def d17(spark, sf):
    return catalog(spark, sf).select("product_id", RR.candidate_document().alias("document"))


# ids as a model may return them: whole, cut at the front, or made up
@query("D18_resolve_ids", with_sql(CATALOG, """returned AS (SELECT s_suppkey AS line_id, CASE s_suppkey % 3 WHEN 0 THEN 'P' || s_suppkey WHEN 1 THEN CAST(s_suppkey AS VARCHAR) ELSE 'X' || s_suppkey END AS product_id FROM supplier),
found AS (SELECT r.product_id, arg_min(c.product_id, {'s': CASE WHEN c.product_id = r.product_id THEN 1 ELSE 2 END, 'p': c.product_id}) AS resolved_id
  FROM (SELECT DISTINCT product_id FROM returned) r JOIN catalog c ON is_active AND ends_with(c.product_id, r.product_id) GROUP BY 1)""", body="""
SELECT line_id, product_id, resolved_id FROM returned LEFT JOIN found USING (product_id)"""))
def d18(spark, sf):
    key = F.col("s_suppkey")
    returned = table(spark, sf, "supplier").select(
        key.alias("line_id"),
        F.when(key % 3 == 0, F.concat(F.lit("P"), text("s_suppkey"))).when(key % 3 == 1, text("s_suppkey")).otherwise(F.concat(F.lit("X"), text("s_suppkey"))).alias("product_id"),
    )
    return VD.resolve_ids(returned, catalog(spark, sf)).select("line_id", "product_id", "resolved_id")


@query("D19_prompt_lines", with_sql(CATALOG, body="""
SELECT product_id, product_id || ' | ' || name || ' | ' || article || ' | ' || brand || ' | — | ' || category_path AS line FROM catalog"""))
def d19(spark, sf):
    return catalog(spark, sf).select("product_id", VD.catalog_line().alias("line"))


BATCHES = """texts AS (SELECT lang AS request_id, doc_id AS position, text AS raw_text FROM documents),
sized AS (SELECT request_id, count(*) AS n, greatest(1, floor((100000 - 300 // 3) / (floor(greatest(80, floor(sum(length(raw_text)) / count(*))) / 3) + 40))) AS fit FROM texts GROUP BY 1),
packed AS (SELECT t.*, row_number() OVER (PARTITION BY request_id ORDER BY position) - 1 AS at_, greatest(1, least(fit, n)) AS size FROM texts t JOIN sized USING (request_id)),
placed AS (SELECT request_id, position, raw_text, CAST(floor(at_ / size) AS BIGINT) AS batch, CAST(at_ % size AS BIGINT) AS item_index FROM packed)"""


def _packed(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("request_id"), F.col("doc_id").alias("position"), F.col("text").alias("raw_text"))
    return VD.pack_batches(docs, 300)


@query("D20_batch_packing", with_sql(BATCHES, body="SELECT request_id, position, batch, item_index FROM placed"))
def d20(spark, sf):
    return _packed(spark, sf).select("request_id", "position", F.col("batch").cast("bigint").alias("batch"), F.col("item_index").cast("bigint").alias("item_index"))


@query("D19_batch_prompts", with_sql(BATCHES, body="""
SELECT request_id, batch, md5(string_agg(item_index || '. "' || raw_text || '" (бренд=—, артикул=—, числа=—, ед.изм=—)', chr(10) ORDER BY item_index)) AS digest FROM placed GROUP BY 1, 2"""))
def d19_batches(spark, sf):
    none = F.lit(None).cast("string")
    items = _packed(spark, sf).withColumns({"brand": none, "article": none, "unit": none, "numbers": F.array().cast("array<double>")})
    return VD.batch_prompts(items).select("request_id", F.col("batch").cast("bigint").alias("batch"), F.md5("items_list").alias("digest"))


@query("D21_parse_replies", """
SELECT l_orderkey AS reply_id, CAST(l_linenumber AS INTEGER) AS item_index, max_by('P' || l_partkey, l_partkey * 10000 + l_suppkey) AS product_id FROM lineitem
WHERE l_linenumber < 5 GROUP BY 1, 2""")
def d21(spark, sf):
    l = table(spark, sf, "lineitem")
    entry = F.to_json(F.struct(F.col("l_linenumber").alias("item_index"), F.concat(F.lit("P"), text("l_partkey")).alias("product_id"), F.lit(0.5).alias("confidence")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("o"), entry.alias("e")))), lambda x: x["e"]), ", ")
    replies = l.groupBy(F.col("l_orderkey").alias("reply_id")).agg(listed.alias("body")).withColumn("items", F.lit(5))
    kind = F.col("reply_id") % 4
    damaged = (
        F.when(kind == 0, F.concat(F.lit("```json\n["), "body", F.lit("]\n```")))
        .when(kind == 1, F.concat(F.lit("["), "body", F.lit(",]")))
        .when(kind == 2, F.concat(F.lit("["), "body", F.lit(', {"item_index": 1, "produ')))
        .otherwise(F.concat(F.lit("```\n["), "body", F.lit("]\n```")))
    )
    return VD.parse_verdicts(replies.withColumn("reply", damaged), ["reply_id"]).select("reply_id", "item_index", "product_id")


@query("D22_alternatives", with_sql(CATALOG, """alts AS (SELECT o_orderkey AS line_id, unnest(['P' || o_custkey, 'P' || o_orderkey, 'none']) AS product_id, unnest([1, 2, 3]) AS n FROM orders)""", body="""
SELECT line_id, string_agg(product_id || '=' || coalesce(name, ''), ';' ORDER BY n) AS listed FROM alts LEFT JOIN (SELECT * FROM catalog WHERE is_active) USING (product_id) GROUP BY 1"""))
def d22(spark, sf):
    alt = lambda c: F.struct(c.alias("product_id"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reasoning"))
    key = lambda c: F.concat(F.lit("P"), text(c))
    verdicts = table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_id"), F.array(alt(key("o_custkey")), alt(key("o_orderkey")), alt(F.lit("none"))).alias("alternatives"))
    named = VD.named_alternatives(verdicts, catalog(spark, sf))
    return named.select("line_id", F.array_join(F.transform("alternatives", lambda a: F.concat_ws("=", a["product_id"], a["name"])), ";").alias("listed"))


# --- E: pairs of ordered parts and parts numbered like their supplier ---

PAIRS = """base AS (SELECT l_partkey, l_suppkey, min(l_quantity) AS qty, min(l_discount) AS disc, min(l_tax) AS tax, min(l_returnflag) AS rf, min(l_linestatus) AS ls FROM lineitem GROUP BY 1, 2),
pairs AS (SELECT l_partkey AS item_id, l_suppkey AS retrieval_rank, 'P' || l_suppkey AS product_id,
  CASE WHEN qty > 40 THEN NULL ELSE lower(a.p_brand) END AS q_brand, CASE WHEN disc > 0.08 AND qty > 40 THEN NULL ELSE lower(c.p_brand) END AS c_brand,
  CASE WHEN tax > 0.05 THEN NULL ELSE lower(a.p_type) END AS q_category, CASE WHEN disc > 0.07 THEN NULL ELSE lower(c.p_type) END AS c_category,
  CASE rf WHEN 'A' THEN 'pcs' WHEN 'R' THEN 'kg' END AS q_unit, CASE ls WHEN 'O' THEN 'pcs' END AS c_unit,
  CASE WHEN qty > 30 THEN 'box' WHEN qty > 15 THEN 'canister' END AS q_packaging, CASE WHEN disc > 0.05 THEN 'bo' WHEN disc > 0.02 THEN 'box' END AS c_packaging,
  CAST(a.p_size AS DOUBLE) AS qnum, CAST(c.p_size AS DOUBLE) AS cnum, CAST(floor(qty) AS DOUBLE) AS cnum2,
  CASE WHEN tax < 0.02 THEN lpad(CAST(l_suppkey AS VARCHAR), 8, '0') WHEN tax < 0.04 THEN 'M-' || l_suppkey END AS q_article,
  lpad(CAST(l_suppkey AS VARCHAR), 8, '0') AS c_article, 'M-' || l_suppkey AS c_manufacturer_code,
  disc * 12 AS lexical_in, tax * 10 - 0.1 AS semantic_in, qty / 50 AS rerank_in, qty = 1 AS mapping_in, qty > 45 AS alias_in
  FROM base JOIN part a ON a.p_partkey = l_partkey JOIN part c ON c.p_partkey = l_suppkey),
texts AS (SELECT DISTINCT q_brand AS a, c_brand AS b FROM pairs UNION SELECT DISTINCT q_category, c_category FROM pairs UNION SELECT DISTINCT q_packaging, c_packaging FROM pairs),
lcs AS (WITH RECURSIVE step AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row FROM texts WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN k = 1 THEN 0 ELSE greatest(row[k], row[k - 1] + CASE WHEN substr(a, i + 1, 1) = substr(b, k - 1, 1) THEN 1 ELSE 0 END) END))) FROM step WHERE i < length(a))
  SELECT a, b, 2.0 * row[length(b) + 1] / (length(a) + length(b)) AS ratio FROM step WHERE i = length(a)),
feat AS (SELECT p.*, least(1.0, greatest(0.0, lexical_in)) AS lexical_score, least(1.0, greatest(0.0, semantic_in)) AS semantic_score, least(1.0, rerank_in) AS rerank_score,
  CASE WHEN mapping_in THEN 1.0 ELSE 0.0 END AS supplier_mapping_hit, CASE WHEN alias_in THEN 1.0 ELSE 0.0 END AS alias_hit,
  CASE WHEN q_article = c_article THEN 1.0 ELSE 0.0 END AS article_exact, CASE WHEN q_article = c_manufacturer_code THEN 1.0 ELSE 0.0 END AS manufacturer_code_exact,
  CASE WHEN q_brand = c_brand THEN 1.0 ELSE 0.0 END AS brand_exact, coalesce(lb.ratio, 0) AS brand_fuzzy, coalesce(lb.ratio < 0.4, false) AS brand_conflict,
  CASE WHEN q_category = c_category THEN 1.0 ELSE 0.0 END AS category_exact, coalesce(lc.ratio, 0) AS category_fuzzy, coalesce(lc.ratio < 0.3, false) AS category_conflict,
  CASE WHEN near1 OR near2 THEN 0.5 ELSE 0.0 END AS number_signature_score, NOT (near1 OR near2) AS critical_number_conflict,
  CASE WHEN q_unit IS NULL OR c_unit IS NULL THEN 0.5 WHEN q_unit = c_unit THEN 1.0 ELSE 0.0 END AS unit_match_score, coalesce(q_unit <> c_unit, false) AS unit_conflict,
  CASE WHEN q_packaging IS NULL OR c_packaging IS NULL THEN 0.5 WHEN q_packaging = c_packaging THEN 1.0 WHEN lp.ratio > 0.6 THEN 0.5 ELSE 0.0 END AS packaging_match_score,
  coalesce(q_packaging <> c_packaging AND lp.ratio <= 0.6, false) AS packaging_conflict,
  (CASE WHEN q_brand = c_brand THEN 1.0 ELSE 0.0 END + CASE WHEN q_unit = c_unit THEN 1.0 ELSE 0.0 END + CASE WHEN qnum = cnum AND cnum = cnum2 THEN 1.0 WHEN qnum IN (cnum, cnum2) THEN 0.5 ELSE 0.0 END)
   / (CASE WHEN q_brand IS NULL AND c_brand IS NULL THEN 0 ELSE 1 END + CASE WHEN q_unit IS NULL AND c_unit IS NULL THEN 0 ELSE 1 END + 1) AS attribute_overlap_score
  FROM (SELECT *, abs(qnum - cnum) <= 0.1 OR abs(qnum - cnum) / greatest(qnum, cnum) <= 0.15 AS near1, abs(qnum - cnum2) <= 0.1 OR abs(qnum - cnum2) / greatest(qnum, cnum2) <= 0.15 AS near2 FROM pairs) p
  LEFT JOIN lcs lb ON lb.a = q_brand AND lb.b = c_brand LEFT JOIN lcs lc ON lc.a = q_category AND lc.b = c_category LEFT JOIN lcs lp ON lp.a = q_packaging AND lp.b = c_packaging)"""

SCORE = """weighted AS (SELECT *, CASE WHEN q_brand IS NULL AND c_brand IS NULL THEN 0.12 ELSE 0.0 END AS no_b, CASE WHEN q_category IS NULL AND c_category IS NULL THEN 0.09 ELSE 0.0 END AS no_c FROM feat),
scaled AS (SELECT *, CAST(1.0 AS DOUBLE) / (1.0 - no_b - no_c) AS k FROM weighted),
parts AS (SELECT *, CASE WHEN supplier_mapping_hit = 1 THEN 'supplier_exact' WHEN article_exact = 1 AND brand_exact = 1 THEN 'article_brand_exact' END AS short_circuit,
  k * (CASE WHEN no_b > 0 THEN 0 ELSE 0.08 * brand_exact + 0.04 * brand_fuzzy END + CASE WHEN no_c > 0 THEN 0 ELSE 0.06 * category_exact + 0.03 * category_fuzzy END
   + 0.12 * lexical_score + 0.18 * semantic_score + 0.26 * rerank_score + 0.14 * number_signature_score + 0.03 * packaging_match_score + 0.02 * unit_match_score
   + 0.03 * attribute_overlap_score + 0.01 * alias_hit) AS base0,
  0.05 * article_exact + 0.05 * manufacturer_code_exact + CASE WHEN brand_exact = 1 AND number_signature_score >= 0.9 THEN 0.03 ELSE 0 END + 0.02 * alias_hit AS bonus0,
  -(CASE WHEN critical_number_conflict THEN 0.18 ELSE 0 END + CASE WHEN category_conflict THEN 0.15 ELSE 0 END + CASE WHEN packaging_conflict THEN 0.12 ELSE 0 END
   + CASE WHEN unit_conflict THEN 0.10 ELSE 0 END + CASE WHEN brand_conflict AND article_exact + manufacturer_code_exact = 0 THEN 0.08 ELSE 0 END) AS penalty0 FROM scaled),
scored AS (SELECT *, CASE WHEN short_circuit IS NULL THEN base0 ELSE 0 END AS base_score, CASE WHEN short_circuit IS NULL THEN bonus0 ELSE 0 END AS bonus,
  CASE WHEN short_circuit IS NULL THEN penalty0 ELSE 0 END AS penalty,
  CASE short_circuit WHEN 'supplier_exact' THEN 0.995 WHEN 'article_brand_exact' THEN 0.985 ELSE least(1.0, greatest(0.0, base0 + bonus0 + penalty0)) END AS final_score,
  short_circuit IS NULL AND ((critical_number_conflict AND article_exact + manufacturer_code_exact = 0) OR (category_conflict AND rerank_score < 0.95)
   OR (brand_conflict AND number_signature_score < 0.6)) AS auto_match_forbidden FROM parts)"""


def _pairs(spark, sf):
    l = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(
        F.min("l_quantity").alias("qty"), F.min("l_discount").alias("disc"), F.min("l_tax").alias("tax"), F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls")
    )
    part = table(spark, sf, "part")
    mine = part.select(F.col("p_partkey").alias("l_partkey"), F.lower("p_brand").alias("b1"), F.lower("p_type").alias("t1"), F.col("p_size").alias("s1"))
    other = part.select(F.col("p_partkey").alias("l_suppkey"), F.lower("p_brand").alias("b2"), F.lower("p_type").alias("t2"), F.col("p_size").alias("s2"), F.col("p_name").alias("name"))
    qty, disc, tax = F.col("qty"), F.col("disc"), F.col("tax")
    code = F.lpad(text("l_suppkey"), 8, "0")
    maker = F.concat(F.lit("M-"), text("l_suppkey"))
    return l.join(mine, "l_partkey").join(other, "l_suppkey").select(
        F.col("l_partkey").alias("item_id"), F.col("l_suppkey").alias("retrieval_rank"), F.concat(F.lit("P"), text("l_suppkey")).alias("product_id"), "name",
        F.when(~(qty > 40), F.col("b1")).alias("q_brand"), F.when(~((disc > 0.08) & (qty > 40)), F.col("b2")).alias("c_brand"),
        F.when(~(tax > 0.05), F.col("t1")).alias("q_category"), F.when(~(disc > 0.07), F.col("t2")).alias("c_category"),
        F.when(F.col("rf") == "A", "pcs").when(F.col("rf") == "R", "kg").alias("q_unit"), F.when(F.col("ls") == "O", "pcs").alias("c_unit"),
        F.when(qty > 30, "box").when(qty > 15, "canister").alias("q_packaging"), F.when(disc > 0.05, "bo").when(disc > 0.02, "box").alias("c_packaging"),
        F.array(F.col("s1").cast("double")).alias("q_numbers"), F.array(F.col("s2").cast("double"), F.floor("qty").cast("double")).alias("c_numbers"),
        F.when(tax < 0.02, code).when(tax < 0.04, maker).alias("q_article"), code.alias("c_article"), maker.alias("c_manufacturer_code"),
        code.alias("article"), F.col("b2").alias("brand"), F.col("t2").alias("category_path"),
        (disc * 12).alias("lexical_score"), (tax * 10 - 0.1).alias("semantic_score"), (qty / 50).alias("rerank_score"),
        (qty == 1).alias("supplier_mapping_hit"), (qty > 45).alias("alias_hit"),
    )


def _features(spark, sf):
    return SC.with_pair_features(_pairs(spark, sf))


def _scored(spark, sf):
    return SC.with_score(_features(spark, sf))


KEYS = "item_id, retrieval_rank"


def _feature_query(name, columns, fuzzy=()):
    listed = ", ".join(f"round({c}, 9) AS {c}" if c in fuzzy else f"CAST({c} AS DOUBLE) AS {c}" if c in NUMERIC else c for c in columns)

    @query(name, with_sql(PAIRS, body=f"SELECT {KEYS}, {listed} FROM feat"))
    def run(spark, sf):
        out = _features(spark, sf).select("item_id", "retrieval_rank", *columns)
        return out.withColumns({c: F.round(c, 9) for c in fuzzy})

    return run


NUMERIC = {
    "lexical_score", "semantic_score", "rerank_score", "article_exact", "manufacturer_code_exact", "brand_exact", "brand_fuzzy", "category_exact", "category_fuzzy",
    "number_signature_score", "unit_match_score", "packaging_match_score", "attribute_overlap_score", "alias_hit", "supplier_mapping_hit",
}
_feature_query("E1_clamped_scores", ["lexical_score", "semantic_score", "rerank_score", "alias_hit"], ("lexical_score", "semantic_score", "rerank_score"))
_feature_query("E2_code_equality", ["article_exact", "manufacturer_code_exact"])
_feature_query("E3_brand_match", ["brand_exact", "brand_fuzzy", "brand_conflict"], ("brand_fuzzy",))
_feature_query("E4_category_match", ["category_exact", "category_fuzzy", "category_conflict"], ("category_fuzzy",))
_feature_query("E5_number_signature", ["number_signature_score", "critical_number_conflict"])
_feature_query("E6_unit_match", ["unit_match_score", "unit_conflict"])
_feature_query("E7_packaging_match", ["packaging_match_score", "packaging_conflict"])
_feature_query("E8_attribute_overlap", ["attribute_overlap_score"], ("attribute_overlap_score",))


def _score_query(name, columns, sql_columns=None):
    listed = sql_columns or ", ".join(f"round(CAST({c} AS DOUBLE), 9) AS {c}" if c.endswith(("score", "bonus", "penalty")) else c for c in columns)

    @query(name, with_sql(PAIRS, SCORE, body=f"SELECT {KEYS}, {listed} FROM scored"))
    def run(spark, sf):
        out = _scored(spark, sf).select("item_id", "retrieval_rank", *columns)
        return out.withColumns({c: F.round(c, 9) for c in columns if c.endswith(("score", "bonus", "penalty"))})

    return run


_score_query("E10_base_score", ["base_score"])
_score_query("E11_bonus", ["bonus"])
_score_query("E12_penalty", ["penalty"])
_score_query("E13_final_score", ["final_score"])
_score_query("E14_auto_forbidden", ["auto_match_forbidden"])
_score_query("E15_short_circuit", ["short_circuit"])


@query("E9_effective_weights", with_sql(PAIRS, SCORE, body="""
SELECT item_id, retrieval_rank, round(CASE WHEN no_b > 0 THEN 0 ELSE 0.08 * k END, 9) AS brand_exact, round(CASE WHEN no_c > 0 THEN 0 ELSE 0.06 * k END, 9) AS category_exact, round(0.26 * k, 9) AS rerank_score FROM scaled"""))
def e9(spark, sf):
    weights = SC.effective_weights()
    return _features(spark, sf).select("item_id", "retrieval_rank", *[F.round(weights[c], 9).alias(c) for c in ("brand_exact", "category_exact", "rerank_score")])


RULES = """rules AS (SELECT s_suppkey, s_suppkey % 4 = 0 AS strict, CASE WHEN s_acctbal > 5000 THEN 0.85 END AS sa, CASE WHEN s_acctbal > 7000 THEN 0.6 END AS sr,
  s_acctbal > 3000 AS has_s, CASE WHEN s_nationkey < 10 THEN 0.9 END AS ca, CASE WHEN s_nationkey < 10 THEN 0.7 END AS cr, s_nationkey < 20 AS has_c FROM supplier),
limits AS (SELECT s_suppkey, strict, CASE WHEN has_s AND sa IS NOT NULL THEN sa WHEN has_c AND ca IS NOT NULL THEN ca WHEN strict THEN 0.96 ELSE 0.93 END AS auto,
  coalesce(CASE WHEN has_s THEN sr END, CASE WHEN (NOT has_s OR sa IS NULL) AND has_c THEN cr END, CASE WHEN strict THEN 0.8 ELSE 0.75 END) AS review FROM rules)"""


def _limits(spark, sf):
    s = table(spark, sf, "supplier")
    level = lambda has, a, r: F.when(has, F.struct(a.alias("auto"), r.alias("review")))
    supplier = level(F.col("s_acctbal") > 3000, F.when(F.col("s_acctbal") > 5000, 0.85), F.when(F.col("s_acctbal") > 7000, 0.6))
    near = F.col("s_nationkey") < 10
    category = level(F.col("s_nationkey") < 20, F.when(near, 0.9), F.when(near, 0.7))
    strict = F.col("s_suppkey") % 4 == 0
    return s.select("s_suppkey", SC.resolved_thresholds(strict, None, None, supplier, category).alias("t")).select("s_suppkey", "t.auto", "t.review")


@query("E16_thresholds", with_sql(RULES, body="SELECT s_suppkey, CAST(auto AS DOUBLE) AS auto, CAST(review AS DOUBLE) AS review FROM limits"))
def e16(spark, sf):
    return _limits(spark, sf)


STATUS = "CASE WHEN final_score >= 0.6 AND NOT auto_match_forbidden THEN 'auto_match' WHEN final_score >= 0.4 THEN 'review_needed' ELSE 'no_match' END"
OPTIONS = MatchOptions(auto_threshold=0.6, review_threshold=0.4)


@query("E17_status", with_sql(PAIRS, SCORE, body=f"SELECT item_id, retrieval_rank, {STATUS} AS status FROM (SELECT * REPLACE (round(final_score, 12) AS final_score) FROM scored)"))
def e17(spark, sf):
    rows = _scored(spark, sf).withColumn("final_score", F.round("final_score", 12))
    status = SC.status_of(F.col("final_score"), F.col("auto_match_forbidden"), F.lit(0.6), F.lit(0.4))
    return rows.select("item_id", "retrieval_rank", status.alias("status"))


REASONS = """CASE short_circuit WHEN 'supplier_exact' THEN 'Найдено точное соответствие поставщика' WHEN 'article_brand_exact' THEN 'Совпадает артикул и бренд' ELSE concat_ws('; ',
  CASE WHEN brand_exact = 1 THEN 'Совпадает бренд' WHEN brand_fuzzy > 0.7 THEN 'Похожий бренд' END, CASE WHEN article_exact = 1 THEN 'Совпадает артикул' END,
  CASE WHEN manufacturer_code_exact = 1 THEN 'Совпадает код производителя' END,
  CASE WHEN number_signature_score >= 0.9 THEN 'Совпадают ключевые числовые характеристики' WHEN number_signature_score >= 0.5 THEN 'Частично совпадают числовые характеристики' END,
  CASE WHEN category_exact = 1 THEN 'Совпадает категория' WHEN category_fuzzy > 0.5 THEN 'Похожая категория' END,
  CASE WHEN unit_match_score = 1 THEN 'Совпадает единица измерения' END, CASE WHEN packaging_match_score = 1 THEN 'Совпадает фасовка' END, CASE WHEN alias_hit = 1 THEN 'Найден через алиас' END,
  CASE WHEN rerank_score > 0.8 THEN 'Высокая семантическая релевантность' WHEN lexical_score > 0.5 THEN 'Высокое текстовое сходство' END,
  CASE WHEN critical_number_conflict THEN 'Конфликт по ключевым числовым характеристикам' END, CASE WHEN category_conflict THEN 'Конфликт по категории' END,
  CASE WHEN packaging_conflict THEN 'Конфликт по фасовке' END, CASE WHEN unit_conflict THEN 'Конфликт по единице измерения' END, CASE WHEN brand_conflict THEN 'Конфликт по бренду' END) END"""


@query("E18_reasons", with_sql(PAIRS, SCORE, body=f"SELECT item_id, retrieval_rank, {REASONS} AS reasons FROM scored"))
def e18(spark, sf):
    return _scored(spark, sf).select("item_id", "retrieval_rank", F.array_join(SC.reasons(), "; ").alias("reasons"))


def _decided(spark, sf):
    rows = _scored(spark, sf).withColumn("final_score", F.round("final_score", 12)).withColumn("supplier_id", F.lit(None).cast("string")).withColumn("strict", F.lit(False))
    return B.decide_pairs(rows, B.MatchInputs(rows), OPTIONS)


BEST = """ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(final_score, 12) DESC, retrieval_rank) AS n FROM scored)"""


@query("E19_best_candidate", with_sql(PAIRS, SCORE, BEST, body=f"""
SELECT item_id, arg_min(product_id, n) AS best_product_id, arg_min({STATUS.replace('final_score', 'round(final_score, 12)')}, n) AS status, round(max(final_score), 9) AS confidence,
  string_agg(product_id, ',' ORDER BY n) FILTER (n <= 5) AS alternatives FROM ranked GROUP BY 1"""))
def e19(spark, sf):
    best = B.best_per_item(_decided(spark, sf))
    return best.select(
        "item_id", "best_product_id", "status", F.round("confidence", 9).alias("confidence"),
        F.array_join(F.transform("alternatives", lambda a: a["product_id"]), ",").alias("alternatives"),
    )


@query("E20_decision_trace", with_sql(PAIRS, SCORE, BEST, body=f"""
SELECT item_id, CAST({STATUS.replace('final_score', 'round(final_score, 12)')} AS VARCHAR) AS status, short_circuit, CAST(brand_conflict AS VARCHAR) AS brand_conflict, round(bonus, 6) AS bonus FROM ranked WHERE n = 1"""))
def e20(spark, sf):
    trace = B.best_per_item(_decided(spark, sf))
    at = lambda path: F.get_json_object("trace", f"$.{path}")
    return trace.select(
        "item_id", at("decision.status").alias("status"), at("short_circuit").alias("short_circuit"), at("features.brand_conflict").alias("brand_conflict"),
        F.round(at("bonus").cast("double"), 6).alias("bonus"),
    )


@query("E21_override_merge", with_sql(LINES_SQL, MAPPINGS, OVERRIDES, body="""
SELECT line_id, CASE WHEN mapping_type IN ('exact', 'approved') THEN 'auto_match' ELSE 'scored' END AS route,
  CASE WHEN mapping_type IN ('exact', 'approved') THEN 0.995 END AS confidence, CASE WHEN mapping_type IN ('exact', 'approved') THEN product_id END AS product_id
FROM lines LEFT JOIN override USING (line_id)"""))
def e21(spark, sf):
    told = _told(spark, sf)
    # of copies of a line the best mapping is the same, so they need not be told apart to find it
    found = M.supplier_overrides(_written_out(told), mappings(spark, sf), up_to="approved")
    # a line always has an id; said here, both uses of the hits ask for the same rows, which Spark then makes once
    found = found.filter(F.col("mapping_type").isin("exact", "approved") & F.col("line_id").isNotNull())
    trace = F.struct(F.lit("supplier_override").alias("short_circuit"), "mapping_type")
    done = B.fixed_results(found.withColumnRenamed("line_id", "item_id"), "auto_match", SC.SUPPLIER_SCORE, B.OVERRIDE_REASON, "product_id", trace)
    done = done.select(F.col("item_id").alias("line_id"), F.col("status").alias("route"), "confidence", F.col("best_product_id").alias("product_id"))
    # one move by id serves both the distinct rows and the comparison
    lines = told.repartition("line_id").distinct()
    rest = lines.join(found.select("line_id"), "line_id", "left_anti").select("line_id", F.lit("scored").alias("route"))
    return done.unionByName(rest, allowMissingColumns=True)


@query("E22_no_candidates", """
SELECT l_orderkey AS item_id, 'no_match' AS status, CAST(0 AS DOUBLE) AS confidence, 'Кандидаты не найдены' AS reason FROM (SELECT DISTINCT l_orderkey FROM lineitem)
WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <> 13 AND l_returnflag = 'N')""")
def e22(spark, sf):
    l = table(spark, sf, "lineitem")
    live = catalog(spark, sf).filter("is_active").select(F.col("p_partkey").alias("l_partkey"))
    hit = l.filter("l_returnflag = 'N'").join(live, "l_partkey").select("l_orderkey")
    missed = l.select("l_orderkey").distinct().join(hit, "l_orderkey", "left_anti").withColumnRenamed("l_orderkey", "item_id")
    out = B.fixed_results(missed, "no_match", 0.0, B.EMPTY_REASON, None, F.struct(F.lit("retrieval").alias("stage")))
    return out.select("item_id", "status", "confidence", F.col("reasons")[0].alias("reason"))


def _results(spark, sf):
    """Results of orders, as a table the verdicts of a model can be merged into."""
    o = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "auto_match").when(F.col("o_orderstatus") == "O", "review_needed").otherwise("no_match")
    return o.select(
        F.col("o_orderkey").alias("line_id"), F.concat(F.lit("S"), text("o_custkey")).alias("supplier_id"), status.alias("status"),
        F.round(F.col("o_totalprice") / 600000, 4).alias("confidence"), F.concat(F.lit("P"), text("o_custkey")).alias("best_product_id"),
        F.array(F.lit("r")).alias("reasons"), (F.col("o_orderkey") % 5).cast("int").alias("candidates_reranked"),
    )


RESULTS = """results AS (SELECT o_orderkey AS line_id, 'S' || o_custkey AS supplier_id, CASE o_orderstatus WHEN 'F' THEN 'auto_match' WHEN 'O' THEN 'review_needed' ELSE 'no_match' END AS status,
  round(o_totalprice / 600000, 4) AS confidence, 'P' || o_custkey AS best_product_id, 'r' AS reasons, o_orderkey % 5 AS candidates_reranked FROM orders)"""


@query("E23_external_verdicts", with_sql(RESULTS, """prof AS (SELECT 'S' || s_suppkey AS supplier_id, s_nationkey < 5 AS strict, CASE WHEN s_acctbal > 0 THEN 0.9 END AS sa FROM supplier),
v AS (SELECT r.*, coalesce(strict, false) AS st, sa, CASE WHEN line_id % 3 <> 0 THEN round((line_id % 100) / 100, 2) END AS vc FROM results r LEFT JOIN prof USING (supplier_id))""", body="""
SELECT line_id, CASE WHEN vc IS NULL THEN status WHEN vc >= coalesce(sa, CASE WHEN st THEN 0.96 ELSE 0.93 END) THEN 'auto_match' WHEN vc >= CASE WHEN st THEN 0.8 ELSE 0.75 END THEN 'review_needed' ELSE 'no_match' END AS status,
  coalesce(vc, confidence) AS confidence, CASE WHEN vc IS NULL THEN best_product_id ELSE 'P' || line_id END AS best_product_id, CASE WHEN vc IS NULL THEN reasons ELSE 'LLM Matcher: why' END AS reasons FROM v"""))
def e23(spark, sf):
    key = F.col("o_orderkey")
    verdicts = table(spark, sf, "orders").filter(key % 3 != 0).select(
        key.alias("line_id"), F.concat(F.lit("P"), text("o_orderkey")).alias("product_id"), F.round((key % 100) / 100, 2).alias("confidence"), F.lit("why").alias("reasoning")
    )
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), text("s_suppkey")).alias("supplier_id"), (F.col("s_nationkey") < 5).alias("strict_mode"),
        F.when(F.col("s_acctbal") > 0, '{"thresholds": {"auto_threshold": 0.9}}').otherwise("{}").alias("normalization_rules"),
    )
    results = _results(spark, sf)
    out = B.apply_verdicts(results, verdicts, B.MatchInputs(results, suppliers=suppliers))
    return out.select("line_id", "status", "confidence", "best_product_id", F.col("reasons")[0].alias("reasons"))


@query("E24_agent_decisions", with_sql(RESULTS, """d AS (SELECT *, CASE line_id % 4 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'likely_match' WHEN 2 THEN 'no_match' END AS dt, CASE WHEN line_id % 7 <> 0 THEN 'P' || line_id END AS ap FROM results)""", body="""
SELECT line_id,
  CASE WHEN status = 'auto_match' OR dt IS NULL THEN status WHEN candidates_reranked = 0 AND ap IS NOT NULL AND dt <> 'no_match' THEN 'review_needed' WHEN candidates_reranked > 0 AND ap IS NOT NULL AND dt = 'exact_match' THEN 'auto_match' ELSE status END AS status,
  CASE WHEN status = 'auto_match' OR dt IS NULL THEN confidence WHEN candidates_reranked = 0 AND ap IS NOT NULL AND dt <> 'no_match' THEN 0.8 WHEN candidates_reranked > 0 AND ap IS NOT NULL AND dt = 'exact_match' THEN 0.99 ELSE confidence END AS confidence,
  CASE WHEN status = 'auto_match' OR dt IS NULL THEN 'r' WHEN candidates_reranked = 0 AND ap IS NOT NULL AND dt <> 'no_match' THEN 'Agent fallback: why' WHEN candidates_reranked > 0 THEN 'Agent Resolution: why' ELSE 'r' END AS reasons FROM d"""))
def e24(spark, sf):
    key = F.col("o_orderkey")
    decisions = table(spark, sf, "orders").filter(key % 4 != 3).select(
        key.alias("line_id"), F.when(key % 4 == 0, "exact_match").when(key % 4 == 1, "likely_match").otherwise("no_match").alias("decision_type"),
        F.when(key % 7 != 0, F.concat(F.lit("P"), text("o_orderkey"))).alias("product_id"), F.lit("why").alias("reasoning"),
    )
    return B.apply_agent(_results(spark, sf), decisions).select("line_id", "status", "confidence", F.col("reasons")[0].alias("reasons"))


@query("E25_supplier_rules", """
SELECT 'S' || s_suppkey AS supplier_id, s_nationkey < 5 AS supplier_strict, CASE WHEN s_acctbal > 0 THEN 0.9 END AS auto FROM supplier""")
def e25(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.concat(F.lit("S"), text("s_suppkey")).alias("supplier_id"), (F.col("s_nationkey") < 5).alias("strict_mode"),
        F.when(F.col("s_acctbal") > 0, '{"thresholds": {"auto_threshold": 0.9}}').otherwise("{}").alias("normalization_rules"),
    )
    return B.supplier_rules(suppliers).select("supplier_id", "supplier_strict", F.col("supplier_thresholds.auto").alias("auto"))


# --- E26: order lines, as buyers might write them, against the whole catalog ---

MATCH_OPTIONS = MatchOptions(auto_threshold=0.6, review_threshold=0.5, scale_rerank=True)

MATCH = """top50 AS (SELECT q, product_id, lex, row_number() OVER (PARTITION BY q ORDER BY CAST(1.0 AS DOUBLE) / (60 + lr) DESC, product_id) AS rk, CAST(1.0 AS DOUBLE) / (60 + lr) AS rrf FROM lexical),
top10 AS (SELECT *, min(rrf) OVER w AS lo, max(rrf) OVER w AS hi, count(*) OVER w AS n FROM (SELECT * FROM top50 WHERE rk <= 10) WINDOW w AS (PARTITION BY q)),
rer AS (SELECT *, CASE WHEN n = 1 THEN rrf WHEN hi > lo THEN (rrf - lo) / (hi - lo) ELSE 1.0 END AS rr FROM top10),
kinds AS (SELECT DISTINCT p_name || ' ' || p_size AS q, p_type AS cat, p_size AS size FROM part),
lens AS (SELECT DISTINCT lower(a.p_type) AS a, lower(b.p_type) AS b FROM part a, part b),
lcs AS (WITH RECURSIVE step AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0) AS row FROM (SELECT x.t AS a, y.t AS b FROM (SELECT DISTINCT lower(p_type) AS t FROM part) x, (SELECT DISTINCT lower(p_type) AS t FROM part) y)
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(b) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k:
    CASE WHEN k = 1 THEN 0 ELSE greatest(row[k], row[k - 1] + CASE WHEN substr(a, i + 1, 1) = substr(b, k - 1, 1) THEN 1 ELSE 0 END) END))) FROM step WHERE i < length(a))
  SELECT a, b, 2.0 * row[length(b) + 1] / (length(a) + length(b)) AS ratio FROM step WHERE i = length(a)),
pair AS (SELECT k.q, k.cat, r.product_id, r.rk, lex, rr, ratio, p.p_size AS csize, k.size, k.cat = p.p_type AS same FROM kinds k JOIN rer r USING (q) JOIN part p ON 'P' || p.p_partkey = r.product_id
  JOIN lcs ON lcs.a = lower(k.cat) AND lcs.b = lower(p.p_type)),
judged AS (SELECT *, size = csize OR abs(size - csize) / greatest(size, csize) <= 0.15 AS num FROM pair),
result AS (SELECT *, least(1.0, greatest(0.0, 0.06 * CASE WHEN same THEN 1 ELSE 0 END + 0.03 * ratio + 0.12 * least(1.0, lex) + 0.26 * rr + 0.14 * CASE WHEN num THEN 1 ELSE 0 END + 0.015 + 0.01
   + 0.03 * CASE WHEN size = csize THEN 0.5 ELSE 0 END - CASE WHEN num THEN 0 ELSE 0.18 END - CASE WHEN ratio < 0.3 THEN 0.15 ELSE 0 END)) AS score,
  NOT num OR (ratio < 0.3 AND rr < 0.95) AS forbidden FROM judged),
best AS (SELECT q, cat, arg_min(product_id, o) AS best_product_id, arg_min(score, o) AS confidence, arg_min(forbidden, o) AS forbidden FROM (SELECT *, {'s': -round(score, 9), 'r': rk} AS o FROM result) GROUP BY 1, 2),
outcome AS (SELECT *, CASE WHEN round(confidence, 9) >= 0.6 AND NOT forbidden THEN 'auto_match' WHEN round(confidence, 9) >= 0.5 THEN 'review_needed' ELSE 'no_match' END AS status FROM best),
matched_lines AS (SELECT l_orderkey, l_linenumber, status, round(confidence, 6) AS confidence, best_product_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN outcome ON q = p_name || ' ' || p_size AND cat = p_type)"""


def match_lines(spark, sf):
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", F.upper("p_name"), text("p_size")).alias("raw_text"), F.col("p_type").alias("category_hint")
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")


def matched(spark, sf):
    return B.batch_match(match_lines(spark, sf), B.MatchInputs(catalog(spark, sf)), MATCH_OPTIONS)


@query("E26_batch_match", with_sql(CATALOG, QUERIES_SQL, *LEX, MATCH, body="SELECT * FROM matched_lines"))
def e26(spark, sf):
    return matched(spark, sf).select("l_orderkey", "l_linenumber", "status", F.round("confidence", 6).alias("confidence"), "best_product_id")


@query("E26_batch_match_summary", with_sql(CATALOG, QUERIES_SQL, *LEX, MATCH, body="""
SELECT status, count(*) AS lines, count(DISTINCT best_product_id) AS products, round(avg(confidence), 6) AS mean_confidence FROM matched_lines GROUP BY 1"""))
def e26_summary(spark, sf):
    return matched(spark, sf).groupBy("status").agg(
        F.count("*").alias("lines"), F.count_distinct("best_product_id").alias("products"), F.round(F.avg(F.round("confidence", 6)), 6).alias("mean_confidence")
    )


@query("I3_retrieval_sizes", with_sql(CATALOG, QUERIES_SQL, *lexical_sql(0.5, 0.4, 7), body="""
SELECT q AS query_id, product_id, lex AS lexical_score, row_number() OVER (PARTITION BY q ORDER BY lr, product_id) AS retrieval_rank FROM lexical QUALIFY retrieval_rank <= 3"""))
def i3_sizes(spark, sf):
    options = MatchOptions(retrieval_top_n=3, list_cap=7, name_threshold=0.5, document_threshold=0.4, relaxed_top_n=0)
    found = R.hybrid_search(_queries(spark, sf), catalog(spark, sf), options=options)
    return found.select("query_id", "product_id", "lexical_score", F.col("retrieval_rank").cast("bigint").alias("retrieval_rank"))


@query("A13_candidate_rows", with_sql(CATALOG, QUERIES_SQL, *LEX, MATCH, body="""
SELECT q || '|' || cat AS line_id, product_id, CAST(place AS INTEGER) AS retrieval_rank, round(score, 6) AS final_score FROM (
  SELECT *, row_number() OVER (PARTITION BY q, cat ORDER BY round(score, 9) DESC, rk) AS place FROM result) WHERE place <= 5"""))
def a13_candidates(spark, sf):
    lines = table(spark, sf, "part").select(
        F.concat_ws(" ", F.upper("p_name"), text("p_size")).alias("raw_text"), F.col("p_type").alias("category_hint"),
        F.concat(F.concat_ws(" ", "p_name", text("p_size")), F.lit("|"), "p_type").alias("line_id"),
    ).distinct()
    rows = B.rank_candidates(B.batch_match(lines, B.MatchInputs(catalog(spark, sf)), MATCH_OPTIONS))
    return rows.select("line_id", "product_id", "retrieval_rank", F.round("final_score", 6).alias("final_score"))
