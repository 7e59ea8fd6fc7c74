"""The whole match with every input at once, against what each input must change."""

import pytest
from pyspark.sql import functions as F

from linewright.options import MatchOptions
from linewright.plans import batch_match as B

CATALOG = "product_id string, name string, normalized_name string, article string, code string, manufacturer_code string, brand string, normalized_brand string, category_id string, category_path string, unit string, packaging string, search_document string, is_active boolean"


def product(key, name, article=None, brand=None, category=None, unit="шт"):
    return (key, name, name.lower(), article, None, None, brand, brand and brand.lower(), None, category, unit, None, name, True)


@pytest.fixture(scope="module")
def inputs(spark):
    products = [
        product("pump", "Насос циркуляционный 25-40", "555000111", "Grundfos", "Насосы"),
        product("valve", "Кран шаровой 20", None, None, "Арматура"),
        product("glue", "Клей монтажный 310", None, None, "Клеи"),
        product("foam", "Пена монтажная 750", None, None, "Клеи"),
        product("far", "Зонт садовый", None, None, "Сад"),
    ]
    vector = lambda *v: [float(x) for x in v]
    return {
        "catalog": spark.createDataFrame(products, CATALOG),
        "embeddings": spark.createDataFrame([("far", vector(1, 0)), ("glue", vector(0, 1))], "product_id string, vector array<float>"),
        "query_vectors": spark.createDataFrame([("beach thing", vector(1, 0.01))], "n_text string, vector array<float>"),
        "suppliers": spark.createDataFrame([("strict", True, "{}"), ("easy", False, '{"thresholds": {"auto_threshold": 0.05, "review_threshold": 0.01}}')], "supplier_id string, strict_mode boolean, normalization_rules string"),
        "mappings": spark.createDataFrame([("m", "easy", None, None, "наш особый", "наш особый", "foam", "approved", None, True)], "mapping_id string, supplier_id string, supplier_sku string, supplier_article string, supplier_raw_text string, normalized_supplier_text string, product_id string, mapping_type string, confidence double, is_active boolean"),
        "synonyms": spark.createDataFrame([(1, "easy", "шаровик", "кран шаровой", True)], "synonym_id int, supplier_id string, normalized_source_text string, target_text string, is_active boolean"),
        "aliases": spark.createDataFrame([("клей монтажный 310", "glue")], "normalized_alias_text string, product_id string"),
        "category_thresholds": spark.createDataFrame([("Клеи", 0.02, 0.01)], "category_path string, auto double, review double"),
    }


LINES = [
    ("1", "easy", "наш особый"),
    ("2", "easy", "шаровик 20"),
    ("3", None, "Клей монтажный 310"),
    ("4", None, "beach thing"),
    ("5", "strict", "Кран шаровой 20"),
    ("6", None, "qqqq 9"),
    ("7", None, "Насос Грундфос циркуляционный 25-40 арт.555000111"),
]


def run(spark, inputs, **more):
    lines = spark.createDataFrame(LINES, "line_id string, supplier_id string, raw_text string")
    return B.batch_match(lines, B.MatchInputs(**{**inputs, **more}), MatchOptions())


def test_each_input_has_its_effect(spark, inputs):
    rows = run(spark, inputs)
    out = {r.line_id: r for r in rows.collect()}
    assert len(out) == len(LINES)
    assert (out["1"].status, out["1"].best_product_id) == ("auto_match", "foam")  # mapping
    assert out["2"].best_product_id == "valve" and out["2"].n_text == "кран шаровой 20"  # synonym
    assert out["2"].status == "auto_match" and out["5"].status != "auto_match"  # supplier limits, strict
    assert out["3"].status == "auto_match" and "Найден через алиас" in out["3"].reasons  # category limits, alias
    assert out["4"].best_product_id == "far"  # vector
    assert (out["6"].status, out["6"].best_product_id, out["6"].confidence) == ("no_match", None, 0.0)
    assert out["7"].confidence == 0.985
    ranked = B.rank_candidates(rows).collect()
    assert {r.line_id for r in ranked} == {"2", "3", "4", "5", "7"}
    assert all(r.retrieval_rank >= 1 for r in ranked)
    firsts = {r.line_id: r.product_id for r in ranked if r.retrieval_rank == 1}
    assert all(firsts[i] == out[i].best_product_id for i in firsts)


def test_rerank_scores_decide_between_candidates(spark, inputs):
    base = run(spark, inputs)
    glue = base.filter("line_id = '3'").first()
    assert glue.best_product_id == "glue" and glue.candidates_reranked > 1
    items = B.prepare_items(spark.createDataFrame([("x", None, "Клей монтажный 310")], "item_id string, supplier_id string, raw_text string"), B.MatchInputs(inputs["catalog"]))
    query = B.as_queries(items, None, MatchOptions()).first().query_id
    second = next(a.retrieval_rank for a in glue.alternatives if a.product_id == "foam")
    scores = spark.createDataFrame([(query, second - 1, 9.0)], "query_id string, candidate_index int, score double")
    out = {r.line_id: r for r in run(spark, inputs, rerank_scores=scores).collect()}
    assert out["3"].best_product_id == "foam"  # the only candidate that the model returned
    assert out["1"].best_product_id == "foam" and out["5"].status == "no_match"


def test_one_result_per_line_however_often_it_comes(spark, inputs):
    lines = spark.createDataFrame(LINES * 3, "line_id string, supplier_id string, raw_text string").withColumn("line_id", F.monotonically_increasing_id().cast("string"))
    out = B.batch_match(lines, B.MatchInputs(**inputs), MatchOptions())
    assert out.count() == 3 * len(LINES) and out.select("raw_text", "status", "best_product_id").distinct().count() == len(LINES)
