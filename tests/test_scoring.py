"""Similarity, scores and decisions against hand-worked cases and plain oracles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linewright.functions import scoring as SC
from linewright.functions import similarity as S
from linewright.plans import batch_match as B
from linewright.options import MatchOptions

PAIR = (
    "q_brand string, q_numbers array<double>, q_unit string, q_packaging string, q_category string, q_article string, "
    "c_brand string, c_article string, c_manufacturer_code string, c_numbers array<double>, c_unit string, "
    "c_packaging string, c_category string, lexical_score double, semantic_score double, rerank_score double, "
    "supplier_mapping_hit boolean, alias_hit boolean"
)
BLANK = dict(
    q_brand=None, q_numbers=[], q_unit=None, q_packaging=None, q_category=None, q_article=None, c_brand=None, c_article=None,
    c_manufacturer_code=None, c_numbers=[], c_unit=None, c_packaging=None, c_category=None, lexical_score=0.0,
    semantic_score=0.0, rerank_score=0.0, supplier_mapping_hit=False, alias_hit=False,
)


def score(spark, *cases):
    df = spark.createDataFrame([{**BLANK, **c} for c in cases], PAIR).coalesce(1)
    out = SC.with_score(SC.with_pair_features(df)).withColumn("reasons", SC.reasons())
    return [r.asDict() for r in out.collect()]


def greedy(q, c):
    rest, open_, matched = list(c), [], 0
    for x in q:
        if x in rest:
            rest.remove(x)
            matched += 1
        else:
            open_.append(x)
    for x in open_:
        for i, y in enumerate(rest):
            if abs(x - y) <= 0.1 or abs(x - y) / max(abs(x), abs(y), 1e-9) <= 0.15:
                rest.pop(i)
                matched += 1
                break
    return matched


def test_number_signature(spark):
    rng = random.Random(3)
    pool = [1.0, 1.1, 2.0, 2.25, 10.0, 10.4, 11.0, 100.0, 110.0, 0.0]
    cases = [([rng.choice(pool) for _ in range(rng.randint(0, 5))], [rng.choice(pool) for _ in range(rng.randint(0, 5))]) for _ in range(300)]
    cases += [([10.0, 10.4], [10.0]), ([100.0], [110.0])]
    df = spark.createDataFrame(cases, "q array<double>, c array<double>")
    for r in df.select("q", "c", S.number_signature(F.col("q"), F.col("c")).alias("s")).collect():
        both = bool(r.q and r.c)
        matched = greedy(r.q, r.c) if both else 0
        assert r.s.matched == matched, (r.q, r.c)
        assert r.s.conflict == (both and matched == 0)
        assert r.s.score == pytest.approx(matched / (len(r.q) + len(r.c) - matched) if both else 0.0)
    last = df.select(S.number_signature(F.array(F.lit(10.0), F.lit(10.4)), F.array(F.lit(10.0))).alias("s")).first()
    assert last.s.score == 0.5


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_edit_ratio(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("абвab1") for _ in range(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(zip(words, reversed(words))), "a string, b string")
    for r in df.select("a", "b", S.edit_ratio(F.col("a"), F.col("b")).alias("x")).collect():
        total = len(r.a) + len(r.b)
        assert r.x == pytest.approx(2 * lcs(r.a, r.b) / total if total else 1.0)


def test_text_rank(spark):
    def rank(terms, doc):
        near = lambda d: 0.1 * math.sqrt(1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2)) if d <= 100 else 1e-30)
        at = [(i, p) for i, t in enumerate(terms) for p, w in enumerate(doc, 1) if w == t]
        if len(terms) == 1:
            return sum(0.1 / (j * j) for j in range(1, len(at) + 1)) / 1.64493406685
        miss = 1.0
        for i, p in at:
            for k, q in at:
                if k < i and p != q:
                    miss *= 1 - near(abs(p - q))
        return 1 - miss

    cases = [(["a", "b"], "a b"), (["a", "b"], "a x x b a"), (["a"], "a c a"), (["a", "b", "c"], "c a"), (["a", "z"], "a"), (["q"], "a")]
    df = spark.createDataFrame([(t, d.split()) for t, d in cases], "t array<string>, d array<string>")
    got = df.select("t", "d", S.text_rank(F.col("t"), S.lexeme_positions(F.col("d"))).alias("r")).collect()
    for r in got:
        assert r.r == pytest.approx(rank(r.t, r.d)), (r.t, r.d)


def test_trigrams(spark):
    df = spark.createDataFrame([("Cat, cat",), ("",), (None,)], "t string")
    assert [sorted(r.g) for r in df.select(S.trigrams(F.col("t")).alias("g")).collect()] == [["  c", " ca", "at ", "cat"], [], []]


def test_short_circuits_and_scores(spark):
    mapped, exact, bonus, conflicts, category = score(
        spark,
        dict(supplier_mapping_hit=True),
        dict(q_article=" A1 ", c_article="a1", q_brand="B", c_brand="b "),
        dict(q_article="a1", c_article="a1", c_manufacturer_code="A1", alias_hit=True, q_numbers=[1.0], c_numbers=[9.0], q_brand="x"),
        dict(q_brand="bosch", c_brand="viega", q_unit="kg", c_unit="m", q_packaging="box", c_packaging="рулон", q_numbers=[1.0, 2.0], c_numbers=[1.0, 2.0]),
        dict(q_category="abc", c_category="xyz", rerank_score=0.96),
    )
    assert (mapped["final_score"], mapped["short_circuit"]) == (0.995, "supplier_exact")
    assert mapped["reasons"] == ["Найдено точное соответствие поставщика"]
    assert (exact["final_score"], exact["short_circuit"]) == (0.985, "article_brand_exact")
    assert bonus["bonus"] == pytest.approx(0.12) and bonus["penalty"] == pytest.approx(-0.18) and not bonus["auto_match_forbidden"]
    assert conflicts["penalty"] == pytest.approx(-0.30) and not conflicts["auto_match_forbidden"]
    assert category["penalty"] == pytest.approx(-0.15) and not category["auto_match_forbidden"]


def test_weights(spark):
    assert sum(SC.WEIGHTS.values()) == pytest.approx(1.0)
    df = spark.createDataFrame([(False, False, False, False), (True, False, False, True), (True, True, False, False)], "query_has_brand boolean, candidate_has_brand boolean, query_has_category boolean, candidate_has_category boolean")
    for r in df.select(*[w.alias(n) for n, w in SC.effective_weights().items()]).collect():
        assert sum(r) == pytest.approx(1.0)


def test_packaging_and_overlap(spark):
    near, far, overlap = score(
        spark,
        dict(q_packaging="box", c_packaging="bo"),
        dict(q_packaging="box", c_packaging="рулон"),
        dict(q_numbers=[1.0, 2.0], c_numbers=[2.0, 3.0], q_unit="KG", c_unit="kg"),
    )
    assert near["packaging_match_score"] == 0.5 and not near["packaging_conflict"]
    assert far["packaging_match_score"] == 0.0 and far["packaging_conflict"]
    assert overlap["attribute_overlap_score"] == pytest.approx(2 / 3)


@pytest.mark.parametrize(
    "score_, strict, explicit, supplier, category, forbidden, want",
    [
        (0.91, False, (None, None), None, None, False, "review_needed"),
        (0.91, False, (0.90, None), None, None, False, "auto_match"),
        (0.70, False, (None, None), None, None, False, "no_match"),
        (0.70, False, (None, 0.65), None, None, False, "review_needed"),
        (0.94, False, (None, None), None, None, False, "auto_match"),
        (0.94, True, (None, None), None, None, False, "review_needed"),
        (0.86, False, (None, None), (0.85, None), None, False, "auto_match"),
        (0.86, False, (None, None), None, (0.90, 0.85), False, "review_needed"),
        (0.99, False, (None, None), None, None, True, "review_needed"),
        (0.50, False, (None, 0.0), (0.9, 0.6), None, False, "no_match"),
    ],
)
def test_decisions(spark, score_, strict, explicit, supplier, category, forbidden, want):
    lit = lambda v: F.lit(v).cast("double")
    level = lambda t: None if t is None else F.struct(lit(t[0]).alias("auto"), lit(t[1]).alias("review"))
    t = SC.resolved_thresholds(F.lit(strict), lit(explicit[0]), lit(explicit[1]), level(supplier), level(category))
    row = spark.range(1).select(SC.status_of(lit(score_), F.lit(forbidden), t["auto"], t["review"]).alias("s")).first()
    assert row.s == want


def test_batch_match_and_overrides(spark):
    columns = "product_id string, name string, normalized_name string, article string, code string, manufacturer_code string, brand string, normalized_brand string, category_id string, category_path string, unit string, packaging string, search_document string, is_active boolean"
    catalog = spark.createDataFrame(
        [
            ("p1", "Насос grundfos 25-40", "насос grundfos 25-40", "96281375", None, None, "Grundfos", "grundfos", None, "Насосы", "шт", None, "Насос grundfos 25-40 | Grundfos", True),
            ("p2", "Клей 25 кг", "клей 25 kg", None, None, None, None, None, None, "Клеи", "кг", None, "Клей 25 кг", True),
            ("p3", "Старый насос", "старый насос", None, None, None, None, None, None, None, None, None, "Старый насос", False),
        ],
        columns,
    )
    mappings = spark.createDataFrame(
        [("m1", "s1", None, None, "особый клей", "особый клей", "p2", "approved", None, True)],
        "mapping_id string, supplier_id string, supplier_sku string, supplier_article string, supplier_raw_text string, normalized_supplier_text string, product_id string, mapping_type string, confidence double, is_active boolean",
    )
    lines = spark.createDataFrame(
        [("1", "s1", "Насос Грундфос 25-40 арт.96281375"), ("2", "s1", "особый клей"), ("3", "s1", "Насос Грундфос 25-40 арт.96281375"), ("4", None, "клей 25 кг")],
        "line_id string, supplier_id string, raw_text string",
    )
    out = {r.line_id: r for r in B.batch_match(lines, B.MatchInputs(catalog, mappings=mappings), MatchOptions()).collect()}
    assert len(out) == 4
    assert (out["1"].best_product_id, out["1"].status, out["1"].confidence) == ("p1", "auto_match", 0.985)
    assert out["3"].best_product_id == "p1"
    assert (out["2"].best_product_id, out["2"].status, out["2"].confidence) == ("p2", "auto_match", 0.995)
    assert out["4"].best_product_id == "p2"
    assert all("p3" not in [a.product_id for a in r.alternatives] for r in out.values())
