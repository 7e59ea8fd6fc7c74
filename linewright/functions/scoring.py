"""Pair features, score, decision and reasons as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import similarity as S

# --- fixed values ---
WEIGHTS = {
    "brand_exact": 0.08,
    "brand_fuzzy": 0.04,
    "category_exact": 0.06,
    "category_fuzzy": 0.03,
    "lexical_score": 0.12,
    "semantic_score": 0.18,
    "rerank_score": 0.26,
    "number_signature_score": 0.14,
    "packaging_match_score": 0.03,
    "unit_match_score": 0.02,
    "attribute_overlap_score": 0.03,
    "alias_hit": 0.01,
}
SUPPLIER_SCORE = 0.995
ARTICLE_BRAND_SCORE = 0.985
AUTO, REVIEW = 0.93, 0.75
STRICT_AUTO, STRICT_REVIEW = 0.96, 0.80
ARTICLE_BONUS, CODE_BONUS, BRAND_NUMBER_BONUS, ALIAS_BONUS = 0.05, 0.05, 0.03, 0.02
NUMBER_PENALTY, NUMBER_PENALTY_WITHOUT_CODES = -0.18, -0.08
CATEGORY_PENALTY, PACKAGING_PENALTY, UNIT_PENALTY, BRAND_PENALTY = -0.15, -0.12, -0.10, -0.08
SURE_NUMBERS, SURE_RERANK, UNSURE_NUMBERS = 0.9, 0.95, 0.6
# --- end of fixed values ---

FEATURES = [
    "article_exact", "manufacturer_code_exact", "supplier_mapping_hit", "brand_exact",
    "category_exact", "alias_hit", "brand_fuzzy", "category_fuzzy", "lexical_score",
    "semantic_score", "rerank_score", "number_signature_score", "packaging_match_score",
    "unit_match_score", "attribute_overlap_score", "critical_number_conflict",
    "category_conflict", "packaging_conflict", "unit_conflict", "brand_conflict",
    "candidate_has_identifiers", "query_has_brand", "candidate_has_brand",
    "query_has_category", "candidate_has_category",
]


def clamp(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(0.0))))


def folded(text: Column) -> Column:
    """Lowercased and trimmed; empty for missing text."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def _flag(condition: Column) -> Column:
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def _fuzzy(left: Column, right: Column) -> Column:
    """Edit ratio of two filled texts, 1 when equal, null when one is missing."""
    apart = (left != "") & (right != "") & (left != right)
    ratio = S.edit_ratio(F.when(apart, left), F.when(apart, right))
    return F.when((left != "") & (left == right), F.lit(1.0)).otherwise(ratio)


def attribute_overlap(
    query_brand: Column, query_unit: Column, query_numbers: Column,
    brand: Column, unit: Column, numbers: Column,
) -> Column:
    """Mean agreement over brand, unit and numbers known on at least one side."""

    def scalar(a: Column, b: Column) -> Column:
        return _flag(F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False)))

    def known(a: Column, b: Column) -> Column:
        return F.when(a.isNotNull() | b.isNotNull(), 1).otherwise(0)

    mine, theirs = F.array_distinct(query_numbers), F.array_distinct(numbers)
    listed = F.when(
        (F.size(mine) > 0) & (F.size(theirs) > 0), S.jaccard(mine, theirs)
    ).otherwise(F.lit(0.0))
    agreed = scalar(query_brand, brand) + scalar(query_unit, unit) + listed
    compared = known(query_brand, brand) + known(query_unit, unit) + 1
    return agreed / compared


def with_pair_features(pairs: DataFrame) -> DataFrame:
    """Add the feature columns to (line, candidate) pairs.

    Line side: ``q_brand q_numbers q_unit q_packaging q_category q_article``.
    Candidate side: ``c_brand c_article c_manufacturer_code c_numbers c_unit
    c_packaging c_category``. Scores and hits: ``lexical_score semantic_score
    rerank_score supplier_mapping_hit alias_hit``.
    """
    c = F.col
    qb, cb = folded(c("q_brand")), folded(c("c_brand"))
    qc, cc = folded(c("q_category")), folded(c("c_category"))
    qu, cu = folded(c("q_unit")), folded(c("c_unit"))
    qp, cp = folded(c("q_packaging")), folded(c("c_packaging"))
    qa = folded(c("q_article"))
    staged = (
        pairs.withColumn("_brand_ratio", _fuzzy(qb, cb))
        .withColumn("_category_ratio", _fuzzy(qc, cc))
        .withColumn("_packaging_ratio", _fuzzy(qp, cp))
        .withColumn("_numbers", S.number_signature(c("q_numbers"), c("c_numbers")))
    )
    code_hit = lambda code: _flag((qa != "") & (qa == folded(c(code))))
    return staged.withColumns(
        {
            "lexical_score": clamp(c("lexical_score")),
            "semantic_score": clamp(c("semantic_score")),
            "rerank_score": clamp(c("rerank_score")),
            "supplier_mapping_hit": _flag(F.coalesce(c("supplier_mapping_hit"), F.lit(False))),
            "alias_hit": _flag(F.coalesce(c("alias_hit"), F.lit(False))),
            "candidate_has_identifiers": _filled(c("c_article")) | _filled(c("c_brand")),
            "article_exact": code_hit("c_article"),
            "manufacturer_code_exact": code_hit("c_manufacturer_code"),
            "brand_exact": _flag((qb != "") & (qb == cb)),
            "brand_fuzzy": F.coalesce("_brand_ratio", F.lit(0.0)),
            "brand_conflict": F.coalesce(c("_brand_ratio") < 0.4, F.lit(False)),
            "query_has_brand": qb != "",
            "candidate_has_brand": cb != "",
            "category_exact": _flag((qc != "") & (qc == cc)),
            "category_fuzzy": F.coalesce("_category_ratio", F.lit(0.0)),
            "category_conflict": F.coalesce(c("_category_ratio") < 0.3, F.lit(False)),
            "query_has_category": qc != "",
            "candidate_has_category": cc != "",
            "number_signature_score": c("_numbers.score"),
            "critical_number_conflict": c("_numbers.conflict"),
            "unit_match_score": F.when((qu == "") | (cu == ""), F.lit(0.5)).otherwise(_flag(qu == cu)),
            "unit_conflict": (qu != "") & (cu != "") & (qu != cu),
            "packaging_match_score": F.when((qp == "") | (cp == ""), F.lit(0.5))
            .when(qp == cp, F.lit(1.0))
            .when(c("_packaging_ratio") > 0.6, F.lit(0.5))
            .otherwise(F.lit(0.0)),
            "packaging_conflict": (qp != "") & (cp != "") & (qp != cp)
            & F.coalesce(c("_packaging_ratio") <= 0.6, F.lit(False)),
            "attribute_overlap_score": attribute_overlap(
                c("q_brand"), c("q_unit"), c("q_numbers"), c("c_brand"), c("c_unit"), c("c_numbers")
            ),
        }
    ).drop("_brand_ratio", "_category_ratio", "_packaging_ratio", "_numbers")


def effective_weights() -> dict[str, Column]:
    """Weights per pair: what neither side can show is spread over the rest."""
    c = F.col
    no_brand = ~(c("query_has_brand") | c("candidate_has_brand"))
    no_category = ~(c("query_has_category") | c("candidate_has_category"))
    brand_share = WEIGHTS["brand_exact"] + WEIGHTS["brand_fuzzy"]
    category_share = WEIGHTS["category_exact"] + WEIGHTS["category_fuzzy"]
    total = sum(WEIGHTS.values())
    lost = F.when(no_brand, brand_share).otherwise(0.0) + F.when(no_category, category_share).otherwise(0.0)
    scale = F.lit(total) / (F.lit(total) - lost)
    out = {}
    for name, weight in WEIGHTS.items():
        dead = no_brand if name.startswith("brand") else no_category if name.startswith("category") else None
        scaled = F.lit(weight) * scale
        out[name] = scaled if dead is None else F.when(dead, F.lit(0.0)).otherwise(scaled)
    return out


def with_score(features: DataFrame) -> DataFrame:
    """Add ``short_circuit base_score bonus penalty final_score auto_match_forbidden``."""
    c = F.col
    short = F.when(c("supplier_mapping_hit") == 1.0, "supplier_exact").when(
        (c("article_exact") == 1.0) & (c("brand_exact") == 1.0), "article_brand_exact"
    )
    base = sum((w * c(name) for name, w in effective_weights().items()), F.lit(0.0))
    points = lambda condition, value: F.when(condition, F.lit(value)).otherwise(F.lit(0.0))
    no_code = (c("article_exact") == 0.0) & (c("manufacturer_code_exact") == 0.0)
    bonus = (
        points(c("article_exact") == 1.0, ARTICLE_BONUS)
        + points(c("manufacturer_code_exact") == 1.0, CODE_BONUS)
        + points((c("brand_exact") == 1.0) & (c("number_signature_score") >= SURE_NUMBERS), BRAND_NUMBER_BONUS)
        + points(c("alias_hit") == 1.0, ALIAS_BONUS)
    )
    penalty = (
        points(c("critical_number_conflict") & c("candidate_has_identifiers"), NUMBER_PENALTY)
        + points(c("critical_number_conflict") & ~c("candidate_has_identifiers"), NUMBER_PENALTY_WITHOUT_CODES)
        + points(c("category_conflict"), CATEGORY_PENALTY)
        + points(c("packaging_conflict"), PACKAGING_PENALTY)
        + points(c("unit_conflict"), UNIT_PENALTY)
        + points(c("brand_conflict") & no_code, BRAND_PENALTY)
    )
    forbidden = (
        (c("critical_number_conflict") & no_code & c("candidate_has_identifiers"))
        | (c("category_conflict") & (c("rerank_score") < SURE_RERANK))
        | (c("brand_conflict") & (c("number_signature_score") < UNSURE_NUMBERS))
    )
    cut = c("short_circuit").isNotNull()
    return (
        features.withColumn("short_circuit", short)
        .withColumn("base_score", F.when(cut, F.lit(0.0)).otherwise(base))
        .withColumn("bonus", F.when(cut, F.lit(0.0)).otherwise(bonus))
        .withColumn("penalty", F.when(cut, F.lit(0.0)).otherwise(penalty))
        .withColumn(
            "final_score",
            F.when(c("short_circuit") == "supplier_exact", F.lit(SUPPLIER_SCORE))
            .when(c("short_circuit") == "article_brand_exact", F.lit(ARTICLE_BRAND_SCORE))
            .otherwise(clamp(c("base_score") + c("bonus") + c("penalty"))),
        )
        .withColumn("auto_match_forbidden", ~cut & forbidden)
    )


def resolved_thresholds(
    strict: Column,
    auto: Column | None = None,
    review: Column | None = None,
    supplier: Column | None = None,
    category: Column | None = None,
) -> Column:
    """``struct(auto, review)`` in force: explicit, then supplier, category, defaults.

    ``supplier`` and ``category`` are ``struct(auto, review)`` or null. Once an
    auto value is found, later levels are not looked at, and a review value of
    zero counts as unset at the levels that are.
    """
    none = F.lit(None).cast("double")
    a, r = (none if auto is None else auto), (none if review is None else review)
    for level in (supplier, category):
        if level is None:
            continue
        open_, given = a.isNull(), level.isNotNull()
        r = F.when(open_ & given, F.coalesce(F.nullif(r, F.lit(0.0)), level["review"])).otherwise(r)
        a = F.when(open_ & given, level["auto"]).otherwise(a)
    strict = F.coalesce(strict, F.lit(False))
    return F.struct(
        F.coalesce(a, F.when(strict, STRICT_AUTO).otherwise(AUTO)).alias("auto"),
        F.coalesce(r, F.when(strict, STRICT_REVIEW).otherwise(REVIEW)).alias("review"),
    )


def status_of(score: Column, forbidden: Column, auto: Column, review: Column) -> Column:
    return (
        F.when((score >= auto) & ~forbidden, "auto_match")
        .when(score >= review, "review_needed")
        .otherwise("no_match")
    )


def reasons() -> Column:
    """Texts that explain a scored pair; texts, limits and order are fixed values."""
    c = F.col

    def note(*cases: tuple[Column, str]) -> Column:
        out = F.lit(None).cast("string")
        for condition, text in reversed(cases):
            out = F.when(condition, F.lit(text)).otherwise(out)
        return out

    listed = F.array_compact(
        F.array(
            note((c("brand_exact") == 1.0, "Совпадает бренд"), (c("brand_fuzzy") > 0.7, "Похожий бренд")),
            note((c("article_exact") == 1.0, "Совпадает артикул")),
            note((c("manufacturer_code_exact") == 1.0, "Совпадает код производителя")),
            note(
                (c("number_signature_score") >= 0.9, "Совпадают ключевые числовые характеристики"),
                (c("number_signature_score") >= 0.5, "Частично совпадают числовые характеристики"),
            ),
            note(
                (c("category_exact") == 1.0, "Совпадает категория"),
                (c("category_fuzzy") > 0.5, "Похожая категория"),
            ),
            note((c("unit_match_score") == 1.0, "Совпадает единица измерения")),
            note((c("packaging_match_score") == 1.0, "Совпадает фасовка")),
            note((c("alias_hit") == 1.0, "Найден через алиас")),
            note(
                (c("rerank_score") > 0.8, "Высокая семантическая релевантность"),
                (c("lexical_score") > 0.5, "Высокое текстовое сходство"),
            ),
            note((c("critical_number_conflict"), "Конфликт по ключевым числовым характеристикам")),
            note((c("category_conflict"), "Конфликт по категории")),
            note((c("packaging_conflict"), "Конфликт по фасовке")),
            note((c("unit_conflict"), "Конфликт по единице измерения")),
            note((c("brand_conflict"), "Конфликт по бренду")),
        )
    )
    return (
        F.when(c("short_circuit") == "supplier_exact", F.array(F.lit("Найдено точное соответствие поставщика")))
        .when(c("short_circuit") == "article_brand_exact", F.array(F.lit("Совпадает артикул и бренд")))
        .otherwise(listed)
    )
