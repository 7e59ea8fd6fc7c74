"""The whole match of a batch of lines against a catalog."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions import scoring
from linewright.functions import text as T
from linewright.operators import normalize as N
from linewright.operators import rerank, retrieval
from linewright.operators.mappings import supplier_overrides
from linewright.options import MatchOptions
from linewright.session import materialize, spread

OVERRIDE_REASON = "Найдено точное соответствие поставщика"
EMPTY_REASON = "Кандидаты не найдены"

THRESHOLDS = "struct<auto: double, review: double>"
ALTERNATIVE = (
    "array<struct<product_id: string, name: string, article: string, brand: string, retrieval_rank: int, "
    "lexical_score: double, semantic_score: double, rerank_score: double, rules_score: double, "
    "final_score: double, reasons: array<string>>>"
)


@dataclass(frozen=True)
class MatchInputs:
    """Everything a batch is matched against; only the catalog is required."""

    catalog: DataFrame
    embeddings: DataFrame | None = None
    query_vectors: DataFrame | None = None  # n_text, vector
    suppliers: DataFrame | None = None
    mappings: DataFrame | None = None
    synonyms: DataFrame | None = None
    aliases: DataFrame | None = None
    lexemes: DataFrame | None = None
    category_thresholds: DataFrame | None = None  # category_path, auto, review
    rerank_scores: DataFrame | None = None  # query_id, candidate_index, score
    index: retrieval.CatalogIndex | None = None


def with_defaults(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add missing optional columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def supplier_rules(suppliers: DataFrame) -> DataFrame:
    """``(supplier_id, supplier_strict, supplier_thresholds)`` from profiles with JSON rules."""
    rules = F.get_json_object("normalization_rules", "$.thresholds")
    value = lambda key: F.get_json_object(rules, f"$.{key}").try_cast("double")
    return suppliers.select(
        "supplier_id",
        F.col("strict_mode").alias("supplier_strict"),
        F.when(
            rules.isNotNull() & (rules != "{}"),
            F.struct(value("auto_threshold").alias("auto"), value("review_threshold").alias("review")),
        ).alias("supplier_thresholds"),
    )


def distinct_items(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with an ``item_id``, and one item per distinct line content.

    Copies of a line are matched once, whatever share of the batch they are.
    """
    lines = with_defaults(
        lines, {"supplier_id": "string", "strict": "boolean", "category_hint": "string"}
    )
    content = ["supplier_id", "raw_text", "strict", "category_hint"]
    keyed = lines.withColumn("item_id", F.md5(F.to_json(F.struct(*content))))
    return keyed, spread(keyed.select("item_id", *content).dropDuplicates(["item_id"]), "item_id")


def prepare_items(items: DataFrame, inputs: MatchInputs) -> DataFrame:
    """Normalize items, apply synonyms, extract article and packaging."""
    out = N.normalize(items)
    if inputs.synonyms is not None:
        out = N.apply_synonyms(out, inputs.synonyms)
    return N.extract_features(out)


def as_queries(items: DataFrame, inputs: MatchInputs, options: MatchOptions) -> DataFrame:
    """Items with the ``query_id`` of their retrieval; equal texts share one."""
    hint = F.lit(None).cast("string") if options.parity else F.col("article")
    return items.withColumn("article_hint", hint).withColumn(
        "query_id", F.md5(F.to_json(F.struct("n_text", "article_hint")))
    )


def candidate_pairs(items: DataFrame, reranked: DataFrame, inputs: MatchInputs, options: MatchOptions) -> DataFrame:
    """Pairs of items and reranked candidates in the shape the scoring reads."""
    numbers = T.numbers(F.coalesce(F.nullif(F.col("normalized_name"), F.lit("")), F.col("name")))
    candidates = reranked.select(
        "query_id", "product_id", "name", "article", "brand", "category_path", "retrieval_rank",
        "lexical_score", "semantic_score", "rerank_score",
        F.col("article").alias("c_article"),
        F.col("manufacturer_code").alias("c_manufacturer_code"),
        F.coalesce(F.nullif(F.col("normalized_brand"), F.lit("")), F.col("brand")).alias("c_brand"),
        numbers.alias("c_numbers"),
        (F.col("unit") if options.parity else T.canonical_units(F.lower("unit"))["text"]).alias("c_unit"),
        F.col("packaging").alias("c_packaging"),
        F.col("category_path").alias("c_category"),
    )
    none = F.lit(None).cast("string")
    query_side = items.select(
        "item_id", "query_id", "supplier_id", "strict",
        F.col("n_text").alias("q_text"),
        F.col("n_brand").alias("q_brand"),
        F.col("n_numbers").alias("q_numbers"),
        F.col("n_unit").alias("q_unit"),
        F.col("packaging").alias("q_packaging"),
        (none if options.parity else F.col("category_hint")).alias("q_category"),
        (none if options.parity else F.col("article")).alias("q_article"),
    )
    pairs = query_side.join(candidates, "query_id").withColumn("supplier_mapping_hit", F.lit(False))
    if inputs.aliases is None:
        return pairs.withColumn("alias_hit", F.lit(False))
    known = inputs.aliases.select(
        F.col("normalized_alias_text").alias("q_text"), "product_id", F.lit(True).alias("alias_hit")
    ).distinct()
    return pairs.join(known, ["q_text", "product_id"], "left")


def decide_pairs(scored: DataFrame, inputs: MatchInputs, options: MatchOptions) -> DataFrame:
    """Add ``status``, resolved thresholds and reasons to scored pairs."""
    rows = scored
    if inputs.suppliers is not None:
        rows = rows.join(supplier_rules(inputs.suppliers), "supplier_id", "left")
    if inputs.category_thresholds is not None:
        rows = rows.join(
            inputs.category_thresholds.select(
                "category_path", F.struct("auto", "review").alias("category_thresholds")
            ),
            "category_path",
            "left",
        )
    rows = with_defaults(
        rows,
        {"supplier_strict": "boolean", "supplier_thresholds": THRESHOLDS, "category_thresholds": THRESHOLDS},
    )
    explicit = lambda v: None if v is None else F.lit(float(v))
    limits = scoring.resolved_thresholds(
        F.coalesce("strict", F.lit(False)) | F.coalesce("supplier_strict", F.lit(False)),
        explicit(options.auto_threshold),
        explicit(options.review_threshold),
        F.col("supplier_thresholds"),
        F.col("category_thresholds"),
    )
    return (
        rows.withColumn("_limits", limits)
        .withColumn(
            "status",
            scoring.status_of(
                F.col("final_score"), F.col("auto_match_forbidden"), F.col("_limits.auto"), F.col("_limits.review")
            ),
        )
        .withColumn("reasons", scoring.reasons())
        .drop("_limits")
    )


def best_per_item(decided: DataFrame, alternatives: int = 5) -> DataFrame:
    """The best candidate of each item, its trace, and the first alternatives.

    Higher score first, then better retrieval rank. A group is one item's
    reranked candidates, at most ``rerank_top_n`` rows.
    """
    rules = (F.col("bonus") + F.col("penalty")).alias("rules_score")
    listed = [
        "retrieval_rank", "product_id", "status", "final_score", "category_path", "name", "article", "brand",
        "lexical_score", "semantic_score", "rerank_score",
    ]
    traced = ["base_score", "bonus", "penalty", "short_circuit", "auto_match_forbidden"]
    columns = list(dict.fromkeys(["item_id", *listed, "reasons", *traced, *scoring.FEATURES]))
    # rows move as plain columns, each once, and only those a caller reads; a partial list would save nothing
    rows = decided.select(*columns).repartition("item_id").withColumn("order_score", -F.col("final_score"))
    place = F.struct("order_score", *listed, rules, "reasons")
    grouped = rows.groupBy("item_id").agg(
        F.sort_array(F.collect_list(place)).alias("ranked"),
        F.min(F.struct(place.alias("place"), *traced, F.struct(*scoring.FEATURES).alias("features"))).alias("first"),
    )
    best, first = F.col("ranked")[0], F.col("first")
    alternative = lambda r: F.struct(
        *[r[c].alias(c) for c in (
            "product_id", "name", "article", "brand", "retrieval_rank", "lexical_score", "semantic_score",
            "rerank_score", "rules_score", "final_score", "reasons",
        )]
    )
    score = first["place"]["final_score"]
    trace = F.struct(
        *[first[c].alias(c) for c in traced[:3]], score.alias("final_score"), *[first[c].alias(c) for c in traced[3:]],
        first["features"].alias("features"),
        F.struct(first["place"]["status"].alias("status"), score.alias("confidence")).alias("decision"),
    )
    return grouped.select(
        "item_id",
        best["status"].alias("status"),
        best["final_score"].alias("confidence"),
        best["product_id"].alias("best_product_id"),
        best["name"].alias("best_name"),
        best["reasons"].alias("reasons"),
        F.transform(F.slice("ranked", 1, alternatives), alternative).alias("alternatives"),
        F.to_json(trace).alias("trace"),
        F.size("ranked").alias("candidates_reranked"),
    )


RESULT = [
    "item_id", "status", "confidence", "best_product_id", "best_name", "reasons", "alternatives", "trace",
    "candidates_reranked",
]


def fixed_results(items: DataFrame, status: str, confidence: float, reason: str, product: str | None, trace) -> DataFrame:
    """Result rows for items that never reach the scoring."""
    return items.select(
        "item_id",
        F.lit(status).alias("status"),
        F.lit(confidence).alias("confidence"),
        (F.col(product) if product else F.lit(None).cast("string")).alias("best_product_id"),
        F.lit(None).cast("string").alias("best_name"),
        F.array(F.lit(reason)).alias("reasons"),
        F.array().cast(ALTERNATIVE).alias("alternatives"),
        F.to_json(trace).alias("trace"),
        F.lit(0).alias("candidates_reranked"),
    )


def match_items(prepared: DataFrame, inputs: MatchInputs, options: MatchOptions = MatchOptions()) -> DataFrame:
    """One result row per prepared item."""
    parts = []
    rest = prepared
    if inputs.mappings is not None:
        found = supplier_overrides(
            prepared.withColumnRenamed("item_id", "line_id"), inputs.mappings, empty_article=options.parity
        ).filter(F.col("mapping_type").isin("exact", "approved"))
        found = materialize(found.withColumnRenamed("line_id", "item_id"), "overrides")
        trace = F.struct(F.lit("supplier_override").alias("short_circuit"), "mapping_type")
        parts.append(
            fixed_results(found, "auto_match", scoring.SUPPLIER_SCORE, OVERRIDE_REASON, "product_id", trace)
        )
        rest = prepared.join(found.select("item_id"), "item_id", "left_anti")
    rest = as_queries(rest, inputs, options)
    queries = rest.select("query_id", F.col("n_text").alias("text"), "article_hint").dropDuplicates(["query_id"])
    if inputs.query_vectors is not None:
        queries = queries.join(inputs.query_vectors.withColumnRenamed("n_text", "text"), "text", "left")
    candidates = retrieval.hybrid_search(
        queries, inputs.catalog, inputs.embeddings, options, inputs.lexemes, inputs.index
    )
    if inputs.rerank_scores is None:
        reranked = rerank.by_fusion(candidates, options.rerank_top_n)
    else:
        reranked = rerank.by_scores(candidates, inputs.rerank_scores, options.rerank_top_n)
    if options.scale_rerank or inputs.rerank_scores is not None:
        reranked = rerank.scale(reranked)
    pairs = candidate_pairs(rest, reranked, inputs, options)
    scored = scoring.with_score(scoring.with_pair_features(pairs))
    results = materialize(best_per_item(decide_pairs(scored, inputs, options), options.alternatives), "results")
    missed = rest.join(results.select("item_id"), "item_id", "left_anti")
    trace = F.struct(F.lit("retrieval").alias("stage"), F.lit(0).alias("candidates_found"))
    parts += [results, fixed_results(missed, "no_match", 0.0, EMPTY_REASON, None, trace)]
    out = parts[0].select(*RESULT)
    for part in parts[1:]:
        out = out.unionByName(part.select(*RESULT))
    return out


def batch_match(lines: DataFrame, inputs: MatchInputs, options: MatchOptions = MatchOptions()) -> DataFrame:
    """Match every line: input columns plus normalized text, attributes and result."""
    keyed, items = distinct_items(lines)
    prepared = materialize(prepare_items(items, inputs), "items")
    results = match_items(prepared, inputs, options).join(
        prepared.select(
            "item_id", "n_text", "n_brand", "n_numbers", "n_unit", "n_dims",
            F.col("article").alias("n_article"), F.col("packaging").alias("n_packaging"),
        ),
        "item_id",
    )
    return keyed.join(results, "item_id").drop("item_id")


# --- verdicts from outside ---


def apply_verdicts(
    results: DataFrame, verdicts: DataFrame, inputs: MatchInputs, options: MatchOptions = MatchOptions()
) -> DataFrame:
    """Let a model's verdict replace the score of its line.

    ``verdicts`` is ``(line_id, product_id, confidence, reasoning)`` with ids
    already resolved. The confidence passes the same thresholds.
    """
    judged = results.join(
        verdicts.select(
            "line_id", F.col("product_id").alias("v_product"), F.col("confidence").alias("v_confidence"),
            F.col("reasoning").alias("v_reasoning"),
        ),
        "line_id",
        "left",
    )
    if inputs.suppliers is not None:
        judged = judged.join(supplier_rules(inputs.suppliers), "supplier_id", "left")
    judged = with_defaults(
        judged, {"strict": "boolean", "supplier_strict": "boolean", "supplier_thresholds": THRESHOLDS}
    )
    explicit = lambda v: None if v is None else F.lit(float(v))
    limits = scoring.resolved_thresholds(
        F.coalesce("strict", F.lit(False)) | F.coalesce("supplier_strict", F.lit(False)),
        explicit(options.auto_threshold), explicit(options.review_threshold), F.col("supplier_thresholds"),
    )
    given = F.col("v_confidence").isNotNull()
    status = scoring.status_of(F.col("v_confidence"), F.lit(False), limits["auto"], limits["review"])
    return (
        judged.withColumn("status", F.when(given, status).otherwise(F.col("status")))
        .withColumn("confidence", F.coalesce("v_confidence", "confidence"))
        .withColumn("best_product_id", F.when(given, F.col("v_product")).otherwise(F.col("best_product_id")))
        .withColumn(
            "reasons",
            F.when(given, F.array(F.concat(F.lit("LLM Matcher: "), "v_reasoning"))).otherwise(F.col("reasons")),
        )
        .drop("v_product", "v_confidence", "v_reasoning", "supplier_strict", "supplier_thresholds")
    )


def apply_agent(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Merge an agent's decision into lines that are not matched yet.

    ``decisions`` is ``(line_id, decision_type, product_id, reasoning)``. An
    exact match becomes automatic at 0.99; any other decision changes reasons
    only. Lines without candidates can at most go to review, at 0.80.
    """
    d = decisions.select(
        "line_id", "decision_type", F.col("product_id").alias("a_product"), F.col("reasoning").alias("a_reasoning")
    )
    rows = results.join(d, "line_id", "left")
    open_ = F.coalesce(F.col("status") != "auto_match", F.lit(False)) & F.col("decision_type").isNotNull()
    has_product = F.coalesce(F.col("a_product") != "", F.lit(False))
    empty = F.col("candidates_reranked") == 0
    rescued = open_ & empty & has_product & F.col("decision_type").isin("exact_match", "likely_match")
    judged = open_ & ~empty
    matched = judged & has_product & (F.col("decision_type") == "exact_match")
    changed = (rescued | judged)
    label = F.when(empty, F.lit("Agent fallback: ")).otherwise(F.lit("Agent Resolution: "))
    return (
        rows.withColumns(
            {
                "status": F.when(rescued, "review_needed").when(matched, "auto_match").otherwise(F.col("status")),
                "confidence": F.when(rescued, 0.80).when(matched, 0.99).otherwise(F.col("confidence")),
                "best_product_id": F.when(rescued | matched, F.col("a_product")).otherwise(F.col("best_product_id")),
                "reasons": F.when(changed, F.array(F.concat(label, F.coalesce("a_reasoning", F.lit(""))))).otherwise(
                    F.col("reasons")
                ),
            }
        ).drop("decision_type", "a_product", "a_reasoning")
    )


def rank_candidates(results: DataFrame) -> DataFrame:
    """Candidate rows of the results, numbered by their place among the alternatives."""
    return results.select("line_id", F.posexplode("alternatives").alias("at", "a")).select(
        "line_id",
        "a.product_id",
        (F.col("at") + 1).alias("retrieval_rank"),
        "a.lexical_score", "a.semantic_score", "a.rerank_score", "a.rules_score", "a.final_score", "a.reasons",
    )
