"""Rerank scores: from the fusion, or from a table that a model filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_fusion(candidates: DataFrame, top_n: int = 10) -> DataFrame:
    """Without a model the fusion score stands in; the best ``top_n`` stay."""
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "product_id")
    return (
        candidates.withColumn("rerank_score", F.coalesce("rrf_score", F.lit(0.0)))
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= top_n)
        .drop("_n")
    )


def by_scores(candidates: DataFrame, scores: DataFrame, top_n: int = 10) -> DataFrame:
    """Attach ``(query_id, candidate_index, score)`` of a model to the candidates.

    The index counts a query's candidates from zero in retrieval order;
    indexes without a candidate drop out.
    """
    placed = candidates.withColumn("candidate_index", F.col("retrieval_rank") - 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "product_id")
    return (
        placed.join(
            scores.select("query_id", "candidate_index", F.col("score").cast("double").alias("rerank_score")),
            ["query_id", "candidate_index"],
        )
        .withColumn("_n", F.row_number().over(best))
        .filter(F.col("_n") <= top_n)
        .drop("_n", "candidate_index")
    )


def scale(reranked: DataFrame) -> DataFrame:
    """Min-max scale the scores of each query; equal positive ones become 1, single rows stay."""
    bounds = reranked.groupBy("query_id").agg(
        F.min("rerank_score").alias("_low"), F.max("rerank_score").alias("_high"), F.count("*").alias("_n")
    )
    score, low, high = F.col("rerank_score"), F.col("_low"), F.col("_high")
    return (
        reranked.join(bounds, "query_id")
        .withColumn(
            "rerank_score",
            F.when(F.col("_n") == 1, score)
            .when(high > low, (score - low) / (high - low))
            .when(high > 0, F.lit(1.0))
            .otherwise(score),
        )
        .drop("_low", "_high", "_n")
    )


def candidate_document(brand: str = "brand", name: str = "name", article: str = "article", category: str = "category_path") -> Column:
    """The text a reranker reads: filled fields joined by bars."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat_ws(" | ", filled(brand), F.col(name), filled(article), filled(category))
