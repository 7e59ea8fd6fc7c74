"""Matching lines as they arrive, and counting the results as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linewright.operators import retrieval
from linewright.options import MatchOptions
from linewright.plans.batch_match import MatchInputs, batch_match


def match_stream(
    lines: DataFrame, inputs: MatchInputs, path: str, checkpoint: str, options: MatchOptions = MatchOptions(),
    available_now: bool = False, seen_at: str | None = None, late: str = "1 day",
) -> StreamingQuery:
    """Match every micro-batch of ``lines`` against a static catalog and write it under ``path``.

    The lexical index is built once. Each batch owns a folder and overwrites
    it, so a batch repeated after a failure gives the same files. A line that
    comes again is matched once: within a batch always, and across batches for
    the time ``late`` after the event time in column ``seen_at``, if given.
    """
    if seen_at is not None:
        lines = lines.withWatermark(seen_at, late).dropDuplicatesWithinWatermark(["request_item_id"])
    if inputs.index is None:
        built = retrieval.build_index(inputs.catalog, max(options.list_cap, options.relaxed_list_cap), inputs.lexemes)
        inputs = MatchInputs(**{**inputs.__dict__, "index": built})

    def match(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.dropDuplicates(["request_item_id"])
        batch_match(fresh, inputs, options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = lines.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def request_counters(items: DataFrame) -> DataFrame:
    """Running counters per request, for update mode."""
    auto, review = F.col("status") == "auto_match", F.col("status") == "review_needed"
    return items.groupBy("request_id").agg(
        F.count("*").alias("processed_items"),
        F.count_if(auto).alias("auto_matched_items"),
        F.count_if(review).alias("review_needed_items"),
        F.count_if(~F.coalesce(auto | review, F.lit(False))).alias("no_match_items"),
    )
