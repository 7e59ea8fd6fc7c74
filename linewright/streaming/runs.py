"""Running streams to their current end, with results in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linewright.session import scratch_path


def parquet_stream(spark: SparkSession, folder: str, file_glob: str, schema: StructType, files_per_trigger: int | None = None):
    """A stream over the parquet files of a folder; the trigger size bounds each batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def drain_appended(stream: DataFrame, label: str) -> DataFrame:
    """Process all available input of an append stream; returns what it wrote."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updated(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Process all available input of an update stream; returns the latest row of each key.

    Every batch overwrites its own folder, so a repeated batch leaves no doubles.
    """
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    rows = spark.read.parquet(path)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")
