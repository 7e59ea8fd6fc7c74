"""Catalog files: delimited text with Russian or English headers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D

NUMERIC_FIELDS = ("weight_value", "volume_value", "size_value")


def delimiter_of(first_line: Column) -> Column:
    return (
        F.when(F.contains(first_line, F.lit("\t")), "\t").when(F.contains(first_line, F.lit(";")), ";").otherwise(",")
    )


def first_lines(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """``(file, line)``: the first line of each file."""
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    # rows of one file block come in order from one partition
    head = lines.filter("start = 0").withColumn("at", F.monotonically_increasing_id())
    return head.groupBy("file").agg(F.min_by("value", "at").alias("line")).select(
        "file", F.regexp_replace("line", "^﻿", "").alias("line")
    )


def field_map(headers: list[str]) -> dict[int, str]:
    """Column position -> field for the headers that are known."""
    known = {i: D.HEADER_FIELDS.get(h.strip().strip('"').lower()) for i, h in enumerate(headers)}
    return {i: f for i, f in known.items() if f}


def clean_rows(rows: DataFrame) -> DataFrame:
    """Trim, turn blanks to null, drop rows without name, parse numbers, fill in missing ids.

    A missing id becomes ``prd_`` and a hash of the row, the same on every run.
    """
    out = rows.select(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in rows.columns])
    out = out.filter("name is not null")
    for field in NUMERIC_FIELDS:
        if field in out.columns:
            out = out.withColumn(field, F.replace(F.col(field), F.lit(","), F.lit(".")).try_cast("double"))
    key = F.concat(F.lit("prd_"), F.md5(F.to_json(F.struct(*[c for c in out.columns if c != "product_id"]))))
    given = F.col("product_id") if "product_id" in out.columns else F.lit(None).cast("string")
    return out.withColumn("product_id", F.coalesce(given, key))


def read_catalog(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """All catalog files under ``path`` as raw items.

    Files are grouped by delimiter and header, so that each group is one scan
    with one projection; there are as many groups as file layouts. Quoted
    fields may span lines.
    """
    layouts = (
        first_lines(spark, path, encoding)
        .withColumn("sep", delimiter_of(F.col("line")))
        .groupBy("line", "sep")
        .agg(F.collect_list("file").alias("files"))
        .collect()
    )
    parts = []
    for layout in layouts:
        headers = layout.line.rstrip("\r").split(layout.sep)
        fields = field_map(headers)
        if not fields:
            raise ValueError(f"no recognized columns in headers: {headers}")
        table = spark.read.csv(
            layout.files, sep=layout.sep, header=True, encoding=encoding, multiLine=True, quote='"', escape='"',
            schema=", ".join(f"_c{i} string" for i in range(len(headers))), enforceSchema=True,
        )
        # of two columns for one field the later filled one counts
        by_field: dict[str, list[Column]] = {}
        for i, field in fields.items():
            by_field.setdefault(field, []).insert(0, F.nullif(F.trim(F.col(f"_c{i}")), F.lit("")))
        parts.append(clean_rows(table.select(*[F.coalesce(*cols).alias(f) for f, cols in by_field.items()])))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
