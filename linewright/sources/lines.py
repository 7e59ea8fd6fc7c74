"""Customer lines from pasted text and from tabular uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D



def pasted_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per filled line of a text; ``line_id`` is the line's place in the original."""
    others = [c for c in texts.columns if c != text]
    return (
        texts.select(*others, F.posexplode(F.split(text, "\n")).alias("at", "line"))
        .select(*others, (F.col("at") + 1).cast("string").alias("line_id"), _strip(F.col("line")).alias("raw_text"))
        .filter("raw_text != ''")
    )


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def tabular_lines(rows: DataFrame, columns: list[str], position: Column, keep: list[str] | None = None) -> DataFrame:
    """Lines of a table: the first filled preferred column, else the first text, else the first value.

    ``position`` is the row's place counted from one and names lines without id.
    """
    filled = lambda c: F.nullif(F.col(f"`{c}`").cast("string"), F.lit(""))
    preferred = [filled(c) for c in D.LINE_TEXT_COLUMNS if c in columns]
    strings = [c for c in columns if dict(rows.dtypes)[c] == "string"]
    wordy = [F.when(F.trim(filled(c)).try_cast("double").isNull(), filled(c)) for c in strings]
    first = F.col(f"`{columns[0]}`").cast("string")
    text = _strip(F.coalesce(*preferred, *wordy, first, F.lit("")))
    ids = [filled(c) for c in D.LINE_ID_COLUMNS if c in columns]
    return rows.select(
        *(keep or []),
        F.coalesce(*ids, position.cast("string")).alias("line_id"),
        text.alias("raw_text"),
        F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]).alias("original_row"),
    ).filter("raw_text != ''")


def split_valid(lines: DataFrame, max_chars: int | None = None, max_lines: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lines that are not empty, and the rejected rest with a reason.

    A caller may bound the characters of a line and the lines of a request.
    """
    sizes = lines.groupBy("request_id").agg(F.count("*").alias("_n"))
    size = F.length(F.coalesce("raw_text", F.lit("")))
    sized = lines.join(sizes, "request_id")
    too_many = F.lit(False) if max_lines is None else F.col("_n") > max_lines
    too_long = F.lit(False) if max_chars is None else size > max_chars
    reason = F.when(too_many, "too many lines").when(size == 0, "empty line").when(too_long, "line too long")
    judged = sized.withColumn("reason", reason).drop("_n")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")
