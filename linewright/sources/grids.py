"""Messy price lists as untyped cells."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.session import small_batches

# fixed values: the delimiters that are told apart
DELIMITERS = "\t;,|"
#: Fields that leave Python at once; so many characters more count as a field.
MOST_FIELDS, FIELD_CHARS = 20_000, 64


def vote_delimiter(text: Column) -> Column:
    """The most frequent of tab, semicolon, comma and bar in a file; at a tie the comma, then the semicolon.

    Tab must beat all others, the bar all but the tab, semicolon must beat the comma.
    """
    tabs, semicolons, commas, bars = (F.regexp_count(text, F.lit(f"[{d}]")) for d in DELIMITERS)
    return (
        F.when((tabs > semicolons) & (tabs > commas) & (tabs >= bars), "\t")
        .when((bars > semicolons) & (bars > commas), "|")
        .when(semicolons > commas, ";")
        .otherwise(",")
    )


def _read(text: str, sep: str) -> Iterator[list[str]]:
    """The records of a delimited text; a quoted field may hold delimiters and line breaks."""
    # one field may be as long as the whole text
    csv.field_size_limit(max(csv.field_size_limit(), len(text) + 1))
    lines = (line for line in io.StringIO(text, newline=None) if line.strip())
    return (record for record in csv.reader(lines, delimiter=sep) if any(f.strip() for f in record))


def _placed(texts: DataFrame, sep: str | None) -> DataFrame:
    """``(file_id, width, record, fields)``: a row per record, with the width of the first one of its file."""
    cleaned = small_batches(texts).withColumn("text", F.regexp_replace("text", "^\ufeff+", ""))
    cleaned = cleaned.withColumn("sep", vote_delimiter(F.col("text")) if sep is None else F.lit(sep))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # texts are taken one by one and records leave in small batches, so a worker never holds the fields of many texts
        for batch in batches:
            ids, at, widths, places, found, held = batch["file_id"], [], [], [], [], 0

            def sent() -> pa.RecordBatch:
                types = {"width": pa.int32(), "record": pa.int32(), "fields": pa.list_(pa.string())}
                columns = [pa.array(v, t) for v, t in zip((widths, places, found), types.values())]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), *columns], ["file_id", *types])

            for i, (text, by) in enumerate(zip(batch["text"], batch["sep"])):
                width = None
                for n, fields in enumerate(_read(text.as_py() or "", by.as_py())):
                    width = len(fields) if width is None else width
                    for column, value in ((at, i), (widths, width), (places, n), (found, fields)):
                        column.append(value)
                    held += len(fields) + sum(map(len, fields)) // FIELD_CHARS
                    if held >= MOST_FIELDS:
                        yield sent()
                        at, widths, places, found, held = [], [], [], [], 0
            yield sent()

    file_id = cleaned.schema["file_id"].dataType.simpleString()
    return cleaned.select("file_id", "text", "sep").mapInArrow(records, f"file_id {file_id}, width int, record int, fields array<string>")


def text_cells(texts: DataFrame, sep: str | None = None) -> DataFrame:
    """``cells(file_id, sheet, row, col, value)`` of whole texts ``(file_id, text)``.

    Blank lines count no row, a byte order mark is dropped, empty fields are
    null. Records with more fields than the first one are bad and are left out
    and not counted; :func:`wide_records` lists them.
    """
    placed = _placed(texts, sep).filter(F.size("fields") <= F.col("width"))
    kept = F.sort_array(F.collect_list(F.struct("record", "fields")))
    rows = placed.groupBy("file_id").agg(kept.alias("kept")).select("file_id", F.posexplode("kept").alias("row", "r"))
    cells = rows.select("file_id", F.lit("Sheet1").alias("sheet"), "row", F.posexplode("r.fields").alias("col", "value"))
    return cells.withColumn("value", F.when(F.trim("value") != "", F.col("value")))


def wide_records(texts: DataFrame, sep: str | None = None) -> DataFrame:
    """``(file_id, record, fields)``: records that are wider than the first one of their file."""
    return _placed(texts, sep).filter(F.size("fields") > F.col("width")).drop("width")


def read_grid_files(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """Cells of all delimited files under ``path``; a sheet is an upload of bounded size."""
    texts = spark.read.option("encoding", encoding).text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_id"), F.col("value").alias("text")
    )
    return text_cells(texts)
