"""What a catalog can be imported from."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.operators import catalog as C
from linewright.sources import catalog_files, erp


class CatalogSource(Protocol):
    """A source gives raw items, whatever columns it has, and says whether it can be read."""

    def items(self, spark: SparkSession) -> DataFrame: ...

    def is_ready(self, spark: SparkSession) -> bool: ...


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


@dataclass(frozen=True)
class CatalogFiles:
    """Delimited catalog files under a path."""

    path: str

    def items(self, spark: SparkSession) -> DataFrame:
        return catalog_files.read_catalog(spark, self.path)

    def is_ready(self, spark: SparkSession) -> bool:
        return _exists(spark, self.path)


@dataclass(frozen=True)
class ErpPages:
    """Landed JSON pages of an ERP system."""

    path: str

    def items(self, spark: SparkSession) -> DataFrame:
        return erp.map_records(erp.read_pages(spark, self.path))

    def is_ready(self, spark: SparkSession) -> bool:
        return _exists(spark, self.path)


@dataclass(frozen=True)
class CatalogTable:
    """A table that already is there."""

    table: DataFrame

    def items(self, spark: SparkSession) -> DataFrame:
        return self.table

    def is_ready(self, spark: SparkSession) -> bool:
        return True


def read_sources(spark: SparkSession, sources: list[CatalogSource]) -> DataFrame:
    """The raw items of all sources that can be read, with ``row_number`` in their order.

    A source's place leads the number, so that of equal ids the last source wins.
    """
    parts = []
    for place, source in enumerate(sources):
        if source.is_ready(spark):
            rows = C.raw_items(source.items(spark))
            kept = [c for c in rows.columns if c in C.RAW_COLUMNS]
            parts.append(rows.select(*kept, F.lit(place).cast("long").alias("row_number")))
    if not parts:
        raise ValueError("no catalog source can be read")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
