"""A lexical index in segments, refreshed by what has changed.

The first segment holds a whole catalog. A refresh compares the products with
those indexed, by a digest of their texts, and writes one more segment with the
new and changed ones only. Classes that lost a product are marked as dead in the
segments before (tombstones) and what is left of them is indexed again in the
new one, so no written file ever changes.

The prefix filters of the search need one order of grams that all segments
share, not exact counts. So a gram or word keeps the count with which it first
came, and a segment adds counts only for what no segment before it knew. When
the segments after the first have grown to a share of it, ``merge`` writes all
that is alive into one segment with fresh counts, from the gram sets as they
are, without looking at texts again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.functions import similarity as S
from linewright.operators import retrieval as R
from linewright.session import materialize, release, scratch_path

#: Tables of a segment; what readers look for is written last.
TABLES = (
    "classes", "members", "names", "name_grams", "document_grams", "postings",
    "name_frequency", "document_frequency", "term_frequency", "tombstones",
)


@dataclass(frozen=True)
class Segments:
    """The folder of an index and its segments, oldest first."""

    spark: SparkSession
    path: str
    names: tuple[str, ...] = ()

    def table(self, segment: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment}/{name}")

    def frequency(self, name: str) -> DataFrame | None:
        """The counts that order grams or words, each with the one it first came with."""
        return _union_of(self, f"{name}_frequency") if self.names else None

    def live(self, name: str, key: str) -> DataFrame | None:
        """A table over all segments, without classes that a later segment replaced."""
        parts = []
        for at, segment in enumerate(self.names):
            rows = self.table(segment, name)
            dead = [self.table(later, "tombstones").where(F.col("segment") == segment) for later in self.names[at + 1 :]]
            if dead:
                dead = reduce(DataFrame.unionByName, dead).select(F.col("class_id").alias("_dead")).distinct()
                rows = rows.join(dead, F.col(key) == F.col("_dead"), "left_anti")
            parts.append(rows.withColumn("segment", F.lit(segment)))
        return reduce(DataFrame.unionByName, parts) if parts else None


def open_segments(spark: SparkSession, path: str) -> Segments:
    """The finished segments in a folder, from the last merged one on."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
    finished = lambda name: files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/{TABLES[-1]}/_SUCCESS"))
    names = sorted(filter(finished, found), key=_number)
    bases = [i for i, n in enumerate(names) if n.startswith("base-")]
    return Segments(spark, path, tuple(names[bases[-1] :]) if bases else ())


def _number(segment: str) -> int:
    return int(segment.rsplit("-", 1)[1])


def _digest() -> Column:
    """Tells apart the texts that a product is found by, null and empty ones too."""
    return F.sha2(F.to_json(F.struct("normalized_name", "search_document")), 256)


def _indexable(catalog: DataFrame) -> DataFrame:
    rows = catalog.filter("is_active").select("product_id", "normalized_name", "search_document")
    return rows.withColumn("digest", _digest())


def refresh(segments: Segments, catalog: DataFrame, lexemes: DataFrame | None = None) -> Segments:
    """Index what differs from the active products of ``catalog`` in one more segment.

    Products that are new, have other texts, were removed or set inactive are
    found by one comparison of ids and digests. Nothing changed, nothing is
    written. On an empty folder the whole catalog becomes the first segment.
    """
    rows = _indexable(catalog)
    if not segments.names:
        return _write(segments, "base-0", _class_tables(rows, lexemes), None)
    members = segments.live("members", "class_id")
    gone = members.join(rows.select("product_id", "digest"), ["product_id", "digest"], "left_anti")
    touched = materialize(gone.select("segment", "class_id").distinct(), "touched-classes")
    fresh = rows.join(members.select("product_id", "digest"), ["product_id", "digest"], "left_anti")
    # what stays of a touched class moves on with it; its text is looked up once more
    rest = members.join(touched, ["segment", "class_id"], "left_semi").select("product_id", "digest")
    changed = materialize(fresh.unionByName(rows.join(rest, ["product_id", "digest"], "left_semi")), "changed-products")
    if changed.isEmpty() and touched.isEmpty():
        out = segments
    else:
        name = f"delta-{_number(segments.names[-1]) + 1}"
        out = _write(segments, name, _class_tables(changed, lexemes), touched)
    release(changed, touched)
    return out


def share_of_deltas(segments: Segments) -> float:
    """How many classes came after the first segment, for each of the first."""
    counts = [segments.table(s, "classes").count() for s in segments.names]
    return sum(counts[1:]) / max(counts[0], 1) if counts else 0.0


def merge(segments: Segments) -> Segments:
    """One segment of all that is alive, with fresh counts; the old files stay for those who still read them."""
    if len(segments.names) < 2:
        return segments
    classes = segments.live("classes", "class_id").drop("segment")
    members = segments.live("members", "class_id").drop("segment")
    name = f"base-{_number(segments.names[-1]) + 1}"
    written = _write(Segments(segments.spark, segments.path), name, (members, classes), None)
    return Segments(segments.spark, segments.path, written.names)


def _class_tables(rows: DataFrame, lexemes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(class_id, product_id, digest)`` of all products, and a row with grams and positions per text."""
    same = rows.groupBy("digest").agg(
        F.min("product_id").alias("class_id"),
        F.count("*").alias("members"),
        F.first("normalized_name").alias("normalized_name"),
        F.first("search_document").alias("search_document"),
    )
    same = materialize(same, "segment-texts")
    members = rows.select("product_id", "digest").join(same.select("digest", "class_id"), "digest")
    classes = R.with_lexemes(same, "search_document", "_lexemes", lexemes).select(
        "class_id",
        "members",
        S.lexeme_positions(F.col("_lexemes")).alias("positions"),
        S.trigrams(F.col("normalized_name")).alias("name_grams"),
        S.trigrams(F.col("search_document")).alias("document_grams"),
    )
    return members.select("class_id", "product_id", "digest"), classes


def _write(segments: Segments, name: str, tables: tuple[DataFrame, DataFrame], dead: DataFrame | None) -> Segments:
    spark, folder = segments.spark, f"{segments.path}/{name}"
    members, classes = tables

    def put(df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{table}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{table}")

    put(members, "members")
    classes = put(classes, "classes")

    def ordered(kind: str, key: str, found: DataFrame) -> DataFrame:
        """Writes the counts of what is new, and gives those of all."""
        known = segments.frequency(kind)
        new = put(found if known is None else found.join(known.select(key), key, "left_anti"), f"{kind}_frequency")
        return new if known is None else known.unionByName(new)

    # a name goes by its content, which is the same in every segment
    names = classes.select("class_id", F.sha2(F.concat_ws(" ", F.array_sort("name_grams")), 256).alias("name_id"), "name_grams")
    put(names.select("name_id", "class_id"), "names")
    sets_of = {
        "name": names.select(F.col("name_id").alias("id"), F.col("name_grams").alias("set")).dropDuplicates(["id"]),
        "document": classes.select(F.col("class_id").alias("id"), F.col("document_grams").alias("set")),
    }
    for kind, sets in sets_of.items():
        put(R._ordered_grams(sets, ordered(kind, "gram", R._gram_frequency(sets))), f"{kind}_grams")
    rows = R.term_rows(classes)
    frequency = ordered("term", "term", rows.groupBy("term").agg(F.count("*").alias("cnt")))
    put(rows.join(frequency, "term"), "postings")
    if dead is None:
        dead = classes.limit(0).select(F.lit("").alias("segment"), "class_id")
    put(dead.select("segment", "class_id"), TABLES[-1])
    return Segments(spark, segments.path, (*segments.names, name))


def catalog_index(segments: Segments, cap: int = 200) -> R.CatalogIndex:
    """The segments as one index, for ``lexical_matches``.

    Products with equal texts may be in classes of several segments; each class
    keeps its first ``cap`` products, which is exact for lists of that length.
    """
    first = Window.partitionBy("class_id").orderBy("product_id")
    members = segments.live("members", "class_id").withColumn("_n", F.row_number().over(first))
    classes = segments.live("classes", "class_id").withColumn("members", F.least("members", F.lit(cap)))
    return R.CatalogIndex(
        cap,
        classes.drop("segment"),
        members.where(F.col("_n") <= cap).select("class_id", "product_id"),
        segments.live("names", "class_id").drop("segment"),
        # a name that no live class has leads nowhere, and one that several segments know is listed once
        _union_of(segments, "name_grams").dropDuplicates(["id"]),
        segments.live("document_grams", "id").drop("segment"),
        segments.frequency("name"),
        segments.frequency("document"),
        segments.live("postings", "r_id").drop("segment"),
        segments.frequency("term"),
    )


def _union_of(segments: Segments, name: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [segments.table(s, name) for s in segments.names])


def new_folder(spark: SparkSession) -> str:
    """A folder of this run for an index that need not outlive it."""
    return scratch_path(spark, "segments")
