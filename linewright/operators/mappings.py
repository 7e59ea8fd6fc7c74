"""Client-specific overrides: texts and codes already mapped to a product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values ---
TYPE_RANK = {"exact": 1, "approved": 2, "manual": 3, "learned": 4}
DEFAULT_CONFIDENCE = 0.995
# --- end of fixed values ---


def type_rank(column: str = "mapping_type"):
    out = F.lit(None).cast("int")
    for name, rank in TYPE_RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return F.coalesce(out, F.lit(len(TYPE_RANK) + 1))


def _flat(df: DataFrame) -> DataFrame:
    """Turn the struct ``key`` into plain columns led by a hash; keys without a value go.

    Sorting for the aggregate and the join then compares numbers first; the
    columns themselves stay part of the key, so collisions do no harm.
    """
    return df.filter("key.value is not null").select(
        F.xxhash64("supplier_id", "key.kind", "key.value").alias("hash"), F.col("key.kind").alias("kind"),
        F.col("key.value").alias("value"), *[c for c in df.columns if c != "key"],
    )


KEY = ["hash", "supplier_id", "kind", "value"]
#: Lines and mappings of one supplier beyond this many are spread over tasks by their keys.
HOT_ROWS = 1_000_000
#: Mappings of one task, which lays out up to four keys of each and as many lines again.
TASK_ROWS = 50_000
RAW, ARTICLE, TEXT = 0, 1, 2  # kinds of keys


def _keys(*kinds):
    return F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in kinds]))


def _best_entries(lines: DataFrame, mappings: DataFrame, asked: list[tuple], offered: list[tuple]) -> DataFrame:
    """``(row, entry)``: each ``row`` of the lines with the least entry for each of its keys that has one.

    Both sides hold ``supplier_id`` and the columns that ``asked`` and
    ``offered`` name as ``(kind, column)``. A line and a mapping have several
    keys, but one supplier. So each of them goes once to the task of its
    supplier, and the keys are laid out there. Only suppliers with more than
    ``HOT_ROWS`` rows send each key to a task of its own.
    """
    lines = lines.filter("supplier_id is not null")
    mappings = mappings.filter("supplier_id is not null")
    counts = lines.groupBy("supplier_id").count().unionAll(mappings.groupBy("supplier_id").count())
    hot = F.broadcast(counts.groupBy("supplier_id").agg(F.sum("count").alias("n")).filter(F.col("n") > HOT_ROWS).select("supplier_id"))
    laid = lambda df, keys, *others: _flat(df.select("supplier_id", _keys(*[(k, F.col(c)) for k, c in keys]).alias("key"), *others))

    tasks = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), mappings.count() // TASK_ROWS + 1)
    together = lines.unionByName(mappings, allowMissingColumns=True).join(hot, "supplier_id", "left_anti").repartition(tasks, "supplier_id")
    is_mapping = F.col("entry").isNotNull()
    values = [(k, F.when(is_mapping, F.col(c))) for k, c in offered] + [(k, F.when(~is_mapping, F.col(c))) for k, c in asked]
    met = _flat(together.select("supplier_id", _keys(*values).alias("key"), "row", "entry"))
    # the supplier is part of the key, so its rows need not move again
    met = met.withColumn("best", F.min("entry").over(Window.partitionBy(*KEY)))
    found = met.filter(~is_mapping & F.col("best").isNotNull()).select("row", F.col("best").alias("entry"))

    few = laid(mappings.join(hot, "supplier_id", "left_semi"), offered, "entry").groupBy(*KEY).agg(F.min("entry").alias("entry"))
    many = laid(lines.join(hot, "supplier_id", "left_semi"), asked, "row").join(few, KEY)
    return found.unionByName(many.select("row", "entry"))


def supplier_overrides(lines: DataFrame, mappings: DataFrame, empty_article: bool = False, up_to: str | None = None) -> DataFrame:
    """The best active mapping per line: ``(line_id, product_id, mapping_type, confidence)``.

    Lines are ``(line_id, supplier_id, raw_text, n_text, article)``. A mapping
    applies when its SKU or raw text equals the raw text, its article equals
    the article of the line, or the normalized texts agree; exact mappings
    come before approved, manual and learned ones. All four conditions are
    equalities on ``(supplier, kind, value)``. ``empty_article`` lets lines
    without article meet mappings with an empty one. ``up_to`` names the last
    type that is of use: only lines whose best mapping is of that type or one
    before it are given. Later types never win over those, so they stay behind.
    """
    article = F.coalesce("article", F.lit("")) if empty_article else F.nullif("article", F.lit(""))
    wanted = lines.select(
        "supplier_id", F.struct("line_id").alias("row"), F.col("raw_text").alias("w_raw"),
        article.alias("w_article"), F.col("n_text").alias("w_text"),
    )
    active = mappings.filter("is_active")
    if up_to is not None:
        active = active.filter(type_rank() <= TYPE_RANK[up_to])
    known = active.select(
        "supplier_id",
        F.struct(type_rank().alias("rank"), "mapping_id", "product_id", "mapping_type", "confidence").alias("entry"),
        "supplier_sku", "supplier_article", "supplier_raw_text", "normalized_supplier_text",
    )
    hits = _best_entries(
        wanted, known, [(RAW, "w_raw"), (ARTICLE, "w_article"), (TEXT, "w_text")],
        [(RAW, "supplier_sku"), (ARTICLE, "supplier_article"), (RAW, "supplier_raw_text"), (TEXT, "normalized_supplier_text")],
    )
    best = hits.select(F.col("row.line_id").alias("line_id"), "entry").groupBy("line_id").agg(F.min("entry").alias("best"))
    return best.select(
        "line_id",
        "best.product_id",
        "best.mapping_type",
        F.coalesce(F.nullif(F.col("best.confidence").cast("double"), F.lit(0.0)), F.lit(DEFAULT_CONFIDENCE)).alias(
            "confidence"
        ),
    )


def find_mapping(lookups: DataFrame, mappings: DataFrame) -> DataFrame:
    """First active mapping by one criterion: article if given, else normalized, else raw text."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    article, words, raw = given("article"), given("normalized_text"), given("raw_text")
    picked = lookups.select(
        "supplier_id",
        F.struct("lookup_id").alias("row"),
        article.alias("w_article"),
        F.when(article.isNull(), words).alias("w_text"),
        F.when(article.isNull() & words.isNull(), raw).alias("w_raw"),
    ).filter("w_article is not null or w_text is not null or w_raw is not null")
    known = mappings.filter("is_active").select(
        "supplier_id", F.struct("mapping_id", "product_id", "mapping_type").alias("entry"),
        "supplier_article", "supplier_raw_text", "normalized_supplier_text",
    )
    found = _best_entries(
        picked, known, [(ARTICLE, "w_article"), (TEXT, "w_text"), (RAW, "w_raw")],
        [(ARTICLE, "supplier_article"), (RAW, "supplier_raw_text"), (TEXT, "normalized_supplier_text")],
    )
    return found.select("row.lookup_id", "entry.mapping_id", "entry.product_id", "entry.mapping_type")


def list_mappings(mappings: DataFrame, supplier_id: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Mappings of a supplier, newest first."""
    return (
        mappings.filter(F.col("supplier_id") == supplier_id)
        .orderBy(F.desc("created_at"), "mapping_id")
        .offset(offset)
        .limit(limit)
    )


def search_mappings(mappings: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Mappings whose raw text, product or article contains ``needle``, any letter case."""
    needle = needle.strip().lower()
    rows = mappings
    if needle:
        hit = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle))
        rows = rows.filter(hit("supplier_raw_text") | hit("product_id") | hit("supplier_article"))
    return rows if limit is None else rows.orderBy("mapping_id").limit(limit)


def list_suppliers(suppliers: DataFrame, active_only: bool = True) -> DataFrame:
    rows = suppliers.filter("is_active") if active_only else suppliers
    return rows.orderBy("supplier_name", "supplier_id")


def ensure_suppliers(names: DataFrame, suppliers: DataFrame) -> DataFrame:
    """``(ordinal, supplier_id, supplier_name, is_new)`` for each wanted name ``(ordinal, name)``.

    Known names match in any letter case. New ones get a slug id, or one from
    the ordinal when no Latin letter or digit is left; the first ordinal names
    a supplier that is asked for several times, and later slugs that collide
    carry a hash of the name.
    """
    wanted = names.withColumn("name", F.trim("name")).filter("name != ''").withColumn("key", F.lower("name"))
    known = suppliers.groupBy(F.lower("supplier_name").alias("key")).agg(
        F.min_by("supplier_id", F.struct("supplier_id")).alias("known_id"),
        F.min_by("supplier_name", F.struct("supplier_id")).alias("known_name"),
    )
    joined = wanted.join(known, "key", "left")
    slug = F.trim(F.regexp_replace("key", "[^a-z0-9]+", "-"), F.lit("-"))
    fresh = (
        joined.filter("known_id is null")
        .groupBy("key")
        .agg(F.min("ordinal").alias("first_ordinal"), F.min_by("name", "ordinal").alias("first_name"))
        .withColumn(
            "slug",
            F.when(slug == "", F.concat(F.lit("bootstrap-"), F.lpad(F.col("first_ordinal").cast("string"), 2, "0"))).otherwise(
                slug
            ),
        )
        .withColumn("supplier_id", F.concat(F.lit("sup_"), "slug"))
    )
    taken = suppliers.select("supplier_id").withColumn("taken", F.lit(True)).distinct()
    owners = fresh.groupBy("supplier_id").agg(F.min("first_ordinal").alias("owner"))
    fresh = (
        fresh.join(taken, "supplier_id", "left")
        .join(owners, "supplier_id")
        .withColumn(
            "new_id",
            F.when(
                F.col("taken").isNull() & (F.col("owner") == F.col("first_ordinal")), F.col("supplier_id")
            ).otherwise(F.concat("supplier_id", F.lit("-"), F.md5("key"))),
        )
        .select("key", "new_id", "first_name")
    )
    return joined.join(fresh, "key", "left").select(
        "ordinal",
        F.coalesce("known_id", "new_id").alias("supplier_id"),
        F.coalesce("known_name", "first_name").alias("supplier_name"),
        F.col("known_id").isNull().alias("is_new"),
    )
