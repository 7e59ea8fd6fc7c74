"""Normalization of a text column, as a chain of DataFrame steps.

Every step reads and rewrites ``n_text`` and may add its own ``n_*`` column.
The chain is an ordinary list of ``DataFrame -> DataFrame`` functions, so a
caller can drop, reorder or add steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.functions import dictionaries as D
from linewright.functions import text as T
from linewright.session import materialize

Step = Callable[[DataFrame], DataFrame]

def clean_unicode(df: DataFrame) -> DataFrame:
    return df.withColumn("n_text", T.clean_unicode(F.col("n_text")))


def repair_scripts(df: DataFrame) -> DataFrame:
    return df.withColumn("n_text", T.multiplication_sign(F.col("n_text"))).withColumn(
        "n_text", T.repair_scripts(F.col("n_text"))
    )


def extract_numbers(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("n_dims", T.last_dimensions(F.col("n_text")))
        .withColumn("n_text", T.dot_decimals(F.col("n_text")))
        .withColumn("n_numbers", T.numbers(F.col("n_text")))
    )


def normalize_units(df: DataFrame, table: dict[str, str] = D.UNIT_ALIASES) -> DataFrame:
    return (
        df.withColumn("_unit", T.canonical_units(F.col("n_text"), table))
        .withColumn("n_text", F.col("_unit.text"))
        .withColumn("n_unit", F.col("_unit.unit"))
        .drop("_unit")
    )


def expand_abbreviations(df: DataFrame, table: dict[str, str] = D.ABBREVIATIONS) -> DataFrame:
    return df.withColumn("n_text", T.replace_bounded(F.col("n_text"), table))


def normalize_packaging(
    df: DataFrame,
    table: dict[str, str] = D.PACKAGING_ALIASES,
    keywords: Sequence[str] = tuple(D.PACKAGING_KEYWORDS),
) -> DataFrame:
    return df.withColumn("n_text", T.replace_bounded(F.col("n_text"), table)).withColumn(
        "n_packaging", T.first_packaging(F.col("n_text"), list(keywords))
    )


def detect_brand(df: DataFrame, table: dict[str, str] = D.BRAND_ALIASES) -> DataFrame:
    lowered = F.lower(F.col("n_text"))
    return (
        df.withColumn("_brand", T.known_brand(F.col("n_text"), table))
        .withColumn(
            "n_text",
            F.when(
                F.col("_brand").isNotNull(),
                F.replace(lowered, F.col("_brand.key"), F.col("_brand.target")),
            ).otherwise(F.col("n_text")),
        )
        .withColumn("n_brand", F.col("_brand.target"))
        .drop("_brand")
    )


def remove_stopwords(df: DataFrame, stopwords: Sequence[str] = tuple(D.STOPWORDS)) -> DataFrame:
    return df.withColumn("n_text", T.drop_words(F.col("n_text"), list(stopwords)))


def tokenize(df: DataFrame) -> DataFrame:
    return df.withColumn("n_tokens", T.tokens(F.col("n_text"))).withColumn(
        "n_text", F.array_join("n_tokens", " ")
    )


DEFAULT_STEPS: tuple[Step, ...] = (
    clean_unicode,
    repair_scripts,
    extract_numbers,
    normalize_units,
    expand_abbreviations,
    normalize_packaging,
    detect_brand,
    remove_stopwords,
    tokenize,
)


def normalize(df: DataFrame, text: str = "raw_text", steps: Sequence[Step] | None = None) -> DataFrame:
    """Add ``n_text`` and the columns of the steps to ``df``."""
    return reduce(DataFrame.transform, steps or DEFAULT_STEPS, df.withColumn("n_text", F.col(text)))


def extract_features(df: DataFrame) -> DataFrame:
    """Article code and packaging token of normalized lines."""
    return df.withColumn("article", T.article_code(F.col("n_tokens"))).withColumn(
        "packaging", T.packaging_token(F.col("n_tokens"))
    )


def decompose(df: DataFrame, text: str = "raw_text", tokens: int | None = None) -> DataFrame:
    """What a resolver needs to know about a line: attributes, tokens (the first ones, if limited), category word."""
    return extract_features(normalize(df, text)).select(
        *df.columns,
        F.col("n_text").alias("normalized_text"),
        F.col("n_brand").alias("brand"),
        "article",
        F.col("n_numbers").alias("numbers"),
        F.col("n_dims").alias("dimensions"),
        F.col("n_unit").alias("unit"),
        "packaging",
        (F.slice("n_tokens", 1, tokens) if tokens else F.col("n_tokens")).alias("tokens"),
        T.leading_word(F.col("n_tokens")).alias("category_word"),
    )


# --- synonyms kept as a table ---


def _entries(synonyms: DataFrame) -> DataFrame:
    """Active synonyms, one target per scope and source (the highest ``synonym_id``)."""
    return (
        synonyms.filter("is_active")
        .groupBy("supplier_id", F.col("normalized_source_text").alias("source"))
        .agg(F.max_by("target_text", "synonym_id").alias("target"))
    )


def synonym_map(synonyms: DataFrame, supplier_id: str | None = None) -> DataFrame:
    """``(source, target)`` in force for a supplier; its own rows beat the global ones."""
    entries = _entries(synonyms)
    shared = entries.filter("supplier_id is null").select("source", F.col("target").alias("shared"))
    if supplier_id is None:
        return shared.withColumnRenamed("shared", "target")
    own = entries.filter(F.col("supplier_id") == supplier_id).select(
        "source", F.col("target").alias("own")
    )
    return shared.join(own, "source", "full_outer").select(
        "source", F.coalesce("own", "shared").alias("target")
    )


def _word_set(text):
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.concat(found, F.array(F.lit(""))))


def _reachable(entries: DataFrame) -> DataFrame:
    """Pairs ``(source, reached)``: applying the first may make the second applicable.

    A target can hold words of other sources, so one hit can lead to the next.
    Works on the synonym table alone and doubles the path length per round.
    """
    words = entries.select(
        F.col("source").alias("a"), F.explode(_word_set(F.col("target"))).alias("first_word")
    )
    reach = materialize(
        words.join(entries.select(F.col("source").alias("b"), "first_word"), "first_word")
        .filter((F.col("first_word") != "") & (F.col("a") != F.col("b")))
        .filter(F.length("b") <= F.length("a"))
        .select("a", "b")
        .distinct(),
        "synonym-reach",
    )
    size = reach.count()
    while size:
        onward = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        reach = materialize(
            reach.union(reach.join(onward, "b").select("a", F.col("c").alias("b"))).distinct(),
            "synonym-reach",
        )
        grown = reach.count()
        if grown == size:
            break
        size = grown
    return reach


def apply_synonyms(lines: DataFrame, synonyms: DataFrame, supplier: str = "supplier_id") -> DataFrame:
    """Replace synonyms in ``n_text``, longest source first, and list those applied.

    Lines meet synonyms through the first word of the source, so neither table
    is collected or broadcast; only the few hits of a text are gathered and
    folded over it. Equal texts of one supplier are worked on once.
    """
    entries = _entries(synonyms).withColumn(
        "first_word",
        F.coalesce(F.regexp_extract(F.lower("source"), r"(?U)\w+", 0), F.lit("")),
    )
    texts = lines.select(F.col(supplier).alias("scope"), F.col("n_text").alias("text")).distinct()
    direct = texts.withColumn("first_word", F.explode(_word_set(F.col("text")))).join(
        entries, "first_word"
    )
    in_scope = F.col("supplier_id").isNull() | (F.col("supplier_id") == F.col("scope"))
    direct = direct.filter(in_scope).select("scope", "text", "supplier_id", "source", "target")
    onward = (
        direct.select("scope", "text", F.col("source").alias("a"))
        .join(_reachable(entries), "a")
        .join(entries.withColumnRenamed("source", "b"), "b")
        .filter(in_scope)
        .select("scope", "text", "supplier_id", F.col("b").alias("source"), "target")
    )
    steps = (
        direct.union(onward)
        .groupBy("scope", "text", "source")
        .agg(F.max_by("target", F.col("supplier_id").isNotNull()).alias("target"))
        .groupBy("scope", "text")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.length("source")).alias("rank"), "source", "target"))
            ).alias("steps")
        )
    )

    def step(state, entry):
        pattern = F.concat(F.lit(r"(?iuU)(?<!\w)"), T.quote_pattern(entry["source"]), F.lit(r"(?!\w)"))
        after = F.regexp_replace(
            state["text"], pattern, F.regexp_replace(entry["target"], r"([\\$])", r"\\$1")
        )
        note = F.concat(entry["source"], F.lit("->"), entry["target"])
        return F.when(
            after != state["text"],
            F.struct(
                after.alias("text"), F.concat(state["applied"], F.array(note)).alias("applied")
            ),
        ).otherwise(state)

    empty = F.array().cast("array<string>")
    folded = steps.select(
        F.col("scope").alias("_scope"),
        F.col("text").alias("_before"),
        F.aggregate(
            "steps", F.struct(F.col("text").alias("text"), empty.alias("applied")), step
        ).alias("_state"),
    )
    joined = lines.join(
        folded,
        F.col(supplier).eqNullSafe(F.col("_scope")) & (F.col("n_text") == F.col("_before")),
        "left",
    )
    return joined.select(
        *[c for c in lines.columns if c != "n_text"],
        F.coalesce("_state.text", "n_text").alias("n_text"),
        F.coalesce("_state.applied", empty).alias("n_synonyms"),
    )
