"""Candidate retrieval: identifiers, words, trigrams and vectors, fused by rank."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.functions import similarity as S
from linewright.functions import text as T
from linewright.operators import vectors
from linewright.options import MatchOptions
from linewright.session import materialize, spread

HOT_ROWS = 20_000  # postings of one key beyond this are split over several tasks
FLOORS = (0.42, 0.35, 0.28, 0.21)  # scores that may already fill the list of a query

NAME_FACTOR, DOCUMENT_FACTOR = 0.8, 0.5


# --- identifiers ---


def exact_matches(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Products whose article, code or manufacturer code equals the article hint."""
    hints = queries.filter("article_hint is not null and article_hint != ''").select(
        "query_id", F.col("article_hint").alias("hint")
    )
    active = catalog.filter("is_active")
    # one equality join over all three fields; an OR of conditions could not be hashed
    fields = F.array_distinct(F.array_compact(F.array("article", "code", "manufacturer_code")))
    keyed = active.select("product_id", F.explode(fields).alias("hint"))
    # a code shared by many products and queries makes far more pairs than rows; a catalog of few files gave them to few tasks
    keyed = spread(keyed, "product_id")
    return hints.join(keyed, "hint").select("query_id", "product_id").distinct()


# --- trigram similarity ---


def _ordered_grams(sets: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(id, grams)``: grams of each text, rarest first, as ``struct(cnt, gram)``."""
    return (
        sets.select("id", F.explode("set").alias("gram"))
        .join(frequency, "gram", "left")
        .groupBy("id")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.coalesce("cnt", F.lit(0)).alias("cnt"), "gram"))
            ).alias("grams")
        )
    )


def _gram_frequency(sets: DataFrame) -> DataFrame:
    return sets.select(F.explode("set").alias("gram")).groupBy("gram").agg(F.count("*").alias("cnt"))


def _prefix(ordered: DataFrame, threshold: float) -> DataFrame:
    """The rare head of each gram list: sets that similar must share a gram within it."""
    n = F.size("grams")
    keep = n - F.ceil(n * threshold - 1e-9).cast("int") + 1
    head = F.slice("grams", F.lit(1), F.greatest(F.least(keep, n), F.lit(0)))
    return ordered.select("id", n.alias("n"), F.posexplode(head).alias("pos", "g")).select(
        "id", "n", "pos", F.col("g.gram").alias("gram"), F.col("g.cnt").alias("cnt")
    )


def _salted_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Equality join on ``key`` whose hot keys are cut into a grid of parts.

    ``cnt`` is the number of ``right`` rows of the key and is known on both
    sides; how many ``left`` rows have it is counted here, for keys that are hot
    there. Rows of one side scatter over its parts and visit all parts of the
    other, so a task meets about ``HOT_ROWS`` rows of either side, whatever
    share of all queries and products holds the key.
    """
    left = left.filter("cnt > 0")
    hot = left.groupBy(key).agg(F.count("*").alias("l_cnt")).filter(F.col("l_cnt") > HOT_ROWS)
    hot = hot.select(key, F.ceil(F.col("l_cnt") / HOT_ROWS).cast("int").alias("l_parts"))
    l_parts = F.coalesce("l_parts", F.lit(1))
    r_parts = F.greatest(F.ceil(F.col("cnt") / HOT_ROWS), F.lit(1)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    l = left.join(hot, key, "left").withColumn("r_part", every(r_parts))
    l = l.withColumn("l_part", F.pmod(F.xxhash64("l_id"), l_parts).cast("int"))
    r = right.join(hot, key, "left").withColumn("l_part", every(l_parts))
    r = r.withColumn("r_part", F.pmod(F.xxhash64("r_id"), r_parts).cast("int"))
    return spread(l.drop("cnt", "l_parts"), key, "l_part", "r_part").join(r.drop("cnt", "l_parts"), [key, "l_part", "r_part"])


def _gram_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose gram sets can reach the threshold (a superset of those that do)."""
    if threshold > 1:
        return None
    l = _prefix(left, threshold).select(
        F.col("id").alias("l_id"), F.col("n").alias("l_n"), F.col("pos").alias("l_pos"), "gram", "cnt"
    )
    r = _prefix(right, threshold).select(
        F.col("id").alias("r_id"), F.col("n").alias("r_n"), F.col("pos").alias("r_pos"), "gram", "cnt"
    )
    need = F.ceil((F.col("l_n") + F.col("r_n")) * (threshold / (1 + threshold)) - 1e-9)
    possible = F.least(F.col("l_n") - F.col("l_pos"), F.col("r_n") - F.col("r_pos"))
    return (
        _salted_join(l, r, "gram")
        .filter(
            (F.col("r_n") >= F.col("l_n") * threshold - 1e-9)
            & (F.col("l_n") >= F.col("r_n") * threshold - 1e-9)
            & (possible >= need)
        )
        .select("l_id", "r_id")
    )


def similar_texts(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """``(l_id, r_id, similarity)`` of texts with trigram similarity above ``threshold``.

    Both sides are ``(id, text)``. Exact: frequent grams are skipped only
    where the threshold proves that a rarer shared one must exist.
    """
    left = left.select("id", S.trigrams(F.col("text")).alias("set"))
    right = right.select("id", S.trigrams(F.col("text")).alias("set"))
    frequency = _gram_frequency(right)
    pairs = _gram_candidates(
        _ordered_grams(left, frequency), _ordered_grams(right, frequency), threshold
    )
    pairs = spread(pairs, "l_id", "r_id").distinct()
    l = left.select(F.col("id").alias("l_id"), F.col("set").alias("l_grams"))
    r = right.select(F.col("id").alias("r_id"), F.col("set").alias("r_grams"))
    return (
        pairs.join(l, "l_id")
        .join(r, "r_id")
        .select("l_id", "r_id", S.jaccard(F.col("l_grams"), F.col("r_grams")).alias("similarity"))
        .filter(F.col("similarity") > threshold)
    )


# --- words ---


def with_lexemes(df: DataFrame, text: str, out: str, lexemes: DataFrame | None = None) -> DataFrame:
    """Add the lexemes of a text; a lookup ``(token, lexeme)`` may stem tokens.

    A null lexeme marks a stop word: it is no term but keeps its position.
    Tokens that the lookup lacks stand for themselves.
    """
    tokenized = df.withColumn(out, S.lexeme_tokens(F.col(text)))
    if lexemes is None:
        return tokenized
    distinct = tokenized.select(F.col(out).alias("_tokens")).distinct()
    mapped = (
        distinct.select("_tokens", F.posexplode("_tokens").alias("pos", "token"))
        .join(lexemes.withColumn("_known", F.lit(True)), "token", "left")
        .withColumn("lexeme", F.when(F.col("_known"), F.col("lexeme")).otherwise(F.col("token")))
        .groupBy("_tokens")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "lexeme"))).alias("_l"))
        .select("_tokens", F.transform("_l", lambda x: x["lexeme"]).alias("_lexemes"))
    )
    return (
        tokenized.join(mapped, tokenized[out] == mapped["_tokens"], "left")
        .withColumn(out, F.coalesce("_lexemes", out))
        .drop("_tokens", "_lexemes")
    )


def _terms(lexemes: Column) -> Column:
    return F.array_distinct(F.filter(lexemes, lambda w: w.isNotNull()))


def term_rows(texts: DataFrame) -> DataFrame:
    """``(r_id, most, term)`` of documents with ``positions``; ``most`` is how often their commonest term stands in them."""
    most = F.array_max(F.transform(F.map_values("positions"), lambda p: F.size(p)))
    return texts.select(
        F.col("class_id").alias("r_id"), most.alias("most"), F.explode(F.map_keys("positions")).alias("term")
    )


def _term_postings(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(r_id, most, term, cnt)`` and ``(term, cnt)`` of documents with ``positions``."""
    rows = term_rows(texts)
    frequency = rows.groupBy("term").agg(F.count("*").alias("cnt"))
    return rows.join(frequency, "term"), frequency


def _ordered_terms(queries: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(id, n, t)``: terms of each query, rarest first, as ``struct(cnt, term)``."""
    return (
        queries.select(F.col("query_id").alias("id"), F.size("terms").alias("n"), F.explode("terms").alias("term"))
        .join(frequency, "term", "left")
        .groupBy("id", "n")
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.coalesce("cnt", F.lit(0)).alias("cnt"), "term"))
            ).alias("t")
        )
    )


def _term_candidates(ordered: DataFrame, postings: DataFrame, floor: float | None) -> DataFrame:
    """Pairs that share enough terms: all of them, or enough for a rank of ``floor``.

    Only the rarest terms of a query are looked up: of any ``m`` shared terms,
    one is among the ``n - m + 1`` rarest. ``postings`` carry ``cnt``, the
    number of documents that hold the term.
    """
    probes = ordered.select(F.col("id").alias("l_id"), "n", F.posexplode("t").alias("pos", "t")).select(
        "l_id", "n", "pos", F.col("t.term").alias("term"), F.col("t.cnt").alias("cnt")
    )
    if floor is None:
        probes = probes.filter("pos = 0")
        need = F.col("n")
    else:
        # every pair of positions adds at most 0.1 of independent evidence
        evidence = math.log(1 - floor) / math.log(1 - S.POSITION_WEIGHT) - 1e-9
        per_pair = F.col("most") * F.col("most")
        need = F.greatest(
            F.ceil((1 + F.sqrt(1 + 8 * F.lit(evidence) / per_pair)) / 2 - 1e-9), F.lit(2)
        )
    return (
        _salted_join(probes, postings, "term")
        .filter(F.col("pos") <= F.col("n") - need)
        .select("l_id", "r_id")
    )


# --- lexical score ---


@dataclass(frozen=True)
class CatalogIndex:
    """Lexical tables of a catalog, written once per catalog version.

    Products with the same name and document form one class, worked on as one;
    names with the same grams are compared once for all classes that have them.
    Equal texts score equally and rank by product id, so only the first ``cap``
    products of a class can enter a list and only those are members.
    """

    cap: int
    classes: DataFrame  # class_id, members, positions, name_grams, document_grams
    members: DataFrame  # class_id, product_id
    names: DataFrame  # name_id, class_id: classes whose names have the same grams
    name_grams: DataFrame  # id, grams; the id is a name_id
    document_grams: DataFrame  # id, grams; the id is a class_id
    name_frequency: DataFrame  # gram, cnt
    document_frequency: DataFrame
    postings: DataFrame  # r_id, most, term, cnt
    term_frequency: DataFrame  # term, cnt


def build_index(catalog: DataFrame, cap: int = 200, lexemes: DataFrame | None = None) -> CatalogIndex:
    """Write the lexical tables of the active products to the scratch folder."""
    same = Window.partitionBy("normalized_name", "search_document").orderBy("product_id")
    members = materialize(
        catalog.filter("is_active")
        .select("product_id", "normalized_name", "search_document")
        .withColumn("_n", F.row_number().over(same))
        .filter(F.col("_n") <= cap)
        .withColumn("class_id", F.first("product_id").over(same))
        .drop("_n"),
        "members",
    )
    classes = members.groupBy("class_id").agg(
        F.count("*").alias("members"),
        F.first("normalized_name").alias("normalized_name"),
        F.first("search_document").alias("search_document"),
    )
    classes = with_lexemes(classes, "search_document", "_lexemes", lexemes)
    classes = materialize(
        classes.select(
            "class_id",
            "members",
            S.lexeme_positions(F.col("_lexemes")).alias("positions"),
            S.trigrams(F.col("normalized_name")).alias("name_grams"),
            S.trigrams(F.col("search_document")).alias("document_grams"),
        ),
        "classes",
    )

    def grams(sets: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
        frequency = materialize(_gram_frequency(sets), label + "-frequency")
        return materialize(_ordered_grams(sets, frequency), label), frequency

    names = materialize(classes.groupBy("name_grams").agg(F.min("class_id").alias("name_id")), "names")
    name_grams, name_frequency = grams(names.select(F.col("name_id").alias("id"), F.col("name_grams").alias("set")), "name-grams")
    document_grams, document_frequency = grams(classes.select(F.col("class_id").alias("id"), F.col("document_grams").alias("set")), "document-grams")
    named = materialize(classes.select("class_id", "name_grams").join(names, "name_grams").select("name_id", "class_id"), "class-names")
    postings, term_frequency = _term_postings(classes)
    return CatalogIndex(
        cap, classes, members.select("class_id", "product_id"), named, name_grams, document_grams,
        name_frequency, document_frequency, materialize(postings, "postings"),
        materialize(term_frequency, "terms"),
    )


def _scored(pairs: DataFrame, queries: DataFrame, classes: DataFrame) -> DataFrame:
    """Exact lexical scores of candidate pairs."""
    q = queries.select(F.col("query_id").alias("l_id"), "terms", "q_grams")
    c = classes.withColumnRenamed("class_id", "r_id")
    measured = (
        pairs.join(c, "r_id")
        .join(q, "l_id")
        .select(
            F.col("l_id").alias("query_id"),
            F.col("r_id").alias("class_id"),
            "members",
            S.jaccard(F.col("q_grams"), F.col("name_grams")).alias("name_similarity"),
            S.jaccard(F.col("q_grams"), F.col("document_grams")).alias("document_similarity"),
            S.text_rank(F.col("terms"), F.col("positions")).alias("text_rank"),
            (
                (F.size("terms") > 0)
                & F.forall("terms", lambda t: F.map_contains_key(F.col("positions"), t))
            ).alias("all_terms"),
        )
    )
    return measured.withColumn(
        "lex_score",
        F.round(
            F.greatest(
                F.col("text_rank"),
                F.col("name_similarity") * NAME_FACTOR,
                F.col("document_similarity") * DOCUMENT_FACTOR,
            ),
            9,
        ),
    )


def _close(pairs: DataFrame | None, queries: DataFrame, grams: DataFrame, threshold: float) -> DataFrame | None:
    """The candidate pairs whose similarity by one text does reach the threshold, up to rounding."""
    if pairs is None:
        return None
    l = queries.select(F.col("query_id").alias("l_id"), "q_grams")
    r = grams.select(F.col("id").alias("r_id"), F.col("grams.gram").alias("r_grams"))
    measured = spread(pairs, "l_id", "r_id").distinct().join(r, "r_id").join(l, "l_id")
    reached = S.jaccard(F.col("q_grams"), F.col("r_grams")) >= threshold - 1e-8
    return measured.filter(reached).select("l_id", "r_id")


def _union(parts: list[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p for p in parts if p is not None])


def _within_reach(listed: DataFrame, cap: int) -> DataFrame:
    """The classes of a query that can still enter its list: better ones do not fill it with their members."""
    down = Window.partitionBy("query_id").orderBy(F.desc("lex_score"))
    peers = F.sum("members").over(Window.partitionBy("query_id", "lex_score"))
    ahead = F.sum("members").over(down) - peers  # equal scores share a running sum
    return listed.withColumn("_ahead", ahead).filter(F.col("_ahead") < cap).drop("_ahead")


def lexical_matches(
    queries: DataFrame,
    index: CatalogIndex,
    name_threshold: float = 0.15,
    document_threshold: float = 0.10,
    cap: int = 200,
    lexemes: DataFrame | None = None,
    floors: tuple[float, ...] = FLOORS,
) -> DataFrame:
    """``(query_id, product_id, lex_score, lex_rank)``: up to ``cap`` products per query.

    A product qualifies when it holds all terms of the query or one of its two
    texts is similar enough. ``queries`` is ``(query_id, text)`` and may bring
    its own ``terms``.

    Most queries fill their list with high scores. So the first rounds look
    only for pairs at or above a floor, where few and rare postings suffice;
    a query whose list is full there is done, the others go on. The last round
    applies the thresholds themselves, so the result is exact.
    """
    if cap > index.cap:
        raise ValueError(f"the index keeps {index.cap} products per text, asked for {cap}")
    if "terms" not in queries.columns:
        queries = with_lexemes(queries, "text", "_lexemes", lexemes)
        queries = queries.withColumn("terms", _terms(F.col("_lexemes"))).drop("_lexemes")
    queries = materialize(
        queries.select("query_id", "terms", S.trigrams(F.col("text")).alias("q_grams")), "queries"
    )
    sets = queries.select(F.col("query_id").alias("id"), F.col("q_grams").alias("set"))
    by_name = materialize(_ordered_grams(sets, index.name_frequency), "query-grams")
    by_document = materialize(_ordered_grams(sets, index.document_frequency), "query-grams")
    by_term = materialize(_ordered_terms(queries, index.term_frequency), "query-terms")

    def round_of(open_queries: DataFrame, floor: float | None) -> DataFrame:
        among = lambda df: df.join(
            open_queries.select(F.col("query_id").alias("id")), "id", "left_semi"
        )
        name_t = name_threshold if floor is None else floor / NAME_FACTOR
        document_t = document_threshold if floor is None else floor / DOCUMENT_FACTOR
        # each list is cut by its own measure first; the full score is for what is left
        close = lambda ordered, grams, least: _close(_gram_candidates(among(ordered), grams, least), open_queries, grams, least)
        named = close(by_name, index.name_grams, name_t)
        if named is not None:
            classes = index.names.select(F.col("name_id").alias("r_id"), "class_id")
            named = named.join(classes, "r_id").select("l_id", F.col("class_id").alias("r_id"))
        documented = close(by_document, index.document_grams, document_t)
        candidates = _union([named, documented, _term_candidates(among(by_term), index.postings, floor)])
        candidates = spread(candidates, "l_id", "r_id").distinct()
        qualifies = (
            F.col("all_terms")
            | (F.col("name_similarity") > name_threshold)
            | (F.col("document_similarity") > document_threshold)
        )
        if floor is not None:
            qualifies = qualifies & (F.col("lex_score") >= floor)
        best = Window.partitionBy("query_id").orderBy(F.desc("lex_score"), "class_id")
        found = (
            _scored(candidates, open_queries, index.classes)
            .filter(qualifies)
            .select("query_id", "class_id", "members", "lex_score")
            .withColumn("_n", F.row_number().over(best))
            .filter(F.col("_n") <= cap)
            .withColumn("_total", F.sum("members").over(Window.partitionBy("query_id")))
        )
        return found if floor is None else materialize(found.filter(F.col("_total") >= cap), "round")

    parts, remaining = [], queries
    for floor in floors:
        found = round_of(remaining, floor)
        parts.append(found)
        remaining = remaining.join(found.select("query_id").distinct(), "query_id", "left_anti")
        if remaining.isEmpty():
            break
    else:
        parts.append(round_of(remaining, None))

    ranked = Window.partitionBy("query_id").orderBy(F.desc("lex_score"), "product_id")
    listed = _within_reach(_union(parts).select("query_id", "class_id", "members", "lex_score"), cap)
    return (
        listed.select("query_id", "class_id", "lex_score")
        .join(index.members, "class_id")
        .withColumn("lex_rank", F.row_number().over(ranked))
        .filter(F.col("lex_rank") <= cap)
        .select("query_id", "product_id", "lex_score", "lex_rank")
    )


def _signature(terms: Column) -> Column:
    """A long with one of its bits set for each term; what holds all terms has all their bits."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(t), F.lit(64)).cast("int"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseOR(bit(t)))


def text_matches(queries: DataFrame, documents: DataFrame, lexemes: DataFrame | None = None) -> DataFrame:
    """``(query_id, product_id, text_rank)`` of documents that hold all terms of a query.

    Documents with the same text are looked at once. Of those that hold the
    rarest term of a query, signatures leave out most of the others before
    whole documents are read.
    """
    queries = with_lexemes(queries.select("query_id", "text"), "text", "_l", lexemes)
    queries = queries.withColumn("terms", _terms(F.col("_l"))).drop("_l").filter(F.size("terms") > 0)
    asked = queries.select("query_id", "terms", _signature(F.col("terms")).alias("asked"))
    documents = documents.filter("product_id is not null and search_document is not null")
    named = documents.select(F.md5("search_document").alias("class_id"), "product_id")
    texts = with_lexemes(documents.select("search_document").distinct(), "search_document", "_l", lexemes)
    texts = texts.select(F.md5("search_document").alias("class_id"), S.lexeme_positions(F.col("_l")).alias("positions"))
    texts = materialize(texts.withColumn("held", _signature(F.map_keys("positions"))), "texts")
    frequency = materialize(term_rows(texts).groupBy("term").agg(F.count("*").alias("cnt")), "terms")
    rows = texts.select(F.col("class_id").alias("r_id"), "held", F.explode(F.map_keys("positions")).alias("term"))
    first = F.col("t")[0]
    probes = _ordered_terms(queries, frequency).select(F.col("id").alias("l_id"), first["term"].alias("term"), first["cnt"].alias("cnt"))
    probes = probes.join(asked.select(F.col("query_id").alias("l_id"), "asked"), "l_id")
    pairs = _salted_join(probes, rows.join(frequency, "term"), "term").filter(F.col("held").bitwiseAND(F.col("asked")) == F.col("asked"))
    found = (
        pairs.select("l_id", "r_id")
        .distinct()
        .join(asked.withColumnRenamed("query_id", "l_id"), "l_id")
        .join(texts.withColumnRenamed("class_id", "r_id"), "r_id")
        .filter(F.forall("terms", lambda t: F.map_contains_key(F.col("positions"), t)))
        .select(F.col("l_id").alias("query_id"), F.col("r_id").alias("class_id"), F.round(S.text_rank(F.col("terms"), F.col("positions")), 9).alias("text_rank"))
    )
    return found.join(named, "class_id").select("query_id", "product_id", "text_rank")


# --- vectors ---


def semantic_matches(queries: DataFrame, embeddings: DataFrame, catalog: DataFrame, cap: int = 200) -> DataFrame:
    """``(query_id, product_id, sem_score, sem_rank)``: nearest active products by cosine."""
    live = embeddings.join(catalog.filter("is_active").select("product_id"), "product_id", "left_semi")
    return vectors.nearest(queries, live, cap)


# --- fusion ---


def fuse(
    lexical: DataFrame, semantic: DataFrame | None = None, exact: DataFrame | None = None, k: int = 60
) -> DataFrame:
    """Reciprocal rank fusion of the three lists; exact hits count as rank zero."""
    none = F.lit(None)
    parts = [
        lexical.select(
            "query_id", "product_id", "lex_score", "lex_rank",
            none.cast("double").alias("sem_score"), none.cast("int").alias("sem_rank"),
            F.lit(False).alias("exact"),
        )
    ]
    if semantic is not None:
        parts.append(
            semantic.select(
                "query_id", "product_id",
                none.cast("double").alias("lex_score"), none.cast("int").alias("lex_rank"),
                "sem_score", "sem_rank", F.lit(False).alias("exact"),
            )
        )
    if exact is not None:
        parts.append(
            exact.select(
                "query_id", "product_id",
                none.cast("double").alias("lex_score"), none.cast("int").alias("lex_rank"),
                none.cast("double").alias("sem_score"), none.cast("int").alias("sem_rank"),
                F.lit(True).alias("exact"),
            )
        )
    merged = _union(parts).groupBy("query_id", "product_id").agg(
        F.max("exact").alias("exact_match"),
        F.max("lex_score").alias("lex_score"),
        F.max("sem_score").alias("sem_score"),
        F.max("lex_rank").alias("lex_rank"),
        F.max("sem_rank").alias("sem_rank"),
    )
    share = lambda rank: F.coalesce(1.0 / (F.lit(k) + F.col(rank)), F.lit(0.0))
    return merged.select(
        "query_id",
        "product_id",
        "exact_match",
        F.coalesce("lex_score", F.lit(0.0)).alias("lexical_score"),
        F.coalesce("sem_score", F.lit(0.0)).alias("semantic_score"),
        (F.when(F.col("exact_match"), 1.0 / k).otherwise(0.0) + share("lex_rank") + share("sem_rank")).alias(
            "rrf_score"
        ),
    )


PRODUCT_COLUMNS = [
    "name", "normalized_name", "article", "brand", "normalized_brand", "manufacturer_code",
    "category_id", "category_path", "unit", "packaging", "search_document",
]


def hydrate(fused: DataFrame, catalog: DataFrame, queries: DataFrame, top_n: int = 50) -> DataFrame:
    """Add product columns, apply the category and brand filters of a query, keep the best."""
    rows = fused.join(catalog.filter("is_active").select("product_id", *PRODUCT_COLUMNS), "product_id")
    filters = [c for c in ("category_filter", "brand_filter") if c in queries.columns]
    if filters:
        rows = rows.join(queries.select("query_id", *filters), "query_id")
        for name, column in (("category_filter", "category_id"), ("brand_filter", "normalized_brand")):
            if name in filters:
                wanted = F.nullif(F.col(name), F.lit(""))
                rows = rows.filter(wanted.isNull() | (F.col(column) == wanted))
        rows = rows.drop(*filters)
    best = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "product_id")
    return rows.withColumn("retrieval_rank", F.row_number().over(best)).filter(
        F.col("retrieval_rank") <= top_n
    )


def relaxed_queries(queries: DataFrame, lexemes: DataFrame | None = None) -> DataFrame:
    """Queries cut down to their leading word; those without one drop out."""
    word = T.leading_word(T.words(F.col("text")))
    kept = queries.withColumn("_lead", F.lower(word)).filter("_lead is not null")
    return with_lexemes(kept, "_lead", "_l", lexemes).withColumn("terms", _terms(F.col("_l"))).drop("_l", "_lead")


def hybrid_search(
    queries: DataFrame,
    catalog: DataFrame,
    embeddings: DataFrame | None = None,
    options: MatchOptions = MatchOptions(),
    lexemes: DataFrame | None = None,
    index: CatalogIndex | None = None,
) -> DataFrame:
    """The ``retrieval_top_n`` best products per query, with scores and ranks.

    ``queries`` holds ``query_id, text`` and optionally ``article_hint,
    category_filter, brand_filter, vector``. Lists are cut at the thresholds,
    whatever the size of the catalog; queries that found nothing get a relaxed
    search. Without a ready ``index`` one is built for the run.
    """
    index = index or build_index(catalog, max(options.list_cap, options.relaxed_list_cap), lexemes)
    with_vectors = embeddings is not None and "vector" in queries.columns
    hinted = "article_hint" in queries.columns

    def search(part: DataFrame, name_t: float, document_t: float, cap: int, top_n: int, exact: bool):
        lexical = lexical_matches(part, index, name_t, document_t, cap, lexemes)
        semantic = semantic_matches(part, embeddings, catalog, cap) if with_vectors else None
        hits = exact_matches(part, catalog) if exact else None
        return hydrate(fuse(lexical, semantic, hits, options.fusion_k), catalog, part, top_n)

    queries = materialize(queries, "queries")
    found = search(
        queries, options.name_threshold, options.document_threshold, options.list_cap,
        options.retrieval_top_n, hinted,
    )
    found = materialize(found, "found")
    missed = queries.join(found.select("query_id").distinct(), "query_id", "left_anti")
    if missed.isEmpty():
        return found
    relaxed = search(
        relaxed_queries(missed, lexemes), options.relaxed_name_threshold,
        options.relaxed_document_threshold, options.relaxed_list_cap, options.relaxed_top_n, False,
    )
    return found.unionByName(relaxed)


def rank_whole_catalog(
    queries: DataFrame,
    catalog: DataFrame,
    embeddings: DataFrame | None = None,
    options: MatchOptions = MatchOptions(),
    lexemes: DataFrame | None = None,
    most: int = 500,
) -> DataFrame:
    """Rank every active product for each query, inside the query's row.

    For callers that want products without any resemblance listed too; refused
    for catalogs above ``most`` active products. The catalog is gathered into
    one row, of that proven size, which every task gets.
    """
    with_vectors = embeddings is not None and "vector" in queries.columns
    active = catalog.filter("is_active")
    if active.limit(most + 1).count() > most:
        raise ValueError(f"catalog has more than {most} active products")
    prepared = with_lexemes(active, "search_document", "_lexemes", lexemes)
    if with_vectors:
        prepared = prepared.join(embeddings.select("product_id", F.col("vector").alias("_vector")), "product_id", "left")
    else:
        prepared = prepared.withColumn("_vector", F.lit(None).cast("array<float>"))
    product = F.struct(
        "product_id",
        F.array_compact(F.array("article", "code", "manufacturer_code")).alias("codes"),
        S.trigrams(F.col("normalized_name")).alias("name_grams"),
        S.trigrams(F.col("search_document")).alias("document_grams"),
        S.lexeme_positions(F.col("_lexemes")).alias("positions"),
        F.col("_vector").alias("vector"),
    )
    gathered = prepared.agg(F.collect_list(product).alias("_products"))
    ready = queries
    if "terms" not in ready.columns:
        ready = with_lexemes(ready, "text", "_l", lexemes)
        ready = ready.withColumn("terms", _terms(F.col("_l"))).drop("_l")
    ready = ready.withColumn("_grams", S.trigrams(F.col("text")))
    hint = F.nullif(F.col("article_hint"), F.lit("")) if "article_hint" in queries.columns else F.lit(None).cast("string")

    def measured(p: Column) -> Column:
        lexical = F.greatest(
            S.text_rank(F.col("terms"), p["positions"]),
            S.jaccard(F.col("_grams"), p["name_grams"]) * NAME_FACTOR,
            S.jaccard(F.col("_grams"), p["document_grams"]) * DOCUMENT_FACTOR,
        )
        semantic = S.cosine(F.col("vector"), p["vector"]) if with_vectors else F.lit(None).cast("double")
        return F.struct(
            p["product_id"].alias("product_id"),
            F.coalesce(F.array_contains(p["codes"], hint), F.lit(False)).alias("exact"),
            F.round(lexical, 9).alias("lex"),
            F.round(semantic, 9).alias("sem"),
        )

    def rank_map(score: str) -> Column:
        known = F.filter("_all", lambda x: x[score].isNotNull())
        ordered = F.array_sort(F.transform(known, lambda x: F.struct((-x[score]).alias("s"), x["product_id"].alias("p"))))
        return F.map_from_entries(F.transform(ordered, lambda x, i: F.struct(x["p"], i + 1)))

    k = F.lit(options.fusion_k)
    ranked = (
        ready.join(F.broadcast(gathered))
        .withColumn("_all", F.transform("_products", measured))
        .withColumn("_lex", rank_map("lex"))
        .withColumn("_sem", rank_map("sem"))
        .withColumn(
            "_fused",
            F.transform(
                "_all",
                lambda x: F.struct(
                    (
                        -(
                            F.when(x["exact"], 1.0 / k).otherwise(0.0)
                            + F.coalesce(1.0 / (k + F.col("_lex")[x["product_id"]]), F.lit(0.0))
                            + F.coalesce(1.0 / (k + F.col("_sem")[x["product_id"]]), F.lit(0.0))
                        )
                    ).alias("minus"),
                    x["product_id"].alias("product_id"),
                    x["exact"].alias("exact"),
                    x["lex"].alias("lex"),
                    x["sem"].alias("sem"),
                ),
            ),
        )
        .select(
            "query_id",
            F.posexplode(F.slice(F.array_sort("_fused"), 1, options.retrieval_top_n)).alias("at", "x"),
        )
    )
    best = ranked.select(
        "query_id",
        F.col("x.product_id").alias("product_id"),
        F.col("x.exact").alias("exact_match"),
        F.col("x.lex").alias("lexical_score"),
        F.coalesce("x.sem", F.lit(0.0)).alias("semantic_score"),
        (-F.col("x.minus")).alias("rrf_score"),
        (F.col("at") + 1).alias("retrieval_rank"),
    )
    listed = active.select("product_id", *PRODUCT_COLUMNS)
    return best.join(listed, "product_id").select(
        "product_id", "query_id", "exact_match", "lexical_score", "semantic_score", "rrf_score",
        *PRODUCT_COLUMNS, "retrieval_rank",
    )


# --- lookups ---


def search_products(catalog: DataFrame, query: str | None = None, limit: int = 50) -> DataFrame:
    """Active products with the text in name, article or brand, any letter case, by name."""
    rows = catalog.filter("is_active")
    if query:
        needle = F.lower(F.lit(query))
        hit = lambda column: F.coalesce(F.contains(F.lower(F.col(column)), needle), F.lit(False))
        rows = rows.filter(hit("name") | hit("article") | hit("brand"))
    return rows.orderBy("name", "product_id").limit(limit)


def alias_hits(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(query_id, product_id)`` of products with an alias equal to the query text."""
    return (
        queries.select("query_id", F.col("text").alias("normalized_alias_text"))
        .join(aliases.select("normalized_alias_text", "product_id").distinct(), "normalized_alias_text")
        .select("query_id", "product_id")
        .distinct()
    )
