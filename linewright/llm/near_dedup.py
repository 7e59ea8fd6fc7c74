"""Near-duplicates by SimHash with deletion-variant signatures, and by shingle similarity.

``simhash_groups`` is the digest contract of ``op3_near_dedup``, as follows.
``groups`` and ``one_per_group`` link texts whose sets of five-word shingles have
a Jaccard similarity of 0.8 or more (``shingle_pairs``), most of which differ in more
bits than SimHash links, and with ``simhash_too`` also what SimHash links.

Fingerprints of 64 bits that differ in at most 3 bits are linked. Cut in two
halves, one half of such a pair differs in at most one bit. So each half is
indexed as it is and with each of its set bits wildcarded (cleared) in turn; a
half that equals another one, or a variant of it, gives a candidate pair by an
equality join, and the whole fingerprints decide.

A half that very many fingerprints share would give all pairs among them. There
the other half, which must be just as close, is cut again in the same way, down
to pieces of 8 bits, so that the pairs of a bucket stay bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from linewright.llm.batches import in_small_batches
from linewright.llm.columns import unused
from linewright.llm.components import connected_components
from linewright.llm.shingle_pairs import map_of, marks_of, similar_links, split_by
from linewright.session import materialize

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Near-duplicates by similarity.
WORDS = 5
SIMILARITY = 0.8
#: A key that more fingerprints share is cut further.
BUCKET = 128


def simhash(text: str | None) -> int:
    """The fingerprint of a whole text as a signed 64-bit number; no word: 0.

    In UTF-8 the bytes of A-Z and of white space stand for nothing else, so
    words are split and lower-cased as bytes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(SHINGLE_WORDS))) if len(words) >= SHINGLE_WORDS else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 65_536):
        block = hashes[start : start + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([simhash(t) for t in batch], dtype="int64")


def _variants(piece: Column, width: int) -> Column:
    """The piece with each of its set bits cleared."""
    bits = F.array(*[F.lit(1 << i) for i in range(width)])
    return F.transform(F.filter(bits, lambda b: piece.bitwiseAND(b) != 0), lambda b: piece.bitwiseAND(F.bitwise_not(b)))


def _indexed(rows: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Both halves of the ``width`` bits from ``low``, as they are and as one-wildcard variants.

    ``key`` sums up what has been matched so far, ``low`` is where the other
    half starts. Two keys that clash only give a candidate more.
    """
    half = width // 2
    ends = F.array(*[F.struct(F.lit(i * half).alias("at"), F.lit((1 - i) * half).alias("rest")) for i in (0, 1)])
    cut = rows.select("fp", "key", "low", F.explode(ends).alias("end"))
    cut = cut.withColumn("piece", F.expr(f"shiftrightunsigned(fp, low + end.at) & {(1 << half) - 1}L"))

    def keyed(of: DataFrame, piece: str) -> DataFrame:
        return of.select("fp", F.xxhash64("key", "end.at", piece).alias("key"), F.expr("low + end.rest").alias("low"))

    return keyed(cut, "piece"), keyed(cut.withColumn("variant", F.explode(_variants(F.col("piece"), half))), "variant")


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    other = right.select(F.col("fp").alias("other"), F.col("key").alias("other_key"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    close = left.join(other, left.key == other.other_key).where((F.col("fp") != F.col("other")) & (apart <= MAX_BITS))
    return close.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))


def _close_pairs(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Linked pairs of rows with one ``key`` that may differ in the ``width`` bits from ``low``."""
    l_exact, l_short = _indexed(left, width)
    if left is right:
        sides = [(l_exact, l_exact.union(l_short))]
    else:
        r_exact, r_short = _indexed(right, width)
        sides = [(l_exact, r_exact.union(r_short)), (l_short, r_exact)]
    found = []
    for l_rows, r_rows in sides:
        if width > 16:
            crowded = l_rows.groupBy("key").count().where(F.col("count") > BUCKET).select("key")
            crowded = materialize(crowded, "crowded-keys")
            if not crowded.isEmpty():
                l_in, r_in = (materialize(rows.join(crowded, "key", "left_semi"), "crowded") for rows in (l_rows, r_rows))
                found.append(_close_pairs(l_in, r_in, width // 2))
                l_rows, r_rows = (rows.join(crowded, "key", "left_anti") for rows in (l_rows, r_rows))
        found.append(_meet(l_rows, r_rows))
    return reduce(DataFrame.union, found)


def linked_pairs(distinct: DataFrame) -> DataFrame:
    """``(a, b)``: the different fingerprints in column ``fp`` at 1 to 3 bits from each other, each pair at least once."""
    rows = distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("low"))
    return _close_pairs(rows, rows, 64)


def _group_heads(prints: DataFrame, head: Column, node: str, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(node, head)`` for the distinct nodes: the least ``head`` of all rows in the group.

    Equal ones are one node, so copies cost nothing beyond a sum. ``link`` gives
    the links ``(a, b)`` among the distinct nodes.
    """
    nodes = materialize(prints.groupBy(node).agg(F.min(head).alias("head")), "distinct-nodes")
    joined = connected_components(link(nodes), "a", "b").withColumnRenamed("node", "linked")
    named = nodes.join(joined, nodes[node] == joined.linked, "left")
    named = materialize(named.select(node, "head", F.coalesce("component", node).alias("component")), "named-nodes")
    heads = named.groupBy("component").agg(F.min("head").alias("head"))
    return named.select(node, "component").join(heads, "component").select(node, "head")


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per document, linked at up to 3 bits.

    The component id is the smallest id in the group. A null text is an empty
    one; a document with a null id is in its group but does not name it, and a
    group without any id has a null one. Repeated rows stay. Other columns are
    not looked at. An empty table gives no rows.
    """
    prints = in_small_batches(docs).select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp"))
    prints = materialize(prints, "fingerprints")
    ids = _group_heads(prints, F.col("doc_id"), "fp", linked_pairs).withColumnRenamed("head", "component_id")
    return prints.join(ids, "fp").select("doc_id", "fp", "component_id")


def simhash_links(rows: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect the sets ``digest`` whose texts are in one group of fingerprints ``fp``."""
    sets = materialize(rows.select("digest", "fp").distinct(), "printed-sets")
    joined = connected_components(linked_pairs(sets.select("fp").distinct()), "a", "b").withColumnRenamed("node", "fp")
    named = sets.join(joined, "fp", "left").select("digest", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("digest").alias("b"))
    return named.join(least, "component").where("digest <> b").select(F.col("digest").alias("a"), "b").distinct()


def _links(rows: DataFrame, words: int, similarity: float, simhash_too: bool) -> DataFrame:
    links = similar_links(rows, words, similarity)
    return links.union(simhash_links(rows)) if simhash_too else links


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, simhash_too: bool = False) -> DataFrame:
    """``(doc_id, component_id)``, one row per document, linked by shingle similarity, with ``simhash_too`` also as in ``simhash_groups``; else as there."""
    rows = in_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), marks_of(words)(F.col(text)).alias("mark"), (fingerprints(F.col(text)) if simhash_too else F.lit(None)).alias("fp"))
    rows = rows.select("doc_id", "text", "mark.*", F.col("fp").cast("long").alias("fp"), F.monotonically_increasing_id().alias("at"))
    rows = materialize(rows, "marked-rows")  # the numbers hold from here on
    ids = _group_heads(rows, F.col("doc_id"), "digest", lambda _: _links(rows, words, similarity, simhash_too))
    return rows.join(ids.withColumnRenamed("head", "component_id"), "digest").select("doc_id", "component_id")


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, simhash_too: bool = False) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, all columns as they were.

    They are linked as by ``groups``. Of each group one row with the smallest id stays, or one without an id
    where the group has none.
    """
    mark, fp, at = unused(docs, "mark", "fp", "at")
    rows = in_small_batches(docs).withColumns({mark: marks_of(words)(F.col(text)), fp: fingerprints(F.col(text)) if simhash_too else F.lit(None).cast("long"), at: F.monotonically_increasing_id()})
    rows = materialize(rows, "marked-rows")  # the numbers hold from here on
    sets = rows.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(at).alias("at"), F.col(mark)["digest"].alias("digest"), F.col(mark)["size"].alias("size"), F.col(mark)["bits"].alias("bits"), F.col(fp).alias("fp"))
    least = F.struct(F.col("id").isNull().alias("unnamed"), "id", "at")
    heads = _group_heads(sets, least, "digest", lambda _: _links(sets, words, similarity, simhash_too))
    stay = heads.select(F.col("head.at").alias(at)).distinct()
    gone = materialize(rows.select(at).join(stay, at, "left_anti"), "copies")
    # only texts that a map of the copies names have to move, to be told from them for certain
    named, others = split_by(rows, map_of(gone, at), at)
    return others.select(*docs.columns).union(named.join(gone, at, "left_anti").select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
