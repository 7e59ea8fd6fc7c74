"""Exact deduplication by recipes of content-defined chunks.

A text is cut where a rolling hash of its last bytes says so, so equal texts are
cut alike and a passage that many texts hold gives the same chunks in all of
them. Each different chunk is moved once: it meets all chunks of its hash, and a
hash with one content only is a verified identifier. A hash of several contents
(a collision) is told apart by the content itself. From there on only recipes,
the ordered lists of identifiers, are shuffled and compared; two texts are equal
exactly if their recipes are. A long document is cut once per pass over the
table and never moves as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.batches import in_small_batches
from linewright.session import materialize

#: A cut depends on this many bytes; as many low bits of the hash must be zero for an average chunk of 4 KB.
WINDOW, CUT_BITS = 32, 12
#: Longer stretches without a cut are cut at multiples of this.
MOST_BYTES = 1 << 16
SEED = 42
#: Groups with more than this share of all documents (at most its inverse in number) are joined by broadcast.
HOT_SHARE = 0.001

#: A fixed number per byte, the low 32 bits of the hash of it.
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), SEED) & 0xFFFFFFFF for b in range(256)], np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end; nothing for empty data."""
    if len(data) <= WINDOW:
        return [len(data)] if data else []
    rolling = GEAR[np.frombuffer(data, np.uint8)]
    reach = 1
    while reach < WINDOW:  # each step doubles the bytes that a hash covers
        rolling[reach:] += rolling[:-reach] << np.uint32(reach)
        reach *= 2
    # the high bits depend on all bytes of the window
    ends = (np.flatnonzero(rolling[WINDOW:] >> np.uint32(32 - CUT_BITS) == 0) + WINDOW + 1).tolist()
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    out, start = [], 0
    for end in ends:
        out += range(start + MOST_BYTES, end, MOST_BYTES)
        out.append(end)
        start = end
    return out


def normalized(text: bytes | None) -> bytes:
    """A-Z in lower case; null is empty."""
    return (text or b"").lower()  # of bytes only A-Z change


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _names(parts: list[bytes], bits: int) -> list[int]:
    """The hash of each chunk, as a signed number of at most ``bits`` bits."""
    return [(xxhash.xxh64_intdigest(p, SEED) >> (64 - bits)) - (1 << (bits - 1)) for p in parts]


def _recipes(docs: DataFrame, bits: int, with_chunks: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cook(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normalized(t) for t in batch["text"]]
            parts = [chunks(t) for t in texts]
            out = pd.DataFrame({"doc_id": batch["doc_id"], "text_sha256": [hashlib.sha256(t).hexdigest() for t in texts]})
            out["recipe"] = [_names(p, bits) for p in parts]
            if with_chunks:
                out["chunks"] = parts
            yield out

    return docs.mapInPandas(cook, f"doc_id {kind}, text_sha256 string, recipe array<long>" + ", chunks array<binary>" * with_chunks)


def _collisions(docs: DataFrame, bits: int) -> DataFrame:
    """``name``: the hashes that stand for several contents."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = list({p for t in batch["text"] for p in chunks(normalized(t))})
            yield pd.DataFrame({"name": _names(parts, bits), "chunk": parts})

    each = docs.select("text").mapInPandas(cut, "name long, chunk binary").distinct()
    return each.groupBy("name").count().where("count > 1").select("name")


def _verified(docs: DataFrame, bits: int) -> DataFrame:
    """``(doc_id, text_sha256, recipe)`` with verified identifiers only, numbered by ``at``."""
    collided = materialize(_collisions(docs, bits), "collided-chunks")
    if collided.isEmpty():
        rows = _recipes(docs, bits, False)
        return materialize(rows.withColumn("at", F.monotonically_increasing_id()), "recipes")
    # an identifier is the hash, with the content behind it where the hash alone does not tell
    rows = _recipes(docs, bits, True).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows, "recipes-with-chunks")
    parts = rows.select("at", F.posexplode_outer(F.arrays_zip("recipe", "chunks")).alias("place", "part"))
    parts = parts.select("at", "place", F.col("part.recipe").alias("name"), F.col("part.chunks").alias("chunk"))
    known = collided.withColumnRenamed("name", "told")
    parts = parts.join(known, parts.name == known.told, "left")
    number = F.to_binary(F.lpad(F.hex("name"), 16, "0"), F.lit("hex"))
    content = F.when(F.col("told").isNotNull(), F.col("chunk")).otherwise(F.lit(b""))
    named = F.struct("place", F.concat(number, content).alias("name"))
    lists = parts.groupBy("at").agg(F.sort_array(F.collect_list(F.when(F.col("place").isNotNull(), named))).alias("list"))
    lists = lists.select("at", F.col("list.name").alias("recipe"))
    return materialize(rows.drop("recipe", "chunks").join(lists, "at").select("doc_id", "text_sha256", "recipe", "at"), "recipes")


def duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per document.

    Texts are equal when they are identical after lower-casing A-Z; a null text
    is an empty one. Of equal texts the row with the largest id stays; null ids
    count as smallest, and of rows that repeat the largest id one stays. The
    digest is of the normalized text in UTF-8. Other columns are not looked at;
    an empty table gives no rows.
    """
    rows = in_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = _verified(rows, hash_bits)
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "at")).alias("last")
    groups = rows.groupBy("recipe").agg(last, F.count("*").alias("group_size"))
    groups = materialize(groups.select(F.col("recipe").alias("of"), F.col("last.doc_id").alias("keep_id"), F.col("last.at").alias("keep_at"), "group_size"), "recipe-groups")
    # fewer groups than 1 / HOT_SHARE are that large, so they may go to every task; no key of the other join is hot
    least = int(HOT_SHARE * rows.count()) + 1
    hot = groups.where(F.col("group_size") > least)
    cold = groups.where(F.col("group_size") <= least)
    same = F.col("recipe") == F.col("of")
    in_hot = rows.join(F.broadcast(hot), same)
    in_cold = rows.join(F.broadcast(hot.select("of")), same, "left_anti").join(cold, same)
    kept = F.col("at") == F.col("keep_at")
    return in_hot.union(in_cold).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), placed AS (
  SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
    row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept
  FROM texts
)
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM placed
"""
