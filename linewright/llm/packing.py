"""Best-fit packing, planned on the histogram of piece lengths.

Documents become token ids plus an end id; longer ones than a sequence are cut
into pieces. Best-fit decreasing then runs over the counts of each length, not
over pieces: sequences with equal room are one class, and a step moves a whole
run of them at once. So the plan takes about as many steps as there are lengths,
whatever the corpus. Pieces take their planned slots by joining on the length
and their rank within it.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from linewright.llm.batches import in_small_batches
from linewright.operators.scans import running_position
from linewright.session import materialize

CAPACITY = 2048
END_ID = 0
#: How the byte-level vocabulary splits text before merging; a fixed value of its published form.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters outside the blocks on whose classes all versions of Unicode agree.
UNSETTLED = re.compile("[^\x00-\u024f\u2010-\u2027]").search

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers.

    The merges of the vocabulary file are applied by a faster library; texts
    with added tokens, or with characters that it might class differently, go to
    the tokenizer itself.
    """

    def __init__(self, vocabulary: str):
        self.tokenizer = Tokenizer.from_file(vocabulary)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {_as_bytes(t): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        # where an added token stands as text, the tokenizer takes it whole
        self.special = re.compile("|".join(map(re.escape, sorted(special)))).search if special else lambda text: None
        self.merger = tiktoken.Encoding("corpus", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if UNSETTLED(text) or self.special(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.merger.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


def _as_bytes(token: str) -> bytes:
    """The bytes that a byte-level token stands for."""
    return bytes(BYTE_OF[c] for c in token)


# printable Latin-1 stands for itself, the other bytes follow from 256 on
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in _PRINTED]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(_OTHERS)}


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, bytes]]:
    """``(piece, start, ids)``; a first piece takes what full pieces leave."""
    total = len(ids) // 4
    end = (total - 1) % capacity + 1
    start = 0
    piece = 0
    while start < total:
        yield piece, start, ids[4 * start : 4 * end]
        piece, start, end = piece + 1, end, end + capacity


def tokenized_pieces(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``, with ``ids`` (32-bit numbers) on demand.

    A null text is empty, so it holds the end id alone.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = Encoder(vocabulary)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for key, whole in zip(batch["doc_id"], batch["text"]):
                for piece, start, ids in cut(ids_of(whole or "") + end, capacity):
                    row = (key, piece, start, len(ids) // 4, zlib.crc32(ids))
                    rows.append((*row, list(memoryview(ids).cast("I"))) if with_ids else row)
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"doc_id": "Int64"})

    rows = in_small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInPandas(encode, PIECES + ", ids array<long>" * with_ids)


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first_rank, n, sequence, offset)``: pieces by rank from ``first_rank`` go to sequences from ``sequence`` on.

    Best-fit decreasing: the longest pieces first, each into the sequence with
    the least room that still holds it, else into a new one.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    plan = []
    opened = 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            heapq.heappush(runs[room], (first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 1, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = heapq.heappop(runs[room])
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            used = min(n, left)
            plan.append((length, rank, used, first, capacity - room))
            put(room, first + used, n - used)
            put(room - length, first, used)
            rank, left = rank + used, left - used
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: str | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``length`` from 1 to ``capacity``.

    Only the histogram, of at most ``capacity`` rows, reaches the driver, and
    the plan, of the same order, goes back as a table. A length of any count is
    ranked in slices. Repeated rows are pieces of their own; no pieces give no
    rows. Pieces of a length take their slots by ``doc_id``, or by the column
    ``order``; then sequences are also numbered by the least of it that they hold.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    pieces = materialize(pieces, "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}
    plan = best_fit_plan(counts, capacity)
    steps = spark.createDataFrame(plan, "p_length long, first_rank long, n long, sequence long, offset long")
    ties = [c for c in ("piece", "start", "ids_crc32") if c in columns]
    ranked = running_position(pieces, ["length"], order or "doc_id", "rank", ties=["doc_id"] * bool(order) + ties)
    slot = F.broadcast(steps)  # bounded by the capacity, not by the corpus
    within = F.col("rank").between(F.col("first_rank"), F.col("first_rank") + F.col("n") - 1)
    placed = ranked.join(slot, (ranked.length == slot.p_length) & within)
    placed = placed.select(*columns, (F.col("sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset")
    return _renumbered(materialize(placed, "placed"), order) if order else placed


def _renumbered(placed: DataFrame, order: str) -> DataFrame:
    """``placed`` with its sequences numbered from zero by the least ``order`` in them."""
    first = placed.groupBy(F.col("sequence_id").alias("opened")).agg(F.min(order).alias("least"))
    numbers = running_position(first, [], "least", "number", ties=["opened"]).select("opened", (F.col("number") - 1).alias("number"))
    joined = placed.join(numbers, F.col("sequence_id") == F.col("opened"))
    return joined.select(*[F.col("number").alias(c) if c == "sequence_id" else F.col(c) for c in placed.columns])


def pack_documents(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, places: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one row per piece.

    Other columns are not looked at. An empty table gives no rows. With
    ``places``, ``(doc_id, at)``, sequences follow the order of ``at``.
    """
    pieces = tokenized_pieces(docs, vocabulary, doc_id, text, capacity)
    if places is None:
        return pack(pieces, capacity)
    # one place an id, so no piece comes twice
    at = places.groupBy(F.col("doc_id").cast("long").alias("placed_id")).agg(F.min("at").alias("at"))
    pieces = pieces.join(at, pieces.doc_id.eqNullSafe(at.placed_id), "left").drop("placed_id")
    return pack(pieces, capacity, "at").drop("at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
