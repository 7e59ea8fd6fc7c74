"""Hard negatives by inner product, found with stored angles and the triangle inequality.

Each vector stores its norm and its angles to a few reference directions. For an
anchor at angle s and a row at angle t to the same direction, the angle between
the two lies between abs(s - t) and min(s + t, 2 pi - s - t). The tightest
interval over all directions, as cosines times both norms and widened by more
than rounding can add, bounds the score. Rows whose interval cannot reach what
is searched for are never scored; the others are scored in whole numbers.

Rows lie in sections in the order of label, nearest direction and angle to it.
Anchors lie in blocks in the same order and meet the sections one by one: first
those with their own label, for the positives, then all others, for rows in the
windows that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.top_k import _kind, _products, whole_numbers
from linewright.session import materialize, spread

#: Reference directions, chosen from as many rows, those first in hash order.
DIRECTIONS, SAMPLE = 16, 2_048
#: Rows in a section, anchors in a block.
SECTION, BLOCK = 4_096, 512
#: More than rounding can add to an angle that is stored in 32 bits.
SLACK = 2e-6

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LEAST, MOST = 30, 90

MEASURED = "vec_id long, label long, vec binary, angles binary, cell int, angle float"
PACKED = "low long, high long, ids binary, labels binary, vecs binary, angles binary"


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def directions(sample: np.ndarray, most: int = DIRECTIONS) -> np.ndarray:
    """Unit vectors of the sample, each the one farthest by angle from those before it."""
    units = _units(sample)
    units = units[(units != 0).any(axis=1)]
    if not len(units):
        return np.eye(1, sample.shape[1])
    chosen = [0]
    near = units @ units[0]
    while len(chosen) < min(most, len(units)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, units @ units[chosen[-1]])
    return units[chosen]


def angles_to(rows: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles to the references; a zero vector has right angles to all."""
    return np.arccos(np.clip(_units(rows) @ references.T, -1, 1)).astype(np.float32)


def score_bounds(angles: np.ndarray, norm: float, o_angles: np.ndarray, o_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers that no inner product of one vector with each of the others is below or above.

    The others' angles have a row per direction and a column per vector.
    """
    angles = angles[:, None]
    apart = np.abs(o_angles - angles).max(axis=0).astype(np.float64) - SLACK
    together = o_angles + angles
    # the sum and what it lacks to a full turn, whichever is less, is largest at a half turn
    together = np.pi - np.abs(together - np.float32(np.pi)).max(axis=0).astype(np.float64) + SLACK
    reach = norm * o_norms
    pad = 1e-9 * reach + 1e-9
    lowest = np.ceil(reach * np.cos(np.minimum(together, np.pi)) - pad)
    highest = np.floor(reach * np.cos(np.maximum(apart, 0)) + pad)
    return lowest, highest


def _measured(rows: DataFrame, references: np.ndarray, kind: str) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["v"].to_list()).astype("<i8")
            angles = angles_to(vectors, references)
            cell = angles.argmin(axis=1)
            yield pd.DataFrame(
                {
                    "vec_id": batch["vec_id"],
                    "label": batch["label"],
                    "vec": [r.tobytes() for r in vectors.astype(kind)],
                    "angles": [r.tobytes() for r in angles],
                    "cell": cell.astype(np.int32),
                    "angle": angles[np.arange(len(batch)), cell],
                }
            )

    return rows.select("vec_id", "label", "v").mapInPandas(measure, MEASURED)


def _packed(rows: DataFrame, size: int, extra: str = "") -> DataFrame:
    """Rows of up to ``size`` neighbours by label, nearest direction and angle, with their values as bytes."""
    order = ["label", "cell", "angle", "vec_id"]
    names = [c.split()[0] for c in extra.split(", ") if c]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out(part: pd.DataFrame) -> pd.DataFrame:
            row = {"low": part["label"].min(), "high": part["label"].max()}
            row |= {"ids": part["vec_id"].to_numpy("<i8").tobytes(), "labels": part["label"].to_numpy("<i8").tobytes()}
            return pd.DataFrame([row | {c: b"".join(part[o]) for c, o in [("vecs", "vec"), ("angles", "angles"), *zip(names, names)]}])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= size:
                whole = pd.concat(held)
                full = n - n % size
                for start in range(0, full, size):
                    yield out(whole.iloc[start : start + size])
                held, n = [whole.iloc[full:]], n - full
        if n:
            yield out(pd.concat(held))

    placed = rows.select(*order, "vec", "angles", *names).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.mapInPandas(pack, PACKED + (", " + extra if extra else ""))


def _meet(blocks: DataFrame, sections: DataFrame, at: Column, look: Callable, names: list[str]) -> DataFrame:
    """What ``look`` finds, as columns of longs, for each block of anchors in each section that it has to see.

    Sections stay where the shuffle puts them, in at most as many groups as there
    are shuffle partitions; a block goes once to each group.
    """
    spark = blocks.sparkSession
    groups = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, sections.count()))
    left = blocks.select(F.struct(*blocks.columns).alias("a")).withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = sections.select(F.struct(*sections.columns).alias("b"))
    right = right.withColumn("grid", F.pmod(F.xxhash64("b.ids"), F.lit(groups)).cast("int"))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                found = [np.broadcast_arrays(*f) for f in look(a, b)]
                if found:
                    yield pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*found)))))

    # neither side is small by any bound that holds for all inputs
    left, right = spread(left, "grid"), spread(right, "grid").hint("merge")
    return left.join(right, "grid").where(at).select("a", "b").mapInPandas(each, ", ".join(f"{n} long" for n in names))


class _Side:
    """The vectors of a block or a section."""

    def __init__(self, row, width: int):
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.labels = np.frombuffer(row["labels"], "<i8")
        n = len(self.ids)
        raw = np.frombuffer(row["vecs"], f"<i{len(row['vecs']) // (n * width)}").reshape(n, width)
        self.vectors = raw.astype(np.float64) if np.abs(raw.astype(np.float64)).max(initial=0) ** 2 * width < 2**53 else raw
        self.angles = np.ascontiguousarray(np.frombuffer(row["angles"], "<f4").reshape(n, -1).T)
        self.norms = np.linalg.norm(raw.astype(np.float64), axis=1)


def _scores(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    if anchor.dtype == rows.dtype == np.float64:  # both small enough to be exact
        top = np.abs(anchor).max(initial=0) * np.abs(rows).max(initial=0) * len(anchor)
        if top < 2**53:
            return (rows @ anchor).astype(np.int64)
    return _products(anchor[None, :], rows)[0]


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _positives(width: int, k: int) -> Callable:
    def look(a, b) -> Iterator[tuple]:
        anchors, rows = _Side(a, width), _Side(b, width)
        for i, label in enumerate(anchors.labels):
            own = slice(*np.searchsorted(rows.labels, [label, label + 1]))
            ids = rows.ids[own]
            lowest, highest = score_bounds(anchors.angles[:, i], anchors.norms[i], rows.angles[:, own], rows.norms[own])
            other = ids != anchors.ids[i]
            sure = lowest[other]
            if not len(sure):
                continue
            least = np.partition(sure, len(sure) - k)[len(sure) - k] if len(sure) > k else -np.inf
            open_ = np.flatnonzero(other & (highest >= least))
            scores = _scores(anchors.vectors[i], rows.vectors[own][open_])
            best = _first(scores, ids[open_], k)
            yield anchors.ids[i], ids[open_][best], scores[best]

    return look


def _negatives(width: int, k: int, least: int, most: int) -> Callable:
    def look(a, b) -> Iterator[tuple]:
        anchors, rows = _Side(a, width), _Side(b, width)
        slots = np.frombuffer(a["positives"], "<i8").reshape(len(anchors.ids), -1, 3)
        for i, label in enumerate(anchors.labels):
            windows = [(place, positive, score, -(-least * score // 100), most * score // 100) for place, positive, score in slots[i].tolist() if place]
            windows = [w for w in windows if w[3] <= w[4]]
            if not windows:
                continue
            lowest, highest = score_bounds(anchors.angles[:, i], anchors.norms[i], rows.angles, rows.norms)
            differs = rows.labels != label
            some = np.flatnonzero(differs & (highest >= min(w[3] for w in windows)) & (lowest <= max(w[4] for w in windows)))
            lowest, highest = lowest[some], highest[some]
            open_ = np.zeros(len(some), bool)
            for _, _, _, low, high in windows:
                own = (highest >= low) & (lowest <= high)
                # those surely within the window bound the last place
                sure = lowest[(lowest >= low) & (highest <= high)]
                if len(sure) > k:
                    own &= highest >= np.partition(sure, len(sure) - k)[len(sure) - k]
                open_ |= own
            some = some[open_]
            scores, ids = _scores(anchors.vectors[i], rows.vectors[some]), rows.ids[some]
            for place, positive, score, low, high in windows:
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                best = inside[_first(scores[inside], ids[inside], k)]
                if len(best):
                    yield anchors.ids[i], place, positive, score, ids[best], scores[best]

    return look


def _ranked(found: DataFrame, keys: list[str], score: str, row: str, out: str, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), row))
    return found.withColumn(out, place).where(F.col(out) <= k)


def _mined(items: DataFrame, is_anchor: Column, width: int, top: float, positives: int, negatives: int, least: int, most: int) -> DataFrame:
    """The mining among vectors of one width."""
    # at most SAMPLE rows
    drawn = items.select("v", F.xxhash64("vec_id", "v").alias("key")).orderBy("key", "v").limit(SAMPLE).toPandas()
    references = directions(np.stack(drawn["v"].to_list()))
    measured = materialize(_measured(items, references, _kind(top)), "measured-vectors")
    sections = materialize(_packed(measured, SECTION), "sections")
    asked = items.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*")
    anchors = materialize(_measured(asked, references, _kind(top)), "anchors")

    near = (F.col("a.low") <= F.col("b.high")) & (F.col("a.high") >= F.col("b.low"))
    found = _meet(_packed(anchors, BLOCK), sections, near, _positives(width, positives), ["anchor_id", "positive_id", "positive_score"])
    found = _ranked(found, ["anchor_id"], "positive_score", "positive_id", "place", positives)
    slot = F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score")))
    slots = found.groupBy("anchor_id").agg(slot.alias("slots"))

    @F.pandas_udf("binary")
    def as_bytes(slots: pd.Series) -> pd.Series:
        """A fixed number of (place, id, score); place zero is none."""
        return pd.Series([np.array([*map(tuple, (tuple(s.values()) for s in each)), *[(0, 0, 0)] * (positives - len(each))], "<i8").tobytes() for each in slots])

    asking = anchors.join(slots.select(F.col("anchor_id").alias("vec_id"), as_bytes("slots").alias("positives")), "vec_id")
    asking = materialize(asking, "anchors-with-positives")
    other = (F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high")) | (F.col("a.low") != F.col("b.low"))
    names = ["anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _meet(_packed(asking, BLOCK, "positives binary"), sections, other, _negatives(width, negatives, least, most), names)
    return _ranked(found, ["anchor_id", "place"], "negative_score", "negative_id", "rank", negatives)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least: int = LEAST,
    most: int = MOST,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Positives of an anchor are its best other rows of the same label, by inner
    product, ties to the smaller id. For each, the best rows of another label
    whose score is between ``least`` and ``most`` hundredths of the positive's
    follow by rank; a positive below zero has none. ``is_anchor`` is over a
    column ``vec_id``; an id that repeats asks once, with its smallest label and
    vector, while as candidates repeated rows count each. "Other" rows have
    another id. Rows without id or label, and vectors that are null, empty, or
    hold a null or a number that is not finite, take no part. Vectors of
    different widths are never compared. Other columns are not looked at.
    Without anchors, positives or negatives there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole_numbers(F.col(embedding), scale).alias("v")
    )
    items = materialize(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    widths = items.groupBy("width").agg(F.max(norm).alias("top")).orderBy("width").collect()
    found = None
    for width, top in widths:
        part = _mined(items.where(F.col("width") == width), is_anchor, width, top, positives, negatives, least, most)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.range(0).selectExpr(*[f"id AS {c}" for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM pairs WHERE same QUALIFY place <= 5
), negatives AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
