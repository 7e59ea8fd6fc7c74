"""Quality classifier: gradient-boosted trees on histograms of document statistics.

The trees are grown here from a bounded sample of labelled documents and
flattened into arrays, so that a batch walks all trees at once.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from linewright.llm.batches import in_small_batches
from linewright.llm.columns import unused

#: Most labelled documents that a model learns from, the first in hash order.
MAX_TRAIN = 20_000
#: Documents with this remainder of crc32(doc_id) by FOLDS are held out.
FOLDS, HELD_OUT = 3, 1

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
SYMBOLS = b"#*$%&<>@^~_=+\\{}[]"
STOPS = b".,;:"
FEATURES = 20


def statistics(text: str | None) -> list[float]:
    """Counts and shares over the whole text; a null text is an empty one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n, n_words, n_lines = max(len(raw), 1), max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    top = max(counts.values(), default=0)
    in_words = sum(map(len, words))

    def share(of: bytes) -> float:
        return (len(raw) - len(raw.translate(None, of))) / n

    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        in_words / n_words,
        in_words / max(len(counts), 1),
        max(map(len, words), default=0),
        len(counts) / n_words,
        top / n_words,
        len(set(lines)) / n_lines,
        len(words) / n_lines,
        share(UPPER),
        share(LOWER),
        share(DIGITS),
        share(SYMBOLS),
        share(STOPS),
        share(b"!?"),
        share(b"|"),
        share(b"\"'()-"),
        len(zlib.compress(raw, 1)) / n,
        sum(1 for line in lines if line.rstrip()[-1:] in b".!?") / n_lines,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: ``feature`` and ``bound`` by node, ``leaf`` values, and the prior log odds."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        n = len(stats)
        total = np.full(n, self.base)
        if len(self.leaf):
            rows, trees = np.arange(n)[:, None], np.arange(len(self.leaf))[None, :]
            node = np.zeros((n, len(self.leaf)), np.int64)
            for _ in range(int(np.log2(self.leaf.shape[1]))):
                right = stats[rows, self.feature[trees, node]] > self.bound[trees, node]
                node = 2 * node + 1 + right
            total += self.leaf[trees, node - self.feature.shape[1]].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(
    stats: np.ndarray, labels: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0
) -> Trees:
    """Boosts trees on the logistic loss; splits are sought among ``bins`` quantiles of a feature.

    Without rows of both labels the model has no trees and says the smoothed share.
    """
    n, width = stats.shape
    positive = float(labels.sum())
    base = float(np.log((positive + 1) / (n - positive + 1)))
    nodes = 2**depth - 1
    if positive in (0, n):
        return Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, nodes + 1)), base)
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], stats[:, f], side="left") for f in range(width)], axis=1)
    flat = binned + np.arange(width) * bins
    out = np.full(n, base)
    model = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-out))
        grad, hess = labels - p, p * (1 - p)
        feature, bound = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            slots = ((at - first)[:, None] * (width * bins) + flat).ravel()
            g, h = (
                np.bincount(slots, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(axis=2)
                for v in (grad, hess)
            )
            all_g, all_h = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + l2) + (all_g - g) ** 2 / (all_h - h + l2) - all_g**2 / (all_h + l2)
            gain[(h < least) | (all_h - h < least)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for i in range(count):
                f, b = divmod(int(best[i]), bins)
                if gain[i, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + i], bound[first + i] = f, cuts[f][b]
            at = 2 * at + 1 + (stats[np.arange(n), feature[at]] > bound[at])
        leaf_at = at - nodes
        sums = [np.bincount(leaf_at, v, nodes + 1) for v in (grad, hess)]
        leaf = rate * sums[0] / (sums[1] + l2)
        out += leaf[leaf_at]
        for part, value in zip(model, (feature, bound, leaf)):
            part.append(value)
    return Trees(*map(np.array, model), base)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@F.pandas_udf(ArrayType(DoubleType()))
def statistics_of(texts: pd.Series) -> pd.Series:
    return texts.map(statistics)


def train(
    docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> Trees:
    """Trees from the labelled documents that are not held out.

    At most ``max_train`` labels take part, the first by hash of the id. An id with
    several labels counts once, by their majority, a tie as 1; of an id with
    several texts one counts. Labels without an id, a value or a document
    teach nothing.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).alias("label")).dropna().where(~is_held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    rows = in_small_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # at most max_train rows are sent to the tasks, and come back
    rows = rows.join(F.broadcast(known), rows.doc_id == known.id).select("id", "label", statistics_of("text").alias("stats"))
    sample = rows.groupBy("id").agg(F.min("label").alias("label"), F.min("stats").alias("stats")).orderBy("id").toPandas()
    if sample.empty:
        return fit(np.zeros((0, FEATURES)), np.zeros(0))
    return fit(np.array(sample["stats"].tolist()), sample["label"].to_numpy(float))


def score(texts: Column, model: Trees) -> Column:
    """The score of each whole text."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch]).reshape(len(batch), FEATURES)
            parts = [model.scores(stats[i : i + 4096]) for i in range(0, len(batch), 4096)]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    return scored(texts)


def classify(docs: DataFrame, model: Trees, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per document, repeated rows included.

    A null text is scored as an empty one. Other columns are not looked at. An
    empty table gives no rows.
    """
    rows = in_small_batches(docs).select(F.col(doc_id).alias("doc_id"), score(F.col(text), model).alias("score"))
    return rows.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model gives label 1, all columns as they were."""
    (found,) = unused(docs, "score")
    return in_small_batches(docs).withColumn(found, score(F.col(text), model)).where(F.col(found) >= 0.5).drop(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
