"""Language identification by nearest centroid.

A text becomes a unit vector of TF-IDF weights of its byte n-grams, hashed to a
fixed width. Each language has a few centroids, found by spherical k-means
among its documents; the nearest centroid by cosine names the language, and a
text farther from it than the language's own documents are is marked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from linewright.llm.batches import in_small_batches
from linewright.session import materialize

#: Most documents that a model learns from, dealt evenly to the languages.
MAX_TRAIN = 3_000
#: Documents with this remainder of crc32(doc_id) by FOLDS are held out.
FOLDS, HELD_OUT = 4, 2
WIDTH = 4096
CENTROIDS = 3
#: A cluster with a smaller share of its language is dropped.
LEAST_CLUSTER = 0.1
#: A language's limit is this quantile of its own distances, and half as much again.
REJECT_QUANTILE, REJECT_SLACK = 0.95, 1.5
UNDETERMINED = "und"

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def grams(text: str | None) -> np.ndarray:
    """Damped counts of the 2- and 3-grams of a whole text, by bucket.

    Case, digits and punctuation are left out; each word keeps its borders.
    """
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    codes = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(WIDTH, np.int64)
    if words:
        pairs = codes[:-1] << 8 | codes[1:]
        triples = pairs[:-1] << 8 | codes[2:]
        for ids in (pairs, triples | 1 << 24):
            counts += np.bincount((ids * np.uint32(2654435761)) >> np.uint32(20), minlength=WIDTH)
    return np.log1p(counts).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray
    lang: list[str]
    limit: np.ndarray

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the nearest centroid of each row of gram counts, and the cosine."""
        cosine = _unit(rows * self.idf) @ self.centers.T
        best = cosine.argmax(axis=1)
        return best, np.clip(cosine[np.arange(len(rows)), best], 0, 1)


def _spherical_means(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Up to ``k`` unit centroids, started at rows spread evenly by closeness to the mean.

    A cluster with few of the rows is dropped: it is noise in the labels or a
    stray text rather than a way of writing the language.
    """
    by_closeness = np.argsort(rows @ rows.mean(axis=0), kind="stable")
    centers = rows[by_closeness[[(2 * i + 1) * len(rows) // (2 * k) for i in range(k)]]]
    for _ in range(rounds):
        sizes = np.bincount((rows @ centers.T).argmax(axis=1), minlength=len(centers))
        centers = centers[(sizes >= LEAST_CLUSTER * len(rows)) | (sizes == sizes.max())]
        own = (rows @ centers.T).argmax(axis=1)
        centers = _unit(np.stack([rows[own == i].mean(axis=0) for i in range(len(centers)) if (own == i).any()]))
    return centers


def fit(counts: np.ndarray, langs: np.ndarray, k: int = CENTROIDS) -> Centroids:
    """Without rows there are no centroids, and every text is undetermined."""
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    rows = _unit(counts * idf)
    centers, names, limits = [], [], []
    for lang in sorted(set(langs)):
        own = rows[langs == lang]
        found = _spherical_means(own, k)
        distance = 1 - (own @ found.T).max(axis=1)
        centers.append(found)
        names += [lang] * len(found)
        limits += [float(np.quantile(distance, REJECT_QUANTILE)) * REJECT_SLACK] * len(found)
    return Centroids(idf, np.vstack(centers) if centers else np.zeros((0, WIDTH), np.float32), names, np.array(limits))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


@F.pandas_udf(BinaryType())
def grams_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: grams(t).tobytes())


def train(
    docs: DataFrame, max_train: int = MAX_TRAIN, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> Centroids:
    """Centroids from documents with a language that are not held out.

    Each language gives as many documents, the first by hash of id and text, so
    that at most ``max_train`` (or one per language) take part. Texts without
    a letter teach nothing.
    """
    rows = in_small_batches(docs).select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").where(~is_held_out(F.col("id")))
    named = rows.select("lang", F.xxhash64("id", "text").alias("key"))
    sizes = materialize(named.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    share = max(1, max_train // max(sizes.count(), 1))
    # keys are spread evenly, so few beyond the first of a language go on to be ranked
    low = named.join(sizes, "lang").where((F.col("key") / 2.0**64 + 0.5) * F.col("n") <= 1.2 * share + 100)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = low.select("lang", "key").distinct().withColumn("place", place).where(F.col("place") <= share).select("lang", "key")
    rows = rows.withColumn("key", F.xxhash64("id", "text")).join(F.broadcast(chosen), ["lang", "key"])
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "key", grams_of("text").alias("grams"))
    sample = rows.groupBy("lang", "key").agg(F.min("grams").alias("grams")).orderBy("lang", "key").toPandas()
    counts = np.array([np.frombuffer(g, np.float32) for g in sample["grams"]]).reshape(len(sample), WIDTH)
    return fit(counts, sample["lang"].to_numpy())


def classify(docs: DataFrame, model: Centroids, doc_id: str = "doc_id", text: str = "text", reject: bool = False) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, one row per document, repeated rows included.

    ``score`` is the cosine to the nearest centroid. A null text, or one without
    a letter, is undetermined with score 0. ``rejected`` texts lie beyond the
    limit of their language; with ``reject`` they are undetermined too. Other
    columns are not looked at. An empty table gives no rows.
    """

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": UNDETERMINED, "score": 0.0, "rejected": False})
            texts = batch["text"].tolist()
            asked = [i for i, t in enumerate(texts) if has_letter(t)] if model.lang else []
            langs, scores, rejected = out["lang_pred"].to_numpy(object).copy(), np.zeros(len(out)), np.zeros(len(out), bool)
            for start in range(0, len(asked), 512):
                part = asked[start : start + 512]
                best, cosine = model.nearest(np.stack([grams(texts[i]) for i in part]))
                langs[part] = [model.lang[b] for b in best]
                scores[part] = cosine
                rejected[part] = 1 - cosine > model.limit[best]
            out["lang_pred"], out["score"], out["rejected"] = langs, scores, rejected
            yield out

    rows = in_small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = rows.mapInPandas(predict, "doc_id long, lang_pred string, score double, rejected boolean")
    lang = F.when(F.col("rejected") & F.lit(reject), F.lit(UNDETERMINED)).otherwise(F.col("lang_pred"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), lang.alias("lang_pred"), "score", "rejected")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs))
