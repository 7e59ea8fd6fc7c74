"""Exact top-k by inner product with a paged M-tree.

A further coordinate, the square root of what a vector's squared norm lacks to
the largest one, turns the largest inner product into the smallest Euclidean
distance, so a metric tree can search it. The tree has upper nodes, leaves with
a routing object each, and pages with the entries of a leaf, cut by their
distance to it. Nodes keep covering radii and their distance to their parent.

The nodes, of bounded number, go to every task; the pages, which hold all
vectors, are a table. A query first walks best-first to leaves with enough
entries, which gives it a radius that holds its answer, and then visits every
node that can reach into this radius. Distances to nodes and entries are not
computed where the stored distances to the parent rule them out already.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.operators.scans import running_position
from linewright.session import materialize

#: Entries in a page, and entries a leaf should hold.
PAGE = 256
#: Most leaves; their routing objects are the vectors first in hash order.
MAX_LEAVES = 4096
#: Queries that meet a page together.
BLOCK = 512

VISITS = "leaf int, q_ids array<long>, q_vecs array<binary>, q_limits array<double>"
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(embedding: Column, scale: int = 256) -> Column:
    """Each component x as floor(scale * x); null unless all components are finite numbers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite & (F.size(embedding) > 0), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)))


def _stacked(vectors: list[bytes], width: int) -> np.ndarray:
    """Vectors from their bytes; all have the size of number that the first one has."""
    kind = f"<i{len(vectors[0]) // width}" if len(vectors) else "<i8"
    return np.frombuffer(b"".join(vectors), kind).reshape(-1, width)


def _kind(top: float) -> str:
    """The smallest whole number that holds any component, by the largest squared norm."""
    return next(k for k, most in (("<i2", 2.0**30), ("<i4", 2.0**62), ("<i8", float("inf"))) if top < most)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers, by floating point where that is exact."""
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if largest[0] * largest[1] * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Nodes:
    """The upper part of the tree, with room: distances are in the lifted space."""

    objects: np.ndarray  # routing objects of the leaves
    upper: np.ndarray  # the upper node of each leaf
    upper_object: np.ndarray  # the leaf whose routing object an upper node has
    to_parent: np.ndarray  # distance of each leaf's object to its upper node's
    top: float  # the largest squared norm
    radius: np.ndarray | None = None  # covering radius of each leaf
    inner: np.ndarray | None = None  # distance of its nearest entry
    counts: np.ndarray | None = None
    upper_radius: np.ndarray | None = None

    @classmethod
    def of(cls, objects: np.ndarray, top: float) -> Nodes:
        n = len(objects)
        upper_object = np.arange(int(np.ceil(np.sqrt(n))))
        nodes = cls(objects, np.zeros(n, np.int64), upper_object, np.zeros(n), top)
        distance = nodes.lifted(objects, objects[upper_object])
        nodes.upper = distance.argmin(axis=1)
        nodes.to_parent = distance[np.arange(n), nodes.upper]
        return nodes

    def cover(self, leaf: np.ndarray, radius: np.ndarray, inner: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.objects)
        self.radius, self.inner, self.counts = np.full(n, -1.0), np.zeros(n), np.zeros(n, np.int64)
        self.radius[leaf], self.inner[leaf], self.counts[leaf] = radius, inner, counts
        self.upper_radius = np.full(len(self.upper_object), -1.0)
        filled = self.counts > 0
        np.maximum.at(self.upper_radius, self.upper[filled], (self.to_parent + self.radius)[filled])

    @property
    def slack(self) -> float:
        """More than rounding can add to a distance."""
        return 1e-6 * (1 + np.sqrt(self.top))

    def _norms(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(np.float64) ** 2).sum(axis=1)

    def lifted(self, rows: np.ndarray, objects: np.ndarray) -> np.ndarray:
        """Distances between stored vectors."""
        a, b = self._norms(rows), self._norms(objects)
        lift_a, lift_b = (np.sqrt(np.maximum(self.top - x, 0)) for x in (a, b))
        flat = a[:, None] + b[None, :] - 2.0 * _products(rows, objects)
        return np.sqrt(np.maximum(flat + (lift_a[:, None] - lift_b[None, :]) ** 2, 0))

    def from_query(self, queries: np.ndarray, products: np.ndarray) -> np.ndarray:
        """Distances of queries to stored vectors, by their inner products."""
        return np.sqrt(np.maximum(self._norms(queries)[:, None] + self.top - 2.0 * products, 0))

    def least_score(self, queries: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The inner product that a distance within the limit takes at least, rounding allowed for."""
        squares = np.asarray(limits, np.float64) ** 2
        return (self._norms(queries) + self.top - squares) / 2 - 1 - 1e-6 * self.top

    def walk(self, query: np.ndarray, limit: float, enough: int | None = None) -> list[int]:
        """The leaves that reach into ``limit``, nearest first; with ``enough`` only until they hold as many entries."""
        query = query[None, :]
        heap: list[tuple[float, int, int, float]] = []
        to_upper = self.from_query(query, _products(query, self.objects[self.upper_object]))[0]
        for u, d in enumerate(to_upper):
            if self.upper_radius[u] >= 0 and d - self.upper_radius[u] <= limit:
                heapq.heappush(heap, (max(0.0, d - self.upper_radius[u]), 0, u, d))
        leaves, held = [], 0
        while heap:
            _, is_leaf, node, distance = heapq.heappop(heap)
            if is_leaf:
                leaves.append(node)
                held += self.counts[node]
                if enough is not None and held >= enough:
                    break
                continue
            own = np.flatnonzero((self.upper == node) & (self.counts > 0))
            # the distance to the parent may rule a leaf out without looking at it
            own = own[np.abs(distance - self.to_parent[own]) - self.radius[own] <= limit]
            if len(own):
                d = self.from_query(query, _products(query, self.objects[own]))[0]
                near = np.maximum(np.maximum(d - self.radius[own], self.inner[own] - d), 0)
                for leaf, bound in zip(own[near <= limit], near[near <= limit]):
                    heapq.heappush(heap, (float(bound), 1, int(leaf), 0.0))
        return leaves


def _assigned(items: DataFrame, nodes: Nodes, width: int) -> DataFrame:
    """``(vec_id, leaf, distance, vec)``: each vector at its nearest routing object."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start : start + 2048]
                rows = np.stack(part["v"].to_list()).astype("<i8")
                distance = nodes.lifted(rows, nodes.objects)
                leaf = distance.argmin(axis=1)
                yield pd.DataFrame(
                    {
                        "vec_id": part["vec_id"].to_numpy(),
                        "leaf": leaf.astype(np.int32),
                        "distance": distance[np.arange(len(part)), leaf],
                        "vec": [r.tobytes() for r in rows.astype(_kind(nodes.top))],
                    }
                )

    return items.select("vec_id", "v").mapInPandas(assign, "vec_id long, leaf int, distance double, vec binary")


def _paged(assigned: DataFrame) -> DataFrame:
    """``(leaf, ids, distances, vecs)``, one row per page; a leaf's pages are rings around its object."""
    ranked = running_position(assigned, ["leaf"], "distance", "place", ties=["vec_id"])
    entry = F.struct("vec_id", "distance", "vec")
    pages = ranked.groupBy("leaf", F.expr(f"(place - 1) div {PAGE}").alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return pages.select(
        "leaf",
        F.col("entries.vec_id").alias("ids"),
        F.col("entries.distance").alias("distances"),
        F.col("entries.vec").alias("vecs"),
    )


def _visits(queries: DataFrame, nodes: Nodes, width: int, enough: int | None) -> DataFrame:
    """Which queries meet which leaf, in blocks of queries."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.iloc[start : start + BLOCK]
                rows = _stacked(part["vec"].to_list(), width)
                limits = part["q_limit"].to_numpy() + nodes.slack
                at: dict[int, list[int]] = {}
                for i, (row, limit) in enumerate(zip(rows, limits)):
                    for leaf in nodes.walk(row, limit, enough):
                        at.setdefault(leaf, []).append(i)
                ids, vecs = part["query_id"].to_list(), part["vec"].to_list()
                out = [(leaf, [ids[i] for i in own], [vecs[i] for i in own], [limits[i] for i in own]) for leaf, own in at.items()]
                yield pd.DataFrame(out, columns=["leaf", "q_ids", "q_vecs", "q_limits"])

    return queries.select("query_id", "vec", "q_limit").mapInPandas(walk, VISITS)


def _best_in_pages(visits: DataFrame, pages: DataFrame, nodes: Nodes, width: int, k: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the best ``k`` of each page for each query that visits it."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                queries, entries = _stacked(row.q_vecs, width), _stacked(row.vecs, width)
                q_ids, ids = np.asarray(row.q_ids), np.asarray(row.ids)
                center = nodes.objects[row.leaf : row.leaf + 1]
                to_center = nodes.from_query(queries, _products(queries, center))
                # entries whose distance to the routing object rules them out are not looked at
                open_ = np.abs(to_center - np.asarray(row.distances)[None, :]) <= np.asarray(row.q_limits)[:, None] + nodes.slack
                some_q, some_e = open_.any(axis=1), open_.any(axis=0)
                if not some_q.any():
                    continue
                q_ids, ids = q_ids[some_q], ids[some_e]
                scores = _products(queries[some_q], entries[some_e])
                usable = (q_ids[:, None] != ids[None, :]) & (scores >= nodes.least_score(queries, row.q_limits)[some_q, None])
                # entries are in the order of their ids, so a stable sort settles ties
                order = np.argsort(np.where(usable, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :k]
                picked = np.take_along_axis(usable, order, axis=1)
                yield pd.DataFrame(
                    {
                        "query_id": np.repeat(q_ids, order.shape[1])[picked.ravel()],
                        "vec_id": ids[order][picked],
                        "score": np.take_along_axis(scores, order, axis=1)[picked],
                    }
                )

    # how much the walk makes of its queries cannot be foreseen, so no side may be taken for small
    return visits.join(pages.hint("merge"), "leaf").mapInPandas(visit, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _search(items: DataFrame, queries: DataFrame, width: int, n: int, top: float, k: int) -> DataFrame:
    """The search among vectors of one width."""
    spark = items.sparkSession
    leaves = int(min(MAX_LEAVES, -(-n // PAGE)))
    # at most MAX_LEAVES routing objects
    chosen = items.select("v", F.xxhash64("vec_id", "v").alias("key")).orderBy("key", "v").limit(leaves).toPandas()
    nodes = Nodes.of(np.stack(chosen["v"].to_list()).astype("<i8"), top)
    pages = materialize(_paged(_assigned(items, nodes, width)), "tree-pages")
    cover = pages.groupBy("leaf").agg(
        F.max(F.array_max("distances")).alias("radius"),
        F.min(F.array_min("distances")).alias("inner"),
        F.sum(F.size("ids")).alias("n"),
    )
    cover = cover.toPandas()  # one row per leaf
    nodes.cover(cover["leaf"].to_numpy(), cover["radius"].to_numpy(), cover["inner"].to_numpy(), cover["n"].to_numpy())

    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    asked = queries.select("query_id", F.col("v"), norm.alias("norm"), F.lit(float("inf")).alias("q_limit"))
    asked = materialize(_packed(asked, _kind(top)), "tree-queries")
    first = _best_in_pages(_visits(asked, nodes, width, k + 1), pages, nodes, width, k)
    # the k-th best so far bounds the distance of the answer
    kth = _ranked(first, k).where(F.col("rank") == k).select(F.col("query_id").alias("q"), F.col("score").alias("kth"))
    bound = F.sqrt(F.greatest(F.lit(0.0), F.col("norm") + top - 2 * F.col("kth").cast("double")))
    asked = asked.join(kth, asked.query_id == kth.q, "left")
    asked = asked.withColumn("q_limit", F.when(F.col("kth").isNotNull(), bound).otherwise(F.col("q_limit")))
    asked = materialize(asked.select("query_id", "vec", "q_limit"), "bounded-queries")
    return _ranked(_best_in_pages(_visits(asked, nodes, width, None), pages, nodes, width, k), k)


def _packed(queries: DataFrame, kind: str) -> DataFrame:
    """The vectors as bytes."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["vec"] = [np.asarray(v).astype(kind).tobytes() for v in batch.pop("v")]
            yield batch[["query_id", "vec", "norm", "q_limit"]]

    return queries.mapInPandas(pack, "query_id long, vec binary, norm double, q_limit double")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for rows with ``is_query`` the best other rows, ties to the smaller id.

    ``is_query`` is over a column ``vec_id``. All rows with an id other than the
    query's own take part, repeated rows each. An id that repeats with several
    vectors asks with the smallest one. Rows without an id, and vectors that
    are null, empty, or hold a null or a number that is not finite, take no
    part. Vectors of different widths are never compared. Other columns are not
    looked at. Without queries or others there are no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(F.col(embedding), scale).alias("v"))
    items = materialize(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").withColumn("width", F.size("v")), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    widths = items.groupBy("width").agg(F.count("*").alias("n"), F.max(norm).alias("top")).orderBy("width").collect()
    found = None
    for width, n, top in widths:
        own = items.where(F.col("width") == width)
        queries = own.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
        part = _search(own, queries, width, n, top, k)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.range(0).selectExpr("id AS query_id", "id AS vec_id", "id AS score", "0 AS rank")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
