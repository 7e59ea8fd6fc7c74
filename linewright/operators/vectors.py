"""Exact nearest neighbours by cosine, without comparing every pair.

Vectors are grouped around a few pivots. For each query the pivots give, from
angles alone, a bound on the k-th best match and the groups that can still
hold one; only those groups are compared. Near groups share slices of bounded
size, and each query leaves a slice with its k best there, so what is compared
and passed on does not grow with the number of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.session import materialize, small_batches

MOST_PIVOTS = 1024
#: Items of a slice, at most so many and so many bytes, and queries that meet a slice at once.
SLICE_ROWS, SLICE_BYTES, QUERY_ROWS = 65_536, 32 << 20, 4096
#: Scores that are held at once.
SCORES = 1 << 22


def _matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.asarray(flat.flatten(), np.float64).reshape(len(vectors), -1)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _is_usable(vector: str) -> Column:
    ok = F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0)
    return F.coalesce(ok & ~F.exists(vector, lambda v: v.isNull() | F.isnan(v)), F.lit(False))


def usable(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector has no nulls and a length above zero."""
    return df.filter(_is_usable(vector))


def rejected(df: DataFrame, vector: str = "vector", width: int | None = None) -> DataFrame:
    """Rows whose vector no search can use, or that have another width than the wanted one."""
    wrong = ~_is_usable(vector)
    return df.filter(wrong if width is None else wrong | (F.size(vector) != width))


def nearest(queries: DataFrame, items: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """``(query_id, product_id, sem_score, sem_rank)``: the ``k`` best items per query.

    ``queries`` is ``(query_id, vector)``, ``items`` is ``(product_id, vector)``.
    A query meets the items of its own width; :func:`rejected` lists what takes
    no part. Scores are rounded to 1e-9 and equal scores rank by ``product_id``.
    ``block_rows`` sets the rows of a block on both sides.
    """
    items = usable(items.select("product_id", "vector"))
    queries = usable(queries.select("query_id", "vector"))
    asked = queries.select(F.size("vector").alias("width")).distinct()
    widths = items.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n")).join(asked, "width").orderBy("width")
    found = None
    for width, n in widths.collect():
        same = [df.filter(F.size("vector") == width) for df in (queries, items)]
        part = _nearest(*same, n, k, block_rows)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return queries.join(items, F.lit(False)).select(
            "query_id", "product_id", F.lit(0.0).alias("sem_score"), F.lit(0).alias("sem_rank")
        )
    return found


def _slices(counts: np.ndarray, pivots: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first slice and how many it has; a slice holds about ``rows`` items.

    Small cells share a slice, near ones first, and a large cell has several, so
    that neither many small lists nor a large group is left.
    """
    lead = pivots[: max(1, int(len(pivots) ** 0.5))]
    order = np.lexsort((np.arange(len(pivots)), _angles(pivots, lead).argmin(axis=1)))
    first, parts = np.zeros(len(pivots), np.int64), np.maximum(1, -(-counts // rows))
    at, held = 0, 0
    for cell in order:
        if held and held + counts[cell] > rows:
            at, held = at + 1, 0
        first[cell] = at
        held += counts[cell]
        if parts[cell] > 1:
            at, held = at + parts[cell], 0
    return first, parts


def _nearest(queries: DataFrame, items: DataFrame, n: int, k: int, block_rows: int | None) -> DataFrame:
    """The search among vectors of one width."""
    scored = _scored(queries, items, n, k, block_rows)
    best = Window.partitionBy("query_id").orderBy(F.desc("sem_score"), "product_id")
    return scored.withColumn("sem_rank", F.row_number().over(best)).filter(F.col("sem_rank") <= k)


def _scored(queries: DataFrame, items: DataFrame, n: int, k: int, block_rows: int | None) -> DataFrame:
    """``(query_id, product_id, sem_score)``: for each query the ``k`` best of each slice that may hold one of its best."""
    single = F.col("vector").cast("array<float>").alias("vector")
    items, queries = small_batches(items).select("product_id", single), queries.select("query_id", single)
    # as many cells as items in a cell, up to a bound
    wanted = min(MOST_PIVOTS, max(16, int(n**0.5)))
    chosen = items.orderBy(F.xxhash64("product_id"), "product_id").limit(wanted).collect()
    pivots = _unit(np.asarray([row.vector for row in chosen], np.float64))
    slice_rows = block_rows or max(1, min(SLICE_ROWS, SLICE_BYTES // (8 * pivots.shape[1])))

    def assign(batches):
        for batch in batches:
            angles = _angles(_unit(_matrix(batch["vector"])), pivots)
            near = angles.argmin(axis=1)
            columns = [pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(near)), near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "cell", "angle"])

    item_type = items.schema["product_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    placed = materialize(
        items.mapInArrow(assign, f"product_id {item_type}, vector array<float>, cell int, angle double"),
        "vectors",
    )
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("reach")).collect()
    radius = np.full(len(pivots), -np.inf)
    counts = np.zeros(len(pivots), dtype=np.int64)
    for row in cells:
        radius[row.cell], counts[row.cell] = row.reach, row.n
    first, parts = _slices(counts, pivots, slice_rows)
    query_parts = max(1, -(-queries.count() // (block_rows or QUERY_ROWS)))

    def probe(batches):
        live = np.flatnonzero(counts)
        slack = 1e-7  # keeps rounding from hiding a cell
        in_slice = [(s, (first[live] <= s) & (s < first[live] + parts[live])) for s in range(int((first + parts).max()))]
        for batch in batches:
            angles = _angles(_unit(_matrix(batch["vector"])), pivots)[:, live]
            worst = np.minimum(angles + radius[live], np.pi)
            best = np.maximum(angles - radius[live], 0.0)
            order = worst.argsort(axis=1)
            filled = counts[live][order].cumsum(axis=1) >= k
            at = np.where(filled.any(axis=1), filled.argmax(axis=1), len(live) - 1)
            bound = worst[np.arange(len(angles)), order[np.arange(len(angles)), at]]
            bound = np.where(filled.any(axis=1), bound, np.pi)
            needed = best <= bound[:, None] + slack
            # a slice at a time, so that no more rows leave at once than came in
            for s, held in in_slice:
                asked = pa.array(np.flatnonzero(needed[:, held].any(axis=1)))
                if len(asked):
                    found = [column.take(asked) for column in batch.columns]
                    yield pa.RecordBatch.from_arrays([*found, pa.array(np.full(len(asked), s, np.int32))], [*batch.schema.names, "slice"])

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "product_id", "sem_score"]
        found = [left["query_id"].type, right["product_id"].type, pa.float64()]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in found], names)
        # by id, so that places among equal scores are those of the ids
        right = right.take(pc.sort_indices(right, sort_keys=[("product_id", "ascending")], null_placement="at_start"))
        a, b = _unit(_matrix(left["vector"])), _unit(_matrix(right["vector"])).T
        asked, held, scores = [], [], []
        step = max(1, SCORES // right.num_rows)
        for start in range(0, len(a), step):
            for at, row in enumerate(np.round(a[start : start + step] @ b, 9) + 0.0, start):
                # only what reaches the k-th best is put in order
                top = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                top = top[np.argsort(-row[top], kind="stable")[:k]]
                asked.append(np.full(len(top), at))
                held.append(top)
                scores.append(row[top])
        ids = left["query_id"].take(pa.array(np.concatenate(asked))), right["product_id"].take(pa.array(np.concatenate(held)))
        return pa.Table.from_arrays([*ids, pa.array(np.concatenate(scores))], names)

    of_cell = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("cell") + 1)
    left = queries.mapInArrow(probe, f"query_id {query_type}, vector array<float>, slice int").withColumn(
        "query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int")
    )
    part = F.pmod(F.xxhash64("product_id"), of_cell(parts)).cast("int")
    right = placed.select("product_id", "vector", (of_cell(first) + part).alias("slice")).withColumn(
        "query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))
    )
    keys = ["slice", "query_part"]
    schema = f"query_id {query_type}, product_id {item_type}, sem_score double"
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, schema)
