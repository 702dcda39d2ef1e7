"""Exact nearest neighbours between two large vector tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

# Distances are computed in doubles; bounds are widened by this much so that
# rounding never prunes a true neighbour.
SLACK = 1e-6
#: Pivots: the root of the number of documents within these bounds. They are
#: the only vectors that the driver and every task hold.
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192


def _points(column, rows: int, metric: str) -> np.ndarray:
    """Vectors in the space where Euclidean order equals the metric's order."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    if metric == "cosine":
        length = np.linalg.norm(values, axis=1, keepdims=True)
        return np.divide(values, length, out=np.zeros_like(values), where=length > 0)
    return values


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    center = b.mean(axis=0)
    a, b = a - center, b - center
    square = (a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


class PivotTree:
    """Pivots below a coarser set of pivots; the cell of a vector is found in two steps.

    A vector's cell need not be that of its nearest pivot: bounds come from
    the distances to the pivot it was given.
    """

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.tops = pivots[: max(1, math.isqrt(len(pivots)))]
        above = _distances(pivots, self.tops).argmin(1)
        self.below = [np.flatnonzero(above == t) for t in range(len(self.tops))]

    def cells(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot of every point."""
        filled = [t for t, b in enumerate(self.below) if len(b)]
        top = _distances(points, self.tops[filled]).argmin(1)
        cell, far = np.zeros(len(points), np.int32), np.zeros(len(points))
        for place in np.unique(top):
            rows, choice = np.flatnonzero(top == place), self.below[filled[place]]
            gaps = _distances(points[rows], self.pivots[choice])
            near = gaps.argmin(1)
            cell[rows], far[rows] = choice[near], gaps[np.arange(len(rows)), near]
        return cell, far


def assign_cells(table: DataFrame, key: str, tree: PivotTree, metric: str) -> DataFrame:
    """``(key, embedding, cell, far)``: the cell and the distance to its pivot."""

    def assign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell, far = tree.cells(_points(batch.column(1), batch.num_rows, metric))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell), pa.array(far)], names=[key, "embedding", "cell", "far"]
            )

    kind = table.schema["embedding"].dataType.simpleString()
    return table.select(F.col(key).cast("long"), "embedding").mapInArrow(
        assign, f"{key} long, embedding {kind}, cell int, far double"
    )


def _packed(table: DataFrame, key: str, block_rows: int) -> DataFrame:
    """``cell, block, blocks, rows``: the rows of a cell in blocks of about ``block_rows``.

    The number of blocks per cell follows from its count, and rows fall into
    blocks by a hash of their key, so the size of a block does not depend on
    how many rows a cell holds.
    """
    sizes = table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    return (
        table.join(F.broadcast(sizes), "cell")  # one row per pivot
        .withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
        .groupBy("cell", "block", "blocks")
        .agg(F.collect_list(F.struct(key, "embedding")).alias("rows"))
    )


def _block(rows: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the i-th block, as flat arrays."""
    ids, vectors = rows[i].values.flatten()
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids.to_numpy(zero_copy_only=False), values.reshape(len(ids), -1)


def _block_scores(pairs: DataFrame, k: int, metric: str) -> DataFrame:
    """Best k per question of each (documents, questions) pair of blocks."""
    from .retrieval import _block_topk

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                (d_ids, d), (q_ids, q) = _block(batch.column("docs"), i), _block(batch.column("asks"), i)
                slot, ids, best = _block_topk(d_ids, d, q, k, metric)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[slot], pa.int64()), pa.array(ids, pa.int64()), pa.array(best, pa.float64())],
                    names=["query_id", "doc_id", "score"],
                )

    return pairs.select("docs", "asks").mapInArrow(score, "query_id long, doc_id long, score double")


def pruned_topk(
    queries: DataFrame, docs: DataFrame, k: int, metric: str, pivots: int | None, block_rows: int
) -> DataFrame:
    from .retrieval import ranked, whole_vectors

    if metric not in ("cosine", "l2"):
        raise ValueError("cells need a distance: use cosine or l2")
    queries, docs = whole_vectors(queries, "query_id"), whole_vectors(docs, "doc_id")
    asked = {r["dim"] for r in queries.select("dim").distinct().collect()}  # one row per dimension
    sizes = {r["dim"]: r["count"] for r in docs.groupBy("dim").count().collect() if r["dim"] in asked}
    parts = []
    for dim, n in sorted(sizes.items()):
        wanted = pivots or min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(n)))
        of_dim = lambda table: table.filter(F.col("dim") == dim)  # noqa: E731, B023
        parts.append(_nearest_in_cells(of_dim(queries), of_dim(docs), n, k, metric, wanted, block_rows))
    if not parts:
        return ranked(docs.sparkSession.createDataFrame([], "query_id long, doc_id long, score double"), k)
    return ranked(reduce(DataFrame.unionByName, parts), k)


def _nearest_in_cells(
    queries: DataFrame, docs: DataFrame, n_docs: int, k: int, metric: str, pivots: int, block_rows: int
) -> DataFrame:
    """``query_id, doc_id, score``: the best k of every question, and others, for vectors of one dimension."""
    from .retrieval import ranked

    # vectors chosen by hash; their quality affects speed only. About twice as
    # many as wanted are sorted, however many rows there are.
    share = F.lit(min(1.0, 2.0 * pivots / n_docs) * 2.0**63).cast("double")
    near = docs.select("doc_id", "embedding", F.xxhash64("doc_id").alias("h"))
    near = near.filter(F.abs(F.col("h").cast("double")) <= share)
    chosen = near.orderBy("h", "doc_id").limit(pivots).select("doc_id", "embedding").toArrow()
    if chosen.num_rows == 0:
        chosen = docs.select("doc_id", "embedding").limit(1).toArrow()
    tree = PivotTree(_points(chosen["embedding"], chosen.num_rows, metric))

    corpus = cut_lineage(assign_cells(docs, "doc_id", tree, metric), "vector-cells")
    blocks = cut_lineage(_packed(corpus, "doc_id", block_rows).withColumnRenamed("rows", "docs"), "vector-blocks")
    # one row per pivot
    cells = corpus.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).orderBy("cell").collect()
    numbers = np.array([r["cell"] for r in cells], dtype=np.int64)
    radius, count = np.array([r["radius"] for r in cells]), np.array([r["n"] for r in cells])
    used = tree.pivots[numbers]

    def route(batches):
        """A distance within which each question has k documents for sure, and
        the cells that reach into it, nearest first."""
        for batch in batches:
            if batch.num_rows == 0:
                continue
            gaps = _distances(_points(batch.column(1), batch.num_rows, metric), used)
            upper, lower = gaps + radius[None, :], gaps - radius[None, :]
            order = np.argsort(upper, axis=1)
            reached = np.cumsum(count[order], axis=1) >= k
            at = np.where(reached.any(1), reached.argmax(1), order.shape[1] - 1)
            row = np.arange(len(at))
            bound = np.where(reached.any(1), upper[row, order[row, at]], np.inf) + SLACK
            inside = [np.flatnonzero(x <= b) for x, b in zip(lower, bound)]
            inside = [c[np.argsort(lower[i, c], kind="stable")] for i, c in enumerate(inside)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bound),
                 pa.array([numbers[c].tolist() for c in inside], pa.list_(pa.int32())),
                 pa.array([lower[i, c].tolist() for i, c in enumerate(inside)], pa.list_(pa.float64()))],
                names=["query_id", "embedding", "bound", "cells", "lower"],
            )

    kind = queries.schema["embedding"].dataType.simpleString()
    routed = cut_lineage(
        queries.select("query_id", "embedding").mapInArrow(
            route, f"query_id long, embedding {kind}, bound double, cells array<int>, lower array<double>"
        ),
        "vector-routes",
    )

    def search(asks: DataFrame) -> DataFrame:
        """Blocks of questions meet the blocks of documents of their cell, every pair under a key of its own."""
        per_cell = blocks.groupBy("cell").agg(F.first("blocks").alias("n"))
        packed = _packed(asks, "query_id", block_rows).select("cell", F.col("rows").alias("asks"))
        dealt = packed.join(F.broadcast(per_cell), "cell").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        )
        return _block_scores(blocks.join(dealt, ["cell", "block"]), k, metric)

    first = routed.select("query_id", "embedding", F.get("cells", F.lit(0)).alias("cell"))
    tried = cut_lineage(ranked(search(first), k), "vector-first")

    # the k-th distance found so far tightens the bound
    worst = tried.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("_found"), F.min("score").alias("_kth")
    )
    as_distance = (
        F.sqrt(F.greatest(F.lit(2.0) - F.lit(2.0) * F.col("_kth"), F.lit(0.0)))
        if metric == "cosine"
        else F.sqrt(F.greatest(-F.col("_kth"), F.lit(0.0)))
    )
    # scores are rounded to six digits; the margin covers that in distance
    margin = F.lit(2e-3)
    limit = F.when(
        F.col("_found") >= k, F.least(F.col("bound"), as_distance + margin)
    ).otherwise(F.col("bound"))
    rest = (
        routed.join(worst, "query_id", "left")
        .withColumn("_limit", limit)
        .select("query_id", "embedding", "_limit", "lower", F.posexplode("cells").alias("_at", "cell"))
        .filter((F.col("_at") > 0) & (F.get("lower", F.col("_at")) <= F.col("_limit")))
        .select("query_id", "embedding", "cell")
    )
    return tried.select("query_id", "doc_id", "score").unionByName(search(rest))
