"""Approximate nearest neighbours by a forest of random-projection trees (operator 6).

Method: each of ``TREES`` trees splits space by random directions at the median of a
sample (at most ``SAMPLE`` rows, taken by a hash of the id; only the split points come
from it).  Every row is indexed: in each tree it falls into one leaf.  A query
descends all trees through one priority queue, ordered by how far the query lies
beyond the split planes on the way (the root of the sum of squared margins), and
takes leaves until they hold ``SEARCHED`` times as many rows as the table, a row
counting once for each tree in which it is met, and ``AT_LEAST`` rows in any case.
The rows in those leaves are ranked by their exact distance in double precision.

Queries and rows meet by leaf.  Leaves are put together to groups of about
``GROUP_ROWS`` rows, and a leaf with more is dealt into several, so no task gathers a
hot leaf; a group gives each of its queries its k nearest only, and these are
merged by query.  The forest and the leaf counts are bounded by the sample, not
by the table.

On vectors without structure (the test tables are nearly uniform on the sphere
in 64 dimensions) only a large share of the rows holds nine tenths of the
neighbours, hence ``SEARCHED``; clustered vectors need far less.

Defined results: rows with a null id, and vectors that are null, empty, zero, of
another length than most, or with null or non-finite components take no part;
equal rows count once, also in the number of rows searched;
equal vectors are ranked by id; rows of one id count as one candidate, the
nearest; a query is never its own neighbour; with few rows all are candidates;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

TREES, SAMPLE, LEAF_ROWS, DEEPEST = 8, 65_536, 96, 10
SEARCHED, AT_LEAST, GROUP_ROWS = 0.9, 4096, 8192


@dataclass
class Forest:
    """Per tree, split directions and points of the inner nodes in heap order (children of k: 2k + 1, 2k + 2)."""

    directions: np.ndarray  # trees x nodes x dimensions
    points: np.ndarray  # trees x nodes
    depth: int

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(self.points), len(vectors)), dtype="int32")
        for t in range(len(self.points)):
            node = np.zeros(len(vectors), dtype="int64")
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", vectors, self.directions[t, node]) > self.points[t, node]
                node = 2 * node + 1 + side
            out[t] = node - len(self.points[t])
        return out

    def search(self, query: np.ndarray, rows: np.ndarray, wanted: float) -> list[tuple[int, int]]:
        """Tree and leaf of the leaves to look into, the most promising first, until they hold ``wanted`` rows."""
        inner = self.points.shape[1]
        margins = self.directions @ query - self.points
        queue = [(0.0, t, 0) for t in range(len(self.points))]
        found: list[tuple[int, int]] = []
        held = 0
        while queue and held < wanted:
            off, t, node = heapq.heappop(queue)
            while node < inner:
                margin = margins[t, node]
                near = 2 * node + 1 + (margin > 0)
                heapq.heappush(queue, (off + margin * margin, t, 4 * node + 3 - near))
                node = near
            if n := rows[t, node - inner]:
                found.append((t, node - inner))
                held += n
        return found


def grow_forest(sample: np.ndarray, *, trees: int = TREES, leaf_rows: int = LEAF_ROWS, deepest: int = DEEPEST, seed: int = 6) -> Forest:
    rng = np.random.default_rng(seed)
    depth = int(np.clip(np.floor(np.log2(max(1, len(sample)) / leaf_rows)), 0, deepest))
    inner, width = (1 << depth) - 1, sample.shape[1]
    directions = rng.normal(size=(trees, inner, width))
    directions /= np.maximum(np.linalg.norm(directions, axis=2, keepdims=True), 1e-12)
    points = np.zeros((trees, inner))
    for t in range(trees):
        node = np.zeros(len(sample), dtype="int64")
        for level in range(depth):
            seen = np.einsum("ij,ij->i", sample, directions[t, node])
            for k in range((1 << level) - 1, (2 << level) - 1):
                here = seen[node == k]
                points[t, k] = np.median(here) if len(here) else 0.0
            node = 2 * node + 1 + (seen > points[t, node])
    return Forest(directions, points, depth)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def _stacked(octets: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(octets), dtype="float64").reshape(-1, width)


def _octets(vectors: pa.Array) -> pa.Array:
    return pa.array([row.tobytes() for row in _matrix(vectors)], pa.binary())


def _nearest(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties to smaller ids."""
    if len(scores) > k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], scores[near]))][:k]


def nearest_neighbours(table: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10,
                       trees: int = TREES, sample: int = SAMPLE, searched: float = SEARCHED, at_least: int = AT_LEAST,
                       group_rows: int = GROUP_ROWS, seed: int = 6) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (Euclidean distance) of the k nearest rows found for each query row."""
    vectors = (table.withColumn("asks", F.coalesce(is_query, F.lit(False)))
               .select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), "asks")
               .where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))))
    result = "query_id bigint, vec_id bigint, score double"
    widths = vectors.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").limit(1).collect()
    if not widths:
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, total = widths[0]
    # Equal rows are one; a query that asks in any of them asks.
    vectors = vectors.where(F.size("vector") == width).groupBy("vec_id", "vector").agg(F.max("asks").alias("asks"))
    every = -(-total // sample)
    taken = vectors.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(every)) == 0).select("vector").toArrow()
    forest = grow_forest(_matrix(taken["vector"].combine_chunks()) if taken.num_rows else np.zeros((0, width)), trees=trees, seed=seed)
    shared = table.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.leaves(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), _octets(batch.column(1)), batch.column(2), pa.array(list(found.T), pa.list_(pa.int32()))],
                                                 names=["vec_id", "vector", "asks", "leaves"])

    placed = keep(vectors.mapInArrow(place, "vec_id bigint, vector binary, asks boolean, leaves array<int>"))
    # As many counts as the forest has leaves, whatever the table.
    counts = placed.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()
    rows = np.zeros((trees, forest.points.shape[1] + 1), dtype="int64")
    rows[counts["tree"].to_numpy(), counts["leaf"].to_numpy()] = counts["n"].to_numpy()
    # Leaves in a row make a group until it is full; a leaf that is too large has groups of its own.
    parts = np.maximum(1, -(-rows // group_rows))
    first, room, at = np.zeros_like(rows), 0, -1
    for t in range(trees):
        for leaf in range(rows.shape[1]):
            if parts[t, leaf] > 1 or rows[t, leaf] > room or leaf == 0:
                at, room = at + 1, group_rows
            first[t, leaf] = at
            if parts[t, leaf] > 1:
                at, room = at + int(parts[t, leaf]) - 1, 0
            else:
                room -= int(rows[t, leaf])
    wanted = max(searched * int(rows[0].sum()), at_least)
    plan = table.sparkSession.sparkContext.broadcast((first, parts, rows))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, _ = plan.value
        for batch in batches:
            if batch.num_rows:
                leaves = np.array(batch.column(3).to_pylist())
                # By id and vector: neither one id nor one vector with many rows gathers in one group.
                deal = np.array([crc32(v, i & 0xFFFFFFFF) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())], dtype="int64")
                for t in range(leaves.shape[1]):
                    leaf = leaves[:, t]
                    group = first[t, leaf] + deal % parts[t, leaf]
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(leaf + t * first.shape[1], pa.int64()), batch.column(0), batch.column(1)],
                                                     names=["block", "leaf", "vec_id", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, rows = plan.value
        for batch in batches:
            if batch.num_rows:
                block, leaf, who = [], [], []
                for n, vector in enumerate(_stacked(batch.column(1).to_pylist(), width)):
                    for t, k_leaf in shared.value.search(vector, rows, wanted):
                        for part in range(int(parts[t, k_leaf])):
                            block.append(int(first[t, k_leaf]) + part)
                            leaf.append(k_leaf + t * first.shape[1])
                            who.append(n)
                # One row for each group, with the leaves of the group that the query looks into.
                asked = pd.DataFrame({"block": block, "who": who, "leaf": leaf}).groupby(["who", "block"], sort=False)["leaf"].agg(list).reset_index()
                chosen = pa.array(asked["who"], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(asked["block"], pa.int64()), pa.array(asked["leaf"], pa.list_(pa.int64())),
                                                  batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["block", "leaves", "query_id", "query"])

    def rank(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, leaf, data = held["vec_id"].to_numpy(), held["leaf"].to_numpy(), _stacked(held["vector"], width)
        places = {x: np.flatnonzero(leaf == x) for x in np.unique(leaf)}
        names, named = np.unique(ids, return_inverse=True)
        squares, out = np.einsum("ij,ij->i", data, data), []
        for a in range(0, len(asked), 256):
            some = asked.iloc[a:a + 256]
            queries = _stacked(some["query"], width)
            rough = squares[:, None] - 2 * (data @ queries.T)
            for n, (query_id, leaves, query) in enumerate(zip(some["query_id"], some["leaves"], queries)):
                here = np.concatenate([places.get(x, np.empty(0, "int64")) for x in leaves])
                here = here[ids[here] != query_id]
                if len(here) > k:
                    # The product only screens: all that could be among the k nearest despite its rounding are measured.
                    value = rough[here, n]
                    slack = 1e-9 * (1 + float(query @ query) + squares[here].max())
                    each = value
                    if len(names) < len(ids):
                        each = np.full(len(names), np.inf)
                        np.minimum.at(each, named[here], value)
                    if len(each) > k:
                        here = here[value <= np.partition(each, k - 1)[k - 1] + slack]
                scores = np.sqrt(((data[here] - query) ** 2).sum(axis=1))
                if len(names) < len(ids):
                    # The nearest row of each id, before the k nearest are taken.
                    order = np.argsort(scores, kind="stable")
                    order = order[np.unique(ids[here][order], return_index=True)[1]]
                    here, scores = here[order], scores[order]
                best = _nearest(ids[here], scores, k)
                out.append((np.full(len(best), query_id), ids[here][best], scores[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    asked = placed.where("asks").select("vec_id", "vector").mapInArrow(ask, "block bigint, leaves array<bigint>, query_id bigint, query binary")
    held = placed.mapInArrow(spread, "block bigint, leaf bigint, vec_id bigint, vector binary")
    near = asked.groupBy("block").cogroup(held.groupBy("block")).applyInPandas(rank, result)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
