"""Approximate nearest neighbours: a vantage-point tree for each shard of the vectors.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of the row, so equal vectors or ids do not meet in one shard, and queries to
parts of about ``QUERY_ROWS`` by a hash of the id. A task holds one shard and one part, however many rows there are: it builds the shard's
tree and searches the queries in blocks. At a node the queries are measured against the vantage point, go to the
nearer half first, and to the other half only where the triangle inequality leaves room. ``factor`` scales that bound: 1 is
an exact search, larger values prune more. The best of all shards are merged by query.

Vectors that are null, zero, or hold null or non-finite components, and rows without id, take no part. Only vectors of the
same length are compared. Repeated candidate rows are candidates each; a repeated query is asked once (its smallest vector). Ties
go to the smaller id. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
LEAF = 64
BLOCK = 256
QUERY_ROWS = 16_384
EDGE = 1e-9  # rounding of distances in a bound


class VantageTree:
    """Median splits by distance from a vantage point; both halves keep the range of their distances."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.random = np.random.default_rng(7)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        vantage = rows[self.random.integers(len(rows))]
        away = np.sqrt(((self.vectors[rows] - self.vectors[vantage]) ** 2).sum(1))
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        sides = []
        for part in (order[:half], order[half:]):
            sides.append((away[part[0]], away[part[-1]], self._build(rows[part])))
        return vantage, sides

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0):
        """Distances and ids of the k nearest of each query, infinity and -1 where there are fewer."""
        self.k, self.factor = k, factor
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), -1, np.int64)
        self.query_ids, self.queries = query_ids, queries
        for a in range(0, len(queries), BLOCK):
            self._visit(self.root, np.arange(a, min(a + BLOCK, len(queries))))
        return self.best, self.found

    def _visit(self, node, active: np.ndarray) -> None:
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, active)
            return
        vantage, sides = node
        away = np.sqrt(((self.queries[active] - self.vectors[vantage]) ** 2).sum(1))
        bounds = [np.maximum(0, np.maximum(low - away, away - high)) for low, high, _ in sides]
        near = bounds[0] <= bounds[1]
        self._visit(sides[0][2], active[near])
        self._visit(sides[1][2], active[~near])
        for side, other in ((0, ~near), (1, near)):
            open_ = bounds[side] * self.factor <= self.best[active, -1] * (1 + EDGE) + EDGE
            self._visit(sides[side][2], active[other & open_])

    def _leaf(self, rows: np.ndarray, active: np.ndarray) -> None:
        away = np.sqrt(((self.queries[active][:, None, :] - self.vectors[rows][None]) ** 2).sum(2))
        away[self.query_ids[active][:, None] == self.ids[rows][None]] = np.inf
        ids = np.broadcast_to(self.ids[rows], away.shape)
        d = np.concatenate((self.best[active], away), 1)
        i = np.concatenate((self.found[active], ids), 1)
        i = np.where(np.isinf(d), -1, i)
        order = np.lexsort((np.where(i < 0, np.iinfo(np.int64).max, i), d), axis=1)[:, : self.k]
        self.best[active] = np.take_along_axis(d, order, 1)
        self.found[active] = np.take_along_axis(i, order, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """Rows with an id and a finite vector that is not zero, as doubles."""
    vector = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def nearest(
    embeddings: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose id is divisible by ``every``."""
    rows = usable(embeddings)
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("dim", F.size("embedding"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "dim").agg(F.min("embedding").alias("embedding"))
    parts = max(1, -(-rows.where(F.col("vec_id") % every == 0).count() // query_rows))
    queries = queries.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def search(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not candidates.num_rows or not wanted.num_rows:
            return schema.empty_table()
        tree = VantageTree(candidates["vec_id"].to_numpy(), _matrix(candidates["embedding"]))
        ids = wanted["vec_id"].to_numpy()
        away, found = tree.search(ids, _matrix(wanted["embedding"]), k, factor)
        keep = found >= 0
        return pa.table([np.repeat(ids, keep.sum(1)), found[keep], away[keep]], schema=schema)

    by = ["shard", "part", "dim"]
    found = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
