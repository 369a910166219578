"""Nearest neighbours by largest inner product: vantage-point trees per shard.

Inner products become Euclidean distances: a vector x gets the extra coordinate sqrt(M^2 - |x|^2), M the largest norm of
its shard, and a query the coordinate 0; then d^2 = |q|^2 + M^2 - 2 <q, x>. A node keeps the range of distances from
its vantage point to each child; by the triangle inequality a child whose range is off by `bound` holds nothing nearer
than that. A child is pruned when bound * factor exceeds the distance of the worst neighbour still wanted: factor 1 is
exact search, larger factors prune more.

Scale: rows are dealt to shards by a hash of their id, so a vector that a third of the rows share is spread; within a
shard equal vectors are one point with several ids. A task reads its shard's rows, builds the tree, and then streams the
queries past it in batches: memory is one shard and one batch, both bounded in bytes whatever the number of components. Each shard returns its best k for a query, and a window
keeps the best of those. No row is sampled away: every valid row is in a tree.

Edge cases: null or empty vectors, those that hold a null, NaN or infinity, and zero vectors take no part, nor do null
ids; vectors of another length are never compared; rows with the query's own id are no candidates; an id that is
repeated with the same vector counts once; with different vectors each is a candidate, so that the id may come twice, and
the smallest one is the query; ties go to the smaller id; fewer than k candidates give as many rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

NEIGHBOURS, FACTOR = 20, 2.0
#: Rows of a shard at the most, and at the least where SHARDS tasks can share the rows; points of a leaf.
SHARD_ROWS, LEAST_ROWS, SHARDS, LEAF_POINTS = 1 << 16, 1 << 11, 16, 64
#: Bytes of a shard's vectors at the most, of which a task holds a few copies, and of one batch of queries.
SHARD_BYTES, QUERY_BYTES = 32 << 20, 1 << 20


class Tree:
    """A vantage-point tree over distinct points, searched by many queries at once."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, k: int, factor: float, leaf: int = LEAF_POINTS):
        self.k, self.factor, self.leaf = k, factor, leaf
        self.points, group = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, group.reshape(-1)))
        self.ids, group = ids[order], group.reshape(-1)[order]
        first = np.concatenate([[True], (np.diff(self.ids) != 0) | (np.diff(group) != 0)])  # a repeated row counts once
        self.ids, group = self.ids[first], group[first]
        self.begin = np.searchsorted(group, np.arange(len(self.points) + 1))
        self.least = self.ids[self.begin[:-1]]
        norms = (self.points**2).sum(axis=1)
        self.m2 = float(norms.max())
        self.lifted = np.concatenate([self.points, np.sqrt(np.maximum(self.m2 - norms, 0))[:, None]], axis=1)
        self.rng = np.random.default_rng(5)
        self.leaves = 0
        self.root = self._node(np.arange(len(self.points)))

    def _node(self, at: np.ndarray):
        if len(at) <= self.leaf:
            self.leaves += 1
            return at, self.leaves
        vantage = self.lifted[at[self.rng.integers(len(at))]]
        d = np.sqrt(((self.lifted[at] - vantage) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        half = len(at) // 2
        near, far = order[:half], order[half:]
        return vantage, (d[near[0]], d[near[-1]]), (d[far[0]], d[far[-1]]), self._node(at[near]), self._node(at[far])

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the best k + 1 points of each query, -1 where there are fewer."""
        self.q, self.q2 = queries, (queries**2).sum(axis=1)
        self.best = np.full((len(queries), self.k + 1), -1)
        self.score = np.full((len(queries), self.k + 1), -np.inf)
        self.lifted_q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        self.home = np.zeros(len(queries), np.int64)
        self._descend(self.root, np.arange(len(queries)))
        self._visit(self.root, np.arange(len(queries)))
        return self.best, self.score

    def _radius(self, who: np.ndarray) -> np.ndarray:
        """Distance of the worst neighbour still wanted, infinite while neighbours are lacking. A squared distance is a sum
        of as many rounded products as there are coordinates, so it is off by that many roundings of q2 + m2."""
        both = self.q2[who] + self.m2
        return np.sqrt(np.maximum(both - 2 * self.score[who, -1], 0) + 4 * self.lifted.shape[1] * np.finfo(float).eps * both)

    def _distance(self, node, who: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.lifted_q[who] - node[0]) ** 2).sum(axis=1))

    def _descend(self, node, who: np.ndarray) -> None:
        """Each query scans the leaf that is nearest on every level, so that the visits begin with a radius."""
        if len(node) == 2:
            self.home[who] = node[1]
            self._scan(node[0], who)
        elif len(who):
            near_first = self._distance(node, who) <= (node[1][1] + node[2][0]) / 2
            self._descend(node[3], who[near_first])
            self._descend(node[4], who[~near_first])

    def _visit(self, node, who: np.ndarray) -> None:
        if len(node) == 2:
            self._scan(node[0], who[self.home[who] != node[1]])
        elif len(who):
            d = self._distance(node, who)
            order = ((1, 3), (2, 4)) if (d <= (node[1][1] + node[2][0]) / 2).mean() >= 0.5 else ((2, 4), (1, 3))
            for limits, child in order:  # the side that most queries are on comes first and narrows their radius
                low, high = node[limits]
                bound = np.maximum(np.maximum(low - d, d - high), 0) * self.factor
                self._visit(node[child], who[bound <= self._radius(who)])

    def _scan(self, at: np.ndarray, who: np.ndarray) -> None:
        if not len(who):
            return
        scores = self.q[who] @ self.points[at].T
        better = scores.max(axis=1) >= self.score[who, -1]  # a tie may have the smaller id
        who = who[better]
        scores = np.concatenate([self.score[who], scores[better]], axis=1)
        numbers = np.concatenate([self.best[who], np.broadcast_to(at, (len(who), len(at)))], axis=1)
        ids = np.where(numbers >= 0, self.least[numbers], np.iinfo(np.int64).max)
        keep = np.lexsort((ids, -scores), axis=1)[:, : self.k + 1]
        self.score[who] = np.take_along_axis(scores, keep, axis=1)
        self.best[who] = np.take_along_axis(numbers, keep, axis=1)

    def neighbours(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query_id, vec_id, score): the k best rows of each query, its own left out."""
        best, _ = self.search(queries)
        asked, column = np.nonzero(best >= 0)
        numbers = best[asked, column]
        score = (self.points[numbers] * queries[asked]).sum(axis=1)
        holders = np.minimum(self.begin[numbers + 1] - self.begin[numbers], 2 * self.k + 2)  # ids of a point, in order
        each = np.repeat(np.arange(len(numbers)), holders)
        ids = self.ids[self.begin[numbers][each] + np.arange(len(each)) - (np.cumsum(holders) - holders)[each]]
        asked, score = asked[each], score[each]
        other = ids != query_ids[asked]
        asked, ids, score = asked[other], ids[other], score[other]
        order = np.lexsort((ids, -score, asked))
        asked, ids, score = asked[order], ids[order], score[order]
        first = np.arange(len(asked)) - np.searchsorted(asked, asked) < self.k
        return query_ids[asked[first]], ids[first], score[first]


def shards_of(rows: int, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS) -> int:
    """Number of shards: none over shard_rows rows, and of few rows as many as SHARDS with least_rows in each."""
    return max(1, -(-rows // shard_rows), min(SHARDS, rows // min(least_rows, shard_rows)))


def rows_within(size: int, width: int) -> int:
    """Vectors of so many components that size bytes hold, one at least."""
    return max(1, size // (8 * max(width, 1)))


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries the k rows of vectors with the largest inner products."""
    take = lambda df: df.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows, wanted = take(vectors), take(queries).groupBy("id").agg(F.min("v").alias("v"))
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    shards = shards_of(held.n, min(shard_rows, rows_within(SHARD_BYTES, held.width)))
    shard = lambda n: F.xxhash64(F.size("v"), n)
    dealt = rows.select(shard(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).alias("shard"), F.lit(0).alias("query"), "id", "v")
    asked = wanted.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("n")).select(shard(F.col("n")).alias("shard"), F.lit(1).alias("query"), "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tree, held = None, None, []
        for batch in batches:
            keys = batch.column(0).to_numpy() * 1, batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                ids = part.column(2).to_numpy()
                matrix = part.column(3).flatten().to_numpy().reshape(len(ids), -1)
                if keys[0][a] != current:
                    current, tree, held = keys[0][a], None, []
                if not keys[1][a]:
                    held.append((ids, matrix))
                    continue
                if held:
                    tree, held = Tree(np.concatenate([m for _, m in held]), np.concatenate([i for i, _ in held]), k, factor), []
                some = rows_within(QUERY_BYTES, matrix.shape[1])
                for start in range(0, len(ids) if tree else 0, some):
                    found = tree.neighbours(ids[start : start + some], matrix[start : start + some])
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    found = dealt.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "query").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def every_20th(vectors: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score of the rows whose vec_id is divisible by 20, against all rows."""
    return nearest(vectors.select("vec_id", "embedding"), vectors.where(F.col("vec_id") % 20 == 0).select("vec_id", "embedding"))
