"""Exact top-k inner products: a ball tree for each shard, searched by branch and bound.

Shards are packed trees, queries travel in packed blocks, and each batch of blocks meets each group of shards once: a
stated query set against all rows, in blocks. A seed pass gives each query the k-th score of one shard; that bound goes
along to all groups, and it rises inside a group from shard to shard. Groups run apart and do not tell each other.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vantage.llm.storage import materialise

SHARD_ROWS, BLOCK_QUERIES, LEAF = 4096, 2048, 64
#: Shards of a group (the least, and the most on a large corpus) and query blocks of a batch. A task holds one group and one batch.
GROUP_SHARDS, MOST_SHARDS, BATCH_BLOCKS = 8, 64, 32
LOWEST = -(1 << 62)


@dataclass
class BallTree:
    """Points in tree order. Node i covers points ``lo[i]:hi[i]``; its children are ``left[i]`` and ``left[i] + 1``, or none (-1)."""

    points: np.ndarray
    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    centre: np.ndarray
    radius: np.ndarray

    @staticmethod
    def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Splits along the line between two far points, at the median, until a ball has ``leaf`` points or radius 0."""
        real = points.astype(float)
        order = np.arange(len(ids))
        lo, hi, left, centre, radius = [0], [len(ids)], [-1], [], []
        i = 0
        while i < len(lo):
            own = order[lo[i] : hi[i]]
            x = real[own]
            c = x.mean(axis=0)
            d = np.sqrt(((x - c) ** 2).sum(axis=1))
            centre.append(c)
            radius.append(d.max())
            if len(own) > leaf and d.max() > 0:
                a = x[d.argmax()]
                b = x[((x - a) ** 2).sum(axis=1).argmax()]
                order[lo[i] : hi[i]] = own[np.argsort(x @ (b - a), kind="stable")]
                mid = (lo[i] + hi[i]) // 2
                left[i] = len(lo)
                lo += [lo[i], mid]
                hi += [mid, hi[i]]
                left += [-1, -1]
            i += 1
        return BallTree(points[order], ids[order], np.array(lo), np.array(hi), np.array(left), np.array(centre), np.array(radius))


@dataclass
class Block:
    """Queries of a block, their k best so far (flat, by query), and the score below which nothing counts."""

    ids: np.ndarray
    points: np.ndarray
    bound: np.ndarray
    k: int

    def __post_init__(self) -> None:
        self.norm = np.sqrt((self.points.astype(float) ** 2).sum(axis=1))
        self.clear()

    def clear(self) -> None:
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(x) for x in zip(self.best, (row, score, ids), strict=True))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        count = np.bincount(row, minlength=len(self.ids))
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        keep = place < self.k
        self.best = row[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.bound[row[full]] = np.maximum(self.bound[row[full]], score[full])

    def search(self, tree: BallTree) -> None:
        """Best-first: of all nodes waiting, the one with the largest upper bound, summed over the queries that it may serve, goes next."""
        top = max(1, int(np.abs(self.points).max(initial=0)), int(np.abs(tree.points).max(initial=0)))
        exact = float if tree.points.shape[1] * top * top < 1 << 53 else object
        points, queries = tree.points.astype(exact), self.points.astype(exact)
        real = self.points.astype(float)

        def upper(node: int, rows: np.ndarray) -> np.ndarray:
            u = real[rows] @ tree.centre[node] + self.norm[rows] * tree.radius[node]
            return u + 1e-9 * (1 + np.abs(u) + self.norm[rows] * (np.abs(tree.centre[node]).max() + tree.radius[node]))

        waiting = [(0.0, 0, np.arange(len(self.ids)), None)]  # nodes differ, so the heap never compares arrays
        while waiting:
            _, node, rows, u = heapq.heappop(waiting)
            if u is not None:
                rows = rows[u >= self.bound[rows]]
            if not len(rows):
                continue
            if tree.left[node] < 0:
                a, b = tree.lo[node], tree.hi[node]
                s = queries[rows] @ points[a:b].T
                hit = (s >= self.bound[rows][:, None]) & (tree.ids[a:b][None, :] != self.ids[rows][:, None])
                r, c = np.nonzero(hit)
                self.offer(rows[r], s[r, c].astype(np.int64), tree.ids[a:b][c])
                continue
            for child in (int(tree.left[node]), int(tree.left[node]) + 1):
                u = upper(child, rows)
                may = u >= self.bound[rows]
                if may.any():
                    heapq.heappush(waiting, (-float(u[may].sum()), child, rows[may], u[may]))


def whole_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v, dim)``: components as floor(scale * x). Null ids, null vectors and vectors with null or non-finite components go.

    So do empty vectors, which have no product with any. Rows that repeat both id and vector count once.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    own = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(fine)
    v = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    return own.select("vec_id", v.alias("v")).where(F.size("v") > 0).groupBy("vec_id", "v").agg(F.size("v").alias("dim"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.int64)


def trees(vectors: DataFrame, shards: int, k: int) -> DataFrame:
    """``(shard, dim, tree)``. Of equal vectors in a shard only the k + 1 with the smallest ids can ever be among k best."""

    def build(table: pa.Table) -> pa.Table:
        ids, points = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        _, kind = np.unique(points, axis=0, return_inverse=True)
        kind = kind.ravel()
        by = np.argsort(kind, kind="stable")
        count = np.bincount(kind)
        place = np.arange(len(kind)) - np.repeat(np.cumsum(count) - count, count)
        keep = np.sort(by[place <= k])
        tree = BallTree.build(points[keep], ids[keep])
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int64()), "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    shard = F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))
    return vectors.withColumn("shard", shard).groupBy("shard", "dim").applyInArrow(build, "shard long, dim int, tree binary")


def blocks(queries: DataFrame, count: int, k: int) -> DataFrame:
    """``(block, dim, queries)``: query blocks, packed."""

    def pack(table: pa.Table) -> pa.Table:
        ids, points = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        held = Block(ids, points, np.full(len(ids), LOWEST, np.int64), k)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int64()), "dim": pa.array([table.column("dim")[0].as_py()], pa.int32()), "queries": pa.array([pickle.dumps(held)], pa.binary())})

    block = F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(count))
    return queries.withColumn("block", block).groupBy("block", "dim").applyInArrow(pack, "block long, dim int, queries binary")


def top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id is divisible by ``every``, the k largest inner products.

    Candidates are all other ids of the same dimension; ties go to the smaller id. Other columns are left out.
    """
    vectors = materialise(whole_vectors(table, id_col, vec_col, scale))
    n = vectors.count()
    shards, count = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(n / every / block_queries))
    groups = max(1, math.ceil(shards / min(MOST_SHARDS, max(GROUP_SHARDS, shards // 256))))
    batches = math.ceil(count / BATCH_BLOCKS)
    forest = materialise(trees(vectors, shards, k))
    packed = blocks(vectors.where(F.col("vec_id") % every == 0), count, k)

    def seed(tree: pa.Table, block: pa.Table) -> pa.Table:
        rows = []
        for raw in block.column("queries").to_pylist():
            held = pickle.loads(raw)
            for t in tree.column("tree").to_pylist():
                held.search(pickle.loads(t))
            held.clear()
            rows.append(pickle.dumps(held))
        return pa.table({"block": block.column("block"), "dim": block.column("dim"), "queries": pa.array(rows, pa.binary())})

    first = forest.join(F.broadcast(table.sparkSession.range(count).withColumnRenamed("id", "block")), F.col("shard") == F.pmod("block", F.lit(shards))).select("block", "dim", "tree")
    seeded = materialise(first.groupBy("block", "dim").cogroup(packed.groupBy("block", "dim")).applyInArrow(seed, "block long, dim int, queries binary"))

    def search(tree: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        for raw in block.column("queries").to_pylist():
            held = pickle.loads(raw)
            for t in tree.column("tree").to_pylist():
                held.search(pickle.loads(t))
            row, score, ids = held.best
            out.append((held.ids[row], ids, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    left = forest.withColumn("part", F.pmod("shard", F.lit(groups))).withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches - 1).cast("long"))))
    right = seeded.withColumn("batch", F.floor(F.col("block") / BATCH_BLOCKS)).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    found = left.groupBy("part", "batch", "dim").cogroup(right.groupBy("part", "batch", "dim")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(best).cast(T.IntegerType()))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector against all others."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
