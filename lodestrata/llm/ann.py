"""Nearest neighbours by vantage-point trees, one for each shard.

A shard's distinct directions form a tree: a node splits its vectors at the median
distance from its vantage point. A search skips the side that the triangle inequality
rules out; the factor relaxes the test, and factor one is exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Vectors of a shard and queries of a block, on average.
SHARD, BLOCK = 8192, 2048
#: Vectors of a leaf.
LEAF = 64
#: Against rounding in squared distances and in scores.
SLACK = 1e-12
#: Candidates whose exact scores are computed at once, or those of a single query.
EXACT = 65_536


def within(gap: np.ndarray) -> np.ndarray:
    """The distance up to which a vector may score as high as one at this distance, by rounding."""
    return np.sqrt(gap * gap + SLACK)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    sound = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & sound & F.exists(as_double, lambda x: x != 0), F.lit(False))


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two arrays of doubles, summed in order."""

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    return dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def ordered_dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Products of the rows of two matrices, summed in order, to the bit as in `cosine`."""
    out = np.zeros(len(left))
    for a, b in zip(left.T, right.T):
        out += a * b
    return out


class Tree:
    """A vantage-point tree of unit vectors; each distinct vector, before scaling, carries its ids in order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 11):
        self.raw, owner = np.unique(vectors, axis=0, return_inverse=True)
        self._scale()
        order = np.lexsort((ids, owner.ravel()))
        self.ids, counts = ids[order], np.bincount(owner.ravel(), minlength=len(self.raw))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.rng = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(self.points)))
        del self.rng

    def _scale(self) -> None:
        self.points = self.raw / np.sqrt((self.raw * self.raw).sum(1))[:, None]
        self.norms = np.sqrt(ordered_dot(self.raw, self.raw))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("points", "norms")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._scale()

    def _node(self, members: np.ndarray) -> tuple:
        if len(members) <= LEAF:
            return (members,)
        at = int(self.rng.integers(len(members)))
        vantage, others = int(members[at]), np.delete(members, at)
        gaps = np.sqrt(np.maximum(0, ((self.points[others] - self.points[vantage]) ** 2).sum(1)))
        half = float(np.median(gaps))
        inside = gaps <= half
        if inside.all():
            return (members,) if len(members) <= 8 * LEAF else (vantage, half, self._node(others[: len(others) // 2]), self._node(others[len(others) // 2 :]), True)
        return vantage, half, self._node(others[inside]), self._node(others[~inside]), False

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float) -> list[np.ndarray]:
        """For each query the positions of the points among which its k nearest ids are, its own id left out.

        All queries go down together; a query leaves where the test rules a side out.
        """
        unit = queries / np.sqrt((queries * queries).sum(1))[:, None]
        need = k + 1  # one id may be the query's own
        best = np.full((len(queries), need), np.inf)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in queries]
        counts = np.minimum(np.diff(self.first), need)

        def visit(who: np.ndarray, points: np.ndarray) -> np.ndarray:
            gaps = np.sqrt(np.maximum(0, ((unit[who][:, None, :] - self.points[points][None, :, :]) ** 2).sum(2))) if len(who) * len(points) < 4096 else np.sqrt(np.maximum(0, 2 - 2 * unit[who] @ self.points[points].T))
            repeated = np.repeat(gaps, counts[points], axis=1)
            best[who] = np.partition(np.concatenate([best[who], repeated], axis=1), need - 1, axis=1)[:, :need]
            reach = within(best[who].max(1))
            for row, q in enumerate(who.tolist()):
                close = gaps[row] <= reach[row]
                if close.any():
                    found[q].append((points[close], gaps[row][close]))
            return gaps

        def descend(node: tuple, who: np.ndarray) -> None:
            if not len(who):
                return
            if len(node) == 1:
                visit(who, node[0])
                return
            vantage, half, near, far, both = node
            gap = visit(who, np.array([vantage]))[:, 0]
            if both:
                descend(near, who)
                descend(far, who)
                return
            inner = gap <= half
            for side, first in ((near, inner), (far, ~inner)):
                descend(side, who[first])
            for side, second in ((far, inner), (near, ~inner)):
                descend(side, who[second & (np.abs(gap - half) * factor <= within(best[who].max(1)) + 2e-7)])

        descend(self.root, np.arange(len(queries)))
        out = []
        for q in range(len(queries)):
            points = np.concatenate([p for p, _ in found[q]]) if found[q] else np.zeros(0, int)
            gaps = np.concatenate([g for _, g in found[q]]) if found[q] else np.zeros(0)
            out.append(points[gaps <= within(best[q].max())])
        return out

    def first_ids(self, queries: np.ndarray, own: np.ndarray, points: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's position, id, exact score) of the first k ids of each query among its points, its own id left out."""
        at = np.repeat(np.arange(len(points)), [len(p) for p in points])
        flat = np.concatenate(points)
        norms = np.sqrt(ordered_dot(queries, queries))
        score = ordered_dot(queries[at], self.raw[flat]) / (norms[at] * self.norms[flat])
        # a point's ids have one score, so that its k + 1 smallest hold its part of the result
        counts = np.minimum(self.first[flat + 1] - self.first[flat], k + 1)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        ids, at, score = self.ids[np.repeat(self.first[flat], counts) + step], np.repeat(at, counts), np.repeat(score, counts)
        keep = ids != own[at]
        ids, at, score = ids[keep], at[keep], score[keep]
        order = np.lexsort((ids, -score, at))
        ids, at, score = ids[order], at[order], score[order]
        chosen = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[chosen], ids[chosen], score[chosen]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine) of the k nearest vectors of each query, ties to the smaller id.

    `is_query` is a condition on the id column. Vectors that are null or zero or hold a
    null or non-finite component take no part, nor do rows without an id; a query is
    compared with vectors of its own length only. A query never finds its own id; rows
    that repeat an id count once, with the smallest of their vectors. Fewer than k candidates give fewer rows,
    an empty table none.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v"), is_query.alias("query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("vec_id").agg(F.min(F.transform("v", lambda x: x.cast("double"))).alias("v"), F.max(F.coalesce("query", F.lit(False))).alias("query"))
    rows = staged(rows.withColumn("dims", F.size("v")), "vectors")
    count, queries = rows.count(), rows.where("query").count()
    shards, blocks = -(-count // SHARD), -(-queries // BLOCK)
    if not queries:
        shards = blocks = 1

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(group["vec_id"].to_numpy(), np.stack(group["v"].to_numpy()))
        return pd.DataFrame({"dims": group["dims"].iloc[:1], "shard": group["shard"].iloc[:1], "tree": [pickle.dumps(tree)]})

    def shard(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64(F.col("vec_id"), F.lit(salt)), F.lit(n)).cast("int")

    trees = staged(rows.withColumn("shard", shard(1, shards)).groupBy("dims", "shard").applyInPandas(grow, "dims int, shard int, tree binary"), "trees")
    asked = rows.where("query").withColumn("block", shard(2, blocks))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dims", "shard", "block", "vec_id", "v")
    planted = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        tree: Tree = pickle.loads(right["tree"].iloc[0])
        own, vectors = left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy())
        points, out, start = tree.search(vectors, own, k, factor), [], 0
        while start < len(points):
            stop, size = start + 1, len(points[start])
            while stop < len(points) and size + len(points[stop]) <= EXACT:
                size += len(points[stop])
                stop += 1
            at, ids, scores = tree.first_ids(vectors[start:stop], own[start:stop], points[start:stop], k)
            out.append(pd.DataFrame({"query_id": own[start:stop][at], "vec_id": ids, "score": scores}))
            start = stop
        return pd.concat(out)

    found = asked.groupBy("dims", "shard", "block").cogroup(planted.groupBy("dims", "shard", "block")).applyInPandas(look, "query_id long, vec_id long, score double")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
