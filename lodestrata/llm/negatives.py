"""Hard negatives of anchors, by lists of candidates that a cluster of anchors shares.

Anchors fall into clusters by direction. A cluster sorts its candidates once, by the
largest product that any anchor within the cluster's angle could have with them. Each of
its anchors walks that list, with exact products, until the bound of what is left proves
that nothing there can enter its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, staged

#: Candidates of a shard and anchors of a block at most, on average; candidates that are looked at between two tests of the bound.
SHARD, BLOCK, STRIDE = 32_768, 2048, 512
#: Anchors for each cluster on average, clusters at most, and anchors at most that their centres are fitted on.
MEMBERS, CLUSTERS, SAMPLE = 128, 64, 4096
#: Products below this are exact in a double.
EXACT = 2.0**52


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component as a double; null for a vector that is null or has a null or non-finite component (after scaling as well)."""
    scaled = F.transform(vector, lambda x: F.lit(256.0) * x.cast("double"))
    sound = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # floor() of a column gives a long; whole doubles beyond that have no fraction
    return F.when(sound, F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)))


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (zero ones stay) and norms."""
    top = np.abs(vectors).max(1, initial=0)
    part = vectors / np.where(top > 0, top, 1)[:, None]
    length = np.sqrt((part * part).sum(1))
    return part / np.where(length > 0, length, 1)[:, None], top * length


def _direction(units: np.ndarray) -> np.ndarray:
    mean = units.sum(0)
    size = np.sqrt(mean @ mean)
    return mean / size if size > 1e-12 else np.eye(1, units.shape[1])[0]


def centres(units: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """`count` directions among the unit vectors, by spherical k-means from evenly chosen ones."""
    found = units[np.linspace(0, len(units) - 1, count).astype(int)]
    for _ in range(rounds):
        own = (units @ found.T).argmax(1)
        found = np.stack([_direction(units[own == c]) if (own == c).any() else found[c] for c in range(count)])
    return found


class SharedList:
    """A cluster's candidates, sorted once by the bound that holds for all of its anchors."""

    def __init__(self, anchors: np.ndarray, candidates: np.ndarray):
        units, self.sizes = _scaled(anchors)
        others, norms = _scaled(candidates)
        centre = _direction(units)
        spread = np.arccos(np.clip(units @ centre, -1, 1)).max(initial=0)
        angle = np.arccos(np.clip(others @ centre, -1, 1))
        bound = norms * (np.cos(np.maximum(0, angle - spread)) + 1e-7)  # the addition is for rounding
        self.order = np.argsort(-bound, kind="stable")
        self.bounds = bound[self.order]
        self.exact = self.sizes.max(initial=0) * norms.max(initial=0) < EXACT
        self.anchors, self.candidates = (anchors, candidates) if self.exact else (_integers(anchors), _integers(candidates))

    def walk(self, owner: np.ndarray, low: list, high: list, most: int, allowed) -> list[list[tuple[int, int]]]:
        """For each search the first `most` (score, position) with a score from low to high, ties by position.

        Search s belongs to anchor `owner[s]`; `allowed(anchors, positions)` is the matrix of
        candidates that an anchor may take. A search ends when no score left can enter it.
        """
        found: list[list[tuple[int, int]]] = [[] for _ in owner]
        need = np.array(low, dtype=float if self.exact else object)
        top = np.array(high, dtype=need.dtype)
        open_, at = np.arange(len(owner)), 0
        while at < len(self.order):
            reach = self.sizes[owner[open_]] * self.bounds[at]
            open_ = open_[reach >= need[open_]]
            if not len(open_):
                break
            here = self.order[at : at + STRIDE]
            at += STRIDE
            who, back = np.unique(owner[open_], return_inverse=True)
            free = allowed(who, here)
            scores = self.anchors[who] @ self.candidates[here].T
            fit = (scores[back] >= need[open_][:, None]) & (scores[back] <= top[open_][:, None]) & free[back]
            for row in np.nonzero(fit.any(1))[0].tolist():
                search, new = int(open_[row]), np.nonzero(fit[row])[0]
                if len(new) > most:  # only those that may be among the first, with their ties
                    values = scores[back[row]][new]
                    new = new[values >= np.partition(values, -most)[-most]]
                merged = found[search] + list(zip((int(x) for x in scores[back[row]][new]), here[new].tolist()))
                merged.sort(key=lambda x: (-x[0], x[1]))
                found[search] = merged[:most]
                if len(merged) >= most:
                    need[search] = max(need[search], found[search][-1][0])
        return found


_integers = np.frompyfunc(int, 1, 1)


def _whole_rows(table: pa.Table) -> dict[str, np.ndarray]:
    """The columns of a group in the order of vec_id."""
    rows = table.sort_by("vec_id").combine_chunks()
    out = {c: rows[c].to_numpy(zero_copy_only=False) for c in rows.column_names if c not in ("v", "found")}
    out["v"] = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return out


def _long(score: int) -> int:
    return max(-(2**63), min(2**63 - 1, score))


def _positives(most: int):
    names = ("anchor_id", "positive_id", "positive_score")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, c = _whole_rows(left), _whole_rows(right)
            for kind in np.unique(a["label"]).tolist():
                same = np.nonzero(c["label"] == kind)[0]
                for cluster in np.unique(a["cluster"][a["label"] == kind]).tolist():
                    own = np.nonzero((a["label"] == kind) & (a["cluster"] == cluster))[0]
                    ids, others = a["vec_id"][own], c["vec_id"][same]
                    lists = SharedList(a["v"][own], c["v"][same])
                    found = lists.walk(np.arange(len(own)), [-np.inf] * len(own), [np.inf] * len(own), most, lambda who, at, ids=ids, others=others: ids[who][:, None] != others[at][None, :])
                    out += [(int(ids[s]), int(others[at]), _long(score)) for s, hits in enumerate(found) for score, at in hits]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 3, names)

    return run


def _negatives(most: int, low: int, high: int):
    names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, c = _whole_rows(left), _whole_rows(right)
            positives = left.sort_by("vec_id")["found"].to_pylist()
            searches = [(row, p["positive_id"], p["positive_score"]) for row, found in enumerate(positives) for p in found]
            owner = np.array([row for row, _, _ in searches])
            least, largest = [-(-low * p // 100) for _, _, p in searches], [high * p // 100 for _, _, p in searches]
            found = SharedList(a["v"], c["v"]).walk(owner, least, largest, most, lambda who, at: a["label"][who][:, None] != c["label"][at][None, :])
            out = [(int(a["vec_id"][row]), int(p), score, int(c["vec_id"][at]), _long(hit)) for (row, p, score), hits in zip(searches, found) for hit, at in hits]
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 5, names)

    return run


def _clustered(anchors: DataFrame, count: int) -> DataFrame:
    """The anchors with a `cluster`; the centres of each length of vectors are fitted on SAMPLE anchors at most."""
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("dims", "v").collect()
    fitted = {}
    for dims in {r.dims for r in sample}:
        units = _scaled(np.array([r.v for r in sample if r.dims == dims], float).reshape(-1, dims))[0]
        fitted[dims] = centres(units, max(1, min(CLUSTERS, -(-count // MEMBERS), len(units))))
    schema = T.StructType([*anchors.schema.fields, T.StructField("cluster", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [int((_scaled(np.array([v], float))[0] @ fitted[d].T).argmax()) if d in fitted else 0 for d, v in zip(batch["dims"].to_pylist(), batch["v"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], schema.names)

    return map_batches(anchors, run, schema)


def _dealt(rows: DataFrame, key: list[str], salt: int, size: int) -> DataFrame:
    """`rows` with a `part` of its key, of `size` rows on average."""
    counts = rows.groupBy(*key).agg(F.ceil(F.count("*") / size).alias("parts"))
    return rows.join(counts, key).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col("parts"))).drop("parts")


def _meet(anchors: DataFrame, candidates: DataFrame, key: list[str], run, schema: str) -> DataFrame:
    """Each block of anchors (key, block, part) with each shard of candidates of its key."""
    blocks = anchors.select(*key, "block", F.col("part").alias("at")).distinct()
    shards = candidates.select(*key, F.col("part").alias("shard")).distinct()
    met = staged(blocks.join(shards, key), "met")
    group = [*key, "block", "at", "shard"]
    left = anchors.withColumnRenamed("part", "at").join(met, [*key, "block", "at"])
    right = candidates.withColumnRenamed("part", "shard").join(met, [*key, "shard"])
    return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Components are taken as floor(256 * x), and a score is the inner product, an exact
    integer (beyond a long: the nearest long). An anchor's positives are its first
    `positives` other rows of its label. Negatives of such a pair are the first `negatives`
    rows of other labels with low <= 100 * negative / positive <= high; there are none for a
    negative positive score. Order is by score, then by the smaller id.

    Rows without id or label, and those whose vector is null or holds a null or non-finite
    component, take no part; vectors of zeros do, with scores of zero, and empty ones don't.
    Only vectors of one length meet. Rows that repeat an id count once, with the smallest
    label and vector. Further columns are left out; an empty table gives an empty result.

    Candidates are dealt into shards of SHARD rows, and each block of anchors meets each
    shard: the work grows with anchors times candidates, and a task holds one shard.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), whole(vectors[vector_col]).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v", "anchor")).alias("own")).select("vec_id", "own.*")
    rows = staged(rows.withColumn("dims", F.size("v")).withColumn("slab", F.pmod(F.xxhash64("label"), F.lit(1024))), "whole")
    count = rows.where("anchor").count()
    anchors = staged(_clustered(rows.where("anchor").drop("anchor"), count), "anchors")
    rows = rows.drop("anchor")

    key = ["dims", "slab"]
    own = _dealt(anchors.withColumn("block", F.lit(0)), key, 1, BLOCK)
    schema = "anchor_id long, positive_id long, positive_score long"
    near = _meet(own, _dealt(rows, key, 2, SHARD), key, _positives(positives), schema)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    near = staged(near.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("found")), "positives")

    asked = anchors.join(near, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id", "slab").withColumn("block", F.col("cluster"))
    asked = _dealt(asked, ["dims", "block"], 3, BLOCK).drop("cluster")
    schema += ", negative_id long, negative_score long"
    far = _meet(asked, _dealt(rows.drop("slab"), ["dims"], 4, SHARD), ["dims"], _negatives(negatives, low, high), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
