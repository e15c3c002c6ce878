"""Near-copies among vectors of one label, by spherical-cap filters.

A filter is a direction; a vector passes it if their product reaches a threshold, so that
its passing vectors are a cap of the sphere. The directions are random product codes: a
rotated vector falls into two halves, each has a book of random directions, and every pair
of entries, one of each book, is a filter. A vector's filters are listed from the two short
lists of half products, never by trying them all. Vectors that share a filter are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ann import cosine, usable
from .common import broadcast_if, components, map_batches, staged

#: Independent product codes, and the share of pairs right at the threshold that find each other (on PAIRS random ones).
ROTATIONS, RECALL, PAIRS = 16, 0.999, 2000
#: Filters of a vector at least: where few directions are near, the vector's own threshold is lower.
LEAST_FILTERS = 16
#: Entries of each half that the choice of the threshold looks at.
TOP = 48
#: Vectors of a filter from which one of them leads a ball.
CROWD = 32
#: Vectors of a chunk, rows of a group of small filters, and pairs multiplied at once.
CHUNK, SLAB, STEP = 512, 4096, 32_768
#: Leaders up to which they are broadcast.
BROADCAST_ROWS = 50_000


class Filters:
    """Product codes for vectors of `dims` components: `entries` directions in each half of each rotation."""

    def __init__(self, dims: int, entries: int, least: float, seed: int = 29):
        rng = np.random.default_rng([seed, dims, entries])
        wide = 2 * -(-max(dims, 8) // 2)
        self.entries, self.spins, self.books = entries, [], []
        for _ in range(ROTATIONS):
            self.spins.append(np.linalg.qr(rng.normal(size=(wide, wide)))[0][:dims])
            book = rng.normal(size=(2, entries, wide // 2))
            self.books.append(book / np.linalg.norm(book, axis=2, keepdims=True) / np.sqrt(2))
        self.level = self._level(rng, dims, least)

    def halves(self, units: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        turned = units @ self.spins[turn]
        half = turned.shape[1] // 2
        return turned[:, :half] @ self.books[turn][0].T, turned[:, half:] @ self.books[turn][1].T

    def _level(self, rng: np.random.Generator, dims: int, least: float) -> float:
        """The threshold at which RECALL of the pairs with a cosine of `least` pass a filter together."""
        a = rng.normal(size=(PAIRS, dims))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        across = rng.normal(size=(PAIRS, dims))
        across -= (across * a).sum(1, keepdims=True) * a
        size = np.linalg.norm(across, axis=1, keepdims=True)
        b = least * a + np.sqrt(1 - least * least) * np.divide(across, size, out=np.zeros_like(across), where=size > 1e-9)
        best = np.full(PAIRS, -1.0)
        for turn in range(ROTATIONS):
            sides = list(zip(self.halves(a, turn), self.halves(b, turn)))
            tops = [np.argsort(-(x + y), axis=1)[:, :TOP] for x, y in sides]
            (ax, bx), (ay, by) = ([np.take_along_axis(v, t, 1) for v in s] for s, t in zip(sides, tops))
            both = np.minimum(ax[:, :, None] + ay[:, None, :], bx[:, :, None] + by[:, None, :])
            best = np.maximum(best, both.max((1, 2)))
        return float(np.quantile(best, 1 - RECALL, method="lower"))

    def decode(self, units: np.ndarray) -> list[np.ndarray]:
        """The numbers of all filters that each unit vector passes, in order."""
        sides = [self.halves(units, turn) for turn in range(ROTATIONS)]
        out = []
        for row in range(len(units)):
            own = [(left[row], right[row]) for left, right in sides]
            found = self._above(own, self.level)
            if len(found) < LEAST_FILTERS:
                most = min(LEAST_FILTERS, self.entries)
                tops = [np.add.outer(np.partition(x, -most)[-most:], np.partition(y, -most)[-most:]) for x, y in own]
                found = self._above(own, np.partition(np.concatenate(tops, axis=None), -LEAST_FILTERS)[-LEAST_FILTERS])
            out.append(found)
        return out

    def _above(self, own: list[tuple[np.ndarray, np.ndarray]], level: float) -> np.ndarray:
        found = []
        for turn, (left, right) in enumerate(own):
            i, j = np.nonzero(left >= level - right.max() - 1e-9)[0], np.nonzero(right >= level - left.max() - 1e-9)[0]
            x, y = np.nonzero(left[i][:, None] + right[j][None, :] >= level)
            found.append(turn * self.entries**2 + i[x] * self.entries + j[y])
        return np.concatenate(found)


@lru_cache(maxsize=8)
def filters(dims: int, entries: int, least: float) -> Filters:
    return Filters(dims, entries, least)


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _units(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def with_filters(classes: DataFrame, entries: int, least: float) -> DataFrame:
    """`classes` (label, dims, cls, n, v) with `fs`, the filters of each vector in order."""
    shape = classes.select("label", "dims", "cls", "n", "v")
    number, width = (T.IntegerType(), pa.int32()) if ROTATIONS * entries**2 < 2**31 else (T.LongType(), pa.int64())
    schema = T.StructType([*shape.schema.fields, T.StructField("fs", T.ArrayType(number))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy()
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                found = filters(dims, entries, least).decode(_units(_flat(part.column(4)).reshape(-1, dims)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(width))], schema.names)

    return map_batches(shape, run, schema)


def balls(listed: DataFrame, least: float) -> DataFrame:
    """cls and ball of the vectors that a leader takes in.

    Of each filter that CROWD vectors or more pass, the one with the least hash leads. A
    vector joins, of the leaders within half the angle of the threshold, the one with the
    least hash. So any two of a ball are within the threshold, and need no comparison.
    """
    keys = ["label", "dims", "f"]
    passed = listed.select("label", "dims", "cls", F.explode("fs").alias("f"))
    leaders = passed.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("cls").alias("rank"), "cls")).alias("led")).where(F.col("n") >= CROWD)
    leaders = staged(leaders.select(*keys, "led.rank", F.col("led.cls").alias("leader")), "leaders")
    offers = passed.join(broadcast_if(leaders, leaders.count(), BROADCAST_ROWS), keys).select("cls", "leader", "rank").distinct()
    double = F.col("v").cast("array<double>")
    heads = leaders.select("leader").distinct().join(listed.select(F.col("cls").alias("leader"), double.alias("head")), "leader")
    tried = offers.join(listed.select("cls", double.alias("v")), "cls").join(heads, "leader")
    inside = tried.where(cosine(F.col("v"), F.col("head")) >= np.sqrt((1 + least) / 2) + 1e-9)
    return inside.groupBy("cls").agg(F.min(F.struct("rank", "leader")).alias("best")).select("cls", F.col("best.leader").alias("ball"))


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all pairs (a, b) connect, fewer than there are nodes."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for x, y in np.unique(np.stack([a, b], 1), axis=0).tolist():
        p, q = top(x), top(y)
        if p != q:
            parent[q] = p
            out.append((x, y))
    return out


def _compared(table: pa.Table, least: float) -> pa.Table:
    """Rows of a group, several filters or two chunks of one: what each vector gains in links (kind 0), and links of balls (kind 1)."""
    rows = table.combine_chunks()
    f, cls, ball, n, side = (rows[c].to_numpy() for c in ("f", "cls", "ball", "n", "side"))
    units = _units(_flat(rows["v"]).reshape(len(f), -1))
    order = np.argsort(f, kind="stable")
    f, cls, ball, n, side, units = f[order], cls[order], ball[order], n[order], side[order], units[order]
    lists = rows["fs"].take(pa.array(order)).combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    widths = np.diff(offsets)
    wide = np.full((len(f), widths.max(initial=1)), -1, np.int64)  # filters of each row, from the left
    wide[np.arange(wide.shape[1])[None, :] < widths[:, None]] = flat[offsets[0] : offsets[-1]]
    ends = np.searchsorted(f, f, side="right")
    hits: list[tuple[np.ndarray, np.ndarray]] = []
    pending: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        if not pending:
            return
        a, b = (np.concatenate(x) for x in zip(*pending))
        pending.clear()
        near = np.einsum("ij,ij->i", units[a], units[b]) >= least
        a, b = a[near], b[near]
        for at in range(0, len(a), 2048):  # a pair counts under the first filter that it shares
            x, y = a[at : at + 2048], b[at : at + 2048]
            early = np.where(wide[x] < f[x][:, None], wide[x], -1)
            shared = ((early[:, :, None] == wide[y][:, None, :]) & (early[:, :, None] >= 0)).any((1, 2))
            hits.append((x[~shared], y[~shared]))

    waiting = 0
    here = np.arange(len(f))
    for gap in range(1, int((ends - here).max(initial=1))):
        a = here[: len(f) - gap][ends[: len(f) - gap] > here[: len(f) - gap] + gap]
        b = a + gap
        apart = (ball[a] != ball[b]) & ((side[a] != side[b]) | (side[a] == 2))
        for at in range(0, len(a), STEP):
            kept = apart[at : at + STEP]
            pending.append((a[at : at + STEP][kept], b[at : at + STEP][kept]))
            waiting += int(kept.sum())
            if waiting >= STEP:
                settle()
                waiting = 0
    settle()
    a, b = (np.concatenate(x) for x in zip(*hits)) if hits else (np.zeros(0, int), np.zeros(0, int))
    gain = np.bincount(a, n[b], len(f)) + np.bincount(b, n[a], len(f))
    some = np.nonzero(gain)[0]
    tied = _forest(ball[a], ball[b])
    return pa.table({"kind": pa.array([0] * len(some) + [1] * len(tied), pa.int32()), "a": pa.array(cls[some].tolist() + [x for x, _ in tied], pa.int64()), "b": pa.array(gain[some].astype(np.int64).tolist() + [y for _, y in tied], pa.int64())})


def compared(taken: DataFrame, least: float) -> DataFrame:
    """kind, a and b of `_compared` over all filters.

    Filters that up to CHUNK vectors pass are dealt many to a group. The vectors of a
    larger one fall into chunks, and each two chunks meet in a group of their own, but for
    chunks of one ball. The vectors themselves are added when the groups are known.
    """
    keys = ["label", "dims", "f"]
    passed = taken.select("label", "dims", "cls", "ball", F.explode("fs").alias("f"))
    sizes = staged(passed.groupBy(*keys).agg(F.count("*").alias("total"), F.min("ball").alias("low"), F.max("ball").alias("high")).where("low <> high").drop("low", "high"), "sizes")
    told = sizes.agg(F.coalesce(F.sum(F.when(F.col("total") <= CHUNK, F.col("total"))), F.lit(0)).alias("few"), F.coalesce(F.max("total"), F.lit(0)).alias("most")).first()
    slabs = max(1, -(-told.few // SLAB))
    zero = F.lit(0).cast("long")
    dealt = passed.join(sizes.where(F.col("total") <= CHUNK), keys).select("f", "cls", F.pmod(F.xxhash64("f"), F.lit(slabs)).alias("g"), zero.alias("i"), zero.alias("j"), F.lit(2).alias("side"))
    if told.most > CHUNK:
        large = passed.join(sizes.where(F.col("total") > CHUNK), keys)
        own = large.groupBy(*keys, "ball").agg(F.count("*").alias("size")).withColumn("part", F.when(F.col("size") > CHUNK // 2, F.col("ball")))
        parts = own.groupBy(*keys, "part").agg(F.ceil(F.sum("size") / CHUNK).alias("chunks"))
        own = staged(own.join(parts.withColumnsRenamed({c: f"p_{c}" for c in [*keys, "part"]}), F.expr(" AND ".join(f"{c} <=> p_{c}" for c in [*keys, "part"]))).select(*keys, "ball", "part", "chunks"), "own")
        parts = own.select(*keys, "part", "chunks").distinct()
        chunks = staged(parts.select(*keys, "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c")).select(*keys, "part", F.xxhash64("part", "c").alias("id")), "chunks")
        left, right = (chunks.select(*keys, F.col("part").alias(f"part_{x}"), F.col("id").alias(x)) for x in ("i", "j"))
        pairs = staged(left.join(right, keys).where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("part_i") == F.col("part_j"), F.lit(False))).select(*keys, "i", "j"), "chunk_pairs")
        placed = large.join(own, [*keys, "ball"]).select(*keys, "cls", F.xxhash64("part", F.pmod(F.xxhash64("cls"), F.col("chunks"))).alias("id"))
        for name, side in (("i", F.when(F.col("i") == F.col("j"), 2).otherwise(0)), ("j", F.lit(1))):
            met = pairs if name == "i" else pairs.where("i <> j")
            dealt = dealt.unionByName(placed.join(met.withColumn("id", F.col(name)), [*keys, "id"]).select("f", "cls", F.col("f").cast("long").alias("g"), "i", "j", side.alias("side")))
    rows = dealt.join(taken.select("label", "dims", "cls", "ball", "n", "v", "fs"), "cls")

    def run(table: pa.Table) -> pa.Table:
        return _compared(table, least)

    return rows.groupBy("label", "dims", "g", "i", "j").applyInArrow(run, "kind int, a long, b long")


def near_copies(vectors: DataFrame, label: Column, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors at a cosine of `least` or more, same label) and component_id (the smallest id that links reach) of each vector.

    Vectors that are null or zero or hold a null or non-finite component, and those with a
    null label, link with nothing and are their own component; so does a vector with those
    of another length. Equal vectors are compared once, and count as often as they come. Rows that
    repeat an id count once, with the smallest of their labelled vectors; rows without an
    id are left out. An empty table gives none, and further columns are ignored.

    Every link found is verified in double precision. Pairs at the threshold are found
    with a probability of RECALL, closer ones more often.
    """
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), vectors[vector_col].alias("v")).where("vec_id IS NOT NULL")
    takes_part = usable(F.col("v")) & F.col("label").isNotNull()
    rows = staged(rows.groupBy("vec_id").agg(F.min(F.when(takes_part, F.struct("label", "v"))).alias("own")).select("vec_id", "own.label", "own.v"), "rows")
    sound = rows.where("v IS NOT NULL").withColumn("dims", F.size("v"))
    classes = staged(sound.groupBy("label", "dims", "v").agg(F.min("vec_id").alias("cls"), F.count("*").alias("n")), "classes")
    most = classes.groupBy("label", "dims").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    entries = max(64, int(np.ceil(np.sqrt(2 * most))))  # filters grow with the vectors, so that a filter's vectors don't
    listed = staged(with_filters(classes, entries, least), "listed")
    taken = staged(listed.join(balls(listed, least), "cls", "left").withColumn("ball", F.coalesce("ball", "cls")), "balls")
    found = staged(compared(taken, least), "found")
    gains = found.where("kind = 0").groupBy(F.col("a").alias("cls")).agg(F.sum("b").alias("gain"))
    roots = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "ball")
    sizes = taken.groupBy("ball").agg(F.sum("n").alias("inside"), F.min("cls").alias("least")).join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    sizes = staged(sizes, "sizes")
    firsts = sizes.groupBy("root").agg(F.min("least").alias("component_id"))
    sizes = sizes.join(firsts, "root").select("ball", "inside", "component_id")
    ends = taken.select("cls", "ball").join(sizes, "ball").join(gains, "cls", "left").select("cls", (F.col("inside") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), "component_id")
    ends = classes.join(ends, "cls").select("label", "v", "n_links", "component_id")
    out = rows.join(ends, ["label", "v"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
