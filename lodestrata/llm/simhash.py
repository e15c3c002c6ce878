"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into so few segments that, within the distance searched for, one of
them differs by one place at most. Each segment is indexed once for each of its places, with
that place as a wildcard; fingerprints that share a signature meet in an equality join and
are verified.

A place is a bit for `near_components`, which searches by distance. `near_groups` searches
by similarity: it takes what the bits give first, and then the same scheme over longer
places (see MARKS), as sets with a similarity of 0.8 differ in 10 of 64 bits on average,
too many for segments of bits. There the shingle sets themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, components, documents, map_batches, staged

#: Members of a bucket of `links` that are joined with each other; of larger ones see there.
BUCKET = 64
SEED = 42
#: Segments of marks, and marks of a segment: a pair at 0.8 agrees in four of five marks of one of four segments in 995 of 1000 cases.
SEGMENTS, MARKS = 4, 5
#: Up to so many ids that go, or signatures that occur twice, are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 18
#: How far the distances of two similar sets to a third one may lie apart, with room for rounding.
MOST_FAR = 0.2 + 1e-9
_MIX = np.random.default_rng(8).integers(1, 2**63, SEGMENTS * MARKS, dtype=np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: lower-cased (A-Z) words joined by a space."""
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(words, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops)), np.uint64, n)


def fingerprint(hashes: np.ndarray, copies: int = 1) -> np.ndarray:
    """`copies` 64-bit words: a bit is 1 if it is set in over half the hashes; no hashes: zero.

    The first word counts the hashes themselves, each further one another mix of them.
    """
    out = np.zeros(copies, np.uint64)
    for k in range(copies if len(hashes) else 0):
        h = hashes
        if k:
            h = (h ^ np.uint64(k)) * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % 2**64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 8192):
            counts += np.unpackbits(h[at : at + 8192, None].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int, copies: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (the text's hash) and w0, w1, ... (64-bit words of the fingerprint) of each row."""
    texts = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")
    names = [f"w{k}" for k in range(copies)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fingerprint(shingle_hashes(t.as_py(), words), copies) for t in batch.column(2)]
            table = np.array(got, np.uint64).reshape(-1, copies).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(copies))], ["doc_id", "h", *names])

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ["h", *names])])
    return map_batches(texts, run, schema)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """node and s, the distinct shingle hashes of the text, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])

    return map_batches(texts.select("node", "text"), run, "node long, s array<long>")


def marks_of(shingles: np.ndarray) -> np.ndarray:
    """SEGMENTS rows of MARKS marks: the smallest of the shingles' hashes under a mix of its own each (no shingles: all equal)."""
    low = np.full(SEGMENTS * MARKS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 4096):
        mixed = (shingles[at : at + 4096, None] ^ _MIX) * (_MIX | np.uint64(1))
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        low = np.minimum(low, mixed.min(0))
    return low.reshape(SEGMENTS, MARKS)


def mark_signatures(marks: np.ndarray) -> np.ndarray:
    """The signatures of each segment, one for each mark as a wildcard: a hash of the other marks and their places."""
    mixed = (marks ^ (marks >> np.uint64(31))) * (_MIX.reshape(marks.shape) | np.uint64(1))
    mixed ^= mixed >> np.uint64(29)
    others = mixed.sum(1, dtype=np.uint64)[:, None] - mixed + _MIX[::-1].reshape(marks.shape)
    others *= np.uint64(0x9E3779B97F4A7C15)
    return (others ^ (others >> np.uint64(32))).ravel()


def set_prints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (the text's hash), digest (a hash of 128 bits of the distinct shingles), w0 (their fingerprint) and sigs (their marks' signatures) of each row."""
    texts = documents(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, prints, sigs = [], [], []
            for text in batch.column(2):
                own = np.unique(shingle_hashes(text.as_py(), words))
                nodes.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(fingerprint(own).view(np.int64)[0])
                sigs.append(mark_signatures(marks_of(own)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.binary()), pa.array(prints, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "h", "digest", "w0", "sigs"])

    fields = (("h", T.LongType()), ("digest", T.BinaryType()), ("w0", T.LongType()), ("sigs", T.ArrayType(T.LongType())))
    return map_batches(texts, run, T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in fields)]))


def signatures(prints: DataFrame, words: list[str], per_word: int, bits: int, carry: list[str]) -> DataFrame:
    """The columns in `carry` and sig, once for each segment and wildcard.

    A word has `per_word` segments of `bits` bits. A signature is the segment's number, the
    wildcard's place and the segment without that bit.
    """
    mask = (1 << bits) - 1
    keys = []
    for i, w in enumerate(words):
        for s in range(per_word):
            segment = F.shiftrightunsigned(F.col(w), s * bits).bitwiseAND(F.lit(mask))
            number = i * per_word + s
            for p in range(bits):
                keys.append(segment.bitwiseAND(F.lit(mask & ~(1 << p))).bitwiseOR(F.lit((number << 6 | p) << 40)))
    return prints.select(*carry, F.explode(F.array(*keys)).alias("sig"))


def _buckets(signed: DataFrame, key: str = "sig") -> DataFrame:
    """The rows whose signature occurs more than once, with the bucket's size `n`.

    The rows themselves are never broadcast: Spark judges them by the files before their
    signatures were spread, so that it would take some gigabytes for a few megabytes.
    """
    sizes = staged(signed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    few = sizes.count() <= BROADCAST_ROWS
    return signed.join(F.broadcast(sizes) if few else sizes.hint("merge"), key)


def links(prints: DataFrame, most: int = 2, bucket: int | None = None) -> DataFrame:
    """Pairs a < b of the distinct 64-bit fingerprints `w0` that differ in `most` bits, 2 or fewer.

    Two segments of 32 bits, as one of them differs by one bit at most. Buckets of up to
    `bucket` members (BUCKET unless given) are joined with themselves, and a pair is kept under one of its
    signatures only. The members of larger buckets are linked without any pairs of members:
    each yields itself and its 64 neighbours at one bit; two fingerprints are at two bits or
    fewer exactly if they share one of these, so the smallest of those that share one is
    linked to the others (two links a member suffice for the same components).
    """
    if not 0 <= most <= 2:
        raise ValueError("links() searches within two bits")
    bucket = BUCKET if bucket is None else bucket
    live = staged(_buckets(signatures(prints, ["w0"], 2, 32, ["w0"])), "signatures")
    small = live.where(F.col("n") <= bucket)
    differ = F.col("l.w0").bitwiseXOR(F.col("r.w0"))
    low, high = differ.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(differ, 32)
    number, place = F.shiftright(F.col("l.sig"), 46), F.shiftright(F.col("l.sig"), 40).bitwiseAND(F.lit(63))
    own = F.when(number == 0, low).otherwise(high)
    at_wildcard = own == F.expr("shiftleft(1L, cast(shiftright(l.sig, 40) & 63 as int))")
    equal = (own == 0) & (place == 0)
    # the first segment counts if it fits; else the second
    once = (at_wildcard | equal) & ((number == 0) | (F.bit_count(low) > 1))
    pairs = small.alias("l").join(small.alias("r"), (F.col("l.sig") == F.col("r.sig")) & (F.col("l.w0") < F.col("r.w0")) & (F.bit_count(differ) <= most) & once)
    found = pairs.select(F.col("l.w0").alias("a"), F.col("r.w0").alias("b"))
    crowded = live.where(F.col("n") > bucket).select("w0").distinct()
    if most < 2:
        near = crowded.select("w0", F.explode(F.array(*(_flip(k) for k in range(64) if most))).alias("b")) if most else None
        return found if near is None else found.union(near.join(crowded.select(F.col("w0").alias("b")), "b").select(F.least("w0", "b").alias("a"), F.greatest("w0", "b").alias("b"))).distinct()
    hubs = crowded.select("w0", F.explode(F.array(F.col("w0"), *(_flip(k) for k in range(64)))).alias("hub"))
    firsts = hubs.groupBy("hub").agg(F.min("w0").alias("a"), F.count("*").alias("n")).where("n > 1").select("hub", "a")
    chained = hubs.join(firsts.hint("merge"), "hub").where("a <> w0").select("a", F.col("w0").alias("b"))
    return found.union(chained).distinct()


def _flip(k: int) -> Column:
    bit = 1 << k
    return F.col("w0").bitwiseXOR(F.lit(bit if k < 63 else -(1 << 63)).cast("long"))


def near_components(docs: DataFrame, words: int = 3, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, w0 (the fingerprint) and component_id (the smallest id reachable) of each row.

    Texts without words, null ones included, have the fingerprint zero and are linked like
    any other. Equal fingerprints are one node, so copies make no links. Null ids take
    part; a component without any other id has a null component_id. Repeated rows each
    stay in the result, other columns are not read, so that none clashes; an empty table
    gives an empty one.
    """
    prints = staged(fingerprints(docs, words, 1, id_col, text_col), "fingerprints")
    nodes = staged(prints.groupBy("w0").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes, most))
    least = nodes.join(roots, nodes["w0"] == roots["node"]).groupBy("root").agg(F.min("least").alias("component_id"))
    reached = roots.join(least, "root").select(F.col("node").alias("w0"), "component_id")
    of_node = nodes.join(reached, "w0", "left").select("w0", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(of_node, "w0").select("doc_id", "w0", "component_id")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of what their shingle sets share (common) and hold (sum)."""
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("left")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("right")), "b")
    return joined.select("a", "b", F.size(F.array_intersect("left", "right")).cast("long").alias("common"), (F.size("left").cast("long") + F.size("right")).alias("sum"))


def similar(pairs: DataFrame) -> DataFrame:
    """The pairs of `compared` with a Jaccard similarity of 0.8 or more."""
    return pairs.where(F.col("common") * 5 >= (F.col("sum") - F.col("common")) * 4).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def near_roots(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(node, root) of each node with links: root is the smallest node reachable by pairs with a similarity of 0.8 or more that the indexes find.

    `nodes` holds distinct shingle sets by `node` with w0 and sigs, and doc_id and h of one
    of their texts in `rep`; `texts` holds doc_id, h and text. Candidates are those of
    `links`, then members of a bucket of marks' signatures against the bucket's head. A
    bucket is compared anew without the head until its members are one component, so that
    every pair of it was compared or is connected; each round takes 16 times as many heads. Members are
    never paired with each other, and after the first round a pair meets in one bucket only.
    The distances to the first head spare most of the later comparisons: 1 minus the Jaccard
    similarity obeys the triangle inequality, so that two sets whose distances to the head
    differ by over 0.2 have a similarity under 0.8. A group of n sets whose similarities lie
    on both sides of 0.8 takes as many comparisons as it has pairs that neither that nor a
    chain of links decides.
    """
    heads = nodes.groupBy("w0").agg(F.min("node").alias("head"), F.count("*").alias("n"))
    heads = staged(heads, "heads")
    same = nodes.join(heads.where("n > 1"), "w0").select(F.col("head").alias("a"), F.col("node").alias("b"))
    of = lambda c: heads.select(F.col("w0").alias(c), F.col("head").alias(f"{c}_head"))
    bits = links(heads.select("w0"), 2, 1).join(of("a"), "a").join(of("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    first = staged(_ordered(same.union(bits)), "candidates")
    live = staged(_buckets(nodes.select(F.explode("sigs").alias("key"), "node"), "key").select("key", "node"), "signatures")
    ends = first.select(F.col("a").alias("node")).union(first.select("b")).union(live.select("node")).distinct()
    reps = nodes.join(ends, "node").select("node", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h"))
    own = texts.join(reps, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "text")
    sets = staged(shingle_sets(own.dropDuplicates(["node"]), words), "sets")
    found = staged(similar(compared(first, sets)), "links")
    roots, heads_each = None, 1
    live = live.select("key", "node", F.col("node").alias("root"), F.lit(None).cast("double").alias("far"))
    marked = nodes.select("node", "sigs")
    while True:
        if found.limit(1).count():
            # links join components, so that only what they join has to be followed
            ends = found if roots is None else found.join(_named(roots, "a"), "a", "left").join(_named(roots, "b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
            moved = components(ends).select(F.col("node").alias("old"), F.col("root").alias("new"))
            if roots is None:
                roots = moved.select(F.col("old").alias("node"), F.col("new").alias("root"))
            else:
                further = roots.join(moved, roots["root"] == moved["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
                more = moved.join(roots, moved["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
                roots = staged(further.union(more), "roots")
            live = live.join(moved, live["root"] == moved["old"], "left").select("key", "node", F.coalesce("new", "root").alias("root"), "far")
        several = live.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        live = staged(live.join(several, "key"), "rest")
        if live.limit(1).count() == 0:
            return found.select(F.col("a").alias("node"), F.col("b").alias("root")) if roots is None else roots  # without any roots no round found a link
        part = F.pmod(F.xxhash64("node"), F.lit(heads_each))
        chosen = staged(live.groupBy("key", part.alias("part")).agg(F.min(F.struct("node", "root", "far")).alias("head")).select("key", F.col("head.node").alias("head"), F.col("head.root").alias("head_root"), F.col("head.far").alias("head_far")), "heads")
        members, by_key = live, (F.col("key") == F.col("_key")) & (F.col("root") != F.col("head_root"))
        heads = chosen.withColumnRenamed("key", "_key")
        if heads_each > 1:  # a pair is compared in the first bucket that it shares
            members = members.join(marked, "node")
            heads = heads.join(marked.select(F.col("node").alias("head"), F.col("sigs").alias("head_sigs")), "head")
            by_key &= F.array_min(F.array_intersect("sigs", "head_sigs")) == F.col("key")
            by_key &= F.coalesce(F.abs(F.col("far") - F.col("head_far")) <= MOST_FAR, F.lit(True))
        star = members.join(heads, by_key).select("key", F.col("head").alias("a"), F.col("node").alias("b"))
        if heads_each == 1:
            star = staged(star, "star")
        tried = staged(compared(_ordered(star), sets), "compared")
        found = staged(similar(tried), "links")
        taken = chosen.select(F.col("key").alias("_key"), "head")
        live = live.join(taken, (F.col("key") == F.col("_key")) & (F.col("node") == F.col("head")), "left_anti").select("key", "node", "root", "far")
        if heads_each == 1:
            shared = F.col("common") / F.greatest(F.col("sum") - F.col("common"), F.lit(1))
            ways = star.select("key", F.col("b").alias("node"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried.select("a", "b", (1 - shared).alias("way")), ["a", "b"]).select("key", "node", "way")
            live = staged(live.join(ways, ["key", "node"], "left").select("key", "node", "root", F.col("way").alias("far")), "far")
        heads_each *= 16


def _named(roots: DataFrame, end: str) -> DataFrame:
    return roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))


def near_groups(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, h (the text's hash), node (a number of its shingle set), group (the smallest node) and stays of each row, by the
    similarity of five-word shingles (0.8 or more). Each link is verified; the fingerprint only finds candidates.

    `stays` holds for the smallest id of a group (null comes last, then the smaller h), and
    for the rows that repeat it. Texts with equal shingle sets are one node; null and empty
    texts are alike, so they are one group.
    Repeated rows each stay in the result; an empty table gives an empty one.
    """
    prints = staged(set_prints(docs, words, id_col, text_col), "fingerprints")
    none = F.isnull("doc_id").alias("none")
    # a node's rows share their fingerprint and signatures, as these follow from the set
    nodes = prints.groupBy("digest").agg(F.min(F.struct(none, "doc_id", "h")).alias("rep"), F.min("w0").alias("w0"), F.min("sigs").alias("sigs"))
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so that the numbers stay
    texts = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    of_node = near_roots(nodes, texts, words).select("node", F.col("root").alias("group"))
    grouped = prints.select("doc_id", "h", "digest").join(nodes.select("digest", "node"), "digest").join(of_node, "node", "left").withColumn("group", F.coalesce("group", "node"))
    first = grouped.groupBy("group").agg(F.min(F.struct(none, "doc_id", "h")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    return grouped.join(first, "group").select("doc_id", "h", "node", "group", stays.alias("stays"))


def one_of_each_group(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs that near_groups lets stay, rows that repeat id and text once."""
    groups = staged(near_groups(docs, words, id_col, text_col), "groups")
    names = F.col("doc_id").alias("_goes_id"), F.col("h").alias("_goes_h")
    goes = groups.where(~F.col("stays")).select(*names).distinct()
    repeated = groups.where("stays").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").select(*names)
    goes, repeated = staged(goes, "goes"), staged(repeated, "repeated")
    goes, repeats = broadcast_if(goes, goes.count(), BROADCAST_ROWS), repeated.count()
    repeated = broadcast_if(repeated, repeats, BROADCAST_ROWS)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_h"))
    match = F.col("_id").eqNullSafe(F.col("_goes_id")) & (F.col("_h") == F.col("_goes_h"))
    left = packed.join(goes, match, "left_anti")
    if repeats:
        left = left.join(repeated, match, "left_anti").union(left.join(repeated, match, "left_semi").dropDuplicates(["_id", "_h"]))
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))
