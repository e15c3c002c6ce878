"""Removal of repeated byte strings by deep-shallow sorted suffixes.

Suffixes start at anchors only: the smallest hashed gram of every window as long as the
wanted match, chosen by the window's bytes alone, so that two equal strings hold the same
anchor at the same place. Suffixes
whose anchors share a gram meet in one task, with as many bytes before and after as a
match can need. There they are sorted in both directions, by multikey quicksort to a
shallow depth and by blind tries below it, and the common prefixes tell what is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, documents, map_batches, staged

LENGTH = 400
#: Bytes of an anchor's gram.
GRAM = 64
#: Bytes that multikey quicksort sorts by before blind tries take over.
SHALLOW = 32
#: Occurrences of a gram that one task takes (some 100 MB); windows of more frequent ones are compared by their digests.
CROWD = 1 << 17
#: Up to so many removed spans are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 17

_BLOCK, _PLACE = 1 << 18, (1 << 20) - 1
_TABLE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        n = _BLOCK + LENGTH + 8
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS.append(np.cumprod(row))
    return _POWERS


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    blocks = np.concatenate([x, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(places, hashes, spans): the anchors of the windows of `length` bytes, and bytes that windows repeat right here.

    A window's anchor is its gram with the smallest hash. Of equals it is the first, or the
    last where the first is within a gram of the window's start, so that a run with a short
    period has an anchor at its start and one at its end. Windows that hold such equals are
    compared with each other at once: those that repeat give a span, and only the first of
    them an anchor, so that a long run has no anchor for each of its periods.
    """
    width = length - gram + 1
    powers, inverse = _powers()
    data = raw.tobytes()
    places, hashes, spans = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
    for start in range(0, len(raw) - length + 1, _BLOCK):
        part = raw[start : start + _BLOCK + length - 1]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[part] * powers[: len(part)])])
        h = (sums[gram:] - sums[:-gram]) * inverse[: len(part) - gram + 1]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        high, place, mask = h & ~np.uint64(_PLACE), np.arange(len(h), dtype=np.uint64), np.uint64(_PLACE)
        first = (_sliding_min(high | place, width) & mask).astype(np.int64)
        last = _PLACE - (_sliding_min(high | (mask - place), width) & mask).astype(np.int64)
        chosen = np.where(first - np.arange(len(first)) < gram, last, first)
        tied = np.flatnonzero(first != last)
        if len(tied):
            whole = (sums[tied + length] - sums[tied]) * inverse[tied]
            _, lead, group = np.unique(whole, return_index=True, return_inverse=True)
            lead = tied[lead][group]
            again = np.array([i != j and data[start + i : start + i + length] == data[start + j : start + j + length] for i, j in zip(tied.tolist(), lead.tolist())], bool)
            repeated = np.union1d(tied[again], lead[again])
            if len(repeated):
                runs = np.split(repeated, np.flatnonzero(np.diff(repeated) > 1) + 1)
                spans += [(start + int(r[0]), start + int(r[-1]) + length) for r in runs]
                chosen = np.delete(chosen, tied[again])
        at = np.unique(chosen)
        places.append(at + start)
        hashes.append(h[at])
    place, index = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[index], spans


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """The members in the order of their strings, by a blind trie: nodes know only the depths at which strings part.

    A string goes down without comparing to any leaf, is compared with that leaf once, and
    enters where they part.
    """
    leaf = [0, [members[0]]]  # a leaf: [0, members with equal strings]; a node: [1, depth, {byte: child}]
    root = leaf
    for m in members[1:]:
        s, node = strings[m], root
        while node[0]:
            c = s[node[1]] if node[1] < len(s) else -1
            node = node[2].get(c) or next(iter(node[2].values()))
        other = strings[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(m)
            continue
        own = s[depth] if depth < len(s) else -1
        above, node = None, root
        while node[0] and node[1] < depth:
            c = s[node[1]] if node[1] < len(s) else -1
            above, node = (node, c), node[2][c]
        if node[0] and node[1] == depth:
            node[2][own] = [0, [m]]
            continue
        parted = [1, depth, {other[depth] if depth < len(other) else -1: node, own: [0, [m]]}]
        if above is None:
            root = parted
        else:
            above[0][2][above[1]] = parted
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0]:
            stack += [node[2][c] for c in sorted(node[2], reverse=True)]
        else:
            out += node[1]
    return out


def deep_shallow_order(strings: list[bytes], known: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices in the order of the strings, which agree in `known` bytes: multikey quicksort for `shallow` bytes, then blind tries."""
    out: list[int] = []
    stack = [(list(range(len(strings))), known)]
    while stack:
        members, depth = stack.pop()
        if len(members) <= 1:
            out += members
        elif depth >= known + shallow:
            out += blind_trie_order(strings, members)
        else:
            pivot = strings[members[len(members) // 2]][depth : depth + 1]
            less, same, more = [], [], []
            for m in members:
                c = strings[m][depth : depth + 1]
                (same if c == pivot else less if c < pivot else more).append(m)
            stack.append((more, depth))
            stack.append((same, depth + 1 if pivot else known + shallow))
            stack.append((less, depth))
    return out


def repeated_extents(before: list[bytes], after: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int]]:
    """For distinct contexts of one gram: how many bytes before and from the anchor strings of `length` repeat cover (0, 0: none).

    `before` is reversed. In every interval of common prefixes of the sorted suffixes
    `after`, the nearest in the order of `before` tells how far a match reaches back.
    """
    n = len(after)
    extent = [(0, 0)] * n

    def note(i: int, back: int, ahead: int) -> None:
        if back + ahead >= length:
            extent[i] = (max(extent[i][0], back), max(extent[i][1], ahead))

    if n == 2:
        back, ahead = common(*before), common(*after)
        note(0, back, ahead)
        note(1, back, ahead)
        return extent
    order = deep_shallow_order(after, gram)
    rank = [0] * n
    for r, i in enumerate(deep_shallow_order(before)):
        rank[i] = r
    shared = [common(after[a], after[b]) for a, b in zip(order, order[1:])]
    open_: list[tuple[int, int]] = []  # (depth, first place) of intervals not yet closed
    for at, depth in enumerate([*shared, -1]):
        first = at
        while open_ and open_[-1][0] > depth:
            ahead, first = open_.pop()
            inside = sorted(order[first : at + 1], key=rank.__getitem__)
            gaps = [common(before[a], before[b]) for a, b in zip(inside, inside[1:])]
            for i, back in zip(inside, map(max, zip([0, *gaps], [*gaps, 0]))):
                note(i, back, ahead)
        if depth >= 0 and (not open_ or open_[-1][0] < depth):
            open_.append((depth, first))
    return extent


def match_group(rows: set[tuple[bytes, int, bytes, bytes]], length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[bytes, int, int]]:
    """(key, start, end) of repeated bytes around the occurrences (key, place, before, after) of one gram."""
    if len(rows) < 2:
        return
    classes: dict[tuple[bytes, bytes], list[tuple[bytes, int]]] = {}
    for key, place, before, after in rows:
        classes.setdefault((before, after), []).append((key, place))
    contexts = list(classes)
    extents = repeated_extents([c[0] for c in contexts], [c[1] for c in contexts], length, gram) if len(contexts) > 1 else [(0, 0)]
    for (before, after), (back, ahead) in zip(contexts, extents):
        own = classes[before, after]
        if len(own) > 1 and len(before) + len(after) >= length:
            back, ahead = len(before), len(after)
        if ahead:
            for key, place in own:
                yield key, place - back, place + ahead


def _spans(rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    keys, starts, ends = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["key", "start", "end"])


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """(key, start, end): bytes of the distinct texts (doc_id, key, text) that strings of `length` bytes repeat cover; spans may overlap."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, keys, places, ends, grams = batch.slice(at, 128), [], [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    place, h, spans = anchors(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), length, gram)
                    keys += [key] * (len(place) + len(spans))
                    places += place.tolist() + [a for a, _ in spans]
                    ends += [None] * len(place) + [b for _, b in spans]
                    grams += h.view(np.int64).tolist() + [None] * len(spans)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in (places, ends, grams))], ["key", "place", "end", "gram"])

    long = texts.where(F.octet_length("text") >= length)
    both = staged(map_batches(long.select("key", "text"), find, "key binary, place long, end long, gram long").distinct(), "anchors")
    here = both.where("gram IS NULL").select("key", F.col("place").alias("start"), "end")
    found = both.where("gram IS NOT NULL").select("key", "place", "gram")
    often = found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    places = found.join(often, "gram").groupBy("key").agg(F.collect_list(F.struct("place", "gram", "n")).alias("places"))
    one = long.groupBy("key").agg(F.min("doc_id").alias("rep"))
    wanted = places.join(one, "key").withColumnRenamed("key", "own")
    sources = long.join(wanted, (F.col("key") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("key", "text", "places")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", "n", "key", "place", "before", "after"]
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                part, rows = batch.slice(at, 32), []
                for key, text, places in zip(*(c.to_pylist() for c in part.columns)):
                    raw = text.encode("utf-8", "replace")
                    for p in places:
                        place = p["place"]
                        rows.append((p["gram"], p["n"], key, place, raw[max(0, place - length + gram) : place][::-1], raw[place : place + length]))
                for first in range(0, len(rows), 4096):
                    g, n, k, p, b, a = zip(*rows[first : first + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.binary()), pa.array(p, pa.int64()), pa.array(b, pa.binary()), pa.array(a, pa.binary())], names)

    around = map_batches(sources, contexts, "gram long, n long, key binary, place long, before binary, after binary")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_now, group = None, set()
        for batch in batches:
            grams, out = batch.column(0).to_pylist(), []
            for g, row in zip(grams, zip(*(c.to_pylist() for c in batch.columns[1:]))):
                if g != gram_now:
                    out += match_group(group, length, gram)
                    gram_now, group = g, set()
                group.add(row)
            yield _spans(out)
        yield _spans(list(match_group(group, length, gram)))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                g, _, key, place, before, after = (c[row].as_py() for c in batch.columns)
                whole = before[::-1] + after
                starts = range(0, min(len(before) + 1, len(whole) - length + 1))
                digests = [hashlib.blake2b(whole[s : s + length], digest_size=16).digest() for s in starts]
                offsets = [len(before) - s for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(digests), pa.int64()), pa.array(offsets, pa.int64()), pa.array(digests, pa.binary()), pa.array([key] * len(digests), pa.binary()), pa.array([place] * len(digests), pa.int64())], ["gram", "offset", "digest", "key", "place"])

    matched = around.where(F.col("n") <= crowd).select("gram", "key", "place", "before", "after").repartition("gram").sortWithinPartitions("gram").mapInArrow(match, "key binary, start long, end long")
    matched = matched.union(here)
    if not often.where(F.col("n") > crowd).limit(1).count():
        return matched
    each = staged(around.where(F.col("n") > crowd).mapInArrow(windows, "gram long, offset long, digest binary, key binary, place long").distinct(), "windows")
    more = each.groupBy("gram", "offset", "digest").agg(F.count("*").alias("n")).where("n > 1")
    start = F.col("place") - F.col("offset")
    return matched.union(each.join(more, ["gram", "offset", "digest"]).select("key", start.alias("start"), (start + length).alias("end")))


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of each row.

    A byte goes if a string of `length` bytes that covers it also starts elsewhere, in any
    row, its own included. A null or empty text has no bytes, a text shorter than `length`
    stays whole, and one that another row repeats goes whole. Repeated rows are copies of
    each other, null ids too; an empty table gives an empty result.
    """
    texts = documents(docs, id_col, text_col).withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    copies = texts.where(F.octet_length("text") >= length).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    spans = staged(repeated_spans(texts, length, gram, crowd), "spans")
    by_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    fates = copies.join(by_text, "key", "full").select("key", F.coalesce(F.col("n") > 1, F.lit(False)).alias("whole"), F.when(F.col("n").isNull(), F.col("spans")).alias("spans"))
    fates = staged(fates, "fates")
    size = fates.select(F.sum(F.lit(4) + F.coalesce(F.size("spans"), F.lit(0)))).first()[0] or 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for text, whole, spans in zip(*(c.to_pylist() for c in part.columns[1:])):
                    raw, merged = text.encode("utf-8", "replace"), []
                    if whole:
                        merged = [[0, len(raw)]]
                    for span in sorted((s["start"], s["end"]) for s in spans or ()):
                        if merged and span[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], span[1])
                        else:
                            merged.append(list(span))
                    ends = [0, *chain.from_iterable(merged), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                    rows.append((len(raw), len(raw) - len(kept), len(merged), kept))
                a, b, c, d = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = texts.join(broadcast_if(fates, size, BROADCAST_ROWS), "key", "left").select("doc_id", "text", "whole", "spans")
    long = T.LongType()
    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), *(T.StructField(n, long) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return map_batches(joined, cut, schema)
