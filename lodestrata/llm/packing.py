"""Sum-of-squares packing of tokenised documents into windows.

Each task packs its partition online. A level array counts the partially filled windows
at each fill level; a document's remainder goes to the level that keeps the sum of the
squared counts smallest, a new window included. Whole windows of a long document are cut
off first. At the end of a partition the fullest open windows keep what was placed in them
and are filled up with pieces of the emptiest, cut as needed; what is left over is cut into
lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import documents, map_batches
from .merging import Encoder, runs_of

#: Tokens of a window, and the id that ends each document.
WINDOW, END = 2048, 1
#: Words that a task remembers at most, and characters that it encodes at once, or those of one text.
MEMO_WORDS, CHARACTERS = 500_000, 4_000_000
#: Windows that a task keeps open at most, some 32 MB of ids; beyond it the fullest is filled up with pieces of the emptiest.
OPEN_WINDOWS = 4096


@functools.lru_cache(maxsize=2)
def load(path: str) -> Encoder:
    return Encoder(path, True, MEMO_WORDS)


class Packer:
    """Online sum-of-squares packing of pieces into windows numbered from `first`."""

    def __init__(self, window: int = WINDOW, first: int = 0):
        self.window, self.next, self.count = window, first, 0
        self.levels = np.zeros(window + 1, np.int64)  # open windows at each fill level
        self.open: list[list[tuple[int, list]]] = [[] for _ in range(window)]  # (number, pieces) at each level

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def level_for(self, size: int) -> int:
        """The level (0: a new window) that keeps the sum of squared counts smallest; of equals the fullest."""
        counts = self.levels[1 : self.window - size + 1]
        after = self.levels[1 + size : self.window + 1]
        change = 2 * (after - counts) + 2
        change[-1:] = 1 - 2 * counts[-1:]  # a window that gets full is no longer counted
        change[counts == 0] = np.iinfo(np.int64).max
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        return best + 1 if best >= 0 and change[best] <= 2 * self.levels[size] + 1 else 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        """Pieces (doc, start, ids, doc_tokens, window number, offset) that are final now."""
        total, at = len(ids), 0
        while total - at >= self.window:
            yield doc, at, ids[at : at + self.window], total, self.number(), 0
            at += self.window
        size = total - at
        if not size:
            return
        level = self.level_for(size)
        if level:
            number, pieces = self._take(level)
        else:
            number, pieces = self.number(), []
        pieces.append((doc, at, ids[at:], total))
        if level + size == self.window:
            yield from self.placed(number, pieces)
        else:
            self._put(number, pieces, level + size)
            while self.count > OPEN_WINDOWS:
                yield from self.fill(OPEN_WINDOWS // 2)

    @staticmethod
    def placed(number: int, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, total in pieces:
            yield doc, start, ids, total, number, offset
            offset += len(ids)

    def fill(self, most: int) -> Iterator[tuple]:
        """Leave at most so many windows open: the fullest are filled up with pieces of the emptiest, cut as needed.

        What the level array placed in a window that gets full stays as it is.
        """
        low, high = 1, self.window - 1
        donor: list = []  # pieces of a window that is given up
        while self.count > most:
            while high and not self.open[high]:
                high -= 1
            if not high:
                break
            number, pieces = self._take(high)
            level = high
            while level < self.window:
                if not donor:
                    while low < self.window and not self.open[low]:
                        low += 1
                    if low == self.window:
                        break
                    donor = self._take(low)[1]
                doc, at, ids, total = donor.pop()
                room = self.window - level
                pieces.append((doc, at, ids[:room], total))
                level += min(room, len(ids))
                if len(ids) > room:
                    donor.append((doc, at + room, ids[room:], total))
            if level < self.window:  # no window is left to take from
                self._put(number, pieces, level)
                break
            yield from self.placed(number, pieces)
        if donor:
            self._put(self.number(), donor, sum(len(p[2]) for p in donor))

    def _take(self, level: int) -> tuple[int, list]:
        self.levels[level] -= 1
        self.count -= 1
        return self.open[level].pop()

    def _put(self, number: int, pieces: list, level: int) -> None:
        self.open[level].append((number, pieces))
        self.levels[level] += 1
        self.count += 1

    def close(self) -> Iterator[tuple]:
        """Fill up the open windows; what is left over is cut into powers of two."""
        yield from self.fill(0)
        pieces = [p for level in reversed(self.open) for _, own in level for p in own]
        self.open, left = [[] for _ in range(self.window)], sum(len(p[2]) for p in pieces)
        self.levels[:], self.count = 0, 0
        room, number, offset = 0, 0, 0
        for doc, start, ids, total in pieces:
            at = 0
            while at < len(ids):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                    number, offset = self.number(), 0
                cut = min(room, len(ids) - at)
                yield doc, start + at, ids[at : at + cut], total, number, offset
                at, room, left, offset = at + cut, room - cut, left - cut, offset + cut


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Every document ends in `end_id`, so that a null or empty text is one token. A null id
    and repeated rows are packed like any other; an empty table gives no pieces. A text of
    any length is cut as needed. A task holds the ids of its open windows only.
    """
    texts = documents(docs, id_col, text_col)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = load(vocabulary), np.array([end_id], np.int32)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        kind = pa.int64()

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, number, offset = zip(*pieces)
            long = functools.partial(pa.array, type=pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), long(start), long(map(len, ids)), pa.array([x.astype("<u4").tobytes() for x in ids]), long(total), long(number), long(offset)], names)

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, texts = (c.to_pylist() for c in batch.columns)
            for at, stop in runs_of([len(t) for t in texts], CHARACTERS):
                ids, counts = bpe.encode(texts[at:stop])
                pieces, ends = [], np.cumsum(counts).tolist()
                for doc, last, n in zip(keys[at:stop], ends, counts.tolist()):
                    pieces += packer.add(doc, np.concatenate([ids[last - n : last], end]))
                if pieces:
                    yield rows(pieces)
        last = list(packer.close())
        for at in range(0, len(last), 1024):
            yield rows(last[at : at + 1024])

    types = [texts.schema["doc_id"].dataType, T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.LongType(), T.LongType()]
    return map_batches(texts, run, T.StructType([T.StructField(n, t) for n, t in zip(names, types)]))
