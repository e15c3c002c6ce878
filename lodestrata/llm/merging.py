"""Splitting into words and byte-pair merging of many words at once, in numpy, for a task's batches.

A batch's characters are one array: their kinds (letter, number, other, space) as the
tokenizers library takes them give the places where words start, and the distinct words
come from Arrow's dictionary encoding. `Memo` keeps the ids of words seen before in one
flat array, from which the ids of the texts are gathered.

New words are rows of a matrix of token ids. In each step every row merges its pair of
lowest rank (the leftmost of equals), until no row has a pair left: exact merging, only not
word by word.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Longer words are merged one by one, by a heap.
WIDEST = 64
#: Rows of a matrix.
ROWS = 16_384
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i], starts[i] + 1, ... of each i, in a row."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Table:
    """A mapping of integers to integers with vectorised lookups."""

    def __init__(self, pairs: dict[int, int]):
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], np.int32)

    def get(self, wanted: np.ndarray) -> np.ndarray:
        """The values, _NONE for keys that aren't there."""
        if not len(self.keys):
            return np.full(wanted.shape, _NONE)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], _NONE)


class Merger:
    """The merges of a vocabulary file. A word is a row of symbols: 0 to 255 are bytes, 256 to 511 the byte that ends a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        pairs = {}
        for rank, (a, b) in enumerate(merges):
            pairs.setdefault(self.vocab[a] * self.size + self.vocab[b], rank)
        self.rank = Table(pairs)
        self.rank_of = pairs
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int32)
        letters = byte_letters()
        self.first_ids = np.array([self.vocab[x] for x in letters] + [self.vocab[x + self.suffix] for x in letters], np.int32)
        self.byte_of = {x: b for b, x in enumerate(letters)}

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols in a row, lengths) of words that aren't empty."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        if self.suffix and len(words):
            flat[np.cumsum(lengths) - 1] += 256
        return flat, lengths

    def token_symbols(self, token: str) -> list[int]:
        body = token[: -len(self.suffix)] if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else token
        own = [self.byte_of[c] for c in body]
        if len(body) < len(token):
            own[-1] += 256
        return own

    def merge(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number for each word) of words in symbols."""
        starts, counts = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []  # (word, ids in a row)
        order = np.argsort(lengths, kind="stable")
        wide = int(np.searchsorted(lengths[order], WIDEST, "right"))
        at = 0
        while at < wide:
            width = int(lengths[order[at]])
            stop = min(wide, at + ROWS, int(np.searchsorted(lengths[order], max(8, width + width // 4), "right")))
            own = order[at:stop]
            ids = self._merge_rows(flat, starts[own], lengths[own])
            kept = ids >= 0
            counts[own] = kept.sum(1)
            parts.append((np.repeat(own, counts[own]), ids[kept]))
            at = stop
        for i in order[wide:].tolist():
            ids = np.array(self.merge_long(self.first_ids[flat[starts[i] : starts[i] + lengths[i]]].tolist()), np.int32)
            counts[i] = len(ids)
            parts.append((np.full(len(ids), i), ids))
        owner = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        ids = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int32)
        return ids[np.argsort(owner, kind="stable")], counts

    def _merge_rows(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        width = int(lengths.max())
        done = np.full((len(starts), width), -1, np.int32)
        done[np.arange(width) < lengths[:, None]] = self.first_ids[flat[ragged(starts, lengths)]]
        rows, now = np.arange(len(starts)), done
        ranks = self._ranks(now[:, :-1], now[:, 1:])
        while ranks.shape[1]:
            best = ranks.argmin(1)
            low = ranks[np.arange(len(rows)), best]
            going = low < _NONE
            if not going.all():
                done[rows, : now.shape[1]] = now
                done[rows, now.shape[1] :] = -1
                rows, now, ranks, best, low = rows[going], now[going], ranks[going], best[going], low[going]
            if not len(rows):
                return done
            each, columns = np.arange(len(rows)), np.arange(now.shape[1] - 1)
            now[each, best] = self.made[low]
            now = np.take_along_axis(now, columns + (columns > best[:, None]), 1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= best[:, None]), 1)
            after = best < now.shape[1] - 1
            ranks[each[after], best[after]] = self._ranks(now[each[after], best[after]], now[each[after], best[after] + 1])
            before = best > 0
            ranks[each[before], best[before] - 1] = self._ranks(now[each[before], best[before] - 1], now[each[before], best[before]])
        done[rows, : now.shape[1]] = now
        done[rows, now.shape[1] :] = -1
        return done

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(right >= 0, self.rank.get(left.astype(np.int64) * self.size + right), _NONE)

    def merge_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank_of.get(parts[i] * self.size + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j < 0 or parts[j] != right:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.rank_of.get(parts[a] * self.size + parts[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, parts[a], parts[after[a]]))
        return [p for p in parts if p >= 0]


class Memo:
    """The ids of strings, each learned once, in one flat array; `learn` gives (ids in a row, lengths) of new strings."""

    def __init__(self, learn: Callable[[list], tuple[np.ndarray, np.ndarray]], most: int):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict = {}
        self.starts, self.lengths, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def slots(self, strings: list) -> np.ndarray:
        """The place of each string, all of them learned now."""
        new = list(dict.fromkeys(x for x in strings if x not in self.slot))
        if new:
            ids, lengths = self.learn(new)
            first = len(self.slot)
            self.starts, self.lengths, self.ids = (self._room(a, n) for a, n in ((self.starts, first + len(new)), (self.lengths, first + len(new)), (self.ids, self.used + len(ids))))
            self.starts[first : first + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[first : first + len(new)] = lengths
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.slot.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.slot.__getitem__, strings), np.int64, len(strings))

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number for each slot)."""
        lengths = self.lengths[slots]
        return self.ids[ragged(self.starts[slots], lengths)], lengths

    def trim(self) -> None:
        """Start anew where more strings are kept than wanted; between batches only."""
        if len(self.slot) > self.most:
            self.clear()


LETTER, NUMBER, OTHER, SPACE, EDGE = range(5)
_EDGE = "\ud800"  # ends each text of a batch; no text holds a surrogate


def runs_of(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges (start, stop) with up to `most` in all, or of one."""
    start, size = 0, 0
    for at, n in enumerate(lengths):
        if at > start and size + n > most:
            yield start, at
            start, size = at, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


class Encoder:
    """Ids of texts as the library gives them for a vocabulary file, each distinct word learned once.

    With `joins` the format is that of byte-level vocabularies: a space belongs to the word
    after it, white space is words too and numbers are runs. Else white space is dropped and
    every digit is a word.
    """

    def __init__(self, path: str, joins: bool, most_words: int):
        self.merger, self.joins = Merger(path), joins
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        special = self.merger.special
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.kind_of = np.full(0x110000, 255, np.uint8)
        self.kind_of[ord(_EDGE)] = EDGE
        self.words = Memo(self.learn, most_words)

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number for each word)."""
        return self.merger.merge(*self.merger.symbols(words))

    def normal(self, text: str) -> str:
        return text

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point; those not met before are asked of the library's pre-tokeniser."""
        kinds = self.kind_of[points]
        if (kinds == 255).any():
            parts = lambda s: len(self.pre_tokenizer.pre_tokenize_str(s))
            for c in np.unique(points[kinds == 255]).tolist():
                own = chr(c)
                if parts("a" + own) == 1 and parts(own + "a") == 1 and parts(own):
                    kind = LETTER
                elif parts("!" + own) == 1 and parts(own):
                    kind = OTHER
                else:
                    kind = NUMBER if (parts("1" + own) == 1 if self.joins else parts(own)) else SPACE
                self.kind_of[c] = kind
            kinds = self.kind_of[points]
        return kinds

    def starts(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Whether a word starts at each code point."""
        new = np.append(True, kinds[1:] != kinds[:-1])
        new |= kinds == EDGE
        if self.joins:
            last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] < SPACE))  # of a run before a word
            new[last] = True
            new[last[points[last] == ord(" ")] + 1] = False
        else:
            new |= kinds == NUMBER
        quote = np.flatnonzero(new & (points == ord("'")))
        if len(quote):
            one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            new[quote[short | long] + 1] = False
            new[quote[short] + 2] = True
            new[quote[long] + 3] = True
        return new

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = _EDGE.join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds(points)
        first = np.flatnonzero(self.starts(points, kinds))
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        width[kinds == EDGE] = 0
        ends = np.concatenate([[0], np.cumsum(width)])
        offsets = np.append(ends[first], ends[-1])
        words = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer("".join(texts).encode())])
        of = kinds[first]
        wanted = of != EDGE if self.joins else of < SPACE
        found = words.filter(pa.array(wanted)).dictionary_encode()
        slots = self.words.slots(found.dictionary.to_pylist())[found.indices.to_numpy()]
        ids, lengths = self.words.gather(slots)
        each = np.zeros(len(first), np.int64)
        each[wanted] = lengths
        return ids, np.diff(np.cumsum(each)[of == EDGE], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number for each text)."""
        self.words.trim()
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.cuts is None or not any("<" in t and self.cuts.search(t) for t in texts):
            return self._encode([self.normal(t) for t in texts])
        parts = [(i, k % 2, p) for i, t in enumerate(texts) for k, p in enumerate(self.cuts.split(t))]
        ids, counts = self._encode(["" if special else self.normal(p) for _, special, p in parts])
        ends = np.cumsum(counts).tolist()
        pieces = [np.array([self.merger.special[p]], np.int32) if special else ids[end - n : end] for (_, special, p), end, n in zip(parts, ends, counts.tolist())]
        return np.concatenate(pieces), np.bincount([i for i, _, _ in parts], [len(p) for p in pieces], minlength=len(texts)).astype(np.int64)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as 32-bit integers."""
        ids, counts = self.encode(texts)
        ends = np.cumsum(counts)
        return [ids[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist())]
