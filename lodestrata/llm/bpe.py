"""BPE encoding and decoding by speculation and verification, for vocabularies with word ends.

A word's tokens are proposed by greedy longest match, all words walking down the
vocabulary's trie together. A sequence of tokens is what the merges give if merging any
two neighbours alone gives just these two, so the pairs of all proposed words are tested
together, each distinct pair once. Only words with a failing pair (or a single token that
its own merges don't give) are merged exactly.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, map_batches
from .merging import Encoder, Table, ragged, runs_of

#: Words that a task remembers at most; then it starts anew.
MEMO_WORDS = 500_000
#: Characters that a task encodes at once, or those of one text.
CHARACTERS = 4_000_000
#: Below this code point no character combines, and lower case is the same in every version of Unicode.
PLAIN = chr(0x250)


class WordBpe(Encoder):
    """The vocabulary of a file, with a memo that lives as long as the worker.

    Characters are told apart, and texts beyond plain ones are normalised, by the library's
    own components, so that their Unicode tables are the library's.
    """

    def __init__(self, path: str):
        super().__init__(path, False, MEMO_WORDS)
        self.tokens = [""] * self.merger.size
        for token, i in [*self.merger.vocab.items(), *self.merger.special.items()]:
            self.tokens[i] = token
        self._grow_trie()
        self.fits: dict[int, bool] = {}

    def normal(self, text: str) -> str:
        return text.lower() if text.isascii() or max(text) < PLAIN else self.normalizer.normalize_str(text)

    def _grow_trie(self) -> None:
        self.of_token: dict[int, list[int]] = {i: self.merger.token_symbols(t) for t, i in self.merger.vocab.items()}
        children: dict[int, int] = {}
        token_at = [-1]
        for i, symbols in self.of_token.items():
            node = 0
            for s in symbols:
                key = node * 512 + s
                if key not in children:
                    children[key] = len(token_at)
                    token_at.append(-1)
                node = children[key]
            token_at[node] = i
        self.children, self.token_at = Table(children), np.array(token_at, np.int32)

    def proposed(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match over words in symbols: (ids in a row, their number for each word)."""
        ends = np.cumsum(lengths)
        word = np.arange(len(lengths))
        at, node = ends - lengths, np.zeros(len(lengths), np.int64)
        token, after = np.zeros(len(lengths), np.int32), at.copy()  # the longest match so far
        owners, ids = [], []
        while len(word):
            inside = at < ends[word]
            child = np.full(len(word), -1, np.int64)
            found = self.children.get(node[inside] * 512 + flat[at[inside]]).astype(np.int64)
            child[inside] = np.where(found < len(self.token_at), found, -1)
            alive = child >= 0
            node, at = np.where(alive, child, 0), at + alive
            longer = alive & (self.token_at[node] >= 0)
            token[longer], after[longer] = self.token_at[node[longer]], at[longer]
            if not alive.all():
                stuck = ~alive
                owners.append(word[stuck])
                ids.append(token[stuck])
                at[stuck] = after[stuck]
                left = alive | (at < ends[word])
                word, at, node, token, after = word[left], at[left], node[left], token[left], after[left]
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        flat_ids = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return flat_ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))

    def verified(self, sequences: np.ndarray) -> np.ndarray:
        """Whether the merges give just these tokens, for each key: a pair left << 32 | right, or a single token as -1 - id."""
        new = [k for k in sequences.tolist() if k not in self.fits]
        if new:
            parts = [[k >> 32, k & 0xFFFFFFFF] if k >= 0 else [-1 - k] for k in new]
            symbols = [[s for t in p for s in self.of_token[t]] for p in parts]
            ids, counts = self.merger.merge(np.array([s for x in symbols for s in x], np.int64), np.array([len(x) for x in symbols], np.int64))
            first = np.cumsum(counts) - counts
            wanted = np.array([len(p) for p in parts])
            same = (counts == wanted) & (ids[first] == np.array([p[0] for p in parts])) & (ids[first + counts - 1] == np.array([p[-1] for p in parts]))
            self.fits.update(zip(new, same.tolist()))
        return np.fromiter(map(self.fits.__getitem__, sequences.tolist()), bool, len(sequences))

    def learn(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, their number for each word): proposals, one test of their pairs, exact merging for those that fail."""
        if len(self.fits) > 10 * MEMO_WORDS:
            self.fits.clear()
        flat, lengths = self.merger.symbols(words)
        ids, counts = self.proposed(flat, lengths)
        owner = np.repeat(np.arange(len(words)), counts)
        inside = owner[1:] == owner[:-1]
        single = np.flatnonzero(counts == 1)
        keys = np.concatenate([ids[:-1][inside].astype(np.int64) << 32 | ids[1:][inside], -1 - ids[(np.cumsum(counts) - counts)[single]].astype(np.int64)])
        distinct, at = np.unique(keys, return_inverse=True)
        wrong = ~self.verified(distinct)[at]
        failing = np.zeros(len(words), bool)
        failing[np.concatenate([owner[1:][inside], single])[wrong]] = True
        again = np.flatnonzero(failing)
        if len(again):
            starts = np.cumsum(lengths) - lengths
            exact, exact_counts = self.merger.merge(flat[ragged(starts[again], lengths[again])], lengths[again])
            owner = np.concatenate([owner[~failing[owner]], np.repeat(again, exact_counts)])
            ids = np.concatenate([ids[~np.repeat(failing, counts)], exact])[np.argsort(owner, kind="stable")]
            counts[again] = exact_counts
        return ids, counts

    def merged(self, symbols: list[str]) -> list[int]:
        """Exact merging of one word, in the letters of the vocabulary."""
        return self.merger.merge_long([self.merger.vocab[s] for s in symbols])

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words in the letters of the vocabulary."""
        ids, counts = self.learn([bytes(map(self.merger.byte_of.__getitem__, w)) for w in words])
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if words else []


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (an array of integers) of each row.

    Null and empty texts give empty arrays, a text of white space too; a text of any length
    is encoded whole. A null id and repeated rows are kept as they are, other columns are
    not read, so that none clashes; an empty table gives an empty result. The vocabulary's
    path must exist on every executor.
    """
    texts = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at, stop in runs_of([len(t) for t in texts], CHARACTERS):
                ids, counts = bpe.encode(texts[at:stop])
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_batches(texts, run, schema)


def decode(encoded: DataFrame, vocabulary: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `keep`, and text: the tokens of ids (doc_id, ids, ...) joined by spaces.

    So decodes a vocabulary without a decoder; special tokens are kept. Null and empty ids
    give an empty text; null doc_ids, repeated rows and an empty table come out as they are.
    """
    kept = [encoded.schema["doc_id"], *(encoded.schema[c] for c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(load(vocabulary).tokens, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = pc.coalesce(part.column(part.num_columns - 1), pa.scalar([], pa.list_(pa.int32())))
                tokens = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), table.take(ids.flatten()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pc.binary_join(tokens, " ")], [*(f.name for f in kept), "text"])

    return map_batches(encoded.select(*(f.name for f in kept), "ids"), run, T.StructType([*kept, T.StructField("text", T.StringType())]))


def ids_text(column: str = "ids"):
    """Decimal ids joined by one space."""
    return F.array_join(F.col(column).cast("array<string>"), " ")
