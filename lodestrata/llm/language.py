"""Language identification by words first, backing off to shorter and shorter character n-grams.

The model counts words and, over the distinct words, character n-grams of each language.
A known word scores by its log frequency in each language; an unseen one by the longest
n-grams of it that are known, and what they don't cover by shorter ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, documents, held_out, map_batches, staged

#: Labelled documents of each language that the model is fitted on at most, by the hash of their ids.
SAMPLE_PER_LANGUAGE = 400
#: Words and n-grams that each language brings into the model at most, its most frequent ones; shares are of all that were counted.
WORDS_PER_LANGUAGE, GRAMS_PER_LANGUAGE = 50_000, 20_000
LONGEST = 4
#: Up to so many ids of the sample are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 16
MEMO_WORDS = 150_000

_WORD, _ASCII_WORD = regex.compile(r"\p{L}+"), re.compile("[a-z]+")


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]
    grams: dict[str, np.ndarray]
    unknown: np.ndarray

    def word_scores(self, word: str) -> np.ndarray:
        """Log probabilities of a word in each language."""
        if (known := self.words.get(word)) is not None:
            return known
        marked, total, n = f"^{word}$", np.zeros(len(self.languages)), 0
        at = 0
        while at < len(marked):
            for size in range(min(LONGEST, len(marked) - at), 0, -1):
                if (known := self.grams.get(marked[at : at + size])) is not None:
                    total, n, at = total + known, n + 1, at + size
                    break
            else:
                total, n, at = total + self.unknown, n + 1, at + 1
        return total / n if n else self.unknown


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    return (_ASCII_WORD if text.isascii() else _WORD).findall(text.lower())


def training_sample(docs: DataFrame, lang_col: str, id_col: str, text_col: str, per_language: int) -> DataFrame:
    """(lang, text) of up to so many training documents of each language; which ones is up to the hash of their ids.

    The rank is taken over ids alone, and map tasks keep no more than the bound of each
    language (a group limit), so that a language with most rows is no burden.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].alias("lang"), docs[text_col].alias("text")).where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ranked = rows.select("doc_id", "lang").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
    chosen = staged(ranked.where(F.col("n") <= per_language).select("doc_id", "lang").distinct(), "chosen")
    return rows.join(broadcast_if(chosen, chosen.count(), BROADCAST_ROWS), ["doc_id", "lang"], "left_semi").select("lang", "text")


def word_counts(sample: DataFrame) -> DataFrame:
    """lang, word and n of the words of (lang, text) rows; each batch is counted where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(lang, Counter()).update(words_of(text.as_py()))
            rows = [(lang, w, n) for lang, own in by.items() for w, n in own.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

    return map_batches(sample, run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows."""
    by: dict[str, Counter] = {}
    for lang, text in rows:
        by.setdefault(lang, Counter()).update(words_of(text))
    return fit_counts(by)


def fit_counts(by: dict[str, Counter], totals: dict[str, int] | None = None) -> Model:
    """A model of the word counts of each language; `totals` are those of all its words, if some were left out of `by`.

    What a language brings in is up to its own counts alone, so that one with few documents
    keeps its words beside one with many. n-grams are those of the words that came in.
    """
    languages = sorted(by)
    if not languages:
        return Model([], {}, {}, np.zeros(0))

    def table(counts: list[Counter], most: int, sums: list[int]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        keys = sorted({k for c in counts for k in sorted(c, key=lambda k: (-c[k], k))[:most]})
        whole = np.maximum(1, np.array(sums, float)) + 0.1 * (len(keys) + 1)
        values = (np.array([[c[k] for c in counts] for k in keys], float).reshape(-1, len(counts)) + 0.1) / whole
        return dict(zip(keys, np.log(values))), np.log(0.1 / whole)

    words, _ = table([by[lang] for lang in languages], WORDS_PER_LANGUAGE, [(totals or {}).get(lang, sum(by[lang].values())) for lang in languages])
    grams = []
    for lang in languages:
        own: Counter = Counter()
        for word, n in by[lang].items():
            marked = f"^{word}$"
            for size in range(1, LONGEST + 1):
                for at in range(len(marked) - size + 1):
                    own[marked[at : at + size]] += min(n, 5)
        grams.append(own)
    tables, unknown = table(grams, GRAMS_PER_LANGUAGE, [sum(c.values()) for c in grams])
    return Model(languages, words, tables, unknown)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each row.

    The score is the softmax of the languages' mean log probabilities per word, sharpened
    by the square root of the number of words. A null or empty text, one without a letter,
    or a model without languages gives `und` and 0. Ties go to the language first in order.
    Repeated rows and null ids are kept; an empty table gives an empty result.
    """
    texts = documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS_PER_LANGUAGE and GRAMS_PER_LANGUAGE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = shared.value, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                langs, scores = [], []
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    if not words or not own.languages:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    counts = Counter(words)
                    for w in counts:
                        if w not in memo:
                            memo[w] = own.word_scores(w)
                    sums = np.array(list(counts.values()), float) @ np.array([memo[w] for w in counts])
                    mean = sums / len(words) * np.sqrt(len(words))
                    best = int(np.argmax(mean))
                    langs.append(own.languages[best])
                    scores.append(float(1 / np.exp(mean - mean[best]).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", texts.schema["doc_id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_batches(texts, run, schema)


def trained(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on the bounded sample, its texts taken whole, however long.

    Counts stay on Spark; WORDS_PER_LANGUAGE of each language, and the sums over all of
    its words, go to the driver. A table without labelled rows gives a model without languages.
    """
    counts = staged(word_counts(training_sample(docs, lang_col, id_col, text_col, per_language)), "word_counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    ranked = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")))
    by: dict[str, Counter] = {}
    for r in ranked.where(F.col("place") <= WORDS_PER_LANGUAGE).collect():
        by.setdefault(r.lang, Counter())[r.word] = r.n
    return fit_counts(by, totals)
