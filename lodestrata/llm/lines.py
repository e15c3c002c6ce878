"""Line dedup with a log-template tree.

A line is parsed to a fixed depth: by its number of tokens, then by its leading tokens,
where tokens with a digit are variable fields. In a leaf, lines join the template that
they agree with in most places, and the places where they differ become fields too. A
template that recurs across documents is dropped everywhere but where it comes first.
Lines are compared by their tokens themselves; hashes only deal them out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, documents, map_batches, staged

#: Leading tokens of a leaf; fixed tokens that a line needs to take part; share of its fixed tokens in which it must agree with a template.
LEADING, LEAST_FIXED, AGREE = 3, 5, 0.8
#: Up to so many numbers of dropped lines are broadcast (some 16 MB); more are joined by a shuffle.
BROADCAST_LINES = 1 << 20
#: Stands for a field; a token that is just this character counts as one.
FIELD = "\0"
_DIGIT = re.compile(r"[0-9]")

#: Begins the words of a line that recurs only as a whole; no token can hold it.
WHOLE = "\n"


def parsed_lines(text: str, every: bool = False) -> Iterator[tuple[int, int, str]]:
    """(number, hash of the leaf, tokens joined by newlines) of the lines that take part; fields are masked.

    Lines with too few fixed tokens for a template take part if `every` is set: each is a
    leaf of its own by all its tokens, unmasked, so that it recurs only as a whole.
    """
    for number, line in enumerate(text.split("\n")):
        tokens = line.split()
        masked = [FIELD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens
        fixed = len(masked) - masked.count(FIELD)
        if fixed >= LEAST_FIXED and 2 * fixed >= len(masked):
            yield number, _hash(f"{len(masked)} {' '.join(masked[:LEADING])}"), "\n".join(masked)
        elif every and tokens:
            own = "\n".join(tokens)
            yield number, _hash("= " + own), WHOLE + own


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


class Leaf:
    """The templates of one leaf, in the order in which they came up; a whole line (see parsed_lines) is a template of its own."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {FIELD: 0}  # of each token that came up in the leaf
        self.places: dict[int, np.ndarray] = {}  # templates by their number of tokens: leaves whose hashes are equal stay apart
        self.names: dict[int, list[str]] = {}

    def place(self, words: str) -> str:
        """The name of the template that takes the line: the one that agrees most, the first of equals, or a new one."""
        if words.startswith(WHOLE):
            return words
        tokens = words.split("\n")
        line = np.array([self.number.setdefault(t, len(self.number)) for t in tokens], np.int32)
        names, places = self.names.setdefault(len(line), []), self.places.setdefault(len(line), np.zeros((4, len(line)), np.int32))
        if names:
            own = places[: len(names)]
            agree = ((own == line) & (own != 0)).sum(1)
            best = int(agree.argmax())
            if agree[best] >= max(LEAST_FIXED, AGREE * np.count_nonzero(line)) and tokens[:LEADING] == names[best].split("\n")[:LEADING]:
                own[best][own[best] != line] = 0
                return names[best]
        if len(names) == len(places):
            places = self.places[len(line)] = np.concatenate([places, np.zeros_like(places)])
        places[len(names)] = line
        names.append(words)
        return words


def templates(named: DataFrame) -> DataFrame:
    """leaf and words of the distinct lines (leaf, words), and the template, named by its first line.

    Lines of a leaf come sorted through one task, which keeps the templates of a single leaf.
    """

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leaf = None, Leaf()
        for batch in batches:
            out = []
            for own, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != now:
                    now, leaf = own, Leaf()
                out.append(leaf.place(words))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], ["leaf", "words", "template"])

    return named.select("leaf", "words").repartition("leaf").sortWithinPartitions("leaf", "words").mapInArrow(grow, "leaf long, words string, template string")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """(doc_id, h, dropped) for documents that lose lines; h is the text's hash, dropped the numbers of the lines.

    Lines whose leaf occurs once go no further. Of the others the distinct ones form
    templates, but in leaves with one distinct line, where there is nothing to form.
    """
    texts = documents(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [(i, *x) for i, text in enumerate(part.column(2).to_pylist()) for x in parsed_lines(text, every)]
                if rows:
                    at_row, numbers, leaves, words = zip(*rows)
                    take = pa.array(at_row, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(take), part.column(1).take(take), pa.array(numbers, pa.int32()), pa.array(leaves, pa.int64()), pa.array(words, pa.string())],
                        ["doc_id", "h", "line", "leaf", "words"],
                    )

    kind, long = texts.schema["doc_id"].dataType, T.LongType()
    fields = (("doc_id", kind), ("h", long), ("line", T.IntegerType()), ("leaf", long), ("words", T.StringType()))
    lines = staged(map_batches(texts.select("doc_id", "h", "text"), run, T.StructType([T.StructField(n, t) for n, t in fields])), "lines")
    several = lines.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    live = staged(lines.join(several, "leaf"), "live")
    none = F.isnull("doc_id").alias("none")
    named = staged(live.groupBy("leaf", "words").agg(F.min(F.struct(none, "doc_id", "h", "line")).alias("first"), F.max(F.struct(none, "doc_id", "h")).alias("last")), "named")
    mixed = named.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf")
    grown = staged(templates(named.join(mixed, "leaf")), "templates")
    of = named.join(grown, ["leaf", "words"], "left").withColumn("template", F.coalesce("template", "words"))
    whole = of.groupBy("leaf", "template").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    same = F.col("first.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("first.h") == F.col("last.h"))
    recurring = of.select("leaf", "words", "template").join(whole.where(~same).select("leaf", "template", "first"), ["leaf", "template"]).select("leaf", "words", "first")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h")) & (F.col("line") == F.col("first.line"))
    return live.join(recurring, ["leaf", "words"]).where(~stays).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def without_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """The rows and columns of docs, the text without the recurring lines, plus lines_before and lines_dropped.

    Lines are what "\\n" separates. Of a recurring template the line of the smallest id
    (then hash and line number) stays; a null id comes last. Lines with fewer than
    LEAST_FIXED fixed tokens, or more fields than fixed tokens, drop only with `every`, and
    then where all their tokens recur, digits included; blank lines never drop. Rows that
    repeat id and text are one document. A null text stays null, an empty one empty; a
    document may lose all its lines and is then empty. Columns of docs that are named as the
    two counts are left out. An empty table stays empty.
    """
    drops = staged(dropped_lines(docs, id_col, text_col, every).select(F.col("doc_id").alias("_drop_id"), F.col("h").alias("_drop_h"), "dropped"), "dropped")
    drops = broadcast_if(drops, drops.select(F.sum(F.size("dropped") + 4)).first()[0] or 0, BROADCAST_LINES)
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[id_col].alias("_id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("_h"))
    joined = packed.join(drops, F.col("_id").eqNullSafe(F.col("_drop_id")) & (F.col("_h") == F.col("_drop_h")), "left")
    parts = F.split(F.col("row")[text_col], "\n", -1)
    left = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("dropped", i)), "\n")
    text = F.when(F.isnull("dropped"), F.col("row")[text_col]).otherwise(left)
    return joined.select(
        *(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("lines_before", "lines_dropped")),
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("lines_before"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("lines_dropped"),
    )
