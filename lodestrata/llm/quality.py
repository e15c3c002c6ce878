"""Quality classification by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded on its own; gated attention
weighs the passages, and a logistic layer scores the weighted representation. Attention
and layer are learned together from document labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, held_out, map_batches

#: Labelled documents that the model is fitted on at most, by the hash of their ids.
SAMPLE_DOCUMENTS = 3000
#: Bytes of a passage: texts are cut into whole passages of this length, the last is shorter.
PASSAGE = 400
#: Hidden units of the attention, steps and step size of the fit.
HIDDEN, STEPS, RATE = 8, 150, 0.1

# Byte classes of the encoding.
_CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "mark", "symbol", "high")
_CLASS = np.zeros(256, np.uint8)
for _k, _members in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".,", "!?;:'\"()-")):
    for _c in _members:
        _CLASS[ord(_c)] = _k
_SEEN = set(np.flatnonzero(_CLASS)) | set(map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
for _b in range(256):
    if _b >= 128:
        _CLASS[_b] = 8
    elif _b not in _SEEN:
        _CLASS[_b] = 7
#: Buckets of hashed byte triples, which tell what a passage says.
BUCKETS = 32
#: Their deviations weigh less, as single buckets tell little.
BUCKET_WEIGHT = 0.25
FEATURES = 2 * len(_CLASSES) + BUCKETS + 6


def encode_passages(text: str) -> np.ndarray:
    """One row of features for each passage of a text (an empty text: one row of zeros, but for the constant).

    Shares of byte classes and of class changes, word lengths, distinct words and repeated
    neighbours tell what a passage looks like; shares of hashed byte triples (ASCII letters
    in lower case) tell what it says.
    """
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // PASSAGE))
    out = np.zeros((n, FEATURES), np.float32)
    out[:, -1] = 1
    if not len(raw):
        return out
    kinds = _CLASS[raw]
    owner = np.arange(len(raw)) // PASSAGE
    size = np.bincount(owner, minlength=n).astype(np.float32)
    k = len(_CLASSES)
    out[:, :k] = np.bincount(owner * k + kinds, minlength=n * k).reshape(n, k) / size[:, None]
    change = np.flatnonzero((kinds[1:] != kinds[:-1]) & (owner[1:] == owner[:-1])) + 1
    out[:, k : 2 * k] = np.bincount(owner[change] * k + kinds[change], minlength=n * k).reshape(n, k) / size[:, None]
    same = (raw[1:] == raw[:-1]) & (kinds[1:] >= 6) & (owner[1:] == owner[:-1])
    out[:, 2 * k] = np.bincount(owner[1:][same], minlength=n) / size
    low = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint32)
    triple = low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)
    triple = ((triple ^ (triple >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(27)
    inside = owner[2:] == owner[:-2]
    at = 2 * k + 5
    out[:, at : at + BUCKETS] = np.bincount(owner[2:][inside] * BUCKETS + triple[inside], minlength=n * BUCKETS).reshape(n, BUCKETS) / size[:, None]
    words = [raw[i * PASSAGE : (i + 1) * PASSAGE].tobytes().lower().split() for i in range(n)]
    for i, own in enumerate(words):
        if own:
            distinct = len(set(own))
            out[i, 2 * k + 1] = distinct / len(own)
            out[i, 2 * k + 2] = sum(a == b for a, b in zip(own, own[1:])) / len(own)
            out[i, 2 * k + 3] = size[i] / len(own) / 20
            out[i, 2 * k + 4] = sum(w in b"|-*#=" for w in own) / len(own)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    v: np.ndarray
    u: np.ndarray
    w: np.ndarray
    c: np.ndarray
    bias: float


def _attention(model: Model, x: np.ndarray, bags: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Gates, weights, pooled passages and scores of `n` bags, whose passages (one at least) stand in a row."""
    first = np.searchsorted(bags, np.arange(n))
    a, b = np.tanh(x @ model.v), 1 / (1 + np.exp(-np.clip(x @ model.u, -30, 30)))
    logits = (a * b) @ model.w
    e = np.exp(logits - np.maximum.reduceat(logits, first)[bags])
    weight = e / np.bincount(bags, e, minlength=n)[bags]
    pooled = np.add.reduceat(weight[:, None] * x, first)
    score = 1 / (1 + np.exp(-np.clip(pooled @ model.c + model.bias, -30, 30)))
    return a, b, weight, pooled, score


def fit(bags_of: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Model:
    """Adam on the weighted log loss, both labels weighing the same; gradients are written out."""
    d = FEATURES
    if not bags_of or len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        zero = np.zeros((d, HIDDEN))
        return Model(np.zeros(d), np.ones(d), zero, zero, np.zeros(HIDDEN), np.zeros(d), 4.0 * (share - 0.5))
    x = np.concatenate(bags_of)
    bags = np.repeat(np.arange(len(bags_of)), [len(b) for b in bags_of])
    n, rng = len(bags_of), np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    scale[-1 - BUCKETS : -1] /= BUCKET_WEIGHT
    x = np.clip((x - mean) / scale, -8, 8)
    model = Model(mean, scale, *(rng.normal(0, 0.1, shape).astype(np.float32) for shape in ((d, HIDDEN), (d, HIDDEN), HIDDEN)), np.zeros(d, np.float32), 0.0)
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) / n
    names = ("v", "u", "w", "c", "bias")
    first = {k: 0.0 for k in names}
    second = {k: 0.0 for k in names}
    for step in range(1, STEPS + 1):
        a, b, weight, pooled, score = _attention(model, x, bags, n)
        off = weights * (score - labels)
        to_pooled = off[:, None] * model.c
        inner = np.einsum("ij,ij->i", x, to_pooled[bags])
        to_logit = weight * (inner - np.bincount(bags, weight * inner, minlength=n)[bags])
        gated = to_logit[:, None] * model.w
        grads = {
            "v": x.T @ (gated * b * (1 - a * a)),
            "u": x.T @ (gated * a * b * (1 - b)),
            "w": (a * b).T @ to_logit,
            "c": pooled.T @ off + 1e-4 * model.c,
            "bias": off.sum(),
        }
        for k in names:
            first[k] = 0.9 * first[k] + 0.1 * grads[k]
            second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
            setattr(model, k, getattr(model, k) - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-9))
    return model


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", documents_at_most: int = SAMPLE_DOCUMENTS) -> Model:
    """Fit on up to `documents_at_most` labelled documents that aren't held out, half of them of each label where there are as many.

    A document with contradicting labels takes the larger share, 1 on a tie; rows without
    id or label are not used.
    """
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("double").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
    half = documents_at_most // 2
    parts = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for k in (0, 1)]
    rows = documents(docs, id_col, text_col).join(F.broadcast(parts[0].union(parts[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [encode_passages(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.binary())], ["label", "passages"])

    sample = map_batches(rows.select("label", "text"), run, "label int, passages binary").toPandas()
    sample = sample.sort_values(["passages", "label"], ignore_index=True)
    return fit([np.frombuffer(p, np.float32).reshape(-1, FEATURES) for p in sample["passages"]], sample["label"].to_numpy(float))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep_row: bool = False) -> DataFrame:
    """doc_id, score (0 to 1) and top_weight, the weight of the passage that weighs most; with keep_row also `row`, the whole row.

    A null or empty text is one empty passage. Repeated rows and null ids are scored like
    any other; an empty table gives an empty result.
    """
    if keep_row:
        source = docs.select(docs[id_col].alias("doc_id"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
        place = docs.columns.index(text_col)
    else:
        source = documents(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes
    kept = source.schema.fields[: 1 + keep_row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(1).field(place) if keep_row else part.column(1)
                bags_of = [encode_passages(t or "") for t in texts.to_pylist()]
                bags = np.repeat(np.arange(len(bags_of)), [len(b) for b in bags_of])
                x = np.clip((np.concatenate(bags_of) - own.mean) / own.scale, -8, 8)
                _, _, weight, _, score = _attention(own, x, bags, len(bags_of))
                top = np.maximum.reduceat(weight, np.searchsorted(bags, np.arange(len(bags_of))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(score), pa.array(top)], [*(f.name for f in kept), "score", "top_weight"])

    return map_batches(source, run, T.StructType([*kept, T.StructField("score", T.DoubleType()), T.StructField("top_weight", T.DoubleType())]))
