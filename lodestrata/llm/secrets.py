"""Secret scans with an incremental blob ledger.

A version of a path is known by the SHA-256 of its text, its blob. The ledger holds one
row for each blob and rule version that was scanned, findings or none. A scan reads only
blobs that the ledger doesn't have under the current rules, each of them once, and joins
the findings back to every path that carries the blob.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, documents, map_batches, shared_dir, staged

#: Up to so many known blobs (64 characters each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern` count if their group has at least `least` characters."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # runs are whole either way; shorter ones would be dropped
)

#: Formats that name themselves, beside the base rules.
FORMATS = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 32),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]+", 40),
)

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def rule_version(rules: tuple[Rule, ...] = RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_spans(text: str, compiled: list[tuple[Rule, re.Pattern]]) -> list[dict]:
    """The spans of all rules in code points, by start and then by the rules' order."""
    found = []
    for order, (rule, pattern) in enumerate(compiled):
        for m in pattern.finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return [{"kind": kind, "start": start, "end": end} for start, _, end, kind in sorted(found)]


LEDGER = "blob string, rule_version string, spans array<struct<kind:string,start:bigint,end:bigint>>"


def scan_versions(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(paths, ledger rows): the findings of every path, and the rows to append to the ledger.

    paths: doc_id, blob, spans (an array, empty without findings) for each row of docs.
    ledger rows: blob, rule_version, spans for each blob that this scan added.
    Each unseen blob is scanned once: where it stands if one row carries it, else the rows
    that carry it meet first. A null text is an empty blob, a null id is a path like any
    other, repeated rows are repeated paths, other columns are not read, so that none
    clashes; an empty table gives two empty results.
    """
    version = rule_version(rules)
    texts = documents(docs, id_col, text_col).withColumn("blob", F.sha2("text", 256))
    versions = staged(texts.select("doc_id", "blob"), "versions")
    counted = versions.groupBy("blob").agg(F.count("*").alias("n"))
    old = None
    if ledger is not None:
        old = ledger.where(F.col("rule_version") == version).select("blob", "spans")
        counted = counted.join(old.select("blob", F.lit(True).alias("known")), "blob", "left")
    else:
        counted = counted.withColumn("known", F.lit(None).cast("boolean"))
    # most blobs are new and carried once; only the others are looked up
    other = staged(counted.where("known OR n > 1").select("blob", F.coalesce("known", F.lit(False)).alias("known")).distinct(), "blobs")
    other = broadcast_if(other, other.count(), BROADCAST_ROWS)
    single = texts.join(other, "blob", "left_anti").select("blob", "text")
    shared = texts.join(other.where("not known"), "blob", "left_semi").groupBy("blob").agg(F.first("text").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(r, r.compiled()) for r in rules]
        for batch in batches:
            spans = [find_spans(text.as_py(), compiled) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _ARROW_SPANS)], ["blob", "spans"])

    found = map_batches(single.union(shared), scan, T.StructType([T.StructField("blob", T.StringType()), T.StructField("spans", SPANS)]))
    new = staged(found.select("blob", F.lit(version).alias("rule_version"), "spans"), "scanned")
    every = new.select("blob", "spans") if old is None else new.select("blob", "spans").unionByName(old)
    return with_findings(versions, every), new


def with_findings(versions: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, blob and spans of each path (doc_id, blob); `found` holds the spans of blobs."""
    findings = found.where(F.size("spans") > 0).dropDuplicates(["blob"])
    return versions.join(findings, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def open_ledger(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, str]:
    """The ledger at `path` and its path; one that isn't there yet, or a new one in the shared folder without a path, starts empty."""
    path = path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path), path


def scan_with_ledger(docs: DataFrame, path: str | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paths of scan_versions; what was scanned now is appended to the ledger at `path`, and the findings are read back from it."""
    ledger, path = open_ledger(docs.sparkSession, path)
    paths, new = scan_versions(docs, ledger, rules, id_col, text_col)
    new.write.mode("append").parquet(path)
    known = docs.sparkSession.read.schema(LEDGER).parquet(path).where(F.col("rule_version") == rule_version(rules))
    return with_findings(paths.select("doc_id", "blob"), known.select("blob", "spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redacted(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, each found span of the text replaced by `mask` (spans that overlap by one); a null text stays null."""
    paths, _ = scan_versions(docs, rules=RULES + FORMATS, id_col=id_col, text_col=text_col)
    hits = paths.where(F.size("spans") > 0).select(F.col("blob").alias("_hit"), "spans").dropDuplicates(["_hit"])
    packed = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("_blob"))
    text = F.col("row")[text_col]

    def step(done: Column, span: Column) -> Column:
        gap = F.substring(text, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        out = F.when(span["start"] >= done["at"], F.concat(done["out"], gap, F.lit(mask))).otherwise(done["out"])
        return F.struct(out.alias("out"), F.greatest(done["at"], span["end"]).alias("at"))

    last = F.aggregate("spans", F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")), step)
    tail = F.substring(text, (last["at"] + 1).cast("int"), F.length(text))
    clean = F.when(F.isnull("spans"), text).otherwise(F.concat(last["out"], tail))
    return packed.join(hits, F.col("_blob") == F.col("_hit"), "left").select(*(clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
