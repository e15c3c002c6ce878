"""The registered queries of the corpus operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, caps, conversations, exact, language, lines, negatives, packing, quality, secrets, simhash, suffix
from .common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = secrets.scan_with_ledger(_table(spark, sf_dir, "documents"), rules=secrets.RULES + secrets.FORMATS)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin([r.kind for r in secrets.RULES]))
    counts = [secrets.count_kind(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return paths.select("doc_id", *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(spans).alias("spans"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_documents(docs, quality.trained(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = lines.without_recurring_lines(_table(spark, sf_dir, "documents"), every=True)
    return left.select("doc_id", "lines_before", "lines_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_copies(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix.without_repeats(_table(spark, sf_dir, "documents"))
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may fall inside a character
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors["vec_id"] % 50 == 0)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(_table(spark, sf_dir, "documents"), words=3, most=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.trained(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), vocabulary)
    counted = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_text(), 256).alias("ids_sha256"), "ids")
    return bpe.decode(counted, vocabulary, keep=("n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each conversation of the table: faults after the damage, cost, audit and the hash of the repaired turns; one whose rows are all gone has zeros."""
    table = _table(spark, sf_dir, "conversations")
    report, turns = conversations.repair(conversations.damaged(table))
    every = table.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    found = found.join(conversations.digests(turns), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of each anchor (ids divisible by 100) and positive among all rows of the table; ids divisible by 7 have the next label."""
    vectors = _table(spark, sf_dir, "embeddings")
    own, label = vectors["vec_id"], vectors["label"]
    return negatives.hard_negatives(vectors, own % 100 == 0, F.when(own % 7 == 0, (label + 1) % 10).otherwise(label))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector of the table: its links within its label at a cosine of 0.93 or more, its component, and whether it is the one that stays."""
    vectors = _table(spark, sf_dir, "embeddings")
    return caps.near_copies(vectors, vectors["label"], 0.93).withColumn("kept", F.col("vec_id") == F.col("component_id"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_quality, op3_line_dedup, op4_packing, op5_exact_dedup, op6_suffix_dedup, op7_nearest, op8_simhash, op9_language, op10_bpe, op11_conversation_repair, op12_hard_negatives, op13_near_vectors)}

ORACLES = {
    "op5_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) = 1 AS kept,
               text_sha256
        FROM t""",
    "op7_nearest": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda s, x: s + x)) AS norm FROM v),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda s, x: s + x) / (q.norm * c.norm) AS score
            FROM n q JOIN n c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op12_hard_negatives": """
        WITH w AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM w a JOIN w c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (
            SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT * FROM n WHERE rank <= 10""",
    "op13_near_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
        l AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
            WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) / (a.norm * b.norm) >= 0.93),
        r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1),
        n AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
        SELECT x AS vec_id, coalesce(n_links, 0) AS n_links, component_id, x = component_id AS kept FROM c LEFT JOIN n USING (x)""",
}
