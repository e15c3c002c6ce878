import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import queries


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns, name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(after.collect(), after.schema)
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def similarity(a, b):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_near_copies_of_documents(spark, sf_dir):
    """Every pair at 0.9 or more loses one of its documents, and no document goes without a partner at 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    ids = sorted(texts)
    pairs = {(a, b): s for n, a in enumerate(ids) for b in ids[n + 1 :] if abs(len(texts[a]) - len(texts[b])) < 0.3 * max(len(texts[a]), len(texts[b])) and (s := similarity(texts[a], texts[b])) >= 0.8}
    assert not [p for p, s in pairs.items() if s >= 0.9 and p[0] in kept and p[1] in kept]
    assert all(any(i in p for p in pairs) for i in ids if i not in kept)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, None), (1, ""), (2, None), (2, "same words here in a text"), (2, "same words here in a text"), (3, "x " * 20_000)]])
def test_odd_rows(spark, docs_of, sf_dir, rows):
    docs = docs_of(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert len(docs.columns) == 8
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= min(1, docs.count())


def test_queries_cover_every_operator():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14)) and np.all([n in queries.QUERIES for n in queries.ORACLES])
