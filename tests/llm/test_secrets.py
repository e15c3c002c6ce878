import hashlib
import re

from pyspark.sql import functions as F

from lodestrata.llm import secrets

KEY = "AKIA" + "A1B2C3D4E5F6G7H8"
ROWS = [(1, f'Password = "hunter22" and {KEY}'), (2, "token: abc token: abcdef0"), (3, "0123456789abcdef01234567 x"), (4, None), (5, ""), (6, f'Password = "hunter22" and {KEY}'), (None, "secret=" + "a" * 40_000), (3, "0123456789abcdef01234567 x"), (7, "ſecret: abcdefgh"), (8, "é api-key api_key:é apikey:abc/def=")]


def plain(text):
    text = text or ""
    rules = {
        "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        "access": re.compile("AKIA[A-Z0-9]+"),
        "hex": re.compile("[0-9a-f]+"),
    }
    least = {"assign": 6, "access": 20, "hex": 24}
    found = [(m.start(), list(rules).index(k), m.end(), k) for k, p in rules.items() for m in p.finditer(text) if len(m[2] if k == "assign" else m[0]) >= least[k]]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_spans(docs_of):
    paths, ledger = secrets.scan_versions(docs_of(ROWS))
    got = sorted(((r.doc_id or 0, r.s) for r in paths.select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()))
    assert got == sorted((i or 0, plain(t)) for i, t in ROWS)
    assert {r.blob for r in ledger.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS}


def test_ledger_is_incremental(docs_of, spark):
    _, old = secrets.scan_versions(docs_of(ROWS[:4]))
    old = spark.createDataFrame(old.collect(), old.schema)
    paths, new = secrets.scan_versions(docs_of(ROWS), old)
    assert {r.blob for r in new.collect()}.isdisjoint({r.blob for r in old.collect()})
    assert sorted((r.doc_id or 0, r.s) for r in paths.select("doc_id", secrets.spans_text(F.col("spans")).alias("s")).collect()) == sorted((i or 0, plain(t)) for i, t in ROWS)
    _, again = secrets.scan_versions(docs_of(ROWS), old.unionByName(spark.createDataFrame(new.collect(), new.schema)))
    assert again.count() == 0
    other = (*secrets.RULES, secrets.Rule("phrase", "magic", 5))
    assert secrets.scan_versions(docs_of(ROWS[:2]), old, other)[1].count() == 2


def test_redaction(docs_of):
    got = {r.doc_id: r.text for r in secrets.redacted(docs_of([*ROWS[:5], (9, "token=0123456789abcdef0123456789 é end")])).collect()}
    assert got == {1: "[SECRET] and [SECRET]".replace("[SECRET] and", '[SECRET]" and'), 2: "token: abc [SECRET]", 3: "[SECRET] x", 4: None, 5: "", 9: "[SECRET] é end"}


def test_no_rows(docs_of):
    paths, ledger = secrets.scan_versions(docs_of([]))
    assert paths.count() == ledger.count() == secrets.redacted(docs_of([])).count() == 0
