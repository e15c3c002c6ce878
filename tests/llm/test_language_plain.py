"""Language identification against a plain loop, and small languages beside large ones."""

import math
import re
from collections import Counter

import pytest

from lodestrata.llm import language

TEXTS = {
    1: ("en", "the cat and the dog of the house"), 2: ("de", "der hund und die katze im haus"), 3: ("en", "a house and a garden"), 4: ("de", "das haus und der garten"),
    5: ("fr", "le chat et le chien dans la maison"), 7: ("fr", "une maison et un jardin"), 8: ("en", "Cats, dogs & houses"), 9: (None, "zzz katzen gardens"), 10: ("en", "l'été déjà"), 12: ("de", ""),
}


def plain(training, texts):
    """{id: (language, score)} by dictionaries and loops only."""

    def words(text):
        return re.findall(r"[^\W\d_]+", text.lower())

    langs = sorted({lang for lang, text in training if words(text)})  # one without a word isn't learned
    counts = {x: Counter(w for lang, t in training if lang == x for w in words(t)) for x in langs}
    grams = {x: Counter() for x in langs}
    for x in langs:
        for w, n in counts[x].items():
            m = "^" + w + "$"
            for i in range(len(m)):
                for j in range(i + 1, min(len(m), i + language.LONGEST) + 1):
                    grams[x][m[i:j]] += min(n, 5)

    def chance(tables, key, x):
        keys = {k for c in tables.values() for k in c}
        return math.log((tables[x][key] + 0.1) / (max(1, sum(tables[x].values())) + 0.1 * (len(keys) + 1)))

    def score(w, x):
        if any(w in c for c in counts.values()):
            return chance(counts, w, x)
        m, at, found = "^" + w + "$", 0, []
        while at < len(m):
            size = next((k for k in range(min(language.LONGEST, len(m) - at), 0, -1) if any(m[at : at + k] in c for c in grams.values())), None)
            found.append(chance(grams, m[at : at + size] if size else None, x))
            at += size or 1
        return sum(found) / len(found)

    out = {}
    for i, text in texts.items():
        ws = words(text)
        if not ws:
            out[i] = ("und", 0.0)
            continue
        mean = [sum(score(w, x) for w in ws) / len(ws) * math.sqrt(len(ws)) for x in langs]
        best = max(range(len(langs)), key=lambda k: mean[k])
        out[i] = (langs[best], 1 / sum(math.exp(v - mean[best]) for v in mean))
    return out


def test_scores_of_a_plain_loop(spark):
    docs = spark.createDataFrame([(i, lang, text) for i, (lang, text) in TEXTS.items()], "doc_id long, lang string, text string")
    training = [(r.lang, r.text) for r in language.training_sample(docs, "lang", "doc_id", "text", 99).collect()]
    assert len({lang for lang, _ in training}) >= 2
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, language.trained(docs)).collect()}
    want = plain(training, {i: text for i, (_, text) in TEXTS.items()})
    assert {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert {i: v[1] for i, v in got.items()} == pytest.approx({i: v[1] for i, v in want.items()}, abs=1e-9)


def test_a_small_language_keeps_its_words(monkeypatch):
    monkeypatch.setattr(language, "WORDS_PER_LANGUAGE", 50)
    large = Counter({f"word{n:04d}": 1000 for n in range(2000)})
    model = language.fit_counts({"large": large, "small": Counter({"pieni": 2, "kieli": 1})}, {"large": 2_000_000, "small": 3})
    assert {"pieni", "kieli"} <= model.words.keys() and len(model.words) == 52
    assert model.word_scores("kieli").argmax() == 1


def test_counts_left_out_stay_in_the_sums(monkeypatch, spark):
    monkeypatch.setattr(language, "WORDS_PER_LANGUAGE", 1)
    docs = spark.createDataFrame([(i, "en", "b a a") for i in range(30)], "doc_id long, lang string, text string")
    model = language.trained(docs)
    n = language.training_sample(docs, "lang", "doc_id", "text", 99).count()
    assert set(model.words) == {"a"} and model.words["a"][0] == pytest.approx(math.log((2 * n + 0.1) / (3 * n + 0.2)))


def test_no_labelled_rows(spark):
    docs = spark.createDataFrame([(1, None, "text")], "doc_id long, lang string, text string")
    assert language.trained(docs).languages == []
