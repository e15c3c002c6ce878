import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestrata.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t", "It's  They'll I'M", "<|startoftext|>hello<|endoftext|> x <|endoftext|>", "éclair É", "ΣΑΣ ΟΔΟΣ", "İstanbul", "a b c\x1cd\x85e", "１２ 3½ ²", "\U0001f600\U0001f600 �", "</w> a</w>b", "x" * 3000, "aaaa bbbb " * 200, "hello" * 300, "ǆ ﬁ ẞ"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def check(library, texts):
    own = bpe.load(PATH)
    want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    got = own.encode_batch([t or "" for t in texts])
    for t, w, g in zip(texts, want, got):
        assert list(memoryview(g).cast("i")) == w.ids, t


def test_odd_texts(library):
    check(library, ODD)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdeinorst' 0!\n")), max_size=40), max_size=4))
def test_any_text(library, texts):
    check(library, texts)


def test_characters_of_other_unicode_versions(library):
    check(library, [":\U0003d000", ":\u0558a", ":\u1c89a \ua7cb"])


def test_every_code_point(library):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    check(library, [" ".join(f":{c}a" for c in points[at : at + 512]) for at in range(0, len(points), 512)])


def test_only_failing_words_are_merged():
    own = bpe.WordBpe(PATH)
    merged = []
    exact = own.merged
    own.merged = lambda s: merged.append("".join(s)) or exact(s)
    words = ["hello", "world", "tokenization", "zzxqj"]
    assert own.encode_words(words) == [bpe.load(PATH).merged([*w[:-1], w[-1] + "</w>"]) for w in words]


def test_round_trip(docs_of, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "x"), (3, "It's  They'll I'M")]
    encoded = bpe.encode(docs_of(rows), PATH)
    got = sorted((r.doc_id or -1, r.text) for r in bpe.decode(encoded, PATH).collect())
    want = sorted((i or -1, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in rows)
    assert got == want
    assert bpe.decode(bpe.encode(docs_of([]), PATH), PATH).count() == 0


def test_documents(documents, library):
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: list(r.ids) for r in bpe.encode(documents, PATH).collect()}
    for r, w in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)):
        assert got[r.doc_id] == w.ids
