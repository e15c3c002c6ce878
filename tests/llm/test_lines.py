from lodestrata.llm import lines

BOILER = "Released under the open License today."


def after(docs_of, rows):
    return {r.doc_id: r for r in lines.without_recurring_lines(docs_of(rows)).collect()}


def test_recurring_lines_stay_once(docs_of):
    got = after(docs_of, [(1, f"one two three\n{BOILER}\nlast"), (2, f"{BOILER}\nmy own words are here now"), (3, BOILER), (4, "nothing else in this one at all")])
    assert got[1].text == f"one two three\n{BOILER}\nlast" and got[2].text == "my own words are here now" and got[3].text == "" and got[4].lines_dropped == 0
    assert (got[2].lines_before, got[2].lines_dropped) == (2, 1)


def test_fields_and_templates(docs_of):
    rows = [(i, f"Request {i} from host h{i} took {i * 7} ms and was served by worker alpha in zone {z}") for i, z in enumerate(["east", "west", "north"])]
    got = after(docs_of, rows)
    assert [got[i].lines_dropped for i in range(3)] == [0, 1, 1]


def test_repeats_within_one_document_stay(docs_of):
    got = after(docs_of, [(1, f"{BOILER}\n{BOILER}"), (2, "short line here"), (3, "short line here"), (4, "1 2 3 4 5 6 7"), (5, "1 2 3 4 5 6 8")])
    assert sum(r.lines_dropped for r in got.values()) == 0


def test_edges(docs_of):
    long = " ".join(f"word{i % 7}x" if i % 2 else "plain" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, BOILER), (3, BOILER), (3, BOILER), (4, long), (5, long), (6, "\n\n")]
    got = lines.without_recurring_lines(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[6] == ["\n\n"] and by[3] == [BOILER, BOILER] and by[None] == [""]
    assert by[4] == [long]
    assert lines.without_recurring_lines(docs_of([])).count() == 0


def test_same_by_shuffle(docs_of, monkeypatch):
    rows = [(1, f"{BOILER}\nx"), (2, f"{BOILER}\ny"), (3, "z")]
    want = {i: r.text for i, r in after(docs_of, rows).items()}
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert {i: r.text for i, r in after(docs_of, rows).items()} == want


def plain(rows):
    """Line dedup in loops over tokens, without hashes, codes or anything else of the operator."""

    def lines_of(text):
        for n, line in enumerate(text.split("\n")):
            tokens = [None if any(c in "0123456789" for c in t) else t for t in line.split()]
            fixed = len(tokens) - tokens.count(None)
            if fixed >= 5 and 2 * fixed >= len(tokens):
                yield n, tuple(tokens)

    leaves, where = {}, {}
    distinct = {t for _, text in rows for _, t in lines_of(text)}
    for line in sorted(distinct, key=lambda t: "\n".join("\0" if x is None else x for x in t).encode()):
        own = leaves.setdefault((len(line), line[:3]), [])
        agree = [sum(a == b and a is not None for a, b in zip(line, template)) for _, template in own]
        if agree and max(agree) >= max(5, 0.8 * sum(x is not None for x in line)):
            name, template = own[agree.index(max(agree))]
            template[:] = [a if a == b else None for a, b in zip(line, template)]
        else:
            name = line
            own.append((name, list(line)))
        where[line] = name
    first, docs = {}, {}
    for i, text in sorted(rows):
        for n, line in lines_of(text):
            first.setdefault(where[line], (i, n))
            docs.setdefault(where[line], set()).add(i)
    out = {}
    for i, text in rows:
        gone = {n for n, line in lines_of(text) if len(docs[where[line]]) > 1 and first[where[line]] != (i, n)}
        out[i] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    return out


def test_lines_that_differ_in_a_fixed_token_stay(docs_of):
    """Five fixed tokens must agree in all five; words that share a byte of their hash once passed for equal."""
    rows = [(i, f"the due payment was {w}") for i, w in enumerate(["bace", "beci", "xyzzy", *(f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst")])]
    got = after(docs_of, rows)
    assert {i: r.text for i, r in got.items()} == dict(rows) == plain(rows)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, BOILER, 7, "x"), (2, BOILER, 8, "y")], "doc_id long, text string, lines_before int, lines_dropped string")
    got = {r.doc_id: (r.lines_before, r.lines_dropped) for r in lines.without_recurring_lines(docs).collect()}
    assert got == {1: (1, 0), 2: (1, 1)}


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.text is not None]
    got = {r.doc_id: r.text for r in lines.without_recurring_lines(documents).collect()}
    assert got == plain(rows)
