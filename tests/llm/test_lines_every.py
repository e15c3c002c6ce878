import re

from lodestrata.llm import lines

#: Few fixed tokens, no blanks, more fields than fixed tokens; each recurs as a whole.
SHORT = ["All rights reserved.", "Licensed under CC BY-NC 4.0.", "版权所有，保留一切权利。", "a 1 b 2 c 3 d 4 e 5 6 7", "#"]


def takes_part_whole(line):
    """Whether a line has too few fixed tokens for a template, told without the tree."""
    tokens = line.split()
    fixed = sum(not re.search("[0-9]", t) for t in tokens)
    return bool(tokens) and (fixed < 5 or 2 * fixed < len(tokens))


def brute(rows):
    """The texts without the lines that hold the tokens of an earlier document's line, for lines that take part whole."""
    where = {}
    for i, t in sorted(rows):
        for n, line in enumerate(t.split("\n")):
            if takes_part_whole(line):
                where.setdefault(tuple(line.split()), []).append((i, n))
    gone = {at for places in where.values() if len({i for i, _ in places}) > 1 for at in places[1:]}
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_every_line_takes_part(docs_of):
    rows = [(i, "\n".join([*SHORT, "", f"total {i}", f"1 2 3 4 5 6 {i}", f"own{i}", "twice" if i == 3 else "", "twice" if i == 3 else ""])) for i in range(4)]
    got = {r.doc_id: r.text for r in lines.without_recurring_lines(docs_of(rows), every=True).collect()}
    assert got == brute(rows)
    assert all(s in got[0] and s not in got[i].split("\n") for s in SHORT for i in (1, 2, 3))


def test_every_line_of_documents(documents):
    """Lines with a template are left to the other tests: only those that take part whole are compared."""
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if r.text is not None]
    want = brute(rows)
    for r in lines.without_recurring_lines(documents, every=True).where("text is not null").collect():
        assert [x for x in r.text.split("\n") if takes_part_whole(x)] == [x for x in want[r.doc_id].split("\n") if takes_part_whole(x)]


def test_the_query_drops_short_lines(spark, docs_of, tmp_path):
    from lodestrata.llm import queries

    docs_of([(1, SHORT[0]), (2, SHORT[0])]).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.lines_dropped for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}


def test_lines_that_begin_with_a_sign_share_templates(docs_of):
    tail = "the annual report of the team {} was filed again today in full"
    for sign in ("*", "=", "=="):
        rows = [(i, f"{sign} {tail.format(name)}\n= 1\nown{i}") for i, name in enumerate(("alpha", "bravo", "carol"))]
        got = {r.doc_id: r.text for r in lines.without_recurring_lines(docs_of(rows), every=True).collect()}
        assert got == {0: rows[0][1], 1: "own1", 2: "own2"}, sign
