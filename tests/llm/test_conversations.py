import hashlib
import heapq
import re
import zlib

import pytest

from lodestrata.llm import conversations, queries

FIRST = {"s": 1, "u": 2, "a": 3}
LEGAL = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(rows):
    """(cost, audit, repaired lines) by a search over (row, state), least cost first, then least audit."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, at, state, lines = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, letters, "\n".join(lines)
        for role in ("user", "assistant"):
            if (state, role[0]) in LEGAL:
                heapq.heappush(heap, (cost + 3, letters + "I", at, LEGAL[state, role[0]], (*lines, role + ":")))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 4, letters + "D", at + 1, state, lines))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if (state, role[:1]) in LEGAL:
                heapq.heappush(heap, (cost + more, letters + "K", at + 1, LEGAL[state, role[:1]], (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                if (state, new[0]) in LEGAL:
                    heapq.heappush(heap, (cost + more + 3, letters + "R", at + 1, LEGAL[state, new[0]], (*lines, f"{new}:{text}")))


def plain(table):
    """The contract row by row."""
    after = {}
    for conv, turn, role, text in table:
        rows = after.setdefault(conv, [])
        shown = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = "user" if kind == 4 else shown[2], {1: "", 2: re.sub("[.!?]", "", shown[3])}.get(kind, shown[3])
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = {}
    for conv, rows in after.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, told = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            told.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, text = cheapest(told)
        faults = [sum(f == k for _, _, f in told) for k in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def found(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pos int").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[1:]) for r in got}


def test_the_whole_table(spark, sf_dir):
    table = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op11_conversation_repair(spark, sf_dir)
    assert {r.conv_id: tuple(r[1:]) for r in got.collect()} == plain(table)


def test_all_kinds_of_rows(spark, tmp_path):
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    texts = ["Yes.", "No", None, " \t\n", "Really?! ", "a.\x85", "Yes.", "long " * 5000 + "end.", "é…", "."]
    rows = [(c, t, roles[(c * 7 + t * t + c // 3) % (3 if c % 2 else 7)], texts[(c + t * 3 + c * t) % 10]) for c in range(150) for t in range(c % 9)]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hello."), (None, None, None, None), (500, None, "user", "Hi."), (501, 5, "user", "Hi."), (501, 5, "user", "Hi."), (501, 5, "assistant", "Hi."), (501, -9, "system", "S.")]
    rows += [(600, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(900)]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_empty_and_dropped(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, tmp_path / "one", [(gone, 0, "user", "Hi.")]) == {gone: nothing}
    assert found(spark, tmp_path / "none", []) == {}


@pytest.mark.parametrize("signature", ["", "x", "u", "ua", "sua", "a", "uu", "Ua", "uaA", "ous", "xuxaX".replace("X", "x"), "aauuoSsUA"])
def test_cost_of_a_signature(spark, signature):
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    rows = [(names[c.lower()], "t", "blank" if c == "x" else "truncated" if c.isupper() else None) for c in signature]
    row = conversations.audits(spark.createDataFrame([(signature,), (signature,)], "sig string")).collect()
    assert [(r.cost, r.audit) for r in row] == [cheapest(rows)[:2]]


def test_nodes_are_shared():
    reader = conversations.Automaton()
    for sig in sorted(("suaua", "uaua", "ua", "xua", "ouaua", "ua"), key=lambda s: s[::-1]):
        reader.read(sig)
    assert reader.made == 7  # a, ua, aua, uaua, suaua, xua, ouaua
