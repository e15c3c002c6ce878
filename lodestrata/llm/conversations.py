"""Repair of conversations: the cheapest edits that bring the roles into a legal order.

A row's signature is one character: its role's initial and its fault. The signatures of
all conversations form an automaton that is shared from the end: a node stands for one
distinct rest of a signature, whichever conversations have it. What a rest costs, and the
first edit of its cheapest repair, is computed once for a node and a state of the grammar
`(s?(ua)+)?`. The signatures are dealt and sorted by their reversed text, so that those
which share a node are neighbours: each node is made once, and a task holds a single path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_if, map_batches, staged

#: The characters that count as space, and those that end a complete text.
SPACE, ENDS = " \t\n\x0b\f\r", ".!?"
#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows and characters of distinct signatures up to which their audits are broadcast.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 8_000_000

#: States: 0 nothing yet, 1 after a system row, 2 after a user row, 3 after an assistant row; 0 and 3 are complete.
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: From each state, where its only legal row of user or assistant leads, and that row's role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")


def _settled(direct: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """The states' cheapest (cost, first edit) when rows may be inserted too; a tie goes to the smaller letter."""
    best, before = list(direct), None
    while best != before:
        before = list(best)
        best = [min(b, (best[_NEXT[s]][0] + INSERT, "I")) for s, b in enumerate(best)]
    return best


#: The end of every signature. A state that isn't complete has no edit there but insertions.
_OPEN = (1 << 60, "~")
END = _settled([(0, ""), _OPEN, _OPEN, (0, "")])


def node(symbol: str, rest: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(cost, first edit) of each state for a row with this symbol before `rest`."""
    role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    direct = []
    for state in range(4):
        found = [(DELETE + rest[state][0], "D")]
        if symbol != "x":
            found.append((REROLE + more + rest[_NEXT[state]][0], "R"))
            if (state, role) in _AFTER:
                found.append((more + rest[_AFTER[state, role]][0], "K"))
        direct.append(min(found))
    return _settled(direct)


class Automaton:
    """The part of the automaton that the signature read last runs through; `path[d]` is the node of its last d symbols.

    Read in the order of their reversed text, signatures find all nodes they share with any before on the path.
    """

    def __init__(self) -> None:
        self.path, self.last, self.made = [END], "", 0

    def read(self, signature: str) -> tuple[int, str]:
        """Cost and audit (the letters of the edits) of the cheapest repair."""
        rev, same = signature[::-1], 0
        while same < min(len(rev), len(self.last)) and rev[same] == self.last[same]:
            same += 1
        del self.path[same + 1 :]
        for symbol in rev[same:]:
            self.path.append(node(symbol, self.path[-1]))
        self.last, self.made = rev, self.made + len(rev) - same
        return self.path[-1][0][0], self._audit(signature)

    def _audit(self, signature: str) -> str:
        out, state, left = [], 0, len(signature)
        while edit := self.path[left][state][1]:
            out.append(edit)
            if edit != "I":
                symbol, left = signature[len(signature) - left].lower(), left - 1
            if edit in "IR":
                state = _NEXT[state]
            elif edit == "K":
                state = _AFTER[state, symbol]
        return "".join(out)


def audits(signatures: DataFrame) -> DataFrame:
    """sig, cost and audit of each distinct value of column `sig`; see the module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Automaton()
        for batch in batches:
            found = [reader.read(sig) for sig in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["sig", "cost", "audit"])

    distinct = signatures.select("sig").distinct()
    dealt = distinct.repartitionByRange(F.reverse("sig")).sortWithinPartitions(F.reverse("sig"))
    return map_batches(dealt, run, "sig string, cost long, audit string")


def judged(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1, by turn, nulls first, then role and text), turn, role, text, initial, fault and symbol of each row.

    Faults: blank, duplicate (role and text seen earlier in the conversation), truncated
    (the last character that is no space isn't one of `.!?`), else null; the first that
    holds counts. Null roles and texts are one space. Both windows number rows as they
    stream by, over one shuffle by conversation.
    """
    one = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy("pos")) > 1
    body = F.rtrim("text", F.lit(SPACE))
    fault = F.when(body == "", "blank").when(F.col("seen"), "duplicate").when(~F.right(body, F.lit(1)).isin(*ENDS), "truncated")
    rows = rows.withColumn("seen", seen).withColumn("initial", F.substring("role", 1, 1)).withColumn("fault", fault)
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(role)).otherwise(role)
    return rows.select("conv_id", "pos", "turn", "role", "text", "initial", "fault", symbol.alias("symbol"))


def summaries(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, the counts of each fault, illegal (adjacent roles out of order) and sig of each conversation of `judged` rows."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    pair = F.concat(F.lag("initial").over(order), F.col("initial"))
    fresh = F.col("turn").isNotNull() & ~F.lag("turn").over(order).eqNullSafe(F.col("turn"))
    told = rows.select("conv_id", "pos", "turn", "fault", "symbol", (~pair.isin("su", "ua", "au")).alias("illegal"), fresh.alias("fresh"))
    counts = [F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("fresh"), F.lit(0)).cast("long")
    letters = F.array_sort(F.collect_list(F.struct("pos", "symbol")))
    return told.groupBy("conv_id").agg(gaps.alias("gaps"), *counts, F.count_if(F.coalesce("illegal", F.lit(False))).alias("illegal"), F.array_join(F.transform(letters, lambda x: x["symbol"]), "").alias("sig"))


def audited(summary: DataFrame) -> DataFrame:
    """`summaries` with the cost and audit of each conversation's signature."""
    found = staged(audits(summary), "audits")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("sig") + F.length("audit")), F.lit(0)).alias("chars")).first()
    few = size.n if size.chars <= BROADCAST_CHARS else BROADCAST_ROWS + 1
    return summary.join(broadcast_if(found, few, BROADCAST_ROWS), "sig").drop("sig")


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, step (from 1), edit (K, R or I), role and text of the repaired conversations.

    `plans` has the audit of each conversation of the `judged` rows. It comes as the first
    row of its conversation, and the rows stream by it in order: a task holds a batch and
    one audit, however long a conversation is.
    """
    both = rows.select("conv_id", "pos", "role", "text").unionByName(plans.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text")))
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(n, t) for n, t in (("step", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, at, state, step, out = "", 0, 0, 0, []

        def fill(conv) -> None:  # the insertions that come next
            nonlocal at, state, step
            while plan[at : at + 1] == "I":
                step += 1
                out.append((conv, step, "I", _ROLE[state], ""))
                at, state = at + 1, _NEXT[state]

        for batch in batches:
            out = []
            for conv, pos, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if pos == 0:
                    plan, at, state, step = text, 0, 0, 0
                    fill(conv)
                    continue
                edit = plan[at]
                at += 1
                if edit != "D":
                    step += 1
                    kept = role if edit == "K" else _ROLE[state]
                    out.append((conv, step, edit, kept, text))
                    state = _AFTER[state, role[:1]] if edit == "K" else _NEXT[state]
                fill(conv)
            arrays = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()))], schema.names)

    return map_batches(both.repartition("conv_id").sortWithinPartitions("conv_id", "pos"), run, schema)


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and sha256 (lowercase hex of `role:text` joined by newlines) of conversations whose rows stream by in order, as from `repaired`."""
    schema = T.StructType([turns.schema["conv_id"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, kind = None, None, None

        def batch_of(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([h for _, h in done], pa.string())], schema.names)

        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for conv, step, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "step", "role", "text"))):
                if step == 1:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield batch_of(done)
        if digest is not None:
            yield batch_of([(last, digest.hexdigest())])

    return map_batches(turns, run, schema)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of conversations with columns conv_id, turn, role and text.

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, one
    row for each conversation; the turns are those of `repaired`. Null ids are one
    conversation, null roles and texts one space; null turns come first and count for no
    gap; rows that repeat are duplicates; an empty text is blank; roles that begin with
    none of s, u and a can't be kept. A text of any length streams by. Further columns are
    left out, and an empty table gives two empty ones.
    """
    rows = staged(judged(turns), "judged")
    report = staged(audited(summaries(rows)), "report")
    return report, repaired(rows, report)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of conversations after a damage told by crc32(`conv_id:turn`) % 20, nulls as one space.

    0 drops a row, 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 makes its role user.
    """
    one = F.lit(" ")

    def shown(name: str) -> Column:
        return F.coalesce(conversations[name].cast("string"), one)

    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn")).cast("binary")) % 20
    rows = conversations.select(conversations["conv_id"], conversations["turn"], shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
