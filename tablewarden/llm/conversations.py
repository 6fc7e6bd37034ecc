"""Repair of conversations: the cheapest edits that give every conversation a legal order of turns.

Method: a forward Viterbi pass over the rows of one conversation and four states
of the grammar ``(s?(ua)+)?``: nothing yet, after the system's turn, after the
user's, after the assistant's.  A state carries the least (cost, audit string)
that reaches it.  A row is kept (0), gets another role (1) or is deleted (2);
after each row the layer is closed by the transitions that insert a turn (5
each, two at most, since three states lie on the way).

The rows of a conversation are brought together by one shuffle, marked where
role and text came earlier (a window over the same partitions), sorted, and then
streamed: the pass holds four states and no rows.  A state also carries the
running SHA-256 of what it would write, so no text is looked at twice.  What the
states' audits share is set aside as it grows.  A conversation with a large part
of all rows is therefore read by one task, in bounded memory but for its audit,
which is part of the result.

Audits compare by code point.  Of two audits with equal cost neither is a prefix
of the other (each letter beyond a common prefix costs something), so the least
prefix gives the least whole.

Defined results: nulls in role and text are one space.  Rows with equal turns
stand by role and then by text; null turns come first.  A null conversation id
is a conversation of its own.  Columns with other names are ignored.  A
conversation whose rows all count zero times has zeros, an empty audit and the
hash of the empty string; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SEPARATORS

#: The costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: States from which a role may follow, and the state after it.
STEPS = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
LEGAL = {"su", "ua", "au"}
#: Audits longer than this are cut where all states agree.
AGREED = 4096
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) with faults chosen by CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops the row (times 0), 1 empties its text, 2 removes its ``.!?``, 3 puts
    it twice, 4 makes it the user's.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = or_space("text")
    return rows.select(
        "conv_id", "turn",
        F.when(fault == 4, F.lit("user")).otherwise(or_space("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("times"),
    )


class Viterbi:
    """The states of one conversation: (cost, audit, SHA-256 so far, whether a line was written), None where unreached."""

    def __init__(self) -> None:
        self.agreed: list[str] = []
        self.states: list = [(0, "", hashlib.sha256(), False), None, None, None]
        self._close([(0, "", self.states[START], ()), None, None, None])

    def _close(self, best: list) -> None:
        """Insert turns where that is cheapest, then write the lines of each state's way: best holds (cost, audit, from, lines)."""
        for _ in range(2):
            for (before, after), line in ((STEPS["u"], b"user:"), (STEPS["a"], b"assistant:")):
                for q in before:
                    if best[q] is not None:
                        cost, audit, origin, lines = best[q]
                        way = (cost + INSERT, audit + "I", origin, (*lines, line))
                        if best[after] is None or way[:2] < best[after][:2]:
                            best[after] = way
        # every way on from the start or the system's turn goes on from the assistant's too, for 2 more at most (a system row is deleted)
        if (a := best[ASSISTANT]) is not None:
            if best[START] is not None and best[START][0] > a[0] + DELETE:
                best[START] = None
            if best[SYSTEM] is not None and best[SYSTEM][0] > a[0]:
                best[SYSTEM] = None
        self.states = [None if x is None else (x[0], x[1], *self._written(x[2], x[3])) for x in best]

    @staticmethod
    def _written(origin: tuple, lines: tuple) -> tuple:
        _, _, digest, begun = origin
        if lines:
            digest = digest.copy()
            digest.update((b"\n" if begun else b"") + b"\n".join(lines))
        return digest, begun or bool(lines)

    def row(self, role: str, text: str, fault: str) -> None:
        best: list = [None] * 4
        body = text.encode("utf-8", "surrogatepass")

        def offer(after: int, way: tuple) -> None:
            if best[after] is None or way[:2] < best[after][:2]:
                best[after] = way

        for q, state in enumerate(self.states):
            if state is not None:
                offer(q, (state[0] + DELETE, state[1] + "D", state, ()))
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            for initial, cost, letter, name in ((role[:1], 0, "K", role), ("u", REROLE, "R", "user"), ("a", REROLE, "R", "assistant")):
                before, after = STEPS.get(initial, ((), START))
                for q in before:
                    if (state := self.states[q]) is not None:
                        offer(after, (state[0] + cost + more, state[1] + letter, state, (name.encode("utf-8", "surrogatepass") + b":" + body,)))
        self._close(best)
        if any(len(x[1]) > AGREED for x in self.states if x is not None):
            shared = len(os.path.commonprefix([x[1] for x in self.states if x is not None]))
            self.agreed.append(next(x[1] for x in self.states if x is not None)[:shared])
            self.states = [x and (x[0], x[1][shared:], *x[2:]) for x in self.states]

    def end(self) -> tuple[int, str, str]:
        cost, audit, digest, _ = min((self.states[q] for q in (START, ASSISTANT) if self.states[q] is not None), key=lambda x: x[:2])
        return cost, "".join([*self.agreed, audit]), digest.hexdigest()


class _Conversation:
    """Counts and states of the conversation being read; rows come by turn."""

    def __init__(self, key) -> None:
        self.key, self.viterbi = key, Viterbi()
        self.low = self.high = self.before = None
        self.turns, self.counts = 0, dict.fromkeys("bdti", 0)

    def row(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + role[:1] not in LEGAL:
            self.counts["i"] += 1
        self.before = role[:1]
        self.viterbi.row(role, text, fault)

    def result(self) -> tuple:
        cost, audit, digest = self.viterbi.end()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *(self.counts[x] for x in "bdti"), cost, audit, digest)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now = None
    for batch in batches:
        for key, turn, role, text, fault, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or key != now.key:
                if now is not None:
                    yield now.result()
                now = _Conversation(key)
            for i in range(times):
                now.row(turn, role, text, "d" if i and fault != "b" else fault)
    if now is not None:
        yield now.result()


def repair_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conversation.

    `times_col` says how often a row stands there, one after the other; a row
    with 0 only names its conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
        (F.coalesce(F.col(times_col), F.lit(0)) if times_col else F.lit(1)).cast("int").alias("times"),
    ).repartition("conv_id")
    there = F.col("times") > 0
    earlier = Window.partitionBy("conv_id", there, "role", "text").orderBy(F.col("turn").asc_nulls_first())
    last = F.right(F.rtrim("text", F.lit(SEPARATORS)), F.lit(1))
    fault: Column = F.when(last == "", "b").when(F.row_number().over(earlier) > 1, "d").when(~last.isin(".", "!", "?"), "t").otherwise("")
    ordered = own.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "fault", "times")
    ordered = ordered.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "fault")
    schema = T.StructType([T.StructField("conv_id", own.schema["conv_id"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    names = schema.names
    kinds = [pa.int64()] * len(COUNTS) + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def noted(source):
            nonlocal kind
            for batch in source:
                kind = batch.schema.field(0).type
                yield batch

        def packed(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *kinds], strict=True)], names)

        found = []
        for x in _read(noted(batches)):
            found.append(x)
            if len(found) == 1024:
                yield packed(found)
                found = []
        if found:
            yield packed(found)

    return ordered.mapInArrow(run, schema)
