"""Conversation repair against a search over all cheap edit sequences, and the Viterbi pass at its edges."""

import hashlib
import heapq
import random
import re
from zlib import crc32

from tablewarden.llm import conversations
from tablewarden.llm.conversations import damaged, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, fault int, times string"
EMPTY = hashlib.sha256(b"").hexdigest()


def hurt(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out.setdefault(conv, [])
        if f:
            out[conv] += [(turn, "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text)] * (1 + (f == 3))
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Uniform-cost search over (position, roles' state) by (cost, audit): the first end found is the best."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, lines = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
        if (i, last) in done:
            continue
        done.add((i, last))
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in nexts[last]:
                heapq.heappush(queue, (cost + 5, audit + "I", i, r, (*lines, name + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, last, lines))
            if found[i] not in ("b", "d"):
                more = 5 * (found[i] == "t")
                if role[:1] and role[:1] in nexts[last]:
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in nexts[last]:
                        heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, r, (*lines, f"{name}:{text}")))


def brute(rows):
    out = {}
    for conv, own in hurt(rows).items():
        found = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        pairs = zip(own, own[1:])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(x) for x in "bdt"), illegal, *cheapest(own, found))
    return out


def repaired(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    return {r[0]: tuple(r)[1:] for r in repair_conversations(damaged(df), times_col="times").collect()}


def test_random_conversations_are_those_of_a_full_search(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(400):
        for turn in range(rng.randrange(1, 12)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "User", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "Why?", "so", " ", "", "it is so. \n", "é?", None, f"t{turn}.", f"u{turn}.", f"v{turn}"])
            rows.append((conv, None if rng.random() < 0.05 else turn + 3 * (rng.random() < 0.1), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Hm."), (-4, None, "user", "Hi."), (-4, None, None, None)]
    rows.append(next((c, 0, "user", "gone.") for c in range(1000, 2000) if crc32(f"{c}:0".encode()) % 20 == 0))
    expected = brute(rows)
    assert repaired(spark, rows) == expected
    assert expected[rows[-1][0]] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert set("".join(v[6] for v in expected.values())) == set("DKR")  # an inserted turn costs more than to delete its neighbour


def test_inserts_where_deleting_is_dear(monkeypatch):
    monkeypatch.setattr(conversations, "DELETE", 50)
    for roles, cost, audit, text in (
        (("user",), 5, "KI", "user:x.\nassistant:"), (("assistant",), 5, "IK", "user:\nassistant:x."),
        (("user", "user", "assistant"), 5, "KIKK", "user:x.\nassistant:\nuser:x.\nassistant:x."), ((), 0, "", ""),
    ):
        states = conversations.Viterbi()
        for role in roles:
            states.row(role, "x.", "")
        assert states.end() == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def test_repeated_rows_ties_and_empty_tables(spark):
    rows = [(1, 2, "user", "Hi."), (1, 2, "user", "Hi."), (1, 2, "assistant", "Hi."), (1, 2, "user", "Ho."), (1, 9, "assistant", "x" * 300_000 + ".")]
    assert repaired(spark, rows) == brute(rows)
    assert repair_conversations(damaged(spark.createDataFrame([], SCHEMA)), times_col="times").count() == 0


def test_operator_without_damage_and_with_other_names(spark):
    rows = spark.createDataFrame([("c", 0, "system", "Be kind."), ("c", 1, "user", "Hi."), ("c", 2, "assistant", "Yes.")], "chat string, n int, who string, said string")
    (got,) = repair_conversations(rows, conv_col="chat", turn_col="n", role_col="who", text_col="said").collect()
    assert tuple(got) == ("c", 0, 0, 0, 0, 0, 0, "KKK", hashlib.sha256(b"system:Be kind.\nuser:Hi.\nassistant:Yes.").hexdigest())


def test_one_very_long_conversation(spark):
    """Its audit is cut where the states agree, and the result stays that of the search."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"{i}.") for i in range(30_000)]
    expected = brute(rows)
    got = repaired(spark, rows)
    assert got == expected and len(got[7][6]) > 28_000
