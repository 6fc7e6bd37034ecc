"""Line dedup against a plain version, and its reversibility."""

import random

import numpy as np
import pytest

from tablewarden.llm import linededup
from tablewarden.llm.linededup import CuckooFilter, LineIndex, dedup_lines

BLANK = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute(rows, min_docs=3, min_chars=20):
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            key = lower(line.strip(BLANK))
            if len(key) >= min_chars and i is not None:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = lambda x: len(holders.get(lower(x.strip(BLANK)), ())) >= min_docs and max(holders[lower(x.strip(BLANK))]) != i
        kept = [x for x in lines if not gone(x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    lines = [f"Line number {k} of a long éßtext {k}" for k in range(30)] + ["short", "", "  x  "]
    rows = [(i, "\n".join(rng.choice(("", " ", "\t")) + rng.choice(lines) + rng.choice(("", "\r")) for _ in range(rng.randrange(1, 12)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, lines[0].upper()), (103, "\n\n")]


def result(df):
    return sorted(((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in df.collect()), key=str)


def test_same_as_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in rows], "doc_id long, text string, k1 string, n_lines long")
    assert result(dedup_lines(docs)) == brute(rows)
    assert result(dedup_lines(docs, broadcast_bytes=0)) == brute(rows)


def test_insert_and_delete_are_as_if_never(spark):
    rows = corpus()
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    index = LineIndex.build(frame(rows[:30]))
    index = index.insert(frame(rows[30:])).delete(frame(rows[10:20]))
    rest = rows[:10] + rows[20:]
    assert result(index.resolve(frame(rest))) == brute(rest)
    counts = {(r["k1"], r["k2"]): (r["docs"], r["last"]) for r in index.counts.collect()}
    again = {(r["k1"], r["k2"]): (r["docs"], r["last"]) for r in LineIndex.build(frame(rest)).counts.collect()}
    assert counts == again


def test_known_ids_repeated_rows_and_growing_shards(spark, monkeypatch):
    """An id that comes again is the same document, and shards and postings follow the number of keys and insertions."""
    frame = lambda part: spark.createDataFrame(part, "doc_id long, text string")
    line = "a line of more than twenty characters"
    index = LineIndex.build(frame([(1, line), (1, line), (2, line)])).insert(frame([(1, line), (2, f"{line}\n{line} two")]))
    assert sorted(r["docs"] for r in index.counts.collect()) == [1, 2]
    monkeypatch.setattr(linededup, "SHARD_KEYS", 8)
    monkeypatch.setattr(linededup, "PARTS", 2)
    rows = [(i, "\n".join(f"line {i % 7 * 40 + k} with more than twenty characters" for k in range(40))) for i in range(30)]
    index = LineIndex.build(frame(rows[:1]).limit(0))
    for i in range(0, 30, 10):
        index = index.insert(frame(rows[i : i + 10]))
    assert index.shards >= 16 and index.parts < 3
    assert result(index.resolve(frame(rows))) == brute(rows)
    assert result(index.delete(frame(rows[:10] + [(999, "")])).resolve(frame(rows[10:]))) == brute(rows[10:])


def test_empty_table_and_null_ids(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    line = "a line of more than twenty characters"
    rows = [(1, line), (2, line), (3, line), (None, line)]
    found = {r["doc_id"]: r["n_dropped"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 0, None: 1}


@pytest.mark.parametrize("n", [0, 1, 5_000])
def test_cuckoo_filter_finds_what_it_holds_and_forgets(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
    made = linededup._filled(keys)
    assert made.contains(keys).all() if n else not made.used
    half = keys[: len(keys) // 2]
    again = CuckooFilter(raw=made.dump())
    again.delete(half)
    assert again.contains(keys[len(half) :]).all() if n else True
    assert again.used == len(keys) - len(half)
    assert n < 10 or again.contains(half).mean() < 0.01
