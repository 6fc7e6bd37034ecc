"""Near duplicates against all pairs."""

import random
import re

from tablewarden.llm.neardup import CHUNK, near_duplicates, shingle_set, signature

SCHEMA = "doc_id long, text string, n long, rep string, bands int"


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    flat = [(i, s) for i, all_ in sets.items() for s in all_]
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(flat):
        for j, t in flat[a + 1 :]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((30, 80, 200)))]
        for _ in range(rng.choice((1, 2, 15))):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(text)))
    rows += [(900, rows[3][1].upper()), (901, rows[3][1].replace(" ", "\t\n")), (902, None), (903, ""), (904, "  \n"), (905, "a b"), (906, "A\x0bb"), (907, "a b c"), (908, None)]
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = corpus()
    for width in (4, 5):
        expected = brute(rows, width)
        docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
        found = {r["doc_id"]: r for r in near_duplicates(docs, width=width).collect()}
        assert len(found) == len(rows)
        assert {i: r["component_id"] for i, r in found.items()} == expected
        assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())
        assert found[902]["n_shingles"] == 0 and found[905]["component_id"] == 905 and found[906]["component_id"] == 905


def test_hot_group_without_a_common_centre(spark):
    """A ring of texts, each close only to its neighbours, is one component; strangers stay out."""
    words = [f"v{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 100])) for i in range(90)] + [(500 + i, " ".join(f"q{i}_{k}" for k in range(60))) for i in range(5)]
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), pivot_rounds=1).collect()}
    assert found == brute(rows, 5)


def test_repeated_ids_nulls_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (2, text), (2, "other words here now and then"), (None, text), (3, None), (3, None)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == len(rows)
    assert {r["component_id"] for r in found if r["doc_id"] in (1,)} == {1}
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_text_and_similar_signatures():
    s = shingle_set(" ".join(f"w{i % 9973}" for i in range(3 * CHUNK)), 5)
    t = s[: int(len(s) * 0.8)]
    same = (signature(s, 160) == signature(t, 160)).mean()
    assert 0.65 < same < 0.95
