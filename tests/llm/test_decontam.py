"""Decontamination against all windows."""

import random
from collections import Counter

from tablewarden.llm.decontam import find_leaks


def grams(words, width):
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


def brute(docs, items):
    out = {}
    for item, text in items:
        w = (text or "").lower().split()
        width = min(len(w), 5)
        if not w:
            continue
        want = Counter(grams(w, width))
        m = sum(want.values())
        for doc, body in docs:
            d = grams((body or "").lower().split(), width)
            for s in range(len(d) - m + 1):
                have = Counter(d[s : s + m])
                shared = sum((want & have).values())
                if 100 * shared >= 80 * (2 * m - shared):
                    best = out.get((doc, item))
                    if best is None or shared > best[0]:
                        out[(doc, item)] = (shared, s)
    return {k: (s, n) for k, (n, s) in out.items()}


def test_same_leaks_as_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice((3, 6, 12, 40, 70))))) for i in range(25)] + [(90, None), (91, ""), (92, "a a a a a a a a a a"), (93, "same text of six words here"), (94, "same text of six words here")]
    docs = []
    for i in range(60):
        body = [rng.choice(words) for _ in range(rng.randrange(0, 150))]
        if i % 2:
            piece = items[rng.randrange(25)][1].split()
            if i % 4 == 1 and len(piece) > 20:
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() for x in piece]
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "b a a a a a a a a a a a c"), (203, "Same  text\nof six words here."), (204, "x same text of six words here y"), (204, "nothing"), (None, "same text of six words here")]
    found = find_leaks(spark.createDataFrame([(i, t, 1, "u") for i, t in docs], "doc_id long, text string, m int, h string"), spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, g int"))
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["shared"]) for r in found.collect()}
    assert got == brute(docs, items)
    shuffled = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=0)
    assert {(r["doc_id"], r["item_id"]) for r in shuffled.collect()} == set(got)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert find_leaks(docs.limit(0), items).count() == 0
    assert find_leaks(docs, items.limit(0)).count() == 0
    assert find_leaks(docs, items).count() == 1
