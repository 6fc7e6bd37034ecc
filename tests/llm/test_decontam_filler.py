"""Shortened passages between fillers: whatever stands beside them, none is lost."""

import random
from collections import Counter

from tablewarden.llm.decontam import find_leaks
from tests.llm.test_decontam import grams

FILLERS = (["-"], ["-", "="], "so it is and so it was".split(), None)


def similarity(item, body):
    """The best weighted Jaccard similarity of a window, by sliding."""
    want, d = Counter(grams(item, 5)), grams(body, 5)
    m, size = sum(want.values()), min(sum(want.values()), len(d))
    have = Counter(d[:size])
    best = shared = sum((want & have).values())
    for s in range(1, len(d) - size + 1):
        gone, come = d[s - 1], d[s + size - 1]
        shared -= have[gone] <= want[gone]
        have[gone] -= 1
        have[come] += 1
        shared += have[come] <= want[come]
        best = max(best, shared)
    return best, size + m - best


def test_no_passage_is_lost_beside_repeated_words(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    items = {i: [rng.choice(words) for _ in range((100, 150, 250, 400)[i % 4])] for i in range(16)}
    items[16] = [rng.choice(words) for _ in range(60)] + ["-"] * 40 + [rng.choice(words) for _ in range(60)]  # filler of its own
    items[17] = ["la"] * 80 + [rng.choice(words) for _ in range(90)]
    docs, doc = {}, 0
    for i, item in items.items():
        for filler in FILLERS:
            for lost in (0.0, 0.07, 0.09, 0.1):
                cut = int(len(item) * lost)
                left = rng.randrange(cut + 1)
                part = item[left : len(item) - (cut - left)]
                run = lambda n: (filler * n)[:n] if filler else [rng.choice(words) for _ in range(n)]  # noqa: E731, B023
                for before, after in ((len(item), len(item)), (0, len(item)), (len(item), 0)):
                    docs[doc] = run(before) + part + run(after)
                    doc += 1
    want = {(d, i): got for d, body in docs.items() for i, item in items.items() if set(item) & set(body) and 100 * (got := similarity(item, body))[0] >= 80 * got[1]}
    found = find_leaks(spark.createDataFrame([(d, " ".join(b)) for d, b in docs.items()], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(b)) for i, b in items.items()], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): (r["shared"], r["joined"]) for r in found.collect()}
    assert got == want and len(want) > 700 and {i for _, i in want} == set(items)
