"""Documents with fewer shingles than an item, against all windows."""

import random
from collections import Counter

from tablewarden.llm.decontam import find_leaks
from tests.llm.test_decontam import grams


def brute(docs, items):
    out = {}
    for item, text in items:
        w = text.split()
        width = min(len(w), 5)
        want = Counter(grams(w, width))
        m = sum(want.values())
        for doc, body in docs:
            d = grams(body.split(), width)
            for s in range(max(len(d) - m, 0) + 1):
                have = Counter(d[s : s + m])
                shared, n = sum((want & have).values()), sum(have.values())
                if n and 100 * shared >= 80 * (n + m - shared) and ((doc, item) not in out or shared / (n + m - shared) > out[(doc, item)][2] / out[(doc, item)][3]):
                    out[(doc, item)] = (s, n + width - 1, shared, n + m - shared)
    return out


def test_documents_shorter_than_an_item(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    head = [rng.choice(words) for _ in range(9)]
    items = [(i, " ".join(head * (i % 3 == 0) + [rng.choice(words) for _ in range(rng.choice((9, 10, 14, 40, 70)))])) for i in range(60)] + [(90, "a " * 30 + "b c d e f g")]
    docs = [(0, " ".join(items[0][1].split()[:-1])), (1, "a " * 27 + "b c d e f g"), (2, " ".join(head))]
    for i, (_, text) in enumerate(items):
        for cut in range(5):
            w = text.split()[rng.randrange(cut + 1) :]
            docs.append((100 + 10 * i + cut, " ".join(w[: len(w) - cut])))
        w = text.split()[:-1]
        w[rng.randrange(len(w))] = "changed"
        docs.append((100 + 10 * i + 9, " ".join(w)))
    want = brute(docs, items)
    assert (0, 0) in want and (1, 90) in want and sum(len(dict(docs)[d].split()) < len(dict(items)[i].split()) for d, i in want) > 80
    for size in (32 << 20, 0):
        found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=size)
        assert {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in found.collect()} == want
