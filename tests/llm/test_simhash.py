"""SimHash components against all pairs of fingerprints, computed bit by bit."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewarden.llm.common import Scratch
from tablewarden.llm.neardup import components
from tablewarden.llm.simhash import CHUNK, fingerprint, linked_fingerprints, simhash_duplicates
from tests.test_log_sorts import plans

SCHEMA = "doc_id long, text string, fp long, label int"


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    hashes = [xxhash.xxh64(" ".join(w[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(keys):
    """{key: smallest key within reach} of links at 3 bits or fewer."""
    keys, parent = list(keys), {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def expected(rows):
    own = [(i, plain_fingerprint(t)) for i, t in rows]
    label, low = classes({f for _, f in own}), {}
    for i, f in own:
        if i is not None:
            low[label[f]] = min(i, low.get(label[f], i))
    return sorted(((i, f"{f:016x}", low.get(label[f])) for i, f in own), key=str)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, t, 3, 4) for i, t in rows], SCHEMA)
    return sorted(map(tuple, simhash_duplicates(df, **options).collect()), key=str)


def test_documents_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(15):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((2, 40, 300)))]
        for _ in range(rng.choice((1, 3, 25))):
            text = list(base)
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) + 1, " ".join(text)))
    rows += [(-5, rows[30][1].upper()), (900, rows[30][1].replace(" ", "\t\n")), (901, None), (902, ""), (903, " \x0b"), (904, "a b"), (904, "É b c d"), (None, rows[3][1]), (None, "alone in the world")]
    assert found(spark, rows) == expected(rows)
    assert len({c for _, _, c in expected(rows)}) < 0.8 * len(rows)


def near(rng, base, bits, n, low=0, high=64):
    return {base ^ sum(1 << b for b in rng.sample(range(low, high), rng.randrange(bits + 1))) for _ in range(n)}


@pytest.mark.parametrize("bucket", (4, 128))
def test_links_of_fingerprints_with_dense_groups(spark, bucket):
    """Groups that fill lists on every level, chains, and pairs with their bits in either half."""
    rng = random.Random(bucket)
    keys = {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
    for low, high in ((0, 64), (0, 32), (32, 64), (0, 16), (48, 64), (8, 16)):
        keys |= near(rng, rng.getrandbits(64), 6, 150, low, high)
    for _ in range(40):
        keys |= near(rng, rng.getrandbits(64), 4, 3)
    at = rng.getrandbits(64)
    for _ in range(60):  # a chain
        at ^= sum(1 << b for b in rng.sample(range(64), 3))
        keys.add(at)
    signed = lambda k: k - (1 << 64) if k >> 63 else k
    labels = {r["fp"] % 2**64: r["label"] for r in linked_fingerprints(spark.createDataFrame([(signed(k),) for k in keys], "fp long"), Scratch(spark), bucket).collect()}
    right, groups = classes(keys), {}
    for k in keys:
        groups.setdefault(labels[k], set()).add(right[k])
    assert len(labels) == len(keys) and len(groups) == len(set(right.values())) and all(len(g) == 1 for g in groups.values())


def test_one_group_of_copies_and_of_near_copies(spark):
    """A third of all rows each: rows made follow the fingerprints, not their pairs."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(400)]
    rows = [(i, "same text for all of them") for i in range(400)]
    for i in range(400):
        text = list(base)
        text[rng.randrange(400)] = "x"
        rows.append((1000 + i, " ".join(text)))
    rows += [(5000 + i, " ".join(rng.choice(base) for _ in range(30))) for i in range(300)]
    assert found(spark, rows, bucket=16) == expected(rows)


def test_long_texts_and_empty_tables(spark):
    text = " ".join(f"w{i % 977}" for i in range(CHUNK + 500))
    assert fingerprint(text) == plain_fingerprint(text) and fingerprint("A") == plain_fingerprint("a")
    assert found(spark, []) == []


def test_hash_is_that_of_spark(spark):
    text = "It was so."
    (row,) = spark.range(1).select(F.xxhash64(F.lit("it was so.")).alias("h")).collect()
    assert fingerprint(text) == row["h"] % 2**64


def test_nothing_is_broadcast(spark):
    """Spark takes 66 probes a fingerprint for one; neither they nor labels, links and components go through the driver."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"v{rng.randrange(400)}" for _ in range(30)) + " x y" * (i % 2)) for i in range(400)] + [(1000 + i, "same words " * 9 + f"w{i % 3}") for i in range(50)]
    ran = plans(spark, lambda: found(spark, rows))
    assert any("SortMergeJoin" in p for p in ran) and not [p for p in ran if re.search(r"\bBroadcast\w+", p)]
    links = spark.createDataFrame([(i, i + 1) for i in range(99)], "a long, b long")
    ran = plans(spark, lambda: components(links, Scratch(spark)).collect())
    assert any("SortMergeJoin" in p for p in ran) and not [p for p in ran if re.search(r"\bBroadcast\w+", p)]
