"""Items and texts of great length, and fingerprints by blocks of sums."""

import random

from pyspark.sql import functions as F

from tablewarden.llm.decontam import find_leaks, simhashes


def test_fingerprints_by_blocks_are_those_of_plain_sums(spark):
    df = spark.range(4).select(F.expr("transform(sequence(0, 1499 + int(id)), x -> xxhash64(x % 700, id))").alias("h"), F.expr("array(0, 1, 255, 256, 257, 700)").alias("s"))
    ranges = F.transform("s", lambda s: F.struct(s.alias("first"), F.lit(700).alias("k")))
    pairs = df.select(simhashes(F.col("h"), ranges, F.lit(False)).alias("a"), simhashes(F.col("h"), ranges, F.lit(True)).alias("b"), "h").collect()
    for r in pairs:
        counts = lambda s: [sum(x >> b & 1 for x in r["h"][s : s + 700]) for b in range(64)]
        plain = [sum(1 << b for b, c in enumerate(counts(s)) if 2 * c > 700) for s in (0, 1, 255, 256, 257, 700)]
        assert [x % (1 << 64) for x in r["a"]] == plain and r["a"] == r["b"]


def test_an_item_of_a_hundred_thousand_words(spark):
    """Also one word, over and over: every lane of the counters is as full as it can be."""
    rng = random.Random(2)
    item = [f"w{rng.randrange(10**7)}" for _ in range(100_000)]
    same = ["a"] * 70_000
    docs = [(1, " ".join(item)), (2, " ".join([f"x{i}" for i in range(50)] + item[:99_000] + [f"y{i}" for i in range(2000)])), (3, " ".join(item[:60_000])), (4, " ".join(same + ["b"] * 9)), (5, "a " * 100)]
    found = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item)), (2, " ".join(same))], "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in found.collect()}
    assert rows == {(1, 1): (0, 100_000, 99_996, 99_996), (2, 1): (0, 100_000, 98_996, 2 * 99_996 - 98_996), (4, 2): (0, 70_000, 69_996, 69_996)}
