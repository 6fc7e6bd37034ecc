"""Hard negatives against every pair of rows, in plain integers."""

import math
import random

from pyspark.sql import functions as F

from tablewarden.llm.negatives import LARGEST, hard_negatives, scaled

SCHEMA = "vec_id long, vector array<double>, label int, items int, path string"


def brute(rows):
    best = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            if all(abs(x) < LARGEST for x in w):
                best[i] = min(best.get(i, (label, w)), (label, w))
    out = []
    for a, (label, v) in best.items():
        if a % 100:
            continue
        scores = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in best.items() if i != a}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        for p in [i for i in order if best[i][0] == label][:5]:
            fits = [i for i in order if best[i][0] != label and 80 * scores[p] <= 100 * scores[i] <= 100 * scores[p]][:5]
            out += [(a, p, k, n, scores[p], scores[n]) for k, n in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives(df.withColumn("vector", scaled(F.col("vector"))), F.col("vec_id") % 100 == 0, **options).collect()))


def unit(rng, d, base=None, spread=1.0):
    v = [rng.gauss(0, spread) + (base[i] if base else 0) for i in range(d)]
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def test_all_pairs_with_small_leaves_and_close_groups(spark):
    rng = random.Random(2)
    hubs = [unit(rng, 8) for _ in range(6)]
    rows = [(i, unit(rng, 8, rng.choice(hubs), 0.05) if rng.random() < 0.7 else unit(rng, 8), rng.randrange(4)) for i in range(-300, 900)]
    got = found(spark, rows, leaf=40, anchor_leaf=3)
    assert got == brute(rows) and len(got) > 100


def test_ties_hot_label_and_copies(spark):
    """Half of the rows are one vector, a third has one label, and all scores tie."""
    rows = [(i, [1.0, 0.5], 0 if i % 3 else i % 7) for i in range(600)] + [(600 + i, [0.5 + i / 1000, -0.25], i % 5) for i in range(500)]
    got = found(spark, rows, leaf=16, anchor_leaf=2)
    assert got == brute(rows) and len(got) > 50


def test_defined_results(spark):
    rng = random.Random(3)
    rows = [(i, unit(rng, 5), i % 3) for i in range(120)]
    rows += [
        (None, unit(rng, 5), 1), (1000, None, 1), (1001, [0.5, None, 0.1, 0.0, 0.0], 1), (1002, [float("nan")] * 5, 2), (1003, [float("inf")] * 5, 0), (1004, unit(rng, 5), None), (1100, [0.9], 1), (1101, [], 2),
        (1102, [1e9, 0.0], 0), (100, unit(rng, 5), 2), (100, unit(rng, 5), 2), (7, *rows[7][1:]), (7, *rows[7][1:]), (-200, [-0.4] * 5, -3), (-201, [-0.3] * 5, -3), (-202, [-0.3] * 5, 61),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, [0.5], 1)]) == [] and found(spark, [(0, [0.5], 1)]) == []
    assert found(spark, [(i, [], i % 2) for i in range(0, 300, 50)]) == brute([(i, [], i % 2) for i in range(0, 300, 50)])


def test_scores_beyond_floating_point(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice((-1, 1)) * (60000 + rng.random() * 5000) for _ in range(40)], i % 2) for i in range(0, 400, 4)]
    assert found(spark, rows, leaf=20) == brute(rows)
