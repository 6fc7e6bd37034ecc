"""Large buckets of texts just below the similarity, and the first look by signatures."""

import random

import numpy as np
from pyspark.sql import functions as F

from tablewarden.llm import neardup
from tablewarden.llm.common import shared_dir
from tablewarden.llm.neardup import alike, near_duplicates, nibbles, shingle_set, signature


def test_thousands_of_texts_just_below_the_similarity(spark):
    """Any two share 85 of 115 words, so nearly every bucket holds them all and nothing links but the planted pairs."""
    common = [f"c{k}" for k in range(85)]
    text = lambda i: " ".join(common + [f"u{i}_{k}" for k in range(15)])
    rows = [(i, text(i)) for i in range(2500)] + [(5000 + i, text(i * 7) + " more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, width=1).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found == {i: i for i in range(2500)} | {5000 + i: i * 7 for i in range(40)}


def test_shingles_of_a_large_group_do_not_become_rows(spark, monkeypatch):
    """600 texts share 85 words and have 15 of their own: rows are made of the latter."""
    common = [f"c{k}" for k in range(85)]
    text = lambda i: " ".join(common + [f"u{i}_{k}" for k in range(15)])
    rows = [(i, text(i)) for i in range(600)] + [(1000 + i, text(i * 7) + " more") for i in range(40)]
    made, write = [], neardup.Scratch.write

    def watched(self, df, label):
        out = write(self, df, label)
        if label == "items":
            made.append((out.count(), out.groupBy("item").count().filter(F.col("count") <= neardup.RARE).count()))
        return out

    monkeypatch.setattr(neardup.Scratch, "write", watched)
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert found == {i: i for i in range(600)} | {1000 + i: i * 7 for i in range(40)}
    assert made and all(0 < rare and n < 640 * 30 for n, rare in made)


def test_hot_shingles_are_none_of_the_rare_ones(spark):
    sets = [(i, [1, 2, 10 + i] + ([3] if i < neardup.RARE else [])) for i in range(40)]
    df = spark.createDataFrame(sets, "rep long, items array<long>").coalesce(1)
    assert sorted(neardup._hot_items(df, sum(len(s) for _, s in sets)).first()["hot"]) == [1, 2]
    assert neardup._hot_items(df.limit(0), 0).first()["hot"] == [] and neardup._hot_items(df, 40 * neardup.HOT_KEYS).first()["hot"] == []


def test_signatures_pass_what_is_similar(spark):
    rng = random.Random(3)
    rows = []
    for n in (5, 40, 400):
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            for share in (1.0, 0.9, 0.8, 0.3):
                other = words[: round(n * share)]
                rows.append((share, *[nibbles(signature(shingle_set(" ".join(t), 1), 160)).tolist() for t in (words, other)]))
    df = spark.createDataFrame(rows, "share double, a array<long>, b array<long>").withColumn("ok", alike(F.col("a"), F.col("b"), 160, 80).cast("double"))
    rates = {r["share"]: r["rate"] for r in df.groupBy("share").agg(F.avg("ok").alias("rate")).collect()}
    assert rates[1.0] == rates[0.9] == rates[0.8] == 1.0 and rates[0.3] < 0.05


def test_scratch_tables_go(spark):
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(shared_dir(spark))
    names = lambda: {p.getPath().getName() for p in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    spark.range(1).write.mode("overwrite").parquet(f"{shared_dir(spark)}/first")
    before = names()
    rows = near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f g"), (3, "x")], "doc_id long, text string"))
    assert {n.rsplit("-", 5)[0] for n in names() - before} == {"members", "labels"}
    assert rows.count() == 3 and np.all([r["kept"] for r in rows.collect()])
