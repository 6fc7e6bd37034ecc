"""One line or one band in a third of all rows; ids that aren't whole numbers."""

import pytest
from pyspark.sql import functions as F

from tablewarden.llm import common
from tablewarden.llm.common import meet
from tablewarden.llm.linededup import LineIndex, dedup_lines
from tablewarden.llm.neardup import near_duplicates


@pytest.mark.parametrize("bound", [1, 3, 50, 10**6])
def test_meet_is_a_join(spark, monkeypatch, bound):
    """Hot keys, others, keys of one side only and null keys, whatever the bound."""
    monkeypatch.setattr(common, "HOT_KEYS", bound)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 400).alias("k"), F.col("id").alias("v")).union(spark.sql("select null, -1L"))
    keys = rows.groupBy("k").agg(F.count("*").alias("size")).filter("k % 2 = 1").union(spark.sql("select 9999L, 1L"))
    found = meet(rows, keys, ["k"], "size", rows.count())
    assert found.columns == ["k", "v", "size"]
    assert sorted(found.collect()) == sorted(rows.join(keys, "k").collect())


def test_no_hot_key_is_shuffled(spark, monkeypatch):
    """The shuffled side of the join holds no key with more than its share, and the broadcast one has fewer than HOT_KEYS rows."""
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    keys, total = rows.groupBy("k").agg(F.count("*").alias("size")), rows.count()
    hot = keys.filter(F.col("size") * common.HOT_KEYS > total).collect()
    assert [r["k"] for r in hot] == [7]
    plan = meet(rows, keys, ["k"], "size", total)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2


@pytest.fixture
def tiny_share(monkeypatch):
    """Bounds so small that both ways of a join are taken."""
    monkeypatch.setattr(common, "HOT_KEYS", 8)


def test_a_line_in_every_document(spark, tiny_share):
    hot, warm = "this line stands in every document", "this line stands in a few of them, too"
    text = lambda i: "\n".join([hot, f"a line of its own, number {i}"] + [warm] * (i % 50 == 0))
    docs = spark.createDataFrame([(i, text(i)) for i in range(600)], "doc_id long, text string")
    want = {i: "\n".join(x for x in text(i).split("\n") if not (x == hot and i != 599 or x == warm and i != 550)) for i in range(600)}
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == want
    index = LineIndex.build(docs)
    fewer = index.delete(docs.filter("doc_id >= 550"))
    kept = {r["doc_id"]: r["text"] for r in fewer.resolve(docs.filter("doc_id < 550")).collect()}
    assert hot in kept[549] and warm in kept[500] and all(hot not in kept[i] for i in range(549))
    assert fewer.counts.agg(F.max("docs")).first()[0] == 550


def test_a_band_in_every_document(spark, tiny_share):
    """Texts that share nearly all words fall into the same buckets; small ids' list is shuffled, too."""
    common_words = " ".join(f"c{k}" for k in range(120))
    rows = [(i, f"{common_words} only{i}") for i in range(400)] + [(1000 + i, " ".join(f"w{i}_{k}" for k in range(30))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for ids in (10**6, 0):
        found = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, broadcast_ids=ids).collect()}
        assert found == {i: 0 for i in range(400)} | {1000 + i: 1000 + i for i in range(200)}


def test_ids_that_are_no_whole_numbers_are_refused(spark):
    docs = spark.createDataFrame([("a", "x y z")], "doc_id string, text string")
    for call in (near_duplicates, dedup_lines):
        with pytest.raises(TypeError, match="doc_id is string"):
            call(docs)
    ints = spark.createDataFrame([(1, "x y z")], "doc_id int, text string")
    assert [r["doc_id"] for r in near_duplicates(ints).collect()] == [1]
