"""A language model beyond its bound in bytes stays a table and judges alike."""

import random

import pytest

from tablewarden.llm import langid

SYLLABLES = {"aa": "ka to mi ra ne so".split(), "bb": "sch ung ein ver ach lo".split(), "cc": "ño ll que ça ão ri".split()}


def text(random_, lang, words):
    made = lambda: "".join(random_.choices(SYLLABLES[lang], k=random_.randint(1, 4)))
    return " ".join(["the", *(made() for _ in range(words))])


def judged(spark, docs, model):
    return sorted(((r["doc_id"], r["note"], r["lang_pred"], round(r["score"], 9)) for r in langid.identify(docs, model).collect()), key=str)


@pytest.fixture(scope="module")
def learned(spark):
    random_ = random.Random(6)
    rows = [(i, text(random_, lang, 12), lang) for i, lang in enumerate(list(SYLLABLES) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return langid.fit(docs), langid.fit(docs, model_bytes=1000)


def test_both_ways_judge_alike(spark, learned):
    small, large = learned
    assert isinstance(small, langid.Model) and isinstance(large, langid.TableModel) and large.languages == small.languages
    random_ = random.Random(7)
    rows = [(i, text(random_, random_.choice(list(SYLLABLES)), random_.randint(0, 9)), "x") for i in range(150)]
    odd = [None, "", "12 ½ Ⅷ", "the", "The THE the " * 3000, "λόγος жук", "q" * 20_000, "kato schung ñoll", "ka\nto\tmi", "é", "a"]
    rows += [(1000 + i // 2, t, None) for i, t in enumerate(odd)] + rows[:5] + [(None, "kami", "y")]
    docs = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, note string, score int, lang_pred string").repartition(5)
    found = judged(spark, docs, large)
    assert found == judged(spark, docs, small) and len(found) == len(rows)
    assert langid.identify(docs, large).columns == langid.identify(docs, small).columns


def test_empty_tables(spark, learned):
    docs = spark.createDataFrame([], "doc_id long, text string, note string")
    assert judged(spark, docs, learned[1]) == []


def test_tables_go_when_the_model_is_forgotten(spark):
    docs = spark.createDataFrame([(1, "kato", "aa"), (2, "ung", "bb")], "doc_id long, text string, lang string")
    model = langid.fit(docs, model_bytes=0)
    assert model.scores.count() > 0
    model.forget()
    with pytest.raises(Exception, match="(?i)path|file"):
        spark.read.parquet(model.scores.inputFiles()[0]).count()
