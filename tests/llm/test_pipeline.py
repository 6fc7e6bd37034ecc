"""The pipeline's stages against their operators and a brute-force run."""

import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_linededup, test_neardup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, m string, n_lines long, target int, cut int, passes int, source_size int, copies int, copy int, kept int, v int, place int, row int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    words = lambda i, n: " ".join(f"word{(i * 37 + k * 11) % 1999}" for k in range(n))
    rows = [(i, f"{words(i, 70)}\nA line that many documents share in full.\n{words(i + 500, 40)}") for i in range(24)]
    rows += [(50 + i, rows[i][1] + " more") for i in range(4)]
    rows += [(70, f"{words(900, 30)} {words(3000, 60)} {words(901, 30)}"), (71, "### !! " * 40), (72, None), (73, "too short")]
    docs = spark.createDataFrame([(i, t, "en", ("a", None)[i % 2], 1, "m", 2, *[3] * 10) for i, t in rows], COLUMNS)
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, words(3000, 60))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base, rows


def test_stages_in_turn(spark, folder):
    base, rows = folder
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "benchmark decontamination", "source mix"]
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    (_, quality), (_, lines), (_, near), (_, clean), (_, mix) = corpus_pipeline.STAGES
    a = quality(spark, docs, base)
    kept = {r["doc_id"]: r["text"] for r in a.collect()}
    assert a.columns == columns and set(kept) == {i for i, _ in rows} - {71, 72, 73}
    b = lines(spark, a, base)
    assert b.columns == columns and {(r["doc_id"], r["text"]) for r in b.collect()} == {(i, t) for i, t, _, _ in test_linededup.brute(list(kept.items()))}
    c = near(spark, b, base)
    parents = test_neardup.brute([(r["doc_id"], r["text"]) for r in b.collect()], 5)
    assert c.columns == columns and {r["doc_id"] for r in c.collect()} == {i for i, p in parents.items() if i == p}
    d = clean(spark, c, base)
    leaks = {i for i, _ in test_decontam.brute([(r["doc_id"], r["text"]) for r in c.collect()], [(1, " ".join(f"word{(3000 * 37 + k * 11) % 1999}" for k in range(60)))])}
    assert leaks == {70} and {r["doc_id"] for r in d.collect()} == {r["doc_id"] for r in c.collect()} - leaks
    assert d.filter("m = 'm' and n_lines = 2").count() == d.count()
    e = mix(spark, d, base)
    assert {r["doc_id"] for r in e.collect()} <= {r["doc_id"] for r in d.collect()} and e.columns == [*[c for c in columns if c not in ("copies", "copy")], "copies", "copy"]
    assert e.filter("target + cut + passes + source_size + kept + v + place + row = 24").count() == e.count() and e.filter("copy <= copies").count() == e.count()
    whole = corpus_pipeline.run(spark, base)
    key = lambda r: (r["doc_id"], r["copy"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, e.collect()))


def test_empty_table(spark, folder, tmp_path):
    base, _ = folder
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{base}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
