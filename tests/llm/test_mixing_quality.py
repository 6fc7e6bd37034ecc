"""Mixing by hash thresholds and quality rules, against plain versions."""

import hashlib
import re

from pyspark.sql import functions as F

from tablewarden.llm.mixing import mix, mix_documents
from tablewarden.llm.quality import RULES, estimate, judge, posterior


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), ("a", "b", "c", None)[0 if i % 3 == 0 else i % 4], i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place long")
    first, _ = mix(docs)
    found = {r["doc_id"]: r for r in first.collect()}
    again = {r["doc_id"]: r for r in mix(docs, broadcast_sources=0)[0].collect()}
    assert found == again and len(found) == 600
    for source in ("a", "b", "c", None):
        own = [r for r in found.values() if r["source"] == source]
        size, target, taken = sum(r["size"] for r in own), own[0]["target"], sum(r["taken"] for r in own)
        assert own[0]["source_size"] == size and target - 40 <= taken <= target + 1e-6
        assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in own)
        place = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
        extra = [r for r in sorted(own, key=lambda r: place(r["doc_id"])) if r["size"]]
        copies = [r["copies"] for r in extra]
        assert copies == sorted(copies, reverse=True)
    assert abs(sum({r["source"]: r["target"] for r in found.values()}.values()) - 1.5 * sum(r["size"] for r in found.values())) < 1e-6
    clashing = docs.withColumns({c: F.lit(7) for c in ("target", "cut", "passes", "source_size", "size", "copies", "row")})
    mixed = mix_documents(clashing)
    assert mixed.columns == [c for c in clashing.columns if c != "copies"] + ["copies"]
    assert {(r["doc_id"], r["copies"]) for r in mixed.filter("target + cut + passes + source_size + size + row = 42").collect()} == {(i, r["copies"]) for i, r in found.items()}


def test_mix_of_nothing_and_of_empty_texts(spark):
    schema = "doc_id long, text string, source string"
    assert mix(spark.createDataFrame([], schema))[0].count() == 0
    rows = mix(spark.createDataFrame([(1, None, "a"), (1, "", None), (None, "x y", "b"), (None, "x y", "b")], schema))[0].collect()
    assert sorted(r["size"] for r in rows) == [0, 0, 2, 2] and all(r["taken"] == 0 for r in rows if not r["size"])


def brute_measures(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t", "one", "a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h", "x " * 40, "The quick brown fox jumps.\n" * 4 + "end", "### $$$ %%% é ß 漢字 😀 word", "a\x0bb\x0cc\rd\n\ne\n e\ne",
    " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i % 13}" for i in range(60)), "b c d e f g h i j k " + " ".join(f"z{i}" for i in range(30)) + " b c d e f g h i j k",
]


def test_measures_are_those_of_a_plain_version(spark):
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(TEXTS)], "doc_id long, text string, m string, votes int")
    for r in judge(docs).collect():
        m = r["m"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute_measures(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]
        assert r["base_failed"] == (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_follow_the_estimated_posterior(spark):
    good = [(i, " ".join("wxyz" + chr(97 + (i * 31 + k * 7) % 23) + chr(97 + (i + k) % 25) for k in range(80)) + "\nsecond line\nthird line") for i in range(40)]
    bad = [(100 + i, " ".join(f"wo### %%{(i * 31 + k * 7) % 997} &&!!" for k in range(80))) for i in range(10)]
    rows = judge(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in rows)
    counted = {}
    for r in rows:
        if not r["base_failed"]:
            counted[tuple(r["votes"])] = counted.get(tuple(r["votes"]), 0) + 1
    share, rates = estimate(sorted(counted.items(), key=str))
    assert all(abs(posterior(tuple(r["votes"]), share, rates) - r["quality"]) < 1e-9 for r in rows if not r["base_failed"])
    assert 0 < share < 1 and len(rates) == len(RULES)
    assert judge(spark.createDataFrame([], "doc_id long, text string")).filter(F.col("kept")).count() == 0
