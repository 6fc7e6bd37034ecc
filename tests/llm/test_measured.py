"""Trained operators over the driver's tables: floors for what is held out, and plain versions of what they compute."""

import math
import os
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewarden.llm import queries, ranking, secrets
from tablewarden.llm.langid import GRAMS

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGE), reason="needs the driver's tables")


def rows(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


def late(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def letters(text):
    return "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()


def plain_languages(docs):
    """Counts by word and n-gram from all labelled rows, and each text's best language."""
    seen = {(r["doc_id"], r["text"], r["lang"]) for r in docs if not late(r["doc_id"]) and r["lang"] is not None and r["text"] is not None}
    languages = sorted({lang for _, _, lang in seen})
    words, grams = defaultdict(Counter), {n: defaultdict(Counter) for n in GRAMS}
    for _, text, lang in seen:
        for w in letters(text):
            words[w][lang] += 1
            for n in GRAMS:
                for i in range(len(w) + 3 - n):
                    grams[n][f" {w} "[i : i + n]][lang] += 1
    total = lambda table: {lang: sum(c[lang] + 0.5 for c in table.values()) for lang in languages}
    sums, gram_sums = total(words), {n: total(grams[n]) for n in GRAMS}
    logs = lambda counts, t: [math.log((counts[lang] + 0.5) / t[lang]) for lang in languages]

    def of(w):
        if w in words:
            return logs(words[w], sums)
        for n in GRAMS:
            known = [logs(grams[n][g], gram_sums[n]) for g in (f" {w} "[i : i + n] for i in range(len(w) + 3 - n)) if g in grams[n]]
            if known:
                return [sum(x) / len(known) for x in zip(*known, strict=True)]
        return [0.0] * len(languages)

    def best(text):
        found = Counter(letters(text))
        if not found:
            return "und", 0.0
        points = [sum(n * s for n, s in zip(found.values(), column, strict=True)) for column in zip(*map(of, found), strict=True)]
        top = max(points)
        return languages[points.index(top)], 1 / sum(math.exp(p - top) for p in points)

    return {r["doc_id"]: best(r["text"]) for r in docs}


def test_languages_are_those_of_a_plain_predictor(spark):
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op6_language_id(spark, SMALL).collect()}
    want = plain_languages(rows(spark, SMALL, "documents"))
    assert found.keys() == want.keys()
    assert all(found[i][0] == want[i][0] and abs(found[i][1] - want[i][1]) < 1e-6 for i in want)


def test_languages_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in rows(spark, LARGE, "documents") if r["lang"] is not None and r["text"]}
    judged = [(truth[r["doc_id"]], r["lang_pred"]) for r in queries.op6_language_id(spark, LARGE).collect() if r["held_out"] and r["doc_id"] in truth]
    assert len(judged) > 100 and sum(a == b for a, b in judged) / len(judged) >= 0.98


def test_quality_held_out(spark):
    truth = {r["doc_id"]: r["quality"] for r in rows(spark, LARGE, "labels") if r["quality"] is not None}
    judged = [(truth[r["doc_id"]], r["score"], r["predicted"]) for r in queries.op10_quality_classifier(spark, LARGE).collect() if r["held_out"] and r["doc_id"] in truth]
    good, bad = [s for y, s, _ in judged if y], [s for y, s, _ in judged if not y]
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert len(bad) > 5 and auc >= 0.97 and sum(y == p for y, _, p in judged) / len(judged) >= 0.95


def test_quality_scores_are_those_of_plain_features(spark):
    """The features of every text, counted in plain Python, and the worth that the weights give them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = ranking.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    k = len(model.mean)

    def features(text):
        t = text or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x.strip(" ")]
        n, each = len(w), lambda a, b: a / max(b, 1)
        count = lambda chars: sum(t.count(c) for c in chars)
        alpha, upper, digits = sum(c.isalpha() for c in t), sum(__import__("unicodedata").category(c) == "Lu" for c in t), sum(c.isdecimal() for c in t)
        log = math.log1p
        return [
            log(n), each(alpha, n), log(20 * each(count("#*$%&<>"), n)), log(20 * each(count("|"), n)), log(20 * each(upper, alpha)), log(20 * each(digits, len(t))), log(20 * each(count("!?"), n)),
            each(count(".,;:"), n), each(len(set(w)), n), 1 - each(len(set(lines)), len(lines)), log(each(n, len(lines))), each(alpha, len(t)),
        ]

    for r in ranking.score(docs, model).collect():
        z = [max(-ranking.CLIP, min(ranking.CLIP, (x - m) / d)) for x, m, d in zip(features(r["text"]), model.mean, model.deviation, strict=True)]
        worth = sum(v * model.weights[j] + v * v * model.weights[k + j] for j, v in enumerate(z))
        assert abs(r["score"] - 1 / (1 + math.exp(-(worth - model.bar + math.log(model.cut / (1 - model.cut)))))) < 1e-9, r["doc_id"]


def test_rules_keep_what_is_labelled_good(spark):
    truth = {r["doc_id"]: r["quality"] for r in rows(spark, LARGE, "labels") if r["quality"] is not None}
    judged = [(truth[r["doc_id"]], r["kept"]) for r in queries.op3_quality_rules(spark, LARGE).collect() if r["doc_id"] in truth and not r["base_failed"]]
    good, bad = [k for y, k in judged if y], [k for y, k in judged if not y]
    assert len(good) > 100 and sum(good) / len(good) >= 0.97 and sum(bad) / len(bad) <= 0.15


def test_planted_secrets_are_found(spark):
    """Exactly the texts with a quoted token; the forest's score is that of its own single prediction for plain candidates."""
    texts = {r["doc_id"]: r["text"] for r in rows(spark, LARGE, "documents")}
    planted = {i for i, t in texts.items() if re.search(r'(?i)token\s*[=:]\s*"[0-9a-f]{40}"', t or "")}
    found = queries.op1_secret_scan(spark, LARGE).collect()
    assert planted and {r["doc_id"] for r in found if r["is_secret"]} == planted
    pattern = re.compile(secrets.CANDIDATE)
    assert Counter(r["doc_id"] for r in found) == Counter({i: n for i, t in texts.items() if (n := len(pattern.findall(t or "")))})


def test_forest_scores_row_by_row(spark):
    forest = secrets.fit(secrets.labelled_findings(spark, 1400))
    judged = forest.score(secrets.labelled_findings(spark, 210))
    vectors = judged.select("score", F.array(*secrets.features().values()).alias("x")).collect()
    assert len(vectors) > 150
    assert all(abs(r["score"] - forest.model.predictProbability(Vectors.dense(r["x"]))[1]) < 1e-9 for r in vectors)
