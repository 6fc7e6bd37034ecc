"""URL filter, revisits, language identification, ranking and secrets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.llm import langid, ranking, secrets
from tablewarden.llm.revisits import canonical, resolve_revisits
from tablewarden.llm.common import Scratch
from tablewarden.llm.urlfilter import candidates, cascade, judge_urls, then

RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:end]), path[:stop]


def verdict(url, listed):
    host, path = split(url)
    fits = lambda key: (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(*((key.partition("/")[0], "/" + key.partition("/")[2]) if "/" in key else (key, "")))
    rule = max((r for r in RULES if fits(r)), key=len, default=None)
    return host, path, rule, RULES[rule] if rule else "block" if any(map(fits, listed)) else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://com", "HTTP://A.COM/", "http://example.com/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://b.example.com/en", "http://x.net/es/1", "http://x.net/es",
    "http://x.net?/es/", "http://net/fr/", "http://notnet/fr/", "a://b://c.com/", "http://bad.org/x", "http://sub.bad.org", "http://notbad.org/", "http://ÄB.Net/fr/\nx", "http://bad.org:80/",
]


def test_url_verdicts_are_those_of_a_plain_loop(spark):
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(('a', 'b', 'www'))}.host{rng.randrange(400)}.{rng.choice(('org', 'net', 'info'))}/{rng.choice(('es', 'fr', 'p'))}/{i}" for i in range(2000)]
    listed = ["bad.org"] + [f"host{i}.org" for i in range(0, 400, 3)] + [f"host{i}.info/p/" for i in range(0, 400, 5)]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key int")
    rules, keys = spark.createDataFrame(list(RULES.items()), "key string, verdict string"), spark.createDataFrame([(k,) for k in listed], "key string")
    for size in (1 << 22, 150):  # one round, and several
        found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules, keys, table_bytes=size).collect()}
        assert found == {i: verdict(u, listed) for i, u in enumerate(urls)}
    assert judge_urls(pages.limit(0), rules, keys).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), keys.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact_on_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(key) % 40 = 0")
    made = cascade(listed, universe.subtract(listed), Scratch(spark))
    assert len(made.levels) > 1
    found = universe.filter(then(made.table(), lambda w: made.holds(F.col("key"), w)))
    assert {r["key"] for r in found.collect()} == {r["key"] for r in listed.collect()}
    assert sum(x.bits for x in made.levels) < 20_000
    assert universe.limit(1).select(candidates(F.lit("a.b.c"), F.lit("/x/y"), [1, 3, 9], [0, 2, 9])).first()[0] == ["c", "c/x", "a.b.c", "a.b.c/x"]


def records(spark, rows):
    return spark.createDataFrame([(*r, "pad") for r in rows], "record_id long, record_type string, url string, captured_at long, headers map<string,string>, part string")


def test_revisits_are_resolved_as_of_their_time(spark):
    rows = [
        (1, "response", "http://www.A.com/x/?b=2&utm_source=q&a=1#f", 10, {"ETag": '"1"', "Content-Type": "t", "Date": "d1"}), (2, "revisit", "https://a.com/x?a=1&b=2", 20, {"etag": 'W/"1"', "Date": "d2", "Content-Length": "0", "DATE": "d3"}),
        (3, "revisit", "https://a.com/x?a=1&b=2", 10, {}), (4, "response", "http://a.com/x?a=1&b=2", 30, {"Last-Modified": "m"}), (5, "response", "http://a.com:80/x?a=1&b=2", 30, None), (6, "revisit", "http://a.com/x?a=1&b=2", 31, {"last-modified": "n"}),
        (7, "revisit", "http://b.com/", 5, {}), (8, "revisit", None, 5, {}), (9, "revisit", "http://a.com/x?a=1&b=2", None, {}), (10, "request", "http://a.com", 1, {}), (11, "revisit", "http://a.com/x?a=1&b=2", 15, {"etag": '"2"'}),
    ]
    found = {r["record_id"]: r for r in resolve_revisits(records(spark, rows)).collect()}
    status = {i: (r["status"], r["response_id"]) for i, r in found.items()}
    assert status == {1: ("full", None), 2: ("resolved", 1), 3: ("no_response", None), 4: ("full", None), 5: ("full", None), 6: ("resolved", 5), 7: ("no_response", None), 8: ("invalid", None), 9: ("invalid", None), 11: ("mismatch", None)}
    assert found[2]["headers"] == {"etag": 'W/"1"', "content-type": "t", "date": "d2"}
    assert resolve_revisits(records(spark, rows).limit(0)).count() == 0


def test_hot_url_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(i, "response" if rng.random() < 0.1 else "revisit", "http://a.com/" if rng.random() < 0.8 else f"http://b.com/{rng.randrange(3)}", rng.randrange(500), {}) for i in range(1500)]
    found = {r["record_id"]: r["response_id"] for r in resolve_revisits(records(spark, rows), partitions=9).collect()}
    for i, kind, url, at, _ in rows:
        earlier = [(t, j) for j, k, u, t, _ in rows if k == "response" and u == url and t < at]
        assert found[i] == (max(earlier)[1] if earlier and kind == "revisit" else None)


def test_canonical_urls(spark):
    of = lambda u: spark.range(1).select(canonical(F.lit(u))).first()[0]
    assert of("http://WWW.X.com:443/a/b/?z=1&ref=2&y=#q?r=1") == "x.com/a/b?y=&z=1" and of("x.com") is None and of(None) is None and of("http://x.com#?a=1") == "x.com"


def test_languages_are_told_apart_by_words_then_grams(spark):
    stems = {"aa": "lopa tiru mena soka".split(), "bb": "strch gnirf whump zdrok".split()}
    rng = random.Random(4)
    text = lambda lang: " ".join(rng.choice(stems[lang]) + rng.choice(("", "s", "an")) for _ in range(20))
    rows = [(i, text(lang), lang) for i in range(60) for lang in ("aa", "bb")] + [(900, "x", None), (901, None, "aa")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(1, "Lopa lopas", 0), (2, "lopax mirutin", 0), (3, "gnirfwhump, zdro", 0), (4, None, 0), (5, "12 _ 3!", 0), (6, "", 0), (7, "½ ²", 0), (8, "Ⅷ", 0), (9, "½lopa²Ⅷ", 0)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string, score int"), model).collect()}
    assert [found[i][0] for i in range(1, 10)] == ["aa", "aa", "bb", "und", "und", "und", "und", "und", "aa"] and found[7][1] == 0
    assert all(0 <= s <= 1 for _, s in found.values())
    assert np.allclose(model.of_word("lopa"), model.word_scores[model.words["lopa"]])
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.identify(spark.createDataFrame(tests, "doc_id long, text string, score int"), nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def test_pairs_give_a_ranking(spark):
    rng = random.Random(6)
    good = lambda: " ".join(f"word{rng.randrange(500)}" for _ in range(60))
    bad = lambda: " ".join(f"w#{rng.randrange(9)}|" for _ in range(30))
    docs = spark.createDataFrame([(i, good() if i % 4 else bad(), "z", i) for i in range(400)] + [(900, None, "z", 0), (901, "", "z", 0)], "doc_id long, text string, score string, predicted long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(None, 1), (2, None), (5000, 1)], "doc_id long, quality int")
    fitted = ranking.fit(docs, labels)
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in ranking.score(docs, fitted).collect()}
    assert np.mean([found[i][1] == (i % 4 > 0) for i in range(1, 400, 2)]) > 0.97
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for s, p in found.values())
    one = ranking.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in ranking.score(docs, one).collect()} == {1.0}
    assert {r["score"] for r in ranking.score(docs, ranking.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_bradley_terry_recovers_weights():
    rng = np.random.default_rng(0)
    truth = np.array([1.5, -2.0, 0.0])
    a, b = rng.normal(size=(4000, 3)), rng.normal(size=(4000, 3))
    first = rng.random(4000) < 1 / (1 + np.exp(-(a - b) @ truth))
    w = ranking.bradley_terry(np.where(first[:, None], a, b), np.where(first[:, None], b, a), penalty=1e-6)
    assert np.abs(w - truth).max() < 0.15


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.fit(secrets.labelled_findings(spark, 2800))


def test_forest_tells_secrets_from_harmless_strings(spark, forest):
    held = secrets.labelled_findings(spark, 4200).filter(F.xxhash64("candidate") % 3 == 0)
    judged = forest.score(held).select("is_secret", "score").toPandas()
    assert ((judged.score >= 0.5) == (judged.is_secret == 1)).mean() > 0.95
    texts = [
        (1, 'x token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" y'), (2, "see commit b44e15e09fd311c3cf3163b66d5a9875b883d8ce now"), (3, "id: 123e4567-e89b-12d3-a456-426614174000, ok"), (4, None), (5, ""), (6, "no digits inthiswordhere"),
        (7, 'A!! TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'), (8, 'api_key: "your_api_key_here_1234"'),
    ]
    found = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame([(i, t, "p", 1) for i, t in texts], "doc_id long, text string, path string, score int"), forest, path_col="path").collect()}
    assert {i: r["is_secret"] for i, r in found.items()} == {1: True, 2: False, 3: False, 7: True, 8: False}
    assert found[1]["candidate"].startswith("b44e") and found[1]["place"] == 0


def test_candidates_with_their_neighbours(spark):
    text = "aaaaaaaaaaaaaaa1b first, then AAAA1111BBBB2222== and AAAA1111BBBB2222"
    rows = secrets.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("place").collect()
    assert [(r["place"], r["candidate"], r["before"], r["after"]) for r in rows] == [
        (0, "aaaaaaaaaaaaaaa1b", "", " first, then "), (1, "AAAA1111BBBB2222==", " first, then ", " and "), (2, "AAAA1111BBBB2222", " and ", ""),
    ]


def test_findings_of_one_kind_and_too_many(spark):
    rows = secrets.labelled_findings(spark, 140)
    only = secrets.fit(rows.filter("is_secret = 1"))
    assert {r["score"] for r in only.score(rows.limit(3)).collect()} == {1.0}
    with pytest.raises(ValueError):
        secrets.fit(rows, fit_rows=10)
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string"), only).count() == 0
