"""Quality rules as weak supervision, with built-in expressions only.

Every document gets measures of its whole text.  Rules over the measures vote
good (1) or bad (0) or abstain (null).  The vote patterns are counted (with R
rules there are at most 3**R of them, whatever the corpus); from the counts
expectation-maximisation estimates each rule's accuracy on good and on bad
documents and the share of good ones; the posterior probability of being good
replaces the all-rules-must-pass filter.  A hard base test stays in front.

Scale: no shuffle of texts or documents and none written: one scan counts the
vote patterns, at most 3**R rows, which are also all that the driver sees, and
a second one measures again and judges.  Who wants the verdicts without the
texts keeps what `voted` gives (a few numbers a document) and measures once.

Defined results: a null text counts as empty; without a word every measure is 0
and the base test fails.  Very long texts are measured whole.  Repeated rows are
judged alike.  An empty table gives an empty result.  Columns pass through, but
those the result adds (m, votes, base_failed, quality, kept) and one called v are
replaced.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: The columns of a verdict.
NAMES = ("m", "votes", "base_failed", "quality", "kept")
#: Words without a letter.
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """Votes good where `good` holds, bad where `bad` does, else abstains.

    Both are SQL over the measures, understood alike by Spark and DuckDB.
    """

    name: str
    good: str
    bad: str


RULES = (
    Rule("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("word_length", "word_chars >= 4 * n_words and word_chars <= 7 * n_words", "word_chars < 3 * n_words or word_chars > 10 * n_words"),
    Rule("repeats", "n_repeat_words = 0", "10 * n_repeat_words > n_words"),
    Rule("lines", "n_dup_lines = 0 and n_lines >= 3", "4 * n_dup_lines > n_lines"),
    Rule("variety", "2 * n_distinct >= n_words", "4 * n_distinct < n_words"),
    Rule("capitals", "20 * n_capitals <= word_chars", "4 * n_capitals > word_chars"),
    Rule("length", "n_words >= 50", "n_words < 30"),
    Rule("letters", "20 * n_letters >= 17 * word_chars", "4 * n_letters < 3 * word_chars"),
    Rule("bare", "50 * n_bare <= n_words", "10 * n_bare > n_words"),
    Rule("shouts", "50 * n_shouts <= n_words", "4 * n_shouts > n_words"),
)


def _then(value: Column, use) -> Column:
    """use(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(w: Column, n: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the same text.

    Windows are compared by 64-bit hashes of their words' hashes.  Only texts
    with some repeat sort their windows; equal neighbours are repeats, and the
    union of the intervals at the sorted places is the number of words.
    """
    by_word = F.transform(w, lambda x: F.xxhash64(x))
    hashes = _then(by_word, lambda h: F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.coalesce(F.least(F.lit(window), F.get(places, k + 1) - p), F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def repeats(order: Column) -> Column:
        same = lambda e, k, j: F.coalesce(F.get(order, j)["h"] == e["h"], F.lit(False))
        twice = F.filter(order, lambda e, k: same(e, k, k + 1) | F.coalesce(F.when(k > 0, F.get(order, k - 1)["h"]) == e["h"], F.lit(False)))
        return _then(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

    def of(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_then(order, repeats))

    return F.when(n < window, F.lit(0)).otherwise(_then(hashes, of))


def measures(text: Column) -> Column:
    """Struct of the measures, all long.

    Words and lines are bound inside one expression, so that their arrays are
    never written into rows.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))

    def of(chars: Column, w: Column, found: Column) -> Column:
        fields = {
            "n_words": F.size(w), "word_chars": chars, "n_symbols": count(f"[{SYMBOLS}]"), "n_dup_lines": F.size(found) - F.size(F.array_distinct(found)), "n_repeat_words": repeated_words(w, F.size(w)),
            "n_lines": F.size(found), "n_distinct": F.size(F.array_distinct(w)), "n_capitals": count("[A-Z]"), "n_letters": chars - count(r"[^\p{L}\x20\x09-\x0D]"), "n_bare": count(BARE), "n_shouts": count("[!?]"),
        }
        return F.struct(*[value.cast("long").alias(name) for name, value in fields.items()])

    whole = lambda p: _then(F.array_remove(p, ""), lambda w: _then(lines, lambda found: of(F.length(text) - F.size(p) + 1, w, found)))
    return _then(pieces(text), whole)


def base_failed() -> str:
    return f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"


def estimate(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 20) -> tuple[float, list[tuple[float, float]]]:
    """(share of good, [(P(1 | good, votes), P(0 | bad, votes)] for each rule) from counted vote patterns.

    Starts from rules that are right four times in five.  One pseudo-count on
    either side keeps every estimate inside (0, 1).
    """
    rules = len(patterns[0][0]) if patterns else 0
    share, rates = 0.8, [(0.8, 0.8)] * rules
    for _ in range(rounds):
        p = [(votes, n, posterior(votes, share, rates)) for votes, n in patterns]
        total = sum(n for _, n, _ in p)
        share = (sum(n * q for _, n, q in p) + 1) / (total + 2)
        rates = [
            (
                (sum(n * q for v, n, q in p if v[j] == 1) + 1) / (sum(n * q for v, n, q in p if v[j] is not None) + 2),
                (sum(n * (1 - q) for v, n, q in p if v[j] == 0) + 1) / (sum(n * (1 - q) for v, n, q in p if v[j] is not None) + 2),
            )
            for j in range(rules)
        ]
    return share, rates


def posterior(votes: tuple[int | None, ...], share: float, rates: list[tuple[float, float]]) -> float:
    good, bad = share, 1 - share
    for v, (a, b) in zip(votes, rates, strict=True):
        if v is not None:
            good, bad = good * (a if v else 1 - a), bad * (1 - b if v else b)
    return good / (good + bad)


def _voted(rules: tuple[Rule, ...]) -> Column:
    """(m, votes, base_failed) of `__m`, the measures as an array of one; they stand in one place, so that no rewriting of a plan repeats them."""
    of = lambda sql: re.sub(r"\b(n_\w+|word_chars)\b", r"m.\1", sql)
    votes = ", ".join(f"case when {of(r.bad)} then 0 when {of(r.good)} then 1 end" for r in rules)
    fields = f"named_struct('m', m, 'votes', array({votes}), 'base_failed', {of(base_failed())})"
    return F.get(F.expr(f"transform(__m, m -> {fields})"), F.lit(0))


def voted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` with `v`: m (measures), votes and base_failed."""
    return docs.withColumn("__m", F.array(measures(F.col(text_col)))).withColumn("v", _voted(rules)).drop("__m")


def learn(votes: DataFrame, rounds: int = 20) -> tuple[float, list[tuple[float, float]]]:
    """`estimate` over the counted patterns of `voted` rows that pass the base test."""
    counted = votes.groupBy("v.base_failed", "v.votes").agg(F.count("*").alias("n")).collect()
    return estimate(sorted(((tuple(r["votes"]), r["n"]) for r in counted if not r["base_failed"]), key=str), rounds)


def judged(votes: DataFrame, learned: tuple[float, list[tuple[float, float]]], threshold: float = 0.5) -> DataFrame:
    """`voted` rows with m, votes, base_failed, `quality` (posterior, null where the base test failed) and `kept` in place of v."""
    share, rates = learned

    def of(v: Column) -> Column:
        factor = lambda good: [F.when(v["votes"][j] == 1, F.lit(a if good else 1 - b)).when(v["votes"][j] == 0, F.lit(1 - a if good else b)).otherwise(F.lit(1.0)) for j, (a, b) in enumerate(rates)]
        good, bad = (reduce(operator.mul, factor(g), F.lit(p)) for g, p in ((True, share), (False, 1 - share)))
        quality = F.when(~v["base_failed"], good / (good + bad))
        return _then(quality, lambda q: F.struct(*[v[c].alias(c) for c in NAMES[:3]], q.alias("quality"), F.coalesce(q >= threshold, F.lit(False)).alias("kept")))

    names = [F.col(f"`{c}`") for c in votes.columns if c not in (*NAMES, "v")]
    return votes.withColumn("v", _then(F.col("v"), of)).select(*names, *[F.col("v")[c].alias(c) for c in NAMES])


def judge(docs: DataFrame, *, text_col: str = "text", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, rounds: int = 20) -> DataFrame:
    """`docs` with `m` (measures), `votes`, `base_failed`, `quality` and `kept`, in two scans."""
    texts = docs.select(F.col(text_col).alias("text"))
    return judged(voted(docs, text_col, rules), learn(voted(texts, rules=rules), rounds), threshold)
