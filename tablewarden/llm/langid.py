"""Language identification with word-first backoff.

A document's words are runs of letters in lower case.  A word that training saw
is scored by its log frequency in each language.  Any other word falls back to
its character n-grams, the longest first: the mean log frequency of those of its
n-grams (padded with a blank at both ends) that training knows, at the greatest
length where it knows any.  Scores add up over all words; the language with the
highest one wins.

Training counts words and n-grams with Spark over a bounded sample of labelled
texts: about `fit_rows` of each language, chosen by hash of id and text, repeated
rows once.  The model keeps all their words and n-grams.  Its size is measured
before the driver sees it.  Up to `model_bytes` it is broadcast, and prediction is
one narrow scan of Arrow batches over whole texts.  Beyond that it stays a table:
the words of all texts meet it in shuffled joins, those that many texts hold by a
broadcast of bounded size (`common.meet`), and each distinct word is scored once.
Both ways give the same rows, scores but for rounding.

Defined results: null texts and those without a letter (digits, numerals like
roman or fraction characters and marks are none) are ``und`` with score 0, as are
all texts if nothing was learned.  Equal scores go to the language that sorts
first.  Very long texts are counted whole.  Repeated rows are judged alike.  Empty
tables give empty results.  Columns pass through, but lang_pred and score are
replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, meet

FIT_ROWS = 2_000
#: Largest model that is broadcast, and what an entry takes in it beside its key and 8 bytes a language.
MODEL_BYTES, ENTRY_BYTES = 256 << 20, 120
GRAMS = (5, 4, 3, 2, 1)
#: Unseen words kept with their score in one task.
CACHE = 100_000
LETTERS = re.compile(r"[^\W\d_]+")  # and other numerals than digits, which `letter_words` cuts out
UNDETERMINED = "und"


def letter_words(text: str | None) -> Counter[str]:
    """Runs of letters (Unicode's categories L) in lower case, counted."""
    found = Counter(LETTERS.findall((text or "").lower()))
    for word in [w for w in found if not w.isalpha()]:
        n = found.pop(word)
        for part in "".join(c if c.isalpha() else " " for c in word).split():
            found[part] += n
    return found


@dataclass(frozen=True)
class Model:
    languages: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    word_scores: np.ndarray
    gram_scores: dict[int, np.ndarray]

    def of_word(self, word: str) -> np.ndarray:
        """Log frequency of one word in each language."""
        at = self.words.get(word)
        if at is not None:
            return self.word_scores[at]
        padded = f" {word} "
        for n in GRAMS:
            known = [self.grams[n][g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in self.grams[n]]
            if known:
                return self.gram_scores[n][known].mean(axis=0)
        return np.zeros(len(self.languages))


@dataclass(frozen=True)
class TableModel:
    """A model too large to broadcast: scores by kind (0 for words, else the length of n-grams) and key."""

    languages: list[str]
    scores: DataFrame
    scratch: Scratch

    def forget(self) -> None:
        """Delete its table; no result that reads it may be pending."""
        self.scratch.clear()


class Scorer:
    """A model with a bounded table of the scores of words met so far; one for each task."""

    def __init__(self, model: Model, room: int = CACHE):
        self.model = model
        self.at = dict(model.words)
        self.limit = len(self.at) + room
        self.table = np.vstack([model.word_scores.reshape(len(self.at), -1), np.zeros((room, len(model.languages)))]) if model.languages else np.zeros((0, 0))

    def _row(self, word: str) -> np.ndarray | int:
        """The row of a new word in the table, or its scores where the table is full."""
        found = self.model.of_word(word)
        if len(self.at) >= self.limit:
            return found
        row = self.at[word] = len(self.at)
        self.table[row] = found
        return row

    def predict(self, text: str | None) -> tuple[str, float]:
        words = letter_words(text)
        if not words or not self.model.languages:
            return UNDETERMINED, 0.0
        rows, extra = list(map(self.at.get, words)), 0.0
        counts = np.fromiter(words.values(), float, len(words))
        if None in rows:
            for i, word in enumerate(words):
                if rows[i] is None:
                    rows[i] = found = self._row(word)
                    if not isinstance(found, int):
                        extra = extra + counts[i] * found
                        rows[i], counts[i] = 0, 0.0
        total = counts @ self.table[rows] + extra
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.model.languages[best], float(odds[best] / odds.sum())


def _letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def _cut(n: int) -> Column:
    """The n-grams of `key`, padded with a blank at both ends, as often as they stand there."""
    padded = F.concat(F.lit(" "), F.col("key"), F.lit(" "))
    starts = F.filter(F.sequence(F.lit(1), F.length("key") + 2), lambda i: i <= F.length("key") + 3 - n)
    return F.transform(starts, lambda i: F.substr(padded, i, F.lit(n)))


def _indexed(counts: DataFrame, languages: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Index of the keys of `counts` (key, n), and their smoothed log relative frequencies by language."""
    table = counts.select("key", "n").toArrow().sort_by("key")
    seen = table["n"].combine_chunks().flatten().to_numpy().reshape(-1, len(languages)) + 0.5
    return {k: i for i, k in enumerate(table["key"].to_pylist())}, np.log(seen / seen.sum(axis=0, keepdims=True))


def _scored(counts: DataFrame, languages: list[str]) -> DataFrame:
    """(kind, key, scores): what `_indexed` gives, for all kinds and without the driver."""
    sums = counts.groupBy("kind").agg(F.array(*[F.sum(F.get("n", F.lit(i)) + 0.5) for i in range(len(languages))]).alias("sums"))  # a row a kind
    return counts.join(sums, "kind").select("kind", "key", F.zip_with("n", "sums", lambda n, of_all: F.log((n + 0.5) / of_all)).alias("scores"))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, model_bytes: int = MODEL_BYTES) -> Model | TableModel:
    """Learn from the rows of `docs` that have a language and a text."""
    labelled = docs.select(F.xxhash64(F.lit(6), F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {n: {} for n in GRAMS}, np.zeros((0, 0)), {n: np.zeros((0, 0)) for n in GRAMS})
    share = F.element_at(F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, fit_rows / sizes[lang]))]), F.col("lang"))
    sample = labelled.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).dropDuplicates(["lang", "h"])
    scratch = Scratch(docs.sparkSession)
    words = sample.select("lang", F.explode(_letter_words(F.col("text"))).alias("key")).groupBy("lang", "key").agg(F.count("*").alias("n"))
    words = scratch.write(words, "words")
    kinds = words.withColumn("kind", F.lit(0)).select("kind", "lang", "key", "n")
    for n in GRAMS:
        kinds = kinds.union(words.select(F.lit(n), "lang", F.explode(_cut(n)), "n"))
    of = lambda lang: F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col("n"))), F.lit(0))
    counts = scratch.write(kinds.groupBy("kind", "key").agg(F.array(*map(of, languages)).alias("n")), "counts")
    size = counts.agg(F.coalesce(F.sum(F.octet_length("key") + ENTRY_BYTES + 8 * len(languages)), F.lit(0))).first()[0]
    if size > model_bytes:
        scores = scratch.write(_scored(counts, languages), "scores")
        scratch.clear(scores)
        return TableModel(languages, scores, scratch)
    known, word_scores = _indexed(counts.filter("kind = 0"), languages)
    grams, gram_scores = {}, {}
    for n in GRAMS:
        grams[n], gram_scores[n] = _indexed(counts.filter(F.col("kind") == n), languages)
    scratch.clear()
    return Model(languages, known, grams, word_scores, gram_scores)


def _backed_off(unseen: DataFrame, model: TableModel, scratch: Scratch) -> DataFrame:
    """(word, scores) of the words in `unseen` with an n-gram that the model knows: the mean over those of the greatest such length."""
    of_kind = lambda n: F.transform(_cut(n), lambda gram: F.struct(F.lit(n).alias("kind"), gram.alias("gram")))
    cuts = F.concat(*map(of_kind, GRAMS))
    grams = scratch.write(unseen.select("word", F.col("word").alias("key")).select("word", F.explode(cuts).alias("g")).select("word", "g.kind", F.col("g.gram").alias("key")), "grams")
    known = scratch.write(grams.groupBy("kind", "key").agg(F.count("*").alias("size")).join(model.scores, ["kind", "key"]), "grams-known")
    hits = meet(grams, known, ["kind", "key"], "size", grams.count())
    means = hits.groupBy("word", "kind").agg(F.array(*[F.avg(F.get("scores", F.lit(i))) for i in range(len(model.languages))]).alias("scores"))
    return means.groupBy("word").agg(F.max_by("scores", "kind").alias("backed"))


def _identified_by_joins(docs: DataFrame, model: TableModel, text_col: str) -> DataFrame:
    """`identify` for a model that stays a table.  A numbered copy of `docs` is written, since ids may repeat."""

    @F.pandas_udf("array<struct<word string, n long>>")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [{"word": w, "n": n} for w, n in letter_words(text).items()])

    scratch, width = Scratch(docs.sparkSession), len(model.languages)
    rows = scratch.write(docs.withColumn("__row", F.monotonically_increasing_id()), "texts")
    used = scratch.write(rows.select("__row", F.explode(counted(F.col(text_col).cast("string"))).alias("w")).select("__row", "w.word", F.col("w.n").alias("times")), "words")
    words = model.scores.filter("kind = 0").select(F.col("key").alias("word"), "scores")
    sizes = scratch.write(used.groupBy("word").agg(F.count("*").alias("size")).join(words, "word", "left"), "words-known")
    backed = _backed_off(sizes.filter("scores is null"), model, scratch)
    scores = F.coalesce("scores", "backed", F.array_repeat(F.lit(0.0), width)).alias("scores")
    found = scratch.write(sizes.join(backed, "word", "left").select("word", "size", scores), "words-scored")
    sums = F.array(*[F.sum(F.get("scores", F.lit(i)) * F.col("times")) for i in range(width)])
    totals = scratch.write(meet(used, found, ["word"], "size", used.count()).groupBy("__row").agg(sums.alias("__totals")), "totals")
    scratch.clear(rows, totals)
    top = F.array_max("__totals")
    best = F.get(F.array(*map(F.lit, model.languages)), (F.array_position("__totals", top) - 1).cast("int"))
    odds = F.aggregate("__totals", F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    judged = rows.join(totals, "__row", "left")
    return judged.withColumns({"lang_pred": F.coalesce(best, F.lit(UNDETERMINED)), "score": F.coalesce(1 / odds, F.lit(0.0))}).drop("__row", "__totals")


def identify(docs: DataFrame, model: Model | TableModel, *, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    if isinstance(model, TableModel):
        return _identified_by_joins(docs, model, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame([scorer.predict(t) for t in texts], columns=["lang", "score"])

    found = docs.withColumn("__lang", run(F.col(text_col).cast("string")))
    return found.withColumns({"lang_pred": F.col("__lang.lang"), "score": F.col("__lang.score")}).drop("__lang")
