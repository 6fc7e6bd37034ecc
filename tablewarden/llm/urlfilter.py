"""URL filters by Bloom filter cascades, in built-in expressions.

A key is a host and the beginning of a path, such as ``example.com/en/``; it
fits its host and all subdomains where the path begins so.  The candidates of a
url are its host's suffixes with the beginnings of its path, in those numbers of
labels and lengths that listed keys have; no other key could fit.

A cascade tells whether a candidate is listed.  Level 0 is a Bloom filter of the
listed keys; level 1 holds the keys of the corpus that pass level 0 wrongly;
level 2 those listed keys that pass level 1 wrongly, and so on until no key
errs.  The levels are built over the complete key universe of the corpus, the
distinct candidates of all its urls, so the answer is exact for every url of it,
and the scan that judges needs no join and no shuffle.

Size: level 0 has 1.44 * log2(universe / listed) bits a key, so that later
levels are about as large as the list; the whole grows with the list and only
logarithmically with the corpus.  Cascades are constants of the plan, which the
driver and each task hold once, so `table_bytes` bounds them: the keys of a longer
list are dealt by hash to several rounds, each with cascades of its own and a
narrow scan that asks them.

Defined results: a null url or one without ``://`` has an empty host and path;
no rule fits it and it is allowed.  Of several rules the longest key wins; rules
given twice with different verdicts block.  Null keys are ignored.  Very long urls
are cut whole; repeated rows are judged alike.  Empty tables give empty results.
All columns of the input pass through, but those the result adds are replaced.
"""

from __future__ import annotations

import math
import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TABLE_BYTES = 4 << 20
#: Bits in a byte of a filter; seven, so that each byte is a character that built-in functions can read.
BITS = 7
#: Bits that are packed into one long on the way to the driver: nine bytes.
PACKED = 63
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Keys that could be listed: host suffixes of so many labels, with path beginnings of so many characters."""
    if not labels or not lengths:
        return F.array().cast("array<string>")
    names = F.split(host, r"\.")
    sizes = lambda found, most: F.filter(F.array(*map(F.lit, found)), lambda k: k <= most)
    heads = F.transform(sizes(lengths, F.length(path)), lambda k: F.substr(path, F.lit(1), k))
    tails = F.transform(sizes(labels, F.size(names)), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    return F.flatten(F.transform(tails, lambda t: F.transform(heads, lambda h: F.concat(t, h))))


@dataclass(frozen=True)
class Level:
    """A Bloom filter's shape; its bytes are given where it is asked."""

    bits: int
    hashes: int
    number: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(64 * self.number + j), key), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column, table: Column) -> Column:
        byte = lambda at: F.ascii(F.substring(table, F.floor(at / BITS).cast("int") + 1, F.lit(1)).cast("string"))
        bit = lambda at: F.call_function("shiftright", byte(at), F.pmod(at, F.lit(BITS)).cast("int")).bitwiseAND(F.lit(1)) == 1
        return reduce(operator.and_, map(bit, self.places(key)))


@dataclass(frozen=True)
class Cascade:
    """Levels and their bytes."""

    levels: tuple[Level, ...]
    tables: tuple[bytes, ...]

    def holds(self, key: Column, tables: Column) -> Column:
        """A key that level i lacks is listed if i is odd; one that passes all is of the last level's kind."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            out = F.when(~level.holds(key, F.get(tables, F.lit(i))), F.lit(i % 2 == 1)).otherwise(out)
        return out

    def table(self) -> Column:
        """The bytes of all levels as one constant, to be bound once by whoever asks."""
        return F.array(*map(F.lit, self.tables)) if self.tables else F.array().cast("array<binary>")


def then(value: Column, use) -> Column:
    """use(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _each(n: int, against: int) -> float:
    """Bits for each of `n` keys, so that about n of `against` others pass."""
    return 1.44 * max(1.0, math.log2(max(2, against) / max(1, n)))


def _level(keys: DataFrame, n: int, against: int, number: int) -> tuple[Level, bytes]:
    """A filter of `keys` that about n of `against` other keys pass wrongly."""
    each = _each(n, against)
    level = Level(max(64, math.ceil(n * each)), max(1, min(16, round(each * 0.69))), number)
    places = keys.select(F.explode(F.array(*level.places(F.col("key")))).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(PACKED)).cast("int"))
    packed = places.groupBy(F.floor(F.col("at") / PACKED).alias("i")).agg(F.bit_or(bit).alias("w")).collect()
    table = bytearray((level.bits // PACKED + 1) * (PACKED // BITS))
    for row in packed:
        for k in range(PACKED // BITS):
            table[row["i"] * (PACKED // BITS) + k] = row["w"] >> (BITS * k) & (1 << BITS) - 1
    return level, bytes(table)


def cascade(listed: DataFrame, others: DataFrame, scratch: Scratch) -> Cascade:
    """The cascade of `listed` (key) against `others` (key), distinct and disjoint."""
    levels, tables = [], []
    inside, outside, n, against = listed, others, listed.count(), others.count()
    while n:
        level, table = _level(inside, n, against, len(levels))
        levels.append(level)
        tables.append(table)
        inside, outside = scratch.write(outside.filter(then(F.lit(table), _asks(level))), "passed"), inside
        n, against = inside.count(), n
    return Cascade(tuple(levels), tuple(tables))


def _asks(level: Level):
    return lambda table: level.holds(F.col("key"), table)


KINDS = ("allow", "block", "listed")


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, *, url_col: str = "url", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """`pages` with host, path, rule and verdict.

    `rules` is (key, verdict) with verdicts allow and block; `listed` is (key),
    the keys to block where no rule fits.  The numbers of labels and the lengths of
    paths that keys have are read by the driver.
    """
    scratch = Scratch(pages.sparkSession)
    keys = scratch.write(rules.select("key", "verdict").union(listed.select("key", F.lit("listed").alias("verdict"))).filter("key is not null").distinct(), "keys")
    path = F.regexp_extract("key", r"(?s)^[^/]*(.*)$", 1)
    shape = keys.select(F.size(F.split(F.regexp_extract("key", r"^[^/]*", 0), r"\.")).alias("labels"), F.length(path).alias("length"))
    shapes = shape.agg(F.sort_array(F.collect_set("labels")).alias("labels"), F.sort_array(F.collect_set("length")).alias("lengths")).first()
    url = F.col(url_col).cast("string")
    cut = pages.drop("host", "path", "rule", "verdict", "__c", "__hits").withColumns({"host": host_of(url), "path": path_of(url)})
    cut = cut.withColumn("__c", candidates(F.col("host"), F.col("path"), shapes["labels"], shapes["lengths"]))
    universe = scratch.write(cut.select(F.explode("__c").alias("key")).distinct(), "universe")
    n, against = keys.count(), universe.count()
    rounds = max(1, math.ceil(1.5 * n * _each(n, against) / 8 / table_bytes))

    hits = None
    for turn in range(rounds):
        mine = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(rounds)) == turn  # noqa: B023, E731
        made = []
        for kind in KINDS:
            own = keys.filter((F.col("verdict") == kind) & mine(F.col("key"))).select("key").distinct()
            made.append(cascade(own, universe.filter(mine(F.col("key"))).join(own, "key", "left_anti"), scratch))
        found = then(F.struct(*[m.table().alias(k) for k, m in zip(KINDS, made, strict=True)]), _hits(made, mine))
        if rounds > 1:
            cut = scratch.write(cut.withColumn("__hits", found if hits is None else F.concat(hits, found)), "judged")
        hits = F.col("__hits") if rounds > 1 else found

    def verdict(found: Column) -> Column:
        ruled = F.filter(found, lambda h: h["allow"] | h["block"])
        longest = F.get(F.array_sort(ruled, lambda a, b: F.length(b["key"]) - F.length(a["key"])), F.lit(0))
        default = F.when(F.exists(found, lambda h: h["listed"]), F.lit("block")).otherwise(F.lit("allow"))
        decided = lambda r: F.struct(r["key"].alias("rule"), F.when(r.isNull(), default).when(r["block"], F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
        return then(longest, decided)

    out = cut.withColumn("__hits", then(hits, verdict))
    names = [F.col(f"`{c}`") for c in out.columns if c not in ("__c", "__hits")]
    return out.select(*names, F.col("__hits.rule").alias("rule"), F.col("__hits.verdict").alias("verdict"))


def _hits(made: list[Cascade], mine):
    """From the cascades' words to the candidates that some cascade holds, with the kinds that do."""

    def of(words: Column) -> Column:
        marks = lambda c: F.struct(c.alias("key"), *[m.holds(c, words[k]).alias(k) for k, m in zip(KINDS, made, strict=True)])
        asked = F.transform(F.filter("__c", mine), marks)
        return F.filter(asked, lambda h: h["allow"] | h["block"] | h["listed"])

    return of
