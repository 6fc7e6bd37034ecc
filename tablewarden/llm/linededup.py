"""Reversible line deduplication: sharded cuckoo filters over exact reference counts.

State (tables in the shared folder, all keyed by a line's 128-bit key hash):

* `postings` (doc_id, k1, k2): which document holds which key, once each;
* `counts` (k1, k2, docs, last): exact number of documents and largest id;
* `filters` (shard, filter): per shard of the key space one cuckoo filter of
  the keys that `counts` holds.  A filter answers "certainly new" for most keys
  of an insertion without touching `counts`, and, unlike a Bloom filter, can
  forget a key whose last document goes.

`LineIndex.insert` and `LineIndex.delete` return the next state, so a document
can come and go and the counts are as if it had never been there.
`LineIndex.resolve` drops repeated lines: keys of at least `min_chars` code
points in at least `min_docs` documents lose their lines everywhere but in the
largest id that holds them.  A second set of filters, of the repeated keys
only, lets the documents' lines pass without a shuffle unless they may be
repeated; the exact counts then decide.  Shards grow in number with the keys, so
that none outgrows a task, and the postings of several insertions are written as
one from time to time.

A hot line costs one posting for each document; counting is partial before
the shuffle, and keys with a large share of all postings, whose number is bounded,
are broadcast to them and gather in no task (`common.meet`).  Filters are broadcast only while their bytes are below
`broadcast_bytes`; beyond that the keys go to the shards, salted so that no
group is unbounded.

Defined results: null and empty texts are one empty line and never change.
Rows that share an id are one document, also when they are inserted one after the
other; repeated rows count once.  Ids that aren't whole numbers are refused.  A row with a null id holds no key; its repeated
lines go.  Very long texts are cut whole.  Ids to delete that are not there change
nothing.  Empty tables give empty results.  Only the id and the text are read;
`resolve` returns all columns of its input with the text replaced, and n_lines and
n_dropped too where the input has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, long_id, meet, small, written

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys that one shard's filter is sized for; the number of shards follows the number of keys.
SHARD_KEYS = 1 << 17
BROADCAST_BYTES = 32 << 20
SLOTS, KICKS = 4, 500
#: Ids that are broadcast; more meet the postings in a shuffled join.
BROADCAST_IDS = 1_000_000
#: Insertions after which the postings are written as one.
PARTS = 8


def key_of(line: str, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    key = line.strip(SEPARATORS)
    if len(key) < min_chars:
        return None
    d = xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower())  # bytes: A-Z only
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


class CuckooFilter:
    """16-bit fingerprints in buckets of four; each key has two buckets.

    Keys are given as the second half of the key hash.  `load` and `dump` use
    plain bytes, the form in which a shard's filter is stored.
    """

    def __init__(self, capacity: int = 0, raw: bytes | None = None):
        if raw is not None:
            self.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        else:
            self.table = np.zeros((1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85))))), SLOTS), np.uint16)
        self.mask = np.uint64(len(self.table) - 1)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = np.asarray(keys).astype(np.int64).view(np.uint64)
        print_ = (k >> np.uint64(48)).astype(np.uint16)
        print_ = np.where(print_ == 0, np.uint16(1), print_)
        first = k & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, place, print_):
        return (place ^ (np.asarray(print_).astype(np.uint64) * np.uint64(0x5BD1E995))) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        p, a, b = self._places(keys)
        return (self.table[a] == p[:, None]).any(axis=1) | (self.table[b] == p[:, None]).any(axis=1)

    def _settle(self, prints: np.ndarray, places: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Put in those of `who` that find a free slot at their place; returns the others."""
        who = who[np.argsort(places[who], kind="stable")]
        at = places[who].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        turn = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        free = self.table[at] == 0
        slot = free & (np.cumsum(free, axis=1) == turn[:, None] + 1)
        found = slot.any(axis=1)
        self.table[at[found], slot[found].argmax(axis=1)] = prints[who[found]]
        return who[~found]

    def insert(self, keys: np.ndarray) -> None:
        """Adds keys that are not in yet; a full filter raises OverflowError."""
        rng = np.random.default_rng(1)
        prints, first, second = self._places(keys)
        rest = np.arange(len(prints))
        for places in (first, second):
            if len(rest):
                rest = self._settle(prints, places, rest)
        for p, place in zip(prints[rest], second[rest], strict=True):
            for _ in range(KICKS):
                slot = rng.integers(SLOTS)
                p, self.table[place, slot] = self.table[place, slot], p
                place = self._other(place, p)
                free = np.flatnonzero(self.table[place] == 0)
                if len(free):
                    self.table[place, free[0]] = p
                    break
            else:
                raise OverflowError("cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        for p, a, b in zip(*self._places(keys), strict=True):
            for place in (a, b):
                hit = np.flatnonzero(self.table[place] == p)
                if len(hit):
                    self.table[place, hit[0]] = 0
                    break

    @property
    def used(self) -> int:
        return int((self.table != 0).sum())

    def dump(self) -> bytes:
        return self.table.tobytes()


def _filled(keys: np.ndarray) -> CuckooFilter:
    """A filter of all keys; one that overflows is built again at twice the size."""
    room = max(16, int(len(keys) * 1.25))
    while True:
        try:
            made = CuckooFilter(room)
            made.insert(keys)
            return made
        except OverflowError:
            room *= 2


def _postings(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, k1, k2), once for each document row and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, k1, k2 = [], [], []
            for i, text in enumerate(batch.column(1)):
                found = {key_of(x, min_chars) for x in (text.as_py() or "").split("\n")} - {None}
                rows.extend([i] * len(found))
                k1.extend(a for a, _ in found)
                k2.extend(b for _, b in found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(k1, pa.int64()), pa.array(k2, pa.int64())], ["doc_id", "k1", "k2"])

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long")


def _counted(postings: DataFrame) -> DataFrame:
    held = postings.filter("doc_id is not null").distinct()
    return held.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


def _shard(shards: int):
    return F.pmod(F.col("k1"), F.lit(shards)).cast("int")


def _shards_for(keys: int) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1, keys) / SHARD_KEYS))))


def _filters(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, filter) over the keys of `counts`; a shard has about SHARD_KEYS keys."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [_filled(np.sort(pdf["k2"].to_numpy())).dump()]})

    return counts.select(_shard(shards).alias("shard"), "k2").groupBy("shard").applyInPandas(build, "shard int, filter binary")


def _may_hold(keys: DataFrame, filters: DataFrame, shards: int, broadcast_bytes: int) -> DataFrame:
    """`keys` (doc_id, k1, k2) with boolean `maybe`: whether its shard's filter has the key."""
    schema = "doc_id long, k1 long, k2 long, maybe boolean"
    size = filters.agg(F.coalesce(F.sum(F.length("filter")), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        shared = keys.sparkSession.sparkContext.broadcast({r["shard"]: bytes(r["filter"]) for r in filters.collect()})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = {k: CuckooFilter(raw=v) for k, v in shared.value.items()}
            for batch in batches:
                k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                maybe, at = np.zeros(len(k1), bool), np.mod(k1, shards)
                for shard in np.unique(at):
                    if shard in loaded:
                        mine = at == shard
                        maybe[mine] = loaded[shard].contains(k2[mine])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe)], ["doc_id", "k1", "k2", "maybe"])

        return keys.mapInArrow(probe, schema)

    salts = 64
    salted = keys.withColumns({"shard": _shard(shards), "salt": F.pmod(F.xxhash64("doc_id", "k2"), F.lit(salts)).cast("int")})
    spread = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = CuckooFilter(raw=right["filter"].iloc[0]).contains(left["k2"].to_numpy()) if len(right) and len(left) else np.zeros(len(left), bool)
        return left[["doc_id", "k1", "k2"]].assign(maybe=hit)

    return salted.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInPandas(meet, schema)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; see the module's docstring."""

    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    scratch: Scratch
    parts: int = 1
    min_chars: int = MIN_CHARS
    broadcast_bytes: int = BROADCAST_BYTES

    @staticmethod
    def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> LineIndex:
        scratch = Scratch(docs.sparkSession)
        postings = written(_postings(_source(docs, id_col, text_col), min_chars), "postings")
        counts = scratch.write(_counted(postings), "counts")
        shards = _shards_for(counts.count())
        return LineIndex(postings, counts, scratch.write(_filters(counts, shards), "filters"), shards, scratch, 1, min_chars, broadcast_bytes)

    def insert(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """The state with `docs` added; of ids that are there, lines that their document holds already count once."""
        scratch = Scratch(docs.sparkSession)
        fresh = scratch.write(_postings(_source(docs, id_col, text_col), self.min_chars).filter("doc_id is not null").distinct(), "fresh")
        ids = scratch.write(fresh.select("doc_id").distinct(), "ids")
        held = self.postings.join(small(ids, ids.count(), BROADCAST_IDS), "doc_id", "left_semi")
        fresh = written(fresh.join(held, ["doc_id", "k1", "k2"], "left_anti"), "postings")
        probed = scratch.write(_may_hold(fresh, self.filters, self.shards, self.broadcast_bytes), "probed")
        added = probed.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"), F.first("maybe").alias("maybe"))
        known = added.filter("maybe").join(self.counts.select("k1", "k2", F.col("docs").alias("old_docs"), F.col("last").alias("old_last")), ["k1", "k2"], "left")
        merged = known.select("k1", "k2", (F.col("docs") + F.coalesce("old_docs", F.lit(0))).alias("docs"), F.greatest("last", "old_last").alias("last"))
        counts = self.counts.join(merged.select("k1", "k2"), ["k1", "k2"], "left_anti").union(merged).union(added.filter("not maybe").select("k1", "k2", "docs", "last"))
        counts = scratch.write(counts, "counts")
        shards = max(self.shards, _shards_for(counts.count()))
        if shards > self.shards:
            filters = scratch.write(_filters(counts, shards), "filters")
        else:
            fresh_keys = added.filter("not maybe").select("k1", "k2").union(known.filter("old_docs is null").select("k1", "k2"))
            filters = scratch.write(self._changed(fresh_keys, grow=True), "filters")
        scratch.clear(counts, filters)
        postings, parts = self.postings.union(fresh), self.parts + 1
        if parts > PARTS:
            postings, parts = written(postings, "postings"), 1
        return LineIndex(postings, counts, filters, shards, scratch, parts, self.min_chars, self.broadcast_bytes)

    def delete(self, ids: DataFrame, *, id_col: str = "doc_id") -> LineIndex:
        """The state without the documents whose ids are in `ids`."""
        scratch = Scratch(ids.sparkSession)
        gone = scratch.write(ids.select(long_id(ids, id_col).alias("doc_id")).distinct(), "gone")
        gone = small(gone, gone.count(), BROADCAST_IDS)
        touched = scratch.write(self.postings.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct(), "touched")
        rest = written(self.postings.join(gone, "doc_id", "left_anti"), "postings")
        sized = scratch.write(self.counts.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", "docs"), "sized")
        recount = scratch.write(_counted(meet(rest, sized, ["k1", "k2"], "docs", self._lines()).drop("docs")), "recount")
        counts = scratch.write(self.counts.join(touched, ["k1", "k2"], "left_anti").union(recount), "counts")
        dead = touched.join(recount, ["k1", "k2"], "left_anti")
        filters = scratch.write(self._changed(dead, grow=False), "filters")
        scratch.clear(counts, filters)
        return LineIndex(rest, counts, filters, self.shards, scratch, 1, self.min_chars, self.broadcast_bytes)

    def _lines(self) -> int:
        """How many postings the state has."""
        return self.counts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]

    def forget(self) -> None:
        """Delete this state's counts and filters, once a later state has its own."""
        self.scratch.clear()

    def _changed(self, keys: DataFrame, grow: bool) -> DataFrame:
        """The filters with `keys` inserted or deleted; a full shard gets a larger filter from `counts`."""
        schema = "shard int, filter binary, full boolean"

        def apply(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            made = CuckooFilter(raw=right["filter"].iloc[0]) if len(right) else CuckooFilter(len(left) * 2)
            try:
                (made.insert if grow else made.delete)(np.sort(left["k2"].to_numpy()))
                return pd.DataFrame({"shard": [key[0]], "filter": [made.dump()], "full": [False]})
            except OverflowError:
                return pd.DataFrame({"shard": [key[0]], "filter": [b""], "full": [True]})

        side = keys.select(_shard(self.shards).alias("shard"), "k2")
        new = written(side.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(apply, schema), "filters")
        full = new.filter("full").select("shard")
        if not grow or not full.limit(1).count():
            return new.select("shard", "filter")
        whole = self.counts.select("k1", "k2").union(keys).withColumn("shard", _shard(self.shards)).join(full, "shard", "left_semi")
        return new.filter("not full").select("shard", "filter").union(_filters(whole.select("k1", "k2"), self.shards))

    def resolve(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
        """`docs` (the documents of the state) without repeated lines, plus n_lines and n_dropped."""
        repeated = self.scratch.write(self.counts.filter(F.col("docs") >= min_docs), "repeated")
        filters = self.scratch.write(_filters(repeated, self.shards), "filters")
        maybe = self.scratch.write(_may_hold(self.postings, filters, self.shards, self.broadcast_bytes).filter("maybe").drop("maybe"), "maybe")
        lost = meet(maybe, repeated, ["k1", "k2"], "docs", self._lines()).filter("doc_id is null or doc_id <> last")
        lost = lost.select("doc_id", F.struct("k1", "k2").alias("key")).groupBy("doc_id").agg(F.collect_set("key").alias("__lost"))
        min_chars = self.min_chars

        @F.pandas_udf("text string, n_lines long, n_dropped long")
        def rewrite(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
            out = []
            for t, gone in zip(text, lost, strict=True):
                lines = (t or "").split("\n")
                if gone is None or not len(gone):
                    out.append((t, len(lines), 0))
                    continue
                gone = {(x["k1"], x["k2"]) for x in gone}
                kept = [x for x in lines if key_of(x, min_chars) not in gone]
                out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

        lost = lost.withColumnRenamed("doc_id", "__id")
        joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col("__id")), "left").withColumn("__new", rewrite(F.col(text_col).cast("string"), F.col("__lost")))
        return joined.drop("__id", "__lost").withColumns({text_col: F.col("__new.text"), "n_lines": F.col("__new.n_lines"), "n_dropped": F.col("__new.n_dropped")}).drop("__new")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Build the index of `docs` and resolve it over them."""
    index = LineIndex.build(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, broadcast_bytes=broadcast_bytes)
    return index.resolve(docs, id_col=id_col, text_col=text_col, min_docs=min_docs)
