"""Near-duplicate documents by circulant MinHash.

Method: a document is its set of distinct word shingles.  One permutation
(sigma, a mixing of the shingle's hash) places each shingle in a circle of
2**20 slots; a second one (pi, a table over the circle) is shifted circularly,
and shift k gives signature coordinate k.  The K shifted values that one
shingle contributes are K neighbours of the table, so a signature is the
minimum over contiguous rows.  Bands of the signature propose candidates and
the Jaccard similarity of the full sets decides.

Steps, all of them Spark jobs over tables in the shared folder:

1. `sketch`: per document the set's size, a 128-bit fingerprint of the set and
   its band keys (Arrow batches in, one small row per document out).
2. Equal sets are one class, represented by the smallest id, so copies
   never reach the candidate search.
3. Buckets of equal band keys: a pivot, chosen by hash from the bucket's
   largest component, is compared with the classes in other components.  At first
   the buckets of one group choose the same one, so that few pairs are compared.
   Keys and pivots meet a bucket's rows by `common.meet`: hot buckets are not shuffled.
4. Buckets that still hold several components: one of at most `FEW` rows is
   compared in full; in a larger one other pivots are tried for a few rounds, and
   then what lies outside the largest component meets those classes that share a
   rare shingle with it, and the rest of the bucket only where the shingles that
   are not rare could reach the similarity.  Shingles that make up much of the
   open texts are taken out of their sets before these become rows.  No link that
   a bucket proposes is lost and no bucket is capped.
5. Candidates are first compared by their signatures, four bits of each
   coordinate: a pair at the similarity falls below the bar, six standard
   deviations down, with a probability of about 1e-8.  Only the sets of those that
   pass are moved, and their exact similarity decides.
6. Each round's links join components, not documents, and the components of
   that small graph follow by minimum labels with pointer jumping.

Defined results: null or empty texts, and texts without a word, have an empty
set (n_shingles 0) and are linked with nothing.  Fewer words than a shingle
give one shingle, the whole sequence.  Very long texts count whole; their minima
are taken piece by piece.  Rows that share an id link through any of their
texts, and each row reports the component of its own text.  A null id is kept
alone unless its text equals another document's.  An empty table gives an empty
result.  Columns other than the id and the text are ignored.  Ids that aren't whole numbers
are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, Scratch, long_id, meet, shuffled, small

SLOTS = 1 << 20
BANDS, ROWS = 32, 5
SEED = 20_250_101
#: Rows of the permutation table gathered at once, so that a very long text needs little memory.
CHUNK = 1 << 14
#: A shingle that at most so many of the classes still open hold proposes all their pairs.
RARE = 8
#: An open bucket of at most so many rows is compared in full.
FEW = 16
#: Ids of candidates that are broadcast; beyond that their sets are found by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Lengths within this factor of each other meet under one key.
BIN = 1.05
NIBBLES = 0x1111111111111111


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash, over whole arrays."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of one text."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and cut at 0x20, 0x09-0x0D
    if not toks:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, toks), np.uint64, len(toks))
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mix(h + w[i : i + n])
    return np.unique(h)


@lru_cache(1)
def _circle(coordinates: int, seed: int) -> np.ndarray:
    """Row p: the values of pi at slot p under each of the circular shifts."""
    pi = np.random.default_rng(seed).permutation(SLOTS).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi[-(coordinates - 1) :], pi]), coordinates)


def signature(shingles: np.ndarray, coordinates: int, seed: int = SEED) -> np.ndarray:
    """Circulant MinHash of a non-empty set: `coordinates` minima."""
    circle = _circle(coordinates, seed)
    slots = (_mix(shingles ^ np.uint64(seed)) >> np.uint64(44)).astype(np.int64)
    return np.minimum.reduce([circle[slots[i : i + CHUNK]].min(axis=0) for i in range(0, len(slots), CHUNK)])


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys, one for each band of each signature; the band is part of the key."""
    parts = signatures.reshape(-1, bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        keys = _mix(keys * np.uint64(31) + parts[:, :, i])
    return keys.astype(np.int64)


def nibbles(signature: np.ndarray) -> np.ndarray:
    """The lowest four bits of each coordinate, sixteen to a long; zeros fill the last one."""
    low = np.zeros(-(-len(signature) // 16) * 16, np.uint64)
    low[: len(signature)] = signature.astype(np.uint64) & np.uint64(15)
    return np.bitwise_or.reduce(low.reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).astype(np.int64)


def alike(a: Column, b: Column, coordinates: int, percent: int) -> Column:
    """Whether two `nibbles` agree as often as those of sets at the similarity do, less six standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 16
    most = coordinates - math.floor(coordinates * p - 6 * math.sqrt(coordinates * p * (1 - p)))
    differ = F.lit(0)
    for i in range(-(-coordinates // 16)):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(NIBBLES)))
    return differ <= most


def sketch(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, bands, low) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, keys, low = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                d = xxhash.xxh3_128_digest(s.tobytes())
                fps.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)))
                sig = signature(s, bands * rows) if len(s) else None
                keys.append(band_keys(sig, bands, rows)[0] if len(s) else [])
                low.append(nibbles(sig) if len(s) else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array([a for a, _ in fps], pa.int64()), pa.array([b for _, b in fps], pa.int64()), pa.array(keys, longs), pa.array(low, longs)],
                ["doc_id", "n", "fp1", "fp2", "bands", "low"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, fp1 long, fp2 long, bands array<long>, low array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(rep, items) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), width).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["rep", "items"])

    return docs.mapInArrow(run, "rep long, items array<long>")


def starred(links: DataFrame) -> DataFrame:
    """Fewer links (a, b) with the same components: each b to its smallest a, and its other a to that one."""
    near = links.groupBy("b").agg(F.min("a").alias("m"))
    rest = links.join(shuffled(near), "b").filter(F.col("a") != F.col("m")).select("a", F.col("m").alias("b")).distinct()
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(rest)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the nodes of the undirected `links` (a, b).

    Labels fall to the smallest neighbour's label and then jump to that
    label's own label, so chains halve with each round.
    """
    few = starred(links)
    both = scratch.write(few.union(few.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.write(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(shuffled(labels), both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(shuffled(near), labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        new = scratch.write(lower.join(shuffled(jump), lower.label == jump.at, "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        moved = new.filter("label < old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
    pivot_rounds: int = 2,
    few: int = FEW,
    broadcast_ids: int = BROADCAST_IDS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|``.  With
    32 bands of 5 rows a pair at similarity 0.8 shares no band with probability
    3e-6.
    """
    source = docs.select(long_id(docs, id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession)
    sketched = scratch.write(sketch(source, width, bands, rows), "sketch")
    # only texts that occur again; from a table of its own, so that adaptive execution can split a hot fingerprint in the join
    classes = scratch.write(sketched.filter("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").drop("copies"), "classes")
    rep = F.coalesce("rep", "doc_id")
    first = (F.col("n") > 0) & (F.col("doc_id") == rep)
    members = scratch.write(
        sketched.join(classes, ["fp1", "fp2"], "left").select("doc_id", "n", rep.alias("rep"), F.when(first, F.col("bands")).alias("bands"), F.when(first, F.col("low")).alias("low")), "members"
    )
    scratch.clear(members)
    entries = members.filter("bands is not null").select("rep", F.explode("bands").alias("key"))
    open_keys = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("key", "size")
    open_keys = scratch.write(open_keys, "keys")
    n_open, n_entries = open_keys.count(), members.agg(F.coalesce(F.sum(F.size("bands")), F.lit(0))).first()[0]
    shared = entries.join(F.broadcast(open_keys), "key") if n_open <= broadcast_ids else meet(entries, open_keys, ["key"], "size", n_entries)
    state = scratch.write(shared.select("key", "rep"), "buckets")
    met = scratch.write(state.select("rep").distinct(), "met")
    n_met = met.count()
    nodes = scratch.write(members.filter("bands is not null").join(small(met, n_met, broadcast_ids), "rep", "left_semi").select("rep", "n", "low", "bands"), "nodes")
    sets = scratch.write(full_sets(source.join(small(met.select(F.col("rep").alias("doc_id")), n_met, broadcast_ids), "doc_id", "left_semi").select("doc_id", "text"), width), "sets")
    labels = scratch.write(met.select("rep", F.col("rep").alias("component")), "labels")

    def likely(n_a: Column, low_a: Column, n_b: Column, low_b: Column) -> Column:
        return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & alike(low_a, low_b, bands * rows, percent)

    def linked(pairs: DataFrame) -> DataFrame:
        """Components (a, b) of those candidate pairs (a, b, c_a, c_b) that are similar enough."""
        pairs = scratch.write(pairs.distinct(), "pairs")
        ids = scratch.write(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "ids")
        own = sets.join(small(ids, ids.count(), broadcast_ids), "rep", "left_semi")
        left = own.select(F.col("rep").alias("a"), F.col("items").alias("items_a"))
        right = own.select(F.col("rep").alias("b"), F.col("items").alias("items_b"))
        shared = F.size(F.array_intersect("items_a", "items_b")).cast("long")
        both = pairs.join(right, "b").join(left, "a").select("c_a", "c_b", shared.alias("shared"), (F.size("items_a") + F.size("items_b")).cast("long").alias("total"))
        both = both.filter(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent)
        return scratch.write(both.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "links")

    for turn in range(pivot_rounds + 1):
        rows_of = scratch.write(state.join(nodes.select("rep", "n", "low").join(labels, "rep"), "rep"), "rows")
        heads = scratch.write(_heads(rows_of, turn), "heads")
        if not heads.limit(1).count():
            break
        pairs, rows_of = None, meet(rows_of, heads, ["key"], "size", rows_of.count())
        if turn:  # buckets of one component are done, and so are small ones after this round
            rows_of = scratch.write(rows_of, "open")
            pairs = _all_pairs(rows_of.filter(F.col("size") <= few), likely)
            rows_of = rows_of.filter(F.col("size") > few)
            state = rows_of.select("key", "rep")
        if turn < pivot_rounds:
            others = rows_of.filter((F.col("component") != F.col("head")) & likely(F.col("n"), F.col("low"), F.col("pivot.n"), F.col("pivot.low")))
            more = others.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b"), F.col("head").alias("c_a"), F.col("component").alias("c_b"))
        else:
            more = _open_pairs(rows_of, nodes, sets, percent, likely, scratch)
        links = linked(more if pairs is None else pairs.union(more))
        if links.limit(1).count():
            merged = components(links, scratch).withColumnRenamed("component", "merged")
            labels = scratch.write(labels.join(merged, labels.component == merged.node, "left").select("rep", F.coalesce("merged", "component").alias("component")), "labels")
    scratch.clear(members, labels)
    return (
        members.join(labels, "rep", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
    )


def _heads(rows: DataFrame, turn: int) -> DataFrame:
    """(key, head, pivot (rep, n, low), size) for the buckets with several components: the component with most
    rows there, and one of its rows, chosen by hash: the same row in all buckets at first, then different ones."""
    chance = lambda x: F.xxhash64(F.lit(turn), *(["key"] if turn else []), x)
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("rows"), F.min_by(F.struct("rep", "n", "low"), chance("rep")).alias("p"))
    found = parts.groupBy("key").agg(F.max_by(F.struct("component", "p"), F.struct("rows", chance("component"))).alias("h"), F.count("*").alias("components"), F.sum("rows").alias("size"))
    return found.filter("components > 1").select("key", F.col("h.component").alias("head"), F.col("h.p").alias("pivot"), "size")


def _pairs_of(rows: Column, likely) -> Column:
    """Array of (a, b, c_a, c_b): the likely pairs in different components of a short array of (rep, component, n, low)."""
    pair = lambda a: lambda b: F.struct(a["rep"].alias("a"), b["rep"].alias("b"), a["component"].alias("c_a"), b["component"].alias("c_b"))
    later = lambda a: lambda b: (a["rep"] < b["rep"]) & (a["component"] != b["component"]) & likely(a["n"], a["low"], b["n"], b["low"])
    return F.flatten(F.transform(rows, lambda a: F.transform(F.filter(rows, later(a)), pair(a))))


def _all_pairs(rows: DataFrame, likely) -> DataFrame:
    """(a, b, c_a, c_b): the likely pairs in different components of each bucket; buckets are small."""
    lists = rows.groupBy("key").agg(F.collect_set(F.struct("rep", "component", "n", "low")).alias("rs"))
    return lists.select(F.explode(_pairs_of(F.col("rs"), likely)).alias("p")).select("p.*")


def _repeated(sets: DataFrame) -> DataFrame:
    """(item, held): how many texts of one batch hold a shingle, where several do; the sums are at most the true counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, held = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(items[held > 1], pa.int64()), pa.array(held[held > 1], pa.int64())], ["item", "held"])

    return sets.select("items").mapInArrow(run, "item long, held long")


def _hot_items(sets: DataFrame, total: int) -> DataFrame:
    """One row with `hot`, the shingles that surely aren't rare and make more than one in HOT_KEYS of the `total`: fewer than HOT_KEYS."""
    counts = _repeated(sets).groupBy("item").agg(F.sum("held").alias("held"))
    return counts.filter((F.col("held") > RARE) & (F.col("held") * HOT_KEYS > total)).agg(F.collect_list("item").alias("hot"))


def _open_pairs(still: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, likely, scratch: Scratch) -> DataFrame:
    """All likely pairs in different components of one bucket: (a, b, c_a, c_b).

    A pair either shares a shingle that few of the open classes hold, and is
    found by it, or shares common shingles only.  Then the similarity is bounded
    by how many of those either one has, and of two such rows in one bucket one
    lies outside the bucket's largest component.  Rows meet only at lengths that
    the bound allows, and once each, in the first bucket that they share.
    """
    ids = scratch.write(still.select("rep", "component", "n", "low").distinct(), "ids")
    n_ids, total = ids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = sets.join(small(ids.select("rep"), n_ids, BROADCAST_IDS), "rep", "left_semi")
    hot = scratch.write(_hot_items(own, total), "hot")
    items = scratch.write(own.join(F.broadcast(hot)).select("rep", F.explode(F.array_except("items", "hot")).alias("item")), "items")
    rare = items.groupBy("item").agg(F.count("*").alias("held")).filter(F.col("held") <= RARE)
    scarce = scratch.write(items.join(rare, "item"), "scarce")
    met = scarce.filter("held > 1").join(ids, "rep").groupBy("item").agg(F.collect_set(F.struct("rep", "component", "n", "low")).alias("rs"))  # at most RARE ids
    named = met.select(F.explode(_pairs_of(F.col("rs"), likely)).alias("p")).select("p.*")

    # an id with several texts has no bound
    single = own.groupBy("rep").agg(F.count("*").alias("texts")).filter("texts = 1")
    bound = scarce.groupBy("rep").agg(F.count("*").alias("scarce")).join(single, "rep").select("rep", "scarce")
    rows = still.join(bound, "rep", "left").join(nodes.select("rep", "bands"), "rep").withColumn("common", F.col("n") - F.coalesce("scarce", F.lit(0)))
    reach = F.floor(F.col("common") * (100 + percent) / percent) - F.col("n")  # the longest partner that the common shingles allow
    rows = rows.withColumn("upto", F.least(reach, F.floor(F.col("n") * 100 / percent))).filter(F.col("upto") * 100 >= F.col("n") * percent)
    rows = scratch.write(rows.select("key", "rep", "n", "low", "component", "bands", "common", "upto", (F.col("component") != F.col("head")).alias("stray")), "open")
    bin_of = lambda n: F.floor(F.log(n.cast("double")) / math.log(BIN)).cast("int")
    side = lambda x: rows.select("key", F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "low", "common", "bands", "stray", "upto")], F.col("component").alias(f"c_{x}"))
    once = ~F.col("stray_b") | (F.col("a") < F.col("b"))
    enough = F.least("common_a", "common_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
    first = F.get(F.array_intersect("bands_a", "bands_b"), F.lit(0)) == F.col("key")
    x = side("a").filter("stray_a").withColumn("bin", F.explode(F.sequence(bin_of(F.ceil(F.col("n_a") * percent / 100)), bin_of(F.col("upto_a")))))
    close = likely(F.col("n_a"), F.col("low_a"), F.col("n_b"), F.col("low_b"))
    plain = x.join(side("b").withColumn("bin", bin_of(F.col("n_b"))), ["key", "bin"]).filter((F.col("c_a") != F.col("c_b")) & once & enough & close & first)
    return named.union(plain.select("a", "b", "c_a", "c_b"))
