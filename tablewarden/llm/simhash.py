"""Near-duplicate documents by SimHash and multi-index hashing.

Method: a document's fingerprint has a bit for each of 64 majorities over the
XXH64 values (seed 42) of its word shingles, repeats included.  Fingerprints
within `RADIUS` (3) bits are linked.  Each one is stored in two tables, by its
upper and its lower half; of two fingerprints at most three bits apart, one half
differs in at most one bit.  So the 33 values of the small Hamming ball of each
half are looked up in its table, and what is found there is verified on all 64
bits.

Steps, all of them Spark jobs over tables in the shared folder:

1. Fingerprints (Arrow batches in, one short row a document out).  Equal ones are
   one class, whatever number of documents holds them; all that follows works on
   distinct fingerprints.
2. Tables.  An entry list of at most `BUCKET` fingerprints is one row.  Longer
   ones, of which a corpus with many near copies may have some with millions of
   entries, are never gathered: they are split by half of the bits that are still
   free, once and if need be again, and balls are enumerated in those too.  After
   three levels 8 bits are free, so that a list has 256 entries at most.  Counts
   come from partial sums.
3. Each probe reports the smallest component among what it has found, not the
   pairs, so a dense group yields rows in proportion to its fingerprints.
   Components are joined (minimum labels with pointer jumping); probes that found
   several other components look again, until all that they find is their own.
   Each such round at least halves what is still to be joined, as in Boruvka's
   algorithm.  No link is lost and no list is capped.

Rows shuffled: 66 short ones for each distinct fingerprint, two for its entries.
Nothing is broadcast.

Defined results: A-Z are lower-cased; words are what stands between separators;
fewer words than a shingle has are one shingle.  Null, empty and blank texts have
the fingerprint zero and are linked like any other.  Very long texts count whole
(bits are summed piece by piece).  A null id has the smallest id that it
reaches, or null.  Rows that repeat an id each report their own text's
fingerprint and component, and join what their texts join.  An empty table
gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffled
from .neardup import components

SEED = 42
WIDTH = 3
#: Bits that linked fingerprints may differ in; two halves with balls of radius one serve up to three.
RADIUS = 3
#: Entries of a table's list; beyond that it is split by further bits.
BUCKET = 128
#: Hashes whose bits are summed at once.
CHUNK = 1 << 14
#: Bits of a part on each level; every level cuts what is still free in two.
PARTS = (32, 16, 8)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 majorities over the shingles' hashes, as an unsigned number."""
    toks = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and cut at 0x20, 0x09-0x0D
    if not toks:
        return 0
    whole = b" ".join(toks)
    starts = [0]
    for t in toks:
        starts.append(starts[-1] + len(t) + 1)
    k = min(width, len(toks))
    view, digest = memoryview(whole), xxhash.xxh64_intdigest
    n = len(toks) - k + 1
    sums = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(view[starts[i] : starts[i + k] - 1], SEED) for i in range(at, min(n, at + CHUNK))], ">u8")
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * sums > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of (doc_id, text); fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _halves(level: int, free: int, bits: list[int]) -> list[tuple[int, int, list[int]]]:
    """(mask, free, the part's own bits) of the two tables that split `free` on this level."""
    n = PARTS[level]
    out = []
    for part in (bits[:n], bits[n:]):
        own = sum(1 << b for b in part)
        out.append((~free & ((1 << 64) - 1) | own, free & ~own, part))
    return out


def _tables(level: int) -> list[tuple[int, int, list[int]]]:
    """All tables of a level: (mask of the fixed bits, mask of the level before, bits of the part)."""
    found, masks = [], [((1 << 64) - 1, 0)]
    for at in range(level + 1):
        found = [(mask, before, part, free) for free_bits, before in masks for mask, free, part in _halves(at, free_bits, [b for b in range(63, -1, -1) if free_bits >> b & 1])]
        masks = [(free, mask) for mask, _, _, free in found]
    return [(mask, before, part) for mask, before, part, _ in found]


def _entries(level: int, fps: DataFrame) -> DataFrame:
    """(mask, key, fp): where a fingerprint is stored; fps has (before, fp), the mask of the list that was too long."""
    masks = F.array(*[F.struct(F.lit(_signed(mask)).alias("mask"), F.lit(_signed(before)).alias("before")) for mask, before, _ in _tables(level)])
    return fps.select("fp", "before", F.explode(masks).alias("t")).filter(F.col("t.before") == F.col("before")).select("t.mask", F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"), "fp")


def _probes(level: int, tried: DataFrame) -> DataFrame:
    """(mask, key, fp, near): what to look up for (before, near, fp), `near` being fp with at most one bit changed on each level so far."""
    balls = F.array(*[
        F.struct(F.lit(_signed(mask)).alias("mask"), F.lit(_signed(before)).alias("before"), F.array(*[F.lit(_signed(f)) for f in (0, *(1 << b for b in part))]).alias("flips")) for mask, before, part in _tables(level)
    ])
    one = tried.select("fp", "near", "before", F.explode(balls).alias("t")).filter(F.col("t.before") == F.col("before")).select("fp", "near", "t.mask", F.explode("t.flips").alias("flip"))
    near = F.col("near").bitwiseXOR(F.col("flip"))
    return one.select("mask", near.bitwiseAND(F.col("mask")).alias("key"), "fp", near.alias("near"))


def _apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def linked_fingerprints(fps: DataFrame, scratch: Scratch, bucket: int = BUCKET) -> DataFrame:
    """(fp, label): for the distinct fingerprints `fps` (fp), equal labels for those that links connect."""
    lists, open_rows = [], []
    stored, tried = fps.select(F.lit(0).cast("long").alias("before"), "fp"), fps.select(F.lit(0).cast("long").alias("before"), "fp", F.col("fp").alias("near"))
    for level in range(len(PARTS)):
        last = level == len(PARTS) - 1
        entries = scratch.write(_entries(level, stored), "entries")
        counts = scratch.write(entries.groupBy("mask", "key").agg(F.count("*").alias("held")), "counts")
        probes = scratch.write(_probes(level, tried).join(shuffled(counts), ["mask", "key"]).filter((F.col("held") > 1) | (F.col("near") != F.col("fp"))), "probes")
        short = counts if last else counts.filter(F.col("held") <= bucket)
        lists.append(scratch.write(entries.join(shuffled(short), ["mask", "key"], "left_semi"), "lists"))
        open_rows.append(probes if last else probes.filter(F.col("held") <= bucket))
        if last or not counts.filter(F.col("held") > bucket).limit(1).count():
            break
        long = counts.filter(F.col("held") > bucket)
        stored = entries.join(shuffled(long), ["mask", "key"], "left_semi").select(F.col("mask").alias("before"), "fp")
        tried = probes.filter(F.col("held") > bucket).select(F.col("mask").alias("before"), "fp", "near")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    stored, looking = union(lists), union(open_rows).select("mask", "key", "fp")
    labels = scratch.write(fps.select("fp", F.col("fp").alias("label")), "labels")
    while True:
        held = stored.join(shuffled(labels), "fp").groupBy("mask", "key").agg(F.collect_list(F.struct("fp", "label")).alias("held"))  # `bucket` entries at most, 256 on the last level
        met = looking.join(shuffled(labels), "fp").join(shuffled(held), ["mask", "key"])
        others = F.filter("held", lambda x: (x["label"] != F.col("label")) & (_apart(x["fp"], F.col("fp")) <= RADIUS))
        found = met.select("mask", "key", "fp", "label", F.array_distinct(F.transform(others, lambda x: x["label"])).alias("others")).filter(F.size("others") > 0)
        found = scratch.write(found.select("mask", "key", "fp", "label", F.array_min("others").alias("other"), (F.size("others") > 1).alias("more")), "found")
        links = found.select(F.greatest("label", "other").alias("b"), F.least("label", "other").alias("a")).distinct()
        if not found.limit(1).count():
            return labels
        merged = components(links, scratch)
        labels = scratch.write(labels.join(shuffled(merged), labels.label == merged.node, "left").select("fp", F.coalesce("component", "label").alias("label")), "labels")
        looking = found.filter("more").select("mask", "key", "fp")
        if not looking.limit(1).count():
            return labels


def simhash_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`; the fingerprint is 16 hexadecimal digits."""
    scratch = Scratch(docs.sparkSession)
    own = scratch.write(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), width), "fingerprints")
    classes = scratch.write(own.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    labels = linked_fingerprints(classes.select("fp"), scratch, bucket)
    grouped = labels.join(shuffled(classes), "fp")
    lowest = grouped.groupBy("label").agg(F.min("low").alias("component_id"))
    named = scratch.write(grouped.select("fp", "label").join(shuffled(lowest), "label").select("fp", "component_id"), "named")
    scratch.clear(own, named)
    return own.join(shuffled(named), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
