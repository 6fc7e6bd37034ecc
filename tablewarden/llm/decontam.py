"""Benchmark decontamination by SimHash of item-sized windows, in built-in expressions.

For each benchmark item of m shingles (five words; an item of fewer words is
one shingle) every window of m shingles of every document is a candidate.  A
window can only reach the similarity if it shares a shingle with the item, so
documents without any benchmark shingle leave after one scan, without a
shuffle, by a bit table of fixed size; in the others all windows over a shared shingle of an
item of that length are taken.  A document of fewer than m shingles is one window
as a whole.

* SimHash: of a window's shingles those count that occur in the benchmark, each
  once, and so do an item's own; what stands beside a passage adds nothing,
  however often it is repeated.  Windows begin where such a shingle does (any
  other holds no more of them than the next of these, or than the text's last).
  64 counters stand two in each of 32 longs, which no array can overflow.  Windows
  of up to 512 shingles are summed as they are; for longer ones sums of blocks of
  256 shingles are added up once a document, so their cost does not grow with the
  item.
* Multi-index Hamming search: a fingerprint is cut into 8 blocks of 8 bits.
  Within distance `radius` some block differs by at most radius // 8 bits, so
  items are entered under all such neighbours of each block and every
  fingerprint within the radius is found by equality.
* The exact weighted Jaccard similarity of the shingles, sum of the smaller
  weights over sum of the larger ones, must reach `percent`.  For a document and
  an item that met, each place of a shared shingle counts in an interval of
  window starts, so the running sum of their ends gives the similarity of all
  windows, in time linear in the places.
* Two kinds of documents meet items by shared shingles instead, since a
  fingerprint of single shingles says too little about weights: those shorter than
  an item, and those in which a shingle of the benchmark occurs again.  Of such a
  document's shingles in the benchmark so many are looked up, the rarest first,
  that no item at the similarity lacks all.

Scale: documents are read once for each width of shingles among the items, and no
text is shuffled, only hashes that occur in the benchmark.
The bit table has 64 bits and more for each benchmark shingle up to 2**27 bits in
all (16 MB); beyond two million shingles it passes more of the others to the
exact join, 3% at sixteen million.  Tables of items are broadcast only
where their rows take `broadcast_bytes` at most, else joined by shuffle.

Defined results: null or empty texts and items match nothing.  Items and texts
may be of any length.  Equal items all match.  Rows with one id are examined each
for itself and reported once for each item.  A row with a null id is reported
under null.  Empty tables give empty results.  Words are compared in lower case.
Columns other than id and text are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small, words

WIDTH, PERCENT, RADIUS = 5, 80, 20
BLOCKS, BLOCK_BITS = 8, 8
TABLE_BITS, MOST_TABLE_BITS = 20, 27
BROADCAST_BYTES = 32 << 20
#: What a row of a few longs takes in a broadcast, at most.
ROW_BYTES = 96
#: One bit in each of two 32-bit lanes.
LANES = 0x0000000100000001
#: Shingles to a block of sums, and the longest window that is summed without them.
BLOCK, DIRECT = 256, 512


def shingles(w: Column, width: int) -> Column:
    """64-bit hash of each run of `width` words; none if there are fewer."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))
    # bound to a lambda variable, so that the words aren't cut again for each shingle
    return F.get(F.transform(F.filter(F.array(w), lambda w: F.size(w) >= width), of), F.lit(0))


def _then(value: Column, use) -> Column:
    """use(value), with `value` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def simhashes(h: Column, ranges: Column, long: Column) -> Column:
    """Fingerprints of the `ranges` (first, k) of `h`: bit b is set where more than half of a range's hashes have it.

    `long` says whether to take them from sums of blocks.
    """

    zero, one, ks = F.lit(0).cast("long"), F.lit(1).cast("long"), F.sequence(F.lit(0), F.lit(31))
    right = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    left = lambda x, k: F.call_function("shiftleft", x, k)

    def counted(k: Column) -> Column:
        """For each range, how many hashes have bit k (low half) and bit 32 + k (high half)."""
        total = lambda part: F.aggregate(part, zero, lambda a, x: a + right(x, k).bitwiseAND(F.lit(LANES)))
        plain = F.transform(ranges, lambda r: total(F.slice(h, r["first"] + 1, r["k"])))
        blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(h) / BLOCK).cast("int")), lambda b: total(F.slice(h, b * BLOCK + 1, F.lit(BLOCK))))
        before = lambda sums: F.transform(sums, lambda _, b: F.aggregate(F.slice(sums, F.lit(1), b), zero, lambda a, x: a + x))
        upto = lambda p, x: F.get(p, F.floor(x / BLOCK).cast("int")) + total(F.slice(h, x - x % BLOCK + 1, x % BLOCK))
        summed = _then(_then(blocks, before), lambda p: F.transform(ranges, lambda r: upto(p, r["first"] + r["k"]) - upto(p, r["first"])))
        return F.when(long, summed).otherwise(plain)

    def bits(total: Column, k: Column, of: Column) -> Column:
        low, high = total.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(total, 32)
        return F.when(2 * low > of, left(one, k)).otherwise(zero).bitwiseOR(F.when(2 * high > of, left(one, k + 32)).otherwise(zero))

    of_range = lambda sums, i, r: F.aggregate(ks, zero, lambda f, k: f.bitwiseOR(bits(F.get(F.get(sums, k), i), k, r["k"])))
    return _then(F.transform(ks, counted), lambda sums: F.transform(ranges, lambda r, i: of_range(sums, i, r)))


def _neighbours(flips: int) -> list[int]:
    """All 8-bit masks of at most `flips` bits."""
    return [sum(1 << i for i in c) for k in range(min(flips, BLOCK_BITS) + 1) for c in combinations(range(BLOCK_BITS), k)]


def _block(f: Column, b: int) -> Column:
    return F.shiftrightunsigned(f, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _bit_table(hashes: DataFrame, bits: int) -> Column:
    """Bloom table of `hashes` (h) as one array of longs, a scalar subquery; 3 bits for each hash."""
    places = hashes.select(F.explode(F.array(*[_bit_at(F.col("h"), s, bits) for s in _shifts(bits)])).alias("at"))
    some = places.select(F.shiftright("at", 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63))).alias("w"))
    every = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("w"))
    packed = some.union(every).groupBy("i").agg(F.bit_or("w").alias("w"))
    return packed.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("table")).scalar()


def _shifts(bits: int) -> tuple[int, int, int]:
    return 64 - bits, (64 - bits) // 2, 0


def _bit_at(h: Column, shift: int, bits: int) -> Column:
    return F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _in_table(h: Column, table: Column, bits: int) -> Column:
    found = F.lit(True)
    for shift in _shifts(bits):
        at = _bit_at(h, shift, bits)
        found = found & (F.call_function("shiftrightunsigned", F.get(table, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)
    return found


def _below(sorted_values: Column, bound: Column, low: Column, high: Column) -> Column:
    """How many of the sorted values lie below `bound`, known to be from `low` to `high`; by halving."""
    step = lambda r: F.struct(
        F.when(F.get(sorted_values, F.floor((r["low"] + r["high"]) / 2).cast("int")) < bound, F.floor((r["low"] + r["high"]) / 2).cast("int") + 1).otherwise(r["low"]).alias("low"),
        F.when(F.get(sorted_values, F.floor((r["low"] + r["high"]) / 2).cast("int")) < bound, r["high"]).otherwise(F.floor((r["low"] + r["high"]) / 2).cast("int")).alias("high"),
    )
    begin = F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"))
    halve = lambda r, _: F.when(r["low"] < r["high"], step(r)).otherwise(r)
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), begin, halve, lambda r: r["low"])


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    radius: int = RADIUS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, shared, joined): for each document and item the most
    similar window, the first among equals; the similarity is shared / joined."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), words(F.lower(F.col(text_col).cast("string"))).alias("w"))
    items = benchmark.select(F.monotonically_increasing_id().alias("item_no"), F.col(item_col).alias("item_id"), words(F.lower(F.col(item_text_col).cast("string"))).alias("w")).filter(F.size("w") > 0)
    items = scratch.write(items.withColumn("width", F.least(F.size("w"), F.lit(width))), "items")
    rows = None
    for k in range(1, width + 1):
        own = items.filter(F.col("width") == k)
        if own.limit(1).count():
            found = _of_width(texts, own, k, percent, radius, broadcast_bytes, scratch)
            rows = found if rows is None else rows.union(found)
    if rows is None:
        none = docs.sparkSession.createDataFrame([], "start_word int, n_words int, shared int, joined int")
        return docs.select(F.col(id_col).alias("doc_id")).join(benchmark.select(F.col(item_col).alias("item_id")), F.lit(False)).join(none, F.lit(False))
    best = F.max_by(F.struct("start_word", "n_words", "shared", "joined"), F.struct(F.col("shared") / F.col("joined"), -F.col("start_word")))
    rows = rows.groupBy("doc_id", "item_no").agg(best.alias("best"))
    found = scratch.write(rows.join(items.select("item_no", "item_id"), "item_no").select("doc_id", "item_id", "best.*"), "leaks")
    scratch.clear(found)
    return found


def _of_width(texts: DataFrame, items: DataFrame, width: int, percent: int, radius: int, broadcast_bytes: int, scratch: Scratch) -> DataFrame:
    """(doc_id, item_no, start_word, n_words, shared, joined) for each text and item that are similar."""
    fits = broadcast_bytes // ROW_BYTES
    items = scratch.write(items.select("item_no", shingles(F.col("w"), width).alias("ih")).withColumn("m", F.size("ih")), "items")
    weights = scratch.write(items.select("item_no", "m", F.explode("ih").alias("h")).groupBy("item_no", "m", "h").agg(F.count("*").cast("int").alias("weight")), "weights")
    hashes = scratch.write(weights.groupBy("h", "m").agg(F.count("*").alias("k")), "hashes")
    n, owned = hashes.count(), weights.count()
    bits = min(MOST_TABLE_BITS, max(TABLE_BITS, (64 * n).bit_length()))
    table = _bit_table(hashes.select("h"), bits)

    hashed = texts.select("doc_id", "t", shingles(F.col("w"), width).alias("h"))
    hits = hashed.select("doc_id", "t", F.size("h").alias("n"), F.posexplode("h").alias("p", "h")).filter(_in_table(F.col("h"), table, bits))
    hits = scratch.write(hits.join(small(hashes.select("h").distinct(), n, fits), "h", "left_semi").distinct(), "hits")
    places = hits.join(small(hashes, n, fits), "h").groupBy("doc_id", "t", "n", "m")
    places = places.agg(F.array_sort(F.collect_list(F.struct("p", "h"))).alias("at"), F.array_sort(F.collect_set(F.struct("k", "h"))).alias("hs"))
    places = places.withColumns({"ps": F.col("at")["p"], "short": F.col("n") < F.col("m"), "again": F.size("hs") < F.size("at")})
    # a window at the similarity shares at least `need` shingles with the item, so it holds `need` of these places
    need = F.ceil((F.col("m") + F.least("n", "m")) * percent / (100 + percent)).cast("int")
    last = lambda i: F.get("ps", i + F.col("need") - 1)
    runs = F.filter(F.sequence(F.lit(0), F.size("ps") - F.col("need")), lambda i: last(i) - F.get("ps", i) < F.col("m"))
    enough = scratch.write(places.withColumn("need", need).filter(F.size("ps") >= F.col("need")).withColumn("runs", runs).filter(F.col("short") | (F.size("runs") > 0)), "places")
    # at most size(ps) - need of these places are not this item's, so one of any size(ps) - need + 1 is
    keys = F.slice("hs", 1, F.size("ps") - F.col("need") + 1)["h"]
    # the places of the window that begins with the i-th, or of the text's last one
    ends = F.transform("runs", lambda i: F.struct(i.alias("i"), F.get("ps", i).alias("s")))
    held = lambda x: F.struct(x["i"].alias("first"), (_below(F.col("ps"), x["s"] + F.col("m"), x["i"], F.least(x["i"] + F.col("m"), F.size("ps"))) - x["i"]).alias("k"))
    ranges = enough.filter(~F.col("short") & ~F.col("again")).select("doc_id", "t", "m", F.col("at")["h"].alias("h"), F.transform(ends, held).alias("ranges"))
    fingerprints = F.array_distinct(simhashes(F.col("h"), F.col("ranges"), F.col("m") > DIRECT))
    windows = scratch.write(ranges.select("doc_id", "t", "m", F.explode(fingerprints).alias("f")), "windows")

    flips = radius // BLOCKS
    masks = F.array(*map(F.lit, _neighbours(flips)))
    slot = lambda b: lambda v: (F.col("m").cast("long") * BLOCKS + b) * (1 << BLOCK_BITS) + v
    slots = lambda f, values: F.flatten(F.array(*[F.transform(values(_block(f, b)), slot(b)) for b in range(BLOCKS)]))
    own = items.select("item_no", "m", F.array_distinct("ih").alias("ih"))
    marks = own.withColumn("g", simhashes(F.col("ih"), F.array(F.struct(F.lit(0).alias("first"), F.size("ih").alias("k"))), F.col("m") > DIRECT)[0])
    entries = marks.select("item_no", "g", F.explode(slots(F.col("g"), lambda v: F.transform(masks, lambda x: v.bitwiseXOR(x)))).alias("slot"))
    entries = scratch.write(entries, "entries")
    probes = windows.withColumn("slot", F.explode(slots(F.col("f"), F.array)))
    near = probes.join(small(entries, entries.count(), fits), "slot").filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= radius)
    whole = enough.filter(F.col("short") | F.col("again")).select("doc_id", "t", "m", F.explode(keys).alias("h")).join(small(weights, owned, fits), ["m", "h"])
    pairs = scratch.write(near.select("doc_id", "t", "m", "item_no").union(whole.select("doc_id", "t", "m", "item_no")).distinct(), "pairs")
    return _verified(hits, pairs, weights, width, percent, fits, owned)


def _verified(hits: DataFrame, pairs: DataFrame, weights: DataFrame, width: int, percent: int, fits: int, owned: int) -> DataFrame:
    """The best window of each pair, by exact weights.

    The j-th place of a shingle that the item holds k times adds to a window that
    holds it but not the one k places before: to an interval of starts.
    """
    of = pairs.select(F.col("doc_id").alias("id"), F.col("t").alias("u"), "m", "item_no")
    met = hits.join(of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("u"))).drop("id", "u").join(small(weights.drop("m"), owned, fits), ["item_no", "h"])
    size = F.least("n", "m")
    one = met.groupBy("doc_id", "t", "item_no", "n", "m", "h", "weight").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # places of one shingle in one text
    interval = lambda p, i: F.struct(F.greatest(p - size + 1, F.get("ps", i - F.col("weight")) + 1, F.lit(0)).alias("lo"), F.least(p, F.col("n") - size).alias("hi"))
    spans = F.filter(F.transform("ps", interval), lambda x: x["lo"] <= x["hi"])
    ends = F.flatten(F.transform(spans, lambda x: F.array(F.struct(x["lo"].alias("s"), F.lit(1).alias("d")), F.struct((x["hi"] + 1).alias("s"), F.lit(-1).alias("d")))))
    pair = ["doc_id", "t", "item_no", "n", "m"]
    steps = one.select(*pair, F.explode(ends).alias("e")).groupBy(*pair, F.col("e.s").alias("s")).agg(F.sum("e.d").alias("d"))
    shared = F.sum("d").over(Window.partitionBy(*pair).orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    best = steps.withColumn("shared", shared).groupBy(*pair).agg(F.max_by(F.struct("s", "shared"), F.struct("shared", -F.col("s"))).alias("b"))
    found = best.select("doc_id", "item_no", F.col("b.s").cast("int").alias("start_word"), (size + width - 1).cast("int").alias("n_words"), F.col("b.shared").cast("int").alias("shared"), (size + F.col("m") - F.col("b.shared")).cast("int").alias("joined"))
    return found.filter(F.col("shared") * 100 >= F.col("joined") * percent)
