"""Mix sources to target weights by hash-threshold histograms.

A document's hash (60 bits of the MD5 of its id) is its fixed place in its
source.  The mix takes whole passes over a source and, for the rest of its
target, the documents below a hash threshold, so a larger target takes a
superset and reruns agree.  The threshold comes from histograms: sum words by
source and hash bucket, find the bucket in which the budget runs out, and sum
again inside that bucket only, four times 15 bits.  No documents are sorted and
a hot source is summed before it is shuffled.

Targets: sources in code point order, null last, have the weights in turn;
they share `percent` of all words.  A source stops at `most` times its size and
its excess is reshared by weight (closed form over the sources ordered by size
for each unit of weight).

The one bound: per-source rows (name, size, threshold) are broadcast while
there are at most `broadcast_sources` of them, else joined by shuffle.

Defined results: null and empty texts have size 0 and take 0.  Null is a source
of its own, last.  Rows with one id stand or fall together, so a repeated row
comes as often as the mix takes it, each time.  Texts are counted whole.  An
empty table gives an empty result.  `mix` reads id, text and source only;
`mix_documents` passes all columns through and replaces one called copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import words, written

WEIGHTS, PERCENT, MOST = (3, 1, 2), 150, 2
LEVEL_BITS, LEVELS = 15, 4
BROADCAST_SOURCES = 50_000


def place(doc_id: Column) -> Column:
    """60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row for each source."""
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    left_words = F.sum("source_size").over(whole) * (percent / 100) - most * F.coalesce(F.sum("source_size").over(earlier), F.lit(0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    level = weighed.withColumns({"rank": F.row_number().over(before), "level": left_words / left_weight, "cap": (most * F.col("source_size")).cast("double")})
    level = level.withColumn("over", F.col("level") * F.col("weight") > F.col("cap"))
    shared = F.min(F.when(~F.col("over"), F.struct("rank", "level"))).over(whole)["level"]
    return level.withColumn("shared", shared).select("source", "source_size", F.when(F.col("over"), F.col("cap")).otherwise(F.col("shared") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """`goals` with passes (whole copies) and cut: documents below it get one more.

    `rows` is (source, size, place).  The sum of sizes below the cut is the
    largest that the rest of the target allows.
    """
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("passes", passes).withColumns({"rest": F.col("target") - F.col("passes") * F.col("source_size"), "below": F.lit(0).cast("long"), "prefix": F.lit(0).cast("long"), "open": F.lit(True)})
    state = written(state, "goals")
    hint = F.broadcast if state.count() <= broadcast_sources else (lambda x: x)
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = rows
        if level:
            limits = state.filter("open").select(F.col("source").alias("s"), "prefix")
            inside = rows.join(hint(limits), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("place", shift + LEVEL_BITS) == F.col("prefix"))).select("source", "size", "place")
        buckets = inside.groupBy(F.col("source").alias("s"), F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        sums = buckets.withColumn("sum", F.sum("words").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        over = state.filter("open").select("source", "rest", "below").join(sums, F.col("source").eqNullSafe(F.col("s")))
        first = over.filter(F.col("below") + F.col("sum") > F.col("rest")).groupBy(F.col("source").alias("s")).agg(F.min(F.struct("bucket", (F.col("sum") - F.col("words")).alias("under"))).alias("at"))
        state = state.join(first, F.col("source").eqNullSafe(F.col("s")), "left")
        state = written(
            state.select(
                "source", "source_size", "target", "passes", "rest",
                (F.col("below") + F.coalesce("at.under", F.lit(0))).alias("below"),
                F.coalesce("at.bucket", "prefix").alias("prefix"),
                (F.col("open") & F.col("at").isNotNull()).alias("open"),
            ),
            "goals",
        )
    # no bucket runs over the rest only where the rest covers the whole source
    return state.select("source", "source_size", "target", "passes", F.when(F.col("open"), F.col("prefix")).otherwise(F.lit(1 << 60)).alias("cut"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    percent: int = PERCENT,
    most: int = MOST,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> tuple[DataFrame, DataFrame]:
    """(sized, cuts): (doc_id, source, size, source_size, target, copies, taken) for each row of
    `docs`, and one row for each source, with which `copies_of` marks any table of the documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), place(F.col(id_col)).alias("place"))
    rows = written(rows, "sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
    cuts = thresholds(rows, goals, broadcast_sources)
    sized = copies_of(rows, cuts, "source", F.col("place"), broadcast_sources).drop("place").withColumn("taken", F.col("size") * F.col("copies"))
    return sized, cuts


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """All columns of `docs`, whatever they are called, and `copies`: how often the mix takes the row.

    An input column `copies` is replaced.  Takes the options of `mix`.
    """
    _, cuts = mix(docs, **options)
    names = [c for c in docs.columns if c != "copies"]
    rows = docs.select(F.col(options.get("source_col", "source")).alias("source"), place(F.col(options.get("id_col", "doc_id"))).alias("place"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    return copies_of(rows, cuts, "source", F.col("place"), options.get("broadcast_sources", BROADCAST_SOURCES)).select("row.*", "copies")


def copies_of(rows: DataFrame, cuts: DataFrame, source_col: str, at: Column, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """`rows`, which have no columns of `cuts`, with source_size, target and copies (how often the mix takes the row)."""
    right = cuts.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if cuts.count() <= broadcast_sources else right
    joined = rows.join(right, F.col(source_col).eqNullSafe(F.col("__source")))
    return joined.withColumn("copies", F.col("passes") + (at < F.col("cut")).cast("long")).drop("__source", "passes", "cut")
