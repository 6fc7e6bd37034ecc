"""Hard negatives of anchors by dual-tree search over integer vectors.

Method: two trees, one over the anchors and one over all vectors as candidates.
A vector's place is its label and the signs of its projections on random
directions through the mean, three to a digit; a cell with too many rows is cut
further by a hash of the id, so that a leaf holds some `LEAF` rows whatever the
data.  A node knows a centre, a radius around it that covers all of its rows,
its labels, and, over anchors, what its anchors still look for.  The inner
product of a row of node A with one of node B lies within

    a.b -/+ (|a| rb + |b| ra + ra rb)        (a, b: centres; ra, rb: radii)

and the pair of nodes is dropped with all pairs of rows below it where that
interval meets nothing wanted:

* positives: rows of the same label; wanted from the fifth best score that every
  anchor of A has among the rows of its own leaf of the candidates' tree,
* negatives: rows of other labels; wanted between the least and the greatest
  bound that the positives of A's anchors set.

The search starts at the two roots and goes down by joins of the surviving pairs
with their children, a job for each level.  Pairs of leaves are scored exactly, a
matrix product for each pair, with the scores of a task's earlier blocks as
floors, and the best rows of an anchor are ranked by a window that keeps five a
task before its shuffle.  Anchors' blocks go to candidates' blocks; candidates
are moved once.

What it can't do: random vectors in many dimensions lie about as far from one
another as from any centre, so that their nodes' intervals hold almost every
score, and most pairs of leaves are scored then.  Pruning works by label, and on
groups of vectors that are close to one another.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part.  Of rows that share an id the one with the
least label, then the least vector, takes part.  A shorter vector counts as one
with zeros behind.  Components of `LARGEST` or more in size, whose scores could
leave 64 bits, take no part with their row either.  An empty table, and a table
without anchors, gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SEED = 11
#: Three directions to a digit of a place, after two digits for the label.
DIGITS, FANOUT = 6, 8
#: Rows of a leaf of candidates and of anchors.
LEAF, ANCHOR_LEAF = 1024, 64
LARGEST = 1 << 24
#: Anchors whose floors a task remembers; beyond that it forgets them and reports more rows.
REMEMBERED = 100_000
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component; null where a component is null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor)))


def _matrix(items: pa.Array, d: int, field: str = "v") -> np.ndarray:
    """The vectors of one block, a row each."""
    return items.field(field).flatten().to_numpy(zero_copy_only=False).reshape(len(items), d)


def _stats(rows: DataFrame) -> tuple[int, int, np.ndarray] | None:
    """Dimensions, largest component and mean; partial sums come to the driver, a row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, total = 0, 0, np.zeros(0)
        for batch in batches:
            for x in batch.column(0):
                v = x.values.to_numpy(zero_copy_only=False)
                if len(v) > len(total):
                    total = np.concatenate([total, np.zeros(len(v) - len(total))])
                total[: len(v)] += v
                most, n = max(most, int(np.abs(v).max(initial=0))), n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most]), pa.array([total])], ["n", "most", "total"])

    parts = rows.select("v").mapInArrow(run, "n long, most long, total array<double>").collect()
    if not parts:
        return None
    d = max(len(p["total"]) for p in parts)
    total = sum(np.pad(np.array(p["total"], float), (0, d - len(p["total"]))) for p in parts)
    return d, max(p["most"] for p in parts), total / sum(p["n"] for p in parts)


def _placed(rows: DataFrame, d: int, mean: np.ndarray) -> DataFrame:
    """`rows` (vec_id, label, v) with vectors of full length and their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions = np.random.default_rng(SEED).standard_normal((d, 3 * DIGITS))
        weights = 1 << np.arange(3 * DIGITS)[::-1]
        for batch in batches:
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            signs = ((v - mean) @ directions > 0) @ weights
            places = [f"{label % 64:02o}{sign:0{DIGITS}o}" for label, sign in zip(batch.column(1).to_pylist(), signs.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.string())], ["vec_id", "label", "v", "place"])

    full = F.concat("v", F.array_repeat(F.lit(0).cast("int"), F.lit(d) - F.size("v")))
    return rows.select("vec_id", "label", full.alias("v")).mapInArrow(run, "vec_id long, label long, v array<int>, place string")


def _leaves(rows: DataFrame, most: int) -> DataFrame:
    """`rows` with `path`: the shortest beginning of the place that at most `most` rows share, or the place and digits of a hash."""
    counts = rows.groupBy("place").agg(F.count("*").alias("n"))
    parts = counts.select("place", "n", F.explode(F.sequence(F.lit(2), F.length("place"))).alias("depth")).withColumn("part", F.substring("place", F.lit(1), F.col("depth")))
    totals = parts.groupBy("part").agg(F.sum("n").alias("total"))
    found = parts.join(totals, "part").groupBy("place").agg(F.min(F.when(F.col("total") <= most, F.col("depth"))).alias("depth"), F.min("total").alias("total"))
    more = F.when(F.col("depth").isNull(), F.ceil(F.log(F.col("total") / F.lit(float(most))) / math.log(FANOUT))).otherwise(0).cast("int")
    digits = F.lpad(F.conv(F.pmod(F.xxhash64("vec_id"), F.lit(FANOUT**10)).cast("string"), 10, FANOUT), 10, "0")
    path = F.concat(F.substring("place", F.lit(1), F.coalesce("depth", F.length("place"))), F.substring(digits, F.lit(1), more))
    return rows.join(found.select("place", "depth", "total"), "place").withColumn("path", path).drop("place", "depth", "total")


def _blocks(leaves: DataFrame, d: int, fields: list[str], *more: Column) -> DataFrame:
    """(path, items, center, radius, labels, low, high, ...): a row for each leaf; labels is a bit set of labels modulo 64."""
    grouped = leaves.groupBy("path").agg(F.collect_list(F.struct(*fields)).alias("items"), F.bit_or(F.expr("shiftleft(1L, int(pmod(label, 64)))")).alias("labels"), F.min("label").alias("low"), F.max("label").alias("high"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centers, radii = [], []
            for items in batch.column("items"):
                v = _matrix(items.values, d).astype(float)
                centers.append(v.mean(axis=0))
                radii.append(float(np.sqrt(((v - centers[-1]) ** 2).sum(axis=1).max())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centers, pa.list_(pa.float64())), pa.array(radii)], [*batch.schema.names, "center", "radius"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grouped.schema)
    return grouped.mapInArrow(run, f"{kinds}, center array<double>, radius double")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _nodes(blocks: DataFrame, scratch: Scratch, *wanted: Column) -> DataFrame:
    """(node, center, norm, radius, labels, low, high, leaf, ...) for every beginning of a path.

    A centre is the mean of the leaves' centres; the radius covers the leaves' balls.
    """
    up = blocks.drop("items").withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("path")))).withColumn("node", F.substring("path", F.lit(1), F.col("depth")))
    sums = up.select("node", F.posexplode("center")).groupBy("node", "pos").agg(F.avg("col").alias("mean"))
    centers = sums.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("c"))
    reach = F.col("radius") + _norm(F.zip_with("center", "c", lambda x, y: x - y))
    rest = [F.bit_or("labels").alias("labels"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.length("path") == F.col("depth")).alias("leaf")]
    found = up.join(centers, "node", "left").withColumn("c", F.coalesce("c", F.array().cast("array<double>"))).groupBy("node").agg(F.first("c").alias("center"), F.max(reach).alias("radius"), *rest, *wanted)
    return scratch.write(found.withColumn("norm", _norm(F.col("center"))), "nodes")


def _steps(nodes: DataFrame, name: str) -> DataFrame:
    """(name, down): from each node to its children, from each leaf to itself."""
    own = F.struct(*nodes.columns).alias("down")
    children = nodes.filter("node != ''").select(F.expr("left(node, length(node) - 1)").alias(name), own)
    return children.union(nodes.filter("leaf").select(F.col("node").alias(name), own))


def _meetings(a: DataFrame, b: DataFrame, alive: Callable[[Column, Column, Column, Column], Column], scratch: Scratch) -> DataFrame:
    """(a, b): the pairs of leaves that no interval on their way rules out."""
    x, y = F.col("x"), F.col("y")
    dot = F.aggregate(F.zip_with("x.center", "y.center", lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    slack = x["norm"] * y["radius"] + y["norm"] * x["radius"] + x["radius"] * y["radius"]
    slack = slack + (x["norm"] + x["radius"]) * (y["norm"] + y["radius"]) * 1e-9 + 1e-6  # for what rounding loses
    down_a, down_b = _steps(a, "a").withColumnRenamed("down", "x"), _steps(b, "b").withColumnRenamed("down", "y")
    levels = max(n.agg(F.max(F.length("node"))).first()[0] or 0 for n in (a, b))
    pairs = a.sparkSession.createDataFrame([("", "")], "a string, b string")
    for _ in range(levels):
        met = pairs.join(down_a, "a").join(down_b, "b").filter(alive(x, y, dot - slack, dot + slack))
        pairs = scratch.write(met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), "pairs")
    return pairs


class _Best:
    """The best scores that a task has seen for each key, as floors for what it still reports."""

    def __init__(self, most: int) -> None:
        self.most, self.scores = most, {}

    def floor(self, key, default):
        kept = self.scores.get(key, ())
        return kept[-1] if len(kept) == self.most else default

    def add(self, key, scores: list) -> None:
        if len(self.scores) >= REMEMBERED and key not in self.scores:
            self.scores.clear()
        self.scores[key] = sorted([*self.scores.get(key, ()), *scores], reverse=True)[: self.most]


def _ranked(scores: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions `at`, by score downwards and then by id."""
    return at[np.lexsort((ids[at], -scores[at]))]


def _scores(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; by floating point where every partial sum is exact in it."""
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T


def _scored(pairs: DataFrame, a: DataFrame, b: DataFrame, found: Callable, schema: str) -> DataFrame:
    """What `found(anchors, candidates)` reports for each pair of blocks."""
    both = pairs.join(a.select(F.col("path").alias("a"), F.col("items").alias("anchors")), "a").join(b.select(F.col("path").alias("b"), F.col("items").alias("candidates")), "b")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = found()
        for batch in batches:
            rows = [row for anchors, candidates in zip(batch.column(0), batch.column(1), strict=True) for row in report(anchors.values, candidates.values)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return both.select("anchors", "candidates").mapInArrow(run, schema)


def _longs(items: pa.Array, field: str) -> np.ndarray:
    return items.field(field).to_numpy(zero_copy_only=False)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "vector",
    label_col: str = "label",
    positives: int = 5,
    negatives: int = 5,
    percent: tuple[int, int] = (80, 100),
    leaf: int = LEAF,
    anchor_leaf: int = ANCHOR_LEAF,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` holds arrays of whole numbers.  `is_anchor` is a condition on a
    column `vec_id`, which holds the ids.  An anchor's positives are its first
    rows of the same label; for each of them the first rows of other labels are
    returned whose score is at least and at most the two percentages of the
    positive's.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    low, high = percent
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<long>").alias("v"))
    sized = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))
    own = own.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sized).groupBy("vec_id").agg(F.min(F.struct("label", F.col("v").cast("array<int>").alias("v"))).alias("r"))
    rows = scratch.write(own.select("vec_id", "r.label", "r.v"), "vectors")
    stats = _stats(rows)
    if stats is None:
        return spark.createDataFrame([], OUT)
    d, most, mean = stats
    if d * most * most * max(low, high, 1) >= 1 << 63:
        raise ValueError(f"{d} components of up to {most} have inner products beyond 64 bits")
    exact = d * most * most < 1 << 53
    placed = scratch.write(_placed(rows, d, mean).withColumn("anchor", F.coalesce(is_anchor, F.lit(False))), "placed")
    candidates = scratch.write(_blocks(_leaves(placed, leaf), d, ["vec_id", "label", "v", "anchor"]), "candidates")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, floors = [], []
            for block in batch.column(0):
                items = block.values
                v, label, of, anchor = _matrix(items, d), _longs(items, "label"), _longs(items, "vec_id"), np.flatnonzero(_longs(items, "anchor"))
                for begin in range(0, len(anchor), anchor_leaf):
                    part = anchor[begin : begin + anchor_leaf]
                    scores = _scores(v[part], v, exact)
                    for i, s in zip(part, scores, strict=True):
                        mine = s[(label == label[i]) & (of != of[i])]
                        ids.append(of[i])
                        floors.append(int(np.partition(mine, -positives)[-positives]) if len(mine) >= positives else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(floors, pa.int64())], ["vec_id", "floor"])

    floors = candidates.select("items").mapInArrow(seeds, "vec_id long, floor long")
    anchors = scratch.write(_leaves(placed.filter("anchor"), anchor_leaf).join(floors, "vec_id"), "anchors")
    # a group without a floor wants every score
    blocks = scratch.write(_blocks(anchors, d, ["vec_id", "label", "v", "floor"], F.min(F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf")))).alias("floor")), "anchors")
    tree = _nodes(candidates, scratch)
    same = lambda x, y, lo, hi: (x["labels"].bitwiseAND(y["labels"]) != 0) & (hi >= x["floor"])
    pairs = _meetings(_nodes(blocks, scratch, F.min("floor").alias("floor")), tree, same, scratch)

    def best_positives():
        best = _Best(positives)

        def report(a: pa.Array, b: pa.Array) -> Iterator[tuple]:
            scores = _scores(_matrix(a, d), _matrix(b, d), exact)
            ids, labels = _longs(b, "vec_id"), _longs(b, "label")
            for s, anchor, label, floor in zip(scores, _longs(a, "vec_id"), _longs(a, "label"), a.field("floor").to_pylist(), strict=True):
                least = max((x for x in (floor, best.floor(anchor, None)) if x is not None), default=None)
                fits = (labels == label) & (ids != anchor)
                at = _ranked(s, ids, np.flatnonzero(fits if least is None else fits & (s >= least)))[:positives]
                best.add(anchor, s[at].tolist())
                yield from zip([anchor] * len(at), ids[at].tolist(), s[at].tolist(), strict=True)

        return report

    scored = _scored(pairs, blocks, candidates, best_positives, "vec_id long, positive_id long, positive_score long")
    first = Window.partitionBy("vec_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = scored.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives).filter("positive_score >= 0")  # nothing lies between 80 and 100 percent of less
    goals = chosen.groupBy("vec_id").agg(
        F.collect_list(F.struct("positive_id", "positive_score")).alias("goals"), F.min(F.col("positive_score") * low / 100).alias("least"), F.max(F.col("positive_score") * high / 100).alias("greatest")
    )
    blocks = scratch.write(_blocks(anchors.drop("floor").join(goals, "vec_id"), d, ["vec_id", "label", "v", "goals"], F.min("least").alias("least"), F.max("greatest").alias("greatest")), "goals")
    others = lambda x, y, lo, hi: ~((x["low"] == x["high"]) & (y["low"] == y["high"]) & (x["low"] == y["low"])) & (hi >= x["least"]) & (lo <= x["greatest"])
    pairs = _meetings(_nodes(blocks, scratch, F.min("least").alias("least"), F.max("greatest").alias("greatest")), tree, others, scratch)

    def best_negatives():
        best = _Best(negatives)

        def report(a: pa.Array, b: pa.Array) -> Iterator[tuple]:
            scores = _scores(_matrix(a, d), _matrix(b, d), exact)
            ids, labels = _longs(b, "vec_id"), _longs(b, "label")
            for s, anchor, label, goals in zip(scores, _longs(a, "vec_id"), _longs(a, "label"), a.field("goals").to_pylist(), strict=True):
                all_low, all_high = (f(g["positive_score"] for g in goals) for f in (min, max))
                at = _ranked(s, ids, np.flatnonzero((labels != label) & (100 * s >= low * all_low) & (100 * s <= high * all_high)))
                sinking, to = -s[at], ids[at]
                for goal in goals:
                    p = goal["positive_score"]
                    begin = np.searchsorted(sinking, -(high * p // 100))
                    end = np.searchsorted(sinking, (-low * p) // 100, side="right")
                    key = (anchor, goal["positive_id"])
                    floor = best.floor(key, None)
                    end = min(end, begin + negatives) if floor is None else min(end, begin + negatives, np.searchsorted(sinking, -floor, side="right"))
                    if begin < end:
                        found = (-sinking[begin:end]).tolist()
                        best.add(key, found)
                        yield from ((*key, n, p, f) for n, f in zip(to[begin:end].tolist(), found, strict=True))

        return report

    scored = _scored(pairs, blocks, candidates, best_negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = scratch.write(scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives), "ranked")
    scratch.clear(ranked)
    return ranked.select(*[part.split()[0] for part in OUT.split(", ")])
