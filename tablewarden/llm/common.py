"""What several operators share: words, shared scratch tables, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

#: The separators of words, space and the controls 0x09 to 0x0D.
SEPARATORS = " \t\n\x0b\x0c\r"


#: Keys that `meet` broadcasts are fewer than this.
HOT_KEYS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(text: Column) -> Column:
    """Text cut at every single separator; empty pieces stay.  Null is ''."""
    flat = F.coalesce(text, F.lit(""))
    for ch in SEPARATORS[1:]:
        flat = F.replace(flat, F.lit(ch), F.lit(" "))
    return F.split(flat, " ")


def words(text: Column) -> Column:
    """Array of the maximal runs without separators."""
    return F.array_remove(pieces(text), "")


def long_id(docs: DataFrame, id_col: str) -> Column:
    """The id as a long; ids that aren't whole numbers are refused here, before a job fails on one of them."""
    kind = docs.select(F.col(id_col)).schema[0].dataType
    if not isinstance(kind, IntegralType | NullType):
        raise TypeError(f"{id_col} is {kind.simpleString()}; ids must be whole numbers")
    return F.col(id_col).cast("long")


def bucket_of(key: Column, n: int) -> Column:
    """0 or 1: the fold of a row, by the CRC-32 of its id as text."""
    return F.crc32(key.cast("string").cast("binary")) % n


def held_out(doc_id: Column) -> Column:
    """True where no model may learn from the row; a null id is held out."""
    return F.coalesce(bucket_of(doc_id, 5) == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``; only a local session, where
    that is unset, gets a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage: an executor lost later costs no recomputation, and
    what several branches read is computed once.
    """
    return Scratch(df.sparkSession).write(df, label)


class Scratch:
    """The shared tables that one run of an operator writes; it deletes those that its result does not read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def clear(self, *keep: DataFrame) -> None:
        """Delete all tables but those in `keep`; nothing that is still to be computed may read them."""
        for df, path in self.tables:
            if not any(df is k for k in keep):
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        self.tables = [(df, path) for df, path in self.tables if any(df is k for k in keep)]


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """`df`, to be broadcast where it has at most `most` rows."""
    return F.broadcast(df) if rows <= most else df


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, to be shuffled in its next join, whatever size Spark takes the sides for.

    Spark goes by compressed files, and takes what `explode` gives for one row a
    list: it would send millions of rows through the driver.
    """
    return df.hint("merge")


def meet(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """`rows` with the columns of `keys`, which has one row a key and counts in `size` how many of the `total` rows it has.

    A key with more than one in HOT_KEYS of all rows is hot; since there are
    fewer than HOT_KEYS of them at any total, they are broadcast.  The others are
    shuffled, and none brings more than its small share to one task.  Both tables
    are read twice and should be written ones.
    """
    is_hot = F.col(size) * HOT_KEYS > total
    hot, rest = F.broadcast(keys.filter(is_hot)), keys.filter(~is_hot)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on))
