"""The folder that the driver and all executors share, and relations kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Files of evidence rows are compressed some thirty times; up to this size they are broadcast in `in_parts`.
BROADCAST = "1m"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """`df` written once and read back, where several readers would compute it again; to the shared folder, or to `folder`."""
    path = f"{folder or shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def in_parts(spark: SparkSession, parts: int) -> Iterator[None]:
    """Shuffles inside make so many parts, whatever they weigh compressed; rows that lie together by one column of a
    join's keys stay there; and only what is small once unpacked too is broadcast.  For jobs that run inside."""
    own = {
        "spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.autoBroadcastJoinThreshold": BROADCAST, "spark.sql.adaptive.autoBroadcastJoinThreshold": BROADCAST,
    }
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ranked(df: DataFrame, col: str) -> DataFrame:
    """`df` with `col` replaced by its rank from 1, over all parts: ranges of values, numbered inside, and the sizes of the ranges before."""
    own = df.repartitionByRange(col).withColumn("__part", F.spark_partition_id())
    rows = saved(own, "ranges")  # ranges come from a sample: written, so that all readers see the same ones
    sizes = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy("a.__part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("__before"))  # a row a part
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(col))
    return rows.withColumn("__inside", inside).join(before, "__part").withColumn(col, (F.col("__inside") + F.col("__before")).cast("bigint")).drop("__part", "__inside", "__before")


def _path(spark: SparkSession, path: str):
    """A path and its file system, whatever store it is in."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; none if there is no such folder."""
    where, system = _path(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, system = _path(spark, path)
    system.delete(where, True)


def path_of(folder: str, name: str) -> str:
    return f"{folder}/{name}"


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole; FileNotFoundError if there is none."""
    where, system = _path(spark, path)
    if not system.exists(where):
        raise FileNotFoundError(path)
    stream = system.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place at once by a rename."""
    draft, system = _path(spark, f"{path}.{uuid.uuid4().hex}.draft")
    stream = system.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    where, _ = _path(spark, path)
    if not system.rename(draft, where):
        system.delete(draft, False)
        raise FileExistsError(path)
