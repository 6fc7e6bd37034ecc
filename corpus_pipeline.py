"""From raw documents to a training mix: five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps; its
result is written as Parquet and read back as the next stage's `docs`.  All
stages but the last return the columns of `documents`.  The last one repeats a
row as often as the mix takes it and adds `copies` and `copy`, which replace
columns of these names.

Defined results: null and empty texts fail the quality rules' base test and go.
Very long texts are read whole in every stage.  Rows that repeat an id are rows
of their own in all stages but these: line dedup takes them as one document, and
near dedup keeps those rows whose id is kept.  A null id stays unless a stage
drops its text.  Columns may have any names, also those that operators use.
Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewarden.llm.common import shared_dir, small, written
from tablewarden.llm.decontam import find_leaks
from tablewarden.llm.linededup import dedup_lines
from tablewarden.llm.mixing import mix_documents
from tablewarden.llm.neardup import near_duplicates
from tablewarden.llm.quality import judge
from tablewarden.workspace import delete

#: Ids that are broadcast, a long each; more of them meet the documents in a shuffled join.
BROADCAST_IDS = 1_000_000


def _packed(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row, so that no column of the documents meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """`docs` without the ids of `gone`, which are broadcast where they are few, so that no text is shuffled."""
    ids = written(gone.select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(small(ids, ids.count(), BROADCAST_IDS), F.col("doc_id").eqNullSafe(F.col("__gone")), "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or that the weighed rules reject go."""
    return judge(_packed(docs)).filter("kept").select("__row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more in three documents or more stay in the largest id only."""
    kept = dedup_lines(_packed(docs))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest id."""
    judged = near_duplicates(docs, width=5, percent=80)
    return _without(docs, judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row comes once for each copy that the mix takes."""
    mixed = mix_documents(docs).filter("copies > 0")
    kept = [F.col(f"`{c}`") for c in mixed.columns if c != "copy"]
    return mixed.select(*kept, F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
]

#: MinHash bands and EM posteriors are not SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written is deleted once the next one's is on disk."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
