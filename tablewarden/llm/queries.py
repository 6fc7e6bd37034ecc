"""The fixed-contract queries of this subpackage.

Every query reads its whole tables, gets its rows through its operator and
derives the columns its contract names.  Their DuckDB twins are in `oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, ranking, secrets
from .captures import page_captures
from .common import held_out, table, written
from .conversations import damaged, repair_conversations
from .decontam import find_leaks
from .linededup import LineIndex
from .mixing import mix
from .neardup import near_duplicates
from .negatives import hard_negatives, scaled
from .oracle import oracle_sql  # noqa: F401
from .quality import judged, learn, voted
from .revisits import resolve_revisits
from .simhash import simhash_duplicates
from .urlfilter import host_of, judge_urls, path_of

#: The rules by host and path, and the hosts to block where no rule fits.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BLOCKED_HOSTS = tuple(f"{name}.example.{end}" for name in ("cheap-pills", "spam-farm") for end in ("com", "net", "org"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = secrets.fit(secrets.labelled_findings(spark))
    found = secrets.scan(table(spark, sf_dir, "documents"), forest, path_col="source")
    return found.select("doc_id", "place", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"), "score", "is_secret")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = written(voted(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "votes")
    return judged(votes, learn(votes)).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept", "quality")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = resolve_revisits(page_captures(table(spark, sf_dir, "pages").select("page_id", "url")))
    names = F.array_sort(F.map_keys("headers"))
    lines = F.transform(names, lambda k: F.concat(k, F.lit("="), F.element_at("headers", k)))
    return resolved.select("record_id", "record_type", "url", "response_id", "status", F.array_join(lines, ";").alias("headers"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = langid.fit(docs.filter("not held_out"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def listed_keys(pages: DataFrame) -> DataFrame:
    """Keys to block, made by rule: the blocked hosts, and of all hosts with the first part of a path those whose MD5 begins with 0 to 3."""
    hosts = pages.sparkSession.createDataFrame([(h,) for h in BLOCKED_HOSTS], "key string")
    parts = pages.select(F.concat(host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), "^/[^/]+/", 0)).alias("key"))
    return hosts.union(parts.filter(F.contains("key", F.lit("/")) & F.md5(F.col("key").cast("binary")).rlike("^[0-3]")).distinct())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "key string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, rules, listed_keys(pages)).select("page_id", "host", "path", "rule", "verdict")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, _ = mix(table(spark, sf_dir, "documents"))
    return sized.select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents comes later, goes and comes back; the result is that of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    late = F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0
    index = LineIndex.build(docs.filter(~late))
    for step in (lambda x: x.insert(docs.filter(late)), lambda x: x.delete(docs.filter(late)), lambda x: x.insert(docs.filter(late))):
        before, index = index, step(index)
        before.forget()
    kept = index.resolve(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    fitted = ranking.fit(docs.filter("not held_out"), labels)
    return ranking.score(docs, fitted).select("doc_id", "held_out", "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", scaled(F.col("embedding")).alias("vector"), relabelled.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), times_col="times")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_secret_scan, op2_minhash_near_dedup, op3_quality_rules, op4_benchmark_decontamination, op5_warc_revisits, op6_language_id,
        op7_url_filter, op8_source_mix, op9_line_dedup, op10_quality_classifier, op11_hard_negatives, op12_simhash_near_dedup, op13_conversation_repair, pipeline,
    )
    return {f.__name__: f for f in found}
