"""Not-modified revisits of web captures: an as-of join by canonical url.

A revisit (a capture that answered "not modified") has no payload.  It is
resolved to the latest earlier full response of its canonical url if its
validators agree with that response: an entity tag on both sides decides, by
weak comparison; else a modification time on both sides; else there is nothing
to check.  The merged headers are the response's, updated by those of the
revisit that a not-modified answer may change.

Skew: rows are dealt by range of (url, time), so a url that holds a third of all
rows spreads over as many partitions as its rows fill.  The latest response so
far is found by a window inside (url, partition); what earlier partitions of the
same url end with is carried in from one small row for each (url, partition).
Payloads are never moved: a resolved row names its response by id.

Defined results: records with a null url or time, revisits before any response
and those whose validators disagree stay unresolved, with a `status` that says
so.  A response at the revisit's own time is not earlier.  Of responses at one
time the largest id counts.  Header names are compared in lower case; of equal
names the spelling that sorts last counts.  Empty tables give empty results.
Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

#: Header fields that a not-modified answer may update.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
#: Query parameters that don't select content.
TRACKING = r"(utm_[a-z]+|ref|fbclid|gclid)"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default ports, path without a closing slash, sorted
    query without tracking parameters; neither scheme nor fragment.  Null without ``://``."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^#]*?\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(f"^{TRACKING}(=|$)")))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))))


def _lowered(headers: Column) -> Column:
    """Map with names in lower case; of equal names the spelling that sorts last counts."""
    entries = F.array_sort(F.map_entries(headers))
    last = lambda k: F.get(F.reverse(F.filter(entries, lambda e: F.lower(e["key"]) == k)), F.lit(0))["value"]
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(e["key"])))
    return F.map_from_arrays(names, F.transform(names, last))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.try_element_at(headers, F.lit("etag")), r'^W/', "")


def resolve_revisits(
    records: DataFrame,
    *,
    id_col: str = "record_id",
    type_col: str = "record_type",
    url_col: str = "url",
    time_col: str = "captured_at",
    headers_col: str = "headers",
    permitted: tuple[str, ...] = PERMITTED,
    partitions: int | None = None,
) -> DataFrame:
    """(record_id, record_type, url, captured_at, response_id, status, headers) for each record.

    A record is a revisit where its type is ``revisit`` and a full response
    where it is ``response``; other types are ignored.  `status` is full,
    resolved, mismatch, no_response or invalid; `headers` are merged where the
    revisit is resolved.
    """
    spark = records.sparkSession
    rows = records.select(
        F.col(id_col).alias("record_id"), F.col(type_col).alias("record_type"), canonical(F.col(url_col)).alias("url"), F.col(time_col).alias("captured_at"),
        _lowered(F.coalesce(F.col(headers_col), F.create_map().cast("map<string,string>"))).alias("headers"),
    ).filter(F.col("record_type").isin("response", "revisit"))
    rows = rows.withColumn("full", (F.col("record_type") == "response").cast("int"))
    valid = F.col("url").isNotNull() & F.col("captured_at").isNotNull()
    order = ["captured_at", "full", "record_id"]  # a revisit comes before responses of its own time
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(count, "url", *order).withColumn("part", F.spark_partition_id()), "dealt")

    response = F.when((F.col("full") == 1) & valid, F.struct("record_id", "headers"))
    here = Window.partitionBy("url", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("response", F.last(response, ignorenulls=True).over(here))
    ends = dealt.filter(valid & (F.col("full") == 1)).groupBy("url", "part").agg(F.max_by(F.struct("record_id", "headers"), F.struct(*order)).alias("end"))
    groups = dealt.filter(valid).select("url", "part").distinct().join(ends, ["url", "part"], "left")
    before = Window.partitionBy("url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.withColumn("carried", F.last("end", ignorenulls=True).over(before)).filter("carried is not null").select(F.col("url").alias("u"), F.col("part").alias("p"), "carried")
    met = near.join(carried, (F.col("url") == F.col("u")) & (F.col("part") == F.col("p")), "left").withColumn("response", F.coalesce("response", "carried"))

    own, theirs = F.col("headers"), F.col("response.headers")
    agree = F.coalesce(_tag(own) == _tag(theirs), own["last-modified"] == theirs["last-modified"], F.lit(True))
    status = (
        F.when(~valid, F.lit("invalid")).when(F.col("full") == 1, F.lit("full"))
        .when(F.col("response").isNull(), F.lit("no_response")).when(agree, F.lit("resolved")).otherwise(F.lit("mismatch"))
    )
    allowed = F.array(*map(F.lit, permitted))
    updates = F.map_filter(own, lambda k, v: F.array_contains(allowed, k) & v.isNotNull())
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)
    out = met.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    return out.select(
        "record_id", "record_type", "url", "captured_at", F.when(resolved, F.col("response.record_id")).alias("response_id"), "status",
        F.when(resolved, merged).otherwise(own).alias("headers"),
    )
