"""Capture records of web pages, for tables that hold one fetched copy of each url.

Each page becomes a full response and, a day later, two revisits that spell its
url differently: one with the response's entity tag and one that the server
answered by time of modification.  Every seventh page has changed in between, so
its tag disagrees, and every eleventh response is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = 86_400
#: Fixed value: the first capture's time, in seconds since 1970.
START = 1_700_000_000


def page_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(record_id, record_type, url, captured_at, headers), two or three rows for each page."""
    page = F.col(id_col)
    url = F.col(url_col)
    tag = F.concat(F.lit('"v'), F.pmod(page, F.lit(1000)).cast("string"), F.lit('"'))
    changed = F.concat(F.lit('W/"w'), page.cast("string"), F.lit('"'))
    respelt = F.concat(F.regexp_replace(url, "^http://", "https://"), F.when(F.contains(url, F.lit("#")), F.lit("x")).otherwise(F.lit("#again")))
    when = lambda second: F.lit(START) + page * 60 + second
    text = lambda value: value.cast("string")
    rows = F.array(
        F.when(F.pmod(page, F.lit(11)) != 0, F.struct((page * 3).alias("record_id"), F.lit("response").alias("record_type"), url.alias("url"), when(0).alias("captured_at"),
            F.create_map(F.lit("ETag"), tag, F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), text(when(0)), F.lit("Last-Modified"), text(page)).alias("headers"))),
        F.struct((page * 3 + 1).alias("record_id"), F.lit("revisit").alias("record_type"), respelt.alias("url"), when(DAY).alias("captured_at"),
            F.create_map(F.lit("etag"), F.when(F.pmod(page, F.lit(7)) == 0, changed).otherwise(F.concat(F.lit("W/"), tag)), F.lit("date"), text(when(DAY)), F.lit("content-length"), F.lit("0")).alias("headers")),
        F.struct((page * 3 + 2).alias("record_id"), F.lit("revisit").alias("record_type"), url.alias("url"), when(2 * DAY).alias("captured_at"),
            F.create_map(F.lit("Last-Modified"), text(page), F.lit("Expires"), text(when(3 * DAY)), F.lit("server"), F.lit("a")).alias("headers")),
    )
    return pages.select(F.explode(rows).alias("r")).filter("r is not null").select("r.*")
