"""Counts of a log don't sort its statements: what scans it adds it up by hash or passes it on."""

import re

import pytest

import __spark_entry__ as entry

LOG = r"Location: \S+ \[\S*(/log-\w+|/log/epoch=\S+|/events(\.parquet)?)[,\]]"
SORTS = r"\) (Sort|SortAggregate|ObjectHashAggregate|Window)\b"


def plans(spark, run):
    """The plans that Spark ran for `run`, in the query's own session or a stream's, as text."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = store.executionsList()
    last = -1 if before.isEmpty() else before.last().executionId()
    run()
    bus.waitUntilEmpty()
    found = store.executionsList()
    return [e.physicalPlanDescription() for e in (found.apply(i) for i in range(found.size())) if e.executionId() > last]


@pytest.mark.parametrize("name", ["s17_snapshot_round_trip", "st03_stream_usages", "s13_snapshot_usages"])
def test_statements_of_a_log_are_not_sorted(spark, name):
    ran = plans(spark, lambda: entry.queries()[name](spark, "/root/testdata/sf0.001").collect())
    scans = [p for p in ran if re.search(LOG, p)]
    assert any("HashAggregate" in p for p in scans)
    assert not [p for p in scans if re.search(SORTS, p)]
