"""Committed epochs, reading while a session runs, and counts in the state store."""

import pytest
from pyspark.sql import functions as F

from tablewarden import workspace
from tablewarden.operators.usages import as_relation, runtime_usages
from tablewarden.streaming import capture, running
from tablewarden.streaming.capture import EVENTS, Capture, event_stream
from tablewarden.streaming.manifest import Manifest
from tablewarden.streaming.running import Running


def batch(spark, *numbers):
    return spark.createDataFrame([(n, f"SELECT 1 FROM t WHERE t.a = {n} AND t.c{n % 3} = 1 ORDER BY t.b", "SCHEMA" if n % 5 == 4 else None, None, f"X{n}" if n % 2 else None, None) for n in numbers], EVENTS).withColumn("duration_ms", F.col("seq").cast("decimal(18,2)"))


def rows(usages):
    return sorted((r["column_name"], r["operation"], tuple(r["where_columns"]), r["count"], r["total_duration_ms"], r["source"], r["explain_source"], r["seq"]) for r in usages.collect())


def test_readers_see_whole_epochs_only(spark, tmp_path):
    """A batch that fails half-way, folders of unfinished writes, and a session read while it runs."""
    events, folder = str(tmp_path / "events"), str(tmp_path / "session")
    first, second = batch(spark, *range(6)), batch(spark, *range(6, 9))
    first.write.parquet(events)
    session = Capture(event_stream(spark, events), folder)
    session.start(processingTime="0 seconds")
    session._query.processAllAvailable()
    assert rows(as_relation(session.usages())) == rows(runtime_usages(first)) and session.log().count() == 5
    (tmp_path / "session/counts/epoch=9-x/_temporary").mkdir(parents=True)
    (tmp_path / "session/log/epoch=9-x/_temporary").mkdir(parents=True)
    assert rows(as_relation(session.usages())) == rows(runtime_usages(first))
    session.stop()
    second.write.mode("append").parquet(events)

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    good, capture.aggregated = capture.aggregated, fail
    try:
        with pytest.raises(Exception):  # noqa: B017
            session.run()
    finally:
        capture.aggregated = good
    session.stop()
    assert rows(as_relation(session.usages())) == rows(runtime_usages(first)) and session.log().count() == 5
    session.run()
    assert rows(as_relation(session.usages())) == rows(runtime_usages(first.union(second))) and session.log().count() == 8


def test_counts_come_back_from_the_state_store(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "MERGE", 3)
    events, folder = str(tmp_path / "events"), str(tmp_path / "session")
    whole = None
    for i in range(7):
        part = batch(spark, 2 * i, 2 * i + 1)
        part.write.mode("append").parquet(events)
        whole = part if whole is None else whole.union(part)
        session = Running(event_stream(spark, events), folder)  # a new one each time: only the folder carries on
        assert i or session.usages().count() == 0
        session.run()
    assert rows(as_relation(session.usages())) == rows(runtime_usages(whole))
    assert len(workspace.folders(spark, f"{folder}/counts")) <= 6
    session.start(processingTime="0 seconds")
    more = batch(spark, 50, 51, 52)
    more.write.mode("append").parquet(events)
    session.settle()
    assert rows(as_relation(session.usages())) == rows(runtime_usages(whole.union(more)))
    session.stop()
    session.stop()


def test_a_manifest_goes_forward_only(spark, tmp_path):
    folder = str(tmp_path / "m")
    assert Manifest.read(spark, folder).epoch == -1
    for epoch in range(5):
        Manifest.read(spark, folder).commit(epoch, {"counts": [f"t{epoch}"]}, [])
    now = Manifest.read(spark, folder)
    assert now.commit(3, {"counts": []}, []) is now and Manifest.read(spark, folder).tables == {"counts": ["t4"]}
    assert len(workspace.folders(spark, folder)) == 3
