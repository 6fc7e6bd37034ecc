"""The source over growing logs: offsets in bytes, lines that are still being written, parts inside lines."""

import json
import random

import pytest

from tablewarden.streaming.capture import Capture
from tablewarden.streaming.growing import Folder, log_so_far, log_stream


def line(n, **more):
    return json.dumps({"sql": f"SELECT 1 FROM t WHERE t.a = {n}", "name": "Load", "started": 1_700_000_000 + n, "finished": 1_700_000_000 + n + 0.0125, **more}) + "\n"


def add(path, text):
    with open(path, "a", encoding="utf-8", newline="") as file:
        file.write(text)


def test_parts_of_any_size_give_each_line_once(tmp_path):
    rng = random.Random(5)
    rows = ["é" * rng.choice([0, 1, 3, 40, 400]) for _ in range(200)]
    (tmp_path / "a.log").write_bytes("".join(r + "\n" for r in rows).encode() + b"unfinished")
    (tmp_path / "_hidden").write_text("no\n")
    (tmp_path / "empty.log").write_text("")
    starts, at = [], 0
    for r in rows:
        starts.append(at)
        at += len(r.encode()) + 1
    for size in (1, 7, 64, 1000, 10**6):
        folder = Folder({"path": str(tmp_path), "partbytes": str(size)})
        end = folder.now()
        assert end == {"a.log": at, "empty.log": 0}
        found = [(x["at"], x["line"]) for p in folder.parts({}, end) for b in folder.lines(p) for x in b.to_pylist()]
        assert found == list(zip(starts, rows, strict=True)), size
        begin = starts[77]  # any line's start may be an offset
        found = [x["line"] for p in folder.parts({"a.log": begin}, end) for b in folder.lines(p) for x in b.to_pylist()]
        assert found == rows[77:], size


def test_events_of_lines(spark, tmp_path):
    log = tmp_path / "app.log"
    add(log, line(1, binds=[7, "x"], seq=9, sql="a = $1 AND b = $2"))
    add(log, "\nnot json\n[1]\n{}\n" + line(2) + line(3, name="SCHEMA").replace("\n", "\r\n"))
    rows = {r["seq"]: r for r in log_so_far(spark, str(tmp_path), 50).collect()}
    assert set(rows) == {9, 1_700_000_002_000_000, 1_700_000_003_000_000}
    assert rows[9]["explain_sql"] == "a = 7 AND b = 'x'" and rows[1_700_000_002_000_000]["explain_sql"] is None
    assert {str(r["duration_ms"]) for r in rows.values()} == {"12.50"} and rows[9]["ts"].timestamp() == 1_700_000_001
    assert log_so_far(spark, str(tmp_path / "nowhere")).count() == 0


def test_a_session_goes_on_where_it_stopped(spark, tmp_path):
    """Files grow in the middle of a line, new ones come and one goes; no line is taken twice or lost."""
    logs, folder = tmp_path / "logs", str(tmp_path / "session")
    logs.mkdir()
    count = lambda s: {r["source"]: r["count"] for r in s.usages().collect()}
    session = lambda: Capture(log_stream(spark, str(logs), 64), folder)
    assert count(session().run()) == {}
    whole = line(4)
    add(logs / "a.log", line(1) + line(2) + whole[:20])
    add(logs / "b.log", line(3, name="SCHEMA"))
    seen = session().run()
    assert sum(count(seen).values()) == 2 and seen.log().count() == 2
    add(logs / "a.log", whole[20:])
    add(logs / "c.log", line(5) + line(6))
    (logs / "b.log").unlink()
    seen = session().start(processingTime="0 seconds").settle()
    assert sum(count(seen).values()) == 5
    add(logs / "c.log", line(7))
    assert sum(count(seen.settle()).values()) == 6
    seen.stop()
    assert sorted(int(r["sql"].rsplit(" ", 1)[1]) for r in seen.log().collect()) == [1, 2, 4, 5, 6, 7]
    (logs / "c.log").write_text("")
    with pytest.raises(Exception, match="c.log"):
        session().run()
