"""Event logs as a stream: stopped and resumed, with half-written events, repeated appends and malformed records."""

from folio.sources import event_logs
from folio.streaming import sessions


def test_blocks():
    p = event_logs.parse_block
    assert p("id: 5\nevent: step\ndata: {\"a\": 1}") == (5, "step", '{"a": 1}', False)
    assert p('id: 1\ndata: [1,\ndata: 2]') == (1, "message", "[1,\n2]", False) and p("data:{}") == (None, "message", "{}", True)
    assert p(": heartbeat") is None and p(" \n") is None and p("id: 3\nevent: x\ndata: {bad") == (3, "x", "{bad", True) and p("id: 3\nevent: x") == (3, "x", None, True)
    assert p("id: x\nevent: e\ndata: 1") == (None, "e", "1", True)


def test_stop_and_resume(spark, tmp_path):
    logs, out, cp = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "cp")
    logs.mkdir()

    def run():
        sessions.run_available(event_logs.once(event_logs.read_stream(spark, f"file://{logs}")), cp, out)
        return sorted((r["session"], r["id"] if r["id"] is not None else -1, r["event"], r["data"] or "", r["malformed"]) for r in spark.read.schema(event_logs._SCHEMA).parquet(out).collect())

    event = lambda k: f"id: {k}\nevent: step\ndata: {{\"n\": {k}, \"t\": \"é\"}}\n\n"
    (logs / "a%2Fb.log").write_text(event(0) + ": heartbeat\n\n" + event(1) + event(2)[:20])
    (logs / "c.log").write_text("id: 0\nev")
    want = [("a/b", k, "step", f'{{"n": {k}, "t": "é"}}', False) for k in range(2)]
    assert run() == want
    assert run() == want  # nothing new
    with (logs / "a%2Fb.log").open("a") as f:
        f.write("\n\n" + event(0) + event(1) + event(2) + event(3))  # a second task begins again
    (logs / "c.log").write_text("id: 0\nevent: x\ndata: {bad\n\n" + event(1) + "data: {}\n\n" + event(2)[:-1])
    (logs / "empty.log").write_text("")
    (logs / "other.txt").write_text(event(9))
    got = run()
    good = [("a/b", k, "step", f'{{"n": {k}, "t": "é"}}', False) for k in range(4)] + [("c", 1, "step", '{"n": 1, "t": "é"}', False)]
    assert [r for r in got if not r[4]] == good
    assert [(r[0], r[3]) for r in got if r[4]] == [("a/b", ""), ("c", "{}"), ("c", "{bad")]
    with (logs / "c.log").open("a") as f:
        f.write("\n" + event(3))
    assert [r for r in run() if not r[4]] == good + [("c", k, "step", f'{{"n": {k}, "t": "é"}}', False) for k in (2, 3)]


def test_append_twice(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    rows = [(f"s{k % 3}", k // 3, "step", f'{{"k":{k}}}') for k in range(300)]
    df = spark.createDataFrame(rows, "session string, id long, event string, data string")
    assert sorted(tuple(r) for r in event_logs.append(df, path).collect()) == [(f"s{k}", 100) for k in range(3)]
    event_logs.append(df.where("id < 60"), path).count()
    sessions.run_available(event_logs.once(event_logs.read_stream(spark, path)), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert sorted((r["session"], r["id"], r["event"], r["data"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(rows)
    raw = event_logs._Reader(path)
    parts = raw.partitions(raw.initialOffset(), raw.latestOffset())
    assert sum(b.num_rows for p in parts for b in raw.read(p)) == 300 + 180


def test_tails_longer_than_a_look(spark, tmp_path, monkeypatch):
    (tmp_path / "x.log").write_text('id: 0\nevent: a\ndata: "' + "x" * 1000 + '"\n\nid: 1\nevent: b\ndata: "' + "y" * 5000)
    monkeypatch.setattr(event_logs, "_TAIL", 16)
    monkeypatch.setattr(event_logs, "TASK_BYTES", 100)
    r = event_logs._Reader(str(tmp_path))
    end = r.latestOffset()
    got = [x for p in r.partitions(r.initialOffset(), end) for b in r.read(p) for x in b.to_pylist()]
    assert [(x["id"], len(x["data"])) for x in got] == [(0, 1002)]
