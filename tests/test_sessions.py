"""Streams with state and timers: stopped and restarted in the middle, each equals its batch form over the whole table."""

import random

import pytest
from pyspark.sql import functions as F

from folio.streaming import sessions


def key(r):
    return tuple((x is not None, x) for x in r)


def through(spark, tmp_path, rows, schema, build, parts=3):
    """Rows arrive in parts, in the order of their times; after each part the query ends, and goes on from its checkpoint."""
    rows = sorted(rows, key=lambda r: (r[1], r[2]))
    step = -(-len(rows) // parts)
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(src)
        sessions.run_available(build(spark.readStream.schema(schema).parquet(src).select("*", F.timestamp_micros("us").alias("at"))), cp, out)
    return sorted((tuple(r) for r in spark.read.parquet(out).collect()), key=key)


GATE = "key string, us long, n long, kind string, approved boolean"


def test_gate(spark, tmp_path):
    rng = random.Random(4)
    rows, n = [], 0
    for k in range(40):
        asked = rng.randrange(10_000_000)
        rows.append((f"g{k}", asked, n, "asked", None))
        for _ in range(rng.randrange(4)):
            n += 1
            rows.append((f"g{k}", asked + rng.randrange(-200_000, 1_500_000), n, "decided", rng.random() < 0.5))
        n += 1
    rows += [("g0", 900, n + 1, "asked", None), ("gone", 5_000, n + 2, "decided", True), ("edge", 1_000, n + 3, "asked", None), ("edge", 601_000, n + 4, "decided", True), ("edge2", 1_000, n + 5, "asked", None), ("edge2", 601_001, n + 6, "decided", True)]
    end = ("end", 100_000_000, n + 9, "decided", True)
    want = sorted((tuple(r) for r in sessions.gate_batch(spark.createDataFrame([*rows, end], GATE), 600_000).collect()), key=key)
    got = through(spark, tmp_path, [*rows, end], GATE, lambda s: sessions.gate_stream(s, "at", 600_000))
    assert got == want and {r[2] for r in want} == {"approved", "denied", "accepted", "too_late", "already_decided", "unknown"}
    assert ("edge", None, "approved", 601_000) in want and ("edge2", None, "denied", 601_000) in want


DUE = "key string, us long, n long, kind string, due_us long"


def test_deadlines(spark, tmp_path):
    rng = random.Random(8)
    rows = []
    for n in range(300):
        us = rng.randrange(10_000_000)
        rows.append((f"j{rng.randrange(30)}", us, n, "add", us + rng.randrange(900_000)) if rng.random() < 0.7 else (f"j{rng.randrange(30)}", us, n, "remove", None))
    end = ("end", 100_000_000, 999, "remove", None)
    want = sorted((tuple(r) for r in sessions.deadlines_batch(spark.createDataFrame([*rows, end], DUE), 50_000_000).collect()), key=key)
    last, plain = {}, []
    for k, us, n, kind, due in sorted(rows, key=lambda r: (r[1], r[2])):
        if k in last and last[k][1] < us:
            plain.append((k, *last[k]))
        last.pop(k, None)
        if kind == "add":
            last[k] = (n, due)
    assert want == sorted(plain + [(k, *x) for k, x in last.items()], key=key)
    assert through(spark, tmp_path, [*rows, end], DUE, lambda s: sessions.deadlines_stream(s, "at")) == want


LOG = "key string, us long, n long, kind string, type string, data string, reader string, last_id long"


def test_session_log(spark, tmp_path):
    rng = random.Random(12)
    rows, us = [], 0
    for n in range(600):
        us += rng.choice([1_000, 20_000, 400_000])
        k = f"s{rng.randrange(5)}"
        rows.append((k, us, n, "publish", rng.choice(["step", "done"]), f"d{n}", None, None) if rng.random() < 0.8 else (k, us, n, "read", None, None, rng.choice("abc"), rng.randrange(-1, 12)))
    want = sorted((tuple(r) for r in sessions.session_log_batch(spark.createDataFrame(rows, LOG), 1_000_000).collect()), key=key)
    log, readers, touched, number, plain = {}, {}, {}, {}, []
    for k, us, _, kind, t, d, reader, last in rows:
        if k not in touched or us - touched[k] > 1_000_000:
            number[k], log[k], readers[k] = number.get(k, 0) + 1, [("session", k)], {}
        touched[k] = us
        if kind == "publish":
            log[k].append((t, d))
            plain += [(k, number[k], r, len(log[k]) - 1, t, d) for r, seen in readers[k].items() if len(log[k]) - 1 > seen]
        else:
            plain += [(k, number[k], reader, i, *e) for i, e in enumerate(log[k]) if i > last]
            readers[k][reader] = max(last, len(log[k]) - 1)
    assert sorted(plain, key=key) == want
    assert through(spark, tmp_path, rows, LOG, lambda s: sessions.session_log_stream(s, "at", 1_000_000)) == want


def test_settings_return(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(Exception):  # noqa: B017
        sessions.run_available(spark.readStream.format("rate").load(), "", str(tmp_path / "x"))
    assert spark.conf.get(name) == before
