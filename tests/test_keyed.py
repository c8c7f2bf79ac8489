"""State by key, many keys to a call: calls follow shards, and keys of one shard are kept apart."""

from pyspark.sql import functions as F

from folio.streaming import keyed, sessions


class _Handle:
    """The state of one shard, and how often it was read or written."""

    def __init__(self):
        self.rows, self.timers, self.trips = [], set(), 0

    def getListState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.trips += 1
        return iter(self.rows)

    def put(self, rows):
        self.trips, self.rows = self.trips + 1, [tuple(r) for r in rows]

    def clear(self):
        self.put([])

    def registerTimer(self, ms):  # noqa: N802
        self.trips += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.trips += 1
        self.timers.remove(ms)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms


def test_round_trips_do_not_follow_keys():
    import pandas as pd

    def step(key, rows, state, now):
        total = (state[0] if state else 0) + sum(n for n, in rows)
        return (total,), 10 + int(key) % 3, [(key, total)]

    p, h = keyed.Keyed("key", ["n"], ["n"], "key string, total long", "total long", step, lambda key, state, now: (None, None, [(key, -state[0])])), _Handle()
    p.init(h)
    frame = pd.DataFrame({"key": [str(k % 300) for k in range(600)], "n": range(600)})
    out = [f for _ in range(2) for f in p.handleInputRows(("x",), iter([frame[:250], frame[250:]]), _Now(0))]
    assert len(out) == 2 and dict(zip(out[1]["key"], out[1]["total"], strict=True)) == {str(k): 2 * (2 * k + 300) for k in range(300)}
    assert h.trips <= 6 and h.timers == {10}
    h.timers.clear()  # what has expired is gone
    (gone,) = p.handleExpiredTimer(("x",), _Now(10), None)
    assert set(gone["key"]) == {str(k) for k in range(0, 300, 3)} and {r[0] for r in h.rows} == {str(k) for k in range(300) if k % 3} and h.timers == {11}


def test_one_shard_equals_many(spark, tmp_path, monkeypatch):
    rows = [(f"g{k % 50}", (k + 1) * 1000, k, "asked" if k < 50 else "decided", k % 2 == 0) for k in range(200)] + [("end", 10**9, 999, "decided", True)]
    schema = "key string, us long, n long, kind string, approved boolean"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    found = []
    for shards in (1, 97):
        def build(s, shards=shards):
            monkeypatch.setattr(keyed.by_key, "__defaults__", (None, shards))
            return sessions.gate_stream(s.withColumn("at", F.timestamp_micros("us")), "at", 60_000)
        found.append(sorted(map(str, sessions.through_stream(spark, str(tmp_path / "in"), build).collect())))
    want = sorted(map(str, sessions.gate_batch(spark.createDataFrame(rows, schema), 60_000).collect()))
    assert found == [want, want]
