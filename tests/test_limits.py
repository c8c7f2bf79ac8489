"""Limits and breakers by pieces against plain sequential folds, with one key that holds nearly all events."""

import random

import pytest

from folio.operators.lifecycle import two_tier
from folio.streaming import limits


def fold(rows, window, limit):
    logs, out = {}, {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        ok, logs[key], wait = limits.admit(logs.get(key, []), at, window, limit)
        out[i] = (ok, limit - len(logs[key]), wait)
    return out


def traffic(rng, n, key=lambda k: 7 if k % 10 else k % 30):
    """Bursts, light stretches, pauses, ties and times before 0."""
    rows, at = [], -500
    for k in range(n):
        at += rng.choice([0, 0, 1, 2, 5, 30]) if (k // 60) % 3 else rng.choice([20, 60, 99, 100, 101, 250])
        rows.append((key(k), k, at))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("window", "limit"), [(100, 1), (100, 3), (100, 12), (7, 2), (1, 1), (100, 0)])
def test_log_by_pieces(spark, window, limit):
    rows = traffic(random.Random(window * 31 + limit), 900)
    df = spark.createDataFrame(rows, "k long, i long, at long")
    want = fold(rows, window, limit)
    got = {r["i"]: (r["admitted"], r["remaining"], r["retry_after_us"]) for r in limits.sliding_log(df, "k", "i", "at", window, limit).collect()}
    assert got == want


def test_one_client_is_spread(spark):
    """One client with all events: pieces are many, no piece holds much, and known rows stay under the limit each."""
    rows = traffic(random.Random(5), 3000, key=lambda _: 1)
    df = spark.createDataFrame(rows, "k long, i long, at long").withColumn("__bucket", limits._bucket("at", 100))
    places = limits.log_pieces(df, "k", "at", 100, 12)
    dealt = limits._dealt(df, places, "k", "i", "at")
    sizes = {(r["__piece"], r["__known"]): r["count"] for r in dealt.groupBy("__piece", "__known").count().collect()}
    own = [n for (_, known), n in sizes.items() if not known]
    assert sum(own) == 3000 and len(own) > 100 and max(own) < 400 and max((n for (_, known), n in sizes.items() if known), default=0) <= 12 and any(known for _, known in sizes)


def test_awkward_rows(spark):
    rows = [(None, 1, 5), (None, 2, 6), (3, 3, None), (3, 4, 10), (3, 5, 10)]
    df = spark.createDataFrame(rows, "k long, i long, at long")
    got = {r["i"]: r["admitted"] for r in limits.sliding_log(df, "k", "i", "at", 10, 1).collect()}
    assert got == {1: True, 2: False, 4: True, 5: False}
    assert limits.sliding_log(df.limit(0), "k", "i", "at", 10, 1).count() == 0


def test_two_tiers(spark):
    rng = random.Random(11)
    rows = traffic(rng, 1200, key=lambda k: rng.randrange(8))
    got = {r["i"]: r["verdict"] for r in two_tier(spark.createDataFrame(rows, "k long, i long, at long"), "k", "i", "at", 2, 50, 6, 100).collect()}
    own, everyone, want = {}, [], {}
    for key, i, at in sorted(rows, key=lambda r: (r[2], r[1])):
        ok, own[key], _ = limits.admit(own.get(key, []), at, 50, 2)
        if ok:
            ok, everyone, _ = limits.admit(everyone, at, 100, 6)
            want[i] = "admitted" if ok else "everyone"
        else:
            want[i] = "client"
    assert got == want


@pytest.mark.parametrize(("failures", "wait", "successes", "share"), [(2, 50, 2, 0.3), (5, 60, 2, 0.1), (1, 20, 1, 0.5), (3, 10, 3, 0.05)])
def test_breaker_by_pieces(spark, failures, wait, successes, share):
    rng = random.Random(failures * 100 + wait)
    rows = [(k, i, at, rng.random() < share or (i // 40) % 5 == 0 and rng.random() < 0.8) for k, i, at in traffic(rng, 1500)]
    state, want = {}, {}
    for key, i, now, fail in sorted(rows, key=lambda r: (r[2], r[1])):
        s, bad, good, since = state.get(key, ("closed", 0, 0, 0))
        if s == "open" and now - since >= wait:
            s, good = "half_open", 0
        allowed = s != "open"
        if allowed and fail:
            bad += 1
            if s == "half_open" or bad >= failures:
                s, since, bad = "open", now, 0
        elif allowed:
            bad, good = 0, good + 1
            if s == "half_open" and good >= successes:
                s = "closed"
        state[key] = (s, bad, good, since)
        want[i] = (s, allowed)
    df = spark.createDataFrame(rows, "k long, i long, at long, failed boolean")
    got = {r["i"]: (r["state"], r["allowed"]) for r in limits.breaker(df, "k", "i", "at", "failed", failures, wait, successes).collect()}
    assert got == want
    x = df.where("k = 7").withColumn("__bucket", limits._bucket("at", wait))
    assert limits.breaker_pieces(x, "k", "failed", successes).selectExpr("inline(__places)").distinct().count() > 1
