"""Rates, instants and quantiles against a plain evaluator, on series with resets, gaps, ties and times before 0."""

import math
import random

import pytest

from folio.operators import rates

S = 1_000_000


def series(rng, n):
    at, v, out = -200 * S, 0.0, []
    for k in range(n):
        at += rng.choice([1, 5, 15, 15, 15, 16, 400]) * S
        v = float(rng.randrange(3)) if rng.random() < 0.08 else v + rng.choice([0, 1, 2.5, 10])
        out.append((at, k, v))
    return out


def plain_rate(samples, t, width):
    inside = [x for x in samples if t - width < x[0] <= t]
    if len(inside) < 2 or inside[-1][0] == inside[0][0]:
        return None
    increase = sum(b[2] if b[2] < a[2] else b[2] - a[2] for a, b in zip(inside, inside[1:], strict=False))
    span = (inside[-1][0] - inside[0][0]) / S
    front, back, mean = (inside[0][0] - (t - width)) / S, (t - inside[-1][0]) / S, span / (len(inside) - 1)
    if increase > 0 and inside[0][2] >= 0:
        front = min(front, span * inside[0][2] / increase)
    total = span + (front if front < 1.1 * mean else mean / 2) + (back if back < 1.1 * mean else mean / 2)
    return increase * total / span / (width / S)


@pytest.mark.parametrize(("width", "step"), [(60, 15), (300, 60), (30, 100)])
def test_rate_and_instant(spark, width, step):
    rng = random.Random(width)
    data = {k: series(rng, 300) for k in ("a", "b", None)}
    df = spark.createDataFrame([(k, *x) for k, s in data.items() for x in s], "job string, us long, n long, value double")
    grid = range(-240 * S, max(x[0] for s in data.values() for x in s) + 400 * S, step * S)
    grid = [t - t % (step * S) for t in grid]
    want = {(k, t): r for k, s in data.items() for t in grid if (r := plain_rate(s, t, width * S)) is not None}
    got = {(r["job"], r["at_us"]): r["rate"] for r in rates.rate(df, ["job"], width * S, step * S).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)
    last = {(k, t): [x for x in s if t - width * S < x[0] <= t] for k, s in data.items() for t in grid}
    now = {(r["job"], r["at_us"]): r["value"] for r in rates.instant(df, ["job"], step * S, width * S).collect()}
    assert now == {k: v[-1][2] for k, v in last.items() if v}


def test_steps_across_buckets(spark):
    rng = random.Random(1)
    s = series(rng, 500)
    df = spark.createDataFrame([("x", *x) for x in s], "job string, us long, n long, value double")
    want = [0.0] + [b[2] if b[2] < a[2] else b[2] - a[2] for a, b in zip(s, s[1:], strict=False)]
    for width in (7 * S, 1000 * S, 10**12):
        assert [r["step"] for r in rates.counter_steps(df, ["job"], width).orderBy("n").collect()] == want


def test_quantile(spark):
    rows = [("a", 1, 1.0, 2.0), ("a", 1, 5.0, 6.0), ("a", 1, None, 8.0), ("b", 1, 1.0, 1.0), ("b", 1, None, 1.0), ("c", 1, 1.0, 5.0), ("d", 1, 1.0, 0.0), ("d", 1, None, 0.0), ("e", 1, -2.0, 3.0), ("e", 1, None, 3.0), ("f", 1, 1.0, 3.0), ("f", 1, 2.0, 2.9), ("f", 1, None, 3.0)]
    df = spark.createDataFrame(rows, "job string, at_us long, le double, rate double")
    half = {r["job"]: r["value"] for r in rates.quantile(df, ["job"], 0.5).collect()}
    assert half == {"a": 1 + 4 * (4 - 2) / 4, "b": 0.5, "e": -2.0, "f": 0.5}
    assert {r["job"]: r["value"] for r in rates.quantile(df, ["job"], 0.95).collect()}["a"] == 5.0


def test_share_and_drain(spark):
    r = spark.createDataFrame([("ok", 1, 3.0), ("bad", 1, 1.0), ("ok", 2, 0.0)], "s string, at_us long, rate double")
    assert {x["at_us"]: x["share"] for x in rates.share(r, r["s"] == "ok").collect()} == {1: 75.0, 2: None}
    d = spark.createDataFrame([("q", 1, 8.0), ("p", 1, 2.0)], "s string, at_us long, value double")
    assert [(x["at_us"], x["depth"], round(x["seconds"], 6)) for x in rates.drain(d, r).collect()] == [(1, 10.0, round(10 / 4.001, 6))]


def test_windows_copy_panes_not_samples(spark):
    """A sample that lies in many windows is sorted once: of 3000 samples in 12 windows each, what windows copy is panes."""
    df = spark.range(3000).selectExpr("'a' AS job", f"(id + 1) * {S} AS us", "id AS n", "CAST(id AS DOUBLE) AS value").repartition(1)
    got = rates.rate(df, ["job"], 1200 * S, 100 * S).orderBy("at_us")
    rows = got.collect()
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("min(struct(")
    assert len(rows) == 41 and all(abs(r["rate"] - 1.0) < 0.01 for r in rows[11:30])
