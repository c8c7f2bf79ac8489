"""Rounds over pages against a sequential run, and recursive collection against a recursive walk."""

import json
import random

from pyspark.sql import functions as F

from folio.operators.lifecycle import dotted
from folio.operators.rounds import last_level, structure_rounds


def test_rounds_see_what_earlier_pages_gave(spark):
    rng = random.Random(3)
    rows = [(d, p, rng.choice(["user", "assistant", "system"])) for d in range(12) for p in sorted(rng.sample(range(1, 30), rng.randrange(1, 9)))]
    asked = []

    def provider(asks):
        asked.append(asks.count())
        return last_level(asks)

    df = spark.createDataFrame(rows, "conv_id long, page int, role string")
    got = {(r["conv_id"], r["page"]): (r["error"], r["headings"][0]["level"]) for r in structure_rounds(df, provider, "conv_id").collect()}
    want, last = {}, {}
    for d, p, role in rows:
        seen = last.get(d)
        level = 1 if seen is None else seen % 3 + 1 if role == "user" else seen
        failed = (d + p) % 7 == 0
        want[d, p] = ("timeout" if failed else None, level)
        if not failed:
            last[d] = level
    assert got == want
    longest = max(sum(r[0] == d for r in rows) for d in range(12))
    assert len(asked) == longest and sum(asked) == len(rows)
    assert structure_rounds(df.limit(0), last_level, "conv_id").count() == 0


def test_unanswered_pages_add_nothing(spark):
    df = spark.createDataFrame([(1, 1, "user"), (1, 2, "user"), (1, 3, "user")], "conv_id long, page int, role string")
    out = structure_rounds(df, lambda asks: last_level(asks.where("page <> 2")), "conv_id")
    assert sorted((r["page"], r["headings"][0]["level"]) for r in out.collect()) == [(1, 1), (3, 2)]


def walk(x, path=""):
    if isinstance(x, dict | list):
        for k, v in x.items() if isinstance(x, dict) else enumerate(x):
            yield from walk(v, f"{path}.{k}" if path else str(k))
    elif x is not None and path:
        yield path, x


def test_dotted_paths_at_any_depth(spark):
    rng = random.Random(9)

    def grow(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.2:
            return rng.choice(["text", 7, None, "é", ""])
        return [grow(depth - 1) for _ in range(rng.randrange(3))] if kind < 0.5 else {f"k{i}": grow(depth - 1) for i in range(rng.randrange(4))}

    deep = "end"
    for k in range(50):
        deep = {"d": deep} if k % 2 else [deep]
    some = [grow(9) for _ in range(30)] + [deep, {}, [], {"a": {"reasoning": "x"}}]
    df = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(some)] + [(99, None)], "k long, j string").select("k", F.try_parse_json("j").alias("r"))
    got = sorted((r["k"], r["path"], r["value"]) for r in dotted(df, "k", "r").collect())
    assert got == sorted((k, p, str(v)) for k, x in enumerate(some) for p, v in walk(x))
