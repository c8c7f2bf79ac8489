"""Row numbers of groups that are cut and of groups that aren't."""

import random

import pytest

from folio.functions.ranks import numbered


@pytest.mark.parametrize("large", [1, 40, 10**6])
def test_numbers_within_groups(spark, large):
    rng = random.Random(large)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), float(rng.randrange(25)) if rng.random() < 0.95 else None, k) for k in range(600)] + [("one", 1.0, 900)]
    df = spark.createDataFrame(rows, "g string, v double, k long")
    got = sorted((r["k"], r["place"], r["total"]) for r in numbered(df, "g", ["v", "k"], large=large).collect())
    want = []
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0.0, r[2]))
        want += [(r[2], i, len(own)) for i, r in enumerate(own, 1)]
    assert got == sorted(want)
    assert numbered(df.limit(0), "g", ["v", "k"]).count() == 0
