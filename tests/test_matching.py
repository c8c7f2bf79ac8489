"""Best matches through the index against every pair, and their bounds against the matcher itself."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import matching

WORDS = "the results of section page figure introduction method data and analysis summary for table appendix with overview note on".split()


def like(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def edited(rng, t):
    t = list(t)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(t) + 1)
        t[k : k + rng.randrange(2)] = rng.choice(["", "x", "é", " "])
    return "".join(t)


def lines(rng, n):
    some = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 9))) for _ in range(n)]
    return [rng.choice([t, edited(rng, t), edited(rng, t), t[:3], "", "aaaa" * rng.randrange(1, 90), t * rng.randrange(1, 6)]) for t in some]


@pytest.mark.parametrize("least", [0.5, 0.6, 0.8, 0.95])
def test_best_matches(spark, least):
    rng = random.Random(int(100 * least))
    left, right = [], []
    for d in range(6):
        texts = lines(rng, 40)
        left += [(d, h, t) for h, t in enumerate(texts)]
        right += [(d, o, edited(rng, rng.choice(texts)) if rng.random() < 0.8 else t) for o, t in enumerate(lines(rng, 40))]
    left += [(0, 900, None), (None, 901, "x")]
    want = {}
    for d, h, t in left:
        best = max(((like(t, u), -o) for e, o, u in right if t and u and e == d), default=(0, 0))
        if best[0] >= least and d is not None:
            want[d, h] = (-best[1], round(best[0], 9))
    a, b = spark.createDataFrame(left, "d long, h long, text string"), spark.createDataFrame(right, "d long, o long, title string")
    got = {(r["d"], r["h"]): (r["o"], round(r["ratio"], 9)) for r in matching.best_matches(a, b, ["d"], least).collect()}
    assert got == want


def test_bounds(spark):
    rng = random.Random(3)
    some = lines(rng, 120)
    pairs = [(k, a, b) for k, (a, b) in enumerate((x, y) for x in some for y in rng.sample(some, 8))]
    df = spark.createDataFrame(pairs, "k long, a string, b string")
    n, m = F.length("a"), F.length("b")
    got = df.select("a", "b", matching.bound(n, m, matching.class_counts(F.col("a")), matching.class_counts(F.col("b"))).alias("x")).collect()
    assert all(r["x"] >= like(r["a"], r["b"]) - 1e-9 for r in got if r["a"] or r["b"])
    from collections import Counter

    for _, a, b in pairs:
        for q in (2, 3, 4):
            t, shared = len(a) + len(b), sum((Counter(a[i : i + q] for i in range(len(a) - q + 1)) & Counter(b[i : i + q] for i in range(len(b) - q + 1))).values())
            assert shared >= like(a, b) * t / 2 - (q - 1) * (t - like(a, b) * t + 1) - 1e-6


def test_large_page_without_the_product(spark):
    """Ten thousand lines by ten thousand entries: what is compared stays near the number of lines."""
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz      "
    texts = ["".join(rng.choice(alphabet) for _ in range(48)) for _ in range(10_000)]
    near = [t if k % 2 else t[:20] + "#" + t[21:] for k, t in enumerate(texts)]
    a = matching.prepared(spark.createDataFrame([(1, k, t) for k, t in enumerate(near)], "d long, h long, text string"), ["d"], "h", "text")
    b = matching.prepared(spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "d long, o long, title string"), ["d"], "o", "title")
    rest = a.join(b.select("d", "s"), ["d", "s"], "left_anti")
    assert rest.count() == 5000
    assert matching.candidates(rest, b, ["d"], 0.9).count() < 1_000_000
    got = matching.best_matches(a.withColumnRenamed("s", "text"), b.withColumnRenamed("s", "title"), ["d"], 0.8)
    assert got.where("h = o").count() == 10_000 == got.count()


def test_words_one_edit_apart(spark):
    """Every pair at one insertion, deletion, replacement or swap of neighbours, and no other, of any length."""
    from folio.operators.cleanup import near_keys, one_edit

    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(7))) for _ in range(150)} - {""})

    def apart(a, b):
        near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in "abc"} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in "abc"}
        return b in near | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)} - {a}

    keys = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.explode(near_keys("w")).alias("k"))
    got = {(r["w"], r["near"]) for r in keys.join(keys.withColumnRenamed("w", "near"), "k").where("w < near").distinct().where(one_edit("w", "near")).collect()}
    assert got == {(a, b) for a in words for b in words if a < b and apart(a, b)}


def test_pairs_of_a_large_key_in_cells(spark):
    """Every pair of a key is met once, and none of the cells holds much more than its share."""
    a = spark.range(300).selectExpr("id % 2 * 0 AS d", "id AS h", "'x' AS s", "1 AS n", "array(1) AS c").unionByName(spark.sql("SELECT 1L AS d, 7L AS h, 'y' AS s, 1 AS n, array(1) AS c"))
    b = spark.range(3000).selectExpr("id * 0 AS d", "id AS o", "'x' AS s", "1 AS n", "array(1) AS c").unionByName(spark.sql("SELECT 1L AS d, 7L AS o, 'y' AS s, 1 AS n, array(1) AS c"))
    got = matching._in_cells(a, b, ["d"])
    assert got.count() == got.select("d", "h", "o").distinct().count() == 900_001
    cells = [r["count"] for r in got.groupBy("d", "cx", "cy").count().collect()]
    assert len(cells) == 16 and max(cells) < 2 * matching.CELL[0] * matching.CELL[1]


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(8)
    for x in lines(rng, 60):
        for y in rng.sample(lines(rng, 40), 5):
            masks = {}
            for i, c in enumerate(x):
                masks[c] = masks.get(c, 0) | 1 << i
            got, row = matching._common(masks, len(x), y), [0] * (len(y) + 1)
            for c in x:
                row = [0, *(old := row)[1:]]
                for j, d in enumerate(y):
                    row[j + 1] = old[j] + 1 if c == d else max(row[j], old[j + 1])
            assert got == row[-1] and 2 * got >= like(x, y) * (len(x) + len(y)) - 1e-6
