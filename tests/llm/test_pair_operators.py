"""op3, op7, op8, op9 and the pipeline against brute force on small tables with every awkward case."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import chaining, jaccard, suffix, topk
from tests.llm.helpers import awkward, frame, sentence

LAST = 1 << 62


@pytest.fixture(scope="module")
def rows():
    return awkward(random.Random(1))


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def removed(rows):
    """(id, text bytes, mask) by the definition."""
    first = {}
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for p in range(len(b) - 49):
            k = b[p : p + 50]
            first[k] = min(i, first.get(k, LAST))
    out = []
    for i, b in texts:
        m = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                m[p : p + 50] = True
        out.append((i, b, m))
    return out


def expected(rows):
    out = []
    for i, b, m in removed(rows):
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        runs = int((np.diff(np.concatenate([[0], m.astype(int), [0]])) == 1).sum())
        out.append((i, len(b), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def scanned(df):
    return sorted((LAST if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.scan(df).collect())


def test_suffix(spark, rows, docs):
    assert scanned(docs) == expected(rows)
    assert suffix.scan(docs.limit(0)).count() == 0
    cut = suffix.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    want = sorted((i, np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")) for i, b, m in removed(rows))
    assert sorted((LAST if r["doc_id"] is None else r["doc_id"], r["text"]) for r in cut.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) and r["key"] == "k" for r in cut.collect())


def test_suffix_on_repetitive_bytes(spark):
    rng = random.Random(7)
    rows = [(k, "".join(rng.choice("ab") * rng.randrange(1, 40) for _ in range(rng.randrange(1, 30)))) for k in range(25)]
    rows += [(30, "a" * 400), (31, "a" * 401), (32, "ab" * 200), (29, "ba" * 150), (33, "é" * 100), (34, "x" + "é" * 80)]
    assert scanned(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=0, max_size=12), min_size=1, max_size=40))
def test_multikey_order(rows):
    keys = np.zeros((len(rows), 12), np.uint64)
    for k, r in enumerate(rows):
        keys[k, : len(r)] = r
    order, group = suffix.multikey_order(keys)
    got = [tuple(keys[k]) for k in order]
    assert got == sorted(map(tuple, keys)) and len(set(got)) == group[-1] + 1
    assert all((got[k] == got[k + 1]) == (group[k] == group[k + 1]) for k in range(len(got) - 1))


def shingle_sets(rows, k=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append((i, {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()))
    return out


def linked(rows):
    sets = shingle_sets(rows)
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                comp[find(a)] = find(b)
    groups = {}
    for a in range(len(sets)):
        groups.setdefault(find(a), []).append(a)
    out = []
    for g in groups.values():
        ids = [sets[a][0] for a in g if sets[a][0] is not None]
        out += [(str(sets[a][0]), len(sets[a][1]), str(min(ids) if ids else None)) for a in g]
    return sorted(out)


def joined(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard.similar_components(df).collect())


def test_jaccard(spark, rows, docs):
    assert joined(docs) == linked(rows)
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def test_jaccard_near_the_threshold(spark):
    rng = random.Random(11)
    rows = []
    for base in range(30):
        w = sentence(rng, rng.randrange(4, 60)).split()
        for _ in range(5):
            v = list(w)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(v))
                v[at : at + 1] = rng.choice([[], ["new"], [v[at], "extra"]])
                v = v or ["x"]
            rows.append((len(rows) * 7 % 1009 + base * 2000, " ".join(v)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == linked(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 120), st.integers(0, 60), st.integers(0, 60), st.integers(0, 10**6))
def test_similar_sets_share_what_they_need(common, left, right, seed):
    if 100 * common < 75 * (common + left + right):
        return
    rng = np.random.default_rng(seed)
    t = np.unique(rng.integers(0, 2**64, common + left + right, dtype=np.uint64))
    rng.shuffle(t)
    a, b = np.sort(t[: common + left]), np.sort(np.concatenate([t[:common], t[common + left :]]))
    bands = jaccard.Bands(75, 100)
    x, y = ({scheme: v for scheme, v in zip(bands.schemes(len(s)), jaccard.signatures(s, bands), strict=True)} for s in (a, b))
    scheme = bands.schemes(min(len(a), len(b)))[0]
    (p, least_a), (q, least_b) = x[scheme], y[scheme]
    assert len(np.intersect1d(p, q)) >= max(least_a, least_b) >= 1


def test_signatures_cost_the_same_in_many_buckets():
    import pyarrow as pa

    rng = random.Random(31)
    texts = [sentence(rng, 300) for _ in range(60)] + [""]
    raw = jaccard._pack_block(list(range(61)), pa.array(texts, pa.large_string()))
    left, right = pa.table({"block": pa.array([5]), "payload": pa.array([raw], pa.binary())}), pa.table({"block": pa.array([5] * 60), "pos": pa.array(range(60))})

    def dealt(buckets):
        got = jaccard._signed(left, right, 5, 75, 100, list(range(buckets)))
        return sum(len(x) - 16 for x in got.column("payload").to_pylist()), sorted(v for x in got.column("payload").to_pylist() for v in zip(*map(np.ndarray.tolist, jaccard._dealt(x, 0)[1:]), strict=True))

    (few, one), (many, other) = dealt(4), dealt(1000)
    assert few == many and one == other and {of >> 1 for _, of in one} == set(range(60))


def test_keep_one(docs, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    least = {c for i, _, c in linked(rows)}
    assert {str(r["doc_id"]) for r in kept.collect()} - {"None"} == least - {"None"}


def brute_top(vectors, k=5):
    ok = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({(i, tuple(v)) for i, v in ok if i % 50 == 0}):
        cand = sorted((-sum(a * b for a, b in zip(q[1], v, strict=True)), i) for i, v in ok if i != q[0] and len(v) == len(q[1]))
        out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(cand[:k])]
    return sorted(out)


def test_topk_leaves_out_what_no_long_can_score(spark):
    rows = [(0, [1e300, 1.0]), (50, [3.0, 4.0]), (1, [1.0, 1.0]), (2, [1e12, 0.0]), (3, [-1e300, -1e300]), (4, [1e6, 1.0]), (5, [1.7e308, 1.7e308]), (6, [float("inf"), 0.0]), (7, None), (8, [float("nan"), 1.0]), (100, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(50, 1, 4, 256 * 256 * (3_000_000 + 4)), (50, 2, 1, 256 * 256 * 7)]
    assert sorted(r["vec_id"] for r in topk.too_long(df).collect()) == [0, 2, 3, 5, 100]


def test_topk(spark):
    rng = random.Random(9)
    v = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(400)]
    v += [(1000 + i, [0.5] * 8) for i in range(120)] + [(2000, None), (2050, []), (2100, [None] * 8), (2150, [float("nan")] * 8), (2200, [float("inf")] * 8), (2250, [0.1, 0.2]), (2251, [0.1, 0.3]), (None, [0.1] * 8), (7, [0.9] * 8), (7, [0.9] * 8)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in v], "vec_id long, embedding array<float>, label int, tree int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, tree_rows=150, query_rows=5).collect())
    assert got == brute_top(v)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(df.where("vec_id IN (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        c = [i + 1]
        for j, y in enumerate(b):
            c.append(min(c[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
        p = c
    assert chaining.edit_distance(a, b) == p[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(-5, 50)), max_size=60), st.integers(0, 20))
def test_fenwick(puts, ask):
    t = chaining.Fenwick(21)
    for who, (i, v) in enumerate(puts):
        t.put(i, float(v), who)
    assert t.get(ask)[0] == max([float(v) for i, v in puts if i <= ask], default=-np.inf)


def test_chain_is_the_best_by_brute_force():
    rng = random.Random(13)
    for _ in range(60):
        seg = []
        for _ in range(rng.randrange(2, 7)):
            q, r, n = rng.randrange(60), rng.randrange(60), rng.randrange(6, 12)
            seg.append((q, q + n, r, r + n))
        best = 0.0
        for mask in range(1, 1 << len(seg)):
            part = sorted(s for k, s in enumerate(seg) if mask >> k & 1)
            if all(b[0] >= a[1] - chaining.K + 1 and b[2] >= a[3] - chaining.K + 1 for a, b in zip(part, part[1:], strict=False)):
                gain = sum(s[1] - s[0] for s in part) - chaining.GAP * sum(b[0] - a[1] + b[2] - a[3] for a, b in zip(part, part[1:], strict=False))
                best = max(best, gain)
        assert chaining.chains(np.array(sorted(set(seg))))[0][4] == pytest.approx(best)


def test_passages(spark, docs):
    rng = random.Random(17)
    passage = sentence(rng, 70).split()
    fuzzy = list(passage)
    for at in (12, 30, 31, 55):
        fuzzy[at] = "edited"
    rows = [(k, sentence(rng, 100)) for k in range(40)]
    for k, p in ((3, passage), (9, passage), (20, fuzzy), (33, passage)):
        rows[k] = (k, f"{sentence(rng, 37)} {' '.join(p)} {sentence(rng, 41)}")
    got = chaining.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["source_id"]) for r in got) == [(9, 3), (20, 3), (33, 3)]
    for r in got:
        assert r["start_word"] == 37 and r["end_word"] == 107 and r["source_start"] == 37 and r["edits"] == (4 if r["doc_id"] == 20 else 0)
    found = {(r["doc_id"], r["source_id"]) for r in chaining.find_passages(docs).collect()}
    assert {(2, 1), (8, 1), (9, 1)} <= found and {(15, 1), (15, 3)} <= found and (None, 3) in found
    assert not {r for r in found if r[0] in (4, 5, 6, 7, 14)}
    assert chaining.find_passages(docs.limit(0)).count() == 0


def test_passages_made_of_parts_that_smaller_documents_hold(spark):
    rng = random.Random(23)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, long = word(60), word(90)
    rows = {1: word(20) + p[:30] + word(20), 2: word(15) + p[30:] + word(20), 3: word(9) + p + word(30), 4: word(33) + p + word(11)}
    for k in range(5, 15):  # every part of 30 words is in nine smaller documents, the whole in one
        rows[k] = word(10) + long[(k % 3) * 30 : (k % 3) * 30 + 30] + word(10)
    rows[15], rows[16] = word(5) + long + word(6), word(7) + long + word(5)
    got = chaining.find_passages(spark.createDataFrame([(k, " ".join(x)) for k, x in rows.items()], "doc_id long, text string")).collect()
    assert {(4, 3, 33, 93, 9, 69, 0), (16, 15, 7, 97, 5, 95, 0)} <= {tuple(r) for r in got}
    verify_passages(rows, got)


def verify_passages(rows, got):
    for r in got:
        a, b = rows[r["doc_id"]][r["start_word"] : r["end_word"]], rows[r["source_id"]][r["source_start"] : r["source_end"]]
        p = list(range(len(b) + 1))
        for i, x in enumerate(a):
            c = [i + 1]
            for j, y in enumerate(b):
                c.append(min(c[-1] + 1, p[j + 1] + 1, p[j] + (x != y)))
            p = c
        assert r["source_id"] < r["doc_id"] and p[-1] == r["edits"] <= 0.25 * max(len(a), len(b)) and min(len(a), len(b)) >= 40


def test_passages_at_every_identity_of_the_bound(spark):
    rng = random.Random(29)
    word = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def edited(p, at, kind):
        out = []
        for i, w in enumerate(p):
            if i not in at:
                out.append(w)
            elif kind == "change":
                out += word(1)
            elif kind == "insert":
                out += [*word(1), w]
        return out

    cases = [(44, {5, 40}, "change")]
    cases += [(60, set(range(every - 1, 60, every)), "change") for every in (4, 5, 6, 7, 8)]
    cases += [(n, set(rng.sample(range(n), n // 4)), "change") for n in (40, 41, 44, 48, 60, 90) for _ in range(8)]
    cases += [(n, set(rng.sample(range(1, n), n // 6)), kind) for n in (54, 60, 90) for kind in ("insert", "drop") for _ in range(4)]
    rows = {}
    for k, (n, at, kind) in enumerate(cases):
        p = word(n)
        rows[2 * k] = word(rng.randrange(50)) + p + word(rng.randrange(50))
        rows[2 * k + 1] = word(rng.randrange(50)) + edited(p, at, kind) + word(rng.randrange(50))
    got = chaining.find_passages(spark.createDataFrame([(k, " ".join(x)) for k, x in rows.items()], "doc_id long, text string")).collect()
    verify_passages(rows, got)
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(2 * k + 1, 2 * k) for k in range(len(cases))}


def test_pipeline(spark, docs, rows):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["language ID", "n-gram Jaccard join", "suffix dedup", "secret scans", "packing"]
    x = docs.select("doc_id", "text", "lang", "source", "n_chars")
    kept = C.STAGES[0][1](spark, x, "")
    gone = {r["doc_id"] for r in x.join(kept, "doc_id", "left_anti").collect()}
    assert gone >= {4, 5, 6} and not gone & {1, 2, 3, 9, 14}
    one = C.STAGES[1][1](spark, kept, "")
    assert {r["doc_id"] for r in one.collect()}.isdisjoint({2, 8, 9})
    cut = C.STAGES[2][1](spark, one, "")
    rows_ = [(r["doc_id"], r["text"]) for r in one.collect()]
    want = sorted((i, np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore")) for i, b, m in removed(rows_))
    assert sorted((LAST if r["doc_id"] is None else r["doc_id"], r["text"]) for r in cut.collect()) == want
    safe = C.STAGES[3][1](spark, cut.withColumn("text", F.concat("text", F.lit(" password=hunter2222"))), "")
    assert safe.columns == x.columns and all(r["text"].endswith("[SECRET]") and r["n_chars"] == len(r["text"]) for r in safe.collect())
    assert {r["doc_id"] for r in C.STAGES[4][1](spark, safe, "").collect()} == {r["doc_id"] for r in safe.collect()}
    for _, stage in C.STAGES:
        assert stage(spark, x.limit(0), "").count() == 0


def test_pipeline_runs(spark, sf_dir):
    import corpus_pipeline as C

    out = C.run(spark, sf_dir)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0
