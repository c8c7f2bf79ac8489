"""op11, op12 and op13 against plain Python on small tables with awkward cases, and op13 against the library itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from folio.llm import align, pieces, resample
from tests.llm.helpers import awkward, frame, sentence

P = pytest.importorskip("public_tokenizers")
PIECES, BPE = P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a", " a", "a ", "a  ", "x  y", "\n", " \n x", "a\n b", "a\n  b ", "\t\t", "<s> </s><unk>", "<0x0A>", "<|endoftext|> x<|endoftext|>", "\x00a \x00", "é́ﬁ①", "\xa0a \xa0 b", "a\x1c b", "日本語 の テキスト", "🙂🙂 🙂x", "don't 's  'll", "aaaa" * 300, "12345 67,890.12", "a\r\n\tb", "a " * 50, " x  ", "ﷺ ﷺ", "a​ b"]
MARKED = ["▁", "a▁b", "▁a", "a▁", "a ▁ b", "x▁ y"]


def odd_rows(rng):
    alphabet = "ab é\n\t.,X1日🙂\xa0'"
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    return [(1000 + k, t) for k, t in enumerate([*ODD, *MARKED, *some])]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    return awkward(rng) + odd_rows(rng)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def key(r):
    return tuple((x is not None, x) for x in r)


def test_pieces_as_the_library(spark, rows, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in rows:
        ids = sp.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(r) for r in pieces.round_trip(docs, PIECES).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert pieces.round_trip(docs.limit(0), PIECES).count() == 0
    again = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, PIECES).collect() if r["doc_id"] and r["doc_id"] >= 1000}
    assert all(again[i] == sp.encode(t) for i, t in rows if i and i >= 1000)


def test_pieces_decode_any_ids(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(6)
    lists = [[rng.randrange(32000) for _ in range(rng.randrange(30))] for _ in range(100)] + [[rng.randrange(260) for _ in range(12)] for _ in range(100)] + [[], [1, 28705, 264], [0], [28705, 28705], [229], [2, 264]]
    df = spark.createDataFrame([*enumerate(lists), (900, None), (901, [32000]), (902, [-1]), (903, [None])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in pieces.decode(df, PIECES).collect()}
    assert all(got[k] == sp.decode(x) for k, x in enumerate(lists)) and got[900] is got[901] is got[902] is got[903] is None


def test_blocks_of_any_size(spark, rows, docs, monkeypatch):
    """Blocks of few texts give what one block gives."""
    import folio.llm.pieces as module

    few = [x for x in rows if x[0] and x[0] >= 1000][:80]
    model = module.Pieces(PIECES)
    words, at, lens = module.number_words([t for _, t in few], module.marked_words)
    ids = model.segment(words)
    ends = np.cumsum(lens)
    for (_, t), e, n in zip(few, ends.tolist(), lens.tolist(), strict=True):
        assert [x for w in at[e - n : e].tolist() for x in ids[w]] == model.library.encode(t)


def brute_alignment(rows):
    model = align.Alignment(BPE, PIECES)
    A, B = model.a, model.b
    out, held, links = [], Counter(), []
    for i, t in rows:
        a, b = (A.library.encode(" " + t, add_special_tokens=False).ids, B.library.encode(t)) if t else ([], [])
        raw = (" " + t).encode() if t else b""
        ba, bb = [A.bytes[k] for k in a], [b" " * 0 + B.bytes[k] for k in b]
        if not t or b"".join(ba) != raw or b"".join(bb) != raw:
            out.append((i, [], []))
            links.append([])
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        if len(a) > 3000:
            ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
        ea, eb = ends(ba), ends(bb)
        common, groups, x, y = sorted(set(ea) & set(eb)), [], 0, 0
        for c in common:
            ga, gb = [], []
            while x < len(ea) and ea[x] <= c:
                ga.append(a[x])
                x += 1
            while y < len(eb) and eb[y] <= c:
                gb.append(b[y])
                y += 1
            groups.append((ga, gb))
        own = [(p, q) for ga, gb in groups for p in ga for q in gb]
        held.update(set(own))
        links.append(own)
        out.append((i, groups, [len(a), len(b)]))
    best = defaultdict(int)
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    result = []
    for (i, groups, n), own in zip(out, links, strict=True):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        result.append((i, *(n or (0, 0)), len(groups), len(own), sum(held[x] == best[x[0]] for x in own), sum(held[x] for x in own), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return result, held, best


def test_alignment_by_brute_force(spark, rows, docs, monkeypatch):
    want, held, best = brute_alignment(rows)
    got = [tuple(r) for r in align.align_documents(docs, BPE, PIECES).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {i for i, t in rows if t and "▁" in t} == {r[0] for r in got if r[0] and r[0] >= 1000 and r[1] == 0 and dict(rows)[r[0]] != ""}
    pairs = {(r["a"], r["b"]): (r["n_docs"], r["best"]) for r in align.pair_counts(docs, BPE, PIECES).collect()}
    assert pairs == {k: (n, n == best[k[0]]) for k, n in held.items()}
    assert align.align_documents(docs.limit(0), BPE, PIECES).count() == 0
    texts = {r["doc_id"]: r["groups"] for r in align.aligned_groups(docs, BPE, PIECES).collect()}
    assert all(("" if texts[w[0]] is None else hashlib.sha256(texts[w[0]].encode()).hexdigest()) == w[7] for w in want if w[0] and w[0] >= 1000)


def test_alignment_in_small_steps(rows, monkeypatch):
    """Units aligned a few at a time, and links expanded a few documents at a time, give the same."""
    model = align.Alignment(BPE, PIECES)
    texts = [t or "" for _, t in rows]
    x, at, lens, d = align._align_block(texts, model)
    d["groups"] = list(d["groups"])
    monkeypatch.setattr(align, "UNITS", 7)
    y, *_, e = align._align_block(texts, model)
    assert list(e["groups"]) == d["groups"] and all((x[k] == y[k]).all() for k in ("n_a", "n_b", "n_groups", "n_links", "bad"))
    codes, pairs = np.unique(x["pair"], return_inverse=True)
    whole = align._document_counts(x, at, lens, d["fine"], len(model.same), pairs, len(codes))
    monkeypatch.setattr(align, "ENTRIES", 3)
    parts = align._document_counts(x, at, lens, d["fine"], len(model.same), pairs, len(codes))
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def features(text, n):
    w = WORD.findall(lower(text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def brute_resampling(rows, target, percent, n=1, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x, n)[0]), Counter(bucket(f) for x in target for f in features(x, n)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for k, (i, x) in enumerate(rows):
        f, n_words = features(x, n)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words, k])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize(("percent", "n", "error"), [(10, 1, 0.001), (50, 2, 0.05), (100, 1, 0.001), (0, 1, 0.001)])
def test_resampling_by_brute_force(spark, rows, docs, percent, n, error):
    target = [sentence(random.Random(k), 40) for k in range(10)] + [None, "", "É日本 x"]
    got = [tuple(r) for r in resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, n=n, error=error).collect()]
    assert sorted(got, key=key) == sorted(brute_resampling(rows, target, percent, n), key=key)


def test_resampling_of_ties_and_nothing(spark):
    target = spark.createDataFrame([("x",)], "text string")
    twins = [(7, "same words " * 30)] * 500 + [(k, "other text of words " * 6) for k in range(100)] + [(None, "word " * 25)] * 50
    rng = random.Random(3)
    rng.shuffle(twins)
    got = [tuple(r) for r in resample.resample(spark.createDataFrame(twins, "doc_id long, text string").repartition(5), target, 30).collect()]
    assert sorted(got, key=key) == sorted(brute_resampling(twins, ["x"], 30), key=key)
    none = spark.createDataFrame([(1, None), (2, ""), (3, "few words")], "doc_id long, text string")
    assert {r["rank"] for r in resample.resample(none, target.limit(0)).collect()} == {None}
    assert resample.resample(none.limit(0), target).count() == 0


def test_bracket_widens(spark):
    """A sketch that misses is refused by exact counts."""
    scores = spark.range(10_000).selectExpr("id % 100 AS score")
    for drawn in (1, 99, 100, 101, 5000, 9999, 10_000):
        low, high, above = resample.bracket(scores, drawn, 10_000, 0.00005)
        assert above == 100 * (99 - high) and above < drawn <= 100 * (100 - low)


def test_crc_of_many():
    rng = random.Random(9)
    words = [bytes(rng.randrange(256) for _ in range(n)) for n in [0, 1, 2, 3, 47, 48, 49, 50, 1000, *(rng.randrange(20) for _ in range(200))]]
    flat, size = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    assert resample.crc32_all(flat, np.cumsum(size) - size, size).tolist() == [zlib.crc32(w) for w in words]
    assert resample.crc32_all(flat, size[:0], size[:0]).tolist() == []
    assert [x[0].tolist() for x in resample.feature_buckets(pa.array(["", None, "--"]), 10)] == [[]]
