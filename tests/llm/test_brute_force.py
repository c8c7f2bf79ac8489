"""op1, op2, op6 and hashing against brute force in plain Python."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from folio.llm import chaining, common, fingerprints, jaccard, language, packing

from .helpers import awkward, frame, sentence


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values):
    """Spark's xxhash64: the hash of one value is the seed of the next."""
    import xxhash

    h = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", signed(v & (1 << 64) - 1))
        h = xxhash.xxh64(raw, seed=h).intdigest()
    return h


def signature(text, k=5, slots=32, size=2):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    h = [spark_hash(w) for w in words]
    grams = [spark_hash(*h[i : i + k]) for i in range(len(h) - k + 1)] if len(h) >= k else [spark_hash(*h)] if h else []
    seen, bins = {}, {}
    for pos, g in enumerate(grams):
        n = seen[g] = seen.get(g, -1) + 1
        x = spark_hash(g, (n,))
        bins.setdefault((x >> 59) ^ 16, []).append((signed(x), pos))
    out = []
    for b in range(slots):
        least = sorted(bins.get(b, []))[:size]
        out.append(max(1, spark_hash(*[x for x, _ in sorted(least, key=lambda v: v[1])]) & 0xFFFFFFFF) if least else 0)
    return out


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(31)
    rows = [(k, sentence(rng, n)) for k, n in enumerate([0, 1, 4, 5, 6, 20, 40, 70, 90, 120, 400, 2000])]
    rows += [(20, "a b c " * 50), (21, "x " * 300), (22, None), (23, "  \t\n"), (24, rows[9][1] + " tail"), (25, "é ü " + rows[8][1])]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, key=lambda r: -r[0])

    def like(a, b):
        filled = sum(x != 0 or y != 0 for x, y in zip(a, b, strict=True))
        return sum(x == y != 0 for x, y in zip(a, b, strict=True)) / filled if filled else 1.0

    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        a, b, c = signature(text), signature(edited), signature(after)
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in a)
        assert got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in b)
        assert got[i]["near_edited"] == pytest.approx(like(a, b)) and got[i]["near_next"] == pytest.approx(like(a, c))


def thue_morse(n):
    x, y = "a", "b"
    while len(x) < n:
        x, y = x + y, y + x
    return x, y


def test_constructed_words_do_not_collide(spark):
    words = [w for n in (64, 1024, 4096) for w in thue_morse(n)]
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    h, s, e, _ = common.words_of(raw, np.array([0, len(raw)], np.int64))
    assert len(set(h.tolist())) == len(words) and [raw[a:b].tobytes().decode() for a, b in zip(s, e, strict=True)] == words
    docs = spark.createDataFrame(list(enumerate(thue_morse(4096))), "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard.similar_components(docs).collect()) == [0, 1]


def test_words_by_brute_force():
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choice("aB é\n\t.x") for _ in range(rng.randrange(40))) for _ in range(300)]
    data, offs = common.text_bytes(pa.array(texts, pa.large_string()))
    h, s, e, cut = common.words_of(data, offs)
    lower = lambda b: bytes(c + 32 if 65 <= c <= 90 else c for c in b)
    seen = {}
    for k, t in enumerate(texts):
        want = [lower(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
        got = [lower(data[s[x] : e[x]].tobytes()) for x in range(cut[k], cut[k + 1])]
        assert got == want
        for x, w in zip(range(cut[k], cut[k + 1]), want, strict=True):
            assert seen.setdefault(int(h[x]), w) == w
    assert len(seen) == len(set(seen.values()))


ODD = ["H̱", "ẖ", "J̌", "T̈", "W̊", "İ", "!", "Σ", "ς", "a", "B", "'s", "'", "é", "É", "É", "ǅ", "Ⓐ", "1", "22", "中", "가", "-", "ﬁ", " ", "́", "Å", "×", "ß", "<|endoftext|>"]


@pytest.mark.parametrize("collide", [False, True])
def test_words_are_encoded_as_the_tokenizer_does(collide, monkeypatch):
    from tokenizers import Tokenizer

    if collide:  # every hash is the same, so that bytes alone tell words apart
        monkeypatch.setattr(packing, "hash_eights", lambda x, at, n: np.zeros(len(n), np.uint64))
    path = P.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    ref.encode_special_tokens = True
    rng = random.Random(7)
    texts = ["", " ", *["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 7))) + rng.choice([" ", "\n", ""]) + "".join(rng.choice(ODD) for _ in range(rng.randrange(5))) for _ in range(200 if collide else 3000)], sentence(rng, 500)]
    t = packing.WordTokenizer(path, most=500)
    for at in range(0, len(texts), 250):
        part = texts[at : at + 250]
        ids, cut = t.encode(*common.text_bytes(pa.array(part, pa.large_string())))
        for k, x in enumerate(part):
            assert ids[cut[k] : cut[k + 1]].tolist() == ref.encode(x, add_special_tokens=False).ids, x.encode("unicode_escape")


def test_packing_by_brute_force(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ref = Tokenizer.from_file(path)
    ref.encode_special_tokens = True
    rows = awkward(random.Random(5)) + [(100, "twice"), (100, "twice")] + [(None, f"null {k}") for k in range(5)]
    pieces = packing.pack_documents(frame(spark, rows), path).collect()
    want = sorted(zlib.crc32(np.array(ref.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in rows)
    by_seq, whole = {}, []
    for r in pieces:
        by_seq.setdefault(r["sequence_id"], []).append(r)
        if r["length"] == r["doc_tokens"]:
            whole.append(r["ids_crc32"])
    assert set(whole) <= set(want)
    for seq, part in by_seq.items():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or seq == max(by_seq)
    assert sum(r["length"] for r in pieces) == sum(len(ref.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)


def test_gram_counts_and_prediction_by_brute_force():
    buckets = 1 << 10
    bits = 10
    mul = [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F]

    def slow(text):
        b = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in (" " + text.lower() + " ").encode())
        out = np.zeros(buckets, np.int64)
        for n in (2, 3, 4):
            for i in range(len(b) - n + 1):
                g = b[i : i + n]
                if 32 in (g if n == 2 else g[1 : n - 1]):
                    continue
                h = n
                for k in range(n):
                    h = (h + g[k] + 1) & 0xFFFFFFFF
                    h = h * mul[k] & 0xFFFFFFFF
                    h ^= h >> 15
                out[max(1, h >> (32 - bits))] += 1
        return out

    texts = ["Hello, World", "", "a", "über die Brücke 12", "x y z", "l'été déjà"]
    got = list(language.gram_counts(pa.array(texts, pa.large_string()), buckets))
    assert all((g == slow(t)).all() for g, t in zip(got, texts, strict=True))
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b", "c"], rng.normal(0, 3, (buckets, 3)).astype(np.float32), rng.normal(0, 1, 3), 0.7, 0.4, buckets)
    lang, score, rejected = language.predict_batch(pa.array(texts, pa.large_string()), model)
    for k, t in enumerate(texts):
        if not any(c.isalpha() for c in t):
            assert (lang[k], score[k], rejected[k]) == ("und", 0.0, True)
            continue
        c = slow(t)
        z = (c @ model.table.astype(float) / max(1, c.sum()) + model.bias) / 0.7
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert lang[k] == "abc"[int(p.argmax())] and score[k] == pytest.approx(p.max(), rel=1e-4) and rejected[k] == (p.max() < 0.4)


def test_language_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(docs, language.train(docs)).join(docs.select("doc_id", "lang", language.held_out().alias("held")), "doc_id").where("held AND lang IS NOT NULL AND NOT rejected").collect()
    assert len(found) >= 20 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.95


def test_repetitive_texts_and_their_copies(spark):
    """Passages of a text that repeats one block many times, and of a copy of it, are few and cover the copy."""
    rng = random.Random(41)
    block = " ".join(f"q{rng.randrange(10**6)}" for _ in range(24))
    rows = [(1, f"{block} " * 30), (2, f"start here {block} " + f"{block} " * 29), (3, f"{block} " * 300)]
    got = chaining.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for doc, total in ((2, 722), (3, 7200)):
        covered = set()
        for r in got:
            if r["doc_id"] == doc:
                assert r["source_id"] < doc
                covered |= set(range(r["start_word"], r["end_word"]))
        assert len(covered) >= total - 48 and sum(r["doc_id"] == doc for r in got) <= 60


def test_components_of_repeated_and_nameless_rows(spark):
    rng = random.Random(43)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(1, a), (1, a), (1, b), (2, a), (3, b), (None, a), (None, a), (None, sentence(rng, 50))]
    df = frame(spark, rows).withColumnRenamed("key", "__keep")
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in jaccard.keep_one(df).collect())
    assert kept == sorted((i is None, i or 0, t) for i, t in {(1, a), (1, b), (None, a), (None, rows[-1][1])})
