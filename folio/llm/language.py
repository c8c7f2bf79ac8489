"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is lower-cased, every byte that is not part of a letter becomes a space, and its 2- to 4-byte
grams that stay within one word (a gram may hold the space at either end) are hashed to `buckets`.  The mean
of the gram embeddings goes through a linear layer and a softmax.  Embeddings and layer are trained
together by stochastic gradient descent in numpy on the driver.

Training takes a bounded sample: of the documents it may learn from, at most about `per_language` of each
language, chosen by a hash of doc_id; each document is counted over its whole text.  One in five of
the sample is held back to fit the temperature and the rejection limit, the score under which only `reject_share`
of correctly labelled documents fall (and never more than `reject_cap`).

Defined results: a text that is null, empty or without any letter is `und` with score 0 and counts as rejected;
a null doc_id is never learned from and counts as held out; repeated rows give a row each; with no labelled
row to learn from, everything is `und`; ties between languages go to the first in sorted order; other columns
are ignored by `identify` and kept by `keep_identified`.  Text, and nothing else, decides a prediction.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_chunks, small_batches, text_bytes

ORDERS = (2, 3, 4)
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
#: a-z and the bytes of other letters stay; every other ASCII byte separates.
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): embedding times layer
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    buckets: int = field(default=1 << 14)


def gram_counts(texts: pa.Array, buckets: int):
    """Yields for each text in order its counts by bucket; bucket 0 holds what isn't a gram and is set to 0."""
    if pa.types.is_string(texts.type):
        texts = texts.cast(pa.large_string())
    joined = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.utf8_lower(pc.fill_null(texts, "")), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    data, offs = text_bytes(joined)
    bits = buckets.bit_length() - 1
    with np.errstate(over="ignore"):
        for i, j in doc_chunks(offs):
            b = _LETTER[data[offs[i] : offs[j]]]
            o, solid, wide = offs[i : j + 1] - offs[i], b != 32, b.astype(np.uint32) + np.uint32(1)
            hashed = []
            for n in ORDERS:
                m = len(b) - n + 1
                if m <= 0:
                    hashed.append(np.zeros(0, np.uint32))
                    continue
                h = np.full(m, n, np.uint32)
                for k in range(n):
                    h += wide[k : k + m]
                    h *= _MULTIPLIERS[k]
                    h ^= h >> np.uint32(15)
                ok = solid[:m] & solid[1 : 1 + m] if n == 2 else solid[1 : 1 + m].copy()
                for k in range(2, n - 1):
                    ok &= solid[k : k + m]
                h >>= np.uint32(32 - bits)
                np.maximum(h, 1, out=h)
                h *= ok
                hashed.append(h)
            for d in range(j - i):
                counts = np.zeros(buckets, np.int64)
                for n, h in zip(ORDERS, hashed, strict=True):
                    if (end := o[d + 1] - n + 1) > o[d]:
                        counts += np.bincount(h[o[d] : end], minlength=buckets)
                counts[0] = 0
                yield counts


def _eligible(id_col: str) -> tuple[Column, Column]:
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
    return F.coalesce(remainder != 2, F.lit(False)), F.coalesce(remainder == 2, F.lit(True))


def held_out(id_col: str = "doc_id") -> Column:
    return _eligible(id_col)[1]


def sample_counts(docs: DataFrame, may_learn: Column, per_language: int, buckets: int, id_col: str, text_col: str, lang_col: str) -> list:
    """Sparse gram counts of the bounded sample: about per_language documents of each language."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), may_learn.alias("may")).where(F.col("may") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = {r["lang"]: r["n"] for r in x.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return []
    draw = F.xxhash64(F.lit("sample"), F.col("doc_id")).bitwiseAND((1 << 30) - 1)
    limit = F.lit(0)
    for lang, n in sorted(totals.items()):
        limit = F.when(F.col("lang") == lang, int(min(1.0, per_language / n) * (1 << 30))).otherwise(limit)
    spare = F.xxhash64(F.lit("calibrate"), F.col("doc_id")).bitwiseAND(0xFFFF) % 5 == 0

    def count(batches):
        for b in batches:
            out = [(np.flatnonzero(c).astype(np.int32), c[c > 0].astype(np.int32)) for c in gram_counts(b.column("text"), buckets)]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("spare"), pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([n.tobytes() for _, n in out], pa.binary())], ["lang", "spare", "bucket", "n"])

    drawn = x.where(draw < limit).select("text", "lang", spare.alias("spare"))
    rows = drawn.mapInArrow(count, "lang string, spare boolean, bucket binary, n binary").collect()
    return sorted((r["lang"], r["spare"], bytes(r["bucket"]), bytes(r["n"])) for r in rows)


def _dense(rows: list, buckets: int) -> np.ndarray:
    x = np.zeros((len(rows), buckets), np.float32)
    for k, (_, _, b, n) in enumerate(rows):
        c = np.frombuffer(n, np.int32)
        x[k, np.frombuffer(b, np.int32)] = c / max(1, c.sum())
    return x


def fit(rows: list, buckets: int = 1 << 14, dim: int = 16, epochs: int = 12, rate: float = 4.0, batch: int = 32, seed: int = 7, reject_share: float = 0.001, reject_cap: float = 0.5) -> LanguageModel | None:
    """Stochastic gradient descent over the sample, then the temperature and the rejection limit on the spare rows."""
    rows = [r for r in rows if r[2]]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    learn, spare = [r for r in rows if not r[1]] or rows, [r for r in rows if r[1]] or rows
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1, (buckets, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    code = {x: i for i, x in enumerate(languages)}
    steps, done = epochs * -(-len(learn) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(learn))
        for at in range(0, len(order), batch):
            part = [learn[k] for k in order[at : at + batch]]
            used = np.unique(np.concatenate([np.frombuffer(r[2], np.int32) for r in part]))
            x = _dense(part, buckets)[:, used]
            mean = x @ emb[used]
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), [code[r[0]] for r in part]] -= 1
            p /= len(part)
            eta = rate * (1 - done / steps)
            back = x.T @ (p @ layer.T)
            layer -= eta * (mean.T @ p)
            bias -= eta * 0.1 * p.sum(0)
            emb[used] -= eta * back * dim
            done += 1
    table = (emb @ layer).astype(np.float32)
    z = np.concatenate([_dense(spare[k : k + 64], buckets) @ table for k in range(0, len(spare), 64)]) + bias
    truth = np.array([code[r[0]] for r in spare])

    def loss(t):
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))

    grid = np.geomspace(0.05, 20, 60)
    temperature = float(min(grid, key=loss))
    model = LanguageModel(languages, table, bias, temperature, 0.0, buckets)
    pick, score = _scores(z, model)
    right = score[pick == truth]
    model.least_score = float(min(reject_cap, np.quantile(right, reject_share))) if len(right) else 0.0
    return model


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600, buckets: int = 1 << 14, **params) -> LanguageModel | None:
    small_batches(docs.sparkSession)
    return fit(sample_counts(docs, _eligible(id_col)[0], per_language, buckets, id_col, text_col, lang_col), buckets, **params)


def _scores(z: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    s = z.astype(np.float64) / model.temperature
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    pick = p.argmax(1)
    return pick, p[np.arange(len(p)), pick]


def predict_batch(texts: pa.Array, model: LanguageModel | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) of each text."""
    n = len(texts)
    lang, score = np.full(n, "und", object), np.zeros(n)
    has = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
    if model is not None and has.any():
        at = np.flatnonzero(has)
        z = np.empty((len(at), len(model.languages)), np.float64)
        for k, c in enumerate(gram_counts(texts.filter(pa.array(has)), model.buckets)):
            z[k] = c.astype(np.float32) @ model.table / max(1, c.sum()) + model.bias
        pick, s = _scores(z, model)
        lang[at], score[at] = np.array(model.languages, object)[pick], s
    return lang.tolist(), score, ~has | (score < (model.least_score if model else 2.0))


def identify(docs: DataFrame, model: LanguageModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, by its whole text alone."""
    small_batches(docs.sparkSession)

    def predict(batches):
        for b in batches:
            lang, score, rejected = predict_batch(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns.  With nothing learned, only texts without letters go."""
    small_batches(docs.sparkSession)

    def keep(batches):
        for b in batches:
            texts = b.column(text_col)
            rejected = predict_batch(texts, model)[2] if model else ~np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
            yield b.filter(pa.array(~rejected))

    return docs.mapInArrow(keep, docs.schema)
