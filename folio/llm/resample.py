"""Target-distribution importance resampling: documents drawn by how much they look like a target set.

Words of whole texts are hashed to buckets; a bucket's gain is the scaled log ratio of its share in the target texts to
its share in all documents (both with one added), a document's weight the mean gain of its words, and its score the
weight plus Gumbel noise that a digest of its id decides, so the highest scores are a draw without replacement.

1. Every task counts its words in a vector of all buckets; vectors are added by bucket.  The gains (as many as `buckets`,
   whatever the input) go to the workers, which score whole batches by array lookups.
2. The cutoff of the draw is bracketed by a quantile sketch over the scores; exact counts outside the bracket validate it,
   or widen it until they do.  Only the rows inside are sorted, in ranges, to find the last one drawn.
3. The drawn rows get ranks by ranges: each range is numbered on its own and offsets are added.

Rows are ordered by score (descending), id (nulls last) and their place in the scored table, so no two are equal and no
range holds a hot key.  The driver sees gains, counts of ranges and the cutoff.

Defined results: null text has no words; a row without words has weight 0; a null id is drawn as the empty string; equal
ids (repeated rows) are rows of their own; without eligible rows, or a share that floors to none, nothing is drawn; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, doc_chunks, materialize, partitions, ragged, small_batches, text_bytes

#: Bytes of words: digits, letters and everything beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
#: Words up to this length are hashed side by side, longer ones alone.
_SIDE_BY_SIDE = 48


def _crc_table() -> np.ndarray:
    """One byte's step of crc32 (reflected polynomial EDB88320)."""
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, np.uint32(0xEDB88320) ^ (x >> np.uint32(1)), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def crc32_all(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of many stretches of bytes."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-size, -_SIDE_BY_SIDE))
    for k in range(long):
        state[k] = zlib.crc32(data[start[k] : start[k] + size[k]]) ^ 0xFFFFFFFF
    live = np.searchsorted(-size, -np.arange(_SIDE_BY_SIDE), "left")  # how many stretches are longer than j
    for j in range(_SIDE_BY_SIDE):
        own = slice(long, max(long, int(live[j])))
        if own.start == own.stop:
            break
        s = state[own]
        state[own] = _CRC[(s ^ data[start[own] + j]) & np.uint32(0xFF)] ^ (s >> np.uint32(8))
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the words in lower-cased bytes; words end where documents do."""
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offs[(offs > 0) & (offs < len(data))]
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def feature_buckets(texts: pa.Array, buckets: int, n: int = 1):
    """Yields, for documents in order and a few at a time, the buckets of their features and the features of each document.

    Features are all runs of 1 to n words, joined by one space.
    """
    data, offs = text_bytes(texts)
    for i, j in doc_chunks(offs):
        b, o = LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        s, e = word_bounds(b, o)
        cut = np.searchsorted(s, o)
        found, of = [], []
        flat = start = None
        if n > 1:  # words one after another with one space each, so that a run is a stretch
            size = e - s + 1
            start = np.cumsum(size) - size
            flat = np.full(int(size.sum()), 32, np.uint8)
            flat[ragged(start, e - s)] = b[ragged(s, e - s)]
        doc = np.repeat(np.arange(j - i), np.diff(cut))
        for k in range(n):
            m = max(0, len(s) - k)
            within = doc[:m] == doc[k : k + m]
            if k == 0:
                h = crc32_all(b, s, e - s)
            else:
                h = crc32_all(flat, start[:m][within], (start[k : k + m] + (e - s)[k : k + m] - start[:m])[within])
            found.append((h % np.uint32(buckets)).astype(np.int64))
            of.append(doc[:m][within])
        yield np.concatenate(found), np.concatenate(of), j - i, np.diff(cut)


def count_features(docs: DataFrame, buckets: int, n: int = 1, text_col: str = "text") -> DataFrame:
    """(bucket, n): how often features of all whole texts fall in each bucket; one vector a task, added by bucket."""
    small_batches(docs.sparkSession)

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for found, *_ in feature_buckets(b.column(0), buckets, n):
                total += np.bincount(found, minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["bucket", "n"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, n: int = 1, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """Gain of each bucket: floor(1000 * ln of the ratio of its smoothed shares in target and documents)."""
    vectors = []
    for df, col in ((docs, text_col), (target, target_col)):
        v = np.zeros(buckets, np.int64)
        for r in count_features(df, buckets, n, col).collect():
            v[r["bucket"]] = r["n"]
        vectors.append(v.tolist())
    s_all, t_all = sum(vectors[0]) + buckets, sum(vectors[1]) + buckets
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(*vectors, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Scaled Gumbel noise of a document."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, place) of every row; place is unique."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_features", "n_words", "weight", "score", "place"]

    def run(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << 40
        for b in batches:
            weight, features, words = [], [], []
            for found, of, k, n_words in feature_buckets(b.column("text"), len(gain), n):
                sums = np.zeros(k, np.int64)
                np.add.at(sums, of, gain[found])
                count = np.bincount(of, minlength=k)
                weight.append(np.where(count > 0, sums // np.maximum(count, 1), 0))
                features.append(count)
                words.append(n_words)
            w = np.concatenate(weight) if weight else np.zeros(0, np.int64)
            ids = b.column("doc_id").to_pylist()
            score = w + np.array([noise(i, seed) for i in ids], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(features) if features else w), pa.array(np.concatenate(words) if words else w), pa.array(w), pa.array(score), pa.array(place + np.arange(len(w)))], names)
            place += len(w)

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(run, ", ".join(f"{c} long" for c in names))


_ORDER = [F.desc, F.asc_nulls_last, F.asc]
_KEYS = ["score", "doc_id", "place"]


def in_order(df: DataFrame, name: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """df written in ranges of the order, with each row's number (from 0) in its range; and the ranges' (number, rows)."""
    spark = df.sparkSession
    order = [f(c) for f, c in zip(_ORDER, _KEYS, strict=True)]
    schema = ", ".join(f"{c} long" for c in [*df.columns, "range_no", "own"])

    def number(batches):
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(done + np.arange(b.num_rows))], [*b.schema.names, "range_no", "own"])
            done += b.num_rows

    x = materialize(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(number, schema), name)
    return x, sorted((r["range_no"], r["n"]) for r in x.groupBy("range_no").agg(F.count("*").alias("n")).collect())


def bracket(scores: DataFrame, drawn: int, total: int, error: float) -> tuple[int, int, int]:
    """(low, high, above): scores low..high hold the drawn-th highest of `total`, and `above` rows lie over high.

    A sketch proposes the bracket; exact counts outside it decide.  Each refusal widens it, at last to all scores.
    """
    share, accuracy = 1 - drawn / total, max(1, min((1 << 31) - 1, round(1 / error)))
    while True:
        if error < 0.5:
            low, high = scores.agg(F.percentile_approx("score", [max(0.0, share - 2 * error), min(1.0, share + 2 * error)], accuracy).alias("q")).first()["q"]
        else:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, upto = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score") >= low)).first()
        if above < drawn <= upto:
            return low, high, above
        error *= 4


def cutoff(scores: DataFrame, drawn: int, total: int, error: float = 0.001):
    """Condition for the first `drawn` rows of the order; only the bracket around the cutoff is sorted."""
    low, high, above = bracket(scores, drawn, total, error)
    inside, ranges = in_order(scores.where(F.col("score").between(low, high)).select(*_KEYS), "bracket")
    left = drawn - above
    for part, n in ranges:
        if left <= n:
            break
        left -= n
    last = inside.where((F.col("range_no") == part) & (F.col("own") == left - 1)).first()
    same = F.col("score") == last["score"]
    before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.col("doc_id") < last["doc_id"]
    tied = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]).cast("long")) & (F.col("place") <= last["place"])
    return (F.col("score") > last["score"]) | (same & F.coalesce(before, F.lit(False))) | (same & tied)


def _offsets(spark: SparkSession, ranges: list[tuple[int, int]]) -> DataFrame:
    rows, done = [], 0
    for part, n in ranges:
        rows.append((part, done))
        done += n
    return spark.createDataFrame(rows, "at int, before long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000, n: int = 1, seed: int = 2024, error: float = 0.001, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for rows that aren't drawn.

    Drawn are floor(percent * N / 100) of the N rows with at least `least_words` words, highest scores first.
    """
    spark = docs.sparkSession
    scored = materialize(score_documents(docs, gains(docs, target, buckets, n, text_col, target_col), n, seed, id_col, text_col), "scored")
    eligible = F.col("n_words") >= least_words
    total = scored.where(eligible).count()
    drawn = percent * total // 100
    out = ["doc_id", "n_features", "weight", "score"]
    if drawn == 0:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    chosen = eligible & cutoff(scored.where(eligible), drawn, total, error)
    ranked, ranges = in_order(scored.where(chosen).select(*out, "place"), "drawn")
    ranks = ranked.join(_offsets(spark, ranges), F.col("range_no") == F.col("at")).select(*out, (F.col("before") + F.col("own") + 1).alias("rank"))
    return ranks.unionByName(scored.where(~chosen).select(*out, F.lit(None).cast("long").alias("rank")))
