"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. Every block of documents is cut into pre-tokens; a document becomes the positions' indexes into the
   block's list of distinct pre-tokens, and that list is dealt to buckets by a hash of the pre-token.
2. A bucket meets every occurrence of its pre-tokens over all blocks, encodes each distinct one once, and
   answers each block with the ids of the pre-tokens it asked for.
3. Each block joins the answers to its positions and puts the ids together in order; decoding joins the ids
   to the token-byte table of the rank file.

What crosses the network is one row per block and bucket, never a row per word occurrence.  The blocks
are kept as a table bucketed by block, so the positions themselves are not shuffled.

Defined results: null text is empty and has no ids; null doc_ids and repeated rows give a row each; texts are
encoded whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, id_text, partitions, ragged, small_batches

#: Bytes of text in a block; a single longer text is a block of its own.
BLOCK_BYTES = 16 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def encoder(path: str, pattern: str):
    """Encode one pre-token (bytes) to its ids."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


def _pack_words(words: list[bytes], index: np.ndarray) -> bytes:
    lens = np.fromiter(map(len, words), np.int32, len(words))
    return zlib.compress(np.int32(len(words)).tobytes() + index.astype(np.int32).tobytes() + lens.tobytes() + b"".join(words), 1)


def _unpack_words(raw: bytes) -> tuple[np.ndarray, list[bytes]]:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    index, lens = np.frombuffer(raw, np.int32, n, 4), np.frombuffer(raw, np.int32, n, 4 + 4 * n)
    ends = np.cumsum(lens, dtype=np.int64) + 4 + 8 * n
    return index, [raw[e - k : e] for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]


_BLOCKS = "block long, bucket int, doc_id long, payload binary"


def blocks_of(docs: DataFrame, pattern: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds: bucket -1 is a document (payload: positions), others are the block's words for that bucket."""
    small_batches(docs.sparkSession)

    def run(batches):
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        part, seq = TaskContext.get().partitionId(), 0

        def emit(block, ids, payloads, words):
            lists: list[list] = [[] for _ in range(buckets)]
            index: list[list] = [[] for _ in range(buckets)]
            for k, w in enumerate(words):
                raw = w.encode()
                b = zlib.crc32(raw) % buckets
                lists[b].append(raw)
                index[b].append(k)
            rows = [(b, _pack_words(lists[b], np.array(index[b]))) for b in range(buckets) if lists[b]]
            n = len(ids) + len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * n, pa.int64()), pa.array([-1] * len(ids) + [b for b, _ in rows], pa.int32()), pa.array(ids + [None] * len(rows), pa.int64()), pa.array(payloads + [p for _, p in rows], pa.binary())],
                ["block", "bucket", "doc_id", "payload"],
            )

        ids: list = []
        payloads: list = []
        size = 0
        words: dict[str, int] = {}
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if ids and size + len(text) > BLOCK_BYTES:
                    yield emit((part << 32) + seq, ids, payloads, words)
                    seq, ids, payloads, size, words = seq + 1, [], [], 0, {}
                found = find(text)
                for w in set(found):
                    if w not in words:
                        words[w] = len(words)
                at = np.fromiter(map(words.__getitem__, found), np.uint32, len(found))
                ids.append(doc)
                payloads.append(zlib.compress((at.view(np.uint8).reshape(-1, 4).T).tobytes(), 1))
                size += len(text)
        if ids:
            yield emit((part << 32) + seq, ids, payloads, words)

    return id_text(docs, id_col, text_col).mapInArrow(run, _BLOCKS)


def encode_bucket(table: pa.Table, encode) -> pa.Table:
    """Answers of one bucket: each distinct word is encoded once, whatever blocks ask for it."""
    known: dict[bytes, bytes] = {}
    blocks, out = [], []
    for block, raw in zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True):
        index, words = _unpack_words(raw)
        parts = []
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = known[w] = np.array(encode(w.decode()), "<u4").tobytes()
            parts.append(ids)
        lens = np.fromiter(map(len, parts), np.int32, len(parts)) // 4
        blocks.append(block)
        out.append(zlib.compress(np.int32(len(words)).tobytes() + index.tobytes() + lens.tobytes() + b"".join(parts), 1))
    return pa.table({"block": pa.array(blocks, pa.int64()), "payload": pa.array(out, pa.binary())})


def assemble(docs: pa.Table, answers: pa.Table):
    """Yields (doc_id, ids) of one block's documents."""
    index, lens, flat = [], [], []
    for raw in answers.column("payload").to_pylist():
        raw = zlib.decompress(raw)
        n = int(np.frombuffer(raw, np.int32, 1)[0])
        index.append(np.frombuffer(raw, np.int32, n, 4))
        lens.append(np.frombuffer(raw, np.int32, n, 4 + 4 * n))
        flat.append(np.frombuffer(raw, "<u4", -1, 4 + 8 * n))
    ids = np.concatenate(flat) if flat else np.zeros(0, "<u4")
    words = np.concatenate(index) if index else np.zeros(0, np.int32)
    size = np.concatenate(lens).astype(np.int64) if lens else np.zeros(0, np.int64)
    where, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    where[words], count[words] = np.cumsum(size) - size, size
    for doc, raw in zip(docs.column("doc_id").to_pylist(), docs.column("payload").to_pylist(), strict=True):
        planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)
        at = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
        yield doc, ids[ragged(where[at], count[at])]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all bytes, and start and length by id."""
    ranks = load_ranks(path)
    size = max(ranks.values(), default=-1) + 1
    table = [b""] * size
    for raw, k in ranks.items():
        table[k] = raw
    lens = np.fromiter(map(len, table), np.int64, size)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lens) - lens, lens


def decode_ids(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bytes:
    flat, start, lens = table
    ids = ids.astype(np.int64)
    return b"".join(flat[ragged(start[p], lens[p])].tobytes() for p in (ids[k : k + (1 << 16)] for k in range(0, len(ids), 1 << 16)))


def encode_documents(docs: DataFrame, path: str, pattern: str, per_doc, schema: str, names: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text; per_doc(ids, token-byte table) gives the values after doc_id of each output row."""
    spark = docs.sparkSession
    buckets = max(1, partitions(spark))
    blocks = blocks_of(docs, pattern, buckets, id_col, text_col)
    kept = bucketed(blocks, "bpe", buckets, "block")

    def encode(table: pa.Table) -> pa.Table:
        return encode_bucket(table, encoder(path, pattern))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        table = token_bytes(path)
        rows = [(doc, *per_doc(ids, table)) for doc, ids in assemble(left, right)]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        return pa.table({n: pa.array(c) if len(c) else pa.array([], pa.null()) for n, c in zip(names, cols, strict=True)})

    answers = kept.where("bucket >= 0").select("block", "bucket", "payload").groupBy("bucket").applyInArrow(encode, "block long, payload binary")
    left = kept.where("bucket < 0").select("block", "doc_id", "payload")
    return left.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded."""

    def digests(ids: np.ndarray, table) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_ids(ids, table)).hexdigest()

    return encode_documents(docs, path, pattern, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], id_col, text_col)
