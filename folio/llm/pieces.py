"""SentencePiece encoding and decoding by a table of distinct marked words.

In a model none of whose pieces holds the white-space marker after another character, no piece crosses the start of
a marked word (a run of markers and what follows up to the next marker), so every marked word is segmented on its own:

1. Every block of documents is cut into marked words; a document becomes indexes into the block's list of distinct
   words (most frequent first), and that list is dealt to buckets by a hash of the word.
2. A bucket meets the words of all blocks, segments each distinct one once with the library, and answers each block.
3. Each block joins the answers back by position; decoding joins the ids to a table of the pieces' bytes.

What crosses the network is one row per block and bucket.  Documents are kept in a table bucketed by block, one row
per block, so positions are not shuffled.  A word that a third of all rows hold is one entry per block.

Defined results: null text is empty and has no ids; null doc_ids and repeated rows give a row each; texts are encoded
whole; a literal marker in a text reads as a space, as in the library; an empty table gives no rows; other columns are
ignored.  A model with pieces that cross markers, or that changes text before it segments it, is refused.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORKER_MEMORY, bucketed, id_text, partitions, ragged, small_batches

#: Characters of text in a block; a single longer text is a block of its own.
BLOCK_CHARS = 16 << 20
MARK = "▁"
_MARKED = re.compile(" +[^ ]*").findall


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers as one compressed string, bytes of equal rank together."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(np.array([len(a), ord(a.dtype.kind), a.dtype.itemsize], "<i8").tobytes() + a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unsqueeze(raw: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        n, kind, size = np.frombuffer(raw, "<i8", 3, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * size, at + 24).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<{chr(kind)}{size}").ravel())
        at += 24 + n * size
    return out


def text_blocks(batches, most: int | None = None):
    """Yields (block, doc_ids, texts) of about `most` characters; the block's number is unique over all partitions."""
    from pyspark import TaskContext

    part, seq, size, most = TaskContext.get().partitionId(), 0, 0, most or BLOCK_CHARS
    ids: list = []
    texts: list = []
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if ids and size + len(text) > most:
                yield (part << 32) + seq, ids, texts
                seq, size, ids, texts = seq + 1, 0, [], []
            ids.append(doc)
            texts.append(text)
            size += len(text)
    if ids:
        yield (part << 32) + seq, ids, texts


def number_words(texts: list[str], cut) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of all texts, most frequent first; all texts' words as indexes into them; words of each text."""
    counts: Counter = Counter()
    for text in texts:
        counts.update(cut(text))
    words = [w for w, _ in counts.most_common()]
    index = dict(zip(words, range(len(words)), strict=True))
    at = [np.fromiter(map(index.__getitem__, x := cut(text)), np.uint32, len(x)) for text in texts]
    return words, np.concatenate(at) if at else np.zeros(0, np.uint32), np.fromiter(map(len, at), np.uint32, len(at))


def pack_ids(ids: list) -> tuple[np.ndarray, np.ndarray]:
    """Nullable ids as numbers and null flags."""
    return np.array([i or 0 for i in ids], np.int64).view(np.uint64), np.array([i is None for i in ids], np.uint8)


def unpack_ids(ids: np.ndarray, null: np.ndarray) -> list:
    return [None if gone else i for i, gone in zip(ids.view(np.int64).tolist(), null.tolist(), strict=True)]


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker (a space here); the first marker is the model's own prefix."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    return text.split(" ") if "  " not in text and text[0] != " " else [w[1:] for w in _MARKED(" " + text)]


class Pieces:
    """A SentencePiece model whose marked words can be segmented one by one."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(k) for k in range(size)]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece of this model crosses a white-space marker")
        probe = "x  y \tﬁ①Ａ é "
        self.lone = self.library.encode("x ")[len(self.library.encode("x")) :]
        if self.library.decode(self.library.encode(probe)) != probe or self.library.decode(self.lone) != "" or not self.lone:
            raise ValueError("this model changes text before it segments it")
        self.plain = np.array([not self.library.is_control(k) and not self.library.is_unknown(k) for k in range(size)])
        raw = [b"" if not self.plain[k] else bytes([int(p[3:5], 16)]) if self.library.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(names)]
        self.bytes = raw
        self.marked = np.array([p.startswith(MARK) for p in names])
        self.length = np.fromiter(map(len, raw), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    @classmethod
    def of(cls, path: str) -> Pieces:
        """The model at a path, loaded once in a worker."""
        key = ("pieces", path)
        if key not in WORKER_MEMORY:
            WORKER_MEMORY[key] = cls(path)
        return WORKER_MEMORY[key]

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words, given without their first marker."""
        return [x if w else self.lone for w, x in zip(words, self.library.encode(words, num_threads=1), strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """What the library's decode makes of the ids, in UTF-8."""
        ids = ids.astype(np.int64)
        if len(ids) and self.plain[ids].all():
            raw = b"".join(self.flat[ragged(self.start[p], self.length[p])].tobytes() for p in (ids[k : k + (1 << 16)] for k in range(0, len(ids), 1 << 16)))
            try:
                raw.decode()
                return raw[1:] if self.marked[ids[0]] else raw
            except UnicodeDecodeError:
                pass  # the library puts marks in the place of broken byte runs
        return self.library.decode(ids.tolist()).encode()


_BLOCKS = "block long, bucket int, payload binary"


def _blocks_of(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of two kinds: bucket -1 has a block's documents, others the block's words for that bucket."""

    def run(batches):
        for block, ids, texts in text_blocks(batches):
            words, at, lens = number_words(texts, marked_words)
            raw = [w.encode() for w in words]
            where = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw)) % np.uint32(buckets)
            order = np.argsort(where, kind="stable")
            ends = np.searchsorted(where[order], np.arange(buckets + 1))
            rows = [(-1, squeeze(*pack_ids(ids), lens, at, order.astype(np.uint32)))]
            for b in np.flatnonzero(np.diff(ends)).tolist():
                part = [raw[k] for k in order[ends[b] : ends[b + 1]].tolist()]
                rows.append((b, squeeze(np.fromiter(map(len, part), np.uint32, len(part)), np.frombuffer(b"".join(part), np.uint8))))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["block", "bucket", "payload"])

    return docs.mapInArrow(run, _BLOCKS)


def _segment_bucket(table: pa.Table, model: Pieces) -> pa.Table:
    """Answers of one bucket: each distinct word is segmented once, whatever blocks ask for it."""
    known: dict[bytes, bytes] = {}
    out = []
    for raw in table.column("payload").to_pylist():
        lens, flat = unsqueeze(raw)
        data, ends = flat.tobytes(), np.cumsum(lens, dtype=np.int64)
        words = [data[e - k : e] for e, k in zip(ends.tolist(), lens.tolist(), strict=True)]
        new = [w for w in words if w not in known]
        for w, ids in zip(new, model.segment([w.decode() for w in new]), strict=True):
            known[w] = np.array(ids, "<u4").tobytes()
        parts = [known[w] for w in words]
        out.append(squeeze(np.fromiter(map(len, parts), np.uint32, len(parts)) // np.uint32(4), np.frombuffer(b"".join(parts), "<u4")))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})


def _assemble(docs: pa.Table, answers: pa.Table):
    """Yields (doc_id, ids) of one block's documents."""
    got = [unsqueeze(raw) for _, raw in sorted(zip(answers.column("bucket").to_pylist(), answers.column("payload").to_pylist(), strict=True))]
    size = np.concatenate([g[0] for g in got]).astype(np.int64) if got else np.zeros(0, np.int64)
    flat = np.concatenate([g[1] for g in got]) if got else np.zeros(0, "<u4")
    del got
    for raw in docs.column("payload").to_pylist():
        ids, null, lens, at, order = unsqueeze(raw)
        start, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        start[order], count[order] = np.cumsum(size) - size, size
        end = 0
        for doc, n in zip(unpack_ids(ids, null), lens.tolist(), strict=True):
            own = at[end : end + n]
            end += n
            yield doc, flat[ragged(start[own], count[own])]


def encode_documents(docs: DataFrame, path: str, per_doc, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text; per_doc(ids, model) gives the values after doc_id of each output row, by the names of the schema."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = max(1, partitions(spark))
    kept = bucketed(_blocks_of(id_text(docs, id_col, text_col), buckets), "pieces", buckets, "block")
    names = [c.split()[0] for c in schema.split(", ")]

    def answer(table: pa.Table) -> pa.Table:
        return _segment_bucket(table, Pieces.of(path))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        model = Pieces.of(path)
        rows = [(doc, *per_doc(ids, model)) for doc, ids in _assemble(left, right)]
        return pa.table({n: pa.array(list(c)) if len(c) else pa.array([], pa.null()) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)})

    answers = kept.where("bucket >= 0").groupBy("bucket").applyInArrow(answer, "block long, bucket int, payload binary")
    return kept.where("bucket < 0").select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text."""
    return encode_documents(docs, path, lambda ids, _: (ids.astype(np.int32),), "doc_id long, ids array<int>", id_col, text_col)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every array of ids, as the library's decode makes it; null for null, or for ids the model lacks."""

    def run(batches):
        model = Pieces.of(path)
        for b in batches:
            out = [None if x is None or any(k is None or not 0 <= k < len(model.plain) for k in x) else model.decode(np.array(x, np.int64)).decode() for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    small_batches(ids.sparkSession)
    return ids.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def ids_digest(ids: np.ndarray) -> str:
    """sha256 of the decimal ids joined by commas."""
    h = hashlib.sha256()
    for k in range(0, len(ids), 1 << 16):
        h.update((b"," if k else b"") + ",".join(map(str, ids[k : k + (1 << 16)].tolist())).encode())
    return h.hexdigest()


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded."""
    return encode_documents(docs, path, lambda ids, model: (len(ids), ids_digest(ids), hashlib.sha256(model.decode(ids)).hexdigest()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
