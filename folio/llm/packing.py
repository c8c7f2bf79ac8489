"""Packing along a space-filling curve.

Documents are tokenized, their hashed token counts are projected to a few dimensions, and the place on a
Hilbert curve through that space is the sort key (ties broken by a hash of the row, then by its number in its task, so
that a group of copies, of null ids or of repeated rows spreads over ranges; keys are written once, with the ids).  Ranges of the key are cut at quantiles; the token total of each range gives the place at
which it begins in one long stream, and the stream is cut every `length` tokens.  Neighbours on the
curve share sequences, all sequences but the very last are full, and no task handles more than its range.

Defined results: null or empty text is the end id alone; a null doc_id is packed like any other; repeated rows
are packed each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, WORKER_MEMORY, eights, hash_eights, id_text, materialize, partitions, ragged, range_of, small_batches, text_bytes, word_bounds

DIMS, BITS, HASHED = 3, 8, 1024
# Fixed value: the pattern by which the vocabulary file cuts words.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Generations(dict):
    """A bounded memory of make(key): when full it becomes the old generation, from which what is used again comes back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Words that are encoded in one call.
JOINED = 4096
#: Kinds of bytes as the pattern tells them apart: white space, letters, digits, others; 4 for what only whole words can settle.
KIND = np.full(256, 4, np.uint8)
KIND[33:127], KIND[48:58], KIND[65:91], KIND[97:123], KIND[39], KIND[SPACE] = 3, 2, 1, 1, 4, 0


def pieces_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the pieces that the vocabulary's pattern cuts: words of printable ASCII without apostrophes and of Latin letters
    (U+00C0 to U+024F, two bytes each) into letters, single digits and others; all other words stay whole."""
    s, e = word_bounds(data, offs)
    if not len(s):
        return s, e
    kind = KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))
    if len(lead):  # signs of multiplication and division, and the one letter whose lower case is two
        both = data[lead].astype(np.int32) << 8 | data[np.minimum(lead + 1, len(data) - 1)]
        lead = lead[~np.isin(both, [0xC397, 0xC3B7, 0xC4B0])]
        kind[lead] = kind[lead + 1] = 1
    fit = np.zeros(len(data), bool)
    fit[s[0] :] = np.repeat(np.add.reduceat((kind == 4).astype(np.int32), s) == 0, np.diff(np.append(s, len(data))))
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = fit[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & (kind[1:] > 0) & (kind[:-1] > 0)
    cut[s] = True
    first = np.flatnonzero(cut)
    word = np.searchsorted(s, first, "right") - 1
    return first, np.minimum(np.append(first[1:], len(data)), e[word])


class WordTokenizer:
    """Ids of whole texts, every distinct piece encoded once.

    The vocabulary drops white space and no token crosses it or the borders of its pattern, so pieces are independent.  A
    batch's pieces are grouped by hash in numpy and compared byte by byte with the first of their group; only the first
    become bytes, which are the key under which this worker remembers their ids.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True  # their strings in a text are ordinary text
        self.kind = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        self.find, self.most = regex.compile(_PIECES).findall, most
        self.pieces = Generations(self._encode, 500_000)
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _encode(self, piece: str) -> bytes:
        return np.array(self.t.encode(piece, add_special_tokens=False).ids, self.kind).tobytes()

    def _word(self, w: str) -> bytes:
        """The vocabulary composes a word (NFC), lowers it letter by letter and then cuts it; words for which the order may matter go whole."""
        if not w.isprintable():
            return self._encode(w)
        low = w.lower()
        if not w.isascii() and ("'" in w or "\u03a3" in w or len(low) != len(w) or not is_normalized("NFC", w) or not is_normalized("NFC", low)):
            return self._encode(w)
        return self.pieces[low] if low.isalpha() else b"".join([self.pieces[p] for p in self.find(low)])

    def _learn(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        lows = [t.lower() for t in texts]
        plain = [low.isalpha() and (t.isascii() or len(low) == len(t) and "\u03a3" not in t and is_normalized("NFC", t) and is_normalized("NFC", low)) for t, low in zip(texts, lows, strict=True)]
        alone = [k for k, p in enumerate(plain) if p]
        for at in range(0, len(alone), JOINED):  # letters alone are one piece each, so many are encoded together
            some = alone[at : at + JOINED]
            e = self.t.encode(" ".join([lows[k] for k in some]), add_special_tokens=False)
            n = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
            if len(n) != len(some) or not n.all():
                raise ValueError("the vocabulary cuts letters where its pattern does not")
            self._keep([words[k] for k in some], np.array(e.ids, self.kind), n)
        rest = [(words[k], np.frombuffer(self._word(texts[k]), self.kind)) for k, p in enumerate(plain) if not p]
        if rest:
            self._keep([w for w, _ in rest], np.concatenate([x for _, x in rest]), np.array([len(x) for _, x in rest], np.int64))

    def _keep(self, words: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.slots)
        while k + len(words) > len(self.start):
            self.start, self.length = (np.resize(x, 2 * len(x)) for x in (self.start, self.length))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[k : k + len(words)], self.length[k : k + len(words)] = self.used + np.cumsum(n) - n, n
        self.used += len(ids)
        self.slots.update(zip(words, range(k, k + len(words)), strict=True))

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        import pandas as pd

        s, e = pieces_of(data, offs)
        if (data >= 128).any():  # words of ASCII alone may be lowered first; in others a letter's marks would compose otherwise
            wide = np.flatnonzero(np.diff(np.cumsum(np.append(0, data >= 128))[np.stack([s, e])], axis=0)[0]) if len(s) else s
            own = ragged(s[wide], (e - s)[wide])
            low = LOWER[data]
            low[own] = data[own]
            data = low
        else:
            data = LOWER[data]
        x, at = eights(data, s, e)
        codes, distinct = pd.factorize(hash_eights(x, at, e - s))
        first = np.zeros(len(distinct), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        like, size = first[codes], np.diff(np.append(at, len(x)))
        other = e - s != (e - s)[like]
        same = np.flatnonzero(~other)
        differ = x[ragged(at[same], size[same])] != x[ragged(at[like[same]], size[same])]
        other[np.repeat(same, size[same])[differ]] = True
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)]
        if other.any():  # another word with the hash of the first of its group
            found: dict[bytes, int] = {}
            for k in np.flatnonzero(other).tolist():
                codes[k] = found.setdefault(raw[s[k] : e[k]], len(words) + len(found))
            words += list(found)
        if len(self.slots) > self.most:
            self._clear()
        self._learn([w for w in dict.fromkeys(words) if w not in self.slots])
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))[codes]
        n = self.length[slot]
        return self.flat[ragged(self.start[slot], n)], np.append(0, n.cumsum())[np.searchsorted(s, offs, "left")]


def word_tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer for the file; what it has learnt lasts from one task to the next."""
    if path not in WORKER_MEMORY:
        WORKER_MEMORY[path] = WordTokenizer(path)
    return WORKER_MEMORY[path]


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dims), by the transpose method."""
    x = coords.astype(np.int64).copy()
    n, dims = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[:, i] & q) != 0
            swap = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(up, x[:, 0] ^ p, x[:, 0] ^ swap)
            if i:
                x[:, i] = np.where(up, x[:, i], x[:, i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(n, np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[:, dims - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_points(ids: list[np.ndarray], seed: int = 11) -> np.ndarray:
    """Hashed token counts, damped and scaled to length 1, projected to DIMS coordinates of BITS bits."""
    plane = np.random.default_rng(seed).normal(0, 1, (HASHED, DIMS))
    out = np.empty((len(ids), DIMS))
    for k, x in enumerate(ids):
        v = np.sqrt(np.bincount((x.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(22), minlength=HASHED))
        out[k] = v @ plane / max(1.0, float(np.sqrt((v * v).sum())))
    even = 1 / (1 + np.exp(-1.702 * out))  # near the normal distribution: coordinates fill their range
    return np.minimum((even * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


#: Ranges of the curve for each task: documents differ much in length, so tasks take ranges by their tokens.
FINE = 4
#: Bytes of text that are tokenized together.
BATCH_BYTES = 4 << 20


def tokenize(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, key, ids): ids as packed little-endian integers, key the place on the curve, a hash of the row and the row's number in its task."""
    small_batches(docs.sparkSession)

    def finish(t: WordTokenizer, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, cut = t.encode(*text_bytes(table.column("text").cast(pa.large_string())))
        end = np.array([end_id], t.kind)
        each = [np.concatenate([ids[a:b], end]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        key = (hilbert(curve_points(each)) << 36) | np.asarray(table.column("tie"))
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks(), pa.array(np.diff(cut) + 1), pa.array(key, pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], ["doc_id", "n", "key", "ids"])

    def run(batches):
        t, held, size = word_tokenizer(path), [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= BATCH_BYTES:
                yield finish(t, held)
                held, size = [], 0
        if held:
            yield finish(t, held)

    x = id_text(docs, id_col, text_col)
    own, row = F.xxhash64("doc_id", "text").bitwiseAND((1 << 24) - 1), F.monotonically_increasing_id().bitwiseAND((1 << 12) - 1)
    x = x.withColumn("tie", F.shiftleft(own, 12).bitwiseOR(row))
    return x.mapInArrow(run, "doc_id long, n long, key long, ids binary")


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    spark = docs.sparkSession
    wide = tokenizer_is_wide(path)
    tokens = materialize(tokenize(docs, path, end_id, id_col, text_col), "tokens")
    n = max(2, partitions(spark))
    fine = FINE * n
    cuts = tokens.agg(F.percentile_approx("key", [i / fine for i in range(1, fine)], 20 * fine).alias("p")).first()["p"] or []
    bucket = range_of(F.col("key"), sorted(set(cuts)))
    totals = {r["b"]: r["n"] for r in tokens.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect()}
    whole = max(1, sum(totals.values()))
    base, part, at = {}, [0] * (len(set(cuts)) + 1), 0
    for b in sorted(totals):  # neighbouring ranges go to one task until it has its share of the tokens
        base[b], part[b], at = at, (2 * at + totals[b]) * n // (2 * whole), at + totals[b]
    kind = np.dtype("<u4" if wide else "<u2")

    def cut(batches):
        now, place = None, 0
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for rng, doc, raw in zip(b.column("b").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if rng != now:
                    now, place = rng, base[rng]
                ids = np.frombuffer(raw.as_buffer(), kind).astype("<u4")
                start, total = 0, len(ids)
                while start < total:
                    seq, off = divmod(place, length)
                    size = min(total - start, length - off)
                    for col, v in zip(out, (doc, start, size, zlib.crc32(ids[start : start + size].tobytes()), total, seq, off), strict=True):
                        col.append(v)
                    start, place = start + size, place + size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    dealt = tokens.select(bucket.alias("b"), "key", "doc_id", "ids").repartitionById(n, F.get(F.lit(part), F.col("b"))).sortWithinPartitions("b", "key", "doc_id", "ids")
    return dealt.select("b", "doc_id", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_is_wide(path: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() > 1 << 16
