"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) stand for which pieces of a SentencePiece model (B).

Byte offsets of space+text where tokens of both sides end cut a text into groups.  A space after a character that is
neither white space nor the marker starts a token on both sides, so texts are cut there into units, and groups never
cross units: each distinct unit of a block of documents is encoded and aligned once.

1. An array made beforehand maps each A id to the B id of the same bytes.  Pairs it holds are counted, by documents, in
   vectors as long as the A vocabulary; only other pairs, which come from irregular groups alone, are pairs in the shuffle.
2. Buckets own A ids (modulo): they add up the blocks' vectors and pairs, find each A id's highest count, and answer the
   blocks with the counts of what they asked for.
3. Each block, kept as one row of a table bucketed by block, sums its units' links by those counts and its documents' units.

What crosses the network is one row per block and bucket, whatever the number of links; a unit or pair that a third of all
documents hold is one entry per block.

Defined results: a text that is null, empty, or holds the marker itself (whose bytes B gives back as a space) has no tokens:
zeros and an empty digest; strings of special tokens are plain text; null doc_ids and repeated rows give a row each, and each
row counts as a document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORKER_MEMORY, bucketed, id_text, partitions, ragged, small_batches
from .pieces import MARK, Pieces, number_words, pack_ids, squeeze, text_blocks, unpack_ids, unsqueeze

#: Distinct units that are encoded and aligned at once.
UNITS = 1 << 14
#: Distinct (document, unit) entries whose links are expanded at once.
ENTRIES = 1 << 19
_LOOSE = re.compile(rf"[\s{MARK}] ")
_BORDER = re.compile(rf"(?<=[^\s{MARK}])(?= )")


def units(text: str) -> list[str]:
    """The units of space+text, each without its leading space."""
    if not text:
        return []
    if text[0] != " " and not _LOOSE.search(text):
        return text.split(" ")
    return [u[1:] for u in _BORDER.split(" " + text)]


class BytePairs:
    """A byte-level BPE of the tokenizers library with the bytes of its tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}
        self.bytes = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, k in vocab.items():
            if all(c in byte for c in token):
                self.bytes[k] = bytes(map(byte.__getitem__, token))
        self.length = np.fromiter(map(len, self.bytes), np.int64, len(self.bytes))

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids


class Alignment:
    """Both tokenizers, the identity map, and the decimal forms of ids."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = BytePairs(path_a), Pieces(path_b)
        if self.b.lone != [k for k, raw in enumerate(self.b.bytes) if raw == b" " and self.b.marked[k]][:1]:
            raise ValueError("a single marker isn't a piece of its own in this model")
        if max(len(self.a.bytes), len(self.b.bytes)) > 1 << 20:
            raise ValueError("pairs of ids are packed in 20 bits each")
        by_bytes: dict[bytes, int] = {}
        for k, raw in enumerate(self.b.bytes):
            if self.b.plain[k] and (raw not in by_bytes or self.b.library.is_byte(by_bytes[raw])):
                by_bytes[raw] = k
        self.same = np.fromiter((by_bytes.get(raw, -1) if raw else -1 for raw in self.a.bytes), np.int64, len(self.a.bytes))
        digits = [str(k).encode() for k in range(max(len(self.a.bytes), len(self.b.bytes)))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.n_digits = np.fromiter(map(len, digits), np.int64, len(digits))
        self.digits_at = np.cumsum(self.n_digits) - self.n_digits

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Alignment:
        key = ("alignment", path_a, path_b)
        if key not in WORKER_MEMORY:
            WORKER_MEMORY[key] = cls(path_a, path_b)
        return WORKER_MEMORY[key]

    def tokens(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids of units one after another, and which units both sides give back byte by byte; others have no ids."""
        good = np.zeros(len(keys), bool)
        ids_a: list = []
        ids_b: list = []

        def add(part: list[int]) -> bool:
            text = " " + " ".join(keys[k] for k in part)
            a, b = self.a.encode(text), self.b.segment([text[1:]])[0]
            raw = text.encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) != raw or b"".join(map(self.b.bytes.__getitem__, b)) != raw:
                return False
            ids_a.extend(a)
            ids_b.extend(b)
            good[part] = True
            return True

        at = 0
        while at < len(keys):  # units that may stand in one text, then one that must stand alone
            end = at
            while end < len(keys) and keys[end] and not keys[end][-1].isspace() and MARK not in keys[end]:
                end += 1
            if end > at and not add(list(range(at, end))):
                for k in range(at, end):
                    add([k])
            if end < len(keys):
                add([end])
            at = end + 1
        return np.array(ids_a, np.int64), np.array(ids_b, np.int64), good

    def align(self, keys: list[str]) -> dict:
        """Groups and links of units: by unit the numbers of tokens, groups and links and the groups as text; links by unit."""
        a, b, good = self.tokens(keys)
        size = np.fromiter((len(k.encode()) + 1 if g else 0 for k, g in zip(keys, good.tolist(), strict=True)), np.int64, len(keys))
        unit_end = np.cumsum(size)
        end_a, end_b = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        cut = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        n_a, n_b = np.bincount(of_a, minlength=len(cut)), np.bincount(of_b, minlength=len(cut))
        last_a, last_b = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        unit = np.searchsorted(unit_end, cut)  # the first end at or after the cut; units without bytes share the end before them
        count = lambda x, w=None: np.bincount(x, w, minlength=len(keys)).astype(np.int64)
        text = self._text(a, b, of_a, of_b, last_a, last_b, n_a)
        text_end = np.cumsum(np.bincount(unit[of_a], self.n_digits[a] + 1, len(keys)) + np.bincount(unit[of_b], self.n_digits[b] + 1, len(keys))).astype(np.int64) if len(cut) else np.zeros(len(keys), np.int64)
        one = (n_a == 1) & (n_b == 1)
        one[one] = self.same[a[last_a[one]]] == b[last_b[one]]
        # other groups: every distinct A id of the group with every distinct B id, times how often each is there
        ka, ca = np.unique(of_a[~one[of_a]] << 20 | a[~one[of_a]], return_counts=True)
        kb, cb = np.unique(of_b[~one[of_b]] << 20 | b[~one[of_b]], return_counts=True)
        first, last = np.searchsorted(kb >> 20, ka >> 20), np.searchsorted(kb >> 20, ka >> 20, "right")
        left, right = np.repeat(np.arange(len(ka)), last - first), ragged(first, last - first)
        la, lb, times, lu = ka[left] & 0xFFFFF, kb[right] & 0xFFFFF, ca[left] * cb[right], unit[ka[left] >> 20]
        same = self.same[la] == lb
        iu, ia, im = np.concatenate([unit[one], lu[same]]), np.concatenate([a[last_a[one]], la[same]]), np.concatenate([np.ones(int(one.sum()), np.int64), times[same]])
        order = np.argsort(iu, kind="stable")
        return {
            "n_a": count(unit[of_a]), "n_b": count(unit[of_b]), "n_groups": count(unit), "n_links": count(iu, im) + count(lu[~same], times[~same]), "bad": ~good,
            "text": [text[x:y] for x, y in zip([0, *text_end[:-1].tolist()], text_end.tolist(), strict=True)],
            "same_n": count(iu), "same_a": ia[order], "same_m": im[order],
            "pair_n": count(lu[~same]), "pair": la[~same] << 20 | lb[~same], "pair_m": times[~same],
        }

    def _text(self, a, b, of_a, of_b, last_a, last_b, n_a) -> bytes:
        """All groups as `a1,a2|b1;`, one after another."""
        at_a = np.arange(len(a)) + (last_b + 1 - np.bincount(of_b, minlength=len(last_b)))[of_a]
        at_b = np.arange(len(b)) + np.cumsum(n_a)[of_b]
        ids, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[at_a], ids[at_b] = a, b
        after[at_a[last_a]], after[at_b[last_b]] = ord("|"), ord(";")
        size = self.n_digits[ids] + 1
        out, end = np.empty(int(size.sum()), np.uint8), np.cumsum(size)
        out[end - 1] = after
        out[ragged(end - size, size - 1)] = self.digits[ragged(self.digits_at[ids], size - 1)]
        return out.tobytes()


def _join(parts: list[dict], name: str) -> np.ndarray:
    return np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64)


def _align_block(texts: list[str], model: Alignment) -> tuple[dict, np.ndarray, np.ndarray, dict]:
    """Units of a block aligned, its documents as indexes into them, units of each document, and the documents' own values."""
    words, at, lens = number_words(texts, units)
    parts = [model.align(words[k : k + UNITS]) for k in range(0, len(words), UNITS)]
    x = {name: _join(parts, name) for name in ("n_a", "n_b", "n_groups", "n_links", "bad", "same_n", "same_a", "same_m", "pair_n", "pair", "pair_m")}
    text = [t for p in parts for t in p["text"]]
    end = np.cumsum(lens, dtype=np.int64)
    sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[at], dtype=np.int64)])[np.concatenate([[0], end])])
    fine = (sums(x["bad"]) == 0) & (lens > 0)
    groups = (b"".join(map(text.__getitem__, at[e - n : e].tolist()))[:-1] if ok else b"" for e, n, ok in zip(end.tolist(), lens.tolist(), fine.tolist(), strict=True))
    docs = {name: sums(x[name]) * fine for name in ("n_a", "n_b", "n_groups", "n_links")}
    return x, at, lens, docs | {"fine": fine, "groups": groups}


def _document_counts(x: dict, at: np.ndarray, lens: np.ndarray, fine: np.ndarray, size: int, pairs: np.ndarray, n_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a block's documents hold each identity pair (by A id) and each other pair (by its index)."""
    doc = np.repeat(np.arange(len(lens)), lens)
    used = fine[doc]
    held = np.unique(doc[used] * len(x["bad"]) + at[used]) if len(x["bad"]) else np.zeros(0, np.int64)
    doc, unit = held // max(1, len(x["bad"])), held % max(1, len(x["bad"]))
    out = []
    for n, ids, width in ((x["same_n"], x["same_a"], size), (x["pair_n"], pairs, n_pairs)):
        first, total = np.cumsum(n) - n, np.zeros(width, np.int64)
        step = 0
        while step < len(doc):  # whole documents, at least one
            stop = min(len(doc), step + ENTRIES)
            stop = int(np.searchsorted(doc, doc[stop - 1], "right")) if stop < len(doc) else stop
            u, d = unit[step:stop], doc[step:stop]
            found = np.unique(np.repeat(d, n[u]) * max(1, width) + ids[ragged(first[u], n[u])])
            total += np.bincount(found % max(1, width), minlength=width)[:width]
            step = stop
        out.append(total)
    return out[0], out[1]


_BLOCKS = "block long, bucket int, payload binary"


def _blocks_of(docs: DataFrame, paths: tuple[str, str], buckets: int) -> DataFrame:
    """Rows of two kinds: bucket -1 has a block's documents and units, others its counts for that bucket."""

    def run(batches):
        model = Alignment.of(*paths)
        for block, ids, texts in text_blocks(batches):
            x, at, lens, d = _align_block(texts, model)
            digest = b"".join(hashlib.sha256(g).digest() for g in d["groups"])
            codes, pairs = np.unique(x["pair"], return_inverse=True)
            order = np.argsort((codes >> 20) % buckets, kind="stable")
            codes, place = codes[order], np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs = place[pairs]
            same, other = _document_counts(x, at, lens, d["fine"], len(model.same), pairs, len(codes))
            u = lambda v, kind=np.uint32: v.astype(kind)
            rows = [(-1, squeeze(*pack_ids(ids), lens, at, u(d["fine"], np.uint8), *(u(d[n], np.uint64) for n in ("n_a", "n_b", "n_groups", "n_links")), np.frombuffer(digest, np.uint8), u(x["same_n"]), u(x["same_a"]), u(x["same_m"]), u(x["pair_n"]), u(pairs), u(x["pair_m"], np.uint64)))]
            ends = np.searchsorted((codes >> 20) % buckets, np.arange(buckets + 1))
            for b in range(buckets):
                own, vector = slice(ends[b], ends[b + 1]), same[b::buckets]
                if ends[b] < ends[b + 1] or vector.any():
                    rows.append((b, squeeze(u(vector), u(codes[own] >> 20), u(codes[own] & 0xFFFFF), u(other[own]))))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], ["block", "bucket", "payload"])

    return docs.mapInArrow(run, _BLOCKS)


def _totals(payloads: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's A ids (a // buckets): documents of the identity pair, the other pairs and their documents, the highest count."""
    vector, codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge():
        nonlocal codes, counts
        all_codes, back = np.unique(np.concatenate([codes, *(c for c, _ in held)]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, *(n for _, n in held)]).astype(np.float64), len(all_codes)).astype(np.int64)
        codes = all_codes
        held.clear()

    for raw in payloads:
        v, a, b, n = unsqueeze(raw)
        vector = v.astype(np.int64) if not len(vector) else vector + v
        held.append((a.astype(np.int64) << 20 | b, n.astype(np.int64)))
        if sum(len(c) for c, _ in held) > max(1 << 20, len(codes)):
            merge()
    merge()
    best = vector.copy()
    np.maximum.at(best, (codes >> 20) // buckets, counts)
    return vector, codes, counts, best


def _answer_bucket(table: pa.Table, buckets: int) -> pa.Table:
    payloads = table.column("payload").to_pylist()
    vector, codes, counts, best = _totals(payloads, buckets)
    out = []
    for raw in payloads:
        v, a, b, _ = unsqueeze(raw)
        n = counts[np.searchsorted(codes, a.astype(np.int64) << 20 | b)]
        known = np.where(v > 0, vector, 0)
        out.append(squeeze(known.astype(np.uint64), ((known == best) & (v > 0)).astype(np.uint8), n.astype(np.uint64), (n == best[a // buckets]).astype(np.uint8)))
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "payload": pa.array(out, pa.binary())})


_SCHEMA = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish_block(left: pa.Table, right: pa.Table, size: int, buckets: int) -> pa.Table:
    same, same_best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    pair, pair_best = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b, raw in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True)):
        v, top, n, most = unsqueeze(raw)
        same[b::buckets], same_best[b::buckets] = v, top
        pair.append(n.astype(np.int64))
        pair_best.append(most.astype(np.int64))
    cols: dict[str, list] = {c.split()[0]: [] for c in _SCHEMA.split(", ")}
    counts, best = np.concatenate(pair), np.concatenate(pair_best)
    for raw in left.column("payload").to_pylist():
        ids, null, lens, at, fine, n_a, n_b, n_groups, n_links, digest, sn, sa, sm, pn, pp, pm = unsqueeze(raw)
        ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])

        def by_doc(one: np.ndarray, other: np.ndarray) -> list[int]:
            unit = np.zeros(len(sn), np.int64)
            for n, values in ((sn, one[sa] * sm.astype(np.int64)), (pn, other[pp] * pm.astype(np.int64))):
                unit += np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(n, dtype=np.int64)])])
            return (np.diff(np.concatenate([[0], np.cumsum(unit[at])])[ends]) * fine).tolist()

        hexes = digest.tobytes().hex()
        for name, values in zip(cols, [unpack_ids(ids, null), n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), by_doc(same_best, best), by_doc(same, counts), [hexes[64 * k : 64 * k + 64] if ok else "" for k, ok in enumerate(fine.tolist())]], strict=True):
            cols[name] += values
    return pa.table({n: pa.array(v, pa.string() if n == "groups_sha256" else pa.int64()) for n, v in cols.items()})


def _kept(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    small_batches(docs.sparkSession)
    buckets = max(1, partitions(docs.sparkSession))
    return bucketed(_blocks_of(id_text(docs, id_col, text_col), (path_a, path_b), buckets), "align", buckets, "block"), buckets


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its numbers of tokens, groups and links, how many links are their A id's most frequent, the sum of their counts, and a digest of the groups."""
    kept, buckets = _kept(docs, path_a, path_b, id_col, text_col)

    def answer(table: pa.Table) -> pa.Table:
        return _answer_bucket(table, buckets)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return _finish_block(left, right, len(Alignment.of(path_a, path_b).same), buckets)

    answers = kept.where("bucket >= 0").groupBy("bucket").applyInArrow(answer, _BLOCKS)
    return kept.where("bucket < 0").select("block", "payload").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, _SCHEMA)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): how many documents hold each pair of ids linked, and whether it is the A id's highest count."""
    kept, buckets = _kept(docs, path_a, path_b, id_col, text_col)

    def count(key, table):
        bucket = key[0].as_py()
        vector, codes, counts, best = _totals(table.column("payload").to_pylist(), buckets)
        own = np.flatnonzero(vector)
        a, b = np.concatenate([own * buckets + bucket, codes >> 20]), np.concatenate([Alignment.of(path_a, path_b).same[own * buckets + bucket], codes & 0xFFFFF])
        n = np.concatenate([vector[own], counts])
        return pa.table({"a": a, "b": b, "n_docs": n, "best": n == best[a // buckets]}).filter(pa.array(n > 0))

    return kept.where("bucket >= 0").groupBy("bucket").applyInArrow(count, "a long, b long, n_docs long, best boolean")


def aligned_groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the groups of each text as `a1,a2|b1;a3|b2,b3`; null where the text has no tokens."""
    small_batches(docs.sparkSession)

    def run(batches):
        model = Alignment.of(path_a, path_b)
        for _, ids, texts in text_blocks(batches):
            groups = [g.decode() or None for g in _align_block(texts, model)[3]["groups"]]
            for k in range(0, len(ids), 512):
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 512], pa.int64()), pa.array(groups[k : k + 512], pa.string())], ["doc_id", "groups"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, groups string")
