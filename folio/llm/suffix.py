"""Exact substring dedup by a sparse, range-partitioned suffix array.

Every string of LENGTH bytes holds, at a place that only its own bytes decide, the k-gram with the least hash of
all its k-grams (its anchor).  It is enough to sort the suffixes that begin at anchors, a few in a hundred.

1. Blocks of documents list their anchors' hashes; buckets of the hash range tell each block which of them
   occur in more than one document.  The rest cannot be part of a repeated string.
2. The remaining anchors go, with the bytes around them that a string through them can reach, to ranges of
   their leading bytes, cut at sampled splitters.  Each range sorts its suffixes by multikey quicksort (one
   8-byte key at a time, going on only within equal stretches).  Equal leading bytes are never split, so
   no equal suffixes lie across a boundary between ranges.
3. Within each stretch of equal k-grams, the strings through the anchor are told apart by the bytes to the left and
   right, each gets its least doc_id, and every occurrence in a greater one is answered to its block.

A block answers for its own repeats first: of equal surroundings only those in its least doc_id go
out, so a passage in a third of all documents is one entry per block.  No document text is shuffled; blocks
are kept as a table bucketed by block.

Defined results: null text is empty; a null doc_id counts as greater than all others; rows with equal doc_id don't
remove each other's bytes; texts shorter than LENGTH keep all; an empty table gives no rows; other columns
are ignored by `scan` and kept by `remove_repeats`, whose texts drop the characters that lost a byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX1, MIX2, bucketed, doc_chunks, forget, mix, partitions, small_batches, text_bytes

LENGTH = 50
#: Bytes of an anchor's k-gram, and how far a string through it can reach to either side.
K = 24
REACH = LENGTH - K
BLOCK_BYTES = 4 << 20
_LAST = np.iinfo(np.int64).max
_SAMPLED = 64


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every `width` neighbours, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = f(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all LENGTH-byte strings within documents, in text order."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in doc_chunks(offs, 1 << 18):
        d, o = np.ascontiguousarray(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        n = len(d)
        if n < LENGTH:
            continue
        u = np.ndarray((n - 7,), "<u8", d, strides=(1,))
        m = n - K + 1
        with np.errstate(over="ignore"):
            h = mix(u[:m] * MIX1 + (u[8 : 8 + m] ^ np.uint64(0x5851F42D4C957F2D)) * MIX2 + u[16 : 16 + m] * np.uint64(0xD6E8FEB86659FD93))
        np.maximum(h, 1, out=h)
        least = _slide(h, REACH + 1, np.minimum)  # of the string that begins here
        ends = (o[1:, None] - np.arange(1, LENGTH)).ravel()  # strings that begin here would leave their document
        begins = np.repeat(o[:-1], LENGTH - 1)
        ends = ends[(ends >= begins) & (ends < len(least))]
        least[ends] = 0
        padded = np.zeros(len(least) + 2 * REACH, np.uint64)
        padded[REACH : REACH + len(least)] = least
        at = np.flatnonzero(_slide(padded, REACH + 1, np.maximum) == h)
        places.append(at + offs[i])
        hashes.append(h[at])
    return np.concatenate(places), np.concatenate(hashes)


def multikey_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of rows of uint64 keys: (order, group of each sorted row), groups being equal rows."""
    n, width = keys.shape
    order = np.argsort(keys[:, 0], kind="stable")
    group = np.zeros(n, np.int64)
    if n == 0:
        return order, group
    new = np.ones(n, bool)
    for w in range(width):
        if w:
            open_ = np.flatnonzero(~new | np.append(~new[1:], False))  # rows in stretches still longer than one
            if not len(open_):
                break
            part = order[open_]
            order[open_] = part[np.lexsort((keys[part, w], group[open_]))]
        k = keys[order, w]
        new[1:] = new[1:] & (w > 0) | (k[1:] != k[:-1])
        group = np.cumsum(new) - 1
    return order, group


def _pack_block(ids: list, texts: pa.Array) -> bytes:
    data, offs = text_bytes(texts)
    none = np.array([i is None for i in ids], np.uint8)
    return b"".join([np.int64(len(ids)).tobytes(), np.array([_LAST if i is None else i for i in ids], np.int64).tobytes(), offs.tobytes(), none.tobytes(), data.tobytes()])


def _unpack_block(raw) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, offs, none = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n), np.frombuffer(raw, np.uint8, n, 16 + 16 * n)
    return ids, offs, none, np.frombuffer(raw, np.uint8, -1, 16 + 17 * n)


def _entries(ids: np.ndarray, offs: np.ndarray, data: np.ndarray, buckets: int):
    """Anchors of a block, and their distinct hashes in order of bucket: (places, docs, hash index, hashes, several, bucket)."""
    places, h = anchors(data, offs)
    doc = np.searchsorted(offs, places, "right") - 1
    hashes, index = np.unique(h, return_inverse=True)
    least, most = np.full(len(hashes), _LAST, np.int64), np.full(len(hashes), np.iinfo(np.int64).min, np.int64)
    np.minimum.at(least, index, ids[doc])
    np.maximum.at(most, index, ids[doc])
    bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending with the hash
    return places, doc, index, hashes, most > least, bucket


def _blocks(docs: DataFrame, buckets: int, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """Rows by block: -1 its texts, -2 sampled leading bytes, -3 the carried columns, others anchor hashes by bucket."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        forget()
        part, seq = TaskContext.get().partitionId(), 0

        def emit(block, ids, texts, rest):
            raw = _pack_block(ids, pa.concat_arrays(texts))
            own, offs, _, data = _unpack_block(raw)
            places, _, _, hashes, several, bucket = _entries(own, offs, data, buckets)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = [(-1, raw)]
            if carried:
                sink = pa.BufferOutputStream()
                table = pa.Table.from_batches(rest).combine_chunks()
                with pa.ipc.new_stream(sink, table.schema) as w:
                    w.write_table(table)
                rows.append((-3, sink.getvalue().to_pybytes()))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if hi > lo:
                    rows.append((b, hashes[lo:hi].astype(np.uint32).tobytes() + np.packbits(several[lo:hi]).tobytes() + np.uint32(hi - lo).tobytes()))
            some = places[:: max(1, len(places) // _SAMPLED)]
            lead = np.ndarray((max(0, len(data) - 7),), ">u8", np.ascontiguousarray(data), strides=(1,))[some] if len(some) else np.zeros(0, ">u8")
            rows.append((-2, (lead.astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "payload"])

        ids: list = []
        texts: list = []
        rest: list = []
        size = 0
        for b in batches:
            col = b.column("text").cast(pa.large_string())
            own = b.column("doc_id").to_pylist()
            more = b.select([f"c{k}" for k in range(len(carried))])
            offs = text_bytes(col)[1]
            lo = 0
            for k in range(len(own)):
                if size + offs[k + 1] - offs[lo] > BLOCK_BYTES and (ids or k > lo):
                    ids += own[lo:k]
                    texts.append(col.slice(lo, k - lo))
                    rest.append(more.slice(lo, k - lo))
                    yield emit((part << 32) + seq, ids, texts, rest)
                    seq, ids, texts, rest, size, lo = seq + 1, [], [], [], 0, k
            ids += own[lo:]
            texts.append(col.slice(lo))
            rest.append(more.slice(lo))
            size += int(offs[-1] - offs[lo])
        if ids:
            yield emit((part << 32) + seq, ids, texts, rest)

    x = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carried)])
    return x.mapInArrow(run, "block long, bucket int, payload binary")


def _shared(table: pa.Table) -> pa.Table:
    """For one bucket of hashes: to each block, a bit for each of its hashes, set if more than one document has it."""
    blocks, values, several = table.column("block").to_pylist(), [], []
    for raw in table.column("payload").to_pylist():
        n = int(np.frombuffer(raw[-4:], np.uint32)[0])
        values.append(np.frombuffer(raw, np.uint32, n))
        several.append(np.unpackbits(np.frombuffer(raw[4 * n : -4], np.uint8), count=n).astype(bool))
    every, more = np.concatenate(values), np.concatenate(several)
    order = np.argsort(every, kind="stable")
    s = every[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:].copy()
    hit = more.copy()
    hit[order] |= same
    out, at = [], 0
    for v in values:
        out.append(np.packbits(hit[at : at + len(v)]).tobytes())
        at += len(v)
    return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array(table.column("bucket").to_pylist(), pa.int32()), "payload": pa.array(out, pa.binary())})


_ENTRY = np.dtype([("around", "u1", K + 2 * REACH), ("left", "u1"), ("right", "u1"), ("doc", "<i8"), ("local", "<u4"), ("place", "<u4")])


def _reachable(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes left of the anchor in a string through it that stays in its document."""
    return np.maximum(0, REACH - right.astype(np.int64)), np.minimum(REACH, left.astype(np.int64))


def _candidates(left: pa.Table, right: pa.Table, buckets: int, splits: np.ndarray) -> pa.Table:
    """Of one block: its repeats among itself (range -1), and by range the entries that others may repeat."""
    out: list[tuple[int, int, bytes]] = []
    if left.num_rows:
        block = left.column("block")[0].as_py()
        ids, offs, _, data = _unpack_block(left.column("payload")[0].as_py())
        places, doc, index, hashes, _, bucket = _entries(ids, offs, data, buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        hit = np.zeros(len(hashes), bool)
        for b, raw in zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True):
            lo, hi = cuts[b], cuts[b + 1]
            hit[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=hi - lo).astype(bool)
        keep = hit[index]
        places, doc = places[keep], doc[keep]
        if len(places):
            e = np.zeros(len(places), _ENTRY)
            start = offs[doc]
            e["left"], e["right"] = np.minimum(REACH, places - start), np.minimum(REACH, offs[doc + 1] - places - K)
            e["doc"], e["local"], e["place"] = ids[doc], doc, places - start
            padded = np.concatenate([np.zeros(REACH, np.uint8), data, np.zeros(REACH + K, np.uint8)])
            for k in range(0, len(places), 1 << 14):
                p = places[k : k + (1 << 14), None] + np.arange(K + 2 * REACH)
                a = padded[p]
                x = e[k : k + (1 << 14)]
                cols = np.arange(K + 2 * REACH)
                a[(cols < REACH - x["left"].astype(np.int64)[:, None]) | (cols >= REACH + K + x["right"].astype(np.int64)[:, None])] = 0
                x["around"] = a
            # equal surroundings: all but those in the least document are repeats for certain
            width = -(-(K + 2 * REACH + 2) // 8) * 8
            raw = np.zeros((len(e), width), np.uint8)
            raw[:, : K + 2 * REACH] = e["around"]
            raw[:, -2], raw[:, -1] = e["left"], e["right"]
            order, group = multikey_order(raw.view(">u8").astype(np.uint64))
            least = np.full(group[-1] + 1, _LAST, np.int64)
            np.minimum.at(least, group, e["doc"][order])
            repeat = np.zeros(len(e), bool)
            repeat[order] = e["doc"][order] > least[group]
            r = e[repeat]
            if len(r):
                low, high = _reachable(r["left"], r["right"])
                place = r["place"].astype(np.int64)
                out.append((block, -1 - int(block % 1009), _pack_spans(r["local"], place - high, place - low + LENGTH)))
            e = e[~repeat]
            lead = np.ascontiguousarray(e["around"][:, REACH : REACH + 8]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
            rng = np.searchsorted(splits, lead.view(np.int64), "right")
            order = np.argsort(rng, kind="stable")
            cuts = np.searchsorted(rng[order], np.arange(len(splits) + 2))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                out.append((block, b, e[order[cuts[b] : cuts[b + 1]]].tobytes()))
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "range": pa.array([o[1] for o in out], pa.int32()), "payload": pa.array([o[2] for o in out], pa.binary())})


def _pack_spans(local: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans by document, overlapping ones merged."""
    order = np.lexsort((start, local))
    local, start, end = local[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    base = local * (1 << 40)
    reach = np.maximum.accumulate(base + end)
    new = np.ones(len(local), bool)
    new[1:] = (base + start)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(local)) - 1
    return np.concatenate([local[first], start[first], reach[last] - base[last]]).astype("<i8").tobytes()


def _refine(cls: np.ndarray, byte: np.ndarray) -> np.ndarray:
    return np.unique(cls * 256 + byte, return_inverse=True)[1]


#: Suffixes that are compared in their surroundings at once.
_STRETCH = 1 << 15


def _reached(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest bytes left of the anchor over the strings through it that a smaller doc_id has too; last is -1 if none."""
    n, around = len(x), x["around"]
    low, high = _reachable(x["left"], x["right"])
    lefts, rights = [group], [group]
    for j in range(REACH):
        lefts.append(_refine(lefts[-1], around[:, REACH - 1 - j].astype(np.int64)))
        rights.append(_refine(rights[-1], around[:, REACH + K + j].astype(np.int64)))
    first, last = np.full(n, LENGTH, np.int64), np.full(n, -1, np.int64)
    for j in range(REACH + 1):
        ok = np.flatnonzero((low <= j) & (j <= high))
        if len(ok):
            cls = np.unique(lefts[j][ok] * (n + 1) + rights[REACH - j][ok], return_inverse=True)[1]
            least = np.full(cls.max() + 1, _LAST, np.int64)
            np.minimum.at(least, cls, x["doc"][ok])
            hit = ok[least[cls] < x["doc"][ok]]
            first[hit] = np.minimum(first[hit], j)
            last[hit] = j
    return first, last


def _repeats(table: pa.Table) -> pa.Table:
    """Of one range: to each block, the spans of its entries that a smaller doc_id repeats."""
    blocks, payloads = table.column("block").to_pylist(), table.column("payload").to_pylist()
    out: list[tuple[int, bytes]] = []
    if table.column("range")[0].as_py() < 0:
        out = list(zip(blocks, payloads, strict=True))
    else:
        parts = [np.frombuffer(p, _ENTRY) for p in payloads]
        source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        e = np.concatenate(parts)
        keys = np.ascontiguousarray(e["around"][:, REACH : REACH + K]).view(">u8").astype(np.uint64)
        order, group = multikey_order(keys)
        size = np.bincount(group)
        docs = e["doc"][order]
        low_doc, high_doc = np.full(len(size), _LAST, np.int64), np.full(len(size), np.iinfo(np.int64).min, np.int64)
        np.minimum.at(low_doc, group, docs)
        np.maximum.at(high_doc, group, docs)
        keep = (high_doc > low_doc)[group]
        order, group = order[keep], group[keep]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(order) else np.zeros(0, np.int64)
        at = 0
        while at < len(order):  # whole stretches of equal k-grams, some ten thousand suffixes at a time
            end = int(starts[np.searchsorted(starts, at + _STRETCH)]) if at + _STRETCH <= starts[-1] else len(order)
            part = order[at:end]
            first, last = _reached(e[part], group[at:end] - group[at])
            hit = np.flatnonzero(last >= 0)
            x, src, place = e[part[hit]], source[part[hit]], e["place"][part[hit]].astype(np.int64)
            by = np.argsort(src, kind="stable")
            for h in np.split(by, np.flatnonzero(np.diff(src[by])) + 1) if len(by) else []:
                out.append((blocks[src[h[0]]], _pack_spans(x["local"][h], place[h] - last[hit[h]], place[h] - first[hit[h]] + LENGTH)))
            at = end
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "payload": pa.array([o[1] for o in out], pa.binary())})


def spans_of_block(packed: bytes, right: pa.Table):
    """Yields (doc_id or None, bytes, starts, ends) of each document of a block, spans merged."""
    ids, offs, none, data = _unpack_block(packed)
    raw = [np.frombuffer(p, "<i8").reshape(3, -1) for p in right.column("payload").to_pylist()]
    local, start, end = np.concatenate(raw, axis=1) if raw else np.zeros((3, 0), np.int64)
    if len(local):
        local, start, end = np.frombuffer(_pack_spans(local, start, end), "<i8").reshape(3, -1)
    cuts = np.searchsorted(local, np.arange(len(ids) + 1))
    for k in range(len(ids)):
        s = slice(cuts[k], cuts[k + 1])
        yield None if none[k] else int(ids[k]), data[offs[k] : offs[k + 1]], start[s], end[s]


def kept_bytes(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    if not len(start):
        return text.tobytes()
    edges = np.concatenate([[0], np.column_stack([start, end]).ravel(), [len(text)]])
    return b"".join(text[a:b].tobytes() for a, b in edges.reshape(-1, 2).tolist())


def find_repeats(docs: DataFrame, per_block, schema, carried: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """per_block(documents of spans_of_block, carried columns or None) of every block, as rows of schema."""
    spark = docs.sparkSession
    n = max(1, partitions(spark))
    kept = bucketed(_blocks(docs, n, id_col, text_col, carried), "suffix", n, "block")

    def leads(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.frombuffer(p, np.int64) for p in b.column("payload").to_pylist()] or [np.zeros(0, np.int64)]))], ["lead"])

    cuts = kept.where("bucket = -2").select("payload").mapInArrow(leads, "lead long").agg(F.percentile_approx("lead", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("p")).first()["p"] or []
    splits = np.array(sorted(set(cuts)), np.int64)
    texts = kept.where("bucket = -1").select("block", "payload")
    bits = kept.where("bucket >= 0").groupBy("bucket").applyInArrow(_shared, "block long, bucket int, payload binary")

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        return _candidates(left, right, n, splits)

    entries = texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(candidates, "block long, range int, payload binary")
    spans = entries.groupBy("range").applyInArrow(_repeats, "block long, payload binary")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = dict(zip(left.column("bucket").to_pylist(), left.column("payload"), strict=True))
        if -1 not in kinds:
            return per_block(iter(()), None)
        rest = pa.ipc.open_stream(kinds[-3].as_buffer()).read_all() if -3 in kinds else None
        return per_block(spans_of_block(kinds[-1].as_py(), right), rest)

    left = kept.where("bucket in (-1, -3)").select("block", "bucket", "payload")
    return left.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(finish, schema)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def rows(documents, _) -> pa.Table:
        out = [(doc, len(text), int((end - start).sum()), len(start), hashlib.sha256(kept_bytes(text, start, end)).hexdigest()) for doc, text, start, end in documents]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return find_repeats(docs, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", [], id_col, text_col)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with repeated bytes removed from the texts, and chars_col, if there, the new lengths.  Null texts become empty."""
    names = docs.columns
    carried = [c for c in names if c not in (text_col, chars_col)]

    def rows(documents, rest) -> pa.Table:
        texts = [kept_bytes(text, start, end).decode("utf-8", "ignore") for _, text, start, end in documents]
        new = {text_col: pa.array(texts, pa.string()), chars_col: pa.array([len(t) for t in texts], pa.int64())}
        old = {c: rest.column(k) if rest is not None else pa.array([], pa.null()) for k, c in enumerate(carried)}
        return pa.table([(new if c in new else old)[c] for c in names], names=names)

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kinds = {text_col: StringType(), chars_col: LongType()}
    schema = StructType([StructField(f.name, kinds.get(f.name, f.dataType)) for f in docs.schema.fields])
    return find_repeats(docs, rows, schema, carried, id_col, text_col)
