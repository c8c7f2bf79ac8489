"""N-gram Jaccard join by partitions of the token universe and the pigeonhole principle.

Sets are grouped into bands of sizes, each a little over 1/t times as wide as it is long, so that similar sets are in
one band or in neighbouring ones.  For a band, H is the greatest symmetric difference that a similar pair with its
smaller set in the band can have.  Tokens are hashed to m = H + 1 + slack segments: of a similar pair at
least slack + 1 segments hold equal subsets.  A set is indexed by the hashes of its non-empty segment subsets, in its own
band's scheme and in that of the band below.

Allocation by cost: an empty segment would be shared with nearly everyone, so it gets no signature.  That is safe
as long as a set has at most `slack` empty segments.  A set with more makes up for them with the one-deletion
neighbourhoods of its segments (a neighbourhood covers two differences at the cost of the segment's size), and
where even these are too few, by signatures for its empty segments.

Documents with equal sets are a class, and the first of them stands for it.  Signatures of these go to buckets as packed
arrays, one row per block of documents and bucket, with the place of the document in its block and nothing else, so that
what a signature costs does not follow the number of buckets.  A bucket returns the distinct lists of classes that share
signatures, and how many each list shares; sizes and needed signatures are joined to classes, not sent with signatures.
A similar pair shares more than one signature: at least m minus its greatest symmetric difference minus a set's empty
segments.  So a class with fewer shared signatures than it needs leaves all lists, whatever they are (a common
passage alone is never enough), and lists are thinned until none leaves.  Pairs are verified exactly on the sets:
first each class against one pivot of its lists, in two rounds.  For lists that the links found so far do not join
the universe is partitioned to its single tokens: a class stays only if three quarters of its tokens (the
threshold) are in other components too, which a common passage cannot make up, and candidates share one of the
least frequent tokens, of which each set shows only as many as the threshold lets differ.  Classes that such tokens
connect are compared part by part (GROUP sets with GROUP sets, by a matrix product), and only links that join
components come out; pairs are never rows.

Defined results: null text and text without words have the empty set, size 0, no links and their own doc_id as
component; repeated rows give a row each; a null doc_id links like any other but is never a component id unless
its whole component has null ids; an empty table gives no rows; other columns are ignored.  Tokens and
classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _powers, bucketed, doc_chunks, even_labels, forget, id_text, materialize, mix, partitions, ragged, shingles, small_batches, text_bytes, words_of
from .suffix import _pack_block, _unpack_block

BLOCK_BYTES = 4 << 20
#: Others verified against one pivot in one task group.
GROUP = 256
SLACK = 0.12


class Bands:
    """Size bands and their schemes for similarity >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low, self.high, self.diff, self.segments = [], [], [], []

    def grow(self, size: int) -> None:
        while not self.high or self.high[-1] < size:
            lo = self.high[-1] + 1 if self.high else 1
            hi = max(lo, lo * self.den // self.num)
            h = ((self.den - self.num) * (hi + self.most(hi))) // (self.den + self.num)
            self.low.append(lo)
            self.high.append(hi)
            self.diff.append(h)
            self.segments.append(h + 1 + (int(np.ceil(SLACK * hi)) + 1 if hi > 2 else 0))

    def most(self, size: int) -> int:
        """Size of the largest set that can be similar to one of this size."""
        return size * self.den // self.num

    def schemes(self, size: int) -> list[int]:
        self.grow(size)
        own = int(np.searchsorted(np.array(self.high), size))
        return [own, own - 1] if own and size <= self.most(self.high[own - 1]) else [own]

    def needed(self, size: int, scheme: int, empty: int) -> int:
        """Fewest signatures that a set with so many empty segments shares in a scheme with any set similar to it there."""
        other = self.most(size) if size <= self.high[scheme] else self.high[scheme]
        h = ((self.den - self.num) * (size + other)) // (self.den + self.num)
        return max(1, self.segments[scheme] - h - empty)


def sets_of(data: np.ndarray, offs: np.ndarray, k: int):
    """Yields the sorted distinct shingle hashes of each document."""
    mul = _powers(0xD6E8FEB86659FD93, k + 1)
    for i, j in doc_chunks(offs):
        h, _, _, cut = words_of(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        with np.errstate(over="ignore"):
            m = max(0, len(h) - k + 1)
            every = np.full(m, k, np.uint64)
            for x in range(k if m else 0):
                every += h[x : x + m] * mul[x + 1]
            every = mix(every)
        for d in range(j - i):
            a, b = cut[d], cut[d + 1]
            yield np.unique(every[a : b - k + 1]) if b - a >= k else shingles(h[a:b], k)


def class_of(s: np.ndarray) -> int:
    """64-bit digest of a set."""
    with np.errstate(over="ignore"):
        x = mix(np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64))
        return int(mix(x[:1] * np.uint64(3) + x[1:])[0].view(np.int64))


def _segments(s: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The segments of a set's tokens, and where each that holds some begins."""
    seg = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # sorted, as s is
    return seg, np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))


def needs(s: np.ndarray, bands: Bands) -> list[int]:
    """How many signatures a set needs in its own scheme and, if it is in one, the scheme below."""
    return [bands.needed(len(s), b, bands.segments[b] - len(_segments(s, bands.segments[b])[1])) for b in bands.schemes(len(s))]


def signatures(s: np.ndarray, bands: Bands) -> list[tuple[np.ndarray, int]]:
    """Of a set, for its own scheme and, if it is in one, the scheme below: (distinct signatures, how many of them it needs)."""
    every = []
    with np.errstate(over="ignore"):
        for b in bands.schemes(len(s)):
            m, out = bands.segments[b], []
            seg, first = _segments(s, m)
            salted = s * np.uint64(0x9E6C63D0876A9A47)
            sums, at = np.add.reduceat(salted, first), seg[first]
            tag = (np.uint64(b + 1) << np.uint64(40)) + at.astype(np.uint64)
            out.append(mix(sums + tag * np.uint64(0xC2B2AE3D27D4EB4F)))
            lacking = (m - len(first)) - (m - bands.diff[b] - 1)
            if lacking > 0:
                sizes = np.diff(np.append(first, len(s)))
                wide = np.repeat(sizes >= 2, sizes)
                of = np.repeat(np.arange(len(first)), sizes)[wide]
                out.append(mix(sums[of] - salted[wide] + tag[of] * np.uint64(0xC2B2AE3D27D4EB4F)))
                if lacking > int((sizes >= 2).sum()):
                    empty = np.setdiff1d(np.arange(m), at)
                    out.append(mix(((np.uint64(b + 1) << np.uint64(40)) + empty.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)))
            every.append((np.unique(np.concatenate(out)), bands.needed(len(s), b, m - len(first))))
    return every


def _blocks(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Rows by block: -1 its texts, -2 (doc_id null, doc_id, size, set, needed signatures) of its documents."""
    small_batches(docs.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        forget()
        part, seq, bands = TaskContext.get().partitionId(), 0, Bands(num, den)

        def emit(block, ids, texts):
            raw = _pack_block(ids, pa.concat_arrays(texts))
            own, offs, none, data = _unpack_block(raw)
            n, cls, need = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros((2, len(own)), np.int32)
            for d, s in enumerate(sets_of(data, offs, k)):
                n[d], cls[d] = len(s), class_of(s)
                for below, least in enumerate(needs(s, bands) if len(s) else ()):
                    need[below, d] = least
            rows = [(-1, raw), (-2, b"".join(x.tobytes() for x in (np.int64(len(own)), own, n, cls, need, none)))]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["block", "bucket", "payload"])

        ids: list = []
        texts: list = []
        size = 0
        for b in batches:
            col, own = b.column("text").cast(pa.large_string()), b.column("doc_id").to_pylist()
            offs, lo = text_bytes(col)[1], 0
            for x in range(len(own)):
                if size + offs[x + 1] - offs[lo] > BLOCK_BYTES and (ids or x > lo):
                    ids += own[lo:x]
                    texts.append(col.slice(lo, x - lo))
                    yield emit((part << 32) + seq, ids, texts)
                    seq, ids, texts, size, lo = seq + 1, [], [], 0, x
            ids += own[lo:]
            texts.append(col.slice(lo))
            size += int(offs[-1] - offs[lo])
        if ids:
            yield emit((part << 32) + seq, ids, texts)

    return id_text(docs, id_col, text_col).mapInArrow(run, "block long, bucket int, payload binary")


def _deal(token: np.ndarray, who: np.ndarray, labels: list[int], header=None):
    """(bucket, payload) rows of 64-bit values with their owners: header(owners) first, then 5 bytes and an owner's place each.

    Without a header, owners are given as they are.
    """
    bucket = ((token >> np.uint64(40)) * np.uint64(len(labels)) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(len(labels) + 1))
    for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        x = order[cuts[b] : cuts[b + 1]]
        owners, of = np.zeros(0, np.int64), who[x]
        if header:
            owners, of = np.unique(who[x] >> 1, return_inverse=True)
            of = 2 * of + (who[x] & 1)
        kind = np.dtype("<u2" if of.max() < 1 << 16 else "<u4")
        yield labels[b], b"".join([np.array([len(owners), kind.itemsize], np.int64).tobytes(), header(owners) if header else b"", token[x].astype("<u4").tobytes(), (token[x] >> np.uint64(32)).astype(np.uint8).tobytes(), of.astype(kind).tobytes()])


def _dealt(raw: bytes, header_bytes: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of owners, 40 bits of each value, places of the owners with their low bit)."""
    m, wide = np.frombuffer(raw, np.int64, 2).tolist()
    at = 16 + m * header_bytes
    n = (len(raw) - at) // (5 + wide)
    low, high = np.frombuffer(raw, "<u4", n, at), np.frombuffer(raw, np.uint8, n, at + 4 * n)
    return m, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32), np.frombuffer(raw, "<u2" if wide == 2 else "<u4", n, at + 5 * n)


def _signed(left: pa.Table, right: pa.Table, k: int, num: int, den: int, labels: list[int]) -> pa.Table:
    """Signatures of those sets of a block that stand for their class, dealt to buckets."""
    rows: list[tuple] = []
    if left.num_rows and right.num_rows:
        forget()
        bands = Bands(num, den)
        _, offs, _, data = _unpack_block(left.column("payload")[0].as_py())
        wanted = np.zeros(len(offs) - 1, bool)
        wanted[right.column("pos").to_numpy()] = True
        sigs, of = [], []
        for d, s in enumerate(sets_of(data, offs, k)):
            if wanted[d]:
                for below, (x, _) in enumerate(signatures(s, bands)):
                    sigs.append(x)
                    of.append(np.full(len(x), 2 * d + below, np.uint32))
        block = left.column("block")[0].as_py()
        rows = [(block, *x) for x in _deal(np.concatenate(sigs), np.concatenate(of), labels)]
    return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["block", "bucket", "payload"])


def _named(block: int, pos: np.ndarray) -> np.ndarray:
    """64-bit names of the documents of a block."""
    with np.errstate(over="ignore"):
        return mix(mix(np.array([block], np.int64).view(np.uint64)) + pos.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47)).view(np.int64)


def _documents(batches):
    """Unpack rows of kind -2."""
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("payload").to_pylist(), strict=True):
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            ids, n, cls = (np.frombuffer(raw, np.int64, m, 8 + 8 * m * x) for x in range(3))
            need, down = (np.frombuffer(raw, np.int32, m, 8 + 24 * m + 4 * m * x) for x in range(2))
            none = np.frombuffer(raw, np.uint8, m, 8 + 32 * m).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, block)), pa.array(np.arange(m)), pa.array(ids, mask=none), pa.array(n), pa.array(cls), pa.array(_named(block, np.arange(m))), pa.array(need), pa.array(down)], ["block", "pos", "doc_id", "n", "own", "cls", "need", "down"])


def _lists(table: pa.Table) -> pa.Table:
    """Of one bucket: the distinct lists of two or more classes that share signatures, with the number they share here."""
    sig, cls, below = [], [], []
    for block, raw in zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True):
        _, value, of = _dealt(raw, 0)
        sig.append(value)
        cls.append(_named(block, of >> 1))
        below.append((of & 1).astype(bool))
    sig, cls, below = map(np.concatenate, (sig, cls, below))
    order = np.argsort(sig, kind="stable")
    s = sig[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:].copy()
    order = order[same]
    order = order[np.lexsort((cls[order], sig[order]))]
    new = np.ones(len(order), bool)
    new[1:] = (sig[order][1:] != sig[order][:-1]) | (cls[order][1:] != cls[order][:-1])
    order = order[new]
    s, c, down = sig[order], cls[order], below[order]
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(s)))
    with np.errstate(over="ignore"):  # the same classes in another scheme are another list: which of them are below their own tells
        digest = np.add.reduceat(mix(c.view(np.uint64) * np.uint64(2) + down), first) if len(s) else np.zeros(0, np.uint64)
    keep = np.flatnonzero(count > 1)
    shared = np.zeros(0, np.int64)
    if len(keep):
        _, pick, shared = np.unique(np.column_stack([digest[keep], count[keep].astype(np.uint64)]), axis=0, return_index=True, return_counts=True)
        keep = keep[pick]
    lens = count[keep]
    at = ragged(first[keep], lens)
    offs = pa.array(np.append(0, np.cumsum(lens)).astype(np.int32))
    as_list = lambda v: pa.ListArray.from_arrays(offs, pa.array(v[at]))
    return pa.table({"digest": pa.array(digest[keep].view(np.int64)), "size": pa.array(lens.astype(np.int32)), "shared": pa.array(shared.astype(np.int64)), "cls": as_list(c), "below": as_list(down)})


def _elsewhere(table: pa.Table, labels: list[int]) -> pa.Table:
    """Of one bucket of tokens: how many of each class's tokens another component has too, packed by parts of the classes."""
    token, cls, comp = [], [], []
    for raw in table.column("payload").to_pylist():
        m, value, of = _dealt(raw, 16)
        token.append(value)
        cls.append(np.frombuffer(raw, np.int64, m, 16)[of >> 1])
        comp.append(np.frombuffer(raw, np.int64, m, 16 + 8 * m)[of >> 1])
    token, cls, comp = map(np.concatenate, (token, cls, comp))
    order = np.argsort(token, kind="stable")
    t, c = token[order], comp[order]
    first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
    mixed = np.repeat(np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first), np.diff(np.append(first, len(t))))
    who, n = np.unique(cls[order][mixed], return_counts=True)
    part = (mix(who.view(np.uint64)) % np.uint64(len(labels))).astype(np.int64)
    found = [(labels[p], np.concatenate([who[part == p], n[part == p]]).tobytes()) for p in np.unique(part).tolist()]
    return pa.table({"part": pa.array([p for p, _ in found], pa.int32()), "payload": pa.array([x for _, x in found], pa.binary())})


def _summed(table: pa.Table) -> pa.Table:
    """Of one part of the classes: the counts of all buckets together."""
    each = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("payload").to_pylist()]
    cls, index = np.unique(np.concatenate([x[0] for x in each]), return_inverse=True)
    there = np.zeros(len(cls), np.int64)
    np.add.at(there, index, np.concatenate([x[1] for x in each]))
    return pa.table({"cls": pa.array(cls), "there": pa.array(there)})


def _set_of(raw, k: int) -> np.ndarray:
    text = np.frombuffer(raw, np.uint8)
    return next(sets_of(text, np.array([0, len(text)], np.int64), k))


def _verifier(k: int, num: int, den: int):
    """Of one pivot and some others, as texts: those whose sets are similar to the pivot's."""

    def check(table: pa.Table) -> pa.Table:
        mine = table.column("pivot_row").to_pylist()
        raw = table.column("text")
        pivot = _set_of(raw[mine.index(True)].as_py(), k)
        a, out = table.column("a")[0].as_py(), []
        for at, (is_pivot, cls) in enumerate(zip(mine, table.column("cls").to_pylist(), strict=True)):
            if not is_pivot:
                x = _set_of(raw[at].as_py(), k)
                common = int((pivot[np.minimum(np.searchsorted(pivot, x), len(pivot) - 1)] == x).sum())
                if den * common >= num * (len(x) + len(pivot) - common):
                    out.append(cls)
        return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(out, pa.int64())})

    return check


def _joiner(k: int, num: int, den: int):
    """Links between two parts of a group of candidates, as few as join the same components."""

    def join(table: pa.Table) -> pa.Table:
        raw = [_set_of(x, k) for x in table.column("text").to_pylist()]
        cls, comp = np.asarray(table.column("cls").combine_chunks()), table.column("comp").to_pylist()
        first, second = (np.flatnonzero(np.asarray(table.column(c).combine_chunks())) for c in ("first", "second"))
        n = np.array([len(x) for x in raw], np.int64)
        token, index = np.unique(np.concatenate(raw), return_inverse=True)
        owner = np.repeat(np.arange(len(raw)), n)
        often = np.bincount(index) > 1  # others are in one set only
        place = np.cumsum(often) - 1
        keep = often[index]
        owner, index = owner[keep], place[index[keep]]
        order = np.argsort(index, kind="stable")
        owner, index = owner[order], index[order]
        common = np.zeros((len(first), len(second)), np.float32)
        for at in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(index, [at, at + 4096])
            m = np.zeros((len(raw), 4096), np.float32)
            m[owner[lo:hi], index[lo:hi] - at] = 1
            common += m[first] @ m[second].T  # whole numbers, exact up to 2**24
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        common = np.rint(common).astype(np.int64)
        a, b = np.nonzero(den * common >= num * (n[first][:, None] + n[second][None, :] - common))
        out = []
        for i, j in zip(first[a].tolist(), second[b].tolist(), strict=True):
            x, y = find(comp[i]), find(comp[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((cls[i], cls[j]))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return join


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cls, comp): the least class that each node reaches over undirected edges (a, b), by label propagation and pointer jumping."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(nodes.select("cls", F.col("cls").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("comp").alias("near"))
        told = labels.join(near, "cls", "left").select("cls", "comp", F.least("comp", F.coalesce("near", "comp")).alias("told"))
        jump = labels.select(F.col("cls").alias("told"), F.col("comp").alias("far"))
        now = materialize(told.join(jump, "told").select("cls", F.least("told", "far").alias("comp"), (F.least("told", "far") != F.col("comp")).alias("moved")), "labels")
        labels = now.select("cls", "comp")
        if not now.where("moved").limit(1).count():
            return labels


def _texts_at(block: pa.Table, places: list[int]):
    """The texts of some documents of a block, in the order asked."""
    _, offs, _, data = _unpack_block(block.column("payload")[0].as_py())
    for pos in places:
        yield data[offs[pos] : offs[pos + 1]].tobytes()


def _sets_at(block: pa.Table, places: list[int], k: int):
    """The sets of some documents of a block, in the order asked."""
    _, offs, _, data = _unpack_block(block.column("payload")[0].as_py())
    for pos in places:
        text = data[offs[pos] : offs[pos + 1]]
        yield next(sets_of(text, np.array([0, len(text)], np.int64), k))


def thin(member: DataFrame, facts: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Members of lists (digest, size, shared, cls, below) without the classes that share too little there, by facts (cls, need, down).

    With labels, only lists that hold another component than the class's own count.  Lists that are left with one
    class, or one component, go.
    """
    what = "cls"
    if labels is not None:
        member, what = member.join(labels, "cls"), "comp"
    key = ["digest", "size"]
    ends = member.groupBy(*key).agg(F.min(what).alias("__x"), F.max(what).alias("__y")).where("__x <> __y").select(*key)
    open_ = member.join(ends, key)
    enough = open_.groupBy("cls", "below").agg(F.sum("shared").alias("__s")).join(facts, "cls").where("__s >= if(below, down, need)").select("cls", "below")
    return materialize(open_.join(enough, ["cls", "below"]).select(*key, "shared", "cls", "below"), "thin")


def _stars(member: DataFrame, facts: DataFrame, close, tried: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b): for each class b one pivot a near it in size, the one that shares most with its lists' members.

    The original of a group of near copies shares more with them than they do with each other, so it comes first.
    With `tried`, members carry their component; pivots are of other components and were not tried before.
    """
    key = ["digest", "size"]
    weight = member.groupBy("cls").agg(F.sum(F.col("shared") * (F.col("size") - 1)).alias("w"))
    x = member.join(weight.join(facts.select("cls", "n"), "cls"), "cls")
    if tried is None:
        x = x.withColumn("comp", F.col("cls"))
    heads = x.groupBy(*key).agg(F.max(F.struct("w", "cls", "n", "comp")).alias("a"))
    pairs = x.join(heads, key).where((F.col("comp") != F.col("a.comp")) & close(F.col("n"), F.col("a.n"))).select(F.col("a.cls").alias("a"), F.col("cls").alias("b"), F.col("a.w").alias("w"))
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    return pairs.groupBy("b").agg(F.max(F.struct("w", "a")).alias("m")).select("m.a", "b")


def similar_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents link when den * |A n B| >= num * |A u B|."""
    spark = docs.sparkSession
    buckets = max(1, partitions(spark))
    even = even_labels(spark, buckets)
    kept = bucketed(_blocks(docs, k, num, den, id_col, text_col), "jaccard", buckets, "block")
    texts = kept.where("bucket = -1").select("block", "payload")
    rows = kept.where("bucket = -2").select("block", "payload").mapInArrow(_documents, "block long, pos long, doc_id long, n long, own long, cls long, need int, down int")
    heads = materialize(rows.where("n > 0").groupBy("own").agg(F.min(F.struct("block", "pos", "n", "cls", "need", "down")).alias("at"), F.min("doc_id").alias("least")).select("own", "least", "at.*"), "heads")
    facts = heads.select("cls", "n", "need", "down")

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        return _signed(left, right, k, num, den, even)

    signed = texts.groupBy("block").cogroup(heads.select("block", "pos").groupBy("block")).applyInArrow(sign, "block long, bucket int, payload binary")
    lists = signed.groupBy("bucket").applyInArrow(_lists, "digest long, size int, shared long, cls array<long>, below array<boolean>")
    lists = lists.groupBy("digest", "size").agg(F.sum("shared").alias("shared"), F.first(F.arrays_zip("cls", "below")).alias("m"))
    member = materialize(lists.select("digest", "size", "shared", F.explode("m").alias("m")).select("digest", "size", "shared", "m.cls", "m.below"), "member")
    for _ in range(2):
        member = thin(member, facts)
    places = materialize(heads.join(member.select("cls").distinct(), "cls").select("cls", "n", "block", "pos"), "places")
    nodes = places.select("cls")
    close = lambda x, y: F.least(x, y) * den >= F.greatest(x, y) * num

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            asked: dict[int, list] = {}
            for r in right.to_pylist():
                asked.setdefault(r["pos"], []).append(r)
            for wanted, text in zip(asked.values(), _texts_at(left, list(asked)), strict=True):
                out += [(r["a"], r["salt"], r["pivot_row"], r["cls"], text) for r in wanted]
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], names=["a", "salt", "pivot_row", "cls", "text"])

    def verify(pairs: DataFrame, what: str) -> DataFrame:
        """The pairs (a, b) that are similar; many partners of one pivot are dealt to several groups."""
        salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("salts"))
        others = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.col("b").alias("cls"))
        pivots = others.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("cls"), F.lit(True).alias("pivot_row"))
        asked = others.withColumn("pivot_row", F.lit(False)).unionByName(pivots).join(places, "cls")
        sent = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(send, "a long, salt int, pivot_row boolean, cls long, text binary")
        return materialize(sent.groupBy("a", "salt").applyInArrow(_verifier(k, num, den), "a long, b long"), what)

    # each class against one pivot, then those that are still apart against another
    tried = materialize(_stars(member, facts, close), "stars")
    links = verify(tried, "links")
    labels = components(links, nodes)
    left = thin(member, facts, labels)
    more = materialize(_stars(left.join(labels, "cls"), facts, close, tried), "stars")
    if more.limit(1).count():
        links, tried = links.unionByName(verify(more, "links")), tried.unionByName(more)
        labels = components(links, nodes)

    # what is not joined now: classes with enough tokens in other components, and of these the pairs that share a rare one
    rest = materialize(thin(left, facts, labels).select("cls").distinct().join(labels, "cls").join(places, "cls"), "rest")

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            asked = right.sort_by("cls")
            cls, comp = np.asarray(asked.column("cls").combine_chunks()), np.asarray(asked.column("comp").combine_chunks())
            sets = list(_sets_at(left, asked.column("pos").to_pylist(), k))
            who = np.repeat(2 * np.arange(len(sets), dtype=np.int64), [len(x) for x in sets])
            rows = list(_deal(np.concatenate(sets), who, even, lambda o: cls[o].tobytes() + comp[o].tobytes()))
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    def elsewhere(table: pa.Table) -> pa.Table:
        return _elsewhere(table, even)

    for _ in range(2):
        dealt = texts.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(deal, "bucket int, payload binary")
        there = dealt.groupBy("bucket").applyInArrow(elsewhere, "part int, payload binary")
        enough = there.groupBy("part").applyInArrow(_summed, "cls long, there long")
        rest = materialize(rest.join(enough, "cls").where(F.col("there") * den >= F.col("n") * num).drop("there"), "rest")

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, cls, comp, n = [np.zeros(0, np.uint64)], [], [], []
        if left.num_rows and right.num_rows:
            sets = list(_sets_at(left, right.column("pos").to_pylist(), k))
            cls, comp, n = (np.repeat(np.asarray(right.column(c).combine_chunks()), [len(x) for x in sets]) for c in ("cls", "comp", "n"))
        return pa.table({"token": pa.array(np.concatenate(sets).view(np.int64)), "cls": pa.array(cls, pa.int64()), "comp": pa.array(comp, pa.int64()), "n": pa.array(n, pa.int64())})

    tokens = materialize(texts.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(spread, "token long, cls long, comp long, n long"), "tokens")
    often = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y"))
    ranked = tokens.join(often, "token").withColumn("place", F.row_number().over(W.partitionBy("cls").orderBy("df", "token")))
    shown = materialize(ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1) & (F.col("x") != F.col("y"))).select("token", "cls", "comp", "n"), "shown")
    hubs = shown.join(shown.groupBy("token").agg(F.min("cls").alias("a")), "token").select("a", F.col("cls").alias("b")).where("a <> b").distinct()
    hubs = materialize(hubs, "hubs")
    if hubs.limit(1).count():
        group = components(hubs, shown.select("cls").distinct()).withColumnRenamed("comp", "grp")
        part = rest.join(group, "cls")
        size = part.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("parts"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp", "parts")
        part = part.join(size, "grp").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        part = part.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = part.select("block", "pos", "cls", "comp", "grp", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"), (F.col("part") <= F.col("with")).alias("first"), (F.col("part") >= F.col("with")).alias("second"))

        def lend(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                wanted: dict[int, list] = {}
                for r in right.to_pylist():
                    wanted.setdefault(r["pos"], []).append(r)
                for ask, raw in zip(wanted.values(), _texts_at(left, list(wanted)), strict=True):
                    out += [(r["grp"], r["lo"], r["hi"], r["first"], r["second"], r["cls"], r["comp"], raw) for r in ask]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["grp", "lo", "hi", "first", "second", "cls", "comp", "text"])

        lent = texts.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(lend, "grp long, lo int, hi int, first boolean, second boolean, cls long, comp long, text binary")
        late = materialize(lent.groupBy("grp", "lo", "hi").applyInArrow(_joiner(k, num, den), "a long, b long"), "links")
        labels = components(links.unionByName(late), nodes)

    classes = heads.select("own", "least", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    named = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = classes.select("own", "comp").join(named, "comp").select("own", "component_id")
    full = rows.where("n > 0").join(named, "own").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that with the least id; of rows with equal id and text one stays, and of rows with a null id
    one of each text."""
    found = similar_components(docs, k, num, den, id_col, text_col)
    key = f"keep_{uuid.uuid4().hex}"
    stay = found.where("doc_id = component_id").groupBy(F.col("doc_id").alias(key)).agg((F.count("*") > 1).alias(f"{key}_many"))
    own = F.col(id_col).cast("long")
    once = docs.join(stay.where(~F.col(f"{key}_many")).select(key), own == F.col(key), "left_semi")
    again = docs.join(stay.where(f"{key}_many").select(key), own == F.col(key), "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    return once.unionByName(again.dropDuplicates([id_col, text_col]))
