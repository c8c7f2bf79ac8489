"""Document fingerprints by Order MinHash, with DataFrame functions only.

The k-mers of a document (k words; fewer words make one k-mer of all) are numbered by occurrence, so that
a repeated k-mer is a different item each time.  One hash of (k-mer, occurrence) orders the items and
deals them to `slots` bins by its top bits; each bin keeps its `tuple_size` least items, puts them back in
text order and hashes that tuple.  Moving a passage keeps the items and changes the tuples, which a plain
MinHash would not see.

Defined results: null text is empty; an empty text has no filled slot (its fingerprint is all zeros);
likeness is equal filled slots over slots filled in either, and 1.0 if neither has any.  Rows are ordered
by doc_id descending, null ids last, ties by text; the row after the last is the first, so a single row
is its own next.  Repeated rows are rows of their own.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, partitions, range_of


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _occurrences(hashes: Column) -> Column:
    """array<struct<h, pos, occ>>: occ counts the earlier items with the same h.

    If all differ, occ is 0 throughout.  Else items are sorted by (h, pos) and the run lengths are found by
    pointer doubling: after j passes, c holds how many of the 2**j predecessors in the sorted order are equal.
    """
    plain = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("pos"), F.lit(0).alias("occ")))

    def doubled(j):
        """c after j passes to the end; the passes stop as soon as no run is that long."""
        step = 1 << j
        grow = lambda v: F.transform(v, lambda x, i: F.when(x == step, x + F.get(v, i - step)).otherwise(x))
        return lambda v: v if j == 30 else F.when(F.array_max(v) < step, v).otherwise(_let(grow(v), doubled(j + 1)))

    def numbered(rows):
        c = F.transform(rows, lambda x, i: F.when((i > 0) & (F.get(rows, i - 1)["h"] == x["h"]), 1).otherwise(0))
        c = _let(c, doubled(0))
        return F.zip_with(rows, c, lambda r, n: F.struct(r["h"].alias("h"), r["pos"].alias("pos"), n.alias("occ")))

    slow = _let(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("pos")))), numbered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), plain).otherwise(slow)


def order_minhash(text: Column, k: int = 5, slots: int = 32, tuple_size: int = 2) -> Column:
    """array<long> of `slots` 32-bit values; 0 stands for a slot without items."""
    bits = int(math.log2(slots))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def kmers(w):
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    def chosen(items):
        """The tuple_size least items of every bin.  Only items under a limit that leaves each bin about 6 times that many are sorted; if some bin then lacks items, all are."""
        low = F.lit((1 << (64 - bits)) - 1)
        limit = F.lit(float(1 << (64 - bits)) * slots * tuple_size * 6) / F.greatest(F.size(items), F.lit(1))
        keyed = F.transform(items, lambda x: F.struct(F.xxhash64(x["h"], x["occ"]).alias("g"), x["pos"].alias("pos")))
        bin_of = lambda g: F.shiftrightunsigned(g, 64 - bits)
        first = lambda s: F.filter(s, lambda x, i: (i < tuple_size) | (bin_of(F.get(s, i - tuple_size)["g"]) != bin_of(x["g"])))
        some = lambda v: _let(F.sort_array(F.filter(v, lambda x: x["g"].bitwiseAND(low).cast("double") < limit)), first)
        full = lambda v: _let(F.sort_array(v), first)
        return _let(keyed, lambda v: F.when(F.size(v) <= slots * tuple_size * 6, full(v)).otherwise(_let(some(v), lambda s: F.when(F.size(s) == slots * tuple_size, s).otherwise(full(v)))))

    def signature(sel):
        def tupled(part):
            in_order = F.array_sort(part, lambda a, b: a["pos"] - b["pos"])
            h = F.xxhash64(F.transform(in_order, lambda x: x["g"])).bitwiseAND(F.lit(0xFFFFFFFF))
            return F.when(F.size(part) == 0, F.lit(0)).otherwise(F.greatest(h, F.lit(1)))

        every = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda b: tupled(F.slice(sel, b * tuple_size + 1, tuple_size)))
        by_bin = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda b: tupled(F.filter(sel, lambda x: F.shiftrightunsigned(x["g"], 64 - bits) == (b + slots // 2) % slots)))  # as signed numbers sort
        return F.when(F.size(sel) == slots * tuple_size, every).otherwise(by_bin)

    return _let(_let(_let(_let(hashes, kmers), _occurrences), chosen), signature)


def likeness(a: Column, b: Column) -> Column:
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != 0)), lambda x: x))
    filled = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != 0) | (y != 0)), lambda x: x))
    return F.when(filled == 0, F.lit(1.0)).otherwise(same.cast("double") / filled)


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(doc_id, text, sig) per row."""
    return id_text(docs, id_col, text_col).withColumn("sig", order_minhash(F.col("text"), **params))


def with_next(rows: DataFrame, key: str, carried: list[str], computed: dict[str, Column]) -> DataFrame:
    """rows plus `computed` plus next_<c> for each carried or computed column: those of the row after it by `key` descending (cyclic).

    Rows are dealt to ranges of the key, each range is ordered on its own, and each range gets one more row,
    the first of the range after it, so that no task sees more than its range and a row.
    """
    spark = rows.sparkSession
    n = partitions(spark) * 2
    ranges = rows.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000).alias("p")).first()["p"] or []
    splits = sorted(set(ranges))
    null_first = F.lit(-1)  # null keys form the lowest range
    bucket = F.when(F.col(key).isNull(), null_first).otherwise(range_of(F.col(key), splits))
    x = rows.withColumn("__b", bucket)
    order = [F.col(key).desc_nulls_last(), F.col(carried[0]).asc(), *[F.col(c).asc() for c in carried[1:]]]
    tops = x.groupBy("__b").agg(F.max(key).alias("__k"))
    first = x.join(F.broadcast(tops.withColumnRenamed("__b", "__tb")), (F.col("__b") == F.col("__tb")) & F.col(key).eqNullSafe(F.col("__k"))).groupBy("__b").agg(F.min(F.struct(*carried)).alias("__f"))
    wide = W.orderBy(F.col("__b").desc())
    wrapped = first.withColumn("__p", F.coalesce(F.lag("__b").over(wide), F.min("__b").over(W.partitionBy())))
    guards = wrapped.select(F.col("__p").alias("__b"), F.lit(1).alias("__last"), F.lit(None).cast(rows.schema[key].dataType).alias(key), *[F.col(f"__f.{c}").alias(c) for c in carried])
    out = [*carried, *computed]
    w = W.partitionBy("__b").orderBy(F.col("__last"), *order)
    both = x.select("__b", F.lit(0).alias("__last"), key, *carried).unionByName(guards)
    both = both.withColumns(computed)
    led = both.select("__last", key, *out, *[F.lead(c).over(w).alias(f"next_{c}") for c in out])
    return led.where(F.col("__last") == 0).drop("__last")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The fingerprints of each text, its edited text and the likeness of both and of the next document."""
    x = with_next(id_text(docs, id_col, text_col), "doc_id", ["text"], {"sig": order_minhash(F.col("text"), **params)})
    third = F.floor(F.char_length("text") / F.lit(3)).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - third), F.substring(F.col("next_text"), F.lit(1), third))
    x = x.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "sig", F.col("next_sig"), edited.alias("edited"))
    x = x.withColumn("edited_sig", order_minhash(F.col("edited"), **params))
    return x.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_string(F.col("sig")).alias("fingerprint"), as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
