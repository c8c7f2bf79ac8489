"""Best matches by similarity (Ratcliff-Obershelp) without meeting every pair: an index of character grams and bounds, both exact.

A match of M characters out of T (both lengths together) falls into at most T - 2M + 1 blocks, since two blocks with nothing between
them would be one; so both strings share at least M - (q - 1)(T - 2M + 1) grams of q characters.  For a high least ratio that is a
positive share of a string's grams, and two strings that reach it share one of the rarest grams of each (as many as may be missing, and
one more): those go into an inverted index.  No ratio exceeds twice the smaller length, or twice the common characters by class, over T.

Best matches are looked for at falling levels: equal texts first, then at least 0.9, then the least ratio asked for, each level only for
what no higher level has found.  Longer grams tell more apart but need longer strings, so strings that are certain of none of four
characters are looked up by two.  Where that leaves nothing certain either, the bounds alone decide who is compared.

Keys with few pairs need no index: their pairs are met in cells of a grid.  The matcher's blocks are a common subsequence, so it is asked
only where the longest one (bit-parallel) can reach the ratio, and for best matches the best one that the string has so far.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from folio.sources.tables import stored

LEVEL = 0.9
CLASSES = 32
#: From this length on the matcher passes over frequent characters, and equal texts may be unlike.
PASSES_OVER = 200
#: Pairs of a key from which on the index comes first, and left and right strings of a cell.
MANY_PAIRS, CELL = 1_000_000, (64, 1024)


def _share(q: int, least: float) -> float:
    return (2 * q - 1) * least / 2 - (q - 1)


def shared_grams(n: Column, q: int, least: float) -> Column:
    """How many grams of q characters a string of length n shares at least with any string at the ratio, of any length."""
    return F.ceil(2.0 * n / (2.0 - least) * _share(q, least) - (q - 1) - 1e-6)


def class_counts(x: Column) -> Column:
    """Characters of x by class of their code, and those beyond ASCII; the sum of the smaller counts of two strings is at least what they
    have in common."""
    of = [F.length(x) - F.length(F.translate(x, "".join(chr(c) for c in range(k, 128, CLASSES)), "")) for k in range(CLASSES)]
    beyond = F.length(F.regexp_replace(x, r"[\x00-\x7F]+", ""))
    return F.array(*of, beyond)


def bound(n: Column, m: Column, a: Column, b: Column) -> Column:
    """No ratio of strings with these lengths and counts by class can exceed this."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return 2.0 * common / F.greatest(n + m, F.lit(1))


def _tokens(x: DataFrame, keys: list[str], name: str, q: int, least: float) -> DataFrame:
    """(keys, name, token, sure): distinct grams of each string, and how many of them it certainly shares with whatever reaches the ratio;
    both null, in one row, where that is none."""
    n = F.col("n")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring("s", i, F.lit(q))))
    y = x.withColumn("grams", F.when(n >= q, grams)).withColumn("sure", shared_grams(n, q, least) - ((n - q + 1) - F.size("grams")))
    return y.select(*keys, name, F.when(F.col("sure") >= 1, F.col("sure")).alias("sure"), F.explode_outer(F.when(F.col("sure") >= 1, F.col("grams"))).alias("token"))


def candidates(left: DataFrame, right: DataFrame, keys: list[str], least: float, sizes: tuple[int, ...] = (4, 2)) -> DataFrame:
    """(keys, h, o): every pair of equal keys whose ratio can reach `least`, and few others.  left: keys, h, s, n; right: keys, o, s, n."""
    sizes = tuple(q for q in sizes if _share(q, least) > 0.02)
    if not sizes:
        a, b = left.select(*keys, "h", F.col("n").alias("na")), right.select(*keys, "o", F.col("n").alias("nb"))
        return a.join(b, keys).where(2.0 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb")) - 1e-9).select(*keys, "h", "o")
    q, others = sizes[0], sizes[1:]
    a, b = _tokens(left, keys, "h", q, least), _tokens(right, keys, "o", q, least)
    often = b.where("token IS NOT NULL").groupBy("token").agg(F.count("*").alias("often"))

    def rarest(x: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy(*keys, name)
        ranked = x.where("token IS NOT NULL").join(often, "token", "left").withColumns({"place": F.row_number().over(w.orderBy(F.coalesce("often", F.lit(0)), "token")), "all": F.count("*").over(w)})
        return ranked.where(F.col("place") <= F.col("all") - F.col("sure") + 1).select(*keys, name, "token")

    out = rarest(a, "h").join(rarest(b, "o"), [*keys, "token"]).select(*keys, "h", "o")
    few_left, few_right = left.join(a.where("token IS NULL").select(*keys, "h"), [*keys, "h"]), right.join(b.where("token IS NULL").select(*keys, "o"), [*keys, "o"])
    return out.unionByName(candidates(few_left, right, keys, least, others)).unionByName(candidates(left, few_right, keys, least, others)).distinct()


def _common(masks: dict, n: int, b: str) -> int:
    """Length of the longest common subsequence of b and the string of n characters with these places by character."""
    v = full = (1 << n) - 1
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def _ratios(pairs: DataFrame, keys: list[str], least: float, best: bool) -> DataFrame:
    """(keys, h, o, ratio) of pairs (keys, h, o, a, b, bound) that reach the ratio; with `best`, pairs may be left out that are worse than another of
    their h.  Pairs of an h that follow one another are met from the highest bound down."""
    names = [*keys, "h", "o"]
    schema = StructType([*[pairs.schema[c] for c in names], *StructType().add("ratio", DoubleType()).fields])

    def run(batches):
        import difflib

        at, floor, masks, n = None, least, {}, 0
        for batch in batches:
            of = list(zip(*[batch.column(c).to_pylist() for c in (*keys, "h")], strict=True))
            a, b, bounds = batch.column("a"), batch.column("b"), batch.column("bound").to_numpy()
            runs = np.cumsum([k > 0 and of[k] != of[k - 1] for k in range(len(of))])
            rows, ratios, x = [], [], ""
            for k in np.lexsort((-bounds, runs)).tolist():
                if of[k] != at or not x:
                    floor = floor if of[k] == at else least
                    at, x = of[k], a[k].as_py()
                    masks, n = {}, len(x)
                    for i, c in enumerate(x):
                        masks[c] = masks.get(c, 0) | 1 << i
                if bounds[k] < floor - 1e-9:
                    continue
                y = b[k].as_py()
                if 2.0 * _common(masks, n, y) / (n + len(y)) < floor - 1e-9:
                    continue
                r = difflib.SequenceMatcher(None, x, y).ratio()
                if r >= floor:
                    floor = r if best else floor
                    rows.append(k)
                    ratios.append(r)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows, pa.int64())) for c in names], pa.array(ratios, pa.float64())], [*names, "ratio"])

    return pairs.select(*names, "a", "b", "bound").mapInArrow(run, schema)


def _bounded(pairs: DataFrame, keys: list[str], least: float) -> DataFrame:
    reach = (2.0 * F.least("na", "nb") >= least * (F.col("na") + F.col("nb")) - 1e-9) & (bound(F.col("na"), F.col("nb"), F.col("ca"), F.col("cb")) >= least - 1e-9)
    return pairs.where(reach).select(*keys, "h", "o", "a", "b", bound(F.col("na"), F.col("nb"), F.col("ca"), F.col("cb")).alias("bound"))


def _sizes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.groupBy(*keys).agg(F.count("*").alias("lefts")).join(right.groupBy(*keys).agg(F.count("*").alias("rights")), keys)


def _in_cells(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of equal keys with their strings, in cells of a grid, so that no task gets a large key whole; all pairs of an h in a cell follow one
    another."""
    sizes = _sizes(left, right, keys).select(*keys, *[F.expr(f"({name} + {most - 1}) div {most}").alias(n) for n, name, most in zip("xy", ("lefts", "rights"), CELL, strict=True)])
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = lambda name, n: F.pmod(F.xxhash64(name), F.col(n))
    a = left.join(sizes, keys).select(*keys, "h", F.col("s").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), mine("h", "x").alias("cx"), every("y").alias("cy"))
    b = right.join(sizes, keys).select(*keys, "o", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), every("x").alias("cx"), mine("o", "y").alias("cy"))
    return a.join(b, [*keys, "cx", "cy"])


def _scored(left: DataFrame, right: DataFrame, keys: list[str], least: float, best: bool = False, index: bool = True) -> DataFrame:
    if not index or not any(_share(q, least) > 0.02 for q in (4, 2)):
        return _ratios(_bounded(_in_cells(left, right, keys), keys, least), keys, least, best)
    x = candidates(left, right, keys, least).join(left.select(*keys, "h", F.col("s").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca")), [*keys, "h"]).join(right.select(*keys, "o", F.col("s").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb")), [*keys, "o"])
    return _ratios(_bounded(x, keys, least), keys, least, best)


def _best(left: DataFrame, right: DataFrame, keys: list[str], least: float, index: bool = True) -> DataFrame:
    """(keys, h, o, ratio): the best partner of each left string at the ratio or more, the first of ties."""
    x = _scored(left, right, keys, least, True, index)
    return x.groupBy(*keys, "h").agg(F.max(F.struct("ratio", (-F.col("o")).alias("minus"))).alias("m")).select(*keys, "h", (-F.col("m.minus")).alias("o"), "m.ratio")


def prepared(df: DataFrame, keys: list[str], name: str, column: str) -> DataFrame:
    s = F.col(column)
    return stored(df.select(*keys, name, s.alias("s")).where(s != "").select(*keys, name, "s", F.length("s").alias("n"), class_counts(F.col("s")).alias("c")), "strings")


def best_matches(left: DataFrame, right: DataFrame, keys: list[str], least: float, text: str = "text", title: str = "title") -> DataFrame:
    """(keys, h, o, ratio): of each left string (keys, h, text) the right one (keys, o, title) of equal keys that is most like it, the one with
    the least o of ties, if its ratio is `least` or more.  h and o are numbers, unique within their keys; nulls and empty strings match nothing.
    """
    a, b = prepared(left, keys, "h", text), prepared(right, keys, "o", title)
    same = b.where(F.col("n").between(1, PASSES_OVER - 1)).groupBy(*keys, "s").agg(F.min("o").alias("o"))
    found = a.join(same, [*keys, "s"]).select(*keys, "h", "o", F.lit(1.0).alias("ratio"))
    rest = a.join(found.select(*keys, "h"), [*keys, "h"], "left_anti")
    large = stored(_sizes(rest, b, keys).where(F.col("lefts") * F.col("rights") > MANY_PAIRS).select(*keys), "large")
    if large.isEmpty():
        return found.unionByName(_best(rest, b, keys, least, False))
    found = found.unionByName(stored(_best(rest.join(large, keys, "left_anti"), b.join(large, keys, "left_anti"), keys, least, False), "matches"))
    many, those = a.join(large, keys, "left_semi"), b.join(large, keys, "left_semi")
    for level in sorted({max(LEVEL, least), least}, reverse=True):
        rest = many.join(found.select(*keys, "h"), [*keys, "h"], "left_anti")
        found = found.unionByName(stored(_best(rest, those, keys, level), "matches"))
    return found


def ratio_at_least(masks: dict, x: str, y: str, floor: float) -> float | None:
    """The ratio of x (with its places by character) and y, if it is floor or more."""
    import difflib

    t = len(x) + len(y)
    if 2.0 * min(len(x), len(y)) / t < floor - 1e-9 or 2.0 * _common(masks, len(x), y) / t < floor - 1e-9:
        return None
    r = difflib.SequenceMatcher(None, x, y).ratio()
    return r if r >= floor else None


def places_of(x: str) -> dict:
    """Bits of x's places by character."""
    masks: dict = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def similar_pairs(left: DataFrame, right: DataFrame, keys: list[str], least: float, text: str = "text", title: str = "title") -> DataFrame:
    """(keys, h, o, ratio): all pairs of equal keys whose ratio is `least` or more."""
    return _scored(prepared(left, keys, "h", text), prepared(right, keys, "o", title), keys, least)
