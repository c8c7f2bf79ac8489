"""Secret scans with DataFrame functions only: three fixed patterns plus sliding-window Shannon entropy.

Regular expressions find the matches; their places come from the lengths of the pieces between them, so
nothing leaves the JVM.  The entropy of each 20-character window of a candidate is kept by incremental
counts: one character enters, one leaves, and only their two terms of sum(c * log2 c) change.

Defined results: null or empty text has no spans and zero counts; every row of the input gives one row,
repeated rows too; a null doc_id stays null; other columns do not matter to `find_secrets` and are kept
by `redact_secrets`.  Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three base patterns, in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Allow-list: stretches that look random but are known not to be secrets.
ALLOWED = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|example|placeholder|changeme|0123456789|abcdefghij"
#: The same within a longer candidate: only this part of it is passed over, the rest is scanned.
PART = r"[A-Za-z0-9+]*(?i:example|placeholder|changeme|0123456789|abcdefghij)[A-Za-z0-9+]*"


def _let(value: Column, f) -> Column:
    """Bind value once and use it many times in f."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _places(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, inner>> of all matches; start and end in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if pattern == ASSIGN else found
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x))

    def places(found, inner, gaps):
        def step(acc, i):
            start = acc["at"] + F.get(gaps, i)
            end = start + F.char_length(F.get(found, i))
            one = F.struct(start.alias("start"), end.alias("end"), F.get(found, i).alias("match"), F.get(inner, i).alias("inner"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        empty = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string,inner:string>>").alias("out"))
        return F.aggregate(F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>")), empty, step)["out"]

    return _let(F.struct(found.alias("f"), inner.alias("i"), gaps.alias("g")), lambda x: places(x["f"], x["i"], x["g"]))


def _spans(kind: int, places: Column) -> Column:
    return F.transform(places, lambda p: F.struct(p["start"].alias("start"), F.lit(kind).alias("kind"), p["end"].alias("end")))


def _rest(place: Column) -> Column:
    """What a candidate (a place) holds besides allowed parts, as places of at least 20 characters."""
    text = place["match"]
    found, rest = F.regexp_extract_all(text, F.lit(PART), F.lit(0)), F.split(text, PART, -1)

    def step(acc, i):
        end = acc["at"] + F.char_length(F.get(acc["rest"], i))
        one = F.struct(acc["at"].alias("start"), end.alias("end"), F.get(acc["rest"], i).alias("match"), F.get(acc["rest"], i).alias("inner"))
        return F.struct((end + F.coalesce(F.char_length(F.get(acc["found"], i)), F.lit(0))).alias("at"), acc["found"].alias("found"), acc["rest"].alias("rest"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,match:string,inner:string>>")
    start = F.struct(place["start"].alias("at"), found.alias("found"), rest.alias("rest"), empty.alias("out"))
    parts = F.aggregate(F.sequence(F.lit(0), F.size(rest) - 1), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(PART), F.filter(parts, lambda x: F.char_length(x["match"]) >= 20)).otherwise(F.array(place))


def _entropy_spans(candidate: Column, window: int, least_hex: float, least_other: float) -> Column:
    """The stretch from the first to the last window of `candidate` (a place) whose entropy reaches its class's limit; null if none."""
    import math

    term = lambda c: F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))
    at = lambda chars, i: F.instr(F.lit(ALPHABET), F.get(chars, i)) - 1

    def scan(place):
        text = place["match"]
        least = F.when(text.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(least_hex)).otherwise(F.lit(least_other))
        most_sum = (F.lit(math.log2(window)) - least) * window  # entropy = log2(window) - sum(c log2 c) / window

        def walk(b):
            chars, limit = b["chars"], b["limit"]

            def step(acc, i):
                new, old = at(chars, i), F.when(i >= window, at(chars, i - window)).otherwise(F.lit(-1))
                c_new = F.get(acc["counts"], new)
                s = acc["s"] - term(c_new) + term(c_new + 1)
                counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == new, 1).otherwise(0))
                c_old = F.get(acc["counts"], old) + F.when(old == new, 1).otherwise(0)
                s = s - F.when(old >= 0, term(c_old) - term(c_old - 1)).otherwise(F.lit(0.0))
                counts = F.transform(counts, lambda c, j: c - F.when(j == old, 1).otherwise(0))
                hit = (i >= window - 1) & (s <= limit + 1e-9)
                return F.struct(counts.alias("counts"), s.alias("s"), F.when(hit & acc["first"].isNull(), i - (window - 1)).otherwise(acc["first"]).alias("first"), F.when(hit, i + 1).otherwise(acc["last"]).alias("last"))

            start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
            return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

        found = _let(F.struct(F.split(text, "").alias("chars"), most_sum.alias("limit")), walk)
        span = _let(found, lambda x: F.when(x["first"].isNotNull(), F.struct((place["start"] + x["first"]).alias("start"), F.lit(3).alias("kind"), (place["start"] + x["last"]).alias("end"))))
        mixed = text.rlike("[0-9]") & text.rlike("[A-Za-z]") & ~text.rlike(ALLOWED)
        return F.when(mixed, span)

    return scan(candidate)


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int>>")


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "secret_spans", window: int = 20, least_hex: float = 3.0, least_other: float = 3.7) -> DataFrame:
    """docs plus `out`: array<struct<start, kind, end>> sorted by start, then kind (0 assign, 1 access, 2 hex, 3 entropy).

    Entropy spans that lie within one base span are not repeated; others stay whole, and base spans always stay.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.when((F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))) & text.rlike(ASSIGN), _spans(0, F.filter(_places(text, ASSIGN), lambda p: F.char_length(p["inner"]) >= 6))).otherwise(_none())
    access = F.when(F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS), _spans(1, _places(text, ACCESS))).otherwise(_none())
    hexes = F.when(text.rlike(HEX), _spans(2, _places(text, HEX))).otherwise(_none())
    base = F.concat(assign, access, hexes)
    extra = F.when(
        text.rlike(CANDIDATE),
        F.filter(F.transform(F.filter(F.flatten(F.transform(_places(text, CANDIDATE), _rest)), lambda p: p["match"].rlike("[0-9]") & p["match"].rlike("[A-Za-z]")), lambda p: _entropy_spans(p, window, least_hex, least_other)), lambda x: x.isNotNull()),
    ).otherwise(_none())
    both = _let(F.struct(base.alias("b"), extra.alias("e")), lambda x: F.sort_array(F.concat(x["b"], F.filter(x["e"], lambda e: ~F.exists(x["b"], lambda b: (b["start"] <= e["start"]) & (e["end"] <= b["end"]))))))
    return docs.withColumn(out, both)


def _joined(spans: Column) -> Column:
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: counts of each base kind, the digest of the base spans, and all spans as text."""
    from .common import id_text

    x = with_spans(id_text(docs, id_col, text_col)).select("doc_id", F.col("secret_spans").alias("s"))
    count = lambda k: F.size(F.filter("s", lambda v: v["kind"] == k)).cast("long")
    return x.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.filter("s", lambda v: v["kind"] < 3)), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by `mark`; overlapping spans become one.  Null texts stay null."""
    tmp = "__secret_spans"
    while tmp in docs.columns:
        tmp += "_"
    text = F.col(text_col)

    def step(acc, s):
        apart = s["start"] >= acc["at"]
        piece = F.when(apart, F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(F.col(tmp), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))))
    return with_spans(docs, text_col, tmp).withColumn(text_col, F.when(F.size(tmp) > 0, done).otherwise(text)).drop(tmp)
