"""Block structure of line-based text by an associative scan.

A line is a map on a small set of states (what is open before it, what is open after it), as an array: the state before is the index, the
state after the item.  Maps compose, so lines are folded in stretches, stretches in stretches of those, and each stretch then runs on
its own from its first state: a text of any length spreads over tasks, and none of them holds more than a stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 256


def _apply(m: Column, s: Column) -> Column:
    return F.get(m, s)


def _stretches(rows: DataFrame, key: str, at: str, states: int, carry: list[str], stretch: int) -> DataFrame:
    """(key, __of, __rows sorted, __map): stretches with their rows and what they do to a state."""
    rows_ = F.sort_array(F.collect_list(F.struct(at, "__map", *carry)))
    x = rows.groupBy(key, F.floor(F.col(at) / stretch).alias("__of")).agg(rows_.alias("__rows"))
    same = F.array(*[F.lit(s) for s in range(states)])
    return x.withColumn("__map", F.aggregate("__rows", same, lambda a, r: F.transform(a, lambda s: _apply(r["__map"], s))))


def scan(lines: DataFrame, key: str, at: str, step: Column, states: int, carry: list[str], stretch: int = STRETCH) -> DataFrame:
    """(key, __of, lines): stretches of lines in order, each line a struct of `at`, the carried columns and `before`, the state it begins in.

    step: array<int> of `states` items, the state after the line for each state before it; texts begin in state 0.
    """
    first = _stretches(lines.withColumn("__map", step), key, at, states, carry, stretch)
    second = _stretches(first.select(key, F.col("__of").alias("__at"), "__map"), key, "__at", states, [], stretch)
    # of the second level there are few rows a text: the lines of a text, divided by the square of the stretch
    earlier = F.collect_list("__map").over(W.partitionBy(key).orderBy("__of").rowsBetween(W.unboundedPreceding, -1))
    begins = second.withColumn("__s", F.aggregate(earlier, F.lit(0), lambda s, m: _apply(m, s)))
    run = F.aggregate("__rows", F.struct(F.col("__s").alias("s"), F.array().cast("array<struct<of:bigint,s:int>>").alias("out")), lambda a, r: F.struct(_apply(r["__map"], a["s"]).alias("s"), F.array_append(a["out"], F.struct(r["__at"].alias("of"), a["s"].alias("s"))).alias("out")))
    starts = begins.select(key, F.inline(run["out"])).select(F.col(key).alias("__key"), F.col("of").alias("__start"), "s")
    x = first.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__of") == F.col("__start")))
    empty = F.slice(F.transform("__rows", lambda r: F.struct(*[r[c].alias(c) for c in (at, *carry)], F.lit(0).alias("before"))), 1, 0)
    out = F.aggregate("__rows", F.struct(F.col("s").alias("s"), empty.alias("out")), lambda a, r: F.struct(_apply(r["__map"], a["s"]).alias("s"), F.array_append(a["out"], F.struct(*[r[c].alias(c) for c in (at, *carry)], a["s"].alias("before"))).alias("out")))
    return x.select(key, "__of", out["out"].alias("lines"))


def lines_of(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, line) from 0."""
    return docs.select(key, F.posexplode(F.split(column, "\n", -1)).alias("n", "line"))


def toggled(lines: DataFrame, key: str, fence: Column, stretch: int = STRETCH) -> DataFrame:
    """(key, n, line, fence, inside): every fence line turns the inside on or off; it belongs to what it opens.

    On and off is a sum modulo 2, so the scan needs counts only: of stretches, summed over the stretches before, and within each.
    """
    x = lines.withColumns({"fence": fence, "__of": F.floor(F.col("n") / stretch)})
    sums = x.groupBy(key, "__of").agg(F.sum(F.col("fence").cast("int")).alias("__own"))
    before = F.coalesce(F.sum("__own").over(W.partitionBy(key).orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col(key).alias("__key"), F.col("__of").alias("__start"), before.alias("__before"))
    within = F.sum(F.col("fence").cast("int")).over(W.partitionBy(key, "__of").orderBy("n"))
    x = x.withColumn("__within", within).join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__of") == F.col("__start")))
    return x.select(key, "n", "line", "fence", ((F.col("__before") + F.col("__within")) % 2 == 1).alias("inside"))


#: A fence line up to its end.
_FENCE = r"(?Umd)^[[\s\x1c-\x1f]&&[^\n]]*```[^\n]*"


def lines_outside(text: Column) -> Column:
    """The lines of a text, those of fences and inside them empty.

    A text is in one row, so it is cut at its fence lines there: every other piece is inside, of which the line ends stay.
    """
    parts = F.transform(F.split(text, _FENCE, -1), lambda p, i: F.when(i % 2 == 0, p).otherwise(F.regexp_replace(p, r"[^\n]+", "")))
    return F.split(F.array_join(parts, ""), "\n", -1)


# --- a normal form ---------------------------------------------------------------------------------------------------------------

#: States outside fences, by what came last, and inside, by the mark and its length (from 3; 6 stands for 6 and more).
START, BLANK, HEADING, TEXT, INDENTED, AFTER_INDENTED = range(6)
LENGTHS = (3, 4, 5, 6)
_INSIDE = {(mark, n): 6 + 4 * k + j for k, mark in enumerate("`~") for j, n in enumerate(LENGTHS)}
STATES = 6 + len(_INSIDE)
_OPEN = r"^ {0,3}(`{3,}|~{3,})(.*)$"


def _marks(line: Column) -> tuple[Column, Column, Column]:
    """(mark, length up to 6, kind) of a fence line: bare ones open and close, others only open; kind is null for other lines."""
    run, rest = F.regexp_extract(line, _OPEN, 1), F.regexp_extract(line, _OPEN, 2)
    mark = F.substring(run, 1, 1)
    kind = F.when(run == "", F.lit(None)).when(F.btrim(rest, F.lit(" \t")) == "", "bare").when((mark == "~") | ~F.contains(rest, F.lit("`")), "open")
    return mark, F.least(F.length(run), F.lit(LENGTHS[-1])), kind


def structure_step(line: Column) -> Column:
    """What a line does to the state, as an array."""
    mark, n, kind = _marks(line)
    blank = F.btrim(line, F.lit(" \t")) == ""
    indented = line.rlike("^(?: {4}|\t)")
    heading = line.rlike(r"^#{1,6}[ \t]+")
    opened = F.coalesce(*[F.when((mark == m) & (n == k), s) for (m, k), s in _INSIDE.items()])
    items = []
    for s in range(6):
        after_blank = {START: START, INDENTED: AFTER_INDENTED, AFTER_INDENTED: AFTER_INDENTED}.get(s, BLANK)
        items.append(F.when(blank, after_blank).when(kind.isNotNull(), opened).when(indented, INDENTED).when(heading, HEADING).otherwise(TEXT))
    for (m, k), s in _INSIDE.items():
        items.append(F.when((kind == "bare") & (mark == m) & (n >= k), TEXT).otherwise(s))
    return F.array(*items)


def _written(line: Column, before: Column) -> Column:
    """The lines that a line becomes, as an array: none, itself, or a blank line and itself; code stays as it is."""
    _, _, kind = _marks(line)
    blank = F.btrim(line, F.lit(" \t")) == ""
    indented = line.rlike("^(?: {4}|\t)")
    heading = line.rlike(r"^#{1,6}[ \t]+")
    plain = F.regexp_replace(line, r"[ \t]+$", "")
    head = F.regexp_replace(F.regexp_replace(plain, r"^(#{1,6})[ \t]+", "$1 "), r"[ \t]+#+$", "")
    text = F.when(heading, head).when(plain.rlike(r"^\s*[*+-](?:[ \t]*[*+-]){2,}$"), plain).otherwise(F.regexp_replace(plain, r"^(\s*)[*+][ \t]+", "$1- "))
    text = F.when(kind.isNotNull(), plain).when(indented, line).otherwise(text)
    apart = before.isin(BLANK, HEADING) | (heading & kind.isNull() & before.isin(TEXT, INDENTED))
    outside = F.when(blank, F.when(before.isin(INDENTED, AFTER_INDENTED), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))).when(apart, F.array(F.lit(""), text)).otherwise(F.array(text))
    return F.when(before >= 6, F.array(line)).otherwise(outside)


#: What lines are to the states: blank, indented, headings, text, and fence lines by mark, length and whether they are bare.
BLANK_LINE, INDENTED_LINE, HEADING_LINE, TEXT_LINE, FENCE_LINE = range(5)


def _line_kind(line: Column) -> Column:
    mark, n, kind = _marks(line)
    fence = FENCE_LINE + (mark == "~").cast("int") * 8 + (n - 3) * 2 + (kind == "open").cast("int")
    return (
        F.when(F.btrim(line, F.lit(" \t")) == "", BLANK_LINE)
        .when(line.rlike("^ {0,3}(?:```|~~~)"), F.coalesce(fence, F.lit(TEXT_LINE)))
        .when(line.rlike("^(?: {4}|\t)"), INDENTED_LINE)
        .when(line.rlike(r"^#{1,6}[ \t]+"), HEADING_LINE)
        .otherwise(TEXT_LINE)
    )


def _next_states() -> list[int]:
    """The state after a line of each kind (in rows) from each state."""
    out = []
    for kind in range(FENCE_LINE + 16):
        mark, n, bare = "`~"[(kind - FENCE_LINE) // 8 % 2], (kind - FENCE_LINE) % 8 // 2 + 3, (kind - FENCE_LINE) % 2 == 0
        for s in range(6):
            if kind == BLANK_LINE:
                out.append({START: START, INDENTED: AFTER_INDENTED, AFTER_INDENTED: AFTER_INDENTED}.get(s, BLANK))
            else:
                out.append({INDENTED_LINE: INDENTED, HEADING_LINE: HEADING, TEXT_LINE: TEXT}.get(kind, _INSIDE[mark, n]))
        out += [TEXT if kind >= FENCE_LINE and bare and mark == m and n >= k else s for (m, k), s in _INSIDE.items()]
    return out


def _states(kinds: Column, stretch: int) -> Column:
    """The state before each line.  A text is in one row already, so its lines are folded there, in stretches, since an array grows by copies."""
    after = F.array(*[F.lit(s) for s in _next_states()])
    none = F.array().cast("array<int>")

    def line(a, c):
        return F.struct(F.get(after, c * STATES + a["s"]).alias("s"), F.array_append(a["out"], a["s"]).alias("out"))

    def part(a, i):
        run = F.aggregate(F.slice(kinds, i * stretch + 1, stretch), F.struct(a["s"].alias("s"), none.alias("out")), line)
        return F.get(F.transform(F.array(run), lambda r: F.struct(r["s"].alias("s"), F.array_append(a["out"], r["out"]).alias("out"))), F.lit(0))

    parts = F.sequence(F.lit(0), F.floor((F.size(kinds) - 1) / stretch).cast("int"))
    return F.flatten(F.aggregate(parts, F.struct(F.lit(START).alias("s"), F.array().cast("array<array<int>>").alias("out")), part)["out"])


def with_normal_form(docs: DataFrame, column: str, stretch: int = STRETCH) -> DataFrame:
    """docs with the column in its normal form; no row leaves its task."""
    lines = F.split(F.regexp_replace(column, "\r\n?", "\n"), "\n", -1)
    x = docs.withColumn("__lines", lines).withColumn("__kinds", F.transform("__lines", _line_kind)).withColumn("__before", _states(F.col("__kinds"), stretch))
    text = F.regexp_replace(F.array_join(F.flatten(F.zip_with("__lines", "__before", _written)), "\n"), r"\n+\z", "")
    x = x.withColumn("__text", text)
    return x.withColumn(column, F.when(F.col("__text") == "", F.col("__text")).otherwise(F.concat("__text", F.lit("\n")))).drop("__lines", "__kinds", "__before", "__text")


def normal_form(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, column) in a normal form: line ends, no trailing blanks, headings with one blank and blank lines around, `-` for bullets, one blank
    line between blocks, one line end at the end.  Fenced code stays as it is, as do indented lines and blank lines after them; a null text
    stays null."""
    return with_normal_form(docs.select(key, column), column)
