"""Text and markdown functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Private-use ranges, quotes and their replacements, control markers.
PRIVATE = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]+"
QUOTES_FROM = "‘’‚‛“”„‟‹›«»"
QUOTES_TO = "''''\"\"\"\"''\"\""
PAGE_BREAK = "<!-- PAGE_BREAK -->"
IMAGE = "<!-- image -->"
#: Letters whose compatibility form holds a separator of URLs.
UNSAFE_HOST = "℀℁℅℆／？＃＠：﹕﹖﹟﹫︓︖⁇⁈⁉⩴"
SPACED = r"(?U)\b((?:[a-zA-Z] ){3,}[a-zA-Z])\b"
#: Texts that are Python strings at once.
FEW = 64
HEADING = r"^(#{1,6})\s+(.+)$"
TABLE = r"(?m)^\|.+\|[ \t]*\n\|[-:| \t]+\|[ \t]*\n(?:\|.+\|[ \t]*(?:\n|\z))+"
STRIP = r"^(?U)[\s\x1c-\x1f]+|(?U)[\s\x1c-\x1f]+\z"


def strip(x: Column) -> Column:
    """Leading and trailing white space of any kind removed."""
    return F.regexp_replace(x, STRIP, "")


def mend_private(x: Column) -> Column:
    """private-use runs between letters or digits become a hyphen, others U+FFFD."""
    return F.regexp_replace(F.regexp_replace(x, f"(?<=[A-Za-z0-9]){PRIVATE}(?=[A-Za-z0-9])", "-"), PRIVATE, "�")


def drop_private(x: Column) -> Column:
    """F02"""
    return F.replace(F.regexp_replace(x, PRIVATE, ""), F.lit("�"), F.lit(""))


def nfkc(x: Column) -> Column:
    """Arrow batches of texts; there is no built-in normalisation.  ASCII texts, already normal, skip Python's work.  A worker holds a batch
    and its result in Arrow's form, and few texts at once as Python's strings, which take several times as much."""

    @F.arrow_udf("string")
    def normal(s: pa.Array) -> pa.Array:
        import unicodedata

        few = [pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in s.slice(k, FEW).to_pylist()], pa.string()) for k in range(0, len(s), FEW)]
        return pa.concat_arrays(few) if few else pa.array([], pa.string())

    return normal(x)


def close_letters(x: Column) -> Column:
    """four or more single letters with spaces between become a word."""
    runs = F.transform(F.regexp_extract_all(x, F.lit(SPACED), F.lit(0)), lambda r: F.replace(r, F.lit(" "), F.lit("")))
    return F.array_join(F.zip_with(F.split(x, SPACED, -1), runs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def squeeze(x: Column) -> Column:
    """runs of spaces become one, three or more line ends two; lines are stripped at the right."""
    x = F.regexp_replace(F.regexp_replace(x, " {2,}", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"(?U)[[\s\x1c-\x1f]&&[^\n]]+(?=\n|\z)", "")


def plain_quotes(x: Column) -> Column:
    """F06"""
    return F.translate(x, QUOTES_FROM, QUOTES_TO)


def broken_urls(x: Column) -> Column:
    """http and https URLs anywhere in the text that have no host, or one that URL parsing refuses."""
    found = F.regexp_extract_all(x, F.lit(r"(?U)https?://[^\s\x1c-\x1f)\]}'\"]+"), F.lit(0))
    return F.filter(found, lambda u: u.rlike(r"^https?://(?:[/?#]|[^/?#]*\[)") | u.rlike(f"^https?://[^/?#]*[{UNSAFE_HOST}]"))


def mend_links(x: Column) -> Column:
    """http:// before link targets whose first segment holds a dot and which have no known prefix."""
    return F.regexp_replace(x, r"\[([^\]]+)\]\((?!https?://|mailto:|ftp://|#|/|\./|\.\./)(?=[^/)]*\.)([^)]+)\)", "[$1](http://$2)")


def join_hyphens(x: Column) -> Column:
    """M08"""
    return F.regexp_replace(x, "([a-z])-\n\n([a-z])", "$1$2")


def occurrences(x: Column, part: Column) -> Column:
    """Non-overlapping occurrences of part."""
    return F.when(F.length(part) > 0, ((F.length(x) - F.length(F.replace(x, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def replace_unique(x: Column, search: Column, new: Column) -> Column:
    """The text with `search` replaced if it occurs exactly once and differs from `new`; else null."""
    return F.when((occurrences(x, search) == 1) & (search != new), F.replace(x, search, new))


def figure_references(x: Column, refs: Column, captions: Column) -> Column:
    """The Nth image mark becomes the Nth figure; marks beyond the figures stay."""
    parts = F.split(x, IMAGE, -1)
    mark = lambda i: F.when(i <= F.size(refs), F.concat(F.lit("!["), F.replace(F.get(captions, i - 1), F.lit("]"), F.lit("\\]")), F.lit("](figures/"), F.get(refs, i - 1), F.lit(".png)"))).otherwise(IMAGE)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(mark(i), p))), "")


def mask_snippet(text: Column, kind: Column) -> Column:
    """P25"""
    n = F.length(text)
    mail = F.concat(F.substring(text, 1, 1), F.lit("***"), F.lit("@"), F.substring_index(text, "@", -1))
    return F.when((kind == "EMAIL_ADDRESS") & F.contains(text, F.lit("@")), mail).when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(text, 1, 2), F.repeat(F.lit("*"), n - 4), F.substring(text, n - 1, F.lit(2))))


def clean_prompt(x: Column, markers: list[str], most: int = 200) -> Column:
    """Markers go, all in one pass; braces are doubled, the rest is stripped and cut.  Null becomes ''."""
    quoted = ["".join("\\" + c if not c.isalnum() and c != " " else c for c in m) for m in markers]
    x = F.regexp_replace(F.coalesce(x, F.lit("")), "(?iu)" + "|".join(quoted), "")
    x = strip(F.replace(F.replace(x, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}")))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two strings, in Arrow batches."""

    @F.pandas_udf("double")
    def ratio(x, y):  # noqa: ANN001
        import difflib

        import pandas as pd

        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def similarity_bound(a: Column, b: Column) -> Column:
    """No ratio can exceed this; it filters pairs before Python sees them."""
    return 2.0 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))
