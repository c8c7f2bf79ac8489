"""Block structure by the scan against sequential parsers, over many stretches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folio.functions import blocks
from folio.operators.cleanup import prose_words


def sequential(lines):
    """The same normal form, line after line."""
    out, inside, last = [], None, "start"
    for line in lines:
        m = re.match(r"^ {0,3}(`{3,}|~{3,})(.*)$", line)
        bare = m and not m[2].strip(" \t")
        if inside:
            out.append(line)
            if bare and m[1][0] == inside[0] and min(len(m[1]), 6) >= inside[1]:
                inside, last = None, "text"
            continue
        if not line.strip(" \t"):
            if last in ("indented", "indented+"):
                out.append("")
                last = "indented+"
            elif last != "start":
                last = "blank"
            continue
        fence = m and (bare or m[1][0] == "~" or "`" not in m[2])
        indented = line.startswith(("    ", "\t"))
        heading = re.match(r"^#{1,6}[ \t]+", line) and not fence
        if last in ("blank", "heading") or (heading and last in ("text", "indented")):
            out.append("")
        plain = re.sub(r"[ \t]+$", "", line)
        if fence:
            inside = (m[1][0], min(len(m[1]), 6))
            out.append(plain)
        elif indented:
            out.append(line)
            last = "indented"
        elif heading:
            out.append(re.sub(r"[ \t]+#+$", "", re.sub(r"^(#{1,6})[ \t]+", r"\1 ", plain)))
            last = "heading"
        else:
            out.append(plain if re.match(r"^\s*[*+-](?:[ \t]*[*+-]){2,}$", plain) else re.sub(r"^(\s*)[*+][ \t]+", r"\1- ", plain))
            last = "text"
    text = re.sub(r"\n+\Z", "", "\n".join(out))
    return text + "\n" if text else text


SOME = ["", "  ", "text", "# Head  ##", "## two", "* a", "+ b  ", "- - -", "```", "```py", "~~~", "````", "~~~~~~~", "``` x`y", "   ```", "    code", "\tcode  ", "#no", "   * c", "text  "]


@pytest.mark.parametrize("stretch", [2, 3, 256])
def test_normal_form(spark, stretch, monkeypatch):
    monkeypatch.setattr(blocks.scan, "__defaults__", (stretch,))
    rng = random.Random(stretch)
    docs = [(k, "\n".join(rng.choice(SOME) for _ in range(rng.randrange(60)))) for k in range(150)] + [(200, ""), (201, None), (202, "\n\n"), (203, "a\r\nb\rc")]
    got = {r["k"]: r["t"] for r in blocks.normal_form(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect()}
    assert got == {k: None if t is None else sequential(re.sub("\r\n?", "\n", t).split("\n")) for k, t in docs}


def test_normal_form_of_code(spark):
    x = "```python\n* a\n# c ##\n```"
    assert blocks.normal_form(spark.createDataFrame([(1, x)], "k long, t string"), "k", "t").first()["t"] == x + "\n"
    twice = blocks.normal_form(spark.createDataFrame([(1, "#  H ##\n* a\n\n\n~~~\n* b\n~~~\n    c\n\n\n    d")], "k long, t string"), "k", "t")
    assert twice.first()["t"] == blocks.normal_form(twice, "k", "t").first()["t"]


def test_one_huge_text_spreads(spark):
    """A text of 200,000 lines is hundreds of stretches; fences come out as from a running toggle."""
    rng = random.Random(7)
    lines = [rng.choice(["a", "b", "```", "c"]) for _ in range(200_000)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "k long, t string")
    step = F.when(F.col("line").startswith("```"), F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    assert blocks.scan(blocks.lines_of(df, "k", "t"), "k", "n", step, 2, ["line"]).count() == -(-200_000 // blocks.STRETCH)
    got = [r["inside"] for r in blocks.toggled(blocks.lines_of(df, "k", "t"), "k", F.col("line").startswith("```")).orderBy("n").collect()]
    state, want = False, []
    for x in lines:
        state ^= x == "```"
        want.append(state)
    assert got == want


def test_prose_words_by_a_sequential_parser(spark):
    rng = random.Random(2)
    some = ["plain words here", "  ```", "```x", "    indented code", "a `code span` end", "see https://x.y/z now", "[link text](u.v) more", "\ttab", "it's <b>bold</b> ok"]
    docs = [(k, "\n".join(rng.choice(some) for _ in range(rng.randrange(1, 700)))) for k in range(8)]
    want = set()
    for k, t in docs:
        code = False
        for n, line in enumerate(t.split("\n"), 1):
            if line.strip().startswith("```"):
                code = not code
            elif not code and not line.startswith(("    ", "\t")):
                x = line
                for p, new in ((r"`[^`]+`", ""), (r"https?://[^\s\)\]]+", ""), (r"<[^>]+>", ""), (r"\[([^\]]+)\]\([^\)]+\)", r"\1"), (r"[#*_\[\](){}|>~]", " ")):
                    x = re.sub(p, new, x)
                want |= {(k, n, at, w) for at, w in enumerate(re.findall(r"\b[a-zA-Z]{2,}\b", x))}
    got = {(r["k"], r["line"], r["at"], r["word"]) for r in prose_words(spark.createDataFrame(docs, "k long, t string"), "k", "t").collect()}
    assert got == want


def test_normal_form_over_many_stretches_in_its_row(spark):
    """The fold goes on from stretch to stretch, and no row leaves its task."""
    rng = random.Random(5)
    docs = [(k, "\n".join(rng.choice(SOME) for _ in range(rng.randrange(500, 1500)))) for k in range(12)]
    df = blocks.normal_form(spark.createDataFrame(docs, "k long, t string"), "k", "t")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["t"] for r in df.collect()} == {k: sequential(t.split("\n")) for k, t in docs}


def test_prose_words_shuffle_no_text(spark):
    df = prose_words(spark.createDataFrame([(1, "a line\n\r ```\nhidden\n```x\nthe end\x85```\nmore")], "k long, t string"), "k", "t")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r["line"], r["word"]) for r in df.collect()] == [(1, "line"), (5, "the"), (5, "end"), (6, "more")]
