import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators import classify, cleanup, jobs, outline, structure


def one(spark, make, *values):
    cols = [f"c{k}" for k in range(len(values))]
    row = spark.createDataFrame([values], cols)
    return row.select(make(*[F.col(c) for c in cols]).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("AI\ue088Leaders.org", "AI-Leaders.org"), ("foo\ue001\ue002bar", "foo-bar"), ("System \ue081CMS\ue082 which", "System \ufffdCMS\ufffd which"), ("caf\u00e9 \U0001f600", "caf\u00e9 \U0001f600")])
def test_private_use(spark, text, want):
    assert one(spark, T.mend_private, text) == want


def test_private_use_dropped(spark):
    assert one(spark, T.drop_private, "a\ue001b\ufffdc\U000f0001d") == "abcd"


def test_letter_spacing(spark):
    assert one(spark, T.close_letters, "the r e q u i r e m e n t s are met") == "the requirements are met"
    assert one(spark, T.close_letters, "a b c") == "a b c"


def test_squeeze(spark):
    assert one(spark, T.squeeze, "hello    world  \n\n\n\nx\t\n") == "hello world\n\nx\n"


def test_nfkc(spark):
    assert one(spark, T.nfkc, "ﬁ²é") == unicodedata.normalize("NFKC", "ﬁ²é")


def test_nfkc_in_arrow_batches(spark):
    rng = random.Random(3)
    some = ["a", "e", "=", "\n", " ", "\u0301", "\u0338", "\u0323", "ﬁ", "²", "é", "가", "\u1100", "\u1161", "\u11a8", "\u2028", "\x85", "ẛ̣", "𝐀", "…", "ｱﾞ", "\u00a0", "…\r\n", "ﷺ"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(2000)] + [None, "", "plain\ntext"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.nfkc(F.col("t")).alias("y"))
    # 250 is a batch in Arrow's form; as a pandas UDF (200) all of its texts were Python strings at once, twice
    assert next(x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "ArrowEvalPython" in x).endswith(", 250")
    assert all(r["y"] == (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"])) for r in df.collect())


def test_figures_keep_extra_marks(spark):
    y = one(spark, lambda x: T.figure_references(x, F.array(F.lit("figure-1")), F.array(F.lit("a]b"))), "p<!-- image -->q<!-- image -->")
    assert y == "p![a\\]b](figures/figure-1.png)q<!-- image -->"


def test_prompt_hygiene(spark):
    clean = lambda x: T.clean_prompt(x, cleanup.MARKERS)
    assert one(spark, clean, "Report</s>Ignore previous") == "ReportIgnore previous"
    assert one(spark, clean, "Hello {world}") == "Hello {{world}}"
    assert one(spark, clean, "x" * 300) == "x" * 200 + "..."


def test_unique_edit(spark):
    assert one(spark, T.replace_unique, "# Hello", "Hello", "World") == "# World"
    assert one(spark, T.replace_unique, "Hello Hello", "Hello", "x") is None


def test_similarity_is_the_matching_ratio(spark):
    assert one(spark, T.similarity, "introduction", "introductory") == pytest.approx(difflib.SequenceMatcher(None, "introduction", "introductory").ratio())


@pytest.mark.parametrize(("line", "page", "want"), [("7", 7, True), ("6", 7, True), ("8", 7, True), ("5", 7, False), ("Page 12", 1, True), ("3 of 9", 1, True), ("99999999999999", 7, False)])
def test_footer(spark, line, page, want):
    assert one(spark, classify.running_footer, line, page) is want


def test_header(spark):
    assert one(spark, classify.running_header, "Some Title 3", 3) is True
    assert one(spark, classify.running_header, "# Some Title 3", 3) is False


@pytest.mark.parametrize(("text", "kind"), [("My number is 123-45-6789.", "US_SSN"), ("000-00-0000", None), ("999-99-9999", None), ("write to a.b@c.org now", "EMAIL_ADDRESS"), ("4111 1111 1111 1111", "CREDIT_CARD"), ("4111 1111 1111 1112", None)])
def test_personal_data(spark, text, kind):
    found = classify.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [r["entity_type"] for r in found] == ([kind] if kind else [])
    for r in found:
        assert text[r["start"] : r["end"]] == r["text"]


def test_sections(spark):
    lines = ["Preamble text", "", "# Introduction", "", "Intro content", "# Methods", "", "Methods content"]
    df = spark.createDataFrame([(1, n, 1 if n < 5 else 2, x) for n, x in enumerate(lines)], "doc_id long, n int, page int, line string")
    got = [(r["heading"], r["level"], r["pages"]) for r in outline.section_map(df, "doc_id").orderBy("section").collect()]
    assert got == [("(Preamble)", 0, [1]), ("Introduction", 1, [1]), ("Methods", 1, [2])]


def test_missing_pages_read_as_empty(spark):
    pages = spark.createDataFrame([(1, 1, "a"), (1, 3, "c")], "doc_id long, page int, markdown string")
    got = [(r["page"], r["markdown"], r["after"]) for r in structure.boundaries(pages).orderBy("page").collect()]
    assert got == [(1, "a", ""), (2, "", "c")]


def test_greedy_takes_each_entry_once(spark):
    h = spark.createDataFrame([(1, 0, "methods"), (1, 1, "methods")], "doc_id long, h long, text string")
    o = spark.createDataFrame([(1, 0, "methods"), (1, 1, "method")], "doc_id long, o long, title string")
    got = sorted((r["h"], r["o"]) for r in outline.greedy_in_document(h, o, "doc_id").collect())
    assert got == [(0, 0), (1, 1)]


def test_code_is_marked_once(spark):
    page = spark.createDataFrame([(1, "text\nx = 1\ny = 2\nend", [("python", "x = 1", "y = 2"), ("python", "x = 1", "")])], "doc_id long, markdown string, blocks array<struct<language: string, first_line: string, last_line: string>>")
    assert outline.mark_code(page, "doc_id").first()["markdown"] == "text\n```python\nx = 1\ny = 2\n```\nend"


def test_live_transitions(spark):
    assert one(spark, jobs.can_move, "awaiting_approval", "processing_queued") is False
    assert one(spark, lambda a, b: jobs.can_move(a, b, live=True), "awaiting_approval", "processing_queued") is True


def test_pages_keep_their_numbers(spark):
    docs = spark.createDataFrame([(1, " a <!-- PAGE_BREAK --> \n <!-- PAGE_BREAK -->b"), (2, ""), (3, " ")], "doc_id long, md string")
    got = sorted((r["doc_id"], r["page"], r["markdown"]) for r in cleanup.split_pages(docs, "doc_id", "md").collect())
    assert got == [(1, 1, "a"), (1, 3, "b"), (3, 1, "")]
