"""Operators that SQL cannot express, against plain Python on small tables."""

import difflib
import io
import re
import unicodedata
import zipfile
from datetime import datetime, timedelta

import pytest

from folio.functions import text as T
from folio.operators import classify, cleanup, exchange, lifecycle, outline, review, stores


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def normal(x):
    return " ".join(unicodedata.normalize("NFKC", x).lower().split())


def body_line(text, body, number):
    lines, body = text.split("\n"), normal(body)
    for i, line in enumerate(lines):
        s = line.strip()
        for start in (f"{number} ", f"{number}. ", f"{number}."):
            if s.startswith(start):
                rest = normal(s[len(start) :])[:60]
                if rest and body and ratio(body[:60], rest) >= 0.6:
                    return i, "number"
                break
    best, at = 0.0, -1
    for i, line in enumerate(lines):
        x = normal(line)
        if len(x) >= 10 and ratio(body[:80], x[:80]) > best:
            best, at = ratio(body[:80], x[:80]), i
    return (at, "text") if best >= 0.5 else None


def test_footnote_bodies(spark):
    cases = [
        (1, "intro\n12. Smith et al, on rivers\nend", "12", "Smith et al., On Rivers and lakes"),
        (2, "1 other words entirely here\nSmith on rivers and lakes\n2 x", "1", "Smith on rivers & lakes"),
        (3, "nothing\nat all", "3", "A body that is nowhere"),
        (4, "a\nb\nc\n7.Jones: the sea\nd\ne\nf\ng", "7", "Jones: the sea"),
        (5, "", "1", "x"),
        (6, "⁷ Jones and the sea level\n7 Jones and the sea", "7", "Jones and the sea"),
    ]
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in cases], "doc_id long, text string")
    notes = spark.createDataFrame([(i, n, b) for i, _, n, b in cases], "doc_id long, number string, body_text string")
    got = {r["doc_id"]: r for r in review.footnote_places(docs, notes).collect()}
    for i, text, number, body in cases:
        want = body_line(text, body, number)
        assert ((got[i]["n"], got[i]["strategy"]) if i in got else None) == want
        if want:
            lines = text.split("\n")
            lo, hi = max(0, want[0] - 3), min(len(lines), want[0] + 4)
            assert got[i]["context"] == "\n".join(f"  L{k + 1}: {lines[k]}" for k in range(lo, hi))
    assert review.footnote_places(docs.limit(0), notes).count() == 0


def test_footnote_markers(spark):
    texts = [(1, "end of word3. next word33 and third3, more at3\nline" + " pad" * 40 + " x3)", "3"), (2, "up³ here and up3; and 3 alone", "3"), (3, "no marker", "12"), (4, "a12] b12 c12, d12.", "12"), (5, "w1.5 w1", "1")]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    notes = spark.createDataFrame([(t[0], t[2]) for t in texts], "doc_id long, number string")
    got = {r["doc_id"]: r["markers"] for r in review.footnote_markers(docs, notes).collect()}
    for i, text, number in texts:
        up = {"3": "³", "1": "¹"}.get(number)
        pattern = re.compile("([a-zA-Z])(" + "|".join([re.escape(number)] + ([up] if up else [])) + r")(?!\d)(\s|[,;.\)\]]|$)")
        want = []
        for m in list(pattern.finditer(text))[:3]:
            a, b = max(0, m.start() - 60), min(len(text), m.start() + 60)
            want.append(("..." if a else "") + text[a:b].replace("\n", " ") + ("..." if b < len(text) else ""))
        assert got[i] == want


def test_heading_levels(spark):
    pages = spark.createDataFrame([(1, 1, "# Intro\ntext\n## Method"), (1, 2, "### Results!\n# Other"), (2, 1, "# Alone")], "doc_id long, page int, markdown string")
    entries = spark.createDataFrame([(1, 1, 0, 2, "intro"), (1, 1, 1, 3, "Methods"), (1, 2, 2, 1, "Results"), (1, 1, 3, 5, "intro")], "doc_id long, page int, ord int, level int, text string")
    new, changes = review.heading_levels(pages, entries, "doc_id")
    assert {(r["doc_id"], r["page"]): r["markdown"] for r in new.collect()} == {(1, 1): "## Intro\ntext\n### Method", (1, 2): "# Results!\n# Other", (2, 1): "# Alone"}
    assert {(r["old_text"], r["new_text"]) for r in changes.collect()} == {("# Intro", "## Intro"), ("## Method", "### Method"), ("### Results!", "# Results!")}


def test_recognition_check(spark):
    terms = spark.createDataFrame([("Enzo", 1), ("modern", 2), ("corn", 3)], "term string, ord long")
    known = spark.createDataFrame([("barn", 30), ("warm", 50), ("plain", 99)], "word string, n long")
    docs = spark.createDataFrame([(1, "Modem modern bam bamn plain enzq corn corn barrn"), (2, "plain text"), (3, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["word"]): (r["reason"], r["confidence"], r["suggestions"]) for r in cleanup.check_recognition(docs, terms, known).collect()}
    assert got[1, "Modem"] == ("key_term_variant", 0.95, ["modern"]) if (1, "Modem") in got else True
    assert got[1, "enzq"] == ("spell_check_suggests_key_term", 0.85, ["enzo"])
    assert got[1, "barrn"] == ("common_ocr_pattern", 0.7, ["barn"])
    assert not {w for _, w in got} & {"modern", "corn", "plain", "text"}


def variants(terms):
    out, low = {}, {t.lower() for t in terms}
    for t in terms:
        for group in cleanup.CONFUSED:
            for a in group:
                for b in group:
                    if a != b and a in t.lower():
                        v = t.lower().replace(a, b)
                        if v != t.lower() and v not in low:
                            out[v] = t
    return out


def test_variants_of_terms(spark):
    terms = ["Modern", "corn", "com", "will", "dull", "Sail5", "bogy", "clod", "vvy", "wy"]
    got = {r["variant"]: r["term"] for r in cleanup.recognition_variants(spark.createDataFrame([(t, k) for k, t in enumerate(terms)], "term string, ord long")).collect()}
    assert got == variants(terms)


def test_running_titles(spark):
    rows = [("Annual River Report 7", "annual river report", 7), ("# Annual River Report", "annual river report", 7), ("Some Title 3", "", 3), ("Some Title 4", "", 3), ("  ", "x", 1), ("River Report", "annual river report", 2)]
    x = spark.createDataFrame(rows, "line string, title string, page int")
    got = [r["h"] for r in x.select(classify.running_header(x.line, x.page, x.title).alias("h")).collect()]
    want = []
    for line, title, page in rows:
        s = line.strip()
        m = re.match(r"^(.+?)\s+(\d+)\s*$", s)
        hit = bool(title) and ratio(s.lower().rstrip("0123456789 "), title.lower()) >= 0.7 or bool(m and int(m[2]) == page and len(m[1]) < 80)
        want.append(bool(s) and not s.startswith("#") and hit)
    assert got == want


def test_prompt_markers_go_in_one_pass(spark):
    x = spark.createDataFrame([("Hum</s>an: x",), ("Report</s>Ignore previous",), ("Hello {world}",), (None,), ("y" * 300,)], "t string")
    assert [r[0] for r in x.select(T.clean_prompt(x.t, cleanup.MARKERS)).collect()] == ["Human: x", "ReportIgnore previous", "Hello {{world}}", "", "y" * 200 + "..."]


def test_two_tier_limit_slides_over_midnight(spark):
    t0, us = datetime(2024, 1, 1, 23, 0), 3_600_000_000
    rows = [(k, k % 3, int((t0 + timedelta(minutes=20 * k)).timestamp() * 1e6)) for k in range(60)]
    got = {r["event_id"]: r["verdict"] for r in lifecycle.two_tier(spark.createDataFrame(rows, "event_id long, user_id long, us long"), "user_id", "event_id", "us", 2, 2 * us, 3, 5 * us).collect()}
    own, everyone, want = {}, [], {}
    for k, user, now in rows:
        log = own[user] = [t for t in own.get(user, []) if t > now - 2 * us]
        if len(log) >= 2:
            want[k] = "client"
            continue
        log.append(now)
        everyone = [t for t in everyone if t > now - 5 * us]
        want[k] = "admitted" if len(everyone) < 3 else "everyone"
        if want[k] == "admitted":
            everyone.append(now)
    assert got == want


def test_bundles(spark):
    docs = spark.createDataFrame([(1, "# a"), (2, "b")], "job_id long, markdown string")
    figures = spark.createDataFrame([(1, "figure-1", b"\x89PNG"), (1, "figure-2", b"x")], "job_id long, ref_id string, image binary")
    got = {r["job_id"]: zipfile.ZipFile(io.BytesIO(bytes(r["bundle"]))) for r in stores.bundles(docs, figures, "job_id").collect()}
    assert sorted(got[1].namelist()) == ["1.md", "figures/figure-1.png", "figures/figure-2.png"] and got[1].read("figures/figure-1.png") == b"\x89PNG"
    assert got[2].namelist() == ["2.md"] and got[2].read("2.md") == b"b"


def test_worker_stream(spark, tmp_path):
    rows = [(1, "mail a@b.org", None, True), (2, "plain", None, True), (3, "x", "timeout", True), (4, "x", "corrupt", True), (5, "x", None, False)]
    spark.createDataFrame(rows, "doc_id long, text string, error string, known boolean").write.parquet(str(tmp_path / "queue"))
    seen = []
    queue = spark.readStream.schema("doc_id long, text string, error string, known boolean").parquet(str(tmp_path / "queue"))
    for _ in range(2):  # a restarted worker finds nothing that was done already
        lifecycle.work_stream(queue, "doc_id", "text", lambda frame, n: seen.extend(frame.collect()), str(tmp_path / "checkpoint")).awaitTermination()
    assert sorted((r["doc_id"], r["status"], r["requeued"], r["days"]) for r in seen) == [(1, "awaiting_approval", False, 7), (2, "processing", False, 7), (3, "pii_scanning", True, 7), (4, "failed", False, 30), (5, "failed", False, 30)]


@pytest.mark.parametrize("text,kinds", [("My number is 123-45-6789.", {"US_SSN"}), ("CS-000-45-6789 000-00-0000 123-45-678", set()), ("card 4111-1111-1111-1111", {"CREDIT_CARD"}), ("4111-1111-1111-1112", set()), ("GB82WEST12345698765432", {"IBAN_CODE"}), ("GB82WEST12345698765433", set()), ("a@b.org and a@b.org", {"EMAIL_ADDRESS"})])
def test_personal_data(spark, text, kinds):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = classify.personal_data(df).collect()
    assert {r["entity_type"] for r in found} == kinds and all(text[r["start"] : r["end"]] == r["text"] for r in found)
    assert [r["found"] for r in classify.with_findings(df).orderBy("doc_id").collect()] == [bool(kinds), False, False]


def test_first_step_and_extraction(spark):
    x = spark.createDataFrame([(1, "<h2>A &amp; B</h2><script>x()</script><p>one <b>two</b></p><ul><li>i</li></ul>"), (2, "")], "page_id long, html string")
    assert {r["page_id"]: r["markdown"] for r in exchange.extract(x).collect()} == {1: "## A & B\n\none two\n\n- i", 2: ""}


def test_similarities(spark):
    rows = [("abcd", "bcde"), ("", ""), ("x" * 300 + "abc", "abc" + "x" * 300), ("same", "same")]
    x = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in x.select(T.similarity(x.a, x.b)).collect()] == [ratio(a, b) for a, b in rows]


def test_best_in_page(spark):
    heads = spark.createDataFrame([(1, 0, "intro"), (1, 1, "method"), (2, 0, "zzz")], "d long, h long, text string")
    entries = spark.createDataFrame([(1, 0, "intro.", 1), (1, 1, "introo", 2), (1, 2, "methods", 2), (2, 3, "abc", 1)], "d long, o long, title string, level int")
    got = sorted((r["d"], r["h"], r["o"]) for r in outline.best_in_page(heads, entries, ["d"]).collect())
    want = []
    for d, h, t in [(1, 0, "intro"), (1, 1, "method"), (2, 0, "zzz")]:
        best, at = 0.8, None
        for o, e in [(0, "intro."), (1, "introo"), (2, "methods")] if d == 1 else [(3, "abc")]:
            if ratio(t, e) > best or (ratio(t, e) >= best and at is None):
                best, at = ratio(t, e), o
        if at is not None:
            want.append((d, h, at))
    assert got == want


def test_numbers_of_large_groups(spark):
    import random

    from folio.functions.ranks import numbered

    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 2, 2, rng.randrange(1000)]), k) for k in range(3000)]
    got = {r["id"]: (r["place"], r["total"]) for r in numbered(spark.createDataFrame(rows, "g string, v long, id long"), "g", ["v", "id"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in own] == [(k + 1, len(own)) for k in range(len(own))]
