"""Recognisers with context: scores rise beside words of the kind, offsets stay exact."""

import json
import random
import re

from folio.operators import classify


def plain(text, least):
    out = []
    for kind, pattern, score in classify.ENTITIES:
        if kind in ("US_SSN", "CREDIT_CARD", "IBAN_CODE"):
            continue
        words = [len(re.findall(r"\s+", text[: m.start()])) for m in re.finditer(r"(?i)\b(?:" + "|".join(classify.CONTEXT[kind]) + r")\b", text)]
        places = [m.start() for m in re.finditer(r"(?i)\b(?:" + "|".join(classify.CONTEXT[kind]) + r")\b", text)]
        for m in re.finditer(pattern, text, re.ASCII):
            at = len(re.findall(r"\s+", text[: m.start()]))
            near = any(p < m.start() and at - w <= classify.WORDS_BEFORE for w, p in zip(words, places, strict=True))
            s = classify.lifted(score) if near else score
            if s >= least:
                out.append((kind, m.start(), m.end(), round(s, 6), m[0]))
    return sorted(out)


def test_context_lifts(spark):
    rng = random.Random(6)
    some = ["call", "Phone:", "number", "x", "yy", "licence", "driving", "555", "+1 555-123-4567", "D1234567", "a.b@c.org", "e-mail", "mobile", "\n", "  ", "telephonex", "(cell)"]
    texts = ["call +1 555-123-4567", "+1 555-123-4567", "call a b c d +1 555-123-4567", "call a b c d e +1 555-123-4567", "+1 555-123-4567 call", "phone +1 555-123-4567 or +1 555-123-4568 x y z +1 555-123-4569", "", "tel/cell:+1 555-123-4567", "driving D1234567"]
    texts += [" ".join(rng.choice(some) for _ in range(rng.randrange(30))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (900, None)], "doc_id long, text string")
    for least in (0.0, 0.85):
        got: dict = {}
        for r in classify.personal_data(df, least=least).collect():
            got.setdefault(r["doc_id"], []).append((r["entity_type"], r["start"], r["end"], round(r["score"], 6), r["text"]))
        assert {k: sorted(v) for k, v in got.items()} == {k: v for k, t in enumerate(texts) if (v := plain(t, least))}
    passed = {r["doc_id"] for r in classify.personal_data(df.where("doc_id < 9")).collect()}
    assert passed == {0, 2, 5, 7}
    found = {r["doc_id"]: r["found"] for r in classify.with_findings(df.where("doc_id < 9 OR doc_id = 900")).collect()}
    assert found == {k: k in passed for k in [*range(9), 900]}


def test_texts_are_searched_once_a_pattern(spark):
    """A pattern is in the plan where texts are searched and where they are cut, not also in filters and for every piece."""
    pattern = next(p for k, p, _ in classify.ENTITIES if k == "US_SSN")
    found = classify.personal_data(spark.sql("SELECT 1L AS doc_id, text FROM VALUES ('ssn 078-05-1120') AS t(text)").repartition(2), least=0.0)
    plan = found._jdf.queryExecution().optimizedPlan().toJSON()
    assert 0 < plan.count(json.dumps(pattern)[1:-1]) <= 3
    assert [(r["entity_type"], r["start"], r["end"], r["score"]) for r in found.collect()] == [("US_SSN", 4, 15, 1.0)]
