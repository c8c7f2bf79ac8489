"""Footnotes in their document's own row and with lines as rows: the same places, and no line is a row without need."""

import random

from folio.operators import review

WORDS = "rivers lakes sea ⁷ Jones Smith et al. ﬁnal Σίσυφος page study of the on water ΟΔΟΣ level".split()


def cases():
    rng = random.Random(6)
    docs, notes = [(-1, None), (-2, "")], [(-1, "1", "a body of text"), (-2, "1", "another body of text"), (-3, "1", "no document")]
    for d in range(40):
        some = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 14))) for _ in range(12)]
        lines = [rng.choice(["", " ", "\u00a0\t", f"{k % 4}. ", f" {k % 4}", f"{k % 4}.", f"{k % 4} "]) + t + rng.choice(["", "  ", "\r"]) for k, t in enumerate(some)]
        docs.append((d, "\n".join(lines)))
        notes += [(d, str(k), rng.choice([*some, " ", "zzz qqq xxx"]) + rng.choice(["", " p. 3"])) for k in range(5)] + [(d, "1", some[0])][: d % 2]
    return docs, sorted(set(notes), key=str)


def test_rows_equal_lines(spark):
    docs, notes = cases()
    notes = list({n[:2]: n for n in notes}.values())
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(notes, "doc_id long, number string, body_text string")
    rows = sorted(map(tuple, review.footnote_places(a, b).collect()))
    lines = sorted(map(tuple, review._places_by_lines(a, b, "doc_id", "text", 3).collect()))
    assert rows == lines and {r[3] for r in rows} == {"number", "text"} and len(rows) > 100
    assert sorted(map(tuple, review.footnote_places(a, b, many=55).collect())) == rows


def test_lines_are_not_shuffled(spark):
    a, b = spark.createDataFrame([(1, "1. a line of text\nend")], "doc_id long, text string"), spark.createDataFrame([(1, "1", "a line of text")], "doc_id long, number string, body_text string")
    plan = review.footnote_places(a, b)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan
