from pyspark.sql import functions as F

from folio.operators.outline import flag_spelling
from folio.operators.review import clean_and_flag


def test_flags_are_limited_by_document(spark):
    from itertools import product

    good = ["".join(p) + "mmmmmmmmmmm" for p in product("abcdefgh", repeat=2)]
    rows = [(k, " ".join(good) + f" {k}") for k in range(20)]
    bad = [w + "x" for w in good]
    rows += [(30, " ".join(bad)), (31, " ".join(bad)), (32, "Aammmmmmmmmmmx\nthen Abmmmmmmmmmmmx"), (33, "aammmmmmmmmmmx again")]
    got = {}
    for r in flag_spelling(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], {})[r["place"]] = (r["w"], r["suggestions"])
    assert sorted(got) == [30, 31, 32, 33]
    for d in (30, 31):
        assert [got[d][k + 1] for k in range(len(got[d]))] == [(w, [w[:-1]]) for w in bad[:50]]
    assert got[32] == got[33] == {1: ("aammmmmmmmmmmx", ["aammmmmmmmmmm"])}


def test_cleaned_texts_are_moved_by_key_alone(spark):
    """Texts are joined to their report once; nothing else that is shuffled holds a text, and words of code are not counted."""
    rows = [(k, f"* good words\n```\nhidden\n```\n\n\n\nend {k}") for k in range(30)] + [(40, None), (41, "goood\n")]
    df = clean_and_flag(spark.createDataFrame(rows, "doc_id long, text string"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
    got = {r["doc_id"]: r for r in df.collect()}
    assert got[3]["cleaned"] == "- good words\n```\nhidden\n```\n\nend 3\n" and got[3]["words_checked"] == 3
    assert (got[40]["cleaned"], got[40]["words_checked"], got[40]["report"]) == (None, 0, "")
    assert got[41]["report"] == 'Possible misspellings:\n- Line 1: "goood" - suggestions: ["good"]'


def test_first_words_of_a_text(spark):
    """Distinct words come out of their own row, in lower case and as they are at their first places."""
    from folio.operators.cleanup import _first_words

    got = spark.sql("SELECT 'The cat, the CAT an Cats' AS t UNION ALL SELECT NULL").select(F.inline(_first_words(F.col("t")))).collect()
    assert sorted(map(tuple, got)) == [("cat", 1, "cat"), ("cats", 4, "Cats"), ("the", 0, "The")]
