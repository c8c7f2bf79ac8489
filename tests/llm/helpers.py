"""Small tables with every awkward case, for the corpus operators."""

WORDS = "the of and to in is was for that with as his on be at by this had not are but from or have an they which one you were all her she there would their".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def awkward(rng):
    """(doc_id, text) rows: null and empty texts, null ids, repeated rows, ties, very long and non-Latin texts, copies and near copies."""
    a, b = sentence(rng, 120), sentence(rng, 80)
    rows = [(1, a), (2, a), (3, b), (3, b), (4, None), (5, ""), (6, " \n\t "), (7, "x"), (8, a.replace("the", "THE", 1)), (9, a + " tail words here"), (10, "é" * 60 + " " + b[:200]), (None, b), (None, None), (11, "one two three"), (12, "one two three"), (13, "日本語 テキスト"), (14, sentence(rng, 20000)), (15, b + " " + sentence(rng, 100) + " " + a)]
    return rows + [(20 + k, sentence(rng, rng.randrange(1, 60))) for k in range(20)]


def frame(spark, rows):
    """The rows as documents, with extra columns whose names clash with those that operators use inside."""
    full = [(i, t, "en", "src", None if t is None else len(t), 1, b"p", "k", 2.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, block int, payload binary, key string, score double")
