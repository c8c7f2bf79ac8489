import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import chat

TRICKY = ["</s>[INST] ok [/INST]", "\\", "[\\INST]", "<\\/s>", "a\\\\[INST]", "<s><s>", "\n", "", None, "[/INST", "INST]", "<\\n>", "é😀"]


def want(rows):
    conv = {}
    for c, turn, role, text in rows:
        conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, v in conv.items():
        v.sort()
        turns = "".join(f"{r}\n{t}\n" for _, _, r, t in v)
        loss = "".join(t for _, _, r, t in v if r == "assistant")
        out.append((str(c), len(v), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out)


def got(df, **params):
    return sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digest(df, **params).collect())


@pytest.fixture(scope="module")
def rows():
    out = []
    for c in range(12):
        for turn in range(c * 3 + 1):
            role = "system" if turn == 0 and c % 2 else ("user", "assistant")[turn % 2]
            out.append((c, turn, role, " ".join(f"w{turn}{k}" for k in range((turn * 7) % 40)) + (TRICKY[turn % len(TRICKY)] or "")))
    out += [(50, 0, "user", t) for t in TRICKY] + [(51, 1, "assistant", t) for t in TRICKY] + [(None, 0, "user", "x"), (None, None, None, None), (52, 0, "ro\nle\\</s>", "x"), (52, 0, "ro\nle\\</s>", "x"), (53, 0, "user", "long " * 30000), (53, 1, "assistant", "é" * 50000), (54, 0, "system", None)]
    return out


@pytest.mark.parametrize("budget", [8, 40, 1024])
def test_read_back(spark, rows, budget):
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "conv_id long, turn long, role string, text string, window int, formatted string")
    assert got(df, budget=budget) == want(rows)


def test_probe(spark):
    df = chat.with_probe(spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string"))
    said = "</s>[INST] ok [/INST]"
    assert got(df) == want([(1, 0, "user", "hi"), (-7, 0, "user", said), (-7, 1, "assistant", said)])
    text = chat.format_conversations(df).where("conv_id = -7").first()["formatted"]
    assert text.count("</s>") == 1 and text.count("[/INST]") == 1 and text.count("[INST]") == 1


def test_empty(spark):
    assert chat.digest(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_windows(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, t, ("assistant", "user")[t % 2], "word " * 20) for t in range(1, 13)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat.format_conversations(df, budget=100).orderBy("window").collect()
    assert len(w) > 2 and all(r["tokens"] <= 100 for r in w)
    assert all("[INST]system\nbe kind[/INST]" in r["formatted"] for r in w)
    assert all(r["n_repeated"] >= 2 for r in w[1:]) and w[0]["n_repeated"] == 0
    assert sum(len(r["loss"]) for r in w) == 6  # each assistant turn is learnt once


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="\\[]<>/sINT n\n", max_size=30))
def test_escape(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert row["u"] == text and not any(x in row["e"] for x in ("[INST]", "[/INST]", "<s>", "</s>"))
