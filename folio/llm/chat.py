"""Chat formatting with DataFrame functions only: budgeted windows over the turns of a conversation.

Prefix sums of turn tokens choose turn-aligned spans of at most `budget` tokens.  Every window after the
first repeats the leading system turn and up to `history` turns before its own; repeated turns carry no
loss.  A turn over the budget gets a window of its own, whole.

The template: `<s>`, then for each turn `[INST]role\\ntext[/INST]`, or `text</s>` for an assistant.  Inside
texts and roles a backslash is doubled and a control string gets one single backslash after its bracket,
which no doubled text can hold, so reading back is exact.

Defined results: null text and null role are empty, equal turns are ordered by role, then text; repeated
rows count as turns of their own; null conv_id is a conversation like any other; an empty table gives no
rows; other columns are ignored.  A conversation is one row of the output by contract (its digest runs
over all its turns), so its turns meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"(\[|<)(/?(?:INST\]|s>))"
MARKED = r"(\[|<)\\(/?(?:INST\]|s>))"
TURN = r"(?s)\[INST\].*?\[/INST\]|.*?</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, MARKED, "$1$2"), F.lit("\\\\"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def token_count(text: Column) -> Column:
    """Words and single marks, and three for the turn's own markers."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")) + 3


def format_conversations(turns: DataFrame, budget: int = 1024, history: int = 2, history_share: float = 0.25) -> DataFrame:
    """Rows (conv_id, window, n_repeated, formatted, loss: array<struct<start, length>>, tokens)."""
    rows = turns.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", token_count(F.col("text")))
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "tokens"))).alias("turns"))
    conv = conv.withColumn("system", F.get("turns", F.lit(0))["role"] == "system")
    conv = conv.withColumn("lead", F.when(F.col("system"), F.get("turns", F.lit(0))["tokens"]).otherwise(0))
    tok = lambda i: F.get(F.col("turns"), i)["tokens"]
    first = F.when(F.col("system"), 1).otherwise(0)  # index of the first turn that may be repeated as history

    def opened(i):
        """History for a window that begins with turn i: the longest run of turns before it within its share."""
        h, used = F.lit(0), F.lit(0)
        for back in range(1, history + 1):
            more = F.coalesce(tok(i - back), F.lit(0))
            ok = (h == back - 1) & (i - back >= first) & (used + more <= int(budget * history_share)) & (F.col("lead") + used + more + tok(i) <= budget)
            h, used = F.when(ok, back).otherwise(h), F.when(ok, used + more).otherwise(used)
        return F.struct(i.alias("start"), h.alias("history"), (F.col("lead") + used + tok(i)).alias("used"))

    def step(acc, i):
        now = F.element_at(acc, -1)
        fits = now["used"] + tok(i) <= budget
        grown = F.struct(now["start"].alias("start"), now["history"].alias("history"), (now["used"] + tok(i)).alias("used"))
        alone = F.col("system") & (i == 1) & (now["start"] == 0)  # a system turn never stands alone before its first turn
        return F.when(fits | alone, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(opened(i))))

    begin = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("history"), tok(F.lit(0)).alias("used")))
    later = F.when(F.size("turns") > 1, F.sequence(F.lit(1), F.size("turns") - 1)).otherwise(F.array().cast("array<int>"))
    conv = conv.withColumn("windows", F.aggregate(later, begin, step))
    conv = conv.withColumn("windows", F.transform("windows", lambda w, k: F.struct(w["start"].alias("start"), F.coalesce(F.get(F.col("windows"), k + 1)["start"], F.size("turns")).alias("end"), w["history"].alias("history"), w["used"].alias("used"))))
    one = conv.select("conv_id", "turns", "system", F.posexplode("windows").alias("window", "w"))
    lead = F.when(F.col("system") & (F.col("w.start") > 0), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))
    past = F.slice(F.col("turns"), F.col("w.start") - F.col("w.history") + 1, F.col("w.history"))
    one = one.select("conv_id", "window", F.col("w.used").alias("tokens"), F.concat(lead, past).alias("old"), F.slice(F.col("turns"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("new"))
    loss = lambda t, new: (t["role"] == "assistant") & new
    piece = lambda t, new: F.struct(
        F.when(t["role"] == "assistant", F.lit("")).otherwise(F.concat(F.lit("[INST]"), _escape_role(t["role"]), F.lit("\n"))).alias("head"),
        escape(t["text"]).alias("body"),
        F.when(t["role"] == "assistant", F.lit("</s>")).otherwise(F.lit("[/INST]")).alias("tail"),
        loss(t, new).alias("loss"),
    )
    one = one.select("conv_id", "window", "tokens", F.size("old").alias("n_repeated"), F.concat(F.transform("old", lambda t: piece(t, F.lit(False))), F.transform("new", lambda t: piece(t, F.lit(True)))).alias("pieces"))

    def spans(acc, p):
        at = acc["at"] + F.char_length(p["head"])
        end = at + F.char_length(p["body"])
        mine = F.when(p["loss"], F.array(F.struct(at.alias("start"), (end - at).alias("length")))).otherwise(none)
        return F.struct((end + F.char_length(p["tail"])).alias("at"), F.concat(acc["out"], mine).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<start:int,length:int>>")
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), ""))
    return one.select("conv_id", "window", "tokens", "n_repeated", formatted.alias("formatted"), F.aggregate("pieces", F.struct(F.lit(3).alias("at"), none.alias("out")), spans)["out"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: its turns without the repeated ones, and the text under the loss mask."""

    def turn(m):
        inner = F.substring(m, F.lit(7), F.char_length(m) - 13)
        head = F.substring_index(inner, "\n", 1)
        role = F.when(m.startswith("[INST]"), _unescape_role(head)).otherwise(F.lit("assistant"))
        text = F.when(m.startswith("[INST]"), F.substring(inner, F.char_length(head) + 2, F.char_length(inner))).otherwise(F.substring(m, F.lit(1), F.char_length(m) - 4))
        return F.concat(role, F.lit("\n"), unescape(text), F.lit("\n"))

    body = F.substring(F.col("formatted"), F.lit(4), F.char_length("formatted"))
    found = F.regexp_extract_all(body, F.lit(TURN), F.lit(0))
    own = F.transform(F.slice(found, F.col("n_repeated") + 1, F.size(found)), turn)
    learnt = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    each = formatted.select("conv_id", "window", own.alias("turns"), F.array_join(learnt, "").alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    conv = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, all_loss = F.flatten(F.transform("w", lambda x: x["turns"])), F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return conv.select("conv_id", turns.alias("turns"), all_loss.alias("loss"), "formatted_chars")


def digest(conversations: DataFrame, budget: int = 1024, history: int = 2) -> DataFrame:
    back = read_back(format_conversations(conversations, budget, history))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars",
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations plus conversation -7, whose texts hold the template's control strings."""
    said = "</s>[INST] ok [/INST]"
    turn = F.col("id")
    probe = conversations.sparkSession.range(2).select(F.lit(-7).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).unionByName(probe)
