"""Documents with external models around them: outlines, page edits, cross-page fixes, footnotes, spelling and their messages (E, M04, M12, M14 to M16, X13, X14, J07, J12, N17).

What a model says comes in as a table (the provider), so the dataflow around it is ordinary joins, folds and projections.
A provider's rows have a kind: edits, a note, a rewrite, or an error, which leaves its page or document as it was.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.blocks import normal_form, with_normal_form
from folio.functions.matching import MANY_PAIRS, best_matches, places_of, ratio_at_least
from folio.functions.pdf import objects
from folio.operators.cleanup import apply_edits, prose_of_text
from folio.operators.outline import IN_PAGE, LINE, best_in_page, flag_spelling, spelling_places
from folio.plans.catalog import Catalog
from folio.sources.tables import stored, table

CATALOG = Catalog()

# Superscript digits; what may follow a footnote's marker; what ends a cut text; limits of notes and searches.
SUPERSCRIPTS = "⁰¹²³⁴⁵⁶⁷⁸⁹"
AFTER_MARKER = r"(?:\s|[,;.)\]]|$)"
#: White space but line ends and the blank itself, as (?U)[\\s\\x1c-\\x1f] has it.
BLANKS = r"\t\x0B\f\r\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BODY, BODY_LINE, MARKER_CONTEXTS = 0.6, 0.5, 3


def cut(x: Column, most: int = 200) -> Column:
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def conversation_pages(spark, sf_dir) -> DataFrame:
    """Conversations as paged documents (conv_id, page, role, markdown), each page under a heading of level 1 to 3."""
    page = (F.col("turn") + 1).cast("int")
    md = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 1).cast("int")), F.lit(" "), F.col("role"), F.lit(" "), page.cast("string"), F.lit("\n\n"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", page.alias("page"), "role", md.alias("markdown"))


PAGES_SQL = "SELECT conv_id, turn, CAST(turn + 1 AS INTEGER) AS page, role, text, repeat('#', CAST(turn % 3 + 1 AS INTEGER)) || ' ' || role || ' ' || (turn + 1) || chr(10) || chr(10) || text AS md FROM conversations"


# --- outline: what the structure model says, page after page ---------------------------------------------------------------


def structure_outline(pages: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The outline (key, ord, page, level, text) of the pages that the model answered, in page order; a page that failed is skipped.

    answers: key, page, error, headings array<struct<level, text>>.
    """
    ok = pages.select(key, "page").join(answers.where("error IS NULL"), [key, "page"]).select(key, "page", F.posexplode("headings").alias("n", "h"))
    return ok.select(key, (F.row_number().over(W.partitionBy(key).orderBy("page", "n")) - 1).alias("ord"), "page", "h.level", "h.text")


def structure_answers(spark, sf_dir) -> DataFrame:
    """The provider of E01: the level that a role stands for; every seventh page of a conversation's id plus page fails."""
    p = conversation_pages(spark, sf_dir)
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return p.select("conv_id", "page", F.when((F.col("conv_id") + F.col("page")) % 7 == 0, "timeout").alias("error"), F.array(F.struct(level.alias("level"), F.concat("role", F.lit(" "), F.col("page").cast("string")).alias("text"))).alias("headings"))


OUTLINE_SQL = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord, turn + 1 AS page, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, role || ' ' || (turn + 1) AS text FROM conversations WHERE (conv_id + turn + 1) % 7 <> 0"


@CATALOG.add("e01", OUTLINE_SQL)
def outlines(spark, sf_dir):
    return structure_outline(conversation_pages(spark, sf_dir), structure_answers(spark, sf_dir), "conv_id")


def reconcile(outline: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """The whole outline of a document is replaced by the model's, if it gave one.

    answers: key, error, entries array<struct<level, text, page>>.
    """
    good = answers.where("error IS NULL")
    new = good.select(key, F.posexplode("entries").alias("ord", "e")).select(key, "ord", "e.page", "e.level", "e.text")
    return outline.join(good.select(key), key, "left_anti").select(key, "ord", "page", "level", "text").unionByName(new)


def outline_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Headings whose level the reconciliation changed, by text and page; of repeated ones in the old outline the last counts."""
    last = old.groupBy(key, "text", "page").agg(F.max_by("level", "ord").alias("old_level"))
    return new.join(last, [key, "text", "page"]).where("level <> old_level").select(key, "page", "text", "old_level", F.col("level").alias("new_level"))


def reconciliation_answers(outline: DataFrame, key: str) -> DataFrame:
    """The provider of E02: no heading more than one level below the one before; every fifth document fails."""
    before = F.coalesce(F.lag("level").over(W.partitionBy(key).orderBy("ord")), F.lit(0))
    x = outline.withColumn("new", F.least("level", before + 1))
    x = x.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("new").alias("level"), "text", "page"))).alias("e"))
    return x.select(key, F.when(F.col(key) % 5 == 0, "timeout").alias("error"), F.transform("e", lambda v: F.struct(v["level"].alias("level"), v["text"].alias("text"), v["page"].alias("page"))).alias("entries"))


RECONCILED_SQL = f"SELECT conv_id, ord, page, CASE WHEN conv_id % 5 = 0 THEN level ELSE least(level, coalesce(lag(level) OVER (PARTITION BY conv_id ORDER BY ord), 0) + 1) END AS level, level AS was, text FROM ({OUTLINE_SQL})"


@CATALOG.add("e02", f"SELECT conv_id, ord, page, level, text FROM ({RECONCILED_SQL})")
def reconciled(spark, sf_dir):
    o = structure_outline(conversation_pages(spark, sf_dir), structure_answers(spark, sf_dir), "conv_id")
    return reconcile(o, reconciliation_answers(o, "conv_id"), "conv_id")


@CATALOG.add("j12", f"SELECT conv_id, page, text, was + 10 AS old_level, level AS new_level FROM ({RECONCILED_SQL}) WHERE level <> was + 10")
def outline_differences(spark, sf_dir):
    """J12 with every old entry twice, the second ten levels deeper, so that the last duplicate decides."""
    o = structure_outline(conversation_pages(spark, sf_dir), structure_answers(spark, sf_dir), "conv_id")
    twice = o.unionByName(o.withColumns({"ord": F.col("ord") + 1000, "level": F.col("level") + 10}))
    return outline_changes(twice, reconcile(o, reconciliation_answers(o, "conv_id"), "conv_id"), "conv_id")


def heading_levels(pages: DataFrame, outline: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pages, changes): each heading line takes the level of the outline entry of its page that is most like it (J05, lower case, 0.8 at least).

    pages: key, page, markdown; outline: key, page, ord, level, text.  Unchanged pages keep their text; changes log the lines and the reason.
    """
    lines = pages.select(key, "page", F.posexplode(F.split("markdown", "\n", -1)).alias("n", "line"))
    heads = lines.where(F.col("line").rlike(T.HEADING)).select(key, "page", F.col("n").alias("h"), F.lower(T.strip(F.regexp_extract("line", T.HEADING, 2))).alias("text"))
    entries = outline.select(key, "page", F.col("ord").alias("o"), F.lower("text").alias("title"), F.col("level").alias("to"), F.col("text").alias("entry"))
    found = best_in_page(heads, entries, [key, "page"], IN_PAGE).select(key, "page", F.col("h").alias("n"), "to", "entry", "ratio")
    was = F.length(F.regexp_extract("line", T.HEADING, 1))
    x = lines.join(found, [key, "page", "n"], "left").withColumn("was", was)
    new = F.concat(F.expr("repeat('#', to)"), F.lit(" "), T.strip(F.regexp_extract("line", T.HEADING, 2)))
    x = x.withColumn("new", F.when(F.col("to").isNotNull() & (F.col("to") != F.col("was")), new).otherwise(F.col("line")))
    reason = F.format_string('Outline says "%s" is level %d (was %s = level %d, match %.0f%%)', "entry", "to", F.expr("repeat('#', was)"), "was", F.col("ratio") * 100)
    changes = x.where("new <> line").select(key, "page", "n", F.col("line").alias("old_text"), F.col("new").alias("new_text"), reason.alias("reasoning"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "new"))), lambda v: v["new"]), "\n")
    return x.groupBy(key, "page").agg(text.alias("markdown")), changes


@CATALOG.add("m04")
def relevelled(spark, sf_dir):
    p = conversation_pages(spark, sf_dir)
    o = structure_outline(p, structure_answers(spark, sf_dir), "conv_id").withColumn("text", F.concat("text", F.lit(".")))
    return heading_levels(p, o, "conv_id")[1]


# --- edits: what the page and document models say --------------------------------------------------------------------------


def correct_pages(pages: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Pages (key, page, markdown, layout) with `edited`, `changes`, `issues`.

    answers: key, page, ord, kind, search, replace, note, confidence.  `edit` is E05's fold; `none` states that nothing needs to
    change, its note is an issue; `rewrite` replaces the whole page, on posters only and not with a blank text, its log is cut to
    200 characters; `error` keeps the page, with an issue, whatever else was said.
    """
    k = [key, "page"]
    fails = answers.where("kind = 'error'").groupBy(*k).agg(F.first("note").alias("failure"))
    notes = answers.where("kind = 'none' AND coalesce(note, '') <> ''").groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("ord", "confidence", "note"))).alias("notes"))
    new = answers.where("kind = 'rewrite'").groupBy(*k).agg(F.max_by("replace", "ord").alias("whole"))
    x = pages.join(fails, k, "left").join(notes, k, "left").join(new, k, "left")
    whole = F.when((F.col("layout") == "poster") & (T.strip(F.coalesce("whole", F.lit(""))) != ""), F.col("whole"))
    x = x.withColumn("start", F.coalesce(whole, "markdown"))
    x = apply_edits(x, answers.where("kind = 'edit'").select(*k, "ord", "search", "replace"), k, "start")
    logged = F.when(F.col("start") != F.col("markdown"), F.struct(cut(F.col("markdown")).alias("old_text"), cut(F.col("start")).alias("new_text")))
    failed = F.col("failure").isNotNull()
    issues = F.concat(
        F.when(failed, F.array(F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" failed: "), "failure"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("notes", lambda n: F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" ("), n["confidence"], F.lit("): "), n["note"])), F.array().cast("array<string>")),
        F.when((F.col("layout") == "poster") & F.col("whole").isNotNull() & (T.strip(F.coalesce("whole", F.lit(""))) == ""), F.array(F.lit("ERROR: new_markdown is empty."))).otherwise(F.array().cast("array<string>")),
    )
    return x.select(*k, F.when(failed, F.col("markdown")).otherwise(F.col("edited")).alias("edited"), F.when(failed, 0).otherwise(F.size("applied") + logged.isNotNull().cast("int")).alias("changes"), F.when(~failed, logged).alias("rewrite"), issues.alias("issues"))


def page_answers(spark, sf_dir) -> DataFrame:
    """The provider of E03: adds a letter to the first word of a page's text; notes on pages 2, a rewrite for page 3, a failure every fifth page."""
    p = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), "text")
    word = F.get(F.split("text", " "), F.lit(0))
    none = F.lit(None).cast("string")
    rows = [
        (F.lit(True), 1, "edit", word, F.concat(word, F.lit("Q")), none, none),
        (F.col("page") == 2, 2, "none", none, none, F.lit("check the table"), F.lit("medium")),
        (F.col("page") == 3, 3, "rewrite", none, F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" rewritten"))).otherwise("  "), none, none),
        ((F.col("conv_id") + F.col("page")) % 5 == 0, 4, "error", none, none, F.lit("timeout"), none),
    ]
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(o).alias("ord"), F.lit(k).alias("kind"), s.alias("search"), r.alias("replace") if isinstance(r, Column) else F.lit(r).alias("replace"), n.alias("note"), q.alias("confidence"))) for c, o, k, s, r, n, q in rows]))
    return p.select("conv_id", "page", F.explode(each).alias("a")).select("conv_id", "page", "a.*")


def corrected(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).cast("int").alias("page"), F.col("text").alias("markdown"), F.when(F.col("conv_id") % 3 == 0, "poster").otherwise("single_column").alias("layout"))
    return correct_pages(pages, page_answers(spark, sf_dir), "conv_id")


CORRECTED_SQL = """SELECT *, CASE WHEN fail THEN text WHEN n = 1 THEN replace(start, w, w || 'Q') ELSE start END AS edited, CASE WHEN NOT fail AND n = 1 THEN 1 ELSE 0 END + CASE WHEN NOT fail AND start <> text THEN 1 ELSE 0 END AS changes
    FROM (SELECT *, CASE WHEN w = '' THEN 0 ELSE (length(start) - length(replace(start, w, ''))) // length(w) END AS n FROM (SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, text, string_split(text, ' ')[1] AS w, (conv_id + turn + 1) % 5 = 0 AS fail, conv_id % 3 = 0 AS poster,
    CASE WHEN conv_id % 3 = 0 AND turn = 2 AND conv_id % 2 = 0 THEN text || ' rewritten' ELSE text END AS start FROM conversations))"""


@CATALOG.add("e03", f"SELECT conv_id, page, changes, md5(edited) AS digest FROM ({CORRECTED_SQL}) WHERE NOT fail")
def corrected_pages(spark, sf_dir):
    """Pages that were corrected, with the number of changes."""
    return corrected(spark, sf_dir).where("NOT exists(issues, i -> i LIKE '% failed: %')").select("conv_id", "page", "changes", F.md5("edited").alias("digest"))


@CATALOG.add("e04", f"SELECT conv_id, page, CASE WHEN fail THEN 'Page ' || page || ' failed: timeout' END AS failure, md5(edited) AS digest FROM ({CORRECTED_SQL})")
def fanned_out(spark, sf_dir):
    """All pages of the next version; a page whose correction failed keeps its text, with an issue."""
    return corrected(spark, sf_dir).select("conv_id", "page", F.get(F.filter("issues", lambda i: F.contains(i, F.lit(" failed: "))), F.lit(0)).alias("failure"), F.md5("edited").alias("digest"))


@CATALOG.add("e06", f"SELECT conv_id, page, 'Page 2 (medium): check the table' AS issue FROM ({CORRECTED_SQL}) WHERE page = 2")
def notes(spark, sf_dir):
    """Notes of pages that need no change."""
    return corrected(spark, sf_dir).select("conv_id", "page", F.explode("issues").alias("issue")).where("issue LIKE 'Page % (%): %'")


@CATALOG.add("e07", f"SELECT conv_id, page, CASE WHEN start <> text AND NOT fail THEN CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END END AS old_text, CASE WHEN start <> text AND NOT fail THEN CASE WHEN length(start) > 200 THEN substr(start, 1, 200) || '...' ELSE start END END AS new_text, poster AND page = 3 AND conv_id % 2 <> 0 AS refused FROM ({CORRECTED_SQL})")
def rewrites(spark, sf_dir):
    """Whole pages are rewritten on posters only, never with nothing; the log is cut."""
    return corrected(spark, sf_dir).select("conv_id", "page", "rewrite.old_text", "rewrite.new_text", F.array_contains("issues", "ERROR: new_markdown is empty.").alias("refused"))


def figure_instructions(figures: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, message, instruction): what the describer is asked about a figure, and what its answer tells the page model to do.

    figures: keys, ref_id, caption, has_crop, markdown; answers: keys, ref_id, error, is_decorative, alt_text.  The message has the caption,
    200 characters on either side of the reference, and a note if the crop is missing.
    """
    ref = F.concat(F.lit("figures/"), "ref_id")
    p = F.instr("markdown", ref)
    around = F.when(p > 0, F.expr("substring(markdown, greatest(instr(markdown, concat('figures/', ref_id)) - 200, 1), least(instr(markdown, concat('figures/', ref_id)) - 1, 200) + length(ref_id) + 8 + 200)")).otherwise("")
    asks = "Say what kind of image this is and write its alt text; none if it only decorates."
    lacks = F.concat(F.lit("There is no crop, only the page: describe '"), "ref_id", F.lit("' and nothing else.\n"))
    message = F.array_join(F.array_compact(F.array(
        F.concat(F.lit("# Figure "), "ref_id", F.lit("\n")), F.when(F.coalesce("caption", F.lit("")) != "", F.concat(F.lit("Caption: "), "caption", F.lit("\n"))),
        F.when(around != "", F.concat(F.lit("Around it:\n```\n"), around, F.lit("\n```\n"))), F.when(~F.col("has_crop"), lacks), F.lit(asks),
    )), "\n")
    says = F.when(F.col("error").isNotNull() | F.col("is_decorative").isNull(), F.concat(F.lit("ERROR: no description of '"), "ref_id", F.lit("': "), F.coalesce("error", F.lit("no answer")))).when(F.col("is_decorative"), F.concat(F.lit("Figure '"), "ref_id", F.lit("' only decorates: keep its alt text empty."))).otherwise(F.concat(F.lit("Alt text of '"), "ref_id", F.lit("': "), "alt_text", F.lit("\nPut it in by str_replace.")))
    return figures.withColumn("message", message).join(answers, [*keys, "ref_id"], "left").select(*keys, "ref_id", "message", says.alias("instruction"))


@CATALOG.add("e08", """SELECT conv_id, turn, r AS ref_id, '# Figure ' || r || chr(10) || chr(10) || CASE WHEN role <> 'user' THEN 'Caption: ' || role || chr(10) || chr(10) ELSE '' END || 'Around it:' || chr(10) || '```' || chr(10) || substr(md, greatest(p - 200, 1), least(p - 1, 200) + length(r) + 208) || chr(10) || '```' || chr(10) || chr(10)
    || CASE WHEN turn % 2 = 1 THEN 'There is no crop, only the page: describe ''' || r || ''' and nothing else.' || chr(10) || chr(10) ELSE '' END
    || 'Say what kind of image this is and write its alt text; none if it only decorates.' AS message,
    CASE turn % 3 WHEN 0 THEN 'Figure ''' || r || ''' only decorates: keep its alt text empty.' WHEN 1 THEN 'Alt text of ''' || r || ''': a ' || role || chr(10) || 'Put it in by str_replace.' ELSE 'ERROR: no description of ''' || r || ''': busy' END AS instruction
    FROM (SELECT *, strpos(md, 'figures/' || r) AS p FROM (SELECT *, 'figure-' || (turn + 1) || '.png' AS r, text || ' ![](figures/figure-' || (turn + 1) || '.png) ' || text AS md FROM conversations))""")
def described_figures(spark, sf_dir):
    ref = F.concat(F.lit("figure-"), (F.col("turn") + 1).cast("string"), F.lit(".png"))
    c = table(spark, sf_dir, "conversations").withColumn("ref_id", ref)
    figures = c.select("conv_id", "turn", "ref_id", F.when(F.col("role") != "user", F.col("role")).alias("caption"), (F.col("turn") % 2 == 0).alias("has_crop"), F.concat("text", F.lit(" ![](figures/"), "ref_id", F.lit(") "), "text").alias("markdown"))
    k = F.col("turn") % 3
    answers = c.select("conv_id", "turn", "ref_id", F.when(k == 2, "busy").alias("error"), (k == 0).alias("is_decorative"), F.concat(F.lit("a "), "role").alias("alt_text"))
    return figure_instructions(figures, answers, ["conv_id", "turn"])


def rebuilt_instructions(items: DataFrame, answers: DataFrame, keys: list[str], what: str) -> DataFrame:
    """What the rebuilt table or list tells the page model to do: replace the old text (keys, number, old) with the new one, in
    markdown, or in HTML where the answer says so; without an answer the text stays."""
    x = items.join(answers, [*keys, "number"], "left")
    name = F.concat(F.lit(f"{what} "), F.col("number").cast("string"))
    says = F.when(F.col("error").isNotNull() | F.col("new").isNull(), F.concat(F.lit("ERROR: "), name, F.lit(" was not rebuilt: "), F.coalesce("error", F.lit("no answer")))).otherwise(F.concat(F.lit("Replace "), name, F.lit(" with this "), F.when(F.coalesce("as_html", F.lit(False)), "HTML").otherwise("markdown"), F.lit(":\n"), "new"))
    return x.select(*keys, "number", says.alias("instruction"))


def _rebuilt(spark, sf_dir, what: str, old: Column, new: Column) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("number", F.col("turn") + 1)
    answers = c.where("turn % 4 <> 3").select("conv_id", "number", F.when(F.col("turn") % 4 == 2, "timeout").alias("error"), (F.col("turn") % 2 == 1).alias("as_html"), new.alias("new"))
    return rebuilt_instructions(c.select("conv_id", "number", old.alias("old")), answers, ["conv_id"], what)


_REBUILT_SQL = "SELECT conv_id, turn + 1 AS number, CASE turn % 4 WHEN 3 THEN 'ERROR: {what} ' || (turn + 1) || ' was not rebuilt: no answer' WHEN 2 THEN 'ERROR: {what} ' || (turn + 1) || ' was not rebuilt: timeout' ELSE 'Replace {what} ' || (turn + 1) || ' with this ' || CASE WHEN turn % 2 = 1 THEN 'HTML' ELSE 'markdown' END || ':' || chr(10) || {new} END AS instruction FROM conversations"


@CATALOG.add("e09", _REBUILT_SQL.format(what="Table", new="'| ' || role || ' |' || chr(10) || '|---|'"))
def rebuilt_tables(spark, sf_dir):
    return _rebuilt(spark, sf_dir, "Table", F.concat(F.lit("|"), "role", F.lit("|")), F.concat(F.lit("| "), "role", F.lit(" |\n|---|")))


@CATALOG.add("e10", _REBUILT_SQL.format(what="List", new="'- ' || role || chr(10) || '- end'"))
def rebuilt_lists(spark, sf_dir):
    return _rebuilt(spark, sf_dir, "List", F.concat(F.lit("* "), "role"), F.concat(F.lit("- "), "role", F.lit("\n- end")))


def across_pages(pages: DataFrame, boundary: DataFrame, footnote: DataFrame, key: str) -> DataFrame:
    """(key, v2, joins, boundary_fixes, footnotes): pages joined in order, hyphens across joints closed and counted, then the
    edits of the boundary model, then those of the footnote model (key, ord, search, replace), each by E05."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "markdown"))), lambda v: v["markdown"]), "\n\n")
    x = pages.groupBy(key).agg(whole.alias("v1"))
    x = x.withColumns({"joins": F.regexp_count("v1", F.lit("([a-z])-\n\n([a-z])")), "joined": T.join_hyphens(F.col("v1"))})
    x = apply_edits(x, boundary, [key], "joined").withColumnsRenamed({"edited": "fixed", "applied": "fixes", "errors": "fix_errors"})
    x = apply_edits(x, footnote, [key], "fixed")
    return x.select(key, F.col("edited").alias("v2"), "joins", F.size("fixes").alias("boundary_fixes"), F.size("applied").alias("footnotes"))


def _document_edits(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    pages = c.select("conv_id", (F.col("turn") + 1).alias("page"), F.concat(F.lit("p"), (F.col("turn") + 1).cast("string"), F.lit("# "), "text", F.lit(" word-")).alias("markdown"))
    pages = pages.withColumn("markdown", F.when(F.col("page") > 1, F.concat(F.lit("part "), "markdown")).otherwise(F.col("markdown")))
    ids = c.select("conv_id").distinct()
    edit = lambda n, a, b: ids.select("conv_id", F.lit(n).alias("ord"), F.lit(a).alias("search"), F.lit(b).alias("replace"))
    return pages, edit(1, "p1# ", "").unionByName(edit(2, "p2# ", "")), edit(1, "p3# ", "[^3] ")


_WHOLE_SQL = "SELECT conv_id, count(*) AS n, regexp_replace(string_agg(CASE WHEN turn > 0 THEN 'part ' ELSE '' END || 'p' || (turn + 1) || '# ' || text || ' word-', chr(10) || chr(10) ORDER BY turn), '([a-z])-\\n\\n([a-z])', '\\1\\2', 'g') AS v, len(regexp_extract_all(string_agg(CASE WHEN turn > 0 THEN 'part ' ELSE '' END || 'p' || (turn + 1) || '# ' || text || ' word-', chr(10) || chr(10) ORDER BY turn), '[a-z]-\\n\\n[a-z]')) AS joins FROM conversations GROUP BY conv_id"


@CATALOG.add("e11", f"SELECT conv_id, CASE WHEN n >= 2 THEN 2 ELSE 1 END AS boundary_fixes FROM ({_WHOLE_SQL})")
def boundary_fixes(spark, sf_dir):
    """Edits of the boundary model that were there exactly once."""
    return across_pages(*_document_edits(spark, sf_dir), "conv_id").select("conv_id", "boundary_fixes")


@CATALOG.add("e12", f"SELECT conv_id, CASE WHEN n >= 3 THEN 1 ELSE 0 END AS footnotes FROM ({_WHOLE_SQL})")
def footnote_moves(spark, sf_dir):
    """Edits of the footnote model that were there exactly once."""
    return across_pages(*_document_edits(spark, sf_dir), "conv_id").select("conv_id", "footnotes")


@CATALOG.add("e13", f"SELECT conv_id, joins, md5(replace(replace(replace(v, 'p1# ', ''), 'p2# ', ''), 'p3# ', '[^3] ')) AS v2 FROM ({_WHOLE_SQL})")
def second_version(spark, sf_dir):
    return across_pages(*_document_edits(spark, sf_dir), "conv_id").select("conv_id", "joins", F.md5("v2").alias("v2"))


#: Tier to model by backend: ids are settings, not facts of the engine.
MODELS = [("gateway", "reasoning", "gateway.large"), ("gateway", "efficient", "gateway.small"), ("direct", "reasoning", "large"), ("direct", "efficient", "small")]


@CATALOG.add("e15", "SELECT r_regionkey, CASE WHEN r_regionkey = 4 THEN 'error: unknown tier' ELSE CASE WHEN r_regionkey % 2 = 0 THEN 'gateway.' ELSE '' END || CASE WHEN r_regionkey < 2 THEN 'large' ELSE 'small' END END AS model FROM region")
def tiers(spark, sf_dir):
    """Tier and backend to model id, by a join with the table of models; an unknown pair is an error value."""
    models = spark.createDataFrame(MODELS, "backend string, tier string, model string")
    k = F.col("r_regionkey")
    asks = table(spark, sf_dir, "region").select("r_regionkey", F.when(k % 2 == 0, "gateway").otherwise("direct").alias("backend"), F.when(k < 2, "reasoning").when(k < 4, "efficient").otherwise("free").alias("tier"))
    return asks.join(F.broadcast(models), ["backend", "tier"], "left").select("r_regionkey", F.coalesce("model", F.lit("error: unknown tier")).alias("model"))


def pdf_metadata(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Metadata of PDF files (binary) from their objects, those in compressed object streams included: version, producer, creator, title,
    tagged, form type, form fields, pages and their sizes, or an error for what is encrypted or no PDF; `whole` is false where an object
    stream could not be read.  Texts in hexadecimal or with escapes are as they stand; a page's size is its own, or its parents' where it has none.
    """
    files = files.withColumn("__pdf", objects(F.col(content)))
    t = F.col("__pdf.text")
    name = lambda n: F.nullif(F.regexp_extract(t, rf"/{n}\s*\(([^)]*)\)", 1), F.lit(""))
    boxes = F.regexp_extract_all(t, F.lit(r"/MediaBox\s*\[\s*[-0-9.]+\s+[-0-9.]+\s+([-0-9.]+\s+[-0-9.]+)\s*\]"), F.lit(1))
    size = lambda b, i: F.round(F.get(F.split(b, r"\s+"), F.lit(i)).cast("double"), 1)
    form = F.when(F.contains(t, F.lit("/XFA")), 2).when(F.contains(t, F.lit("/AcroForm")), 1).otherwise(0)
    return files.select(
        key, F.when(~t.startswith("%PDF-"), "Data format error").when(F.contains(t, F.lit("/Encrypt")), "Incorrect password error").alias("error"), F.regexp_extract(t, r"^%PDF-(\d\.\d)", 1).alias("pdf_version"), name("Producer").alias("producer"), name("Creator").alias("creator"), name("Title").alias("title"),
        t.rlike(r"/Marked\s+true").alias("is_tagged"), form.alias("form_type"), F.regexp_count(t, F.lit(r"/Subtype\s*/Widget\b")).alias("form_field_count"), F.regexp_count(t, F.lit(r"/Type\s*/Page\b(?!s)")).alias("page_count"), F.transform(boxes, lambda b: F.struct(size(b, 0).alias("w"), size(b, 1).alias("h"))).alias("page_dimensions"), F.col("__pdf.whole").alias("whole"),
    )


@CATALOG.add("e16", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Data format error' WHEN page_id % 7 = 0 THEN 'Incorrect password error' END AS error, CASE WHEN page_id % 5 = 0 THEN '' ELSE '1.7' END AS pdf_version, 'maker ' || page_id AS producer, page_id % 3 + 1 AS page_count, page_id % 2 AS form_field_count, page_id % 2 AS form_type, (page_id % 3 + 1) * 612.0 AS widths FROM pages")
def metadata_of_files(spark, sf_dir):
    k = F.col("page_id").cast("int")
    page = F.lit("2 0 obj << /Type /Page /MediaBox [0 0 612.04 792] >> endobj\n")
    body = F.concat(F.when(k % 5 == 0, "no PDF ").otherwise("%PDF-1.7\n"), F.lit("1 0 obj << /Type /Pages >> endobj\n"), F.repeat(page, k % 3 + 1), F.lit("3 0 obj << /Producer (maker "), k.cast("string"), F.lit(") >>\n"), F.when(k % 2 == 1, "<< /AcroForm 4 0 R >> << /Subtype /Widget >>\n").otherwise(""), F.when(k % 7 == 0, "/Encrypt 5 0 R").otherwise(""))
    m = pdf_metadata(table(spark, sf_dir, "pages").select("page_id", F.encode(body, "ISO-8859-1").alias("content")), "page_id")
    return m.select("page_id", "error", "pdf_version", "producer", "page_count", "form_field_count", "form_type", F.aggregate("page_dimensions", F.lit(0.0), lambda a, d: a + d["w"]).alias("widths"))


def retries(attempts: DataFrame, key: str, most: int = 3, base: float = 1.0, factor: float = 2.0, cap: float = 30.0) -> DataFrame:
    """(key, attempts, succeeded, waited) from a log of attempts (key, n from 1, ok, retryable): tried until one succeeds, one fails for
    good, or `most` were made; the waits between them grow by `factor` up to `cap`."""
    w = W.partitionBy(key).orderBy("n")
    over = F.max((F.col("ok") | ~F.col("retryable")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, -1))
    made = attempts.withColumn("over", F.coalesce(over, F.lit(0))).where((F.col("over") == 0) & (F.col("n") <= most))
    wait = F.when(F.col("n") > 1, F.least(F.lit(base) * F.pow(F.lit(factor), F.col("n") - 2), F.lit(cap))).otherwise(0.0)
    return made.groupBy(key).agg(F.count("*").alias("attempts"), F.max("ok").alias("succeeded"), F.sum(wait).alias("waited"))


@CATALOG.add("e17", "SELECT user_id, count(*) AS attempts, bool_or(ok) AS succeeded, sum(CASE WHEN n > 1 THEN least(1.0 * power(2.0, n - 2), 30.0) ELSE 0.0 END) AS waited FROM (SELECT *, coalesce(max(CASE WHEN ok OR NOT again THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_type = 'purchase' AS ok, event_type <> 'error' AS again FROM events)) WHERE done = 0 AND n <= 3 GROUP BY user_id")
def retried(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), (F.col("event_type") == "purchase").alias("ok"), (F.col("event_type") != "error").alias("retryable"))
    return retries(e, "user_id")


# --- footnotes --------------------------------------------------------------------------------------------------------------


def search_text(x: Column) -> Column:
    """Compatibility form, superscripts as digits, lower case, white space collapsed and stripped."""
    return F.btrim(F.regexp_replace(F.lower(F.translate(T.nfkc(x), SUPERSCRIPTS, "0123456789")), r"(?U)[\s\x1c-\x1f]+", " "))


def _search_lines(x: Column) -> Column:
    """search_text of each line, the text normalised as one."""
    one = F.regexp_replace(F.lower(F.translate(T.nfkc(x), SUPERSCRIPTS, "0123456789")), f" [ {BLANKS}]+|[{BLANKS}][ {BLANKS}]*", " ")
    return F.transform(F.split(one, "\n", -1), lambda v: F.btrim(v))


def footnote_places(docs: DataFrame, footnotes: DataFrame, key: str = "doc_id", column: str = "text", around: int = 3, many: int = MANY_PAIRS) -> DataFrame:
    """(key, number, n, strategy, context): the first line that begins with a footnote's number and is like the first 60 characters of its
    text (0.6 at least); else the line that is most like its first 80 (0.5 at least, lines of ten characters or more); with three lines on either side.

    footnotes: key, number, body_text.  Those that are found nowhere have no row.  A document meets its footnotes in its own row; where
    lines times footnotes exceed `many`, its lines become rows.
    """
    notes_ = footnotes.select(key, "number", search_text(F.col("body_text")).alias("body")).dropDuplicates([key, "number"])
    counts = docs.select(key, F.size(F.split(column, "\n", -1)).cast("long").alias("lines")).where("lines > 0").join(footnotes.groupBy(key).agg(F.count("*").alias("notes")), key)
    large = stored(counts.where(F.col("lines") * F.col("notes") > many).select(key), "large")
    if large.isEmpty():
        return _places_in_rows(docs, notes_, key, column, around)
    few, some = (lambda x: x.join(large, key, "left_anti")), (lambda x: x.join(large, key, "left_semi"))
    return _places_in_rows(few(docs), few(notes_), key, column, around).unionByName(_places_by_lines(some(docs), some(footnotes), key, column, around))


def _places_in_rows(docs: DataFrame, notes_: DataFrame, key: str, column: str, around: int) -> DataFrame:
    """footnote_places of documents whose lines and footnotes (key, number, body) are few enough to meet in one row."""
    own = notes_.groupBy(key).agg(F.collect_list(F.struct("number", "body")).alias("notes"))
    x = docs.select(key, F.col(column).alias("text")).join(own, key).withColumn("ls", F.split("text", "\n", -1))
    after = lambda s, f: F.substring(s, F.length(f["number"]) + 1, F.lit(1))
    begins = lambda s, f: F.startswith(s, f["number"]) & after(s, f).isin(" ", ".")
    skip = lambda s, f: F.length(f["number"]) + F.when((after(s, f) == ".") & (F.substring(s, F.length(f["number"]) + 2, F.lit(1)) == " "), 2).otherwise(1)
    rest = lambda s, f: T.strip(F.substring(s, skip(s, f) + 1, F.length(s)))
    at = lambda s, n: F.transform(F.filter("notes", lambda f: begins(s, f)), lambda f: F.struct(n.cast("long").alias("n"), f["number"].alias("number"), rest(s, f).alias("rest")))
    x = x.withColumn("s", F.transform("ls", T.strip)).withColumn("numbered", F.flatten(F.transform("s", at)))
    x = x.withColumns({"rests": _search_lines(F.array_join(F.transform("numbered", lambda v: v["rest"]), "\n")), "searched": _search_lines(F.col("text"))})

    def run(batches):  # noqa: ANN001
        for b in batches:
            found: list = []
            for row, (notes, ls, numbered, rests, searched) in enumerate(zip(*[b.column(c).to_pylist() for c in ("notes", "ls", "numbered", "rests", "searched")], strict=True)):
                if ls is None:
                    continue
                first: dict = {}
                for v, s in zip(numbered, rests, strict=False):  # without numbered lines the joined text is one empty line
                    first.setdefault(v["number"], []).append((v["n"], s[:60]))
                wide = [(n, s[:80]) for n, s in enumerate(searched) if len(s) >= 10]
                for f in notes:
                    hit = place_of_note(f["body"], first.get(f["number"], []), wide)
                    if hit:
                        lo, hi = max(hit[0] - around, 0), hit[0] + around + 1
                        found.append((row, f["number"], *hit, "\n".join(f"  L{lo + k + 1}: {v}" for k, v in enumerate(ls[lo:hi]))))
            rows, number, n, strategy, context = zip(*found, strict=True) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(rows, pa.int64())), pa.array(number, pa.string()), pa.array(n, pa.int64()), pa.array(strategy, pa.string()), pa.array(context, pa.string())], [key, "number", "n", "strategy", "context"])

    return x.select(key, "notes", "ls", "numbered", "rests", "searched").mapInArrow(run, f"`{key}` {x.schema[key].dataType.simpleString()}, number string, n long, strategy string, context string")


def place_of_note(body: str | None, numbered: list, wide: list) -> tuple[int, str] | None:
    """(line, strategy) of a footnote's text among the lines with its number, and among all: each (n, text), by n."""
    if not body:
        return None
    a, masks = body[:60], places_of(body[:60])
    for n, s in numbered:
        if s and ratio_at_least(masks, a, s, BODY) is not None:
            return n, "number"
    a, masks, best = body[:80], places_of(body[:80]), None
    for n, s in wide:
        r = ratio_at_least(masks, a, s, best[0] if best else BODY_LINE)
        if r is not None and (best is None or r > best[0]):
            best = r, n
    return (best[1], "text") if best else None


def _places_by_lines(docs: DataFrame, footnotes: DataFrame, key: str, column: str, around: int) -> DataFrame:
    """footnote_places of documents with many lines and footnotes: lines are rows, and pairs are met in cells or through the index."""
    lines = docs.select(key, F.posexplode(F.split(column, "\n", -1)).alias("n", "line")).withColumn("s", T.strip(F.col("line")))
    notes_ = footnotes.select(key, "number", search_text(F.col("body_text")).alias("body")).dropDuplicates([key, "number"])
    # a line that begins with a number of a document has one of these numbers' lengths before a blank or a dot
    sizes = notes_.groupBy(key).agg(F.collect_set(F.length("number")).alias("sizes"))
    begins = lines.join(sizes, key).select(key, "n", "s", F.explode("sizes").alias("size")).withColumn("next", F.expr("substring(s, size + 1, 1)")).where("next IN (' ', '.')").select(key, "n", "s", "next", F.expr("substring(s, 1, size)").alias("number"))
    x = begins.join(notes_, [key, "number"])
    after = F.length("number") + F.when((F.col("next") == ".") & F.expr("substring(s, length(number) + 2, 1) = ' '"), 2).otherwise(1)
    numbered = x.withColumn("after", after).withColumns({"a": F.substring("body", 1, 60), "b": F.substring(search_text(T.strip(F.expr("substring(s, after + 1)"))), 1, 60)})
    numbered = numbered.where((F.col("a") != "") & (F.col("b") != "") & (T.similarity_bound(F.col("a"), F.col("b")) >= BODY)).withColumn("ratio", T.similarity(F.col("a"), F.col("b"))).where(F.col("ratio") >= BODY)
    first = numbered.groupBy(key, "number").agg(F.min("n").cast("long").alias("n")).withColumn("strategy", F.lit("number"))
    rest = notes_.join(first, [key, "number"], "left_anti").select(key, "number", F.xxhash64("number").alias("h"), F.substring("body", 1, 80).alias("text"))
    wide = lines.join(rest.select(key).distinct(), key, "left_semi").withColumn("t", search_text(F.col("line"))).where(F.length("t") >= 10).select(key, F.col("n").cast("long").alias("o"), F.substring("t", 1, 80).alias("title"))
    best = best_matches(rest, wide, [key], BODY_LINE).join(rest, [key, "h"]).select(key, "number", F.col("o").alias("n"), F.lit("text").alias("strategy"))
    at = first.unionByName(best)
    lo, hi = F.greatest(F.col("n") - around, F.lit(0)), F.least(F.col("n") + around + 1, F.size("ls"))
    context = F.array_join(F.transform(F.slice("ls", lo + 1, hi - lo), lambda v, i: F.concat(F.lit("  L"), (lo + i + 1).cast("string"), F.lit(": "), v)), "\n")
    return at.join(docs.select(key, F.split(column, "\n", -1).alias("ls")), key).select(key, "number", "n", "strategy", context.alias("context"))


def footnotes_of_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents with a numbered line (even ids) or a plain one (odd), and their footnotes, slightly different."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    some = F.concat_ws(" ", F.slice(F.split(F.regexp_replace("text", r"\s+", " "), " "), 1, 12))
    line = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("12. "), some)).otherwise(F.concat(F.lit("see also "), some))
    docs = d.select("doc_id", F.concat("text", F.lit("\n"), line, F.lit("\nend")).alias("text"))
    return docs, d.select("doc_id", F.lit("12").alias("number"), F.concat(F.replace(some, F.lit("th"), F.lit("Th")), F.lit(" (p. 3)")).alias("body_text"))


@CATALOG.add("x13")
def footnote_bodies(spark, sf_dir):
    return footnote_places(*footnotes_of_documents(spark, sf_dir))


def footnote_markers(docs: DataFrame, footnotes: DataFrame, key: str = "doc_id", column: str = "text", around: int = 60) -> DataFrame:
    """(key, number, markers): up to three snippets around a letter that the footnote's number follows, in digits or one superscript, and then
    no digit but white space, a delimiter or the end."""
    up = F.when(F.length("number") == 1, F.translate("number", "0123456789", SUPERSCRIPTS))
    one = F.concat(F.lit("([a-zA-Z])(?:\\Q"), "number", F.lit("\\E"), F.coalesce(F.concat(F.lit("|"), up), F.lit("")), F.lit(r")(?!\d)" + AFTER_MARKER))
    x = docs.join(footnotes.select(key, "number"), key).withColumn("p", one)
    found, gaps = F.expr(f"regexp_extract_all({column}, p, 0)"), F.expr(f"split({column}, p, -1)")
    x = x.withColumns({"found": F.slice(found, 1, MARKER_CONTEXTS), "gaps": gaps})
    ends = F.transform("found", lambda v, i: F.aggregate(F.slice("gaps", F.lit(1), i + 1), F.lit(0), lambda a, g: a + F.length(g)) + F.aggregate(F.slice("found", F.lit(1), i), F.lit(0), lambda a, g: a + F.length(g)))
    text = F.col(column)
    snippet = lambda at: F.concat(F.when(at > around, "...").otherwise(""), F.replace(F.substring(text, F.greatest(at - around, F.lit(0)) + 1, F.least(at, F.lit(around)) + around), F.lit("\n"), F.lit(" ")), F.when(at + around < F.length(text), "...").otherwise(""))
    return x.select(key, "number", F.transform(ends, snippet).alias("markers"))


@CATALOG.add("x14", "SELECT conv_id, turn, 1 AS n, CASE WHEN length(text) > 56 THEN '...' || replace(right(text, 56), chr(10), ' ') ELSE replace(text, chr(10), ' ') END || ' word7. 17 and x77 y7z' AS first FROM (SELECT conv_id, turn, regexp_replace(text, '[0-9]', '_', 'g') AS text FROM conversations)")
def markers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.regexp_replace("text", "[0-9]", "_"), F.lit(" word7. 17 and x77 y7z")).alias("text"), F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("k"))
    m = footnote_markers(c, c.select("k", F.lit("7").alias("number")), "k")
    return c.select("conv_id", "turn", "k").join(m, "k").select("conv_id", "turn", F.size("markers").alias("n"), F.get("markers", F.lit(0)).alias("first"))


@CATALOG.add("j07")
def line_search(spark, sf_dir):
    """Of each conversation the line most like the first line of each of its turns but for one letter, the first of ties."""
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("i", "title")).withColumn("o", F.col("turn") * 100_000 + F.col("i"))
    want = c.select("conv_id", F.col("turn").alias("h"), F.translate(F.get(F.split("text", "\n"), F.lit(0)), "e", "a").alias("text"))
    return best_in_page(want, lines.select("conv_id", "o", "title"), ["conv_id"], LINE).select("conv_id", "h", "o", "ratio")


# --- spelling and formatting ------------------------------------------------------------------------------------------------


def spelling_report(flags: DataFrame, key: str = "doc_id", *more: Column) -> DataFrame:
    """Flags as a text for the page model, with what else is asked of them."""
    line = F.concat(F.lit("- Line "), F.col("line").cast("string"), F.lit(': "'), "word", F.lit('" - suggestions: ['), F.array_join(F.transform("suggestions", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", "), F.lit("]"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("s")))), lambda v: v["s"])
    return flags.groupBy(key).agg(F.concat(F.lit("Possible misspellings:\n"), F.array_join(rows, "\n")).alias("report"), *more)


@CATALOG.add("m12", "SELECT conv_id, turn, md5('# Head ' || turn || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || t || chr(10)) AS digest, abs(length('# Head ' || turn || chr(10) || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || t || chr(10)) - length('#  Head ' || turn || '  ##' || chr(10) || '* a  ' || chr(10) || '+ b' || chr(10) || chr(10) || chr(10) || chr(10) || t || '  ')) AS delta FROM (SELECT conv_id, turn, 'x ' || regexp_replace(text, '[^a-zA-Z]+', ' ', 'g') || 'x' AS t FROM conversations)")
def formatted(spark, sf_dir):
    t = F.concat(F.lit("x "), F.regexp_replace("text", "[^a-zA-Z]+", " "), F.lit("x"))
    raw = F.concat(F.lit("#  Head "), F.col("turn").cast("string"), F.lit("  ##\n* a  \n+ b\n\n\n\n"), t, F.lit("  "))
    x = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("k"), raw.alias("raw"))
    new = normal_form(x.select("k", F.col("raw").alias("new")), "k", "new")
    return x.join(new, "k").select("k.conv_id", "k.turn", F.md5("new").alias("digest"), F.abs(F.length("new") - F.length("raw")).alias("delta"))


_FENCED = ["# H ##", "text", "```python", "* a  ", "# c ##", "", "", "~~~", "```", "+ b", "", "", "    * code  ", "    # x ##", "end"]


@CATALOG.add("m12_code", "SELECT doc_id, md5(array_to_string(['# H', '', 'text', '```python', '* a  ', '# c ##', '', '', '~~~', '```', '- b', '', '    * code  ', '    # x ##', 'end ' || doc_id], chr(10)) || chr(10)) AS digest FROM documents")
def formatted_code(spark, sf_dir):
    """Lines in fences and indented ones are left alone."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\n".join(_FENCED) + " "), F.col("doc_id").cast("string"), F.lit("\n\n")).alias("text"))
    return normal_form(x, "doc_id", "text").select("doc_id", F.md5("text").alias("digest"))


def clean_and_flag(docs: DataFrame, key: str = "doc_id", column: str = "text", known: int = 20, most: int = 50) -> DataFrame:
    """Docs with the normal form, how many characters it changed, the prose words that were checked, and the flags as a report."""
    x = with_normal_form(docs.select(key, F.length(column).alias("before"), F.col(column).alias("cleaned")), "cleaned")
    x = stored(x.withColumn("words_checked", F.coalesce(F.greatest(F.size(prose_of_text(F.col("cleaned"))), F.lit(0)).cast("long"), F.lit(0))), "cleaned")
    flags = stored(spelling_places(x.select(key, "cleaned"), known, most, None, key, "cleaned"), "flags")
    flagged = spelling_report(flags, key, F.count("*").alias("words_flagged"))
    x = x.join(flagged, key, "left")
    return x.select(key, "cleaned", F.abs(F.length("cleaned") - F.col("before")).alias("formatting_changes"), "words_checked", F.coalesce("words_flagged", F.lit(0)).alias("words_flagged"), F.coalesce("report", F.lit("")).alias("report"))


@CATALOG.add("m14")
def spelling_flags(spark, sf_dir):
    return flag_spelling(table(spark, sf_dir, "documents").select("doc_id", "text"))


@CATALOG.add("m15")
def cleaned_with_flags(spark, sf_dir):
    return clean_and_flag(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("cleaned", F.md5("cleaned"))


@CATALOG.add("m16", "SELECT conv_id, 'Possible misspellings:' || chr(10) || string_agg('- Line ' || turn || ': \"' || role || '\" - suggestions: [\"' || upper(role) || '\", \"x\"]', chr(10) ORDER BY turn) AS report FROM conversations GROUP BY conv_id")
def formatted_flags(spark, sf_dir):
    flags = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("place"), F.col("turn").alias("line"), F.col("role").alias("word"), F.array(F.upper("role"), F.lit("x")).alias("suggestions"))
    return spelling_report(flags, "conv_id")
