"""Messages for the models, put together from parts in order (N17): reconciliation of headings, structure of a page, boundaries of pages.

Wording comes from fragments by name, filled in at {names}, so a deployment brings its own; what is fixed is the order of the parts, what
each is made of, and which are left out when there is nothing to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()

#: The fragments that the registered queries use.
WORDING = {
    "headings": "# {pages} pages, {n} headings", "no headings": "There are no headings; answer with none.", "candidates": "# Headings in order", "columns": "| # | page | level | text | why |\n|---|---|---|---|---|", "headings end": "Give every heading its level.",
    "page": "# Page {page} of {pages}", "layout": "# Layout\n\nThis page looks like {layout}; the image decides.", "outline": "# Outline up to here", "no outline": "(nothing yet)", "markdown": "# Text of this page", "page end": "Say what the page holds.",
    "boundaries": "# Boundaries", "between": "## Pages {a} and {b}", "hints": "Hints:", "tail": "Page {a} ends:", "head": "Page {b} begins:", "footnotes": "# Footnotes to leave\n\n{numbers}", "document": "# Document", "boundaries end": "Mend what the page breaks split.",
}


def fill(template: str, **values: Column | str) -> Column:
    """A fragment with its {names} replaced by columns."""
    parts, rest = [], template
    while rest:
        at = min((rest.find("{" + k + "}") for k in values if "{" + k + "}" in rest), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(k for k in values if rest.startswith("{" + k + "}", at))
        parts += [F.lit(rest[:at]), F.col(values[name]).cast("string") if isinstance(values[name], str) else values[name].cast("string")]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def lines_of(*parts: Column | str) -> Column:
    """Parts on lines of their own; nulls are left out, an array is a part for each of its items."""
    arrays = [F.array(F.lit(p)) if isinstance(p, str) else p for p in parts]
    return F.array_join(F.array_compact(F.concat(*arrays)), "\n")


def _one(x: Column) -> Column:
    return F.array(x)


def shorten(x: Column, most: int = 120) -> Column:
    """Texts of more than `most` characters are cut three characters before that, and marked."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def heading_messages(docs: DataFrame, outline: DataFrame, key: str, wording: dict[str, str] = WORDING) -> DataFrame:
    """(key, message) for every document (key, pages), with a table of its heading candidates (key, ord, page, level, text, reasoning), or
    with what is said where there are none."""
    some = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    row = F.concat(F.lit("| "), (F.row_number().over(W.partitionBy(key).orderBy("ord"))).cast("string"), F.lit(" | "), some("page", "?"), F.lit(" | h"), some("level", "?"), F.lit(" | "), some("text", ""), F.lit(" | "), shorten(some("reasoning", "")), F.lit(" |"))
    rows = outline.select(key, "ord", row.alias("row")).groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "row"))), lambda v: v["row"]).alias("rows"))
    x = docs.select(key, "pages").join(rows, key, "left").withColumn("n", F.coalesce(F.size("rows"), F.lit(0)))
    title = _one(F.concat(fill(wording["headings"], pages="pages", n="n"), F.lit("\n")))
    full = lines_of(title, wording["candidates"] + "\n", wording["columns"], F.col("rows"), "", wording["headings end"])
    return x.select(key, F.when(F.col("n") > 0, full).otherwise(lines_of(title, wording["no headings"])).alias("message"))


def structure_messages(pages: DataFrame, outline: DataFrame, key: str, wording: dict[str, str] = WORDING) -> DataFrame:
    """(key, page, message) for every page (key, page, pages, markdown, layout), with the headings (key, page, ord, level, text) of the pages
    before it, each indented by its level."""
    entry = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.expr("repeat('#', level)"), F.lit(" "), "text", F.lit(" (page "), F.col("page").cast("string"), F.lit(")"))
    own = outline.groupBy(key, "page").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))), lambda v: v["e"]).alias("own"))
    before = F.flatten(F.collect_list(F.coalesce("own", F.array().cast("array<string>"))).over(W.partitionBy(key).orderBy("page").rowsBetween(W.unboundedPreceding, -1)))
    x = pages.join(own, [key, "page"], "left").withColumn("before", before)
    layout = F.when(F.col("layout").isNotNull() & ~F.col("layout").isin("", "unknown"), F.concat(fill(wording["layout"], layout="layout"), F.lit("\n")))
    outline_ = F.when(F.size("before") > 0, F.col("before")).otherwise(F.array(F.lit(wording["no outline"])))
    return x.select(key, "page", lines_of(_one(fill(wording["page"], page="page", pages="pages")), "", _one(layout), wording["outline"], "", outline_, "", wording["markdown"], "", "```markdown", _one(F.col("markdown")), "```", "", wording["page end"]).alias("message"))


def boundary_messages(docs: DataFrame, boundaries: DataFrame, key: str, wording: dict[str, str] = WORDING) -> DataFrame:
    """(key, message) for every document (key, document, footnotes array) with its boundaries (key, page, tail, head, hints array)."""
    b = F.col("page") + 1
    hints = F.when(F.size("hints") > 0, F.concat(F.lit(wording["hints"] + "\n"), F.array_join(F.transform("hints", lambda h: F.concat(F.lit("- "), h)), "\n"), F.lit("\n\n"))).otherwise("")
    fenced = lambda c: F.concat(F.lit("\n```\n"), c, F.lit("\n```\n"))
    block = F.concat(fill(wording["between"], a="page", b=b), F.lit("\n"), hints, fill(wording["tail"], a="page"), fenced("tail"), fill(wording["head"], b=b), fenced("head"))
    each = boundaries.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("page", block.alias("b")))), lambda v: v["b"]).alias("blocks"))
    x = docs.join(each, key, "left").withColumn("blocks", F.coalesce("blocks", F.array().cast("array<string>")))
    notes = F.when(F.size("footnotes") > 0, F.concat(fill(wording["footnotes"], numbers=F.array_join("footnotes", ", ")), F.lit("\n")))
    return x.select(key, lines_of(wording["boundaries"] + "\n", F.col("blocks"), _one(notes), wording["document"] + "\n", _one(F.concat(F.lit("```\n"), "document", F.lit("\n```\n"))), wording["boundaries end"]).alias("message"))


_N = "|| chr(10) ||"


@CATALOG.add("n17", f"""SELECT c.conv_id, '# ' || pages || ' pages, ' || coalesce(n, 0) || ' headings' {_N} chr(10) || CASE WHEN n > 0 THEN '# Headings in order' {_N} chr(10) || '| # | page | level | text | why |' {_N} '|---|---|---|---|---|' {_N} rows {_N} chr(10) || 'Give every heading its level.' ELSE 'There are no headings; answer with none.' END AS message
    FROM (SELECT conv_id, count(*) AS pages FROM conversations GROUP BY conv_id) c LEFT JOIN
    (SELECT conv_id, count(*) AS n, string_agg('| ' || k || ' | ' || (turn + 1) || ' | h' || coalesce(CAST(level AS VARCHAR), '?') || ' | ' || role || ' | ' || CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END || ' |', chr(10) ORDER BY turn) AS rows
        FROM (SELECT *, CASE WHEN turn % 4 <> 3 THEN turn % 3 + 1 END AS level, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE conv_id % 5 <> 0) GROUP BY conv_id) h ON h.conv_id = c.conv_id""")
def reconciliation(spark, sf_dir):
    """Conversations as documents; every fifth has no headings, every fourth heading no level."""
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("turn") % 4 != 3, F.col("turn") % 3 + 1)
    o = c.where("conv_id % 5 <> 0").select("conv_id", F.col("turn").alias("ord"), (F.col("turn") + 1).alias("page"), level.alias("level"), F.col("role").alias("text"), F.col("text").alias("reasoning"))
    return heading_messages(c.groupBy("conv_id").agg(F.count("*").alias("pages")), o, "conv_id")


@CATALOG.add("n17_structure", f"""SELECT conv_id, page, md5('# Page ' || page || ' of ' || count(*) OVER (PARTITION BY conv_id) {_N} chr(10) || CASE page % 3 WHEN 1 THEN '# Layout' {_N} chr(10) || 'This page looks like double_column; the image decides.' {_N} chr(10) ELSE '' END || '# Outline up to here' {_N} chr(10)
    || coalesce(string_agg(CASE WHEN page % 2 = 1 THEN repeat('  ', CAST(page % 3 AS INTEGER)) || repeat('#', CAST(page % 3 + 1 AS INTEGER)) || ' ' || role || ' (page ' || page || ')' END, chr(10)) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '(nothing yet)')
    {_N} chr(10) || '# Text of this page' {_N} chr(10) || '```markdown' {_N} text {_N} '```' {_N} chr(10) || 'Say what the page holds.') AS digest FROM (SELECT *, turn + 1 AS page FROM conversations)""")
def page_structures(spark, sf_dir):
    """Every odd page has a heading; some pages have a layout, others an unknown one or none."""
    c = table(spark, sf_dir, "conversations").withColumn("page", (F.col("turn") + 1).cast("int"))
    layout = F.when(F.col("page") % 3 == 1, "double_column").when(F.col("page") % 3 == 2, "unknown")
    pages = c.select("conv_id", "page", F.count("*").over(W.partitionBy("conv_id")).alias("pages"), F.col("text").alias("markdown"), layout.alias("layout"))
    outline = c.where("page % 2 = 1").select("conv_id", "page", F.lit(0).alias("ord"), (F.col("page") % 3 + 1).alias("level"), F.col("role").alias("text"))
    return structure_messages(pages, outline, "conv_id").select("conv_id", F.col("page").cast("long").alias("page"), F.md5("message").alias("digest"))


@CATALOG.add("n17_boundaries", f"""SELECT d.conv_id, md5('# Boundaries' {_N} chr(10) || coalesce(blocks || chr(10), '') || CASE WHEN d.conv_id % 2 = 0 THEN '# Footnotes to leave' {_N} chr(10) || '1, 2' {_N} chr(10) ELSE '' END || '# Document' {_N} chr(10) || '```' {_N} document {_N} '```' {_N} chr(10) || 'Mend what the page breaks split.') AS digest
    FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY conv_id) d LEFT JOIN
    (SELECT conv_id, string_agg('## Pages ' || (turn + 1) || ' and ' || (turn + 2) {_N} CASE WHEN turn % 2 = 0 THEN 'Hints:' {_N} '- h1' {_N} '- ' || role {_N} chr(10) ELSE '' END || 'Page ' || (turn + 1) || ' ends:' {_N} '```' {_N} right(text, 20) {_N} '```' {_N} 'Page ' || (turn + 2) || ' begins:' {_N} '```' {_N} substr(after, 1, 20) {_N} '```' || chr(10), chr(10) ORDER BY turn) AS blocks
        FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM conversations) WHERE after IS NOT NULL GROUP BY conv_id) b ON b.conv_id = d.conv_id""")
def boundaries_of_pages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda v: v["text"]), "\n\n").alias("document"))
    docs = docs.withColumn("footnotes", F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array().cast("array<string>")))
    x = c.withColumn("after", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("after IS NOT NULL")
    hints = F.when(F.col("turn") % 2 == 0, F.array(F.lit("h1"), F.col("role"))).otherwise(F.array().cast("array<string>"))
    b = x.select("conv_id", (F.col("turn") + 1).alias("page"), F.expr("right(text, 20)").alias("tail"), F.substring("after", 1, 20).alias("head"), hints.alias("hints"))
    return boundary_messages(docs, b, "conv_id").select("conv_id", F.md5("message").alias("digest"))
