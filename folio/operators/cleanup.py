"""Text cleanup, markdown structure of single texts, edits and prompt hygiene (F, M, X)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.blocks import lines_outside
from folio.plans.catalog import Catalog
from folio.sources.tables import stored, table

CATALOG = Catalog()

#: Words of a dictionary that is sent to the texts whole, some 60 MB; a larger one is joined by shuffles.
SMALL_DICTIONARY = 1_000_000
# Strings that must not reach a prompt.
MARKERS = ["</s>", "<|im_end|>", "<|im_start|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "Human:", "Assistant:", "System:", "<|user|>", "<|assistant|>", "<|system|>", "<|endoftext|>", "<|end|>"]
# Groups of letters that character recognition confuses with each other.
CONFUSED = [("l", "1", "I", "|"), ("O", "0"), ("rn", "m"), ("cl", "d"), ("vv", "w"), ("ii", "u"), ("fi", "fi"), ("fl", "fl"), ("S", "5"), ("B", "8"), ("Z", "2"), ("G", "6")]
#: (wrong, right) in the order in which they are tried.
CONFUSIONS = [(a, b) for group in CONFUSED for a in group for b in group if a != b]
CONFUSIONS_SQL = "(VALUES " + ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(CONFUSIONS)) + ") AS c(k, a, b)"

SQUEEZE_SQL = "regexp_replace(regexp_replace(regexp_replace({x}, ' {{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t\\r\\f\\v]+(\\n|$)', '\\1', 'g')"


# Word boundaries are Unicode's here and ASCII's in the other engine, so queries that need them replace other letters in both.
COLLAPSE_SQL = "list_reduce(list_prepend({x}, list_transform(list_reverse_sort(list_transform(list_distinct(regexp_extract_all({x}, '\\b(?:[a-zA-Z] ){{3,}}[a-zA-Z]\\b')), lambda m: {{{{'l': length(m), 'm': m}}}})), lambda s: s.m)), lambda a, m: replace(a, m, replace(m, ' ', '')))".replace("{{{{", "{{").replace("}}}}", "}}")
FOLD_SQL = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"

MARK_SQL = FOLD_SQL.replace("'_'", "'x'")


def _fold(column: str = "text", new: str = "_") -> Column:
    return F.regexp_replace(column, r"[^\x00-\x7F]", new)


def _digest(x: Column) -> list[Column]:
    return [F.length(x).alias("n"), F.md5(x).alias("digest")]


def _over_documents(name: str, make, sql: str | None) -> None:
    """A query that applies make(text, doc_id) to every document; sql is the same expression over text and doc_id."""
    oracle = f"SELECT doc_id, length(y) AS n, md5(y) AS digest FROM (SELECT doc_id, {sql} AS y FROM documents)" if sql else None

    @CATALOG.add(name, oracle)
    def query(spark, sf_dir) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", make(F.col("text"), F.col("doc_id")).alias("y"))
        return docs.select("doc_id", *_digest(F.col("y")))


PUA_SQL = r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]+"
_noise_pua = lambda x: F.replace(F.replace(x, F.lit("an"), F.lit("an")), F.lit(". "), F.lit(". "))
_noise_pua_sql = "replace(replace(text, 'an', 'a' || chr(57344) || 'n'), '. ', '.' || chr(57345) || chr(57346) || ' ')"
_over_documents("f01", lambda x, i: T.mend_private(_noise_pua(x)), f"regexp_replace(regexp_replace(regexp_replace({_noise_pua_sql}, '([A-Za-z0-9]){PUA_SQL}([A-Za-z0-9])', '\\1-\\2', 'g'), '([A-Za-z0-9]){PUA_SQL}([A-Za-z0-9])', '\\1-\\2', 'g'), '{PUA_SQL}', chr(65533), 'g')")
_over_documents("f02", lambda x, i: T.drop_private(F.concat(_noise_pua(x), F.lit("�"))), f"regexp_replace(replace({_noise_pua_sql} || chr(65533), chr(65533), ''), '{PUA_SQL}', '', 'g')")
_over_documents("f03", lambda x, i: T.nfkc(x), "nfc_normalize(text)")
_over_documents("f04", lambda x, i: T.close_letters(F.concat(F.lit("the r e q u i r e d item "), _fold())), COLLAPSE_SQL.format(x=f"('the r e q u i r e d item ' || {FOLD_SQL})"))
_over_documents("f05", lambda x, i: T.squeeze(F.replace(F.replace(x, F.lit(". "), F.lit(".   ")), F.lit("\n"), F.lit("  \n\n\n\n"))), SQUEEZE_SQL.format(x="replace(replace(text, '. ', '.   '), chr(10), '  ' || chr(10) || chr(10) || chr(10) || chr(10))"))
_over_documents("f06", lambda x, i: T.plain_quotes(F.replace(F.replace(x, F.lit(","), F.lit("”")), F.lit("."), F.lit("’"))), "replace(replace(text, ',', '\"'), '.', '''')")
_over_documents("m08", lambda x, i: T.join_hyphens(F.replace(x, F.lit(" th"), F.lit("-\n\nth"))), "regexp_replace(replace(text, ' th', '-' || chr(10) || chr(10) || 'th'), '([a-z])-\\n\\n([a-z])', '\\1\\2', 'g')")
_over_documents("f09", lambda x, i: T.nfkc(T.mend_private(_noise_pua(x))), f"regexp_replace(regexp_replace(regexp_replace({_noise_pua_sql}, '([A-Za-z0-9]){PUA_SQL}([A-Za-z0-9])', '\\1-\\2', 'g'), '([A-Za-z0-9]){PUA_SQL}([A-Za-z0-9])', '\\1-\\2', 'g'), '{PUA_SQL}', chr(65533), 'g')")


def clean_final(x: Column) -> Column:
    """the final cleanup, in its fixed order."""
    return T.mend_links(T.squeeze(T.close_letters(T.nfkc(T.plain_quotes(T.drop_private(x))))))


_over_documents("f10", lambda x, i: clean_final(F.concat(F.lit("\u201cH e l l o\u201d [a](site.org/x)  \n"), _fold())), "'\"Hello\" [a](http://site.org/x)' || chr(10) || " + SQUEEZE_SQL.format(x=COLLAPSE_SQL.format(x=FOLD_SQL)))
_over_documents("x10", lambda x, i: T.clean_prompt(F.concat(F.lit(" </S>{a}[inst] Human: "), x), MARKERS), "CASE WHEN length(y0) > 200 THEN substr(y0, 1, 200) || '...' ELSE y0 END".replace("y0", "trim('{{a}}  ' || text, ' ' || chr(10) || chr(9) || chr(13))"))
_over_documents("x12", lambda x, i: F.regexp_replace(F.lower(F.translate(T.nfkc(F.concat(F.lit("Note\t¹ "), x)), "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789")), r"\s+", " "), "regexp_replace(lower('note 1 ' || nfc_normalize(text)), '\\s+', ' ', 'g')")


@CATALOG.add("f07", "SELECT page_id, len(list_filter(regexp_extract_all(u, 'https?://[^\\s\\)\\]\\}''\"]+'), lambda v: regexp_matches(v, '^https?://[/?#]'))) AS n_broken FROM (SELECT page_id, 'see ' || url || ' (http:///x' || page_id || ') [a](https://?q) [b](x.html) http://ok.org/y' AS u FROM pages)")
def broken_links(spark, sf_dir):
    u = F.concat(F.lit("see "), F.col("url"), F.lit(" (http:///x"), F.col("page_id").cast("string"), F.lit(") [a](https://?q) [b](x.html) http://ok.org/y"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(T.broken_urls(u)).alias("n_broken"))


@CATALOG.add("f08", "SELECT page_id, '[a](http://' || regexp_replace(url, '^https?://', '') || ') [b](#x) [c](../y.z) [](p.q) [d](http://tel:1.2) ![i](http://image.png)' AS md FROM pages")
def mended_links(spark, sf_dir):
    bare = F.regexp_replace("url", "^https?://", "")
    md = F.concat(F.lit("[a]("), bare, F.lit(") [b](#x) [c](../y.z) [](p.q) [d](tel:1.2) ![i](image.png)"))
    return table(spark, sf_dir, "pages").select("page_id", T.mend_links(md).alias("md"))


def split_pages(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, page, markdown), pages numbered from 1 with gaps where empty ones were dropped; page 1 always stays unless the text is ''."""
    parts = docs.where(F.col(column) != "").select(key, F.posexplode(F.split(column, T.PAGE_BREAK, -1)).alias("p", "md"))
    return parts.select(key, (F.col("p") + 1).alias("page"), T.strip(F.col("md")).alias("markdown")).where((F.col("page") == 1) | (F.col("markdown") != ""))


@CATALOG.add("m01", "SELECT doc_id, page, length(md) AS n FROM (SELECT doc_id, i AS page, trim(parts[i], ' ' || chr(10) || chr(9)) AS md FROM (SELECT doc_id, string_split(replace(text, chr(10), '<!-- PAGE_BREAK -->') || '<!-- PAGE_BREAK -->', '<!-- PAGE_BREAK -->') AS parts FROM documents WHERE text <> ''), unnest(range(1, len(parts) + 1)) AS t(i)) WHERE page = 1 OR md <> ''")
def pages_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''")  # an empty text has no pages, and gets no mark either
    docs = docs.select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit(T.PAGE_BREAK)), F.lit(T.PAGE_BREAK)).alias("md"))
    return split_pages(docs, "doc_id", "md").select("doc_id", "page", F.length("markdown").alias("n"))


def headings(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines that are headings, with level and text."""
    return lines.where(F.col(column).rlike(T.HEADING)).withColumns({"level": F.length(F.regexp_extract(column, T.HEADING, 1)), "heading": F.regexp_extract(column, T.HEADING, 2)})


@CATALOG.add("m02", "SELECT conv_id, turn, length(regexp_extract(l, '^(#{1,6})\\s+(.+)$', 1)) AS level, md5(regexp_extract(l, '^(#{1,6})\\s+(.+)$', 2)) AS heading FROM (SELECT conv_id, turn, repeat('#', CAST(turn AS INTEGER) + 1) || ' ' || string_split(text, chr(10))[1] AS l FROM conversations) WHERE regexp_matches(l, '^(#{1,6})\\s+(.+)$')")
def headings_of_turns(spark, sf_dir):
    line = F.concat(F.repeat(F.lit("#"), F.col("turn").cast("int") + 1), F.lit(" "), F.get(F.split("text", "\n"), F.lit(0)))
    return headings(table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))).select("conv_id", "turn", "level", F.md5("heading").alias("heading"))


@CATALOG.add("m03", "SELECT conv_id, turn, 1 AS n, '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || turn || ' | ' || role || ' |' AS first_table FROM conversations")
def tables_of_pages(spark, sf_dir):
    """Pipe tables with a header, a separator and a body row."""
    md = F.concat(F.lit("text\n\n| a | b |\n|---|---|\n| "), F.col("turn").cast("string"), F.lit(" | "), F.col("role"), F.lit(" |\n\nnot | a table\n"))
    found = F.regexp_extract_all(md, F.lit(T.TABLE), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).alias("n"), F.rtrim(F.regexp_replace(F.get(found, F.lit(0)), "\n$", "")).alias("first_table"))


@CATALOG.add("m05", "SELECT conv_id, turn, 'a![x\\]](figures/figure-1.png)b![' || role || '](figures/figure-2.png)c<!-- image -->' AS md FROM conversations")
def figures_in_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", T.figure_references(F.lit("a<!-- image -->b<!-- image -->c<!-- image -->"), F.array(F.lit("figure-1"), F.lit("figure-2")), F.array(F.lit("x]"), F.col("role"))).alias("md"))


def words_of_line(x: Column) -> Column:
    """The words of a line: inline code, URLs, tags, link targets and markup go.  Links are rewritten before images, so image texts stay."""
    for pattern, new in (("`[^`]+`", ""), (r"https?://[^\s)\]]+", ""), ("<[^>]+>", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"[#*_\[\](){}|>~]", " ")):
        x = F.regexp_replace(x, pattern, new)
    return F.regexp_extract_all(x, F.lit(r"(?U)\b[a-zA-Z]{2,}\b"), F.lit(0))


def indented(line: Column) -> Column:
    return line.startswith("    ") | line.startswith("\t")


def prose_of_text(text: Column) -> Column:
    """The prose words of a text, in order."""
    return F.flatten(F.transform(F.filter(lines_outside(text), lambda v: (v != "") & ~indented(v)), words_of_line))


def prose_words(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, line, at, word, context) of prose: lines in fences and indented ones are skipped.  context: the line, stripped, its first 80
    characters."""
    lines = docs.select(key, F.posexplode(lines_outside(F.col(column))).alias("n", "line")).where((F.col("line") != "") & ~indented(F.col("line")))
    return lines.select(key, (F.col("n") + 1).alias("line"), line_context(F.col("line")).alias("context"), F.posexplode(words_of_line(F.col("line"))).alias("at", "word"))


def line_context(line: Column) -> Column:
    return F.substring(T.strip(line), 1, 80)


@CATALOG.add("m13", "SELECT item_id, line, \"at\", word, context FROM (SELECT item_id, CAST(n AS INTEGER) AS line, substr(trim(l), 1, 80) AS context, unnest(range(len(w))) AS \"at\", unnest(w) AS word FROM (SELECT item_id, n, l, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '`[^`]+`', '', 'g'), 'https?://[^\\s)\\]]+', '', 'g'), '<[^>]+>', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '[#*_\\[\\](){}|>~!]', ' ', 'g'), '\\b[a-zA-Z]{2,}\\b') AS w FROM (SELECT item_id, i AS n, ls[i] AS l, list_sum(list_transform(ls[1:i], lambda z: CASE WHEN starts_with(trim(z), '```') THEN 1 ELSE 0 END)) AS f FROM (SELECT item_id, string_split('Read `code x` at https://a.b/c <b>now</b>' || chr(10) || '```sql' || chr(10) || 'select hidden' || chr(10) || '```' || chr(10) || '    indented code' || chr(10) || 'a [link text](x.y) and ![image words](i.png) ' || regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), chr(10)) AS ls FROM benchmark), unnest(range(1, len(ls) + 1)) AS t(i)) WHERE f % 2 = 0 AND NOT starts_with(trim(l), '```') AND NOT starts_with(l, '    ')))")
def words_of_prose(spark, sf_dir):
    noise = "Read `code x` at https://a.b/c <b>now</b>\n```sql\nselect hidden\n```\n    indented code\na [link text](x.y) and ![image words](i.png) "
    x = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(noise), _fold(new=" ")).alias("text"))
    return prose_words(x, "item_id").select("item_id", F.col("line").cast("int").alias("line"), F.col("at").cast("long").alias("at"), "word", "context")


def recognition_variants(terms: DataFrame, term: str = "term", ord: str = "ord") -> DataFrame:
    """(variant, term): every occurrence of one confused letter replaced; key terms are no variants, and the last term (by ord) wins."""
    low = F.lower(term)
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(CONFUSIONS)])).alias("c")
    x = terms.select(F.col(term).alias("term"), F.col(ord).alias("ord"), low.alias("low"), pairs).where(F.contains("low", F.col("c.a")))
    x = x.select("term", "ord", "c.k", F.replace("low", F.col("c.a"), F.col("c.b")).alias("variant"), "low").where("variant <> low")
    known = terms.select(low.alias("variant")).distinct()
    return x.join(known, "variant", "left_anti").groupBy("variant").agg(F.max(F.struct("ord", "term", "k")).alias("m")).select("variant", "m.term")


def key_terms(spark, sf_dir) -> DataFrame:
    """The words of three letters or more of every benchmark item, as key terms."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(words).alias("term")).groupBy("term").agg(F.min("item_id").alias("ord"))


TERMS_SQL = "SELECT term, min(item_id) AS ord FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS term FROM benchmark) GROUP BY term"
VARIANTS_SQL = f"SELECT variant, arg_max(term, (ord, term, k)) AS term FROM (SELECT term, ord, k, lower(term) AS low, replace(lower(term), a, b) AS variant FROM ({TERMS_SQL}), {CONFUSIONS_SQL} WHERE contains(lower(term), a)) WHERE variant <> low AND variant NOT IN (SELECT lower(term) FROM ({TERMS_SQL})) GROUP BY variant"


@CATALOG.add("x01", VARIANTS_SQL)
def variants_of_terms(spark, sf_dir):
    return recognition_variants(key_terms(spark, sf_dir))


@CATALOG.add("j19", f"SELECT w AS word, term FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(replace(text, 'd', 'cl'), '[a-zA-Z0-9|]{{3,}}'))) AS w FROM benchmark) JOIN ({VARIANTS_SQL}) ON variant = w")
def confused_terms(spark, sf_dir):
    """Words that are variants of a key term, by an equi join; whether the variants are broadcast is left to their measured size."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.regexp_extract_all(F.replace("text", F.lit("d"), F.lit("cl")), F.lit("[a-zA-Z0-9|]{3,}"), F.lit(0)), lambda w: F.lower(w))).alias("word")).distinct()
    return words.join(recognition_variants(key_terms(spark, sf_dir)).withColumnRenamed("variant", "word"), "word")


def near_keys(word) -> Column:
    """The word and all that remain when one letter goes: words at one edit share one of them."""
    w = F.col(word)
    cut = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    return F.array_distinct(F.concat(cut, F.array(w)))


def one_edit(a: str, b: str) -> Column:
    """Whether two words are one edit apart: a letter more, less or another, or two neighbours swapped."""
    x, y = F.col(a), F.col(b)
    turned = F.exists(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.lit(1)), F.substring(x, i, F.lit(1)), F.substring(x, i + 2, F.length(x))) == y)
    return (F.levenshtein(x, y, 1) == 1) | ((F.length(x) == F.length(y)) & (x != y) & turned)


def _first_words(text: Column) -> Column:
    """(low, at, word): distinct words of three letters or more of a text, in lower case and as they are at their first places."""
    words = F.transform(F.regexp_extract_all(text, F.lit("\\b[a-zA-Z]{3,}\\b"), F.lit(0)), lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("at"), v.alias("word")))
    return F.get(F.transform(F.array(F.sort_array(words)), lambda a: F.filter(a, lambda v, i: (i == 0) | (F.get(a, i - 1)["low"] != v["low"]))), F.lit(0))


def check_recognition(docs: DataFrame, terms: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, word, reason, confidence, suggestions): of each document's distinct words of three letters or more, not key terms,
    variants of a key term (0.95); unknown words one edit from a key term (0.85), or with a suspicious pattern and near a known word (0.7).

    terms: term, ord; dictionary: word, n (how common).
    """
    # what is a term, a variant of one or known goes to the words, so that only words that may be answered are shuffled
    none = lambda *but: [F.lit(None).cast(t).alias(c) for c, t in (("variant", "string"), ("term", "boolean"), ("known", "boolean")) if c not in but]
    marks = recognition_variants(terms).select(F.col("variant").alias("low"), F.col("term").alias("variant"), *none("variant")).unionByName(terms.select(F.lower("term").alias("low"), F.lit(True).alias("term"), *none("term"))).unionByName(dictionary.select(F.lower("word").alias("low"), F.lit(True).alias("known"), *none("known")))
    marks = stored(marks.groupBy("low").agg(F.max("variant").alias("variant"), F.max("term").alias("term"), F.max("known").alias("known")), "marks")
    words = docs.select(key, F.inline(_first_words(F.col(text)))).join(F.broadcast(marks) if marks.count() <= SMALL_DICTIONARY else marks, "low", "left").where("term IS NULL AND (variant IS NOT NULL OR known IS NULL)")
    words = stored(words.groupBy(key, "low").agg(F.min(F.struct("at", "word")).alias("m"), F.max("variant").alias("variant")).select(key, "low", "m.word", "variant"), "words")
    first = words.where("variant IS NOT NULL").select(key, "word", "low", F.lit("key_term_variant").alias("reason"), F.lit(0.95).alias("confidence"), F.array("variant").alias("suggestions"))
    rest = words.where("variant IS NULL").select(key, "word", "low")
    known = dictionary.select(F.lower(F.col("word")).alias("near"), "n", F.lit(False).alias("is_term")).unionByName(terms.select(F.lower("term").alias("near"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("is_term"))).groupBy("near").agg(F.max("n").alias("n"), F.max("is_term").alias("is_term"))
    asked = stored(rest.select("low").distinct(), "asked")
    # known words that are no terms only count for suspicious words
    pairs = lambda a, b: a.select("low", F.explode(near_keys("low")).alias("k")).join(b.select("near", "n", "is_term", F.explode(near_keys("near")).alias("k")), "k")
    near = pairs(asked, known.where("is_term")).unionByName(pairs(asked.where(suspicious(F.col("low"))), known.where("NOT is_term"))).where(one_edit("low", "near")).select("low", "near", "n", "is_term").distinct()
    best = near.groupBy("low").agg(*[F.transform(F.slice(F.sort_array(F.collect_list(F.when(c, F.struct((-F.col("n")).alias("m"), "near")))), 1, 3), lambda v: v["near"]).alias(name) for name, c in (("terms", F.col("is_term")), ("top", F.lit(True)))])
    second = rest.join(best, "low").withColumn("term", F.size("terms") > 0).where(F.col("term") | suspicious(F.col("low")))
    pick = lambda a, b: F.when(F.col("term"), a).otherwise(b)
    second = second.select(key, "word", "low", pick(F.lit("spell_check_suggests_key_term"), F.lit("common_ocr_pattern")).alias("reason"), pick(F.lit(0.85), F.lit(0.7)).alias("confidence"), pick(F.col("terms"), F.col("top")).alias("suggestions"))
    return first.unionByName(second).drop("low")


def suspicious(word: Column) -> Column:
    """A lower-case word with a pattern that misread letters make; in words of letters alone only rn, vv and ll can occur."""
    return word.rlike(r"[0-9][a-z]|[a-z][0-9]|rn|[Il1|]{2,}|vv")


@CATALOG.add("x02")
def recognition_check(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("\\b[a-zA-Z]{3,}\\b"), F.lit(0)), lambda w: F.lower(w)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return check_recognition(docs, key_terms(spark, sf_dir), stored(words.where("n >= 20"), "dictionary"))


@CATALOG.add("x05", f"SELECT w AS word, regexp_matches(w, '[0-9][a-z]|[a-z][0-9]|rn|[Il1|]{{2,}}|vv') AS suspicious, count(*) AS n FROM (SELECT lower(unnest(regexp_extract_all({FOLD_SQL}, '\\b[a-zA-Z]+\\b'))) AS w FROM documents) GROUP BY w")
def suspicious_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(_fold(), F.lit("\\b[a-zA-Z]+\\b"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    return words.select("word", suspicious(F.col("word")).alias("suspicious"), "n")


@CATALOG.add("x03", f"SELECT doc_id, len(regexp_extract_all({FOLD_SQL}, '\\b[a-zA-Z]+\\b')) AS n_words FROM documents")
def words_of_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.regexp_extract_all(_fold(), F.lit("\\b[a-zA-Z]+\\b"), F.lit(0))).alias("n_words"))


@CATALOG.add("x04", "SELECT doc_id, CASE WHEN p > 51 THEN '...' ELSE '' END || substr(text, greatest(p - 50, 1), p + 3 + 50 - greatest(p - 50, 1)) || CASE WHEN p + 2 + 50 < length(text) THEN '...' ELSE '' END AS context FROM (SELECT doc_id, text, strpos(lower(text), 'ion') AS p FROM documents) WHERE p > 0")
def contexts(spark, sf_dir):
    """Fifty characters on either side of the first hit, whatever its case."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr(F.lower("text"), "ion").alias("p")).where("p > 0")
    start = F.greatest(F.col("p") - 50, F.lit(1))
    return d.select("doc_id", F.concat(F.when(F.col("p") > 51, "...").otherwise(""), F.substring(F.col("text"), start, F.col("p") + 53 - start), F.when(F.col("p") + 52 < F.length("text"), "...").otherwise("")).alias("context"))


@CATALOG.add("x06", "SELECT doc_id, CASE WHEN c = 0 THEN 'not found' WHEN c > 1 THEN 'not unique' ELSE 'valid' END AS verdict FROM (SELECT doc_id, (length(text) - length(replace(text, w, ''))) / length(w) AS c FROM (SELECT doc_id, text, string_split(text, ' ')[3] AS w FROM documents) WHERE length(w) > 0)")
def edit_verdicts(spark, sf_dir):
    """An edit needs a search text that is there exactly once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.get(F.split("text", " "), F.lit(2)).alias("w")).where("length(w) > 0")
    c = T.occurrences(F.col("text"), F.col("w"))
    return d.select("doc_id", F.when(c == 0, "not found").when(c > 1, "not unique").otherwise("valid").alias("verdict"))


@CATALOG.add("x07", "SELECT doc_id, list_min(list_filter(range(20, 101, 10), lambda c: (length(text) - length(replace(text, substr(text, 1, c), ''))) = length(substr(text, 1, c)))) AS context_size FROM documents")
def minimal_contexts(spark, sf_dir):
    """The least context of 20, 30, ... 100 characters that makes the text's beginning unique."""
    sizes = F.sequence(F.lit(20), F.lit(100), F.lit(10))
    unique = F.filter(sizes, lambda c: (F.col("text") == "") | (T.occurrences(F.col("text"), F.substring(F.col("text"), F.lit(1), c)) == 1))  # an empty text is in itself once
    return table(spark, sf_dir, "documents").select("doc_id", F.array_min(unique).cast("long").alias("context_size"))


@CATALOG.add("x08", "SELECT doc_id, CASE WHEN (length(text) - length(replace(text, w, ''))) = length(w) THEN md5(replace(text, w, 'CHANGED')) END AS changed FROM (SELECT doc_id, text, string_split(text, ' ')[4] AS w FROM documents) WHERE length(w) > 0")
def applied_edits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.get(F.split("text", " "), F.lit(3)).alias("w")).where("length(w) > 0")
    return d.select("doc_id", F.md5(T.replace_unique(F.col("text"), F.col("w"), F.lit("CHANGED"))).alias("changed"))


@CATALOG.add("x09", "SELECT conv_id, turn, length(text) AS removed, length(text) + 6 AS added, 6 AS net FROM conversations")
def edit_sizes(spark, sf_dir):
    """Characters removed, added, and the difference."""
    c = table(spark, sf_dir, "conversations").withColumn("new", F.concat("text", F.lit(" World")))
    return c.select("conv_id", "turn", F.length("text").alias("removed"), F.length("new").alias("added"), (F.length("new") - F.length("text")).alias("net"))


def apply_edits(docs: DataFrame, edits: DataFrame, keys: list[str], column: str = "markdown") -> DataFrame:
    """Edits (keys, ord, search, replace) in order, each on the result of the one before: docs with `edited`, `applied` (their ords) and
    `errors` (ord and why).  An edit whose text is not there exactly once, or equals its replacement, changes nothing."""
    listed = edits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("ord", "search", "replace"))).alias("edits"))
    start = F.struct(F.col(column).alias("t"), F.array().cast("array<int>").alias("done"), F.array().cast("array<struct<ord:int,why:string>>").alias("bad"))

    def step(acc, e):
        found = T.occurrences(acc["t"], e["search"])
        why = F.when(e["search"] == "", "empty").when(e["search"] == e["replace"], "no change").when(found == 0, "not found").when(found > 1, "not unique")
        return F.struct(
            F.when(why.isNull(), F.replace(acc["t"], e["search"], e["replace"])).otherwise(acc["t"]).alias("t"),
            F.when(why.isNull(), F.array_append(acc["done"], e["ord"].cast("int"))).otherwise(acc["done"]).alias("done"),
            F.when(why.isNull(), acc["bad"]).otherwise(F.array_append(acc["bad"], F.struct(e["ord"].cast("int").alias("ord"), why.alias("why")))).alias("bad"),
        )

    done = F.aggregate(F.coalesce("edits", F.array().cast(listed.schema["edits"].dataType)), start, step)
    return docs.join(listed, keys, "left").withColumn("done", done).select(*docs.columns, F.col("done.t").alias("edited"), F.col("done.done").alias("applied"), F.col("done.bad").alias("errors"))


@CATALOG.add("e05", "SELECT conv_id, turn, md5(CASE WHEN n1 = 1 THEN replace(replace(text, w1, 'QONE'), 'QONE', 'QTWO') ELSE text END) AS final, CASE WHEN n1 = 1 THEN 2 ELSE 0 END AS applied, CASE WHEN w1 = '' THEN '1 empty,2 not found,3 not found' WHEN n1 = 1 THEN '3 not found' ELSE '1 not unique,2 not found,3 not found' END AS errors FROM (SELECT *, CASE WHEN w1 = '' THEN 0 ELSE (length(text) - length(replace(text, w1, ''))) // length(w1) END AS n1 FROM (SELECT conv_id, turn, text, string_split(text, ' ')[1] AS w1 FROM conversations))")
def folded_edits(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("markdown"))
    first = F.get(F.split("markdown", " "), F.lit(0))
    edits = c.select("conv_id", "turn", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), a.alias("search"), F.lit(b).alias("replace")) for k, a, b in ((1, first, "QONE"), (2, F.lit("QONE"), "QTWO"), (3, F.lit("never there"), "x"))])).alias("e")).select("conv_id", "turn", "e.*")
    done = apply_edits(c, edits, ["conv_id", "turn"])
    return done.select("conv_id", "turn", F.md5("edited").alias("final"), F.size("applied").alias("applied"), F.array_join(F.transform("errors", lambda e: F.concat(e["ord"].cast("string"), F.lit(" "), e["why"])), ",").alias("errors"))
