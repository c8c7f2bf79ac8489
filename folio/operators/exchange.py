"""What comes in and goes out: extraction from markup, results, URLs, server-sent events, feedback (S), and the interface to external models (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.cleanup import COLLAPSE_SQL, FOLD_SQL, SQUEEZE_SQL, clean_final
from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Raw pages as markdown: headings, list items and paragraphs; scripts, styles and other tags go."""
    x = F.col(html)
    steps = [(r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?is)<!--.*?-->", " "), (r"(?is)<h([1-6])[^>]*>", "\n\n<h$1>"), (r"(?is)</h[1-6]>", "\n\n"), (r"(?is)<li[^>]*>", "\n- "), (r"(?is)<br\s*/?>", "\n"), (r"(?is)</?(p|div|tr|ul|ol|table)\b[^>]*>", "\n\n")]
    for pattern, new in steps:
        x = F.regexp_replace(x, pattern, new)
    for level in range(1, 7):
        x = F.replace(x, F.lit(f"<h{level}>"), F.lit("#" * level + " "))
    x = F.regexp_replace(x, r"(?s)<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return pages.select(key, T.strip(T.squeeze(F.regexp_replace(x, r"\n[ \t]+", "\n"))).alias("markdown"))


@CATALOG.add("s16")
def extracted(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


@CATALOG.add("s17", "SELECT doc_id, CASE WHEN length(trim(text)) < 10 THEN 'error' ELSE 'ok' END AS status FROM documents")
def text_only(spark, sf_dir):
    """Too little text is a status, not an exception."""
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(T.strip(F.col("text"))) < 10, "error").otherwise("ok").alias("status"))


@CATALOG.add("s18", "SELECT doc_id, length(trim(text)) >= 50 AS sufficient FROM documents")
def sufficient(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(T.strip(F.col("text"))) >= 50).alias("sufficient"))


@CATALOG.add("s20", "SELECT conv_id, turn, length(text) AS chars, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM conversations")
def minimal(spark, sf_dir):
    """Extraction alone, pages in numeric order of their string keys."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("page"), F.length("text").alias("chars"))
    return c.select("conv_id", F.col("page").cast("long").alias("turn"), "chars", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("page").cast("int"))).alias("place"))


@CATALOG.add("s21", "SELECT item_id, trim(string_split(text || ' # note', '#')[1]) AS entry FROM benchmark")
def manifest_lines(spark, sf_dir):
    line = F.concat("text", F.lit(" # note"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.btrim(F.get(F.split(line, "#"), F.lit(0))).alias("entry")).where("entry <> ''")


@CATALOG.add("s26", "SELECT DISTINCT lower(trim(w)) AS term FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE trim(w) <> '' AND NOT starts_with(w, '#')")
def dictionary_terms(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w"))
    return w.where((F.btrim("w") != "") & ~F.col("w").startswith("#")).select(F.lower(F.btrim("w")).alias("term")).distinct()


@CATALOG.add("s27", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://files.example/bucket/results/' ELSE 'https://bucket.files.example/results/' END || page_id || '.md' AS url FROM pages")
def public_urls(spark, sf_dir):
    """Path-style or host-style."""
    base = F.when(F.col("page_id") % 2 == 0, "https://files.example/bucket").otherwise("https://bucket.files.example")
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", base, F.lit("results"), F.concat(F.col("page_id").cast("string"), F.lit(".md"))).alias("url"))


@CATALOG.add("s28", "SELECT o_orderkey, 'https://files.example/results/' || o_orderkey || '/result.md' AS url FROM orders")
def result_urls(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://files.example/results/"), F.col("o_orderkey").cast("string"), F.lit("/result.md")).alias("url"))


def parse_sse(buffers: DataFrame, key: str, column: str) -> DataFrame:
    """(key, n, id, event, data) of the complete events of a buffer, and what is left of it as `rest`; malformed data is dropped."""
    parts = F.split(column, "\n\n", -1)
    x = buffers.select(key, F.get(parts, F.size(parts) - 1).alias("rest"), F.posexplode(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("n", "e"))
    field = lambda name: F.nullif(F.regexp_extract("e", f"(?m)^{name}: (.*)$", 1), F.lit(""))
    return x.select(key, "n", field("id").cast("long").alias("id"), field("event").alias("event"), field("data").alias("data"), "rest").where(F.expr("try_parse_json(data)").isNotNull())


@CATALOG.add("s31", "SELECT event_id, event_id AS id, event_type AS event, props AS data, 'id: 9' AS rest FROM events")
def sse_events(spark, sf_dir):
    buf = F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\nevent: x\ndata: {bad\n\nid: 9"))
    return parse_sse(table(spark, sf_dir, "events").select("event_id", buf.alias("b")), "event_id", "b").drop("n")


@CATALOG.add("s32", "SELECT event_id, 'id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: {\"user\":' || user_id || '}' || chr(10) || chr(10) AS sse FROM events")
def sse_texts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), "event_type", F.lit("\ndata: "), F.to_json(F.struct(F.col("user_id").alias("user"))), F.lit("\n\n")).alias("sse"))


@CATALOG.add("s41", "SELECT user_id, event_id, '{\"level\":\"INFO\",\"message\":\"' || event_type || '\"}' AS line FROM events")
def log_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.to_json(F.struct(F.lit("INFO").alias("level"), F.col("event_type").alias("message"))).alias("line"))


# --- external models: the dataflow around them, with a rule-based provider in their place -------------------------------


@CATALOG.add("e14", f"SELECT doc_id, {SQUEEZE_SQL.format(x=COLLAPSE_SQL.format(x=FOLD_SQL))} <> {FOLD_SQL} AS changed FROM documents")
def cleaned_up(spark, sf_dir):
    """The final cleanup logs one change if it changed anything."""
    text = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, sf_dir, "documents").select("doc_id", (clean_final(text) != text).alias("changed"))


# --- what the other families still lack -----------------------------------------------------------------------------------


@CATALOG.add("p26", "SELECT doc_id, lang, '' AS text FROM documents")
def slim(spark, sf_dir):
    """Payloads without their heavy column, which the scan then never reads."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit("").alias("text"))


@CATALOG.add("p40", "SELECT o_orderkey, CASE WHEN o_orderdate + INTERVAL 4 HOUR > TIMESTAMP '1996-01-01' THEN 200 ELSE 404 END AS code FROM orders")
def review_details(spark, sf_dir):
    live = F.expr("o_orderdate + INTERVAL 4 HOURS > TIMESTAMP_NTZ '1996-01-01'")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(live, 200).otherwise(404).alias("code"))


@CATALOG.add("p44", "SELECT conv_id, turn, role AS agent, length(text) AS duration FROM conversations")
def traces(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("agent"), F.length("text").alias("duration"))


@CATALOG.add("o05", "SELECT p_brand, min(p_partkey) AS best FROM part p WHERE p_size = (SELECT max(p_size) FROM part q WHERE q.p_brand = p.p_brand) GROUP BY 1")
def best_first(spark, sf_dir):
    """The best, and the first of ties."""
    x = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.struct("p_size", (-F.col("p_partkey")).alias("k"))).alias("m"))
    return x.select("p_brand", (-F.col("m.k")).alias("best"))


@CATALOG.add("o08", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 5")
def call_limits(spark, sf_dir):
    """Five calls a page; the limit is the feature."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 5").select("l_orderkey", "l_linenumber")


@CATALOG.add("m07")
def applied_blocks(spark, sf_dir):
    """All code blocks, in order, on the newest version."""
    from folio.operators.outline import mark_code

    c = table(spark, sf_dir, "conversations").withColumn("page_key", F.concat_ws("/", "conv_id", "turn"))
    blocks = F.array(*[F.struct(F.lit(lang).alias("language"), F.lit(a).alias("first_line"), F.lit("").alias("last_line")) for lang, a in (("sql", "SELECT 1"), ("sh", "ls -l"))])
    newest = F.coalesce(F.nullif(F.when(F.col("conv_id") % 2 == 0, "v1\nSELECT 1\nls -l").otherwise(""), F.lit("")), F.lit("v0\nls -l"))
    return mark_code(c.select("page_key", newest.alias("markdown"), blocks.alias("blocks")), "page_key")


@CATALOG.add("x11", "SELECT n_nationkey, 'k=' || n_name || '{{x}}' AS context FROM nation")
def context_maps(spark, sf_dir):
    from folio.operators.cleanup import MARKERS

    m = F.transform_values(F.create_map(F.lit("k"), F.concat("n_name", F.lit("</s>{x}"))), lambda k, v: T.clean_prompt(v, MARKERS))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("k="), F.element_at(m, "k")).alias("context"))


def _box(s: Column, pad: float) -> list[Column]:
    return [F.greatest(F.lit(0.0), s - pad).cast("int").alias("x0"), F.least(F.lit(612.0), s + 100 + pad).cast("int").alias("x1")]


@CATALOG.add("n12", "SELECT p_partkey, CAST(trunc(greatest(0.0, p_size - 10.0)) AS INTEGER) AS x0, CAST(trunc(least(612.0, p_size + 110.0)) AS INTEGER) AS x1 FROM part")
def element_boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *_box(F.col("p_size"), 10.0))


@CATALOG.add("n13", "SELECT p_partkey, CAST(trunc(greatest(0.0, p_size - 2.0)) AS INTEGER) AS x0, CAST(trunc(least(612.0, p_size + 102.0)) AS INTEGER) AS x1 FROM part")
def highlight_boxes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *_box(F.col("p_size"), 2.0))


@CATALOG.add("t21", "SELECT user_id, max(ts) - min(ts) > INTERVAL 1800 SECOND AS timed_out FROM events GROUP BY 1")
def timeouts(spark, sf_dir):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.max(us) - F.min(us) > 1_800_000_000).alias("timed_out"))
