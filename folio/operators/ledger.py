"""Roll-ups: document statistics, tokens and cost, change ledgers, review checklists, batch reports, orders and sets (A, O, U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.functions.ranks import numbered
from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()

# Cents per token by tier (input, output).
RATES = {"default": (0.0001, 0.0005), "fast": (0.00008, 0.0004), "strong": (0.0003, 0.0015)}


def _join(parts: Column) -> Column:
    return F.array_join(parts, ",")


@CATALOG.add("a01", "SELECT lang, count(*) AS documents, sum(n) AS characters, sum(p) AS pages, sum(CASE WHEN n / p < 50 THEN 1 ELSE 0 END) AS scanned FROM (SELECT lang, length(y) AS n, greatest(CAST(ceil(length(y) / 1000.0) AS INTEGER), 1) AS p FROM (SELECT lang, regexp_replace(regexp_replace(regexp_replace(text, ' {2,}', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t\\r\\f\\v]+(\\n|$)', '\\1', 'g') AS y FROM documents)) GROUP BY lang")
def document_totals(spark, sf_dir):
    """Characters, pages and scanned documents by language, after cleanup."""
    d = table(spark, sf_dir, "documents").select("lang", F.length(T.mend_links(T.plain_quotes(T.squeeze(F.col("text"))))).alias("n"))
    d = d.withColumn("p", F.greatest(F.ceil(F.col("n") / 1000.0).cast("int"), F.lit(1)))
    return d.groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n").alias("characters"), F.sum("p").alias("pages"), F.sum((F.col("n") / F.col("p") < 50).cast("int")).alias("scanned"))


@CATALOG.add("a02", "SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS input_tokens, sum(CAST(l_quantity AS BIGINT) * l_linenumber) AS output_tokens, sum(l_linenumber) AS cached FROM lineitem GROUP BY l_orderkey")
def token_sums(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("input_tokens"), F.sum(q * F.col("l_linenumber")).alias("output_tokens"), F.sum("l_linenumber").alias("cached"))


@CATALOG.add("a03", "SELECT o.o_orderkey, count(l_linenumber) AS edits, coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS tokens FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey")
def job_totals(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("edits"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return o.join(steps, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("edits", F.lit(0)).cast("long").alias("edits"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def cost_cents(inputs: Column, outputs: Column, tier: str = "default") -> Column:
    """A04"""
    a, b = RATES[tier]
    return inputs * F.lit(a) + outputs * F.lit(b)


@CATALOG.add("a04", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 0.0001::DOUBLE + CAST(l_quantity AS BIGINT) * 2 * 0.0005::DOUBLE AS cents FROM lineitem")
def costs(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cost_cents(q, q * 2).alias("cents"))


@CATALOG.add("a05", "SELECT conv_id, count(DISTINCT turn // 2) AS pages FROM conversations WHERE length(text) > 100 GROUP BY conv_id")
def changed_pages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("length(text) > 100").groupBy("conv_id").agg(F.countDistinct(F.expr("turn DIV 2")).alias("pages"))


@CATALOG.add("a06", "SELECT l_returnflag AS stage, count(*) AS n FROM lineitem GROUP BY 1")
def by_stage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.count("*").alias("n"))


@CATALOG.add("a07", "SELECT l_orderkey, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS ledger_rows, count(*) AS total_edits FROM lineitem GROUP BY l_orderkey")
def ledger_rows(spark, sf_dir):
    """Skipped steps have no rows but count in total_edits."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_linestatus") != "O").cast("long")).alias("ledger_rows"), F.count("*").alias("total_edits"))


@CATALOG.add("a08", "SELECT l_orderkey, l_linenumber % 3 AS page, count(*) AS edit_count, sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS needs_review, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS entries FROM lineitem GROUP BY 1, 2")
def ledger_by_page(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("page"))
    return x.agg(F.count("*").alias("edit_count"), F.sum((F.col("l_discount") > 0.05).cast("long")).alias("needs_review"), _join(F.transform(F.sort_array(F.collect_list("l_linenumber")), lambda v: v.cast("string"))).alias("entries"))


@CATALOG.add("a09", "SELECT l_orderkey, CASE WHEN n < 4 THEN 'unknown' WHEN w < 0.55 AND lft >= 2 AND rgt >= 2 THEN 'double_column' ELSE 'single_column' END AS layout FROM (SELECT l_orderkey, count(*) AS n, list_sort(list(l_quantity / 50.0))[count(*) // 2 + 1] AS w, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS lft, sum(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) AS rgt FROM lineitem GROUP BY l_orderkey)")
def column_layout(spark, sf_dir):
    """Two columns if the item at the middle is narrow and both sides hold two."""
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_quantity") / 50.0)).alias("w"), F.sum((F.col("l_linenumber") % 2 == 0).cast("int")).alias("l"), F.sum((F.col("l_linenumber") % 2 == 1).cast("int")).alias("r"))
    mid = F.get("w", F.expr("size(w) DIV 2"))
    return x.select("l_orderkey", F.when(F.size("w") < 4, "unknown").when((mid < 0.55) & (F.col("l") >= 2) & (F.col("r") >= 2), "double_column").otherwise("single_column").alias("layout"))


@CATALOG.add("a11", "SELECT conv_id, role, string_agg(DISTINCT CAST(turn AS VARCHAR), ',' ORDER BY CAST(turn AS VARCHAR)) AS pages FROM conversations WHERE text <> '' GROUP BY 1, 2")
def section_pages(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").where("text <> ''").groupBy("conv_id", "role").agg(F.sort_array(F.collect_set(F.col("turn").cast("string"))).alias("p"))
    return x.select("conv_id", "role", _join(F.col("p")).alias("pages"))


@CATALOG.add("a12", "SELECT l_orderkey, count(DISTINCT l_quantity > 25) > 1 AS mixed FROM lineitem GROUP BY 1")
def orientations(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.countDistinct(F.col("l_quantity") > 25) > 1).alias("mixed"))


@CATALOG.add("a14", "SELECT conv_id, string_agg(n || ' ' || role, ', ' ORDER BY first_turn) AS summary FROM (SELECT conv_id, role, count(*) AS n, min(turn) AS first_turn FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def summaries(spark, sf_dir):
    """Counts by agent in the order of first appearance."""
    x = table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("f")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("f", "n", "role"))).alias("s"))
    return x.select("conv_id", F.array_join(F.transform("s", lambda v: F.concat(v["n"].cast("string"), F.lit(" "), v["role"])), ", ").alias("summary"))


@CATALOG.add("a15", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)")
def hint_counts(spark, sf_dir):
    return table(spark, sf_dir, "labels").cube("quality", "toxic").agg(F.count("*").alias("n"))


@CATALOG.add("a16", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@CATALOG.add("a18", "SELECT event_type, n, CAST(row_number() OVER (ORDER BY n DESC, event_type) AS INTEGER) AS place FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def by_type_descending(spark, sf_dir):
    x = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return x.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "event_type")))


@CATALOG.add("a19", "SELECT l_orderkey, sum(l_linenumber) AS ms, CASE WHEN bool_or(l_returnflag = 'R') THEN 'error' WHEN bool_and(l_returnflag = 'A') THEN 'skipped' ELSE 'success' END AS status FROM lineitem GROUP BY 1")
def stage_status(spark, sf_dir):
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("ms"), F.when(F.bool_or(f == "R"), "error").when(F.bool_and(f == "A"), "skipped").otherwise("success").alias("status"))


@CATALOG.add("a20", "SELECT p_type AS layout, count(*) AS n, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS flagged FROM part GROUP BY 1")
def layouts(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("layout")).agg(F.count("*").alias("n"), F.sum((F.col("p_size") > 25).cast("long")).alias("flagged"))


@CATALOG.add("a22", "SELECT DISTINCT l_linenumber AS page, CAST(dense_rank() OVER (ORDER BY l_linenumber) AS INTEGER) AS place FROM lineitem")
def distinct_pages(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("page")).distinct()
    return d.withColumn("place", F.dense_rank().over(W.orderBy("page")))


@CATALOG.add("a23", "SELECT count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS completed, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS failed FROM orders")
def batch_totals(spark, sf_dir):
    s = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").agg(F.count("*").alias("total"), F.sum((s == "F").cast("long")).alias("completed"), F.sum((s == "P").cast("long")).alias("failed"))


@CATALOG.add("a24", "SELECT o_orderpriority, median(CAST(o_totalprice AS BIGINT)) AS med, list_sort(list(CAST(o_totalprice AS BIGINT)))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95 FROM orders GROUP BY 1")
def elapsed(spark, sf_dir):
    """The median, and p95 as the element at int(n * 0.95) of the sorted values, found by rank rather than by collecting them."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.bround("o_totalprice", 0).cast("long").alias("v"))
    x = numbered(o, "o_orderpriority", ["v"], "r", "n")
    return x.groupBy("o_orderpriority").agg(middle("v", "r", "n").alias("med"), F.max(F.when(F.col("r") - 1 == F.floor(F.col("n") * 0.95), F.col("v"))).alias("p95"))


def middle(value: str, rank: str, total: str) -> Column:
    """The median of ranked values, as an aggregate."""
    r, n = F.col(rank), F.col(total)
    return F.avg(F.when((r == F.floor((n + 1) / 2)) | (r == F.floor((n + 2) / 2)), F.col(value).cast("double")))


@CATALOG.add("a25", "SELECT o_orderstatus, median(c) AS med FROM (SELECT o_orderstatus, CAST(o_totalprice AS BIGINT) * 1.0::DOUBLE / (o_orderkey % 5) AS c FROM orders WHERE o_orderkey % 5 > 0) GROUP BY 1")
def cost_per_page(spark, sf_dir):
    """The median over documents that have pages."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 5 > 0").select("o_orderstatus", (F.bround("o_totalprice", 0).cast("long") / (F.col("o_orderkey") % 5)).alias("v"))
    return numbered(o, "o_orderstatus", ["v"], "r", "n").groupBy("o_orderstatus").agg(middle("v", "r", "n").alias("med"))


@CATALOG.add("o01", "SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pages FROM conversations GROUP BY 1")
def numeric_page_order(spark, sf_dir):
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("string").cast("int"))).alias("p"))
    return x.select("conv_id", _join(F.transform("p", lambda v: v.cast("string"))).alias("pages"))


@CATALOG.add("o02", "SELECT p_brand, string_agg('figure-' || p_size, ',' ORDER BY 'figure-' || p_size) AS refs FROM (SELECT DISTINCT p_brand, p_size FROM part) GROUP BY 1")
def lexical_refs(spark, sf_dir):
    """References are ordered as strings."""
    x = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.concat(F.lit("figure-"), F.col("p_size").cast("string")))).alias("r"))
    return x.select("p_brand", _join(F.col("r")).alias("refs"))


@CATALOG.add("o03", "SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS INTEGER) AS place FROM documents")
def by_size(spark, sf_dir):
    """Inputs by ascending size, by prefix."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return numbered(d, "source", ["n_chars", "doc_id"]).select("source", "doc_id", F.col("place").cast("int").alias("place"))


@CATALOG.add("o04", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) <= 3")
def top_three(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.withColumn("r", F.row_number().over(W.partitionBy("p_brand").orderBy(F.col("p_size").desc(), "p_partkey"))).where("r <= 3").select("p_brand", "p_partkey")


@CATALOG.add("o06", "SELECT doc_id, list_extract(string_split(text, ' '), 1) AS c1, list_extract(string_split(text, ' '), 2) AS c2, list_extract(string_split(text, ' '), 3) AS c3 FROM documents")
def first_contexts(spark, sf_dir):
    """Up to three, in order."""
    x = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    return x.select("doc_id", *[F.get("w", F.lit(k)).alias(f"c{k + 1}") for k in range(3)])


@CATALOG.add("o07", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5")
def peek(spark, sf_dir):
    """The newest five of each queue."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("r", F.row_number().over(W.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()))).where("r <= 5").select("event_type", "event_id")


@CATALOG.add("o09", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def version_concat(spark, sf_dir):
    """Pages in order, joined."""
    x = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return x.select("conv_id", F.md5(F.array_join(F.transform("t", lambda v: v["text"]), "\n\n")).alias("digest"))


@CATALOG.add("u01", "SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def intersection(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").intersect(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@CATALOG.add("u02", "SELECT o_orderstatus AS status FROM orders UNION SELECT l_linestatus FROM lineitem")
def union_of_statuses(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")).union(table(spark, sf_dir, "lineitem").select("l_linestatus")).distinct()


@CATALOG.add("u03", "SELECT count(DISTINCT w) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark)")
def unique_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).agg(F.countDistinct("w").alias("n"))


@CATALOG.add("u04", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def difference(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").select("o_custkey"))


@CATALOG.add("u05", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def bag_union(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("k")).unionAll(table(spark, sf_dir, "region").select("r_regionkey"))


@CATALOG.add("u06", "SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'new' ELSE role END AS value FROM conversations")
def merged_maps(spark, sf_dir):
    """The right map wins, key by key."""
    old, new = F.create_map(F.col("turn"), F.col("role")), F.create_map(F.lit(1).cast("long"), F.lit("new"))
    merged = F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.element_at(merged, F.col("turn")).alias("value"))


@CATALOG.add("u07", "SELECT conv_id, role, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def last_by_name(spark, sf_dir):
    """A step that is emitted again replaces the one before."""
    c = table(spark, sf_dir, "conversations")
    return c.withColumn("r", F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.col("turn").desc()))).where("r = 1").select("conv_id", "role", "turn")
