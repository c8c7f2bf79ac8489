"""Joins and lookups (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.cleanup import near_keys, one_edit
from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()


@CATALOG.add("j01", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P'")
def pages_and_figures(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey")
    return o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")


@CATALOG.add("j02", "SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_discount > 0.08 GROUP BY 1")
def lookup_lists(spark, sf_dir):
    """What belongs to each page, null if nothing does."""
    x = table(spark, sf_dir, "lineitem").where("l_discount > 0.08").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"))
    o = table(spark, sf_dir, "orders").select("o_orderkey").join(x, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("p").isNotNull(), F.array_join(F.transform("p", lambda v: v["l_partkey"].cast("string")), ",")).alias("parts"))


@CATALOG.add("j03", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def figures_with_image(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").join(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")


@CATALOG.add("j04", "SELECT c.conv_id, c.turn, d.role AS caption FROM conversations c LEFT JOIN conversations d ON d.conv_id = c.conv_id AND d.turn = c.turn + 1")
def captions(spark, sf_dir):
    """References resolved by (collection, index)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    d = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("caption"))
    return c.join(d, ["conv_id", "turn"], "left")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each left row with the last right value at or before it: one shuffle and one sort, no range join."""
    both = left.withColumns({value: F.lit(None).cast(right.schema[value].dataType), "__own": F.lit(1)}).unionByName(right.select(key, at, value).withColumn("__own", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, "__own").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("__own = 1").drop("__own")


@CATALOG.add("j08", "SELECT e.user_id, e.event_id, max(p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts GROUP BY 1, 2")
def last_start(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return as_of(e.select("user_id", "event_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("last_purchase")), "user_id", "ts", "last_purchase").select("user_id", "event_id", "last_purchase")


@CATALOG.add("j09", "SELECT conv_id, 1 + turn // 2 AS section, turn + d AS page FROM conversations, (VALUES (0), (1)) AS t(d)")
def sections_and_pages(spark, sf_dir):
    """A section's list of pages as a bridge."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.expr("1 + turn DIV 2").alias("section"), F.array(F.col("turn"), F.col("turn") + 1).alias("pages"))
    return c.select("conv_id", "section", F.explode("pages").alias("page"))


@CATALOG.add("j10", "SELECT conv_id, turn, CASE WHEN role = nr THEN role END AS shared FROM (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM conversations) WHERE nr IS NOT NULL")
def shared_sections(spark, sf_dir):
    nxt = F.lead("role").over(W.partitionBy("conv_id").orderBy("turn"))
    x = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("role", F.lit("a")).alias("before"), F.array(nxt, F.lit("b")).alias("after"), nxt.alias("nr")).where("nr IS NOT NULL")
    return x.select("conv_id", "turn", F.get(F.array_intersect("before", "after"), F.lit(0)).alias("shared"))


@CATALOG.add("j13", "SELECT d.doc_id, coalesce(CASE WHEN l.quality IS NULL THEN 'unknown' WHEN l.quality = 1 THEN 'good' ELSE 'bad' END, 'unknown') AS review FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic IS NULL OR l.toxic <> 1")
def reviews(spark, sf_dir):
    """Items with their observation; closed ones go, unmatched ones stay as unknown."""
    x = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").where("toxic IS NULL OR toxic <> 1")
    return x.select("doc_id", F.when(F.col("quality").isNull(), "unknown").when(F.col("quality") == 1, "good").otherwise("bad").alias("review"))


@CATALOG.add("j14", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate + INTERVAL 4 HOUR > TIMESTAMP '1996-01-01'")
def live_tokens(spark, sf_dir):
    """Token to job, unless expired."""
    o = table(spark, sf_dir, "orders").where(F.expr("o_orderdate + INTERVAL 4 HOURS > TIMESTAMP_NTZ '1996-01-01'"))
    return o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@CATALOG.add("j15", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def consumed_once(spark, sf_dir):
    """Only the first use of a token counts."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return e.select("user_id", "f.event_id")


@CATALOG.add("j16", "SELECT event_id, CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'structure' ELSE 'review' END AS stage FROM events")
def stages(spark, sf_dir):
    """Steps by a fixed mapping of two rows; others go to review."""
    m = spark.range(2).select(F.when(F.col("id") == 0, "click").otherwise("view").alias("event_type"), F.when(F.col("id") == 0, "extract").otherwise("structure").alias("stage"))
    return table(spark, sf_dir, "events").join(F.broadcast(m), "event_type", "left").select("event_id", F.coalesce("stage", F.lit("review")).alias("stage"))


@CATALOG.add("j17", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def rendered_paths(spark, sf_dir):
    return table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@CATALOG.add("j18", "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) WHERE w NOT IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) FROM documents WHERE lang = 'en')")
def unknown_words(spark, sf_dir):
    """Words that the dictionary (here: of the English documents) lacks."""
    words = lambda df: df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word")).distinct()
    return words(table(spark, sf_dir, "benchmark")).join(words(table(spark, sf_dir, "documents").where("lang = 'en'")), "word", "left_anti")


@CATALOG.add("j20", "SELECT a.w AS word, b.w AS near FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '\\b[a-z]+\\b')) AS w FROM benchmark) a JOIN (SELECT DISTINCT unnest(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g')), '\\b[a-z]+\\b')) AS w FROM benchmark) b ON a.w < b.w AND damerau_levenshtein(a.w, b.w) = 1")
def near_words(spark, sf_dir):
    """Words one edit apart, swapped neighbours included, found by an equi-join on words with one letter taken out, then verified."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower(F.regexp_replace("text", r"[^\x00-\x7F]", "x")), F.lit("\\b[a-z]+\\b"), F.lit(0))).alias("w")).distinct()
    keys = words.select("w", F.explode(near_keys("w")).alias("k"))
    pairs = keys.join(keys.withColumnRenamed("w", "near"), "k").where("w < near").select(F.col("w").alias("word"), "near").distinct()
    return pairs.where(one_edit("word", "near"))


@CATALOG.add("j21", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, r.r_name AS figure FROM conversations JOIN region r ON r.r_regionkey = turn")
def positional_zip(spark, sf_dir):
    """The Nth mark meets the Nth figure."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns")).select("conv_id", F.posexplode("turns").alias("pos", "turn"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("figure"))
    return c.join(r, "pos").select("conv_id", "turn", (F.col("pos") + 1).alias("place"), "figure")


@CATALOG.add("j22", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def labels_of_keys(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@CATALOG.add("j23", "SELECT o_orderkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_shipdate < TIMESTAMP '1995-01-01' AND o_orderstatus <> 'F'")
def expired_and_open(spark, sf_dir):
    """Passed deadlines whose job is still open."""
    due = table(spark, sf_dir, "lineitem").where(F.expr("l_linenumber = 1 AND l_shipdate < TIMESTAMP_NTZ '1995-01-01'")).select("l_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(due, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey")
