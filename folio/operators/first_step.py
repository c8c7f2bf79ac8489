"""The first extraction step as a whole (S35): cleaned text, its pages with figures in place, column layouts and statistics, from an extractor's
markdown and record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.classify import figures
from folio.operators.cleanup import split_pages
from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()

# Collections of a record whose items have places; least width of an item, and what makes two columns of them.
COLLECTIONS = ["texts", "tables", "pictures", "lists", "key_value_items"]
WIDE, NARROW, LEFT, RIGHT, FEW = 0.1, 0.55, 0.45, 0.55, 4
SCANNED_UNDER = 50
_ITEM = "array<struct<prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>>>"
_RECORD = "pages map<string,struct<size:struct<width:double,height:double>>>, " + ", ".join(f"{c} {_ITEM}" for c in COLLECTIONS)


def page_layouts(records: DataFrame, key: str, json: str) -> DataFrame:
    """(key, page, layout) of every page with items: of those a tenth of the page wide or more, unknown for fewer than four; two columns
    where the middle width is under 0.55 and two centres at least lie on either side; else one."""
    x = records.select(key, F.from_json(json, _RECORD).alias("r"))
    none = F.array().cast(_ITEM)
    items = F.flatten(F.transform(F.concat(*[F.coalesce(F.col(f"r.{c}"), none) for c in COLLECTIONS]), lambda i: F.coalesce(i["prov"], F.array().cast("array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>"))))
    x = x.select(key, "r.pages", F.explode(items).alias("p")).select(key, F.col("p.page_no").alias("page"), F.try_element_at("pages", F.col("p.page_no").cast("string"))["size"]["width"].alias("whole"), F.coalesce("p.bbox.l", F.lit(0.0)).alias("l"), F.coalesce("p.bbox.r", F.lit(0.0)).alias("r"))
    x = x.where((F.col("whole") > 0) & (F.abs(F.col("r") - F.col("l")) >= F.col("whole") * WIDE)).select(key, "page", (F.abs(F.col("r") - F.col("l")) / F.col("whole")).alias("width"), ((F.col("l") + F.col("r")) / 2 / F.col("whole")).alias("centre"))
    x = x.groupBy(key, "page").agg(F.sort_array(F.collect_list("width")).alias("w"), F.count_if(F.col("centre") < LEFT).alias("left"), F.count_if(F.col("centre") > RIGHT).alias("right"))
    middle = F.get("w", F.expr("size(w) div 2"))
    return x.select(key, "page", F.when(F.size("w") < FEW, "unknown").when((middle < NARROW) & (F.col("left") >= 2) & (F.col("right") >= 2), "double_column").otherwise("single_column").alias("layout"))


def first_step(records: DataFrame, key: str, page_images: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, pages, figures) from an extractor's answers (key, markdown, record as JSON).

    documents: key, v0, total_pages, total_chars, chars_per_page, likely_scanned, figure_count; pages: key, page, markdown, layout;
    figures: key, ref_id, caption, page_number.  The text is cleaned (F09), split at page marks (M01) and its image marks become the
    figures of their page, in order (M05, P02); with page_images (key, page_number), a figure whose page has no image goes (J03).
    """
    x = records.select(key, "record", T.nfkc(T.mend_private(F.col("markdown"))).alias("text"))
    found = figures(x, key, "record")
    if page_images is not None:
        found = found.join(page_images.select(key, "page_number").distinct(), [key, "page_number"], "left_semi")
    found = found.withColumn("place", F.regexp_extract("ref_id", "([0-9]+)$", 1).cast("int"))
    ordered = F.sort_array(F.collect_list(F.struct("place", "ref_id", "caption")))
    refs, captions = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<place:int,ref_id:string,caption:string>>")), lambda f: f["ref_id"]), lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<place:int,ref_id:string,caption:string>>")), lambda f: f["caption"])
    whole, by_page = found.groupBy(key).agg(ordered.alias("f")), found.groupBy(key, F.col("page_number").alias("page")).agg(ordered.alias("f"))
    pages = split_pages(x, key, "text").join(by_page, [key, "page"], "left").join(page_layouts(x, key, "record"), [key, "page"], "left")
    pages = pages.select(key, "page", F.length("markdown").alias("chars"), T.figure_references(F.col("markdown"), refs(F.col("f")), captions(F.col("f"))).alias("markdown"), F.coalesce("layout", F.lit("unknown")).alias("layout"))
    count = F.coalesce(F.size(F.from_json("record", "pages map<string,string>")["pages"]), F.lit(0))
    docs = x.select(key, "text", count.alias("total_pages")).join(pages.groupBy(key).agg(F.sum("chars").alias("total_chars")), key, "left").join(whole, key, "left")
    docs = docs.withColumns({"total_pages": F.greatest("total_pages", F.lit(0)), "total_chars": F.coalesce("total_chars", F.lit(0)), "figure_count": F.coalesce(F.size("f"), F.lit(0))})
    mean = F.when(F.col("total_pages") > 0, F.col("total_chars") / F.col("total_pages")).otherwise(0.0)
    docs = docs.select(key, T.figure_references(F.col("text"), refs(F.col("f")), captions(F.col("f"))).alias("v0"), "total_pages", "total_chars", F.round(mean, 1).alias("chars_per_page"), ((mean < SCANNED_UNDER) & (F.col("total_pages") > 0)).alias("likely_scanned"), F.greatest("figure_count", F.lit(0)).alias("figure_count"))
    return docs, pages.drop("chars"), found.drop("place")


def extracted_documents(spark, sf_dir) -> DataFrame:
    """Documents as an extractor answers them: two pages or three, the second with two image marks, and places of their items."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("t"))
    n = (F.col("doc_id") % 2 + 2).cast("int")
    size = '{"size":{"width":600.0,"height":800.0}}'
    box = lambda page, lo, hi: f'{{"prov":[{{"page_no":{page},"bbox":{{"l":{lo},"t":9,"r":{hi},"b":1}}}}]}}'
    texts = ",".join([box(1, 10, 290), box(1, 10, 280), box(1, 310, 590), box(1, 320, 590), box(1, 0, 5), box(2, 10, 590), box(2, 10, 590), box(2, 20, 590), box(2, 10, 580)])
    pictures = '{"text":"one","prov":[{"page_no":2,"bbox":{"l":1,"t":2,"r":3,"b":0}}]},{"text":"","captions":["no","box"],"prov":[]},{"text":"","captions":["a","b]"],"prov":[{"page_no":2,"bbox":{"l":1,"t":2,"r":3,"b":0}}]}'
    record = F.concat(F.lit('{"pages":{"1":' + size + ',"2":' + size), F.when(n == 3, ',"3":' + size).otherwise(""), F.lit("},"), F.lit('"texts":[' + texts + '],"pictures":[' + pictures + "]}"))
    text = F.concat(F.lit("Ｔitle "), "t", F.lit(T.PAGE_BREAK + "ab " + T.IMAGE + " mid " + T.IMAGE + " end " + T.IMAGE), F.when(n == 3, T.PAGE_BREAK + "last").otherwise(T.PAGE_BREAK + " \n"))
    return d.select("doc_id", text.alias("markdown"), record.alias("record"))


_STEP = "SELECT doc_id, regexp_replace(regexp_replace('Title ' || regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g'), '^$', '') AS p1, 'Title ' || regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS raw, 'a-b ![one](figures/figure-1.png) mid ![a b\\]](figures/figure-3.png) end <!-- image -->' AS p2, length('a-b <!-- image --> mid <!-- image --> end <!-- image -->') AS c2, doc_id % 2 = 1 AS three FROM documents"


@CATALOG.add("s35", f"SELECT doc_id, md5(raw || '<!-- PAGE_BREAK -->' || p2 || '<!-- PAGE_BREAK -->' || CASE WHEN three THEN 'last' ELSE ' ' || chr(10) END) AS v0, CASE WHEN three THEN 3 ELSE 2 END AS total_pages, length(p1) + c2 + CASE WHEN three THEN 4 ELSE 0 END AS total_chars, round((length(p1) + c2 + CASE WHEN three THEN 4 ELSE 0 END)::DOUBLE / CASE WHEN three THEN 3 ELSE 2 END, 1) AS chars_per_page, (length(p1) + c2 + CASE WHEN three THEN 4 ELSE 0 END)::DOUBLE / CASE WHEN three THEN 3 ELSE 2 END < 50 AS likely_scanned, 2 AS figure_count FROM ({_STEP})")
def first_steps(spark, sf_dir):
    docs = first_step(extracted_documents(spark, sf_dir), "doc_id")[0]
    return docs.withColumn("v0", F.md5("v0"))


@CATALOG.add("s35_pages", f"SELECT doc_id, page, md5(CASE page WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE 'last' END) AS digest, CASE page WHEN 1 THEN 'double_column' WHEN 2 THEN 'single_column' ELSE 'unknown' END AS layout FROM ({_STEP}), (VALUES (1), (2), (3)) AS t(page) WHERE page < 3 OR three")
def first_pages(spark, sf_dir):
    pages = first_step(extracted_documents(spark, sf_dir), "doc_id")[1]
    return pages.select("doc_id", "page", F.md5("markdown").alias("digest"), "layout")


# Findings that ask for recognition.
SCANNED_FINDINGS = ["scanned_document", "scan_producer"]
LATER_STEPS = ["structure", "headings", "pages", "boundaries", "cleanup"]


def recognise_again(documents: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, rerun): likely scanned by its text, and with a finding (key, code) that says so."""
    asks = found.where(F.col("code").isin(*SCANNED_FINDINGS)).select(F.col(key).alias("__key")).distinct()
    return documents.join(asks, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, (F.col("likely_scanned") & F.col("__key").isNotNull()).alias("rerun"))


def later_steps(documents: DataFrame, key: str) -> DataFrame:
    """(key, step, status) of the steps after the extraction: skipped where that gave no character, else pending."""
    return documents.select(key, F.explode(F.array(*[F.lit(s) for s in LATER_STEPS])).alias("step"), F.when(F.col("total_chars") == 0, "skipped").otherwise("pending").alias("status"))


def scanned_documents(spark, sf_dir) -> DataFrame:
    """Documents of one page in the record, of which every fourth has next to no text and every eighth none, as answered by an extractor."""
    d = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 8 == 0, " \n").when(F.col("doc_id") % 4 == 0, F.concat(F.lit("p. "), F.col("doc_id").cast("string"))).otherwise(F.col("text"))
    return d.select("doc_id", text.alias("markdown"), F.lit('{"pages":{"1":{"size":{"width":600.0,"height":800.0}}}}').alias("record"))


_CHARS = "CASE WHEN doc_id % 8 = 0 THEN 0 WHEN doc_id % 4 = 0 THEN 3 + length(CAST(doc_id AS VARCHAR)) ELSE length(regexp_replace(nfc_normalize(text), '^[ \\n\\t\\r]+|[ \\n\\t\\r]+$', '', 'g')) END"


@CATALOG.add("p13", f"SELECT doc_id, {_CHARS} < 50 AND doc_id % 3 <> 2 AS rerun FROM documents")
def reruns(spark, sf_dir):
    docs = first_step(scanned_documents(spark, sf_dir), "doc_id")[0]
    k = F.col("doc_id") % 3
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(F.when(k == 0, "scanned_document").when(k == 1, "scan_producer").otherwise("low_text_density"), F.lit("mixed_orientation"))).alias("code"))
    return recognise_again(docs, found, "doc_id")


@CATALOG.add("p14", f"SELECT doc_id, s AS step, CASE WHEN {_CHARS} = 0 THEN 'skipped' ELSE 'pending' END AS status FROM documents, (VALUES ('structure'), ('headings'), ('pages'), ('boundaries'), ('cleanup')) AS t(s)")
def skipped_steps(spark, sf_dir):
    return later_steps(first_step(scanned_documents(spark, sf_dir), "doc_id")[0], "doc_id")
