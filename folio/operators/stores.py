"""Object stores: what is written is read again, through the readers and writers of folio.sources."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.operators.classify import LANGUAGES
from folio.operators.structure import paged_conversations
from folio.plans.catalog import Catalog
from folio.functions.ranks import numbered
from folio.sources import objects as O
from folio.sources import tables as S
from folio.sources.tables import table

CATALOG = Catalog()

LEAST, MOST = 100, 50 << 20


def _folder(spark, name: str) -> str:
    return f"{S.work_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def result_key(job: Column, suffix: Column | None = None, ending: str = "md") -> Column:
    """results/<job>/result.md, or result_<suffix>.md."""
    name = F.lit("result") if suffix is None else F.concat(F.lit("result_"), suffix)
    return F.concat(F.lit("results/"), job.cast("string"), F.lit("/"), name, F.lit(f".{ending}"))


def _texts(spark, sf_dir) -> DataFrame:
    """Nations as jobs with a result text each."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("job_id"), F.concat(F.lit("# "), "n_name", F.lit(" "), F.repeat(F.lit("text "), 20)).alias("markdown"))


TEXTS_SQL = "SELECT n_nationkey AS job_id, '# ' || n_name || ' ' || repeat('text ', 20) AS markdown FROM nation"


def admission(length: Column, mime: Column, most: int = MOST) -> Column:
    """What becomes of an upload by its type and size."""
    return F.when(mime != "application/pdf", "wrong_type").when(length < LEAST, "too_small").when(length > most, "too_large").otherwise("stored")


@CATALOG.add("s01", "SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'wrong_type' WHEN octet_length(encode(html)) < 100 THEN 'too_small' WHEN octet_length(encode(html)) > 9000 THEN 'too_large' ELSE 'stored' END AS status, page_id % 4 <> 3 AND octet_length(encode(html)) BETWEEN 100 AND 9000 AS has_key FROM pages")
def ingested(spark, sf_dir):
    """Uploads with a status; stored ones get a job id and its key."""
    mime = F.when(F.col("page_id") % 4 == 3, "text/html").otherwise("application/pdf")
    x = table(spark, sf_dir, "pages").select("page_id", admission(F.octet_length("html"), mime, 9000).alias("status"), F.uuid().alias("job"))
    key = F.when(F.col("status") == "stored", F.format_string("temp/%s.pdf", "job"))
    return x.select("page_id", "status", (key.rlike("^temp/[-0-9a-f]{36}[.]pdf$") & key.isNotNull()).alias("has_key"))


@CATALOG.add("s02", f"SELECT job_id, md5(markdown || chr(10)) AS digest, 'stored' AS status FROM ({TEXTS_SQL})")
def temp_objects(spark, sf_dir):
    """Temp objects with a key, their bytes and a status by size; a lost task fetches its objects again."""
    path = _folder(spark, "temp")
    O.put(_texts(spark, sf_dir).select(F.format_string("temp/%d.pdf", "job_id").alias("key"), F.concat("markdown", F.lit("\n")).alias("content")), path)
    got = O.get(spark, path, _texts(spark, sf_dir).select("job_id", F.format_string("temp/%d.pdf", "job_id").alias("key")))
    return got.select("job_id", F.md5("content").alias("digest"), admission(F.octet_length("content"), F.col("content_type")).alias("status"))


@CATALOG.add("s03", TEXTS_SQL)
def result_objects(spark, sf_dir):
    """Final markdown by job, written and read by key."""
    path = _folder(spark, "results")
    keyed = _texts(spark, sf_dir).withColumn("key", result_key(F.col("job_id")))
    O.put(keyed.select("key", F.col("markdown").alias("content")), path)
    return O.get(spark, path, keyed.select("job_id", "key")).select("job_id", F.decode("content", "UTF-8").alias("markdown"))


@CATALOG.add("s04", f"SELECT job_id, suffix, md5(markdown || suffix) AS digest FROM ({TEXTS_SQL}), (VALUES ('v1'), ('v2')) AS t(suffix)")
def suffixed_results(spark, sf_dir):
    """Result texts with a suffix in their key."""
    path = _folder(spark, "suffixed")
    x = _texts(spark, sf_dir).withColumn("suffix", F.explode(F.array(F.lit("v1"), F.lit("v2")))).withColumn("key", result_key(F.col("job_id"), F.col("suffix")))
    O.put(x.select("key", F.concat("markdown", "suffix").alias("content")), path)
    return O.read(spark, path).select(F.regexp_extract("key", "results/([0-9]+)/", 1).cast("int").alias("job_id"), F.regexp_extract("key", "_(v[12])[.]md$", 1).alias("suffix"), F.md5("content").alias("digest"))


def figure_objects(images: DataFrame, key: str, folder: str) -> DataFrame:
    """(key, content) of images (key column, ref_id, image_base64: plain, or a data: address); rows without data, or whose
    data isn't base64, are skipped."""
    raw = F.try_to_binary(F.regexp_replace("image_base64", "^data:[^,]*,", ""), F.lit("base64"))
    x = images.select(F.concat(F.lit("results/"), F.col(key).cast("string"), F.lit(f"/{folder}/"), "ref_id", F.lit(".png")).alias("key"), raw.alias("content"))
    return x.where(F.octet_length("content") > 0)


def _images(spark, sf_dir) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(k.alias("job_id"), F.when(k % 3 != 1, F.base64(F.encode(F.col("n_name"), "UTF-8"))).alias("image_base64"))


@CATALOG.add("s05", "SELECT n_nationkey AS job_id, octet_length(encode(n_name)) AS n FROM nation WHERE n_nationkey % 3 <> 1")
def figure_images(spark, sf_dir):
    """Images are decoded and put under their job's key; those without data are skipped."""
    path = _folder(spark, "figures")
    O.put(figure_objects(_images(spark, sf_dir).withColumn("ref_id", F.lit("figure-1")), "job_id", "figures"), path)
    return O.listing(spark, path).select(F.regexp_extract("key", "results/([0-9]+)/", 1).cast("int").alias("job_id"), F.col("size").cast("int").alias("n"))


@CATALOG.add("s06", "SELECT n_nationkey AS job_id, n_name AS image, 'image/png' AS content_type FROM nation WHERE n_nationkey % 3 <> 1")
def page_images(spark, sf_dir):
    path = _folder(spark, "pages")
    O.put(figure_objects(_images(spark, sf_dir).withColumn("ref_id", F.lit("page-1")), "job_id", "pages"), path)
    return O.read(spark, path).select(F.regexp_extract("key", "results/([0-9]+)/", 1).cast("int").alias("job_id"), F.decode("content", "UTF-8").alias("image"), "content_type")


@CATALOG.add("s07", "SELECT 'job_id=' || n_nationkey AS key FROM nation WHERE n_nationkey % 2 = 0")
def existing_keys(spark, sf_dir):
    """Of all keys, those that the store holds."""
    path = _folder(spark, "half")
    key = F.format_string("job_id=%d", "job_id").alias("key")
    O.put(_texts(spark, sf_dir).where("job_id % 2 = 0").select(key, F.col("markdown").alias("content")), path)
    return O.exists(spark, path, _texts(spark, sf_dir).select(key))


def _results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("cost"), F.array("o_orderpriority").alias("issues")).alias("result"))


@CATALOG.add("s08", "SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS cost FROM orders")
def loaded_results(spark, sf_dir):
    """The stored result of each job, null where there is none."""
    path = _folder(spark, "json")
    _results(spark, sf_dir).where("job_id % 3 <> 0").write.json(path)
    got = S.json_results(spark, path, "job_id long, result struct<cost: double, issues: array<string>>")
    return _results(spark, sf_dir).select("job_id").join(got, "job_id", "left").select("job_id", "result.cost")


@CATALOG.add("s09", "SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderpriority AS issue FROM orders")
def saved_results(spark, sf_dir):
    """Processing results as JSON, by status."""
    path = _folder(spark, "by_status")
    S.write_results(_results(spark, sf_dir), path, "status")
    return spark.read.schema("job_id long, result struct<cost: double, issues: array<string>>, status string").json(path).select("job_id", "status", F.get("result.issues", F.lit(0)).alias("issue"))


@CATALOG.add("s10", f"SELECT job_id, length(markdown) AS n FROM ({TEXTS_SQL})")
def final_markdown(spark, sf_dir):
    path = _folder(spark, "final")
    keyed = _texts(spark, sf_dir).withColumn("key", result_key(F.col("job_id")))
    O.put(keyed.select("key", F.col("markdown").alias("content")), path)
    return O.get(spark, path, keyed.select("job_id", "key")).select("job_id", F.length(F.decode("content", "UTF-8")).alias("n"))


@CATALOG.add("s12", "SELECT o_orderkey AS job_id, 'results/' || o_orderkey || '/result.md' AS key, 'text/markdown' AS content_type, md5('# ' || o_orderpriority || ' ' || o_orderstatus) AS digest FROM orders")
def stored_markdown(spark, sf_dir):
    """The final markdown of every order under results/<job>/result.md: as many objects, a few files."""
    path = _folder(spark, "markdown")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), result_key(F.col("o_orderkey")).alias("key"), F.concat(F.lit("# "), "o_orderpriority", F.lit(" "), "o_orderstatus").alias("content"))
    O.put(o.select("key", "content"), path)
    return O.get(spark, path, o.select("job_id", "key")).select("job_id", "key", "content_type", F.md5("content").alias("digest"))


@CATALOG.add("s11", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'application/json' WHEN 2 THEN 'image/png' ELSE 'application/octet-stream' END AS content_type, octet_length(encode(p_name)) AS n FROM part")
def puts(spark, sf_dir):
    """Any content under a key, with the type that its ending tells."""
    path = _folder(spark, "puts")
    k = F.col("p_partkey") % 4
    key = F.concat(F.lit("results/"), F.col("p_partkey").cast("string"), F.when(k == 0, ".md").when(k == 1, ".JSON").when(k == 2, ".png").otherwise(".x"))
    O.put(table(spark, sf_dir, "part").select(key.alias("key"), F.encode("p_name", "UTF-8").alias("content")), path)
    return O.listing(spark, path).select(F.regexp_extract("key", "/([0-9]+)[.]", 1).cast("long").alias("p_partkey"), "content_type", F.col("size").cast("int").alias("n"))


def ledger(steps: DataFrame, key: str) -> DataFrame:
    """The change ledger of each document as JSON.  steps: key, ord, name, elapsed_ms, input_tokens, output_tokens, cost_cents, changes array."""
    each = F.sort_array(F.collect_list(F.struct("ord", "name", "elapsed_ms", "input_tokens", "output_tokens", "cost_cents", "changes")))
    return steps.groupBy(key).agg(F.to_json(F.struct(F.first(key).alias("document_id"), F.transform(each, lambda s: s.dropFields("ord")).alias("steps"), F.sum(F.size("changes")).alias("total_edits"))).alias("ledger"))


@CATALOG.add("s13", "SELECT l_orderkey, count(*) AS steps, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS total_edits, arg_min(l_shipmode, (l_linenumber, l_shipmode)) AS first_step FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def stored_ledgers(spark, sf_dir):
    """Ledgers put as JSON under their document's key and read again."""
    path = _folder(spark, "ledgers")
    change = F.struct(F.col("l_linenumber").alias("page"), F.lit("a").alias("old_text"), F.lit("b").alias("new_text"), F.lit("c").alias("reasoning"), F.lit("page").alias("stage"))
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").cast("int").alias("elapsed_ms"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.col("l_tax").alias("cost_cents"), F.when(F.col("l_linenumber") % 2 == 0, F.array(change)).otherwise(F.array().cast("array<struct<page:int,old_text:string,new_text:string,reasoning:string,stage:string>>")).alias("changes"))
    O.put(ledger(steps, "l_orderkey").select(F.format_string("results/%d/ledger.json", "l_orderkey").alias("key"), F.col("ledger").alias("content")), path)
    got = O.read(spark, path).select(F.from_json(F.decode("content", "UTF-8"), "document_id long, steps array<struct<name: string, changes: array<struct<page: int>>>>, total_edits long").alias("r")).select("r.*")
    return got.select(F.col("document_id").alias("l_orderkey"), F.size("steps").cast("long").alias("steps"), "total_edits", F.get("steps", F.lit(0))["name"].alias("first_step"))


@CATALOG.add("s14", "SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE doc_id % 2 = 0")
def stored_figures(spark, sf_dir):
    """Figures of an extractor's record, read from its pictures' data addresses and stored; pictures without image data are skipped."""
    path = _folder(spark, "record_figures")
    image = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), F.base64(F.encode("text", "UTF-8"))))
    record = F.to_json(F.struct(F.array(F.struct(F.lit("#/pictures/0").alias("self_ref"), F.struct(image.alias("uri")).alias("image"))).alias("pictures")))
    found = table(spark, sf_dir, "documents").select("doc_id", record.alias("record")).select("doc_id", F.from_json("record", "pictures array<struct<self_ref:string,image:struct<uri:string>>>").alias("r"))
    pictures = found.select("doc_id", F.posexplode("r.pictures").alias("n", "p")).select("doc_id", F.format_string("figure-%d", F.col("n") + 1).alias("ref_id"), F.col("p.image.uri").alias("image_base64"))
    O.put(figure_objects(pictures, "doc_id", "figures"), path)
    return O.listing(spark, path).select(F.regexp_extract("key", "results/([0-9]+)/", 1).cast("long").alias("doc_id"), F.col("size").alias("n"))


@CATALOG.add("s15", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 1 END AS edits FROM events")
def read_ledgers(spark, sf_dir):
    """A stored ledger's edits; null where there is none (every eighth) or what is there can't be read (cut off in the middle)."""
    path = _folder(spark, "broken_ledgers")
    e = table(spark, sf_dir, "events").select("event_id", F.format_string("results/%d/ledger.json", "event_id").alias("key"), F.lit('{"steps":[],"total_edits":1}').alias("whole"))
    stored = e.where("event_id % 8 <> 0").select("key", F.when(F.col("event_id") % 8 == 4, F.substring("whole", 1, 17)).otherwise(F.col("whole")).alias("content"))
    O.put(stored, path)
    got = O.get(spark, path, e.select("event_id", "key"))
    return got.select("event_id", F.from_json(F.decode("content", "UTF-8"), "total_edits int")["total_edits"].alias("edits"))


@CATALOG.add("s37", "SELECT o_orderkey, 'temp/' || o_orderkey || '.pdf' AS deleted FROM orders WHERE o_orderstatus = 'F'")
def deletions(spark, sf_dir):
    """Temp objects of finished orders are deleted, half of which the store never had; a key counts as deleted once it isn't there."""
    path = _folder(spark, "deleted")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.format_string("temp/%d.pdf", "o_orderkey").alias("key"))
    O.put(o.where("o_orderkey % 2 = 0").select("key", F.lit("%PDF").alias("content")), path)
    asked = o.where("o_orderstatus = 'F'")
    O.delete(asked.select("key"), path)
    return asked.join(O.listing(spark, path).select("key"), "key", "left_anti").select("o_orderkey", F.col("key").alias("deleted"))


@CATALOG.add("s22", f"SELECT row_number() OVER (ORDER BY CAST(job_id AS VARCHAR)) AS place, job_id FROM ({TEXTS_SQL})")
def globbed(spark, sf_dir):
    """Keys by pattern, in order, with their places; numbered in ranges, not in one task."""
    path = _folder(spark, "glob")
    O.put(_texts(spark, sf_dir).select(F.format_string("in/%d.pdf", "job_id").alias("key"), F.col("markdown").alias("content")), path)
    names = O.listing(spark, path).where(F.col("key").rlike("^in/.*[.]pdf$")).select(F.regexp_extract("key", "in/(.*)[.]pdf", 1).alias("s"), F.lit(0).alias("all"))
    leading = F.conv(F.hex(F.encode(F.rpad("s", 6, "\x00"), "UTF-8")), 16, 10).cast("double")
    return numbered(names.withColumn("leading", leading), "all", ["leading", "s"]).select(F.col("place").cast("long").alias("place"), F.col("s").cast("int").alias("job_id"))


@CATALOG.add("s23", "SELECT count(*) AS documents, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS completed, round(sum(o_totalprice), 2) AS cost FROM orders")
def batch_summary(spark, sf_dir):
    """Results of each document as JSON, and a summary of what was written."""
    path = _folder(spark, "batch")
    S.write_results(_results(spark, sf_dir), path, "status")
    back = spark.read.schema("job_id long, result struct<cost: double>, status string").json(path)
    summary = back.agg(F.count("*").alias("documents"), F.sum((F.col("status") == "F").cast("long")).alias("completed"), F.round(F.sum("result.cost"), 2).alias("cost"))
    summary.coalesce(1).write.json(path + "-summary")
    return spark.read.schema("documents long, completed long, cost double").json(path + "-summary")


def bundles(docs: DataFrame, figures: DataFrame, key: str) -> DataFrame:
    """(key, bundle): a zip of each document's markdown and its figures, in batches of documents; figures: key, ref_id, image (binary)."""
    each = figures.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ref_id", "image"))).alias("figures"))

    def pack(frames):
        import io
        import zipfile

        for frame in frames:
            out = []
            for name, text, images in zip(frame[key], frame["markdown"], frame["figures"], strict=True):
                sink = io.BytesIO()
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr(zipfile.ZipInfo(f"{name}.md"), text)
                    for f in images if images is not None else []:
                        z.writestr(zipfile.ZipInfo(f"figures/{f['ref_id']}.png"), bytes(f["image"]))
                out.append(sink.getvalue())
            yield frame[[key]].assign(bundle=out)

    return docs.join(each, key, "left").select(key, "markdown", "figures").mapInPandas(pack, f"{key} {docs.schema[key].dataType.simpleString()}, bundle binary")


@CATALOG.add("s24")
def bundled(spark, sf_dir):
    figures = _images(spark, sf_dir).where("image_base64 IS NOT NULL").select("job_id", F.lit("figure-1").alias("ref_id"), F.unbase64("image_base64").alias("image"))
    return bundles(_texts(spark, sf_dir), figures, "job_id").select("job_id", F.octet_length("bundle").alias("n"))


@CATALOG.add("s25", f"SELECT job_id, true AS old, length(markdown) + 1 AS size FROM ({TEXTS_SQL})")
def old_objects(spark, sf_dir):
    """Objects older than 24 hours, seen two days from now; none is seen an hour from now."""
    path = _folder(spark, "aged")
    O.put(_texts(spark, sf_dir).select(F.format_string("temp/%d.pdf", "job_id").alias("key"), F.concat("markdown", F.lit("\n")).alias("content")), path)
    older = lambda ahead: O.listing(spark, path).where(F.expr(f"current_timestamp() + INTERVAL {ahead} HOURS") - F.col("written_at") > F.expr("INTERVAL 24 HOURS"))
    both = older(48).withColumn("old", F.lit(True)).unionByName(older(1).withColumn("old", F.lit(False)))
    return both.select(F.regexp_extract("key", "temp/([0-9]+)", 1).cast("int").alias("job_id"), "old", "size")


def feedback_records(edits: DataFrame, issues: DataFrame) -> DataFrame:
    """User edits (document_id, page, old_text, new_text) and issue reports (document_id, page, category, description) as one table of
    records with a payload each; an edit's category is content, an issue's other where it has none."""
    e = edits.select("document_id", "page", F.lit("user_edit").alias("feedback_type"), F.lit("content").alias("category"), F.col("old_text").alias("original_text"), F.col("new_text").alias("corrected_text"), F.lit(None).cast("string").alias("description"))
    i = issues.select("document_id", "page", F.lit("issue_report").alias("feedback_type"), F.coalesce("category", F.lit("other")).alias("category"), F.lit(None).cast("string").alias("original_text"), F.lit(None).cast("string").alias("corrected_text"), "description")
    x = e.unionByName(i)
    return x.withColumn("payload", F.to_json(F.struct(*x.columns)))


def deliver(records: DataFrame, key: str, payload: str, send, batch: int = 100) -> DataFrame:
    """Records given to send(text) one by one, or as {"items": [...]} of up to `batch` where there are several; what send raises is
    swallowed and shows as not delivered."""

    def post(frames):
        for frame in frames:
            sent = []
            for k in range(0, len(frame), batch):
                part = frame[payload].iloc[k : k + batch].tolist()
                try:
                    send(part[0] if len(part) == 1 else '{"items":[' + ",".join(part) + "]}")
                    sent += [True] * len(part)
                except Exception:  # noqa: BLE001
                    sent += [False] * len(part)
            yield frame[[key]].assign(delivered=sent)

    return records.select(key, payload).mapInPandas(post, f"{key} {records.schema[key].dataType.simpleString()}, delivered boolean")


def _feedback(spark, sf_dir) -> DataFrame:
    l = table(spark, sf_dir, "labels")
    edits = l.where("toxic = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.lit("a").alias("old_text"), F.col("quality").cast("string").alias("new_text"))
    issues = l.where("toxic = 1").select(F.col("doc_id").alias("document_id"), F.lit(2).alias("page"), F.when(F.col("quality") == 1, "layout").alias("category"), F.lit("toxic").alias("description"))
    return feedback_records(edits, issues)


@CATALOG.add("s30", "SELECT doc_id AS document_id, CASE WHEN toxic = 0 THEN '{\"document_id\":' || doc_id || ',\"page\":1,\"feedback_type\":\"user_edit\",\"category\":\"content\",\"original_text\":\"a\",\"corrected_text\":\"' || quality || '\"}' ELSE '{\"document_id\":' || doc_id || ',\"page\":2,\"feedback_type\":\"issue_report\",\"category\":\"' || CASE WHEN quality = 1 THEN 'layout' ELSE 'other' END || '\",\"description\":\"toxic\"}' END AS payload FROM labels")
def feedback(spark, sf_dir):
    return _feedback(spark, sf_dir).select("document_id", "payload")


def _refuse_issues(text: str) -> None:
    if "issue_report" in text:
        raise OSError("no such endpoint")


@CATALOG.add("s29", "SELECT doc_id AS document_id, toxic = 0 AS delivered FROM labels")
def delivered(spark, sf_dir):
    """S29 with a sender that refuses issue reports, one record at a time."""
    return deliver(_feedback(spark, sf_dir), "document_id", "payload", _refuse_issues, 1)


@CATALOG.add("s39", "SELECT page_id, CASE WHEN length(html) > 0 AND page_id % 6 <> 0 THEN 'archive/' || page_id || '.pdf' END AS ref FROM pages")
def archived(spark, sf_dir):
    """Originals go to the archive; the reference is null where there is no content or the archive did not take it."""
    path = _folder(spark, "archive")
    key = F.format_string("archive/%d.pdf", "page_id").alias("key")
    p = table(spark, sf_dir, "pages").select("page_id", key, F.when(F.col("page_id") % 6 != 0, F.encode("html", "UTF-8")).alias("content"))
    O.put(p.where("octet_length(content) > 0").select("key", "content"), path)
    return p.select("page_id", "key").join(O.listing(spark, path).select("key", F.col("key").alias("ref")), "key", "left").select("page_id", "ref")


def submit(uploads: DataFrame, known: list[str], most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, jobs, queue) of uploads (upload_id, length, mime, ocr_languages, skip_scan): unknown languages, wrong types and sizes are
    refused; others become a job, which waits for the scan in the queue or starts at once where the scan is skipped."""
    bad = F.filter(F.coalesce("ocr_languages", F.array().cast("array<string>")), lambda c: ~c.isin(*known))
    status = admission(F.col("length"), F.col("mime"), most)
    x = uploads.withColumn("answer", F.when(F.size(bad) > 0, F.concat(F.lit("invalid languages: "), F.array_join(bad, ","))).when(status != "stored", status).when(F.col("skip_scan"), "processing").otherwise("pii_scanning"))
    jobs = x.where("answer IN ('processing', 'pii_scanning')").select("upload_id", F.format_string("temp/%d.pdf", F.col("upload_id").cast("long")).alias("s3_key"), F.col("answer").alias("status"))
    return x.select("upload_id", "answer"), jobs, jobs.where("status = 'pii_scanning'").select("upload_id", "s3_key")


def _uploads(spark, sf_dir) -> DataFrame:
    k = F.col("page_id")
    langs = F.when(k % 5 == 0, F.array(F.lit("eng"), F.lit("xx"), F.lit("yy"))).when(k % 5 == 1, F.lit(None).cast("array<string>")).otherwise(F.array(F.lit("deu"), F.get(F.array(*[F.lit(c) for c in LANGUAGES]), (k % len(LANGUAGES)).cast("int"))))
    return table(spark, sf_dir, "pages").select(k.alias("upload_id"), F.octet_length("html").alias("length"), F.lit("application/pdf").alias("mime"), langs.alias("ocr_languages"), (k % 2 == 0).alias("skip_scan"))


@CATALOG.add("s33", "SELECT page_id AS upload_id, CASE WHEN page_id % 5 = 0 THEN 'invalid languages: xx,yy' WHEN octet_length(encode(html)) < 100 THEN 'too_small' WHEN octet_length(encode(html)) > 9000 THEN 'too_large' WHEN page_id % 2 = 0 THEN 'processing' ELSE 'pii_scanning' END AS answer FROM pages")
def submissions(spark, sf_dir):
    return submit(_uploads(spark, sf_dir), list(LANGUAGES), 9000)[0]


@CATALOG.add("s33_queue", "SELECT page_id AS upload_id, 'temp/' || page_id || '.pdf' AS s3_key FROM pages WHERE page_id % 5 <> 0 AND page_id % 2 = 1 AND octet_length(encode(html)) BETWEEN 100 AND 9000")
def queued(spark, sf_dir):
    return submit(_uploads(spark, sf_dir), list(LANGUAGES), 9000)[2]


def reextract(first: DataFrame, again: DataFrame, key: str) -> DataFrame:
    """(key, page, markdown, source): all pages of documents that were recognised again come from there, unsanitised; the others stay."""
    stay = first.join(again.select(key).distinct(), key, "left_anti").select(key, "page", "markdown", F.lit("first").alias("source"))
    return stay.unionByName(again.select(key, "page", "markdown", F.lit("again").alias("source")))


@CATALOG.add("s34", "SELECT conv_id, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN n < 3 THEN 'again' ELSE 'first' END AS source FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def reextracted(spark, sf_dir):
    """S34 for conversations of fewer than three turns."""
    first = paged_conversations(spark, sf_dir)
    few = first.groupBy("conv_id").agg(F.count("*").alias("n")).where("n < 3").select("conv_id")
    return reextract(first, first.join(few, "conv_id").withColumn("markdown", F.upper("markdown")), "conv_id").select("conv_id", "page", "source")


def transport(outcomes: DataFrame, key: str, most: int = 3) -> DataFrame:
    """(key, calls, answer) from what each call to the extractor met (key, n from 1, code or failure): unreachable, timed out, 503 and other
    5xx are called again, up to `most` calls; 504 and 4xx never; 200 is the answer."""
    again = F.coalesce(F.col("failure").isin("unreachable", "timeout"), F.lit(False)) | F.coalesce((F.col("code") >= 500) & (F.col("code") != 504), F.lit(False))
    stop = F.max((~again).cast("int")).over(W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, -1))
    made = outcomes.withColumn("stop", F.coalesce(stop, F.lit(0))).where((F.col("stop") == 0) & (F.col("n") <= most))
    last = F.max_by(F.coalesce("failure", F.col("code").cast("string")), "n")
    return made.groupBy(key).agg(F.count("*").alias("calls"), last.alias("answer"))


@CATALOG.add("s36", "SELECT user_id, count(*) AS calls, arg_max(answer, n) AS answer FROM (SELECT *, coalesce(max(CASE WHEN answer IN ('unreachable', '503', '500') THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'click' THEN 'unreachable' WHEN 'view' THEN '503' WHEN 'purchase' THEN '200' WHEN 'error' THEN '504' ELSE '500' END AS answer FROM events)) WHERE stop = 0 AND n <= 3 GROUP BY user_id")
def calls(spark, sf_dir):
    k = F.col("event_type")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"), F.when(k == "view", 503).when(k == "purchase", 200).when(k == "error", 504).when(k != "click", 500).alias("code"), F.when(k == "click", "unreachable").alias("failure"))
    return transport(e, "user_id")


@CATALOG.add("s38", "SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg(regexp_replace(text, '^[ \\n\\t]+|[ \\n\\t]+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) ELSE '404' END AS body FROM conversations GROUP BY conv_id")
def minimal_endpoint(spark, sf_dir):
    """Extraction alone, pages in numeric order of their string keys, in development mode (even ids) only; else not found."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("page"), T.strip(F.col("text")).alias("text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("page").cast("int").alias("p"), "text"))), lambda v: v["text"]), "\n\n")
    return c.groupBy("conv_id").agg(whole.alias("body")).select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("body")).otherwise("404").alias("body"))
