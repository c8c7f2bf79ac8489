"""Classification, predicates over documents, and detection and masking of personal data (P, D)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions import text as T
from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()

# Thresholds, producer words, language codes, patterns of personal data with their scores.
SCANNED_PER_PAGE, SPARSE_PER_PAGE, PRESENTATION_SHARE = 50, 200, 0.6
SCANNERS = ["adobe scan", "camscanner", "scanbot", "genius scan", "microsoft lens", "office lens", "epson scan", "hp scan", "brother scan", "fujitsu scansnap", "vuescan", "naps2", "readiris", "abbyy finereader", "tesseract", "ocrmypdf"]
PRESENTERS = ["microsoft powerpoint", "impress", "keynote", "google slides"]
SPREADSHEETS = ["microsoft excel", "calc", "google sheets"]
#: Area of a sheet A0 in points, and what may be over it; how much longer than wide a page must be to be no square.
A0, OVER, SQUARE = 2384 * 3370, 1.1, 1.05
#: Recognition languages and the codes that the extractor takes for them.
LANGUAGES = {
    "eng": "en", "spa": "es", "fra": "fr", "deu": "de", "chi_sim": "ch_sim", "chi_tra": "ch_tra", "jpn": "ja", "kor": "ko", "ara": "ar", "hin": "hi", "por": "pt",
    "ita": "it", "rus": "ru", "nld": "nl", "pol": "pl", "tur": "tr", "vie": "vi", "tha": "th", "ukr": "uk", "ces": "cs", "swe": "sv", "nor": "no", "dan": "da",
    "fin": "fi", "hun": "hu", "ron": "ro", "bul": "bg", "hrv": "hr", "slk": "sk", "slv": "sl", "ell": "el", "heb": "he", "ind": "id", "msa": "ms", "ben": "bn",
    "tam": "ta", "tel": "te", "kan": "kn", "mal": "ml", "mar": "mr", "nep": "ne", "urd": "ur",
}
#: Errors of a store by their code, and answers by their status, that are worth another try; codes that never are.
AGAIN_CODES = ["RequestTimeout", "ServiceUnavailable", "ThrottlingException", "RequestThrottled", "InternalError", "SlowDown", "TooManyRequestsException", "ProvisionedThroughputExceededException"]
NEVER_CODES = ["NoSuchKey", "NoSuchBucket", "AccessDenied", "InvalidRequest", "InvalidArgument", "MalformedXML", "InvalidBucketName"]
AGAIN_STATUS = [408, 429, 500, 502, 503, 504]
ENTITIES = [
    ("EMAIL_ADDRESS", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0),
    ("US_SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0.85),
    ("PHONE_NUMBER", r"\+?[0-9]{1,3}[ .-]\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}\b", 0.75),
    ("CREDIT_CARD", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b", 1.0),
    ("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 1.0),
    ("US_DRIVER_LICENSE", r"\b[A-Z][0-9]{6,8}\b", 0.3),
]
#: Words that make a match of a kind likelier when they stand shortly before it; how much, at least to what, and how many words before.
CONTEXT = {
    "EMAIL_ADDRESS": ["email", "mail"], "US_SSN": ["social", "security", "ssn", "ssns", "ssid"], "PHONE_NUMBER": ["phone", "number", "telephone", "cell", "cellphone", "mobile", "call"],
    "CREDIT_CARD": ["credit", "card", "visa", "mastercard", "cc", "amex", "discover", "jcb", "diners", "maestro"], "IBAN_CODE": ["iban", "bank", "transaction"],
    "US_DRIVER_LICENSE": ["driver", "license", "permit", "lic", "identification", "dls", "cdls", "driving"],
}
#: What every match of a kind holds.
SIGNS = {"EMAIL_ADDRESS": "@"}
LIFT, LIFT_LEAST, WORDS_BEFORE = 0.35, 0.4, 5
PAGE = "greatest(CAST(ceil(n_chars / 1000.0) AS INTEGER), 1)"


def _pages() -> Column:
    return F.greatest(F.ceil(F.col("n_chars") / 1000.0).cast("int"), F.lit(1))


@CATALOG.add("p01", "SELECT page_id, 612.0 AS width, 792.0 AS height, CAST(page_id % 3 + 1 AS INTEGER) AS page_count FROM pages")
def page_info(spark, sf_dir):
    """Page count and first page's size from extractor JSON."""
    one = F.lit('":{"size":{"width":612.0,"height":792.0}}')
    json = F.concat(F.lit('{"pages":{'), F.array_join(F.transform(F.sequence(F.lit(1), (F.col("page_id") % 3 + 1).cast("int")), lambda i: F.concat(F.lit('"'), i.cast("string"), one)), ","), F.lit("}}"))
    x = table(spark, sf_dir, "pages").select("page_id", F.from_json(json, "pages map<string, struct<size: struct<width: double, height: double>>>").alias("j"))
    return x.select("page_id", F.element_at("j.pages", "1")["size"]["width"].alias("width"), F.element_at("j.pages", "1")["size"]["height"].alias("height"), F.size("j.pages").alias("page_count"))


PICTURES = "pictures array<struct<text: string, captions: array<string>, prov: array<struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double>>>>>"


def figures(rows: DataFrame, key: str, json: str) -> DataFrame:
    """Pictures that have a box; numbers are places in the original list, so dropped ones leave gaps."""
    x = rows.select(key, F.posexplode(F.from_json(json, PICTURES)["pictures"]).alias("pos", "p"))
    caption = F.coalesce(F.nullif(F.col("p.text"), F.lit("")), F.concat_ws(" ", "p.captions"))
    return x.where(F.get("p.prov", F.lit(0))["bbox"].isNotNull()).select(key, F.concat(F.lit("figure-"), (F.col("pos") + 1).cast("string")).alias("ref_id"), caption.alias("caption"), F.get("p.prov", F.lit(0))["page_no"].alias("page_number"))


@CATALOG.add("p02", "SELECT page_id, 'figure-' || k AS ref_id, CASE k WHEN 1 THEN url ELSE 'c1 c2' END AS caption, CAST(k AS INTEGER) AS page_number FROM pages, (VALUES (1), (3)) AS t(k)")
def figures_of_pages(spark, sf_dir):
    box = '{"l":1,"t":2,"r":3,"b":0}'
    json = F.concat(F.lit('{"pictures":[{"text":"'), F.col("url"), F.lit('","prov":[{"page_no":1,"bbox":' + box + '}]},{"text":"no box","prov":[]},{"text":"","captions":["c1","c2"],"prov":[{"page_no":3,"bbox":' + box + "}]}]}"))
    return figures(table(spark, sf_dir, "pages").withColumn("j", json), "page_id", "j")


@CATALOG.add("p05", "SELECT conv_id, turn, NOT starts_with(l, '#') AND length(regexp_extract(l, '^(.+?)\\s+(\\d+)\\s*$', 1)) < 80 AND regexp_matches(l, '^(.+?)\\s+(\\d+)\\s*$') AND TRY_CAST(regexp_extract(l, '^(.+?)\\s+(\\d+)\\s*$', 2) AS INTEGER) = turn + 1 AS header FROM (SELECT conv_id, turn, string_split(text, ' ')[1] || ' Report ' || (turn % 3 + 1) AS l FROM conversations)")
def running_headers(spark, sf_dir):
    """P05, pattern branch: a short line that ends in the page's number."""
    line = F.concat(F.get(F.split("text", " "), F.lit(0)), F.lit(" Report "), (F.col("turn") % 3 + 1).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", running_header(line, F.col("turn") + 1).alias("header"))


def running_header(line: Column, page: Column, title: Column | None = None) -> Column:
    """No heading, and like the title but for digits and blanks at its end (at least 0.7), or a short text before the page's number."""
    line, pattern = T.strip(line), r"^(.+?)\s+(\d+)\s*$"
    hit = line.rlike(pattern) & F.coalesce(F.regexp_extract(line, pattern, 2).try_cast("int") == page, F.lit(False)) & (F.length(F.regexp_extract(line, pattern, 1)) < 80)
    if title is not None:
        x, y = F.regexp_replace(F.lower(line), "[0-9 ]+$", ""), F.lower(title)
        hit = hit | F.when((F.coalesce(title, F.lit("")) != "") & (T.similarity_bound(x, y) >= 0.7), T.similarity(x, y) >= 0.7).otherwise(False)
    return (line != "") & ~line.startswith("#") & hit


@CATALOG.add("p05_title")
def running_titles(spark, sf_dir):
    """P05, title branch: the title of a conversation is its first turn's first four words."""
    c = table(spark, sf_dir, "conversations")
    title = F.array_join(F.slice(F.split(F.first("text").over(W.partitionBy("conv_id").orderBy("turn")), " "), 1, 4), " ")
    c = c.select("conv_id", "turn", "text", title.alias("title")).withColumn("line", F.when(F.col("turn") % 2 == 0, F.concat("title", F.lit(" "), F.col("turn").cast("string"))).otherwise(F.get(F.split("text", "\n"), F.lit(0))))
    return c.select("conv_id", "turn", running_header(F.col("line"), F.col("turn") + 1, F.col("title")).alias("header"))


def running_footer(line: Column, page: Column) -> Column:
    """A number within one of the page's, `Page n`, or `n of m`."""
    x = T.strip(line)
    number = F.abs(F.when(x.rlike(r"^\d+$"), x).try_cast("int") - page) <= 1
    return F.coalesce(number, F.lit(False)) | x.rlike(r"^[Pp]age\s+\d+") | x.rlike(r"^\d+\s+of\s+\d+$")


@CATALOG.add("p06", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS footer FROM conversations")
def running_footers(spark, sf_dir):
    p = F.col("turn") + 1
    line = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("  "), (p - 1).cast("string"))).when(F.col("turn") % 4 == 1, F.concat(F.lit("Page "), p.cast("string"))).when(F.col("turn") % 4 == 2, F.concat(p.cast("string"), F.lit(" of 9"))).otherwise(F.concat((p + 2).cast("string")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", running_footer(line, p).alias("footer"))


def findings(pdf: DataFrame, max_pages: int = 500) -> DataFrame:
    """Pdf with `findings`, an array of (code, severity, detail) in the order of the checks.

    pdf: form_field_count, form_type, page_count, producer, creator, page_dimensions array<struct<w, h>>.
    """
    both = F.lower(F.concat_ws(" ", F.coalesce("producer", F.lit("")), F.coalesce("creator", F.lit(""))))
    has = lambda names: F.exists(F.array(*[F.lit(w) for w in names]), lambda w: F.contains(both, w))
    dims = F.coalesce("page_dimensions", F.array().cast("array<struct<w:double,h:double>>"))
    large = F.filter(F.transform(dims, lambda d, i: F.when(d["w"] * d["h"] > A0 * OVER, i + 1)), lambda i: i.isNotNull())
    ways = F.transform(F.filter(dims, lambda d: (d["w"] > 0) & (d["h"] > 0)), lambda d: F.when(d["w"] > d["h"] * SQUARE, "landscape").when(d["h"] > d["w"] * SQUARE, "portrait").otherwise("square"))
    ways = F.array_sort(F.array_distinct(ways))
    makers = F.concat_ws("|", "producer", "creator")
    one = lambda code, severity, detail: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))
    n = F.col("form_field_count")
    every = [
        F.when((n > 0) & F.col("form_type").isin(2, 3), one("form_xfa", "error", n)).when(n > 0, one("form_acroform", "error", n)),
        F.when(F.col("page_count") == 0, one("empty_document", "error", F.col("page_count"))),
        F.when(F.col("page_count") > max_pages, one("too_many_pages", "error", F.col("page_count"))),
        F.when(has(SCANNERS), one("scan_producer", "warning", makers)),
        F.when(F.size(large) > 0, one("oversized_pages", "warning", F.array_join(F.transform(large, lambda i: i.cast("string")), ","))),
        F.when((F.size(dims) >= 2) & (F.size(ways) > 1), one("mixed_orientation", "warning", F.array_join(ways, ","))),
        F.when(has(PRESENTERS), one("presentation_document", "warning", makers)),
        F.when(has(SPREADSHEETS), one("spreadsheet_document", "warning", makers)),
    ]
    return pdf.withColumn("findings", F.array_compact(F.array(*every)))


def document_type(found: Column) -> Column:
    """Form, scanned, presentation, spreadsheet by the first that applies; standard without errors, else unknown."""
    codes = F.transform(found, lambda f: f["code"])
    has = lambda *names: F.arrays_overlap(codes, F.array(*[F.lit(x) for x in names]))
    kind = F.when(has("form_acroform", "form_xfa"), "form").when(has("scanned_document", "scan_producer"), "scanned").when(has("presentation_document"), "presentation").when(has("spreadsheet_document"), "spreadsheet")
    return kind.when(~F.exists(found, lambda f: f["severity"] == "error"), "standard").otherwise("unknown")


def classify(pdf: DataFrame, max_pages: int = 500) -> DataFrame:
    """Unreadable files (error is not null) are told apart by their error's text, though both carry the same code; of the others P07 to P09."""
    x = findings(pdf, max_pages)
    detail = F.when(F.contains(F.lower("error"), F.lit("password")), "password").otherwise("corrupt")
    bad = F.array(F.struct(F.lit("encrypted").alias("code"), F.lit("error").alias("severity"), detail.alias("detail")))
    x = x.withColumn("findings", F.when(F.col("error").isNotNull(), bad).otherwise(F.col("findings")))
    return x.withColumn("kind", F.when(F.col("error").isNotNull(), "unknown").otherwise(document_type(F.col("findings"))))


#: Makers that orders stand for, by key: of every kind, in both columns, and names that only look like one.
MAKERS = ["Adobe Scan 2.1", "Scandinavian Writer", "Microsoft PowerPoint", "LibreOffice Calc", "ABBYY FineReader 15", "Keynote", "Google Sheets", "pdfTeX", None, "OCRmyPDF 14"]
MAKERS_SQL = "[" + ", ".join("NULL" if m is None else f"'{m}'" for m in MAKERS) + "]"


def pdf_metadata_of_orders(spark, sf_dir) -> DataFrame:
    """Orders as PDF metadata: columns of a file derived from the key, quantity and priority of an order and its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").alias("q"), F.col("l_tax").alias("t")))).alias("l"))
    o = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    k, maker = F.col("o_orderkey"), F.array(*[F.lit(m) for m in MAKERS])
    dims = F.transform(F.coalesce("l", F.array().cast(lines.schema["l"].dataType)), lambda x: F.struct((x["q"] * F.when(x["t"] > 0.06, 100.0).otherwise(24.0)).alias("w"), (F.lit(600.0) * F.when(x["t"] > 0.06, 4.0).otherwise(1.0)).alias("h")))
    return o.select(
        "o_orderkey", (k % 4).alias("form_type"), F.when(F.col("o_orderstatus") == "P", k % 3).otherwise(0).alias("form_field_count"), F.when(k % 11 == 0, 0).when(k % 13 == 0, 501).otherwise(F.size(dims)).alias("page_count"),
        F.get(maker, (k % 10).cast("int")).alias("producer"), F.get(maker, ((k / 10).cast("long") % 10).cast("int")).alias("creator"), dims.alias("page_dimensions"), F.when(k % 17 == 0, "Incorrect PASSWORD error").when(k % 19 == 0, "Data format error").alias("error"),
    )


_HAS_SQL = "len(list_filter([{names}], lambda w: contains(lower(coalesce(producer, '') || ' ' || coalesce(creator, '')), w))) > 0"
_NAMED = {k: _HAS_SQL.format(names=", ".join(f"'{x}'" for x in v)) for k, v in (("scan", SCANNERS), ("show", PRESENTERS), ("sheet", SPREADSHEETS))}
PDF_SQL = f"""SELECT o_orderkey, o_orderkey % 4 AS form_type, CASE WHEN o_orderstatus = 'P' THEN o_orderkey % 3 ELSE 0 END AS fields, CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN 501 ELSE coalesce(len(ws), 0) END AS pages,
    {MAKERS_SQL}[o_orderkey % 10 + 1] AS producer, {MAKERS_SQL}[(o_orderkey // 10) % 10 + 1] AS creator, ws, hs, CASE WHEN o_orderkey % 17 = 0 THEN 'password' WHEN o_orderkey % 19 = 0 THEN 'corrupt' END AS err
    FROM orders LEFT JOIN (SELECT l_orderkey, list(l_quantity * CASE WHEN l_tax > 0.06 THEN 100.0 ELSE 24.0 END ORDER BY l_linenumber, l_quantity, l_tax) AS ws, list(600.0 * CASE WHEN l_tax > 0.06 THEN 4.0 ELSE 1.0 END ORDER BY l_linenumber, l_quantity, l_tax) AS hs FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
CODES_SQL = f"""SELECT *, CASE WHEN fields > 0 THEN CASE WHEN form_type IN (2, 3) THEN 'form_xfa,' ELSE 'form_acroform,' END ELSE '' END || CASE WHEN pages = 0 THEN 'empty_document,' ELSE '' END || CASE WHEN pages > 500 THEN 'too_many_pages,' ELSE '' END AS blockers,
    CASE WHEN {_NAMED['scan']} THEN 'scan_producer,' ELSE '' END || CASE WHEN len(list_filter(range(1, coalesce(len(ws), 0) + 1), lambda i: ws[i] * hs[i] > 2384 * 3370 * 1.1)) > 0 THEN 'oversized_pages,' ELSE '' END
    || CASE WHEN len(ws) >= 2 AND len(list_distinct(list_transform(list_filter(range(1, len(ws) + 1), lambda i: ws[i] > 0), lambda i: CASE WHEN ws[i] > hs[i] * 1.05 THEN 'l' WHEN hs[i] > ws[i] * 1.05 THEN 'p' ELSE 's' END))) > 1 THEN 'mixed_orientation,' ELSE '' END
    || CASE WHEN {_NAMED['show']} THEN 'presentation_document,' ELSE '' END || CASE WHEN {_NAMED['sheet']} THEN 'spreadsheet_document,' ELSE '' END AS warnings FROM ({PDF_SQL})"""
KIND_SQL = "CASE WHEN contains(blockers, 'form_') THEN 'form' WHEN contains(warnings, 'scan_') THEN 'scanned' WHEN contains(warnings, 'presentation') THEN 'presentation' WHEN contains(warnings, 'spreadsheet') THEN 'spreadsheet' WHEN blockers = '' THEN 'standard' ELSE 'unknown' END"


def _codes(severity: str | None = None) -> Column:
    kept = F.filter("findings", lambda f: f["severity"] == severity) if severity else F.col("findings")
    return F.concat_ws("", F.transform(kept, lambda f: F.concat(f["code"], F.lit(","))))


@CATALOG.add("p07", f"SELECT o_orderkey, blockers FROM ({CODES_SQL})")
def hard_blockers(spark, sf_dir):
    return findings(pdf_metadata_of_orders(spark, sf_dir)).select("o_orderkey", _codes("error").alias("blockers"))


@CATALOG.add("p08", f"SELECT o_orderkey, warnings FROM ({CODES_SQL})")
def soft_warnings(spark, sf_dir):
    return findings(pdf_metadata_of_orders(spark, sf_dir)).select("o_orderkey", _codes("warning").alias("warnings"))


@CATALOG.add("p09", f"SELECT o_orderkey, {KIND_SQL} AS kind FROM ({CODES_SQL})")
def document_types(spark, sf_dir):
    return findings(pdf_metadata_of_orders(spark, sf_dir)).select("o_orderkey", document_type(F.col("findings")).alias("kind"))


@CATALOG.add("p39", f"SELECT o_orderkey, CASE WHEN err IS NOT NULL THEN 'encrypted,' ELSE blockers || warnings END AS codes, CASE WHEN err IS NOT NULL THEN 'unknown' ELSE {KIND_SQL} END AS kind, err AS reason FROM ({CODES_SQL})")
def classified(spark, sf_dir):
    reason = F.when(F.col("error").isNotNull(), F.get("findings", F.lit(0))["detail"])
    return classify(pdf_metadata_of_orders(spark, sf_dir)).select("o_orderkey", _codes().alias("codes"), "kind", reason.alias("reason"))


@CATALOG.add("p10", f"SELECT doc_id, CASE WHEN n_chars * 1.0 / p < 50 THEN 'scanned' WHEN n_chars * 1.0 / p < 200 THEN 'sparse' ELSE 'text' END AS content FROM (SELECT doc_id, n_chars, {PAGE} AS p FROM documents)")
def enriched(spark, sf_dir):
    """P10: content class by characters per page."""
    per = F.col("n_chars") * 1.0 / _pages()
    return table(spark, sf_dir, "documents").select("doc_id", F.when(per < SCANNED_PER_PAGE, "scanned").when(per < SPARSE_PER_PAGE, "sparse").otherwise("text").alias("content"))


@CATALOG.add("p11", "SELECT user_id, bool_or(event_type = 'error') AS has_errors, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS n_warnings FROM events GROUP BY user_id")
def severities(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("has_errors"), F.sum((F.col("event_type") == "view").cast("long")).alias("n_warnings"))


@CATALOG.add("p12", f"SELECT doc_id, {PAGE} > 0 AND n_chars / {PAGE} < 50 AS likely_scanned FROM documents")
def likely_scanned(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ((_pages() > 0) & (F.col("n_chars") / _pages() < SCANNED_PER_PAGE)).alias("likely_scanned"))


def is_real(kind: str, text: Column) -> Column:
    """Whether a match of a pattern passes the checks of its kind: areas and groups of SSNs, Luhn's digit of cards, the 97 rule of IBANs."""
    if kind == "US_SSN":
        return ~text.rlike(r"^(000|666|9)|-00-|-0000$")
    if kind == "CREDIT_CARD":
        return F.call_function("luhn_check", F.regexp_replace(text, "[^0-9]", ""))
    if kind == "IBAN_CODE":
        turned = F.split(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)), "")
        value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).when(c != "", F.ascii(c) - 55)
        step = lambda acc, c: F.when(value(c).isNull(), acc).when(value(c) < 10, (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97)
        return F.aggregate(turned, F.lit(0), step) == 1
    return F.lit(True)


def lifted(score: float) -> float:
    return min(1.0, max(score + LIFT, LIFT_LEAST))


def personal_data(docs: DataFrame, key: str = "doc_id", column: str = "text", least: float = 0.85, only: list[str] | None = None) -> DataFrame:
    """(key, entity_type, start, end, score, text) of every match at or over the score, in code points; of all kinds, or `only` some.

    Matches and the words of their context are found by one pattern each, with their offsets and how many blanks are before them; both
    meet in one order by offset within a document, and a match less than six blanks after a word of its context is worth more.
    """

    kinds = [e for e in ENTITIES if lifted(e[2]) >= least and (only is None or e[0] in only)]
    context = {k: r"(?i)\b(?:" + "|".join(CONTEXT[k]) + r")\b" for k, _, _ in kinds}
    listed = lambda pattern: F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))
    blanks = lambda x: F.regexp_count(x, F.lit(r"\s+"))

    def spans(name: str, kind: str, found: str, gaps: str, score: float) -> Column:
        pieces = F.transform(F.arrays_zip(F.col(found).alias("t"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap")), lambda z, i: F.struct(F.lit(name).alias("pattern"), F.lit(kind).alias("entity_type"), F.length(z["gap"]).alias("gap"), blanks(z["gap"]).alias("blanks"), blanks(z["t"]).alias("within"), z["t"].alias("text"), F.lit(score).alias("score"), i.alias("i")))
        return F.coalesce(pieces, F.array().cast("array<struct<pattern:string,entity_type:string,gap:int,blanks:int,within:int,text:string,score:double,i:int>>"))

    # A text is searched once for each pattern, and cut, or searched for words of a context, only where the pattern's kind was found.  The
    # pattern that begins anew at every letter of a word is tried only where its sign is.  Row numbers keep Spark from filtering before them,
    # which would search again.
    some = lambda name: F.size(name) > 0
    x = docs.select(F.col(key).alias("__key"), F.col(column).alias("__t"))
    x = x.select("*", *[(F.when(F.contains("__t", F.lit(SIGNS[k])), listed(p)) if k in SIGNS else listed(p)).alias(f"__{k}") for k, p, _ in kinds])
    x = x.select("*", *[F.when(some(f"__{k}"), F.split("__t", p, -1)).alias(f"__{k} gaps") for k, p, _ in kinds], *[F.when(some(f"__{k}"), listed(context[k])).alias(f"__{k} words") for k, _, _ in kinds])
    x = x.select("*", *[F.when(some(f"__{k} words"), F.split("__t", context[k], -1)).alias(f"__{k} rest") for k, _, _ in kinds])
    every = F.concat(*[spans(k, k, f"__{k}", f"__{k} gaps", s) for k, _, s in kinds], *[spans(f"{k} context", k, f"__{k} words", f"__{k} rest", -1.0) for k, _, _ in kinds])
    x = x.select("__key", every.alias("__every"), F.monotonically_increasing_id().alias("__row")).select("__key", "__row", F.explode("__every").alias("f")).select("__key", "__row", "f.*")
    w = W.partitionBy("__row", "pattern").orderBy("i")
    x = x.withColumn("end", F.sum(F.col("gap") + F.length("text")).over(w).cast("int")).withColumn("at", F.sum(F.col("blanks") + F.col("within")).over(w) - F.col("within"))
    x = x.withColumn("start", F.col("end") - F.length("text"))
    word = F.last(F.when(F.col("score") < 0, F.col("at")), ignorenulls=True).over(W.partitionBy("__row", "entity_type").orderBy("start", "score").rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("word", word).where("score >= 0")
    real, more = F.lit(True), F.col("score")
    for kind, _, score in kinds:
        real = F.when(F.col("entity_type") == kind, is_real(kind, F.col("text"))).otherwise(real)
        more = F.when(F.col("entity_type") == kind, F.lit(lifted(score))).otherwise(more)
    x = x.where(real).withColumn("score", F.when(F.col("at") - F.col("word") <= WORDS_BEFORE, more).otherwise(F.col("score")))
    return x.where(F.col("score") >= least).select(F.col("__key").alias(key), "entity_type", "start", "end", "score", "text")


def with_findings(docs: DataFrame, key: str = "doc_id", column: str = "text", least: float = 0.85) -> DataFrame:
    """Docs with `found`: whether any entity at or over the score is in their text, or for what only its context can lift, in a text of
    their key.  Only texts that have nothing certain, but a match and a word of its context, are searched for those."""

    def real(kind: str, pattern: str) -> Column:
        return F.exists(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)), lambda t: is_real(kind, t))

    certain, possible = F.lit(False), F.lit(False)
    text, some = F.col(column), []
    for kind, pattern, score in ENTITIES:
        if score >= least:
            certain = certain | F.coalesce(real(kind, pattern), F.lit(False))
        elif lifted(score) >= least:
            some.append(kind)
            possible = possible | (text.rlike(r"(?i)\b(?:" + "|".join(CONTEXT[kind]) + r")\b") & text.rlike(pattern))
    x = docs.withColumn("__certain", certain)
    hits = personal_data(docs.where(possible & ~certain).select(key, column), key, column, least, some).select(F.col(key).alias("__hit")).distinct()
    x = x.join(hits, F.col(key).eqNullSafe(F.col("__hit")) & F.col("__hit").isNotNull(), "left")
    return x.withColumn("found", F.col("__certain") | F.col("__hit").isNotNull()).drop("__hit", "__certain")


_LUHN_SQL = "list_sum(list_transform(range(1, len({d}) + 1), lambda i: CASE WHEN (len({d}) - i) % 2 = 0 THEN CAST({d}[i] AS INTEGER) ELSE (CAST({d}[i] AS INTEGER) * 2) % 10 + (CAST({d}[i] AS INTEGER) * 2) // 10 END)) % 10 = 0".format(d="regexp_replace(t, '[^0-9]', '', 'g')")
_IBAN_SQL = "list_reduce(list_prepend(0, list_transform(string_split(substr(t, 5) || substr(t, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ascii(c) - 55 END)), lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
REAL_SQL = {"US_SSN": "NOT regexp_matches(t, '^(000|666|9)|-00-|-0000$')", "CREDIT_CARD": _LUHN_SQL, "IBAN_CODE": _IBAN_SQL}
PERSONAL_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS entity_type, CASE WHEN near THEN {lifted(score)}::DOUBLE ELSE {score}::DOUBLE END AS score, t AS text FROM (SELECT doc_id, ms[i] AS t, regexp_matches(array_to_string(list_transform(range(1, i + 1), lambda j: gs[j] || CASE WHEN j < i THEN ms[j] ELSE '' END), ''), '(?i)\\b({'|'.join(CONTEXT[k])})\\b\\S*(\\s+\\S+){{0,{WORDS_BEFORE - 1}}}(\\s+\\S*)?$') AS near FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS gs FROM found_in), unnest(range(1, len(ms) + 1)) AS u(i)) WHERE {REAL_SQL.get(k, 'true')}"
    for k, p, score in ENTITIES
)
_PLANTED = ["write 078-05-1120 or 000-12-3456 now", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "pay GB82WEST12345698765432 not GB83WEST12345698765432", "call +1 555-123-4567", "mail a.b@c.org", "licence D1234567"]
FOUND_IN_SQL = "WITH found_in AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') || ' ' || [" + ", ".join(f"'{x}'" for x in _PLANTED) + "][doc_id % 7 + 1] AS text FROM documents) "


def _personal(spark, sf_dir) -> DataFrame:
    """Documents in ASCII (word boundaries differ between the engines otherwise), six of seven with look-alikes and real entities of one kind."""
    planted = F.coalesce(F.get(F.array(*[F.lit(x) for x in _PLANTED]), (F.col("doc_id") % 7).cast("int")), F.lit(None))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.regexp_replace("text", r"[^\x00-\x7F]", " "), F.lit(" "), planted).alias("text"))


@CATALOG.add("d01", FOUND_IN_SQL + f"SELECT doc_id, entity_type, score, text FROM ({PERSONAL_SQL})")
def entities(spark, sf_dir):
    return personal_data(_personal(spark, sf_dir), least=0.0).select("doc_id", "entity_type", "score", "text")


@CATALOG.add("d01_spans")
def all_personal_data(spark, sf_dir):
    return personal_data(table(spark, sf_dir, "documents"), least=0.0)


@CATALOG.add("p15", FOUND_IN_SQL + f"SELECT entity_type, score >= 0.85 AS certain, count(*) AS n FROM ({PERSONAL_SQL}) WHERE score >= 0.75 GROUP BY ALL")
def certain_personal_data(spark, sf_dir):
    """What the score threshold lets pass."""
    return personal_data(_personal(spark, sf_dir), least=0.75).groupBy("entity_type", (F.col("score") >= 0.85).alias("certain")).agg(F.count("*").alias("n"))


@CATALOG.add("d02", FOUND_IN_SQL + f"SELECT f.doc_id, CASE WHEN f.doc_id IN (SELECT doc_id FROM ({PERSONAL_SQL}) WHERE score >= 0.85) THEN 'awaiting_approval' ELSE 'processing' END AS route FROM found_in f")
def routes(spark, sf_dir):
    """Documents with any finding need approval; the others go on."""
    return with_findings(_personal(spark, sf_dir)).select("doc_id", F.when(F.col("found"), "awaiting_approval").otherwise("processing").alias("route"))


@CATALOG.add("d03", "SELECT o_orderkey, md5('t' || o_orderkey) AS token, o_orderdate + INTERVAL 4 HOUR AS expires_at FROM orders WHERE o_orderstatus = 'P'")
def approvals(spark, sf_dir):
    """Approval requests with a token and an expiry."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", F.md5(F.concat(F.lit("t"), F.col("o_orderkey").cast("string"))).alias("token"), (F.col("o_orderdate") + F.expr("INTERVAL 4 HOURS")).alias("expires_at"))


@CATALOG.add("p25", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(m, 1, 1) || '***@' || 'x.org' ELSE substr(c_name, 1, 2) || repeat('*', CAST(length(c_name) - 4 AS INTEGER)) || substr(c_name, length(c_name) - 1, 2) END AS masked FROM (SELECT *, lower(c_name) || '@x.org' AS m FROM customer)")
def masked(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    return c.select("c_custkey", T.mask_snippet(F.when(even, F.concat(F.lower("c_name"), F.lit("@x.org"))).otherwise(F.col("c_name")), F.when(even, "EMAIL_ADDRESS").otherwise("PERSON")).alias("masked"))


@CATALOG.add("p20", "SELECT conv_id, turn, conv_id % 2 = 0 AS valid FROM conversations")
def temp_keys(spark, sf_dir):
    key = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("temp/"), F.col("conv_id").cast("string"))).otherwise("results/x")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", key.startswith("temp/").alias("valid"))


def consistent(pages: DataFrame) -> DataFrame:
    """A set flag needs a count of one at least, a cleared one has none (images, tables); simple pages (score 0.3 at most) have no factors."""
    fix = lambda has, n: F.when(F.col(has) & (F.col(n) == 0), 1).when(~F.col(has) & (F.col(n) > 0), 0).otherwise(F.col(n))
    return pages.withColumns({"image_count": fix("has_images", "image_count"), "table_count": fix("has_tables", "table_count"), "factors": F.when(F.col("score") <= 0.3, F.array().cast("array<string>")).otherwise(F.col("factors"))})


@CATALOG.add("p21", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN greatest(p_size % 5, 1) ELSE 0 END AS image_count, CASE WHEN p_size > 25 THEN greatest(p_size % 4, 1) ELSE 0 END AS table_count, CASE WHEN p_retailprice / 2000 <= 0.3 THEN '' ELSE p_brand || ',' || p_type END AS factors FROM part")
def consistent_flags(spark, sf_dir):
    s = F.col("p_size")
    p = table(spark, sf_dir, "part").select("p_partkey", (s % 3 == 0).alias("has_images"), (s % 5).alias("image_count"), (s > 25).alias("has_tables"), (s % 4).alias("table_count"), (F.col("p_retailprice") / 2000).alias("score"), F.array("p_brand", "p_type").alias("factors"))
    return consistent(p).select("p_partkey", "image_count", "table_count", F.array_join("factors", ",").alias("factors"))


@CATALOG.add("p22", "SELECT doc_id, quality, toxic FROM labels WHERE toxic = 1 OR quality = 0")
def hint_filter(spark, sf_dir):
    return table(spark, sf_dir, "labels").where((F.col("toxic") == 1) | (F.col("quality") == 0))


@CATALOG.add("p23", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS hints FROM conversations GROUP BY conv_id")
def hints_in_page_order(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("h"))
    return c.select("conv_id", F.array_join(F.transform("h", lambda x: x["role"]), ",").alias("hints"))


def search_changes(changes: DataFrame, page: int, term: str) -> DataFrame:
    """Changes of a page whose old text, new text or reasoning holds the term, whatever its case."""
    hit = F.lit(False)
    for c in ("old_text", "new_text", "reasoning"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(term.lower()))
    return changes.where((F.col("page") == page) & hit)


@CATALOG.add("p24", "SELECT conv_id, turn FROM conversations WHERE turn + 1 = 2 AND (contains(lower(text), 'tion') OR contains(lower(replace(text, 'e', 'TI')), 'tion') OR contains(lower(role), 'tion'))")
def change_search(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") + 1).alias("page"), F.col("text").alias("old_text"), F.replace("text", F.lit("e"), F.lit("TI")).alias("new_text"), F.col("role").alias("reasoning"))
    return search_changes(c, 2, "TION").select("conv_id", "turn")


@CATALOG.add("p27", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'completed:' || CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) WHEN 'O' THEN 'processing' ELSE 'awaiting_approval:' || o_orderpriority END AS view FROM orders")
def job_views(spark, sf_dir):
    """What a job shows depends on its status."""
    view = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("completed:"), F.bround(F.col("o_totalprice"), 0).cast("long").cast("string"))).when(F.col("o_orderstatus") == "O", "processing").otherwise(F.concat(F.lit("awaiting_approval:"), F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", view.alias("view"))


@CATALOG.add("p28", "SELECT event_id, TRY_CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS INTEGER) AS k, coalesce(TRY_CAST(value AS DOUBLE), 0.0) AS cost FROM events")
def safe_casts(spark, sf_dir):
    k = F.from_json("props", "k int")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(F.col("value").cast("string").try_cast("double"), F.lit(0.0)).alias("cost"))


@CATALOG.add("p29", "SELECT doc_id, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN 'v1' WHEN 2 THEN 'v2' ELSE 'v3' END) AS latest FROM documents")
def latest_version(spark, sf_dir):
    """The newest version that isn't empty."""
    v = {k: F.when(F.col("doc_id") % 4 >= k, f"v{k}").otherwise(F.lit("")) for k in (1, 2, 3)}
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce(*[F.nullif(v[k], F.lit("")) for k in (3, 2, 1)], F.nullif(F.col("text"), F.lit("")), F.lit(""))).alias("latest"))


@CATALOG.add("p30", "SELECT p_partkey, trim(CASE WHEN p_size % 2 = 0 THEN 'tables' || chr(10) || chr(10) ELSE '' END || CASE WHEN p_size % 3 = 0 THEN 'lists' || chr(10) || chr(10) ELSE '' END || 'base', ' ') AS prompt FROM part")
def prompts(spark, sf_dir):
    """Fragments by page attributes."""
    parts = F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, "tables"), F.when(F.col("p_size") % 3 == 0, "lists"), F.lit("base")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n\n", parts).alias("prompt"))


def asked_languages(x: Column) -> Column:
    """The codes of a comma-separated list, stripped."""
    return F.transform(F.split(x, ",", -1), T.strip)


def invalid_languages(asked: Column) -> Column:
    """The codes that aren't known, in order, as often as they are asked for."""
    return F.filter(asked, lambda c: ~c.isin(*LANGUAGES))


def extractor_languages(asked: Column) -> Column:
    """The extractor's codes; unknown ones pass through."""
    known = F.create_map(*[F.lit(v) for kv in LANGUAGES.items() for v in kv])
    return F.transform(asked, lambda c: F.coalesce(F.try_element_at(known, c), c))


def _asked(spark, sf_dir) -> DataFrame:
    """Documents that ask for one of all known languages, their own language's short code, and an unknown one twice."""
    some = F.get(F.array(*[F.lit(k) for k in LANGUAGES]), (F.col("doc_id") % len(LANGUAGES)).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", asked_languages(F.concat(some, F.lit(", "), "lang", F.when(F.col("doc_id") % 3 == 0, ",xx, xx ").otherwise(""))).alias("asked"))


_ASKED_SQL = f"SELECT doc_id, list_transform(string_split([{', '.join(repr(k) for k in LANGUAGES)}][CAST(doc_id % {len(LANGUAGES)} AS INTEGER) + 1] || ', ' || lang || CASE WHEN doc_id % 3 = 0 THEN ',xx, xx ' ELSE '' END, ','), lambda x: trim(x)) AS asked FROM documents"


@CATALOG.add("p31", f"SELECT doc_id, array_to_string(list_filter(asked, lambda x: NOT list_contains([{', '.join(repr(k) for k in LANGUAGES)}], x)), ',') AS invalid FROM ({_ASKED_SQL})")
def refused_languages(spark, sf_dir):
    return _asked(spark, sf_dir).select("doc_id", F.array_join(invalid_languages(F.col("asked")), ",").alias("invalid"))


@CATALOG.add("p32", f"SELECT doc_id, array_to_string(list_transform(asked, lambda x: coalesce(list_extract([{', '.join(repr(v) for v in LANGUAGES.values())}], list_position([{', '.join(repr(k) for k in LANGUAGES)}], x)), x)), ',') AS codes FROM ({_ASKED_SQL})")
def language_codes(spark, sf_dir):
    return _asked(spark, sf_dir).select("doc_id", F.array_join(extractor_languages(F.col("asked")), ",").alias("codes"))


@CATALOG.add("p33", "SELECT user_id, CASE WHEN bool_and(ok) THEN 'healthy' WHEN bool_or(ok) THEN 'degraded' ELSE 'unhealthy' END AS health FROM (SELECT user_id, event_type <> 'error' AS ok FROM events) GROUP BY user_id")
def health(spark, sf_dir):
    ok = F.col("event_type") != "error"
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.bool_and(ok), "healthy").when(F.bool_or(ok), "degraded").otherwise("unhealthy").alias("health"))


@CATALOG.add("p34", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || (event_id % 7) WHEN 1 THEN '10.1.0.1' ELSE 'peer' END AS ip FROM events")
def client_addresses(spark, sf_dir):
    """The first forwarded address, else the real one, else the peer."""
    i = F.col("event_id")
    xff = F.when(i % 3 == 0, F.concat(F.lit(" 10.0.0."), (i % 7).cast("string"), F.lit(", 10.9.9.9")))
    real = F.when(i % 3 == 1, "10.1.0.1")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.btrim(F.get(F.split(xff, ","), F.lit(0))), real, F.lit("peer")).alias("ip"))


def worth_retrying(kind: Column, code: Column, status: Column) -> Column:
    """Whether a failure is worth another try, by its kind: an error of the store (client) by its code, then its status, an answer (http)
    by its status, network, timeout, connection and queue failures always, anything else never."""
    by_status = F.coalesce(status.isin(*AGAIN_STATUS), F.lit(False))
    by_code = F.when(code.isin(*NEVER_CODES), False).when(code.isin(*AGAIN_CODES), True).otherwise(by_status)
    return F.when(kind == "client", by_code).when(kind == "http", by_status).otherwise(F.coalesce(kind.isin("network", "timeout", "connection", "queue"), F.lit(False)))


_KINDS, _CODES, _STATUS = ["client", "http", "network", "timeout", "connection", "queue", "other"], ["NoSuchKey", "SlowDown", "Other", "RequestTimeout", "AccessDenied", "InternalError", "ThrottlingException", "InvalidRequest"], [500, 503, 429, 400, 404, 504, 408, 502, 200]


@CATALOG.add("p35", f"""SELECT event_id, CASE kind WHEN 'client' THEN CASE WHEN code IN ('NoSuchKey', 'AccessDenied', 'InvalidRequest') THEN false WHEN code <> 'Other' THEN true ELSE status IN (408, 429, 500, 502, 503, 504) END WHEN 'http' THEN status IN (408, 429, 500, 502, 503, 504) WHEN 'other' THEN false ELSE true END AS retryable
    FROM (SELECT event_id, {_KINDS}[CAST(event_id % 7 AS INTEGER) + 1] AS kind, {_CODES}[CAST(event_id % 8 AS INTEGER) + 1] AS code, {_STATUS}[CAST(event_id % 9 AS INTEGER) + 1] AS status FROM events)""")
def retryable(spark, sf_dir):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values)).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", worth_retrying(pick(_KINDS), pick(_CODES), pick(_STATUS)).alias("retryable"))


@CATALOG.add("p36", "SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS width, (l_quantity / 2.0) / 50.0 AS centre FROM lineitem WHERE l_quantity / 50.0 >= 0.1")
def wide_items(spark, sf_dir):
    """Items of at least a tenth of the page's width, with relative width and centre."""
    w = F.col("l_quantity") / 50.0
    return table(spark, sf_dir, "lineitem").where(w >= 0.1).select("l_orderkey", "l_linenumber", w.alias("width"), ((F.col("l_quantity") / 2.0) / 50.0).alias("centre"))


@CATALOG.add("p37", "WITH RECURSIVE t(n_nationkey, depth) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM nation n JOIN t ON (n.n_nationkey - 1) // 2 = t.n_nationkey AND n.n_nationkey > 0) SELECT n_nationkey, depth FROM t")
def tree_walk(spark, sf_dir):
    """Depth of every node of a tree given by (node, parent)."""
    nodes = table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") > 0, F.expr("(n_nationkey - 1) DIV 2")).alias("parent"))
    return spark.sql("WITH RECURSIVE t(n_nationkey, depth) AS (SELECT n_nationkey, 0 FROM {nodes} WHERE parent IS NULL UNION ALL SELECT n.n_nationkey, t.depth + 1 FROM {nodes} n JOIN t ON n.parent = t.n_nationkey) SELECT n_nationkey, depth FROM t", nodes=nodes)


@CATALOG.add("p38", "SELECT event_id FROM events WHERE event_type <> 'error'")
def honeypot(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type <> 'error'").select("event_id")


@CATALOG.add("p41", "SELECT o_orderkey, 'job:' || o_orderkey AS job_key, 'queue:' || lower(o_orderstatus) AS queue, 'metrics:' || strftime(o_orderdate, '%Y%m%d') AS metrics_key FROM orders")
def keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("job:"), F.col("o_orderkey").cast("string")).alias("job_key"), F.concat(F.lit("queue:"), F.lower("o_orderstatus")).alias("queue"), F.concat(F.lit("metrics:"), F.date_format("o_orderdate", "yyyyMMdd")).alias("metrics_key"))


@CATALOG.add("p42", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[0-9]+', '{id}', 'g') AS route FROM pages")
def route_templates(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://[^/]+", ""), "[0-9]+", "{id}").alias("route"))


@CATALOG.add("p43", "SELECT item_id, length(text) BETWEEN 10 AND 500 AS valid, len(regexp_extract_all(text, '[.!?] ')) + 1 AS sentences FROM benchmark")
def reasoning_quality(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.length("text").between(10, 500).alias("valid"), (F.regexp_count("text", F.lit("[.!?] ")) + 1).cast("long").alias("sentences"))
