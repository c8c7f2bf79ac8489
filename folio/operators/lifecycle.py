"""Roll-ups, limits, gates, workers and one-shot transitions over logs of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.operators.classify import FOUND_IN_SQL, PERSONAL_SQL, _personal, personal_data, with_findings
from folio.operators.jobs import STATUS_SQL, jobs
from folio.operators.telemetry import EVENTS_SQL, events, log_sql
from folio.plans.catalog import Catalog
from folio.sources.tables import stored, table
from folio.streaming.limits import sliding_log

CATALOG = Catalog()

# Days that a job is kept by its status, and of all others; substatuses by status; limits of requests and their windows.
KEEP_DAYS, KEEP_OTHERS = {"completed": 30, "failed": 30, "denied": 7}, 7
SUBSTATUSES = {"processing": ["analyzing", "extracting", "specializing", "consolidating", "awaiting_review", "applying"]}
HOUR, DAY = 3_600_000_000, 86_400_000_000


# --- records of an extractor -------------------------------------------------------------------------------------------------


def resolve(record: Column, ref: Column) -> Column:
    """The text of what a pointer such as #/texts/42 refers to in a variant: its text, else its orig, else itself if it is a string; '' if nothing is there."""
    path = F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(F.substring(ref, F.lit(2), F.length(ref)), r"/([0-9]+)(?=/|$)", "[$1]"), r"/([^/\[]+)", ".$1"))
    one = lambda tail: F.nullif(F.try_variant_get(record, F.concat(path, F.lit(tail)), "string"), F.lit(""))
    found = F.try_variant_get(record, path, "string")
    return F.when(ref.startswith("#/"), F.coalesce(one(".text"), one(".orig"), F.when(~found.startswith("{") & ~found.startswith("["), found), F.lit(""))).otherwise("")


PICTURE = "struct<text:string,captions:array<variant>>"


def caption(picture: Column, record: Column) -> Column:
    """A picture's own text, else its captions joined by blanks; each is a string, or has a text or orig, or refers to one."""

    def one(c: Column) -> Column:
        own = F.coalesce(F.nullif(F.try_variant_get(c, "$.text", "string"), F.lit("")), F.nullif(F.try_variant_get(c, "$.orig", "string"), F.lit("")))
        ref = F.get_json_object(F.to_json(c), "$['$ref']")
        plain = F.when(F.schema_of_variant(c) == "STRING", F.variant_get(c, "$", "string"))
        return F.coalesce(plain, own, F.nullif(F.when(ref.isNotNull(), resolve(record, ref)), F.lit("")))

    return F.coalesce(F.nullif(picture["text"], F.lit("")), F.array_join(F.filter(F.transform(picture["captions"], one), lambda t: t.isNotNull()), " "))


def _records(spark, sf_dir) -> DataFrame:
    """A record per page with two texts and three pictures: one with a text, one with captions of all kinds, one with none."""
    json = F.concat(F.lit('{"texts":[{"text":"t0 '), F.col("page_id").cast("string"), F.lit('"},{"orig":"t1"}],"pictures":[{"text":"own","captions":[]},{"text":"","captions":["plain",{"text":"inline"},{"orig":"old"},{"$ref":"#/texts/0"},{"$ref":"#/texts/1"},{"$ref":"#/texts/9"},{"$ref":"x"}]},{"captions":[]}]}'))
    return table(spark, sf_dir, "pages").select("page_id", F.parse_json(json).alias("record"), F.from_json(json, f"pictures array<{PICTURE}>")["pictures"].alias("pictures"))


@CATALOG.add("p03", "SELECT page_id, i AS picture, CASE i WHEN 0 THEN 'own' WHEN 1 THEN 'plain inline old t0 ' || page_id || ' t1' ELSE '' END AS caption FROM pages, (VALUES (0), (1), (2)) AS t(i)")
def captions(spark, sf_dir):
    x = _records(spark, sf_dir).select("page_id", "record", F.posexplode("pictures").alias("picture", "p"))
    return x.select("page_id", "picture", caption(F.col("p"), F.col("record")).alias("caption"))


@CATALOG.add("p04", "SELECT page_id, ref, CASE ref WHEN '#/texts/0' THEN 't0 ' || page_id WHEN '#/texts/1' THEN 't1' WHEN '#/texts/0/text' THEN 't0 ' || page_id ELSE '' END AS text FROM pages, (VALUES ('#/texts/0'), ('#/texts/1'), ('#/texts/9'), ('#/none/0'), ('#/texts/0/text'), ('texts/0')) AS t(ref)")
def pointers(spark, sf_dir):
    refs = F.array(*[F.lit(r) for r in ("#/texts/0", "#/texts/1", "#/texts/9", "#/none/0", "#/texts/0/text", "texts/0")])
    return _records(spark, sf_dir).select("page_id", "record", F.explode(refs).alias("ref")).select("page_id", "ref", resolve(F.col("record"), F.col("ref")).alias("text"))


def load_fragments(asked: DataFrame, fragments: DataFrame) -> DataFrame:
    """The text of each asked fragment (name) from a table of fragments (name, text); '' where it is missing."""
    return asked.join(fragments, "name", "left").withColumn("text", F.coalesce("text", F.lit("")))


@CATALOG.add("p45", "SELECT n_nationkey, coalesce(r_name, '') AS text FROM nation LEFT JOIN region ON 'f' || (n_nationkey % 7) = 'f' || r_regionkey")
def fragments(spark, sf_dir):
    """P45 with regions as fragments f0 to f4, of which nations ask for f0 to f6."""
    known = table(spark, sf_dir, "region").select(F.concat(F.lit("f"), F.col("r_regionkey").cast("string")).alias("name"), F.col("r_name").alias("text"))
    asked = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("f"), (F.col("n_nationkey") % 7).cast("string")).alias("name"))
    return load_fragments(asked, known).select("n_nationkey", "text")


# --- roll-ups --------------------------------------------------------------------------------------------------------------------


@CATALOG.add("a10", "SELECT o, CASE WHEN n < 4 THEN 'unknown' WHEN med < 0.55 AND l >= 2 AND r >= 2 THEN 'double_column' ELSE 'single_column' END AS layout FROM (SELECT l_orderkey AS o, count(*) AS n, list_sort(list(l_quantity / 50.0))[count(*) // 2 + 1] AS med, sum(CASE WHEN l_discount * 10 < 0.45 THEN 1 ELSE 0 END) AS l, sum(CASE WHEN l_discount * 10 > 0.55 THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1)")
def layouts(spark, sf_dir):
    """A10: unknown under four items; two columns if the median item is under 0.55 of the page and both halves have two; else one."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_quantity") / 50.0).alias("width"), (F.col("l_discount") * 10).alias("centre"))
    x = x.groupBy("o").agg(F.sort_array(F.collect_list("width")).alias("w"), F.count_if(F.col("centre") < 0.45).alias("left"), F.count_if(F.col("centre") > 0.55).alias("right"))
    median = F.get("w", F.floor(F.size("w") / 2).cast("int"))
    return x.select("o", F.when(F.size("w") < 4, "unknown").when((median < 0.55) & (F.col("left") >= 2) & (F.col("right") >= 2), "double_column").otherwise("single_column").alias("layout"))


def checklist(items: DataFrame) -> DataFrame:
    """(category, agent, page, n, critical, completed) by category, by agent, by page and in all, from one pass; the other columns are '*' or null.

    items: category, agent, page, confidence, reviewed_at.
    """
    x = items.groupingSets([["category"], ["agent"], ["page"], []], "category", "agent", "page").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") < 0.7).alias("critical"), F.count("reviewed_at").alias("completed"), F.grouping_id().alias("g"))
    return x.select(*[F.coalesce(F.col(c).cast("string"), F.lit("*")).alias(c) for c in ("category", "agent", "page")], "n", "critical", "completed")


@CATALOG.add("a13", "SELECT coalesce(CAST(l_returnflag AS VARCHAR), '*') AS category, coalesce(CAST(l_linestatus AS VARCHAR), '*') AS agent, coalesce(CAST(l_linenumber AS VARCHAR), '*') AS page, count(*) AS n, count(*) FILTER (l_tax * 10 < 0.7) AS critical, count(*) FILTER (l_discount > 0.05) AS completed FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())")
def checklists(spark, sf_dir):
    done = F.when(F.col("l_discount") > 0.05, F.col("l_shipdate"))
    return checklist(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("agent"), F.col("l_linenumber").alias("page"), (F.col("l_tax") * 10).alias("confidence"), done.alias("reviewed_at")))


@CATALOG.add("a17", FOUND_IN_SQL + f"SELECT doc_id, count(*) AS n, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types FROM ({PERSONAL_SQL}) WHERE score >= 0.85 GROUP BY doc_id")
def personal_summary(spark, sf_dir):
    """How many findings and of which types; no text of them."""
    found = personal_data(_personal(spark, sf_dir))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("entity_type")), ",").alias("types"))


@CATALOG.add("a21", "SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS ms, round(sum(l_extendedprice), 2) AS cost, sum(CAST(l_quantity AS BIGINT) * 3 + l_linenumber) AS tokens FROM lineitem GROUP BY 1")
def totals(spark, sf_dir):
    """Time, cost and tokens of a document over its steps."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("ms"), F.round(F.sum("l_extendedprice"), 2).alias("cost"), F.sum(F.col("l_quantity").cast("long") * 3 + F.col("l_linenumber")).alias("tokens"))


@CATALOG.add("a31", "SELECT user_id, count(DISTINCT date_trunc('day', ts)) AS rounds, count(*) FILTER (event_type = 'error') AS issues, count(*) FILTER (event_type = 'error' AND value >= 66) AS critical, count(*) FILTER (event_type = 'error' AND value >= 33 AND value < 66) AS major, count(*) FILTER (event_type = 'error' AND value < 33) AS minor FROM events GROUP BY 1")
def rounds(spark, sf_dir):
    """Rounds (days), and the issues of the critic by severity."""
    bad = F.col("event_type") == "error"
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct(F.date_trunc("day", "ts")).alias("rounds"), F.count_if(bad).alias("issues"), F.count_if(bad & (v >= 66)).alias("critical"), F.count_if(bad & (v >= 33) & (v < 66)).alias("major"), F.count_if(bad & (v < 33)).alias("minor"))


def _level(level: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(scalars, what lies one level deeper) of rows (key, path, v)."""
    level = level.withColumn("kind", F.schema_of_variant("v"))
    nested = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
    leaves = level.where(~nested & (F.col("path") != "") & (F.col("kind") != "VOID")).select(key, "path", F.try_variant_get("v", "$", "string").alias("value"))
    entries = F.try_variant_get("v", "$", "map<string,variant>")
    items = F.map_from_entries(F.transform(F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array().cast("array<variant>")), lambda x, i: F.struct(i.cast("string").alias("key"), x.alias("value"))))
    inner = level.where(nested).select(key, "path", F.explode(F.coalesce(F.when(F.col("kind").startswith("OBJECT"), entries), items)).alias("__name", "__w"))
    return leaves, inner.select(key, F.concat_ws(".", F.nullif("path", F.lit("")), "__name").alias("path"), F.col("__w").alias("v"))


def dotted(rows: DataFrame, key: str, record: str, at_once: int = 4) -> DataFrame:
    """(key, path, value) of every scalar in a variant, with its dotted path (list items by number), at any depth.

    `at_once` levels are unfolded by one plan; what is still nested then is written and goes into the next round, until nothing is left.
    """
    rest = rows.select(key, F.lit("").alias("path"), F.col(record).alias("v")).where(F.col("v").isNotNull())
    out = None
    while True:
        for _ in range(at_once):
            leaves, rest = _level(rest, key)
            out = leaves if out is None else out.unionByName(leaves)
        rest = stored(rest.where("v IS NOT NULL"), "nested")
        if rest.isEmpty():
            return out


@CATALOG.add("a33", "SELECT event_id, path, value FROM (SELECT event_id, 'page.reasoning' AS path, event_type AS value FROM events UNION ALL SELECT event_id, 'items.0.reasoning', 'a' || user_id FROM events UNION ALL SELECT event_id, 'items.1.note.reasoning', 'b' || event_id FROM events) WHERE path LIKE '%reasoning'")
def reasoning_corpus(spark, sf_dir):
    """All reasonings in nested records, by their paths."""
    e = table(spark, sf_dir, "events")
    s = lambda c: F.col(c).cast("string")
    json = F.concat(F.lit('{"page":{"reasoning":"'), "event_type", F.lit('","n":1},"items":[{"reasoning":"a'), s("user_id"), F.lit('"},{"note":{"reasoning":"b'), s("event_id"), F.lit('","x":null}}]}'))
    return dotted(e.select("event_id", F.parse_json(json).alias("r")), "event_id", "r").where(F.col("path").endswith("reasoning"))


@CATALOG.add("a33_deep", f"SELECT n_nationkey, {' || '.join(chr(39) + x + chr(39) for x in ['.'.join(['a', '0'] * 12) + '.reasoning'])} AS path, n_name AS value FROM nation")
def deep_reasonings(spark, sf_dir):
    """What lies 25 levels deep is found as well."""
    json = F.concat(F.lit('{"a":[' * 12 + '{"reasoning":"'), "n_name", F.lit('"}' + "]}" * 12))
    return dotted(table(spark, sf_dir, "nation").select("n_nationkey", F.parse_json(json).alias("r")), "n_nationkey", "r")


@CATALOG.add("a34", "SELECT source, count(*) FILTER (doc_id % 9 <> 4) AS files, coalesce(sum(n_chars) FILTER (doc_id % 9 <> 4), 0) AS bytes, count(*) FILTER (doc_id % 9 = 4) AS errors FROM documents GROUP BY 1")
def cleanup_totals(spark, sf_dir):
    """Deleted files, their bytes, and deletions that failed, by prefix."""
    x = table(spark, sf_dir, "documents").select("source", "n_chars", F.when(F.col("doc_id") % 9 == 4, "access denied").alias("error"))
    ok = F.col("error").isNull()
    return x.groupBy("source").agg(F.count_if(ok).alias("files"), F.coalesce(F.sum(F.when(ok, F.col("n_chars"))), F.lit(0)).alias("bytes"), F.count("error").alias("errors"))


# --- status ----------------------------------------------------------------------------------------------------------------------


@CATALOG.add("n10", f"SELECT o_orderkey AS job_id, CASE s WHEN 'completed' THEN 30 WHEN 'failed' THEN 30 ELSE 7 END AS days FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'denied' ELSE {STATUS_SQL} END AS s FROM orders)")
def keep_days(spark, sf_dir):
    """Days that a job is kept, by a status of every kind."""
    k = F.col("job_id") % 5
    status = F.when(k == 0, "failed").when(k == 1, "denied").otherwise(F.col("status"))
    return jobs(spark, sf_dir).withColumn("status", status).select("job_id", ttl_days(F.col("status")).alias("days"))


def ttl_days(status: Column) -> Column:
    days = F.lit(KEEP_OTHERS)
    for k, v in KEEP_DAYS.items():
        days = F.when(status == k, v).otherwise(days)
    return days


def valid_substatus(status: Column, substatus: Column) -> Column:
    """Whether a substatus belongs to its status; none belongs to an unknown one."""
    hit = F.lit(False)
    for k, v in SUBSTATUSES.items():
        hit = hit | ((status == k) & substatus.isin(*v))
    return F.coalesce(hit, F.lit(False))


@CATALOG.add("p19", f"SELECT o_orderkey AS job_id, sub, {STATUS_SQL} = 'processing' AND sub NOT IN ('scanning', '') AS valid FROM orders, (VALUES ('analyzing'), ('extracting'), ('specializing'), ('consolidating'), ('awaiting_review'), ('applying'), ('scanning'), ('')) AS t(sub)")
def substatuses(spark, sf_dir):
    x = jobs(spark, sf_dir).select("job_id", "status", F.explode(F.array(*[F.lit(v) for v in [*SUBSTATUSES["processing"], "scanning", ""]])).alias("sub"))
    return x.select("job_id", "sub", valid_substatus(F.col("status"), F.col("sub")).alias("valid"))


def one_shot(events_: DataFrame, key: str, order: list[str], guard: Column | None = None) -> DataFrame:
    """The first event of each key that passes the guard is applied; later ones and refused ones are error rows: events with `outcome`."""
    ok = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    x = events_.withColumn("__ok", ok)
    nth = F.sum(F.col("__ok").cast("int")).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return x.withColumn("outcome", F.when(~F.col("__ok"), "refused").when(nth == 1, "applied").otherwise("already done")).drop("__ok")


@CATALOG.add("t28", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'refused' WHEN sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 THEN 'applied' ELSE 'already done' END AS outcome FROM events")
def closings(spark, sf_dir):
    """Observations (users) are closed once; a review without an option or a text (an error) is refused."""
    return one_shot(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") != "error").select("event_id", "outcome")


def scan_jobs(queue: DataFrame, key: str, column: str) -> DataFrame:
    """What a worker makes of its queue (key, text, error, known): failed if the file can't be read or the job is unknown, else by
    findings awaiting_approval or processing; with the days it is kept and whether it goes back to the queue (transient errors)."""
    again = F.coalesce(F.col("error").isin("timeout", "unreachable"), F.lit(False))
    status = F.when(again, "pii_scanning").when(F.col("error").isNotNull(), "failed").when(~F.col("known"), "failed").when(F.col("found"), "awaiting_approval").otherwise("processing")
    x = with_findings(queue, key, column).withColumns({"requeued": again, "status": status})
    return x.select(key, "status", "requeued", ttl_days(F.col("status")).alias("days"), F.coalesce("error", F.when(~F.col("known"), "job not found")).alias("failure"))


def _queue(spark, sf_dir) -> DataFrame:
    d = _personal(spark, sf_dir)
    return d.select("doc_id", "text", F.when(F.col("doc_id") % 11 == 0, "timeout").when(F.col("doc_id") % 13 == 0, "corrupt").alias("error"), (F.col("doc_id") % 17 != 0).alias("known"))


_SCANNED_SQL = FOUND_IN_SQL + f", s AS (SELECT f.doc_id, CASE WHEN f.doc_id % 11 = 0 THEN 'timeout' WHEN f.doc_id % 13 = 0 THEN 'corrupt' WHEN f.doc_id % 17 = 0 THEN 'job not found' END AS failure, f.doc_id IN (SELECT doc_id FROM ({PERSONAL_SQL}) WHERE score >= 0.85) AS hit FROM found_in f) "


@CATALOG.add("t31", _SCANNED_SQL + "SELECT doc_id, status, CASE WHEN status = 'failed' THEN 30 ELSE 7 END AS days, failure FROM (SELECT *, CASE WHEN failure = 'timeout' THEN 'pii_scanning' WHEN failure IS NOT NULL THEN 'failed' WHEN hit THEN 'awaiting_approval' ELSE 'processing' END AS status FROM s)")
def scanned(spark, sf_dir):
    return scan_jobs(_queue(spark, sf_dir), "doc_id", "text").select("doc_id", "status", "days", "failure")


def work_stream(queue: DataFrame, key: str, column: str, sink, checkpoint: str):
    """The worker loop as a stream: every micro-batch of the queue is scanned and given to sink(frame, batch id); the checkpoint is what a
    restarted worker resumes from, so nothing popped is lost.  Returns the running query."""
    return queue.writeStream.foreachBatch(lambda frame, n: sink(scan_jobs(frame, key, column), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@CATALOG.add("t23", _SCANNED_SQL + "SELECT doc_id, failure = 'timeout' AND failure IS NOT NULL AS requeued FROM s")
def requeued(spark, sf_dir):
    """Which jobs a worker puts back."""
    return scan_jobs(_queue(spark, sf_dir), "doc_id", "text").select("doc_id", "requeued")


# --- limits and gates ------------------------------------------------------------------------------------------------------------


def two_tier(requests: DataFrame, client: str, order: str, at: str, own: int = 35, own_us: int = HOUR, everyone: int = 1000, everyone_us: int = DAY) -> DataFrame:
    """A sliding log per client, then one for all; a client's slot is spent even where the second refuses.

    The second log is one sequence, but it is cut wherever traffic is light or pauses; only a stretch under constant load is one run.
    """
    first = sliding_log(requests, client, order, at, own_us, own).where("admitted").select(order)
    passed = requests.join(first, order).select(order, at, F.lit(0).cast("long").alias("__all"))
    second = sliding_log(passed, "__all", order, at, everyone_us, everyone).select(order, "admitted")
    return requests.select(order).join(second, order, "left").select(order, F.when(F.col("admitted").isNull(), "client").when(F.col("admitted"), "admitted").otherwise("everyone").alias("verdict"))


_OWN_SQL = log_sql(EVENTS_SQL, "user_id", "event_id", "us", DAY, 2)


@CATALOG.add("t02", f"SELECT e.event_id, CASE WHEN s.ok IS NULL THEN 'client' WHEN s.ok THEN 'admitted' ELSE 'everyone' END AS verdict FROM events e LEFT JOIN ({log_sql(f'SELECT 0 AS everyone, event_id, us FROM ({_OWN_SQL}) WHERE ok', 'everyone', 'event_id', 'us', DAY, 20)}) s ON s.event_id = e.event_id")
def two_tier_limit(spark, sf_dir):
    """T02 with limits that the events reach: two a day and user, and twenty in all."""
    return two_tier(events(spark, sf_dir), "user_id", "event_id", "us", 2, DAY, 20, DAY)


def status_limit(requests: DataFrame, client: str, order: str, at: str) -> DataFrame:
    """The sliding log with its own limit, 100 an hour and client."""
    return sliding_log(requests, client, order, at, HOUR, 100)


@CATALOG.add("t03", f"SELECT event_id, ok AS admitted, 100 - len(log) AS remaining FROM ({log_sql('SELECT event_type, event_id, epoch_us(ts) // 60 AS us FROM events', 'event_type', 'event_id', 'us', HOUR, 100)})")
def status_limits(spark, sf_dir):
    """T03 with event types as clients, and a minute of the table as a second, so that the limit is reached."""
    x = events(spark, sf_dir).withColumn("us", F.expr("us div 60"))
    return status_limit(x, "event_type", "event_id", "us").select("event_id", "admitted", "remaining")


def gate(requests: DataFrame, decisions: DataFrame, key: str, wait: str = "INTERVAL 600 SECONDS") -> tuple[DataFrame, DataFrame]:
    """(one row per key: the first decision within the wait, else denied; one row per decision: accepted, already_decided or too_late).

    requests: key, asked_at; decisions: key, n (order), decided_at, approved.
    """
    x = decisions.join(requests, key)
    late = F.col("decided_at") > F.col("asked_at") + F.expr(wait)
    nth = F.row_number().over(W.partitionBy(key).orderBy("decided_at", "n"))
    x = x.withColumn("answer", F.when(late, "too_late").when(nth == 1, "accepted").otherwise("already_decided"))
    taken = x.where("answer = 'accepted'").select(key, F.when(F.col("approved"), "approved").otherwise("denied").alias("decision"))
    return requests.join(taken, key, "left").select(key, F.coalesce("decision", F.lit("denied")).alias("decision")), x.select(key, "n", "answer")


def _gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    asked = e.groupBy("user_id").agg(F.min("ts").alias("asked_at"))
    return gate(asked, e.where("event_type IN ('purchase', 'error')").select("user_id", F.col("event_id").alias("n"), F.col("ts").alias("decided_at"), (F.col("event_type") == "purchase").alias("approved")), "user_id", "INTERVAL 3 DAYS")


_GATE_SQL = "SELECT e.user_id, event_id AS n, event_type = 'purchase' AS yes, CASE WHEN ts > lo + INTERVAL 3 DAY THEN 'too_late' WHEN row_number() OVER (PARTITION BY e.user_id ORDER BY ts, event_id) = 1 THEN 'accepted' ELSE 'already_decided' END AS answer FROM events e JOIN (SELECT user_id, min(ts) AS lo FROM events GROUP BY 1) m ON m.user_id = e.user_id WHERE event_type IN ('purchase', 'error')"


@CATALOG.add("t20", f"SELECT user_id, CASE WHEN bool_or(answer = 'accepted' AND yes) THEN 'approved' ELSE 'denied' END AS decision FROM (SELECT user_id, NULL AS yes, NULL AS answer FROM events UNION ALL SELECT user_id, yes, answer FROM ({_GATE_SQL})) GROUP BY user_id")
def gates(spark, sf_dir):
    return _gate(spark, sf_dir)[0]


@CATALOG.add("t20_answers", f"SELECT user_id, n, answer FROM ({_GATE_SQL})")
def gate_answers(spark, sf_dir):
    return _gate(spark, sf_dir)[1]


def due_runs(start: Column, end: Column, tasks: list[tuple[str, int]]) -> Column:
    """Array of (task, at) between two times for tasks (name, seconds between runs), the first at the start."""
    return F.concat(*[_runs(name, seconds, start, end) for name, seconds in tasks])


def _runs(name: str, seconds: int, start: Column, end: Column) -> Column:
    return F.transform(F.sequence(start, end, F.expr(f"INTERVAL {seconds} SECONDS")), lambda t: F.struct(F.lit(name).alias("task"), t.alias("at")))


@CATALOG.add("t22", "SELECT user_id, task, count(*) AS runs, max(at) AS last FROM (SELECT user_id, 'expire' AS task, unnest(generate_series(lo, hi, INTERVAL 6 HOUR)) AS at FROM (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1) UNION ALL SELECT user_id, 'cleanup', unnest(generate_series(lo, hi, INTERVAL 24 HOUR)) FROM (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1)) GROUP BY 1, 2".replace("AS at", "AS \"at\"").replace("max(at)", "max(\"at\")"))
def schedule(spark, sf_dir):
    """Runs of two periodic tasks while a user's worker lives."""
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    runs = F.explode(due_runs(F.col("lo"), F.col("hi"), [("expire", 21_600), ("cleanup", 86_400)]))
    return x.select("user_id", runs.alias("r")).groupBy("user_id", F.col("r.task").alias("task")).agg(F.count("*").alias("runs"), F.max("r.at").alias("last"))


def fold_state(events_: DataFrame, session: str) -> DataFrame:
    """A client's state of each session from its events (n, kind, name, text), in order: step_started and step_done set a step's status,
    version sets a version's text (right wins), error sets the error, complete sets done; what comes after complete or error changes nothing."""
    x = events_.groupBy(session).agg(F.sort_array(F.collect_list(F.struct("n", "kind", "name", "text"))).alias("e"))
    start = F.struct(*[F.create_map().cast("map<string,string>").alias(c) for c in ("steps", "versions")], F.lit(None).cast("string").alias("error"), F.lit(False).alias("done"))
    put = lambda m, k, v: F.map_concat(F.map_filter(m, lambda a, _: a != k), F.create_map(k, v))

    def step(s, e):
        over = s["done"] | s["error"].isNotNull()
        return F.struct(
            F.when(over, s["steps"]).when(e["kind"] == "step_started", put(s["steps"], e["name"], F.lit("running"))).when(e["kind"] == "step_done", put(s["steps"], e["name"], F.lit("done"))).otherwise(s["steps"]).alias("steps"),
            F.when(~over & (e["kind"] == "version"), put(s["versions"], e["name"], e["text"])).otherwise(s["versions"]).alias("versions"),
            F.when(~over & (e["kind"] == "error"), e["text"]).otherwise(s["error"]).alias("error"),
            (s["done"] | (~over & (e["kind"] == "complete"))).alias("done"),
        )

    return x.select(session, F.aggregate("e", start, step).alias("s")).select(session, "s.*")


@CATALOG.add("t18", """WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'step_started' WHEN 'view' THEN 'step_done' WHEN 'purchase' THEN 'version' WHEN 'error' THEN 'error' ELSE 'complete' END AS kind, CASE event_type WHEN 'purchase' THEN 'v' ELSE 's' END || (event_id % 3) AS name, props AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    l AS (SELECT *, min(CASE WHEN kind IN ('error', 'complete') THEN n END) OVER (PARTITION BY user_id) AS stop FROM e), live AS (SELECT * FROM l WHERE stop IS NULL OR n <= stop)
    SELECT u.user_id, coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT name || '=' || arg_max(CASE WHEN kind = 'step_done' THEN 'done' ELSE 'running' END, n) AS x FROM live WHERE live.user_id = u.user_id AND kind LIKE 'step%' GROUP BY name)), '') AS steps,
    coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT name || '=' || arg_max(text, n) AS x FROM live WHERE live.user_id = u.user_id AND kind = 'version' GROUP BY name)), '') AS versions,
    (SELECT text FROM live WHERE live.user_id = u.user_id AND kind = 'error') AS error, EXISTS (SELECT 1 FROM live WHERE live.user_id = u.user_id AND kind = 'complete') AS done FROM (SELECT DISTINCT user_id FROM events) u""")
def folded_state(spark, sf_dir):
    k = F.col("event_type")
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    kind = F.when(k == "click", "step_started").when(k == "view", "step_done").when(k == "purchase", "version").when(k == "error", "error").otherwise("complete")
    name = F.concat(F.when(k == "purchase", "v").otherwise("s"), (F.col("event_id") % 3).cast("string"))
    s = fold_state(table(spark, sf_dir, "events").select("user_id", n.alias("n"), kind.alias("kind"), name.alias("name"), F.col("props").alias("text")), "user_id")
    flat = lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ",")
    return s.select("user_id", flat("steps").alias("steps"), flat("versions").alias("versions"), "error", "done")


def open_sessions(requests: DataFrame, key: str, at: str, order: str, gap_us: int = HOUR) -> DataFrame:
    """Events with their session's number and their own in it from 0; the first opens the session, a touch later than the gap opens the next."""
    w = W.partitionBy(key).orderBy(at, order)
    fresh = (F.col(at) - F.lag(at).over(w) >= gap_us) | F.lag(at).over(w).isNull()
    x = requests.withColumn("session", F.sum(fresh.cast("int")).over(w))
    return x.withColumn("number", F.row_number().over(W.partitionBy(key, "session").orderBy(at, order)) - 1).withColumn("kind", F.when(F.col("number") == 0, "session_created").otherwise("event"))


@CATALOG.add("t32", "SELECT event_id, session, number, CASE WHEN number = 0 THEN 'session_created' ELSE 'event' END AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1 AS number FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))))")
def opened_sessions(spark, sf_dir):
    return open_sessions(events(spark, sf_dir), "user_id", "us", "event_id").select("event_id", "session", "number", "kind")
