"""Job lifecycle: transitions, retention, deadlines, queues, tokens, and scalar helpers of dates, money and boxes (P16-P18, T05-T15, T24-T30, N)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.ranks import numbered
from folio.plans.catalog import Catalog
from folio.sources.tables import table

CATALOG = Catalog()

# Statuses and transitions, days to keep by status.
TERMINAL = ["completed", "failed", "denied"]
TRANSITIONS = {
    "pii_scanning": ["awaiting_approval", "processing", "failed"],
    "awaiting_approval": ["processing", "denied", "failed"],
    "processing": ["completed", "failed"],
    "completed": [],
    "failed": [],
    "denied": [],
}
#: Written by the approval path, though the table of transitions lacks them.
LIVE_TRANSITIONS = {"awaiting_approval": ["processing_queued"], "processing_queued": ["processing"]}
NOW = "1997-01-01 00:00:00"
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'pii_scanning' END"


def _now() -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{NOW}'")


def jobs(spark, sf_dir) -> DataFrame:
    s = F.col("o_orderstatus")
    status = F.when(s == "F", "completed").when(s == "O", "processing").otherwise("pii_scanning")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("price"))


def to_clean(index: DataFrame, jobs_: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Of the indexed job ids those to clean: jobs that are gone, and ended ones (job_id, status, created_at as text) from before the cutoff; a
    date that can't be read keeps its job, one without a zone is UTC."""
    x = index.join(jobs_.withColumn("__there", F.lit(True)), "job_id", "left")
    created = F.try_to_timestamp(F.regexp_replace("created_at", "Z$", "+00:00"))
    old = F.coalesce(created < now - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))
    return x.where(F.col("__there").isNull() | (F.col("status").isin(TERMINAL) & old)).select("job_id")


@CATALOG.add("p16", f"SELECT o_orderkey AS job_id FROM orders WHERE o_orderkey % 11 = 0 OR ({STATUS_SQL} = 'completed' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 30 DAY AND o_orderkey % 7 <> 0)")
def cleanable(spark, sf_dir):
    """P16 over an index of all orders, of which every eleventh has no job and every seventh no readable date."""
    x = jobs(spark, sf_dir)
    at = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("job_id") % 7 == 0, "soon").when(F.col("job_id") % 2 == 0, F.concat(at, F.lit("Z"))).otherwise(at)
    return to_clean(x.select("job_id"), x.where("job_id % 11 <> 0").select("job_id", "status", text.alias("created_at")), F.expr(f"TIMESTAMP '{NOW}+00:00'"))


@CATALOG.add("p17", f"SELECT o_orderkey AS job_id FROM orders WHERE {STATUS_SQL} IN ('processing', 'pii_scanning') AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR")
def stuck(spark, sf_dir):
    return jobs(spark, sf_dir).where(F.col("status").isin("processing", "pii_scanning") & (F.col("created_at") < _now() - F.expr("INTERVAL 2 HOURS"))).select("job_id")


def can_move(old: Column, new: Column, live: bool = False) -> Column:
    """Whether a transition is allowed; `live` adds the edges of the approval path."""
    edges = {k: list(v) for k, v in TRANSITIONS.items()}
    for k, v in LIVE_TRANSITIONS.items() if live else ():
        edges[k] = edges.get(k, []) + v
    ok = F.lit(False)
    for k, v in edges.items():
        ok = F.when(old == k, new.isin(v) if v else F.lit(False)).otherwise(ok)
    return ok


@CATALOG.add("p18", f"SELECT o_orderkey AS job_id, ({STATUS_SQL} = 'processing' AND n IN ('completed', 'failed')) OR ({STATUS_SQL} = 'pii_scanning' AND n IN ('awaiting_approval', 'processing', 'failed')) AS allowed FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE 'failed' END AS n FROM orders)")
def transitions(spark, sf_dir):
    new = F.when(F.col("job_id") % 3 == 0, "completed").when(F.col("job_id") % 3 == 1, "processing").otherwise("failed")
    return jobs(spark, sf_dir).select("job_id", can_move(F.col("status"), new).alias("allowed"))


@CATALOG.add("t05", "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS popped, count(*) OVER (PARTITION BY event_type) AS depth FROM events")
def queue_order(spark, sf_dir):
    """First in, first out, by queue."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return numbered(e, "event_type", ["us", "event_id"], "popped", "depth").select("event_type", "event_id", "popped", "depth")


@CATALOG.add("t06", f"SELECT l_orderkey, count(*) AS expired FROM lineitem WHERE l_shipdate <= TIMESTAMP '{NOW}' GROUP BY 1")
def expired_deadlines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= _now()).groupBy("l_orderkey").agg(F.count("*").alias("expired"))


@CATALOG.add("t08", f"SELECT o_orderkey AS job_id, 'failed' AS status, 'approval expired' AS audit FROM orders WHERE {STATUS_SQL} = 'pii_scanning' AND o_orderdate + INTERVAL 4 HOUR <= TIMESTAMP '{NOW}'")
def expired_approvals(spark, sf_dir):
    """Approvals past their expiry fail, guarded by the status, with an audit record."""
    x = jobs(spark, sf_dir).where((F.col("status") == "pii_scanning") & (F.col("created_at") + F.expr("INTERVAL 4 HOURS") <= _now()))
    return x.select("job_id", F.lit("failed").alias("status"), F.lit("approval expired").alias("audit"))


@CATALOG.add("t09", f"SELECT event_id, date_diff('hour', ts, TIMESTAMP '2100-01-01') > 24 AS stale FROM events")
def stale_objects(spark, sf_dir):
    age = F.expr("(unix_micros(TIMESTAMP '2100-01-01') - unix_micros(CAST(ts AS TIMESTAMP))) / 3.6e9")
    return table(spark, sf_dir, "events").select("event_id", (age > 24).alias("stale"))


@CATALOG.add("t10", f"SELECT o_orderkey AS job_id, CASE WHEN {STATUS_SQL} = 'completed' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 30 DAY THEN 'delete' WHEN {STATUS_SQL} <> 'completed' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR THEN 'fail' ELSE 'keep' END AS action FROM orders")
def maintenance(spark, sf_dir):
    """Old jobs go, stuck ones fail."""
    done, at = F.col("status").isin(TERMINAL), F.col("created_at")
    action = F.when(done & (at < _now() - F.expr("INTERVAL 30 DAYS")), "delete").when(~done & (at < _now() - F.expr("INTERVAL 2 HOURS")), "fail").otherwise("keep")
    return jobs(spark, sf_dir).select("job_id", action.alias("action"))


@CATALOG.add("t11", f"SELECT o_orderkey AS job_id, o_orderdate AS updated FROM orders WHERE o_orderdate < TIMESTAMP '1994-06-01'")
def updated_before(spark, sf_dir):
    return jobs(spark, sf_dir).where(F.expr("created_at < TIMESTAMP_NTZ '1994-06-01'")).select("job_id", F.col("created_at").alias("updated"))


def upsert(state: DataFrame, changes: DataFrame, key: str, at: str) -> DataFrame:
    """The latest record of each key; ties go to the change."""
    both = state.withColumn("__c", F.lit(0)).unionByName(changes.withColumn("__c", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (key, "__c")]
    last = both.groupBy(key).agg(F.max(F.struct(at, "__c", *[c for c in rest if c != at])).alias("r"))
    return last.select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


@CATALOG.add("t12", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts").select("user_id", "event_type", "event_id")


CATALOG.oracles["t12"] = "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id % 2 DESC, event_id DESC) = 1"


@CATALOG.add("t13", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def deleted(spark, sf_dir):
    """State without the deleted keys."""
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(gone, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@CATALOG.add("t14", "SELECT user_id, min(event_id) AS decided_by, count(*) - 1 AS refused FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def first_decision(spark, sf_dir):
    """The first decision stands; later ones are told that it is decided."""
    e = table(spark, sf_dir, "events").where("event_type IN ('click', 'purchase')")
    return e.groupBy("user_id").agg(F.min("event_id").alias("decided_by"), (F.count("*") - 1).alias("refused"))


@CATALOG.add("t15", f"SELECT o_orderkey AS job_id, CASE WHEN {STATUS_SQL} = 'pii_scanning' THEN 200 WHEN {STATUS_SQL} = 'completed' THEN 409 ELSE 404 END AS code FROM orders")
def decision_guards(spark, sf_dir):
    s = F.col("status")
    return jobs(spark, sf_dir).select("job_id", F.when(s == "pii_scanning", 200).when(s == "completed", 409).otherwise(404).alias("code"))


@CATALOG.add("t24", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 HAVING CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 7 FROM events)")
def metric_retention(spark, sf_dir):
    """Days before the cut-off go."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.date_sub(F.max("day"), 7).alias("cut"))
    return e.groupBy("day").agg(F.count("*").alias("n")).join(F.broadcast(last), F.col("day") >= F.col("cut")).select("day", "n")


@CATALOG.add("t25", "SELECT event_id, greatest(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS in_flight FROM events")
def in_flight(spark, sf_dir):
    step = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", -1).otherwise(0)
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.sum(step).over(w), F.lit(0)).alias("in_flight"))


@CATALOG.add("t26", f"SELECT o_orderkey AS job_id, {STATUS_SQL} || '->failed' AS audit FROM orders WHERE {STATUS_SQL} <> 'completed'")
def audits(spark, sf_dir):
    return jobs(spark, sf_dir).where("status <> 'completed'").select("job_id", F.concat("status", F.lit("->failed")).alias("audit"))


@CATALOG.add("t27", "SELECT event_id, '{\"type\":\"' || event_type || '\",\"user\":' || user_id || '}' AS line FROM events")
def access_log(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user"))).alias("line"))


@CATALOG.add("t29", "SELECT count(*) AS live FROM (SELECT user_id, max(ts) AS m FROM events GROUP BY 1) WHERE m > (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def live_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("cut"))
    return e.groupBy("user_id").agg(F.max("ts").alias("m")).join(F.broadcast(last), F.col("m") > F.col("cut")).agg(F.count("*").alias("live"))


@CATALOG.add("t30", "SELECT o_orderkey AS job_id, sha256('stream:' || o_orderkey) AS token, o_orderdate + INTERVAL 300 SECOND AS expires_at FROM orders")
def issued_tokens(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", F.sha2(F.concat(F.lit("stream:"), F.col("job_id").cast("string")), 256).alias("token"), (F.col("created_at") + F.expr("INTERVAL 300 SECONDS")).alias("expires_at"))


@CATALOG.add("n01", "SELECT event_id, epoch_us(ts) AS us FROM events")
def iso_times(spark, sf_dir):
    """ISO texts with Z; naive ones are UTC."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))).alias("us"))


@CATALOG.add("n03", "SELECT o_orderkey, (epoch_us(TIMESTAMP '1997-01-01') - epoch_us(o_orderdate)) / 3.6e9 AS hours FROM orders")
def ages(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", ((F.unix_micros(_now().cast("timestamp")) - F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(3.6e9)).alias("hours"))


@CATALOG.add("n02", f"SELECT o_orderkey, o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 7 DAY AS older FROM orders")
def cutoffs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderdate") < _now() - F.expr("INTERVAL 7 DAYS")).alias("older"))


@CATALOG.add("n04", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS date_key, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_keys(spark, sf_dir):
    key = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").select("o_orderkey", key.alias("date_key"), F.to_date(key, "yyyyMMdd").alias("day"))


@CATALOG.add("n05", "SELECT p_partkey, CASE WHEN p_size < 3 THEN '$0.00' || lpad(CAST(p_size * 1000 AS VARCHAR), 4, '0') ELSE '$' || p_size || '.00' END AS dollars FROM part")
def dollars(spark, sf_dir):
    """Six decimals below a cent, else two."""
    d = F.when(F.col("p_size") < 3, F.col("p_size") / 1000.0).otherwise(F.col("p_size") * 1.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(d < 0.01, F.concat(F.lit("$"), F.format_string("%.6f", d))).otherwise(F.concat(F.lit("$"), F.format_string("%.2f", d))).alias("dollars"))


@CATALOG.add("n06", "SELECT n_nationkey, 'key,' || n_nationkey || ',name,' || n_name AS flat FROM nation")
def flattened_maps(spark, sf_dir):
    m = F.create_map(F.lit("key"), F.col("n_nationkey").cast("string"), F.lit("name"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.flatten(F.transform(F.map_entries(m), lambda e: F.array(e["key"], e["value"]))), ",").alias("flat"))


@CATALOG.add("n07", "SELECT n_nationkey, '[\"' || n_name || '\",\"' || n_regionkey || '\"]' AS json FROM nation")
def serialised(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.array(F.col("n_name"), F.col("n_regionkey").cast("string"))).alias("json"))


@CATALOG.add("n08", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE TRY_CAST(regexp_extract(props, '\"k\": *(\\d+)', 1) AS INTEGER) END AS k FROM events")
def tolerant_json(spark, sf_dir):
    """Bad JSON reads as null."""
    text = F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(text, "k int")["k"].alias("k"))


@CATALOG.add("n09")
def secure_tokens(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", F.uuid().alias("token"))


def crop_box(left: Column, top: Column, right: Column, bottom: Column, page_w: Column, page_h: Column, image_w: Column, image_h: Column, pad: float = 0.02) -> list[Column]:
    """A box in points with its origin at the bottom as pixels from the top, padded and clamped."""
    sx, sy = image_w / page_w, image_h / page_h
    dx, dy = image_w * pad, image_h * pad
    x0, x1 = F.greatest(F.lit(0.0), left * sx - dx), F.least(image_w * 1.0, right * sx + dx)
    y0, y1 = F.greatest(F.lit(0.0), (page_h - top) * sy - dy), F.least(image_h * 1.0, (page_h - bottom) * sy + dy)
    return [x0.cast("int").alias("x0"), y0.cast("int").alias("y0"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1")]


@CATALOG.add("n11", "SELECT p_partkey, CAST(trunc(greatest(0.0, p_size * 2 - 24.48)) AS INTEGER) AS x0, CAST(trunc(greatest(0.0, (792 - p_size * 10) * 2 - 31.68)) AS INTEGER) AS y0, CAST(trunc(least(1224.0, (p_size + 100) * 2 + 24.48)) AS INTEGER) AS x1, CAST(trunc(least(1584.0, (792 - p_size) * 2 + 31.68)) AS INTEGER) AS y1 FROM part")
def crop_boxes(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", *crop_box(s, s * 10, s + 100, s, F.lit(612), F.lit(792), F.lit(1224), F.lit(1584)))


@CATALOG.add("n14", "SELECT p_partkey, least(p_size * 40, 800) AS width, CAST(trunc(p_size * 30.0 * least(p_size * 40, 800) / (p_size * 40)) AS INTEGER) AS height FROM part")
def resized(spark, sf_dir):
    w, h = F.col("p_size") * 40, F.col("p_size") * 30
    new = F.least(w, F.lit(800))
    return table(spark, sf_dir, "part").select("p_partkey", new.alias("width"), (h * 1.0 * new / w).cast("int").alias("height"))


@CATALOG.add("n15", "SELECT p_partkey, least(1.0::DOUBLE * pow(2.0::DOUBLE, p_size % 8), 30.0::DOUBLE) AS delay FROM part")
def backoff(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.least(F.lit(1.0) * F.pow(F.lit(2.0), F.col("p_size") % 8), F.lit(30.0)).alias("delay"))


@CATALOG.add("n16", "SELECT p_partkey, greatest(1.0::DOUBLE, least(3.0::DOUBLE, p_size / 10.0::DOUBLE)) AS scale FROM part")
def scales(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.greatest(F.lit(1.0), F.least(F.lit(3.0), F.col("p_size") / 10.0)).alias("scale"))


@CATALOG.add("n18", "SELECT doc_id, md5(substr(text, greatest(p - 200, 1), p + 400 - greatest(p - 200, 1))) AS around FROM (SELECT doc_id, text, strpos(text, 'tion') AS p FROM documents) WHERE p > 0")
def surroundings(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "text", F.instr("text", "tion").alias("p")).where("p > 0")
    start = F.greatest(F.col("p") - 200, F.lit(1))
    return x.select("doc_id", F.md5(F.substring(F.col("text"), start, F.col("p") + 400 - start)).alias("around"))
