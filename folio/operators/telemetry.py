"""Metrics, dashboards and rate limits (A26-A32, G, T01, T02, T07, T16-T19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.plans.catalog import Catalog
from folio.sources.tables import table
from folio.streaming import limits

CATALOG = Catalog()

# Histogram bounds.
BOUNDS = [1.0, 5.0, 10.0, 50.0, 100.0, 500.0]


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


@CATALOG.add("a26", "SELECT strftime(ts, '%Y%m%d') AS day, event_type AS metric, count(*) AS n FROM events GROUP BY 1, 2")
def daily_counters(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_type").alias("metric")).agg(F.count("*").alias("n"))


@CATALOG.add("a27", "SELECT day, string_agg(metric || '=' || n, ',' ORDER BY metric) AS summary FROM (SELECT CAST(ts AS DATE) AS day, event_type AS metric, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def daily_summary(spark, sf_dir):
    x = events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")).groupBy("day").agg(F.sort_array(F.collect_list(F.struct("event_type", "n"))).alias("s"))
    return x.select("day", F.array_join(F.transform("s", lambda v: F.concat(v["event_type"], F.lit("="), v["n"].cast("string"))), ",").alias("summary"))


@CATALOG.add("a28", "SELECT event_type, user_id % 4 AS worker, count(*) AS n FROM events GROUP BY 1, 2")
def labelled_counters(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", (F.col("user_id") % 4).alias("worker")).agg(F.count("*").alias("n"))


@CATALOG.add("a29", "SELECT event_type, le, sum(CASE WHEN value <= le THEN 1 ELSE 0 END) AS n FROM events, (VALUES (1.0), (5.0), (10.0), (50.0), (100.0), (500.0)) AS t(le) GROUP BY 1, 2")
def histogram(spark, sf_dir):
    """Cumulative buckets in one pass, without a row per bound and event."""
    x = events(spark, sf_dir).groupBy("event_type").agg(*[F.sum(F.when(F.col("value") <= b, 1).otherwise(0)).alias(f"b{k}") for k, b in enumerate(BOUNDS)])
    return x.select("event_type", F.explode(F.array(*[F.struct(F.lit(b).cast("decimal(4,1)").alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(BOUNDS)])).alias("h")).select("event_type", "h.le", "h.n")


CATALOG.oracles["a29"] = CATALOG.oracles["a29"].replace("event_type, le, sum", "event_type, CAST(le AS DECIMAL(4,1)) AS le, sum")


@CATALOG.add("a30", "SELECT event_type AS agent, count(*) AS calls, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS failed, max(user_id) AS last FROM events GROUP BY 1")
def call_records(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("agent")).agg(F.count("*").alias("calls"), F.sum((F.col("event_type") == "error").cast("long")).alias("failed"), F.max("user_id").alias("last"))


@CATALOG.add("a32", "SELECT event_type AS endpoint, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status, count(*) AS n, max(value) AS slowest FROM events GROUP BY 1, 2")
def requests(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "500").otherwise("200")
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("endpoint"), status.alias("status")).agg(F.count("*").alias("n"), F.max("value").alias("slowest"))


@CATALOG.add("g01", "SELECT event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def instant_vector(spark, sf_dir):
    """The last sample of each series."""
    x = events(spark, sf_dir).groupBy("event_type").agg(F.max(F.struct("us", "event_id", "value")).alias("m"))
    return x.select("event_type", "m.value", "m.event_id")


@CATALOG.add("g02", "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS increase FROM events GROUP BY 1, 2")
def rates(spark, sf_dir):
    """Increase of each series in five-minute windows."""
    x = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return x.groupBy("event_type", F.window("t", "5 minutes").alias("w")).agg(F.count("*").alias("increase")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "increase")


@CATALOG.add("g03", "SELECT CAST(ts AS DATE) AS day, 100.0::DOUBLE * sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) / count(*) AS success FROM events GROUP BY 1")
def success_ratio(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg((F.lit(100.0) * F.sum((F.col("event_type") != "error").cast("long")) / F.count("*")).alias("success"))


@CATALOG.add("g04")
def quantile_of_buckets(spark, sf_dir):
    """The 0.95 quantile by linear interpolation in the histogram's buckets."""
    h = histogram(spark, sf_dir)
    w = W.partitionBy("event_type").orderBy("le")
    x = h.withColumns({"before": F.coalesce(F.lag("n").over(w), F.lit(0)), "low": F.coalesce(F.lag("le").over(w), F.lit(0).cast("decimal(4,1)")), "total": F.max("n").over(W.partitionBy("event_type"))})
    want = F.col("total") * 0.95
    first = x.where((F.col("n") >= want) & (F.col("before") < want))
    return first.select("event_type", (F.col("low") + (F.col("le") - F.col("low")).cast("double") * (want - F.col("before")) / (F.col("n") - F.col("before"))).alias("p95"))


@CATALOG.add("g05", "SELECT event_type, sum(user_id % 10) / (count(*) / 100.0::DOUBLE + 0.001::DOUBLE) AS drain FROM events GROUP BY 1")
def drain_estimate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.sum(F.col("user_id") % 10) / (F.count("*") / F.lit(100.0) + F.lit(0.001))).alias("drain"))


@CATALOG.add("g06", "SELECT count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN '503' ELSE '200' END AS status FROM events) WHERE regexp_full_match(status, '5..')")
def label_pattern(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "503").otherwise("200")
    return table(spark, sf_dir, "events").where(status.rlike("^5..$")).agg(F.count("*").alias("n"))


def log_sql(source: str, key: str, order: str, at: str, window_us: int, limit: int) -> str:
    """The sliding log in SQL: (key, order, at, ok, log) by one step of recursion per event of a key, from a source of those columns."""
    live = f"list_filter(r.log, lambda x: x > e.{at} - {window_us})"
    return f"""
        WITH RECURSIVE e AS MATERIALIZED (SELECT {key}, {order}, {at}, row_number() OVER (PARTITION BY {key} ORDER BY {at}, {order}) AS k FROM ({source})),
        r({key}, {order}, {at}, k, ok, log) AS (
            SELECT {key}, {order}, {at}, k, true, [{at}] FROM e WHERE k = 1
            UNION ALL
            SELECT e.{key}, e.{order}, e.{at}, e.k, len({live}) < {limit}, CASE WHEN len({live}) < {limit} THEN list_append({live}, e.{at}) ELSE {live} END
            FROM r JOIN e ON e.{key} = r.{key} AND e.k = r.k + 1
        )
        SELECT {key}, {order}, {at}, ok, log FROM r"""


EVENTS_SQL = "SELECT user_id, event_id, epoch_us(ts) AS us FROM events"


@CATALOG.add("t01", f"SELECT user_id, event_id, ok AS admitted FROM ({log_sql(EVENTS_SQL, 'user_id', 'event_id', 'us', 86400000000, 2)})")
def rate_limit(spark, sf_dir):
    """At most two admissions per user in a sliding day; refused requests are not recorded."""
    return limits.sliding_log(events(spark, sf_dir), "user_id", "event_id", "us", window_us=86_400_000_000, limit=2).select("user_id", "event_id", "admitted")


@CATALOG.add("t04", f"SELECT user_id, event_id, ok AS admitted, 2 - len(log) AS remaining, CASE WHEN ok THEN 0 ELSE log[1] + 86400000000 - us END AS retry_after_us FROM ({log_sql(EVENTS_SQL, 'user_id', 'event_id', 'us', 86400000000, 2)})")
def remaining_quota(spark, sf_dir):
    return limits.sliding_log(events(spark, sf_dir), "user_id", "event_id", "us", window_us=86_400_000_000, limit=2)


@CATALOG.add("t07", """
    WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'error' AS fail, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r(user_id, event_id, k, state, allowed, bad, good, since) AS (
        SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 'closed', true, 0, 0, 0::BIGINT FROM e
        UNION ALL
        SELECT user_id, event_id, k, CASE WHEN opens THEN 'open' WHEN was = 'half_open' AND NOT fail AND tried + 1 >= 2 THEN 'closed' ELSE was END, was <> 'open',
            CASE WHEN opens OR (was <> 'open' AND NOT fail) THEN 0 WHEN was <> 'open' THEN bad + 1 ELSE bad END, CASE WHEN was <> 'open' AND NOT fail THEN tried + 1 ELSE tried END, CASE WHEN opens THEN us ELSE since END
        FROM (SELECT *, was <> 'open' AND fail AND (was = 'half_open' OR bad + 1 >= 2) AS opens FROM (
            SELECT e.*, r.bad, r.since, CASE WHEN r.state = 'open' AND e.us - r.since >= 3600000000 THEN 'half_open' ELSE r.state END AS was, CASE WHEN r.state = 'open' AND e.us - r.since >= 3600000000 THEN 0 ELSE r.good END AS tried
            FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
    )
    SELECT user_id, event_id, state, allowed FROM r WHERE k > 0
""")
def circuit_breaker(spark, sf_dir):
    """Closed, open and half-open by failures, waiting time and successes."""
    return limits.breaker(events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error"), "user_id", "event_id", "us", "failed", failures=2, wait_us=3_600_000_000, successes=2)


@CATALOG.add("t16", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS number, event_type FROM events WHERE event_type <> 'view'")
def event_log(spark, sf_dir):
    """An ordered log per session from which late subscribers replay."""
    e = events(spark, sf_dir).where("event_type <> 'view'")
    return e.select("user_id", "event_id", (F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")) - 1).cast("long").alias("number"), "event_type")


@CATALOG.add("t17", "SELECT user_id, count(*) AS replayed FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS number FROM events) WHERE number >= 3 GROUP BY 1")
def resumed(spark, sf_dir):
    """A reader that saw number 2 resumes at 3."""
    x = events(spark, sf_dir).select("user_id", (F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")) - 1).alias("number"))
    return x.where("number >= 3").groupBy("user_id").agg(F.count("*").alias("replayed"))


@CATALOG.add("t19", "SELECT user_id, min(ts) AS started, max(ts) AS touched, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 1 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, s")
def sessions(spark, sf_dir):
    """Sessions end after an hour without any touch."""
    x = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    s = x.groupBy("user_id", F.session_window("t", "1 hour").alias("w")).agg(F.min("ts").alias("started"), F.max("ts").alias("touched"), F.count("*").alias("n"))
    return s.select("user_id", "started", "touched", "n")
