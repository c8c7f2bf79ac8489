"""Streams over the events table, run to the end of what it holds, and their batch forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.plans.catalog import Catalog
from folio.sources import event_logs
from folio.sources.tables import table, work_dir
from folio.streaming import sessions

CATALOG = Catalog()

DAY = 86_400_000_000


def _base(e: DataFrame) -> DataFrame:
    t = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").cast("string").alias("key"), F.unix_micros(t).alias("us"), F.col("event_id").alias("n"), t.alias("at"), "event_type")


def _events_path(sf_dir: str) -> str:
    return f"{sf_dir}/events.parquet"


# --- gates: a signup asks, a purchase approves and an error denies -----------------------------------------------------------------


def _gates(e: DataFrame) -> DataFrame:
    k = F.col("event_type")
    return _base(e).where(k.isin("signup", "purchase", "error")).select("key", "us", "n", F.when(k == "signup", "asked").otherwise("decided").alias("kind"), (k == "purchase").alias("approved"), "at")


GATES_SQL = f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, event_id AS n, event_type FROM events WHERE event_type IN ('signup', 'purchase', 'error')),
    a AS (SELECT key, min((us, n)) AS first FROM e WHERE event_type = 'signup' GROUP BY key),
    d AS (SELECT e.*, a.first, CASE WHEN a.first IS NULL OR (e.us, e.n) <= a.first THEN 'unknown' WHEN e.us > a.first[1] + {3 * DAY} THEN 'too_late' ELSE 'inside' END AS place FROM e LEFT JOIN a ON a.key = e.key WHERE event_type <> 'signup'),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, place ORDER BY us, n) AS nth FROM d),
    t AS (SELECT key, us, event_type FROM r WHERE place = 'inside' AND nth = 1)
    SELECT key, n, CASE WHEN place <> 'inside' THEN place WHEN nth = 1 THEN 'accepted' ELSE 'already_decided' END AS answer, us AS at_us FROM r
    UNION ALL SELECT a.key, NULL, CASE WHEN t.event_type = 'purchase' THEN 'approved' ELSE 'denied' END, coalesce(t.us, a.first[1] + {3 * DAY}) FROM a LEFT JOIN t ON t.key = a.key
    WHERE t.key IS NOT NULL OR a.first[1] + {3 * DAY} <= (SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ('signup', 'purchase', 'error'))
"""


@CATALOG.add("t20_stream", GATES_SQL)
def gates_through_stream(spark, sf_dir):
    """Gates with a wait of three days; those whose wait isn't over at the end of the table have no outcome yet."""
    return sessions.through_stream(spark, _events_path(sf_dir), lambda s: sessions.gate_stream(_gates(s), "at", 3 * DAY))


# --- deadlines: a click sets one a day ahead, a purchase lifts it --------------------------------------------------------------------


def _deadlines(e: DataFrame, add: str, remove: str, wait_us: int) -> DataFrame:
    k = F.col("event_type")
    return _base(e).where(k.isin(add, remove)).select("key", "us", "n", F.when(k == add, "add").otherwise("remove").alias("kind"), F.when(k == add, F.col("us") + wait_us).alias("due_us"), "at")


def deadlines_sql(add: str, remove: str, wait_us: int) -> str:
    return f"""
        WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, event_id AS n, event_type AS kind, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events WHERE event_type IN ('{add}', '{remove}'))
        SELECT key, n, us + {wait_us} AS due_us FROM e WHERE kind = '{add}' AND (after IS NULL OR after > us + {wait_us}) AND us + {wait_us} <= (SELECT max(us) FROM e)"""


@CATALOG.add("t06_stream", deadlines_sql("click", "purchase", DAY))
def deadlines_through_stream(spark, sf_dir):
    return sessions.through_stream(spark, _events_path(sf_dir), lambda s: sessions.deadlines_stream(_deadlines(s, "click", "purchase", DAY), "at"))


@CATALOG.add("t06_deadlines", deadlines_sql("click", "purchase", DAY))
def deadlines(spark, sf_dir):
    """Adds replace a key's deadline, removes lift it; expired by the table's last time."""
    x = _deadlines(table(spark, sf_dir, "events"), "click", "purchase", DAY)
    return sessions.deadlines_batch(x.join(F.broadcast(x.agg(F.max("us").alias("now"))), F.lit(True)), F.col("now"))


@CATALOG.add("t21_runs", deadlines_sql("signup", "view", 1_800_000_000))
def timed_out_runs(spark, sf_dir):
    """Runs (begun by a signup, ended by a view) that take longer than 1800 seconds."""
    x = _deadlines(table(spark, sf_dir, "events"), "signup", "view", 1_800_000_000)
    return sessions.deadlines_batch(x.join(F.broadcast(x.agg(F.max("us").alias("now"))), F.lit(True)), F.col("now"))


# --- session logs: a view reads, everything else is published ----------------------------------------------------------------------


def _log(e: DataFrame) -> DataFrame:
    k, text = F.col("event_type"), F.col("n").cast("string")
    read = k == "view"
    return _base(e).select(
        "key", "us", "n", F.when(read, "read").otherwise("publish").alias("kind"), F.when(~read, k).alias("type"), F.when(~read, F.concat(F.lit("e"), text)).alias("data"),
        F.when(read, F.concat(F.lit("r"), (F.col("n") % 3).cast("string"))).alias("reader"), F.when(read, F.col("n") % 5 - 1).alias("last_id"), "at",
    )


LOG_SQL = f"""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS us, event_id AS n, event_type AS type, event_type = 'view' AS read, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
    s AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY us, n ROWS UNBOUNDED PRECEDING) AS session FROM e),
    l AS (SELECT *, sum(CASE WHEN read THEN 0 ELSE 1 END) OVER (PARTITION BY key, session ORDER BY us, n ROWS UNBOUNDED PRECEDING) AS id, 'r' || (n % 3) AS reader FROM s),
    q AS (SELECT key, session, reader, n % 5 - 1 AS last_id, lead(id) OVER (PARTITION BY key, session, reader ORDER BY us, n) AS until FROM l WHERE read),
    p AS (SELECT key, session, id, type, 'e' || n AS data FROM l WHERE NOT read UNION ALL SELECT DISTINCT key, session, 0, 'session', key FROM l)
    SELECT p.key, CAST(p.session AS BIGINT) AS session, q.reader, CAST(p.id AS BIGINT) AS id, p.type, p.data FROM q JOIN p ON p.key = q.key AND p.session = q.session WHERE p.id > q.last_id AND (q.until IS NULL OR p.id <= q.until)
"""


@CATALOG.add("t17_replay", LOG_SQL)
def replay(spark, sf_dir):
    """What each reader of a session gets, from its own last number on; sessions end after a day without a touch."""
    return sessions.session_log_batch(_log(table(spark, sf_dir, "events")), DAY)


@CATALOG.add("t17_stream", LOG_SQL)
def replay_through_stream(spark, sf_dir):
    return sessions.through_stream(spark, _events_path(sf_dir), lambda s: sessions.session_log_stream(_log(s), "at", DAY))


# --- event logs as a source --------------------------------------------------------------------------------------------------------


@CATALOG.add("s31_stream", "SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id, event_type AS event, props AS data, false AS malformed FROM events")
def logs_through_stream(spark, sf_dir):
    """Every user's events appended to its log and read back as a stream, stopped and resumed in between; the second
    writer begins again at the start, as one does after a lost task."""
    e = table(spark, sf_dir, "events")
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    events = e.select(F.col("user_id").cast("string").alias("session"), number.cast("long").alias("id"), F.col("event_type").alias("event"), F.col("props").alias("data"))
    home = f"{work_dir(spark)}/folio-logs-{uuid.uuid4().hex}"
    for written in (events.where("id < 20"), events):
        event_logs.append(written, f"{home}/logs").write.format("noop").mode("overwrite").save()
        sessions.run_available(event_logs.once(event_logs.read_stream(spark, f"{home}/logs")), f"{home}/checkpoint", f"{home}/rows")
    return spark.read.parquet(f"{home}/rows")
