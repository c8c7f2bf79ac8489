"""State with timers over streams: gates that wait for a decision, deadlines, and session logs with replay.

Each stream keeps its state per key between micro-batches and acts on event time: what no row triggers, a timer does once the
watermark has passed it.  A restarted query goes on from its checkpoint.  Each has a batch form of the same meaning, over a
table, built of windows and joins.  Rows of one key in one micro-batch are put in order in memory; the source's trigger options
bound them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.sources.tables import work_dir
from folio.streaming.keyed import by_key

_NEEDS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, checkpoint: str, sink: str, **needs: str) -> None:
    """Process what a stream's source holds now, append the results to a Parquet folder, and end; the next call goes on from the checkpoint."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k in _NEEDS | needs}
    try:
        for k, v in (_NEEDS | needs).items():
            spark.conf.set(k, v)
        q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def through_stream(spark: SparkSession, path: str, build) -> DataFrame:
    """The result table of a stream over a folder (or file) of Parquet as it is now; build(stream) gives the processed stream."""
    home = f"{work_dir(spark)}/folio-stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # streams read folders
        source, path = source.option("pathGlobFilter", where.getName()), where.getParent().toString()
    out = build(source.parquet(path))
    run_available(out, f"{home}/checkpoint", f"{home}/rows")
    return spark.read.schema(out.schema).parquet(f"{home}/rows")


def _ms(us: int) -> int:
    return -(-us // 1000)


# --- gates (T20) -----------------------------------------------------------------------------------------------------------------

_GATE = "key string, n long, answer string, at_us long"


def gate_stream(rows: DataFrame, at: str, wait_us: int = 600_000_000, late: str = "0 seconds") -> DataFrame:
    """T20 over a stream of key (string), us, n, kind (asked or decided), approved and an event time.

    The first decision within the wait is taken, later ones are refused; without one, the timer denies.  Out: a row per decision (its
    number and accepted, already_decided, too_late or unknown), and one with n null for what the gate came to: approved or denied at its time.
    """

    def step(key, rows, state, now):  # noqa: ANN001
        asked, decision = state or (None, None)
        out = []
        for us, n, kind, approved in rows:
            if kind == "asked":
                asked = us if asked is None else asked
            elif asked is None:
                out.append((key, n, "unknown", us))
            elif us > asked + wait_us:
                out.append((key, n, "too_late", us))
            elif decision is not None:
                out.append((key, n, "already_decided", us))
            else:
                decision = "approved" if approved else "denied"
                out += [(key, n, "accepted", us), (key, None, decision, us)]
        return (None if asked is None else (asked, decision)), (_ms(asked + wait_us) if asked is not None and decision is None else None), out

    def expired(key, state, now):  # noqa: ANN001
        asked, decision = state
        return (asked, "denied"), None, [(key, None, "denied", asked + wait_us)]

    return by_key(rows.withWatermark(at, late), "key", ["us", "n", "kind", "approved"], ["us", "n"], _GATE, "asked_us long, decision string", step, expired)


def gate_batch(rows: DataFrame, wait_us: int = 600_000_000) -> DataFrame:
    """The same over a table in which every gate's wait is over."""
    order = W.partitionBy("key").orderBy("us", "n")
    first = F.min(F.when(F.col("kind") == "asked", F.struct("us", "n"))).over(W.partitionBy("key"))
    x = rows.withColumn("first", first).where("kind = 'decided'")
    known = F.coalesce(F.struct("us", "n") > F.col("first"), F.lit(False))
    inside = known & (F.col("us") <= F.col("first.us") + wait_us)
    nth = F.sum(inside.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    answers = x.select("key", "n", F.when(~known, "unknown").when(~inside, "too_late").when(nth == 1, "accepted").otherwise("already_decided").alias("answer"), F.col("us").alias("at_us"), "approved")
    taken = answers.where("answer = 'accepted'").select("key", F.when(F.col("approved"), "approved").otherwise("denied").alias("decision"), F.col("at_us").alias("taken_us"))
    asked = rows.where("kind = 'asked'").groupBy("key").agg(F.min("us").alias("asked"))
    ends = asked.join(taken, "key", "left").select("key", F.lit(None).cast("long").alias("n"), F.coalesce("decision", F.lit("denied")).alias("answer"), F.coalesce("taken_us", F.col("asked") + wait_us).alias("at_us"))
    return answers.drop("approved").unionByName(ends)


# --- deadlines (T06, T21) ----------------------------------------------------------------------------------------------------------

_EXPIRED = "key string, n long, due_us long"


def deadlines_stream(rows: DataFrame, at: str, late: str = "0 seconds") -> DataFrame:
    """T06 over a stream of key (string), us, n, kind (add or remove), due_us and an event time: an add sets the key's deadline anew, a remove
    lifts it, and a deadline that neither reaches in time expires: out with the number of its add."""

    def step(key, rows, state, now):  # noqa: ANN001
        n, due = state or (None, None)
        out = []
        for us, number, kind, due_us in rows:
            if due is not None and due < us:
                out.append((key, n, due))
            n, due = (number, int(due_us)) if kind == "add" else (None, None)
        return (None if due is None else (n, due)), (None if due is None else _ms(due)), out

    def expired(key, state, now):  # noqa: ANN001
        n, due = state
        return (None, None, [(key, n, due)]) if _ms(due) <= now else (state, _ms(due), [])

    return by_key(rows.withWatermark(at, late), "key", ["us", "n", "kind", "due_us"], ["us", "n"], _EXPIRED, "n long, due_us long", step, expired)


def deadlines_batch(rows: DataFrame, now_us: Column | int) -> DataFrame:
    """The same over a table, at a time: an add has expired if nothing follows up to its deadline, and that has passed."""
    after = F.lead("us").over(W.partitionBy("key").orderBy("us", "n"))
    x = rows.withColumn("after", after).where("kind = 'add'")
    return x.where((F.col("after").isNull() | (F.col("after") > F.col("due_us"))) & (F.col("due_us") <= now_us)).select("key", "n", "due_us")


# --- session logs (T16, T17, T32) ------------------------------------------------------------------------------------------------

_DELIVERED = "key string, session long, reader string, id long, type string, data string"
IDLE_US = 3_600_000_000


def session_log_stream(rows: DataFrame, at: str, idle_us: int = IDLE_US, late: str = "0 seconds") -> DataFrame:
    """T16, T17, T32 over a stream of key (string), us, n, kind (publish or read), type, data, reader, last_id and an event time: every event
    each reader gets, once.

    The first row of a key, and any that comes later than `idle_us` after the one before, opens a session, whose log begins with an
    event 0 of type session.  A published row gets the log's next number and goes to every reader the session has; a reading row is
    given what the log holds beyond its last_id, and from then on what follows.  Logs that nothing touches are dropped by a timer.
    """

    def step(key, rows, state, now):  # noqa: ANN001
        session, touched, types, data, names, lasts = state or (0, None, [], [], [], [])
        log, readers = list(zip(types, data, strict=True)), dict(zip(names, lasts, strict=True))  # events by their numbers
        out = []
        for us, _, kind, type_, text, reader, last_id in rows:
            if not log or us - touched > idle_us:
                session, log, readers = session + 1, [("session", key)], {}
            touched = us if touched is None else max(touched, us)
            if kind == "publish":
                out += [(key, session, each, len(log), type_, text) for each, last in readers.items() if len(log) > last]
                log.append((type_, text))
            else:
                last = int(last_id)
                out += [(key, session, reader, i, *log[i]) for i in range(max(last + 1, 0), len(log))]
                readers[reader] = max(last, len(log) - 1)
        return (session, touched, [t for t, _ in log], [d for _, d in log], list(readers), list(readers.values())), max(_ms(touched + idle_us), now) + 1, out

    def expired(key, state, now):  # noqa: ANN001
        session, touched, *_ = state
        return (session, touched, [], [], [], []), None, []

    state = "session long, touched_us long, types array<string>, data array<string>, readers array<string>, last_ids array<long>"
    return by_key(rows.withWatermark(at, late), "key", ["us", "n", "kind", "type", "data", "reader", "last_id"], ["us", "n"], _DELIVERED, state, step, expired)


def numbered_sessions(rows: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """rows with their session's number (from 1) and, for published ones, their own number in its log (from 1; 0 is the session's opening)."""
    w = W.partitionBy("key").orderBy("us", "n")
    fresh = F.coalesce(F.col("us") - F.lag("us").over(w) > idle_us, F.lit(True))
    x = rows.withColumn("session", F.sum(fresh.cast("long")).over(w))
    return x.withColumn("id", F.sum((F.col("kind") == "publish").cast("long")).over(W.partitionBy("key", "session").orderBy("us", "n").rowsBetween(W.unboundedPreceding, 0)))


def session_log_batch(rows: DataFrame, idle_us: int = IDLE_US) -> DataFrame:
    """The same over a table: readers meet the events of their session beyond their last_id by a join; a reader who reads again goes on
    where it was, and is given again only what it asks for again."""
    x = numbered_sessions(rows, idle_us)
    w = W.partitionBy("key", "session", "reader").orderBy("us", "n")
    reads = x.where("kind = 'read'").withColumn("until", F.lead("id").over(w)).select("key", "session", "reader", "last_id", "until", F.col("id").alias("so_far"))
    opened = x.groupBy("key", "session").agg(F.lit(0).cast("long").alias("id")).select("key", "session", "id", F.lit("session").alias("type"), F.col("key").alias("data"))
    log = x.where("kind = 'publish'").select("key", "session", "id", "type", "data").unionByName(opened)
    meets = reads.join(log, ["key", "session"]).where((F.col("id") > F.col("last_id")) & (F.col("until").isNull() | (F.col("id") <= F.col("until"))))
    return meets.select("key", "session", "reader", "id", "type", "data")
