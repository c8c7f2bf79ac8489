"""Per-key state machines over ordered events: sliding-log rate limit and circuit breaker, as batch folds and as streams.

Admission depends on earlier admissions, so these are folds, not windows.  The batch form cuts each key's sequence where
the state is known whatever came before, and folds the pieces independently, each as a sorted run of rows with bounded
state; where to cut is read from counts per key and time bucket, so a key that holds most rows is spread as well.  The
stream form keeps the same state per key between micro-batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType


def admit(log: list[int], now: int, window_us: int, limit: int) -> tuple[bool, list[int], int]:
    """(admitted, log, microseconds until a slot is free): entries at or before now - window are gone; refusals are not recorded."""
    live = [t for t in log if t > now - window_us]
    if len(live) < limit:
        return True, [*live, now], 0
    return False, live, live[0] + window_us - now if live else window_us


def _bucket(at: str, width: int) -> Column:
    return F.expr(f"(`{at}` - pmod(`{at}`, {width})) div {width}")


def _dealt(events: DataFrame, buckets: DataFrame, key: str, order: str, at: str) -> DataFrame:
    """Events with the pieces of their key and bucket, each piece as one sorted run; a row is `known` where it only brings a piece's first state."""
    x = events.join(buckets.select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), "__places"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__of")))
    x = x.select(*[c for c in events.columns if c != "__bucket"], F.inline("__places"))
    return x.repartition(key, "__piece").sortWithinPartitions(key, "__piece", at, order)


def _schema(events: DataFrame, columns: list[str], more: list[tuple[str, object]]) -> StructType:
    return StructType([events.schema[c] for c in columns] + [StructField(n, t) for n, t in more])


def log_pieces(events: DataFrame, key: str, at: str, window_us: int, limit: int) -> DataFrame:
    """(key, __bucket, __places): the pieces of every bucket of a window's width that holds events.

    A piece begins where the log is known: no entry can be alive (a gap of one window), or the bucket before and the one before
    that hold at most `limit` requests together, so that all of the bucket before were admitted and are all that is alive; they
    come along as known rows, at most `limit` of them.
    """
    w = W.partitionBy(key).orderBy("__bucket")
    x = events.groupBy(key, "__bucket").agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    near = F.coalesce(F.lag("__bucket").over(w) == F.col("__bucket") - 1, F.lit(False))
    x = x.withColumns({"near": near, "gone": ~near | (F.col("first") - F.lag("last").over(w) >= window_us), "light": F.col("n") + F.when(near, F.lag("n").over(w)).otherwise(0) <= limit})
    x = x.withColumn("warm", ~F.col("gone") & F.lag("light").over(w))
    x = x.withColumns({"__piece": F.sum((F.col("gone") | F.col("warm")).cast("long")).over(w), "next": F.coalesce(F.lead("warm").over(w), F.lit(False))})
    own = F.struct("__piece", F.lit(False).alias("__known"))
    return x.select(key, "__bucket", F.when(F.col("next"), F.array(own, F.struct((F.col("__piece") + 1).alias("__piece"), F.lit(True).alias("__known")))).otherwise(F.array(own)).alias("__places"))


def sliding_log(events: DataFrame, key: str, order: str, at: str, window_us: int, limit: int) -> DataFrame:
    """Each event admitted or not, with what remains and when to retry.  Events without a time are left out."""
    x = events.select(key, order, at).where(F.col(at).isNotNull()).withColumn("__bucket", _bucket(at, window_us))
    schema = _schema(x, [key, order], [("admitted", BooleanType()), ("remaining", LongType()), ("retry_after_us", LongType())])

    def fold(batches):
        log: deque = deque()
        piece = None
        for b in batches:
            keep, ok, remaining, wait = [], [], [], []
            for own, now, known in zip(zip(b.column(key).to_pylist(), b.column("__piece").to_pylist(), strict=True), b.column(at).to_pylist(), b.column("__known").to_pylist(), strict=True):
                if own != piece:
                    piece = own
                    log.clear()
                while log and log[0] <= now - window_us:
                    log.popleft()
                fits = known or len(log) < limit
                if fits:
                    log.append(now)
                keep.append(not known)
                ok.append(fits)
                remaining.append(limit - len(log))
                wait.append(0 if fits else log[0] + window_us - now if log else window_us)
            out = pa.RecordBatch.from_arrays([b.column(key), b.column(order), pa.array(ok, pa.bool_()), pa.array(remaining, pa.int64()), pa.array(wait, pa.int64())], schema.names)
            yield out.filter(pa.array(keep, pa.bool_()))

    return _dealt(x, log_pieces(x, key, at, window_us, limit), key, order, at).mapInArrow(fold, schema)


def sliding_log_stream(events: DataFrame, key: str, order: str, at: str, window_us: int, limit: int) -> DataFrame:
    """The same limit over a stream: the log of each key is the state between micro-batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(k, frames: Iterator, state):  # noqa: ANN001
        import pandas as pd

        log = list(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames)).sort_values([at, order])
        out = []
        for now in frame[at]:
            ok, log, wait = admit(log, int(now), window_us, limit)
            out.append((ok, limit - len(log), wait))
        state.update((log,))
        yield frame[[key, order]].assign(admitted=[o[0] for o in out], remaining=[o[1] for o in out], retry_after_us=[o[2] for o in out])

    return events.select(key, order, at).groupBy(key).applyInPandasWithState(step, f"{key} long, {order} long, admitted boolean, remaining long, retry_after_us long", "log array<long>", "append", GroupStateTimeout.NoTimeout)


def breaker_pieces(events: DataFrame, key: str, failed: str, successes: int) -> DataFrame:
    """(key, __bucket, __places): pieces of buckets as wide as the breaker's wait.

    A piece begins after a bucket without failures, following one without failures, that holds at least `successes` calls: by then
    any opening is over and closed again, and any count of failures is back at nothing.
    """
    w = W.partitionBy(key).orderBy("__bucket")
    x = events.groupBy(key, "__bucket").agg(F.count("*").alias("n"), F.count_if(failed).alias("bad"))
    near = F.coalesce(F.lag("__bucket").over(w) == F.col("__bucket") - 1, F.lit(False))
    x = x.withColumn("sound", (F.col("bad") == 0) & (F.col("n") >= successes) & (F.when(near, F.lag("bad").over(w)).otherwise(0) == 0))
    x = x.withColumn("__piece", F.sum(F.coalesce(F.lag("sound").over(w), F.lit(False)).cast("long")).over(w))
    return x.select(key, "__bucket", F.array(F.struct("__piece", F.lit(False).alias("__known"))).alias("__places"))


def breaker(events: DataFrame, key: str, order: str, at: str, failed: str, failures: int = 5, wait_us: int = 60_000_000, successes: int = 2) -> DataFrame:
    """The state after each call, and whether the call was let through.  Calls without a time are left out.

    Closed opens after `failures` failures in a row; open lets the first call through after the wait, as half-open;
    half-open closes after `successes` successes and opens again at any failure.
    """
    x = events.select(key, order, at, F.coalesce(F.col(failed), F.lit(False)).alias(failed)).where(F.col(at).isNotNull()).withColumn("__bucket", _bucket(at, wait_us))
    schema = _schema(x, [key, order], [("state", StringType()), ("allowed", BooleanType())])

    def fold(batches):
        piece, state, bad, good, since = None, "closed", 0, 0, 0
        for b in batches:
            states, let = [], []
            for own, now, fail in zip(zip(b.column(key).to_pylist(), b.column("__piece").to_pylist(), strict=True), b.column(at).to_pylist(), b.column(failed).to_pylist(), strict=True):
                if own != piece:
                    piece, state, bad, good, since = own, "closed", 0, 0, 0
                if state == "open" and now - since >= wait_us:
                    state, good = "half_open", 0
                allowed = state != "open"
                if allowed and fail:
                    bad += 1
                    if state == "half_open" or bad >= failures:
                        state, since, bad = "open", now, 0
                elif allowed:
                    bad, good = 0, good + 1
                    if state == "half_open" and good >= successes:
                        state = "closed"
                states.append(state)
                let.append(allowed)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(order), pa.array(states, pa.string()), pa.array(let, pa.bool_())], schema.names)

    return _dealt(x, breaker_pieces(x, key, failed, successes), key, order, at).mapInArrow(fold, schema)


def live_sessions_stream(events: DataFrame, key: str, at: str, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """T19 over a stream: session windows under a watermark; later events than that are dropped."""
    return events.withWatermark(at, late).groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("n"))


def windowed_counts_stream(events: DataFrame, at: str, by: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """G02 over a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("increase"))
