"""Event logs of sessions as a streaming source: one text log a session, read on from the last event that was read.

A log holds events as a server sends them (id, event and data lines, a blank line after each).  Writers append, and may append
again what a lost task had appended already.  The source's offset is, for every log, the byte after the last whole event; the state of
`once` is the last id it gave out.  So a stopped query goes on from its checkpoint, loses nothing and repeats nothing.  The driver
looks at the ends of logs only; logs are dealt to tasks by their new bytes.

The offset has an entry for each log in the folder: remove the logs of sessions that have expired.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from folio.sources.objects import _open
from folio.streaming.keyed import by_key

#: Bytes of logs that one task is dealt, if there are several logs, and how many logs.
TASK_BYTES, TASK_LOGS = 32 << 20, 1000
_SCHEMA = "session string, id long, event string, data string, malformed boolean"
_TAIL = 1 << 16
_HEARTBEAT = ":"


def parse_block(block: str) -> tuple[int | None, str, str | None, bool] | None:
    """(id, event, data, malformed) of the text between two blank lines; None where it holds nothing or only comments."""
    lines = [x for x in block.split("\n") if x.strip() and not x.startswith(_HEARTBEAT)]
    if not lines:
        return None
    number, kind, data = None, "message", []
    for line in lines:
        name, _, value = line.partition(":")
        value = value[1:] if value.startswith(" ") else value
        if name == "id":
            try:
                number = int(value.strip())
            except ValueError:
                pass
        elif name == "event":
            kind = value.strip()
        elif name == "data":
            data.append(value)
    text = "\n".join(data)
    try:
        json.loads(text)
    except ValueError:
        return number, kind, text or None, True
    return number, kind, text, number is None


def _whole(source, size: int, start: int) -> int:
    """Where the last whole event ends, between start and size: after its blank line."""
    end, step = size, _TAIL
    while end > start:
        low = max(start, size - step)
        at = source.read_at(size - low, low).rfind(b"\n\n")
        if at >= 0:
            return low + at + 2
        end, step = low, step * 4
    return start


@dataclass
class _Part(InputPartition):
    logs: list  # (session, first byte, end byte)


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path
        self.ends: dict = {}

    def initialOffset(self) -> dict:
        return {"logs": {}}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, home = _open(self.path)
        for f in store.get_file_info(fs.FileSelector(home, allow_not_found=True)):
            if f.base_name.endswith(".log") and f.size > self.ends.get(f.base_name, (0, 0))[1]:
                with store.open_input_file(f.path) as source:
                    self.ends[f.base_name] = (_whole(source, f.size, self.ends.get(f.base_name, (0, 0))[0]), f.size)
        return {"logs": {unquote(k[:-4]): end for k, (end, _) in sorted(self.ends.items()) if end}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, logs, size = [], [], 0
        for session, upto in sorted(end["logs"].items()):
            since = start["logs"].get(session, 0)
            if upto <= since:
                continue
            if logs and (size + upto - since > TASK_BYTES or len(logs) == TASK_LOGS):
                parts.append(_Part(logs))
                logs, size = [], 0
            logs.append((session, since, upto))
            size += upto - since
        return [*parts, _Part(logs)] if logs else parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, home = _open(self.path)
        for session, since, upto in partition.logs:
            with store.open_input_file(f"{home}/{quote(session, safe='')}.log") as source:
                rest, at = b"", since
                while at < upto:
                    piece = source.read_at(min(TASK_BYTES, upto - at), at)
                    at += len(piece)
                    blocks = (rest + piece).split(b"\n\n")
                    rest = blocks.pop()
                    found = (parse_block(b.decode("utf-8", "replace")) for b in blocks)
                    if rows := [(session, *x) for x in found if x is not None]:
                        yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)], ["session", "id", "event", "data", "malformed"])


class EventLogs(DataSource):
    """Rows (session, id, event, data, malformed) of the logs in the folder `path`."""

    @classmethod
    def name(cls) -> str:
        return "folio_events"

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The logs of a folder as a stream; what isn't an event (no id, or data that isn't JSON) is there as malformed."""
    spark.dataSource.register(EventLogs)
    return spark.readStream.format("folio_events").load(path)


def _once(key, rows, state, now):  # noqa: ANN001
    last = state[0] if state else -1
    given: set = set()
    out = []
    for id_, event, data, malformed in rows:
        if malformed or (id_ > last and id_ not in given):
            out.append((key, None if id_ != id_ else id_, event, data, malformed))
            if not malformed:
                given.add(id_)
    return ((int(max(given)),) if given else state), None, out


def once(logs: DataFrame) -> DataFrame:
    """The rows of read_stream without events that were appended again: ids only grow in a log, so the last one is all that is kept of it."""
    return by_key(logs, "session", ["id", "event", "data", "malformed"], [], _SCHEMA, "id long", _once)


def append(events: DataFrame, path: str) -> DataFrame:
    """Append events (session, id, event, data) to their sessions' logs, in order of ids; (session, n) of what was appended.

    A repeated task appends its events again, after a blank line that ends whatever it had left half written; readers pass over both.
    """
    where = events.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(events.sparkSession._jsc.hadoopConfiguration()).mkdirs(where)
    text = F.concat(F.lit("id: "), F.col("id").cast("string"), F.lit("\nevent: "), "event", F.lit("\ndata: "), F.col("data"), F.lit("\n\n"))

    def run(batches):
        store, home = _open(path)
        session, sink, n = None, None, 0
        for b in batches:
            done = []
            for own, block in zip(b.column("session").to_pylist(), b.column("text").to_pylist(), strict=True):
                if own != session:
                    if sink is not None:
                        sink.close()
                        done.append((session, n))
                    session, n = own, 0
                    sink = store.open_append_stream(f"{home}/{quote(own, safe='')}.log")
                    sink.write(b"\n\n")
                sink.write(block.encode())
                n += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done]), pa.array([k for _, k in done], pa.int64())], ["session", "n"])
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([session]), pa.array([n], pa.int64())], ["session", "n"])

    x = events.select(F.col("session").cast("string").alias("session"), F.col("id").cast("long").alias("id"), text.alias("text")).where("session IS NOT NULL AND text IS NOT NULL")
    return x.repartition("session").sortWithinPartitions("session", "id").select("session", "text").mapInArrow(run, "session string, n long")
