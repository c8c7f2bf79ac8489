"""State by key with timers, many keys to a call.

A stateful operator calls Python once for each key that has rows, and every reading or writing of state is a round trip: several
milliseconds a key, whatever it does.  Here keys are dealt to SHARDS, and one call takes the rows of all keys of a shard, reads
their states as one list and writes them as one.  A shard holds one part in SHARDS of all keys' states; its timer is the earliest of its
keys' times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Calls a micro-batch makes at most; more shards hold fewer keys each.
SHARDS = 1024


class Keyed(StatefulProcessor):
    """step(key, rows, state, watermark in ms) and expired(key, state, watermark in ms) give (state or None, ms at which the key is due or
    None, rows out); rows are lists of `columns`, ordered by `order` (none: as they come)."""

    def __init__(self, key: str, columns: list[str], order: list[str], schema: str, state: str, step: Callable, expired: Callable | None):
        self.key, self.columns, self.order, self.state, self.step, self.expired = key, columns, [columns.index(c) for c in order], state, step, expired
        self.names = [c.split()[0] for c in schema.split(", ")]
        self.longs = {c.split()[0] for c in schema.split(", ") if c.endswith(" long")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", f"key string, due_ms long, {self.state}")

    def _turn(self, call: Callable, now: int, todo: dict | None = None):
        """Call for each key with rows (None: each key that is due), keep what it says, and set the shard's timer; the rows out as a frame."""
        import pandas as pd

        held = {key: (due, state) for key, due, *state in self.kept.get()}
        first = min((due for due, _ in held.values() if due is not None), default=None)
        todo = {key: None for key, (due, _) in held.items() if due is not None and due <= now} if todo is None else todo
        changed, out = False, []
        for key, rows in todo.items():
            _, state = before = held.pop(key, (None, None))
            new, due, more = call(key, rows, state, now)
            out += more
            after = (None if due is None else max(due, now + 1), None if new is None else list(new))
            if new is not None:
                held[key] = after
            changed |= after != before
        if changed:
            self.kept.put([(key, due, *state) for key, (due, state) in held.items()]) if held else self.kept.clear()
        then = min((due for due, _ in held.values() if due is not None), default=None)
        if then != first:
            if first is not None and first > now:
                self.handle.deleteTimer(first)
            if then is not None:
                self.handle.registerTimer(then)
        columns = list(zip(*out, strict=True)) if out else [[]] * len(self.names)
        return pd.DataFrame({c: pd.array(x, dtype="Int64" if c in self.longs else object) for c, x in zip(self.names, columns, strict=True)})

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001
        todo: dict = {}
        for frame in rows:
            for own, *r in zip(*[frame[c].tolist() for c in (self.key, *self.columns)], strict=True):
                todo.setdefault(own, []).append(r)
        for each in todo.values() if self.order else ():
            each.sort(key=lambda r: [r[c] for c in self.order])
        yield self._turn(self.step, timerValues.getCurrentWatermarkInMs() if self.expired else 0, todo)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001
        yield self._turn(lambda own, _, state, now: self.expired(own, state, now), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def by_key(rows: DataFrame, key: str, columns: list[str], order: list[str], schema: str, state: str, step: Callable, expired: Callable | None = None, shards: int = SHARDS) -> DataFrame:
    """A stream by a key (string) through step and expired (with a watermark on rows; None: without timers)."""
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).alias("__shard")
    process = Keyed(key, columns, order, schema, state, step, expired)
    return rows.select(shard, "*").groupBy("__shard").transformWithStateInPandas(process, schema, "Append", "EventTime" if expired else "None")
