"""Keyed state that takes rows in the order of their times, whatever order they arrive in.

Rows wait in the state store until the watermark has passed their bucket of
time; an event-time timer then releases the bucket and its rows are taken in
order of time and tie. A group of keys holds no more than what may still be
overtaken and the memories of its keys: the rows of a micro-batch go to the
store in chunks, and a release reads one bucket at a time.
"""

from __future__ import annotations

import pickle
from abc import abstractmethod
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues,
)

from courant.operators.ratelimit import admit

#: What timers and maps of state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHUNK_ROWS = 1000
#: Groups that keys are dealt into by a hash; fixed for the life of a checkpoint, like the shuffle partitions.
GROUPS = 2048


def _long(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


def _packed() -> T.StructType:
    return T.StructType([T.StructField("packed", T.BinaryType())])


class InOrder(StatefulProcessor):
    """Gives each row, in the order of its key, what `step` makes of it; None to rows that come too late.

    State belongs to a group of keys: each access to it is a call from one
    process to another, so calls are made by group and bucket and not by key.
    """

    def __init__(self, names: list[str], result: str, key: str, tie: str, bucket_ms: int) -> None:
        self.names, self.bucket_ms = names, bucket_ms
        self.made, self.key, self.tie = Row(*names, result), names.index(key), names.index(tie)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", _long("bucket"), _long("n"))
        self.rows = handle.getMapState("rows", _long("bucket", "chunk"), _packed())
        self.memories = handle.getValueState("memories", _packed())

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        """Rows have the columns `names`, then their time in microseconds."""
        watermark, waiting, held, width = timerValues.getCurrentWatermarkInMs(), {}, 0, len(self.names)
        for row in rows:
            values, at = row[:width], row[width]
            bucket = None if at is None else at // 1000 // self.bucket_ms
            if bucket is None or (bucket + 1) * self.bucket_ms <= watermark:
                yield self.made(*values, None)
                continue
            waiting.setdefault(bucket, []).append((at, values))
            held += 1
            if held == CHUNK_ROWS:
                self._keep(waiting)
                waiting, held = {}, 0
        self._keep(waiting)

    def _keep(self, waiting: dict[int, list]) -> None:
        for bucket, rows in waiting.items():
            found = self.chunks.getValue((bucket,))
            n = found[0] if found else 0
            if not n:
                self.handle.registerTimer((bucket + 1) * self.bucket_ms)
            self.rows.updateValue((bucket, n), (pickle.dumps(rows),))
            self.chunks.updateValue((bucket,), (n + 1,))

    def handleExpiredTimer(
        self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due = sorted(b for (b,) in self.chunks.keys() if (b + 1) * self.bucket_ms <= watermark)
        memories = self._load()
        for bucket in due:
            rows = []
            for chunk in range(self.chunks.getValue((bucket,))[0]):
                rows += pickle.loads(self.rows.getValue((bucket, chunk))[0])
                self.rows.removeKey((bucket, chunk))
            self.chunks.removeKey((bucket,))
            rows.sort(key=lambda r: (r[0], r[1][self.tie] is not None, r[1][self.tie]))
            for at, values in rows:
                memory = memories.setdefault(name_of(values[self.key]), [])
                yield self.made(*values, self.step(memory, at, values))
        kept = {name: memory for name, memory in memories.items() if memory and not self.useless(memory, watermark)}
        if due or len(kept) < len(memories):
            if kept:
                self.memories.update((pickle.dumps(kept),))
            else:
                self.memories.clear()
        if due and kept:
            self.remind(kept)

    def _load(self) -> dict[str, list]:
        return pickle.loads(self.memories.get()[0]) if self.memories.exists() else {}

    def close(self) -> None:
        pass

    @abstractmethod
    def step(self, memory: list, at: int, values: tuple) -> Any:
        """The result of a row; may change the memory of its key, empty at first, in place."""

    def useless(self, memory: list, watermark: int) -> bool:
        """Whether the watermark has made a memory that is not empty worth nothing."""
        return False

    def remind(self, memories: dict[str, list]) -> None:
        """Set a timer for when these memories may be worth nothing."""


def name_of(key: Any) -> str:
    """A text that is the same for keys Spark groups together, and for no others of a column."""
    return repr(key + 0.0 if isinstance(key, float) else key)  # no minus zero


class Failures(InOrder):
    """Errors in a row; their number is the memory, empty without any."""

    def __init__(self, names: list[str], result: str, key: str, tie: str, bucket_ms: int) -> None:
        super().__init__(names, result, key, tie, bucket_ms)
        self.status = names.index("status")

    def step(self, memory: list, at: int, values: tuple) -> int:
        failures = memory[0] + 1 if memory else 1
        memory[:] = [failures] if values[self.status] == "error" else []
        return memory[0] if memory else 0


class RateLimit(InOrder):
    """Verdicts; the memory is the allowed times still in the window, and goes with a timer."""

    def __init__(
        self, names: list[str], result: str, key: str, tie: str, bucket_ms: int, limit: int, window: int
    ) -> None:
        super().__init__(names, result, key, tie, bucket_ms)
        self.limit, self.window = limit, window

    def step(self, memory: list, at: int, values: tuple) -> bool:
        return admit(memory, at, self.limit, self.window)

    def useless(self, memory: list, watermark: int) -> bool:
        return self._free_at(memory) <= watermark

    def remind(self, memories: dict[str, list]) -> None:
        self.handle.registerTimer(max(map(self._free_at, memories.values())))

    def _free_at(self, memory: list) -> int:
        """When no row still to be released can be in the window of the last allowed one."""
        return (memory[-1] + self.window) // 1000 + self.bucket_ms


def in_order(
    rows: DataFrame, key: str, time: str, result: T.StructField, lateness_seconds: int, processor: InOrder,
    groups: int = GROUPS,
) -> DataFrame:
    """`rows` with the processor's result, a null one where they came behind the watermark.

    The watermark follows a copy of the time that ends before the state: rows
    behind it are the processor's to answer, not Spark's to drop.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = T.StructType([*rows.schema.fields, result])
    event = F.col(time).cast("timestamp")
    marked = rows.withColumns({
        "_at": F.unix_micros(event), "_group": F.pmod(F.xxhash64(key), F.lit(groups)), "_event": event,
    }).withWatermark("_event", f"{lateness_seconds} seconds").drop("_event")
    return marked.groupBy("_group").transformWithState(processor, schema, "append", "eventTime")
