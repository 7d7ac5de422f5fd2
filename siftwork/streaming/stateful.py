"""Stateful stream processors: rows in event-time order, sliding-window limits and a cache of answers.

All state lives in the state store (RocksDB), keyed and partitioned by Spark;
a task holds the rows of one key that the watermark released, never a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Processors need the RocksDB state store; queries started after this use it, those with a checkpoint keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def admits(time: float, limit: int, window: float, recent: list[float]) -> bool:
    """Whether a call has fewer than ``limit`` admitted calls in the window before it; an admitted one joins ``recent``, expired ones leave."""
    while recent and recent[0] <= time - window:
        recent.pop(0)
    if len(recent) < limit:
        recent.append(time)
        return True
    return False


class InOrder(StatefulProcessor):
    """Hands the rows of a key on in the order (us, rank, id), once the watermark has passed their time.

    Rows wait in a map state, so they may come in any order and in any micro-batch; a row that comes twice (equal us, rank and id)
    counts once.  One timer a key stands at its earliest waiting row, or where nothing waits, at the time its state ends.
    Rows need the columns us (event time in microseconds), rank, id and those of ``value``.
    """

    #: Columns besides us, rank and id that a waiting row keeps, as a schema.
    value = "nothing boolean"
    id_type = "long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c.split()[0] for c in self.value.split(",")]
        self.waiting = handle.getMapState("waiting", f"us long, rank int, id {self.id_type}", self.value)
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = None
        for row in rows:
            self.waiting.updateValue((row.us, row.rank, row.id), tuple(getattr(row, n, None) for n in self.names))
            first = row.us if first is None else min(first, row.us)
        if first is not None and (not self.timer.exists() or -(-first // 1000) < self.timer.get()[0]):
            self._wake_at(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        due, later = [], None
        for at, value in self.waiting.iterator():
            if at[0] <= now * 1000:
                due.append((tuple(at), tuple(value)))
            else:
                later = at[0] if later is None else min(later, at[0])
        due.sort(key=lambda x: x[0])
        out = list(self.take(key, due))
        for at, _ in due:
            self.waiting.removeKey(at)
        self.timer.clear()
        if later is not None:
            self._wake_at(-(-later // 1000))
        else:
            end = self.ends()
            if end is not None and end > now:
                self._wake_at(end)
            else:
                self.forget()
        return iter(out)

    def _wake_at(self, ms: int) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def take(self, key, due: list[tuple[tuple, tuple]]) -> Iterable[Row]:
        """The results of the released rows ((us, rank, id), value), in order."""
        raise NotImplementedError

    def ends(self) -> int | None:
        """Until when (milliseconds) the state is of use."""
        return None

    def forget(self) -> None:
        """Drops the state."""

    def close(self) -> None:
        pass


class LimitInOrder(InOrder):
    """Sliding-window limit by event time; the state of a caller is its admitted times in the window."""

    def __init__(self, limit: int, window_s: float, id_type: str):
        self.limit, self.window, self.id_type = limit, window_s, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.recent = handle.getListState("recent", "t double")

    def take(self, key, due):
        recent = [t for (t,) in self.recent.get()]
        out = [Row(caller=key[0], call_id=id, allowed=admits(us / 1e6, self.limit, self.window, recent)) for (us, _, id), _ in due]
        self.recent.put([(t,) for t in recent])
        return out

    def ends(self):
        last = max((t for (t,) in self.recent.get()), default=None)
        return None if last is None else int((last + self.window) * 1000) + 1

    def forget(self):
        self.recent.clear()


def answered(body: str | None, status: int | None) -> str | None:
    """What an answer says: its body, nothing forbidden for client errors, everything for server errors."""
    if status is None:
        return None
    return body if 200 <= status <= 299 else "" if 400 <= status <= 499 else "User-agent: *\nDisallow: /"


class CacheInOrder(InOrder):
    """Each request with the latest answer of its host not older than ``seconds``, by event time; answers before requests of the same time."""

    value = "body string, status int"

    def __init__(self, seconds: int, id_type: str):
        self.seconds, self.id_type = seconds, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.answer = handle.getValueState("answer", "us long, body string, status int")

    def take(self, key, due):
        known, out = self.answer.get() if self.answer.exists() else None, []
        for (us, rank, id), (body, status) in due:
            if rank == 0:
                known = (us, body, status)
            else:
                fresh = known is not None and us < known[0] + self.seconds * 1_000_000
                out.append(Row(host=key[0], id=id, body=answered(known[1], known[2]) if fresh else None))
        if known is not None:
            self.answer.update(tuple(known))
        return out

    def ends(self):
        return self.answer.get()[0] // 1000 + self.seconds * 1000 + 1 if self.answer.exists() else None

    def forget(self):
        self.answer.clear()


class CacheOnArrival(StatefulProcessor):
    """Requests get what is cached when they arrive; answers leave the state by their time to live."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answer = handle.getValueState("answer", "body string, status int", ttlDurationMs=max(1, int(self.seconds * 1000)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known, out = self.answer.get() if self.answer.exists() else (None, None), []
        for row in sorted(rows, key=lambda r: (r.us, r.rank, r.id or 0)):
            if row.rank == 0:
                known = (row.body, row.status)
                self.answer.update(known)
            else:
                out.append(Row(host=key[0], id=row.id, body=answered(*known)))
        return iter(out)

    def close(self) -> None:
        pass


def run(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, delay: str | None) -> DataFrame:
    """The stream rows(key, ts, us, ...) through a processor: by event time behind a watermark of ``delay``, or as rows arrive."""
    use_rocksdb(rows.sparkSession)
    if delay is None:
        return rows.groupBy(key).transformWithState(processor, schema, "append", "processingTime")
    return rows.withWatermark("ts", delay).groupBy(key).transformWithState(processor, schema, "append", "eventTime")
