"""Sliding-window limits and drains with Structured Streaming, and their batch forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .stateful import CacheInOrder, CacheOnArrival, LimitInOrder, admits, run


def admitted(times: list[float], limit: int, window: float, recent: list[float]) -> list[bool]:
    """Whether each call, in order, has fewer than ``limit`` admitted calls in the window before it; refused calls do not count."""
    return [admits(t, limit, window, recent) for t in times]


def rate_limited(calls: DataFrame, limit: int, window_s: float) -> DataFrame:
    """calls(caller, call_id, ts) with allowed, in batch.

    A caller is scanned in time order with at most ``limit`` times in memory: rows arrive sorted and stream through, so no caller is
    collected whole.
    """
    rows = calls.select("caller", "call_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).repartition("caller").sortWithinPartitions("caller", "us", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller, recent = None, []
        for b in batches:
            allowed = []
            for c, us in zip(b["caller"], b["us"], strict=True):
                if c != caller:
                    caller, recent = c, []
                allowed += admitted([us / 1e6], limit, window_s, recent)
            yield pd.DataFrame({"caller": b["caller"], "call_id": b["call_id"], "allowed": allowed})

    kind = calls.schema["caller"].dataType.simpleString()
    return rows.mapInPandas(run, f"caller {kind}, call_id {calls.schema['call_id'].dataType.simpleString()}, allowed boolean")


def stream_rate_limited(calls: DataFrame, limit: int, window_s: float, delay: str | None = None) -> DataFrame:
    """The same on a stream of calls(caller, call_id, ts); the state of a caller is its admitted times in the window.

    With ``delay`` calls may come in any order within it: each is decided once the watermark has passed it, so the rows are those of
    ``rate_limited`` however calls are dealt to micro-batches.  Without it calls (caller string, call_id long)
    are decided as they arrive.
    """
    if delay is not None:
        kinds = {c: calls.schema[c].dataType.simpleString() for c in ("caller", "call_id")}
        rows = calls.select("caller", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.lit(0).alias("rank"), F.col("call_id").alias("id"))
        return run(rows, "caller", LimitInOrder(limit, window_s, kinds["call_id"]), f"caller {kinds['caller']}, call_id {kinds['call_id']}, allowed boolean", delay)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        b = pd.concat(list(frames)).sort_values(["ts", "call_id"])
        times = (b["ts"].astype("int64") / 1e9 if str(b["ts"].dtype).startswith("datetime64[ns") else b["ts"].map(lambda t: t.timestamp())).tolist()
        allowed = admitted(times, limit, window_s, recent)
        state.update((recent,))
        state.setTimeoutDuration(int(window_s * 1000))
        yield pd.DataFrame({"caller": key[0], "call_id": b["call_id"], "allowed": allowed})

    return calls.groupBy("caller").applyInPandasWithState(step, "caller string, call_id long, allowed boolean", "recent array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def drain(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str):
    """Each micro-batch of an inbox goes to ``upsert`` once; with an idempotent upsert the whole is exactly-once."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cached(answers: DataFrame, requests: DataFrame, seconds: int = 3600) -> DataFrame:
    """requests(host, ts) with the latest of answers(host, ts, body, status) not older than ``seconds``; client errors allow all, server errors nothing."""
    spans = answers.withColumn("until", F.least(F.lead("ts").over(Window.partitionBy("host").orderBy("ts")), F.col("ts") + F.make_dt_interval(secs=F.lit(seconds))))
    spans = spans.withColumn("until", F.coalesce("until", F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)))).withColumnRenamed("ts", "since")
    joined = requests.join(spans, (requests["host"] == spans["host"]) & (requests["ts"] >= spans["since"]) & (requests["ts"] < spans["until"]), "left").drop(spans["host"])
    body = F.when(F.col("status").between(200, 299), F.col("body")).when(F.col("status").between(400, 499), "").when(F.col("status").isNotNull(), "User-agent: *\nDisallow: /")
    return joined.select(*requests.columns, body.alias("body"))


def stream_cached(events: DataFrame, seconds: int = 3600, delay: str | None = None) -> DataFrame:
    """host, id, body for the requests in a stream of events(host, ts, id, body, status): answers have a status, requests an id.

    With ``delay`` the rows are those of ``cached`` whatever the order of arrival; without it a request gets what is
    cached when it comes, and Spark goes on with empty micro-batches to end answers in time, so such a query runs until it is stopped.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in ("host", "id")}
    rank = F.when(F.col("status").isNull(), 1).otherwise(0)
    rows = events.select("host", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), rank.alias("rank"), "id", "body", F.col("status").cast("int").alias("status"))
    processor = CacheOnArrival(seconds) if delay is None else CacheInOrder(seconds, kinds["id"])
    return run(rows, "host", processor, f"host {kinds['host']}, id {kinds['id']}, body string", delay)


def first_of_session(events: DataFrame, key: list[str]) -> DataFrame:
    """On a stream: each key once, as far back as its watermark; in batch: each key once."""
    return events.dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def new_since(rows: DataFrame, previous_run: str) -> DataFrame:
    """rows(first_seen) with is_new: first seen after the previous run."""
    return rows.withColumn("is_new", F.col("first_seen") > F.lit(previous_run).cast("timestamp"))
