"""Stateful streams against their batch forms, with shuffled micro-batches and restarts."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siftwork.streaming import limits

START = datetime(2026, 1, 1)


def run_stream(stream, folder, table, rows=None):
    """One run over what is there, or until a table of its own has so many rows."""
    writer = stream.writeStream.format("parquet").option("path", str(folder / table)).option("checkpointLocation", str(folder / f"{table}-state"))
    if rows is None:
        query = writer.trigger(availableNow=True).start()
        assert query.awaitTermination(180)
    else:
        query = writer.trigger(processingTime="1 second").start()
        end = time.time() + 60
        while time.time() < end and not (list((folder / table).glob("part-*")) and stream.sparkSession.read.schema(stream.schema).parquet(str(folder / table)).count() >= rows):
            time.sleep(0.5)
        query.stop()
    assert query.exception() is None


def files_of(frame, folder, parts, numbers):
    """The rows of some parts, a file a part, so each becomes a micro-batch."""
    for k in numbers:
        frame.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(str(folder))


@pytest.mark.parametrize("restarts", [0, 2])
def test_limits_in_any_order(spark, tmp_path, restarts):
    rng = random.Random(restarts)
    calls = [(rng.choice(["a", "a", "a", "b", "c"]), i, START + timedelta(seconds=rng.randrange(0, 300), microseconds=rng.randrange(3) * 500_000)) for i in range(240)]
    last = ("z", 10_000, START + timedelta(hours=2))
    rows = [(*c, rng.randrange(5)) for c in calls] + [(*last, 5), ("z", 10_001, START + timedelta(hours=3), 6)]
    frame = spark.createDataFrame(rows, "caller string, call_id long, ts timestamp, part int")
    batch = {r.call_id: r.allowed for r in limits.rate_limited(frame.drop("part"), 3, 20).collect()}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    steps = [range(7)] if not restarts else [[0, 1], [2, 3], [4, 5, 6]]
    for some in steps:
        files_of(frame, tmp_path / "in", 7, some)
        run_stream(limits.stream_rate_limited(stream, 3, 20, delay="10 minutes"), tmp_path, "out")
    got = [(r.call_id, r.allowed) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert len(got) == len(dict(got))
    assert {i: a for i, a in got if i < 10_000} == {i: a for i, a in batch.items() if i < 10_000}
    assert not all(dict(got).values())


def test_cache_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    at = lambda: START + timedelta(seconds=rng.randrange(0, 9000))
    answers = [(rng.choice("gh"), t, f"body {i}", rng.choice([200, 200, 404, 503])) for i, t in enumerate(sorted({at() for _ in range(14)}))]
    requests = [(rng.choice("gh"), at(), i) for i in range(120)]
    events = [(h, t, None, b, s) for h, t, b, s in answers] + [(h, t, i, None, None) for h, t, i in requests]
    rng.shuffle(events)
    events = [(*e, k % 4) for k, e in enumerate(events)] + [("z", START + timedelta(days=1 + k), 9000 + k, None, None, 4 + k) for k in range(2)]
    frame = spark.createDataFrame(events, "host string, ts timestamp, id long, body string, status int, part int")
    expected = limits.cached(frame.where("status is not null").select("host", "ts", "body", "status"), frame.where("id < 9000").select("host", "ts", "id"))
    expected = {r.id: r.body for r in expected.collect()}
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(frame.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for some in ([0, 1, 2], [3, 4, 5]):
        files_of(frame, tmp_path / "in", 6, some)
        run_stream(limits.stream_cached(stream, 3600, delay="3 hours"), tmp_path, "out")
    got = [(r.id, r.body) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.id < 9000]
    assert len(got) == len(expected) == 120 and dict(got) == expected
    assert len(set(expected.values())) > 4 and None in expected.values()


def test_cache_on_arrival_forgets(spark, tmp_path):
    """An answer serves requests until its time to live is over, also after a restart."""
    schema = "host string, ts timestamp, id long, body string, status int, part int"
    now = lambda k, *rest: ("h", START + timedelta(seconds=k), *rest)
    frame = spark.createDataFrame([now(0, None, "text", 200, 0), now(1, 1, None, None, 0), now(2, 2, None, None, 1), now(3, 3, None, None, 2)], schema)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(frame.drop("part").schema).parquet(str(tmp_path / "in"))
    for part, pause in ((0, 0), (1, 0), (2, 26)):
        if pause:
            time.sleep(max(0, pause - (time.time() - began)))
        files_of(frame, tmp_path / "in", 3, [part])
        run_stream(limits.stream_cached(stream, 25), tmp_path, "out", rows=part + 1)
        if part == 0:
            began = time.time()
    got = {r.id: r.body for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "text", 2: "text", 3: None}
