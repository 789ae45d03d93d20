"""The stream with state per job against the batch functions, event by event."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from colloquy.streaming import job_state as js
from colloquy.streaming import progress as pg

HOUR = 3_600_000
LINES = "event_id long, job_id long, ts_ms long, payload string"


def lines():
    """Four jobs, shuffled inside two hours; job 0 ends and sends more, job 1 falls silent, then events far ahead of another job."""
    rng = random.Random(1)
    early, late, rows = [], [], []
    for job in range(4):
        for n in range(14):
            ts = 10 * HOUR + n * 400_000 + (50 * 60_000 if n > 7 and job == 1 else 0)
            kind = "completed" if n == 9 and job == 0 else "resource" if n % 3 == 1 else "stage"
            body = {"type": kind, "stage": f"s{n // 4}", "fraction": ((n * 7) % 10) / 10}
            (early if n < 7 else late).append((job * 100 + n, job, ts, json.dumps(body)))
    late.append((950, 0, 10 * HOUR + 9 * 400_000 + 1, json.dumps({"type": "error"})))
    rng.shuffle(early)
    rng.shuffle(late)
    for i, hours in enumerate((400, 800, 801)):
        rows.append((900 + i, 9, hours * HOUR, json.dumps({"type": "stage", "stage": "z", "fraction": 0.1})))
    return [early, late, rows[:1], rows[1:2], rows[2:]]


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("job_state")
    js.use_state_store(spark)
    for part in lines():
        spark.createDataFrame(part, LINES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    changes = js.job_changes(pg.decode(source).withColumn("ts", F.timestamp_millis("ts_ms")))
    query = changes.writeStream.format("memory").queryName("changes").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table("changes"), query.lastProgress, changes, folder


def test_stream_equals_batch_by_event(spark, ran):
    got = {(r.job_id, r.kind, r.event_id, r.ts_ms, r.progress, r.stage) for r in ran[0].collect()}
    batch = pg.decode(spark.createDataFrame([r for part in lines() for r in part], LINES))
    ends = {r.job_id: r for r in pg.terminal_events(batch).collect()}

    def live(r):
        return r.job_id not in ends or (r.ts_ms, r.event_id) <= (ends[r.job_id].ts_ms, ends[r.job_id].event_id)

    want = {(r.job_id, "progress", r.event_id, r.ts_ms, r.progress, None) for r in pg.monotone_progress(batch).collect() if live(r)}
    want |= {(r.job_id, "stage", r.event_id, r.ts_ms, None, r.stage) for r in pg.stage_changes(batch).collect() if live(r)}
    want |= {(r.job_id, "stalled", r.event_id, r.ts_ms, None, None) for r in pg.stalls(batch).collect() if live(r)}
    want |= {(r.job_id, "end", r.event_id, r.ts_ms, None, r.type) for r in ends.values()}
    # The watermark has not passed the last two events.
    assert got == {w for w in want if w[3] < 799 * HOUR}
    assert {k for _, k, *_ in got} == {"progress", "stage", "stalled", "end"} and (1, "stalled", 106) in {g[:3] for g in got}


def test_state_ends(ran):
    # Only job 9 is left: its two pending events and what they add up to.
    assert ran[1]["stateOperators"][0]["numRowsTotal"] <= 3


def test_stored_ends_and_replay(spark, ran):
    _, _, changes, folder = ran
    path = f"{folder}/ends"
    query = js.store_ends(changes, path, f"{folder}/ends_state").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    ends = spark.read.parquet(path)
    assert [(r.job_id, r.event_id, r.type) for r in ends.collect()] == [(0, 9, "completed")]
    joined = spark.createDataFrame([(0, 1), (0, 99 * HOUR), (1, 99 * HOUR)], "job_id long, joined_ms long")
    assert [(r.job_id, r.joined_ms, r.type) for r in js.replay(joined, ends).collect()] == [(0, 99 * HOUR, "completed")]
