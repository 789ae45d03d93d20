"""Progress of running jobs as a stream with state per job and event-time timers.

Every job has one state: events that the watermark has not passed yet, and what the passed ones add up to. Events pass in order of time, whatever the
order of their arrival, so the stream emits row by row what the batch functions of `progress` compute:

- progress: the bar after each stage event and at completion; it never moves back and stays under 0.95 until then;
- stage: a change of stage and when it began;
- stalled: 45 minutes without an event of the pipeline;
- end: completed or error, once. Whatever a job sends afterwards is dropped.

The state of a job is deleted `LINGER_MS` after its end, or `IDLE_MS` after its last event if it never ends; a timer sees to it. A job holds
the events of the watermark's delay at most, and a few numbers. An end that is sent again after that has no state to meet; `store_ends` drops it, since
the stored ends are the memory, and `replay` gives it to those who join late. Needs the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from colloquy.session import shared_folder, ship_package
from colloquy.streaming.progress import CAP, LATE, NOT_PIPELINE, STALL_MS, TERMINAL, decode

LINGER_MS = 2 * 3_600_000
IDLE_MS = 7 * 24 * 3_600_000
CHANGES = "job_id long, kind string, event_id long, ts_ms long, progress double, stage string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NOW = "bar double, stage string, last_ms long, last_id long, last_type string, told boolean, seen_ms long, end_ms long"
#: Stands for a time that is not known yet.
NEVER = -1


class JobState(StatefulProcessor):
    """State of one job: `pending` events by (ts_ms, event_id), and `now`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "ts_ms long, event_id long", "type string, stage string, fraction double")
        self.now = handle.getValueState("now", _NOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            for ts, event, kind, stage, fraction in zip(frame.ts_ms, frame.event_id, frame.type, frame.stage, frame.fraction, strict=True):
                self.pending.updateValue((int(ts), int(event)), (kind, None if pd.isna(stage) else stage, None if pd.isna(fraction) else float(fraction)))
                first = ts if first is None else min(first, ts)
        if first is not None:
            self.handle.registerTimer(int(first))
        yield pd.DataFrame(columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        state = self.now.get() if self.now.exists() else (None, None, NEVER, NEVER, None, False, NEVER, NEVER)
        bar, stage, last_ms, last_id, last_type, told, seen_ms, end_ms = state
        out = []

        def silent(until: int) -> bool:
            return last_ms != NEVER and not told and end_ms == NEVER and until - last_ms >= STALL_MS

        waiting = None
        for (ts, event), (kind, new_stage, fraction) in sorted(self.pending.iterator(), key=lambda x: tuple(x[0])):
            if ts > passed:
                waiting = ts
                break
            self.pending.removeKey((ts, event))
            if end_ms != NEVER:
                continue
            seen_ms = max(seen_ms, ts)
            if kind not in NOT_PIPELINE:
                if silent(ts):
                    out.append(("stalled", last_id, last_ms, None, None))
                last_ms, last_id, last_type, told = ts, event, kind, False
            if kind == "stage" and new_stage is not None and new_stage != stage:
                stage = new_stage
                out.append(("stage", event, ts, None, stage))
            step = 1.0 if kind == "completed" else min(fraction, CAP) if kind == "stage" and fraction is not None else CAP if kind == "stage" else None
            if step is not None:
                bar = step if bar is None else max(bar, step)
                out.append(("progress", event, ts, bar, None))
            if kind in TERMINAL:
                end_ms = ts
                out.append(("end", event, ts, None, kind))
        if silent(passed):
            out.append(("stalled", last_id, last_ms, None, None))
            told = True
        over = end_ms + LINGER_MS if end_ms != NEVER else seen_ms + IDLE_MS
        if waiting is None and over <= passed:
            self.now.clear()
            self.pending.clear()
        else:
            self.now.update((bar, stage, last_ms, last_id, last_type, told, seen_ms, end_ms))
            stall = last_ms + STALL_MS if last_ms != NEVER and not told and end_ms == NEVER else over
            self.handle.registerTimer(min(t for t in (waiting, stall if stall > passed else None, over if over > passed else None) if t is not None))
        columns = ["kind", "event_id", "ts_ms", "progress", "stage"]
        frame = pd.DataFrame(out, columns=columns)
        frame.insert(0, "job_id", key[0])
        yield frame

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Sets the state store that timers need, for this session's streams."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def job_changes(events: DataFrame, late: str = LATE) -> DataFrame:
    """Stream of (job_id, kind, event_id, ts_ms, progress, stage) from decoded events with a timestamp `ts`; append mode."""
    spark = events.sparkSession
    ship_package(spark)
    rows = events.filter("job_id is not null").select("job_id", "ts", "ts_ms", "event_id", "type", "stage", "fraction").withWatermark("ts", late)
    return rows.groupBy("job_id").transformWithStateInPandas(JobState(), CHANGES, "Append", "EventTime")


def streamed(lines: DataFrame, late: str = LATE) -> DataFrame:
    """The changes of all jobs from progress lines (event_id, job_id, ts_ms, payload), by one run of the stream over them as files."""
    spark = lines.sparkSession
    use_state_store(spark)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    last = lines.agg((F.max("ts_ms") + 2 * IDLE_MS).alias("ts_ms")).filter("ts_ms is not null")
    ahead = last.select(F.lit(NEVER).cast("long").alias("event_id"), F.lit(NEVER).cast("long").alias("job_id"), "ts_ms", F.lit('{"type":"audio_info"}').alias("payload"))
    lines.select("event_id", F.col("job_id").cast("long").alias("job_id"), "ts_ms", "payload").unionByName(ahead).write.parquet(f"{folder}/lines")
    source = spark.readStream.schema("event_id long, job_id long, ts_ms long, payload string").parquet(f"{folder}/lines")
    events = decode(source).withColumn("ts", F.timestamp_millis("ts_ms"))
    run = job_changes(events, late).writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{folder}/changes").filter(F.col("job_id") != NEVER)


def store_ends(changes: DataFrame, path: str, checkpoint: str):
    """Starts a stream that appends the ends to the Parquet table at path, a job's first one only; returns its writer for a trigger."""

    def append(batch: DataFrame, number: int) -> None:
        ends = batch.filter("kind = 'end'").select("job_id", "event_id", "ts_ms", F.col("stage").alias("type"))
        stored = batch.sparkSession.read.schema(ends.schema).parquet(path)
        ends.join(stored.select("job_id"), "job_id", "left_anti").write.mode("append").parquet(path)

    changes.sparkSession.createDataFrame([], "job_id long, event_id long, ts_ms long, type string").write.mode("append").parquet(path)
    return changes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("append")


def replay(joined: DataFrame, ends: DataFrame) -> DataFrame:
    """The end of the job for each one who joined (job_id, joined_ms, ...) at or after it."""
    return joined.join(ends.select("job_id", F.col("ts_ms").alias("end_ms"), "type"), "job_id").filter("joined_ms >= end_ms")
