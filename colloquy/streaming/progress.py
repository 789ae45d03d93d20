"""Progress events of running jobs, in batches and as streams.

Functions taking `events` work on both kinds of DataFrame unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import exact_mean
from colloquy.operators.ops import in_time
from colloquy.operators.ordered import following, previous, running_max, running_sum, scan

PAYLOAD = (
    "type string, stage string, fraction double, message string, current int, total int, "
    "cpu_pct double, ram_gb double, audio_duration double"
)
# Event types, stage labels and weights of the event protocol. Fixed values.
TYPES = (
    "stage", "audio_info", "resource", "pipeline_decision", "chunk_progress", "partial_transcript", "completed", "error",
)
TERMINAL = ("completed", "error")
NOT_PIPELINE = ("resource",)
# Labels of the protocol's messages.
LABELS = {
    "Preprocessing audio": "Preprocessing Audio", "Audio ready": "Preprocessing Audio",
    "Loading Whisper model": "Loading Model", "Loading Parakeet model": "Loading Model",
    "Aligning timestamps": "Aligning Words", "Transcription complete": "Transcribing",
    "Finalizing speaker attribution": "Processing", "Loading diarization model": "Loading Diarization",
    "Running speaker diarization": "Speaker Diarization", "Diarization complete": "Speaker Diarization",
    "Merging speakers and words": "Processing", "Running processors": "Processing", "Done": "Generating Files",
}
# Label of a message that is not listed above, by fragments of its lower-case text: all of the first and, if
# there are any, one of the second. The first line that fits decides. The order has a quirk that results depend on: messages about
# loading a diarization model name a model, so "Loading Diarization" only labels those that load without saying "model".
LABEL_RULES = (
    ((), ("audio", "preprocess"), "Preprocessing Audio"),
    (("load",), ("model", "whisper", "parakeet"), "Loading Model"),
    (("diariz", "load"), (), "Loading Diarization"),
    (("transcrib",), (), "Transcribing"),
    (("align",), (), "Aligning Words"),
    ((), ("speaker attribution", "finaliz"), "Processing"),
    ((), ("diariz", "speaker"), "Speaker Diarization"),
    (("merg",), (), "Processing"),
    ((), ("process", "vocab", "clean", "correct"), "Processing"),
    ((), ("export", "done"), "Generating Files"),
)
WEIGHTS = {
    "preprocess": (0.00, 0.05), "transcribe": (0.05, 0.62), "diarize": (0.62, 0.88),
    "merge": (0.88, 0.92), "process": (0.92, 0.97), "export_prep": (0.97, 1.00),
}
CAP = 0.95
STALL_MS = 45 * 60_000
LATE = "2 hours"


def decode(lines: DataFrame) -> DataFrame:
    """Events of known type from (job_id, event_id, ts_ms, payload); malformed lines are skipped."""
    parsed = lines.withColumn("_e", F.from_json("payload", PAYLOAD))
    return parsed.select(*[c for c in lines.columns if c != "payload"], "_e.*").filter(F.col("type").isin(*TYPES))


def stage_label(message: Column) -> Column:
    low = F.lower(message)
    label = F.lit("Processing")
    for every, some, name in reversed(LABEL_RULES):
        hit = F.lit(True)
        for w in every:
            hit = hit & low.contains(w)
        if some:
            any_of = F.lit(False)
            for w in some:
                any_of = any_of | low.contains(w)
            hit = hit & any_of
        label = F.when(hit, name).otherwise(label)
    exact = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(exact, message), label)


def chunk_progress(message: Column) -> Column:
    """(current, total) from "chunk N/M", null without it."""
    pattern = r"(?i)chunk\s+(\d+)/(\d+)"
    return F.when(
        message.rlike(pattern),
        F.struct(
            F.regexp_extract(message, pattern, 1).cast("int").alias("current"),
            F.regexp_extract(message, pattern, 2).cast("int").alias("total"),
        ),
    )


def overall_fraction(stage: Column, fraction: Column) -> Column:
    """Progress of the whole job from the progress inside a stage; unknown stages span all of it."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for name, (a, b) in WEIGHTS.items():
        lo = F.when(stage == name, F.lit(a)).otherwise(lo)
        hi = F.when(stage == name, F.lit(b)).otherwise(hi)
    return lo + (hi - lo) * fraction


def monotone_progress(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Batch: the bar after each stage event; it never moves back and stays under 0.95 until the end."""
    bar = F.when(F.col("type") == "completed", 1.0).when(F.col("type") == "stage", F.least(F.col("fraction"), F.lit(CAP)))
    seen = scan(*in_time(events.withColumn("_bar", bar).select("job_id", "event_id", "ts_ms", "_bar"), ranges), progress=running_max(F.col("_bar")))
    return seen.filter("_bar is not null").select("job_id", "event_id", "ts_ms", "progress")


def live_progress(events: DataFrame) -> DataFrame:
    """Stream or batch: present bar of each job. A plain maximum per job, combined before the shuffle."""
    bar = F.when(F.col("type") == "completed", 1.0).when(F.col("type") == "stage", F.least(F.col("fraction"), F.lit(CAP)))
    return events.groupBy("job_id").agg(F.max(bar).alias("progress"))


def stalls(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Batch: silences of 45 minutes after an event that did not end the job, up to the last event seen."""
    own = events.filter(~F.col("type").isin(*NOT_PIPELINE))
    until = events.agg(F.max("ts_ms")).scalar()
    nexts = scan(*in_time(own.select("job_id", "ts_ms", "event_id", "type"), ranges), next_ms=following(F.col("ts_ms")))
    idle = F.coalesce(F.col("next_ms"), until) - F.col("ts_ms")
    return nexts.filter((idle >= STALL_MS) & ~F.col("type").isin(*TERMINAL)).select(
        "job_id", "event_id", "ts_ms", (F.col("ts_ms") + STALL_MS).alias("stalled_ms")
    )


def stalls_stream(events: DataFrame) -> DataFrame:
    """Stream: the same silences as sessions that closed without an end; needs a `ts` timestamp.

    A session is reported when the watermark passes its end, so events of other jobs drive it.
    """
    own = events.filter(~F.col("type").isin(*NOT_PIPELINE)).withWatermark("ts", LATE)
    closed = own.groupBy("job_id", F.session_window("ts", "45 minutes").alias("s")).agg(
        F.max_by("type", F.struct("ts_ms", "event_id")).alias("last_type"), F.max("ts_ms").alias("ts_ms"),
    )
    return closed.filter(~F.col("last_type").isin(*TERMINAL)).select("job_id", "ts_ms", (F.col("ts_ms") + STALL_MS).alias("stalled_ms"))


def terminal_events(events: DataFrame) -> DataFrame:
    """Batch: the event that ended each job; later ones are repeats."""
    ends = events.filter(F.col("type").isin(*TERMINAL))
    return ends.groupBy("job_id").agg(F.min(F.struct("ts_ms", "event_id", "type", "message")).alias("e")).select("job_id", "e.*")


def terminal_stream(events: DataFrame) -> DataFrame:
    """Stream: one terminal event per job, repeats inside the watermark dropped."""
    return events.filter(F.col("type").isin(*TERMINAL)).withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["job_id"])


def stage_changes(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Batch: events at which the stage of a job changed."""
    staged = events.filter((F.col("type") == "stage") & F.col("stage").isNotNull()).select("job_id", "ts_ms", "event_id", "stage")
    seen = scan(*in_time(staged, ranges), _prev=previous(F.col("stage")))
    return seen.filter(~F.col("_prev").eqNullSafe(F.col("stage"))).drop("_prev")


def current_stages(events: DataFrame) -> DataFrame:
    """Stream or batch: latest stage of each job."""
    staged = events.filter((F.col("type") == "stage") & F.col("stage").isNotNull())
    return staged.groupBy("job_id").agg(F.max_by("stage", F.struct("ts_ms", "event_id")).alias("stage"))


def live_view(events: DataFrame) -> DataFrame:
    """Batch: current stage of each job and when it began."""
    last = stage_changes(events).groupBy("job_id").agg(F.max(F.struct("ts_ms", "event_id", "stage")).alias("c"))
    return last.select("job_id", "c.stage", F.col("c.ts_ms").alias("since_ms"))


def resource_windows(events: DataFrame, width: str = "10 seconds", streaming: bool = False) -> DataFrame:
    """Average load per job and window; in a stream, later resource events of any job close a window."""
    own = events.filter(F.col("type") == "resource")
    if streaming:
        own = own.withWatermark("ts", LATE)
    return own.groupBy("job_id", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), F.round(exact_mean(F.col("cpu_pct")), 3).alias("cpu_pct"), F.round(exact_mean(F.col("ram_gb")), 3).alias("ram_gb")
    ).select("job_id", F.unix_millis(F.col("w.start")).alias("start_ms"), "n", "cpu_pct", "ram_gb")


def sampled_resources(events: DataFrame, every: int = 1, ranges: int | None = None) -> DataFrame:
    """Batch: the resource events of each job with their number; every=2 keeps the second ones only, as a report of half the length."""
    own = events.filter(F.col("type") == "resource").select("job_id", "ts_ms", "event_id", "cpu_pct", "ram_gb")
    return scan(*in_time(own, ranges), nth=running_sum(F.lit(1))).filter(F.col("nth") % every == 0)


def expired(files: DataFrame, now_ms: Column, output_h: int = 24, temp_h: int = 26) -> DataFrame:
    """Files (kind output or temp, modified_ms) past their retention."""
    limit = F.when(F.col("kind") == "output", output_h).otherwise(temp_h) * 3_600_000
    return files.filter(F.col("modified_ms") < now_ms - limit)
