"""Operations on job tables: visibility, rollups, stages, resources, artifacts, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numbers import exact_mean
from colloquy.operators.ordered import Axis, equal_ranges, following, scan

# Accepted upload types and artifact names of a finished job. Fixed values.
SUFFIXES = (".aac", ".mp3", ".wav", ".m4a", ".flac", ".mp4", ".mov", ".ogg")
# Largest upload, names of the artifacts, modes and formats of a request.
MOST_MB = 2_000
ARTIFACTS = (
    "transcript.md transcript.json transcript.txt transcript.srt transcript.vtt transcript.stats.json "
    "transcript.quality.md transcript.summary.md transcript.action_items.md transcript.decisions.md "
    "transcript.questions.md transcript.timeline.md transcript.entities.json transcript.metrics.json "
    "transcript.review.md transcript.index.json transcript_bundle.zip"
).split()
MODES = ("accurate", "balanced", "fast")
FORMATS = ("docx", "json", "md", "srt", "txt", "vtt")

# Ordered failure classes: any of the alternatives, each a set of words that must all occur. Fixed words.
FAILURES = (
    ("access_token", (("huggingface",), ("hf_token",), ("token", "model"))),
    ("token_rejected", (("401",), ("unauthorized",))),
    ("licence_missing", (("403",), ("forbidden",), ("license",), ("gated",))),
    ("device", (("cuda", "device"),)),
    ("decoder_missing", (("ffmpeg",),)),
    ("file_missing", (("no such file or directory",),)),
    ("network", (("connectionerror",), ("networkerror",), ("timeout",))),
    ("permission", (("permission",), ("errno 13",))),
    ("memory", (("out of memory",), ("oom",))),
    ("no_speech", (("index out of range",),)),
)


def in_time(events: DataFrame, ranges: int | None = None) -> tuple[DataFrame, Axis]:
    """Events of each job in order of time, in ranges of about equal numbers of events."""
    return equal_ranges(events, ("job_id",), ("ts_ms", "event_id"), ranges)


def validate_uploads(manifest: DataFrame) -> DataFrame:
    """Check (upload_id, file_name, size_mb): accepted or the reason why not, and a safe name."""
    suffix = F.lower(F.regexp_extract("file_name", r"(\.[^./]+)$", 1))
    stem = F.regexp_replace(F.regexp_extract("file_name", r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    clean = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N} _-]", "_"), r"^_+|_+$", "")
    reason = F.when(~suffix.isin(*SUFFIXES), "type").when(F.col("size_mb") > MOST_MB, "size")
    return manifest.select(
        "upload_id", reason.isNull().alias("accepted"), reason.alias("reason"),
        F.when(clean == "", "recording").otherwise(clean).alias("safe_name"), suffix.alias("suffix"),
    )


def valid_request(mode: Column, profile: Column, fmt: Column) -> Column:
    return mode.isin(*MODES) & profile.rlike(r"^[a-zA-Z0-9_-]{1,100}$") & fmt.isin(*FORMATS)


def access(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Answer to (request_id, job_id, user_id): ok, forbidden, or not_found for absent and deleted jobs."""
    owned = jobs.filter("deleted_ms is null").select("job_id", "owner_id")
    verdict = (
        F.when(F.col("owner_id").isNull(), "not_found").when(F.col("owner_id") != F.col("user_id"), "forbidden").otherwise("ok")
    )
    return requests.join(owned, "job_id", "left").select("request_id", "job_id", verdict.alias("verdict"))


def tombstone(jobs: DataFrame, deletions: DataFrame) -> DataFrame:
    """Mark jobs deleted at their first deletion; their audio key goes. Unknown jobs do nothing."""
    first = deletions.groupBy("job_id").agg(F.min("at_ms").alias("at_ms"))
    return jobs.join(first, "job_id", "left").select(
        "job_id", "owner_id", F.coalesce("deleted_ms", "at_ms").alias("deleted_ms"),
        F.when(F.coalesce("deleted_ms", "at_ms").isNull(), F.col("audio_key")).alias("audio_key"),
    )


def job_rollup(events: DataFrame) -> DataFrame:
    """State of each job: the latest event wins."""
    return events.groupBy("job_id").agg(
        F.max_by("kind", F.struct("ts_ms", "event_id")).alias("status"), F.max("ts_ms").alias("last_ms"),
        F.min("ts_ms").alias("first_ms"), F.count("*").alias("n_events"), F.count_if(F.col("kind") == "error").alias("n_errors"),
    )


def failure_class(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(None).cast("string")
    for name, alternatives in reversed(FAILURES):
        hit = F.lit(False)
        for words in alternatives:
            every = F.lit(True)
            for w in words:
                every = every & low.contains(w)
            hit = hit | every
        out = F.when(hit, name).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def artifact_report(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Expected artifacts of every job with status and size."""
    sizes = listing.groupBy("job_id", "artifact").agg(F.max("size_bytes").alias("size_bytes"))
    expected = jobs.select("job_id", F.explode(F.array(*[F.lit(a) for a in ARTIFACTS])).alias("artifact"))
    return expected.join(sizes, ["job_id", "artifact"], "left").withColumn(
        "status", F.when(F.col("size_bytes").isNull(), "missing").otherwise("ok")
    )


def artifact_totals(jobs: DataFrame, listing: DataFrame) -> DataFrame:
    """Present and missing artifacts per job; a job has at most as many as there are expected names."""
    present = listing.filter(F.col("artifact").isin(*ARTIFACTS)).groupBy("job_id", "artifact").agg(
        F.max("size_bytes").alias("size_bytes")
    ).groupBy("job_id").agg(F.collect_set("artifact").alias("have"), F.sum("size_bytes").alias("total_bytes"))
    expected = F.array(*[F.lit(a) for a in sorted(ARTIFACTS)])
    have = F.coalesce("have", F.array().cast("array<string>"))
    return jobs.join(present, "job_id", "left").select(
        "job_id", F.lit(len(ARTIFACTS)).cast("long").alias("n_expected"), F.size(have).cast("long").alias("n_present"),
        F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"), F.array_join(F.array_except(expected, have), ",").alias("missing"),
    )


def stage_report(transitions: DataFrame, ranges: int | None = None) -> DataFrame:
    """Time per stage from stage changes (job_id, ts_ms, event_id, stage); the last change only closes.

    Stages entered again add up and keep their first start.
    """
    timed = scan(*in_time(transitions, ranges), until=following(F.col("ts_ms")))
    begun = transitions.groupBy("job_id").agg(F.min("ts_ms").alias("t0"), F.max("ts_ms").alias("t1"))
    spans = timed.filter("until is not null").groupBy("job_id", "stage").agg(
        F.min("ts_ms").alias("first"), F.sum(F.col("until") - F.col("ts_ms")).alias("duration_ms")
    )
    total = F.col("t1") - F.col("t0")
    return spans.join(begun, "job_id").select(
        "job_id", "stage", (F.col("first") - F.col("t0")).alias("start_ms"), "duration_ms",
        F.when(total > 0, F.round(100 * F.col("duration_ms") / total, 1)).otherwise(0.0).alias("pct"),
    )


def resource_summary(samples: DataFrame) -> DataFrame:
    parts = []
    for m in ("cpu_pct", "ram_gb", "swap_gb"):
        parts += [F.max(m).alias(f"peak_{m}"), F.round(exact_mean(F.col(m)), 3).alias(f"mean_{m}")]
    return samples.groupBy("job_id").agg(*parts)


def word_loss(counts: DataFrame, keep: float = 0.95) -> DataFrame:
    """Stage counts (job_id, stage_no, stage, n_words) with the count before and a loss flag.

    A job has a handful of stages, so the window holds a handful of rows.
    """
    before = F.lag("n_words").over(Window.partitionBy("job_id").orderBy("stage_no"))
    return counts.withColumn("n_before", before).withColumn(
        "lost", F.coalesce(F.col("n_words") < F.col("n_before") * keep, F.lit(False))
    )


def empty_output(recordings: DataFrame, words: DataFrame) -> DataFrame:
    """Recordings over 30 s without a single word count as failed."""
    n = words.groupBy("job_id").agg(F.count("*").alias("n_words"))
    return recordings.join(n, "job_id", "left").select(
        "job_id", F.coalesce("n_words", F.lit(0)).alias("n_words"),
        F.when(F.col("n_words").isNull() & (F.col("duration_ms") > 30_000), "failed").otherwise("completed").alias("status"),
    )


def real_time_factor(recordings: DataFrame, runs: DataFrame) -> DataFrame:
    spent = runs.groupBy("job_id").agg(F.sum("duration_s").alias("elapsed_s"))
    e = F.coalesce("elapsed_s", F.lit(0.0))
    return recordings.join(spent, "job_id", "left").select(
        "job_id", F.round(F.when(e > 0, F.col("duration_ms") / 1000.0 / e).otherwise(0.0), 6).alias("rtf")
    )


def _group_of(stage: Column) -> Column:
    return F.when(stage.startswith("proc_"), "processors").when(stage.startswith("intel_"), "intelligence").otherwise(stage)


def profile_report(runs: DataFrame) -> DataFrame:
    """Seconds and share per stage group, with the stages inside the groups.

    Recognition and diarization run side by side, so the longer of them counts towards the total.
    """
    stages = runs.groupBy("job_id", "stage").agg(F.sum("duration_s").alias("s"))
    side = F.col("stage").isin("transcribe", "diarize")
    wall = stages.groupBy("job_id").agg(
        (F.coalesce(F.sum(F.when(~side, F.col("s"))), F.lit(0.0)) + F.coalesce(F.max(F.when(side, F.col("s"))), F.lit(0.0))).alias("total_s")
    )
    groups = stages.groupBy("job_id", _group_of(F.col("stage")).alias("name")).agg(F.sum("s").alias("s"))
    inside = stages.filter(_group_of(F.col("stage")) != F.col("stage")).select("job_id", F.col("stage").alias("name"), "s")
    rows = groups.withColumn("level", F.lit("group")).unionByName(inside.withColumn("level", F.lit("detail")))
    return rows.join(wall, "job_id").select(
        "job_id", "level", "name", "s", "total_s", F.round(100 * F.col("s") / F.col("total_s"), 1).alias("pct")
    )


def bottlenecks(runs: DataFrame, n: int = 5) -> DataFrame:
    """The n slowest stages of each job."""
    stages = runs.groupBy("job_id", "stage").agg(F.sum("duration_s").alias("s"))
    order = Window.partitionBy("job_id").orderBy(F.desc("s"), "stage")
    return stages.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def word_rate(counts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Words per minute of each stage count, and whether people speak that fast."""
    rate = F.col("n_words") * 60_000 / F.col("duration_ms")
    verdict = F.when(rate < 100, "low").when(rate > 200, "high").otherwise("normal")
    return counts.join(jobs.select("job_id", "duration_ms"), "job_id").select(
        "job_id", "stage", "n_words", F.round(rate, 2).alias("words_per_minute"), verdict.alias("verdict")
    )


def slowdowns(runs: DataFrame, recordings: DataFrame) -> DataFrame:
    """Share of the recording a stage takes alone, and how much longer beside others."""
    by = runs.groupBy("job_id", "stage").agg(
        F.sum(F.when(F.col("variant") == "alone", F.col("duration_s"))).alias("alone_s"),
        F.sum(F.when(F.col("variant") == "beside", F.col("duration_s"))).alias("beside_s"),
    )
    share = F.col("alone_s") * 1000 / F.col("duration_ms")
    ratio = F.col("beside_s") / F.col("alone_s")
    return by.join(recordings, "job_id").select(
        "job_id", "stage", F.round(share, 4).alias("share"), F.coalesce(share > 0.10, F.lit(False)).alias("slow"),
        F.round(ratio, 4).alias("ratio"), F.coalesce(ratio > 1.5, F.lit(False)).alias("contended"),
    )
