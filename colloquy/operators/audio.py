"""Signals measured on recordings and the decisions taken from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numbers import decimal_mean

SPEECH_RATIO = 0.15
WINDOW_S, MOST_WINDOWS = 60, 4
ONE_SPEAKER, TWO_SPEAKERS = 0.30, 0.60
SKIP_FROM, SKIP_SAVES_S, LONG_S = 0.85, 540, 600


def energy_profile(frames: DataFrame, first_frames: int | None = 600) -> DataFrame:
    """Share of speech and silence and the signal-to-noise ratio of the first minute of 0.1 s frames, or of all frames (None).

    Means are exact: a frame may lie on the threshold, and sums of doubles in another order would put it on the other side.
    """
    heard = frames if first_frames is None else frames.filter(F.col("frame_idx") < first_frames)
    mean = heard.groupBy("job_id").agg((decimal_mean(F.col("rms")) * SPEECH_RATIO).alias("threshold"))
    speech = F.col("rms") > F.col("threshold")
    rows = heard.join(mean, "job_id").groupBy("job_id").agg(
        F.count("*").alias("n"), F.count_if(speech).alias("n_speech"),
        decimal_mean(F.when(speech, F.col("rms"))).alias("loud"), decimal_mean(F.when(~speech, F.col("rms"))).alias("quiet"),
    )
    ratio = F.col("n_speech") / F.col("n")
    snr = (
        F.when(F.col("loud").isNull() | F.col("quiet").isNull(), 20.0)
        .when(F.col("quiet") <= 0, 40.0)
        .otherwise(20 * F.log10(F.col("loud") / F.col("quiet")))
    )
    return rows.select("job_id", ratio.alias("speech_ratio"), (1 - ratio).alias("silence_ratio"), snr.alias("snr_db"))


def with_energy_defaults(jobs: DataFrame, profile: DataFrame) -> DataFrame:
    """Meetings without frames count as half speech."""
    return jobs.join(profile, "job_id", "left").fillna({"speech_ratio": 0.5, "silence_ratio": 0.5, "snr_db": 0.0})


def sample_offsets(jobs: DataFrame) -> DataFrame:
    """Starts of the minutes to look at: one for a short recording, else two to four, evenly spread."""
    d = F.col("duration_ms")
    n = F.least(F.lit(MOST_WINDOWS), F.greatest(F.lit(2), F.floor(d / (WINDOW_S * 1000))))
    last = d - WINDOW_S * 1000
    spread = F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")), lambda i: F.floor(i * last / (n - 1))))
    offsets = F.when(d <= WINDOW_S * 1000, F.array(F.lit(0).cast("long"))).otherwise(spread)
    return jobs.select("job_id", F.posexplode(offsets).alias("window_idx", "offset_ms"))


def estimate_speakers(jobs: DataFrame, windows: DataFrame) -> DataFrame:
    """Speaker count and how far to trust it, from the spread of each sampled window (`std`)."""
    count = F.when(F.col("std") < ONE_SPEAKER, 1).when(F.col("std") < TWO_SPEAKERS, 2).otherwise(3)
    seen = windows.withColumn("c", count).groupBy("job_id").agg(
        F.max("c").alias("speakers"), F.min("c").alias("least"), F.count("*").alias("n_windows"), F.max("std").alias("spread")
    )
    d = F.col("duration_ms") / 1000.0
    coverage = F.when(d > 0, F.least(F.lit(1.0), F.col("n_windows") * WINDOW_S / d)).otherwise(0.0)
    few = (d < 120) | (F.coalesce("n_windows", F.lit(0)) < 2)
    trust = (
        F.when(few, 0.5).when(F.col("least") == F.col("speakers"), F.round(F.least(F.lit(0.95), 0.55 + 0.45 * coverage), 3)).otherwise(0.4)
    )
    return jobs.join(seen, "job_id", "left").select(
        "job_id", "duration_ms", F.coalesce("speakers", F.lit(2)).alias("speakers"), F.coalesce("spread", F.lit(0.0)).alias("spread"), trust.alias("trust")
    )


def decide(estimates: DataFrame) -> DataFrame:
    """Which expensive steps to skip, why, and the seconds this saves."""
    s = F.col("duration_ms") / 1000.0
    one = (F.col("speakers") == 1) & (F.col("trust") >= SKIP_FROM)
    long = s >= LONG_S
    saved = F.when(one, SKIP_SAVES_S).otherwise(0) + F.when(long, F.bround(s * 0.08)).otherwise(0)
    reasons = F.array_compact(F.array(
        F.when(one, "one speaker, no diarization").otherwise(F.concat(F.lit("diarization for "), F.col("speakers").cast("string"), F.lit(" speakers"))),
        F.when(long, "long recording, native word times").otherwise("short recording, word alignment"),
    ))
    return estimates.select(
        "job_id", (~one).alias("use_diarization"), (~long).alias("use_alignment"), saved.cast("long").alias("saved_s"), reasons.alias("reasons")
    )
