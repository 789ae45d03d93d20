"""Known voices across meetings: windows, centroids, matching, naming, enrolment."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.vectors import unit

HIGH, MEDIUM = 0.80, 0.65
MIN_MS, WINDOW_MS, WHOLE_MS = 2_000, 5_000, 10_000
SLAB = 1024
PROFILES_PER_BLOCK = 4_096
VOICES_PER_SHARD = 16_384


def enrollable(segs: DataFrame) -> DataFrame:
    """Segments long enough to learn a voice from: two seconds and three words."""
    return segs.filter((F.col("end_ms") - F.col("start_ms") >= MIN_MS) & (F.col("n_words") >= 3))


def embedding_windows(turns: DataFrame) -> DataFrame:
    """Windows of each turn: none under 2 s, one up to 10 s, else 5 s steps with the rest in the last."""
    length = F.col("end_ms") - F.col("start_ms")
    steps = F.greatest(F.lit(0), F.ceil((length - WHOLE_MS) / WINDOW_MS)).cast("long")
    cut = turns.filter(length >= MIN_MS).withColumn("steps", steps).withColumn("window_idx", F.explode(F.sequence(F.lit(0).cast("long"), "steps")))
    start = F.col("start_ms") + F.col("window_idx") * WINDOW_MS
    return cut.select(
        "job_id", "turn_idx", "speaker_id", "window_idx", start.alias("start_ms"),
        F.when(F.col("window_idx") < F.col("steps"), start + WINDOW_MS).otherwise(F.col("end_ms")).alias("end_ms"),
    )


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector of each key at length 1, with the number of vectors; null vectors don't count.

    Vectors are summed as they are, and combined before the shuffle.
    """
    vector = array_to_vector(F.col("embedding").cast("array<double>"))
    rows = vectors.where("embedding is not null").groupBy(*keys).agg(Summarizer.mean(vector).alias("v"), F.count("*").alias("n_vectors"))
    return rows.select(*keys, "n_vectors", unit(vector_to_array("v")).alias("centroid"))


def _at_length_one(vectors) -> np.ndarray:
    x = np.vstack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1), np.finfo(float).tiny)[:, None]


def _best_in_block(voices: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    columns = ["job_id", "speaker_id", "profile_id", "similarity"]
    if voices.empty or known.empty:
        return pd.DataFrame({c: [] for c in columns}).astype({"job_id": "int64", "similarity": "float64"})
    known = known.sort_values("profile_id")
    q, p = _at_length_one(voices["centroid"]), _at_length_one(known["centroid"])
    at, best = np.empty(len(q), dtype=np.int64), np.empty(len(q))
    # In slabs, so that the products of a task stay at SLAB x PROFILES_PER_BLOCK numbers.
    for i in range(0, len(q), SLAB):
        sims = q[i : i + SLAB] @ p.T
        at[i : i + SLAB] = sims.argmax(axis=1)
        best[i : i + SLAB] = sims.max(axis=1)
    return pd.DataFrame({
        "job_id": voices["job_id"].to_numpy(), "speaker_id": voices["speaker_id"].to_numpy(),
        "profile_id": known["profile_id"].to_numpy()[at], "similarity": best,
    })


def match_voices(voices: DataFrame, profiles: DataFrame) -> DataFrame:
    """Nearest profile of each voice by cosine, ties to the smaller profile id.

    Every voice has to be compared with every profile, but no pairs are formed as rows: both sides
    are cut into blocks of bounded size, a task multiplies one block of voices with one block of
    profiles, and only each voice's best match of the block leaves the task.
    """
    known = profiles.filter("centroid is not null").select("profile_id", "centroid")
    blocks = max(1, math.ceil(known.count() / PROFILES_PER_BLOCK))
    shards = max(1, math.ceil(voices.count() / VOICES_PER_SHARD))
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    v = voices.filter("centroid is not null").select(
        "job_id", "speaker_id", "centroid",
        F.pmod(F.xxhash64("job_id", "speaker_id"), F.lit(shards)).cast("int").alias("shard"), every_block.alias("block"),
    )
    p = known.select("profile_id", "centroid", F.pmod(F.xxhash64("profile_id"), F.lit(blocks)).cast("int").alias("block"), every_shard.alias("shard"))
    best = v.groupBy("block", "shard").cogroup(p.groupBy("block", "shard")).applyInPandas(
        _best_in_block, "job_id long, speaker_id string, profile_id string, similarity double"
    )
    rank = F.struct(-F.col("similarity"), "profile_id")
    top = best.groupBy("job_id", "speaker_id").agg(F.min(rank).alias("r")).select(
        "job_id", "speaker_id", F.col("r.profile_id").alias("profile_id"), (-F.col("r.col1")).alias("similarity")
    )
    level = F.when(F.col("similarity") >= HIGH, "high").when(F.col("similarity") >= MEDIUM, "medium").otherwise("unknown")
    named = top.join(profiles.select("profile_id", "display_name"), "profile_id").withColumn("confidence", level)
    known_voice = F.col("confidence") != "unknown"
    return named.select(
        "job_id", "speaker_id", F.when(known_voice, F.col("profile_id")).alias("profile_id"),
        F.when(known_voice, F.col("display_name")).alias("display_name"), "similarity", "confidence",
    )


def identify(speakers: DataFrame, matches: DataFrame, introduced: DataFrame, profiles: DataFrame) -> DataFrame:
    """Name of each speaker and the profile to enrol into.

    A sure voice wins, then a sure self-introduction, then a likely voice, which names but never
    enrols. All speakers are judged against the same state of the profile store; enrolment
    follows for the whole batch.
    """
    intro = introduced.filter("sure").select("job_id", "speaker_id", F.col("name").alias("said"))
    by_name = profiles.groupBy(F.col("display_name").alias("said")).agg(F.min("profile_id").alias("said_profile"))
    m = matches.select("job_id", "speaker_id", "profile_id", "display_name", "similarity", F.col("confidence").alias("voice"))
    all_in = speakers.join(m, ["job_id", "speaker_id"], "left").join(intro, ["job_id", "speaker_id"], "left").join(by_name, "said", "left")
    voice, said = F.col("voice"), F.col("said")
    new_id = F.concat(F.lit("inferred:"), said)
    heard = F.concat(F.lit("voice_match:"), voice, F.lit(":"), F.format_string("%.3f", F.col("similarity")))

    def pick(sure_voice, sure_intro, likely_voice, unknown):
        return (
            F.when(voice == "high", sure_voice).when(said.isNotNull(), sure_intro)
            .when(voice == "medium", likely_voice).otherwise(unknown)
        )

    null = F.lit(None).cast("string")
    return all_in.select(
        "job_id", "speaker_id", pick(F.col("display_name"), said, F.col("display_name"), null).alias("display_name"),
        pick(F.lit("high"), F.lit("high"), F.lit("medium"), F.lit("unknown")).alias("confidence"),
        pick(heard, F.lit("self_identification:high"), heard, null).alias("evidence"),
        pick(F.col("profile_id"), F.coalesce("said_profile", new_id), null, null).alias("enrol_into"),
    )


def enrolled_vectors(identified: DataFrame, voice_windows: DataFrame) -> DataFrame:
    """Vectors to append to the store: (profile_id, job_id, embedding, evidence)."""
    chosen = identified.filter("enrol_into is not null").select("job_id", "speaker_id", F.col("enrol_into").alias("profile_id"), "evidence")
    return voice_windows.join(chosen, ["job_id", "speaker_id"]).select("profile_id", "job_id", "embedding", "evidence")


def enrolled_profiles(profiles: DataFrame, stored: DataFrame, identified: DataFrame, added: DataFrame) -> DataFrame:
    """Profile rows after enrolment: vectors and source jobs counted, status kept, new ones inferred."""
    both = stored.select("profile_id", "job_id", F.lit(0).alias("is_new")).union(added.select("profile_id", "job_id", F.lit(1)))
    per_job = both.groupBy("profile_id", "job_id").agg(F.count("*").alias("n"), F.sum("is_new").alias("n_new"))
    counts = per_job.groupBy("profile_id").agg(
        F.sum("n").alias("n_vectors"), F.sum("n_new").alias("n_new"), F.count("*").alias("n_source_jobs")
    )
    made = identified.filter("enrol_into like 'inferred:%'").groupBy(F.col("enrol_into").alias("profile_id")).agg(
        F.min("display_name").alias("new_name")
    )
    rows = profiles.select("profile_id", "display_name", "status").join(made, "profile_id", "full")
    return rows.join(counts, "profile_id", "left").select(
        "profile_id", F.coalesce("display_name", "new_name").alias("display_name"),
        F.coalesce("status", F.lit("inferred")).alias("status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_vectors", "n_new", "n_source_jobs")],
    )
