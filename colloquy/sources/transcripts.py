"""Transcript and artifact files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

WORD = "struct<text:string,start_ms:bigint,end_ms:bigint,confidence:double,speaker_id:string>"
SEGMENT = f"struct<seg_idx:bigint,speaker_id:string,start_ms:bigint,end_ms:bigint,text:string,words:array<{WORD}>>"
SCHEMA = (
    "job_id bigint, audio_path string, duration_ms bigint, language string, speakers map<string,string>, "
    f"metadata map<string,string>, segments array<{SEGMENT}>, part bigint, version int"
)
CORRUPT = "_corrupt"


def read_transcripts(spark: SparkSession, path: str, bad_path: str | None = None) -> DataFrame:
    """Transcripts below path: files of JSON lines (named part-*, *.jsonl or *.ndjson), and files that are one transcript each.

    Every record is checked against the whole schema, whatever columns are used later. Records that don't fit or lack a job_id are left
    out, counted in a warning, and kept in bad_path (file, value) if given.
    """
    lines = F.col("_metadata.file_name").rlike(r"^part-|[.](?:jsonl|ndjson)$")

    def texts(whole: bool) -> DataFrame:
        return spark.read.text(path, wholetext=whole, recursiveFileLookup=True).where(~lines if whole else lines).select("value", F.col("_metadata.file_path").alias("file"))

    records = texts(False).unionByName(texts(True)).where(F.trim("value") != "")
    # With options set, Spark parses all fields even if few are read.
    parsed = records.withColumn("r", F.from_json("value", f"{SCHEMA}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = parsed.where(F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull() | F.col("r.job_id").isNull())
    if bad_path:
        bad.select("file", "value").write.mode("append").json(bad_path)
    if rejected := bad.count():
        log.warning("%s: %d records are no transcripts and are left out", path, rejected)
    good = parsed.where(F.col("r").isNotNull() & F.col(f"r.{CORRUPT}").isNull() & F.col("r.job_id").isNotNull())
    return good.select("r.*").drop(CORRUPT)


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    return transcripts.select("job_id", F.explode("segments").alias("s")).select(
        "job_id", "s.seg_idx", "s.speaker_id", "s.start_ms", "s.end_ms", "s.text", F.size("s.words").cast("long").alias("n_words")
    )


def transcript_words(transcripts: DataFrame) -> DataFrame:
    """Words of all segments, in order of segment and place."""
    segs = transcripts.select("job_id", F.explode("segments").alias("s")).select("job_id", "s.seg_idx", F.posexplode("s.words").alias("pos", "w"))
    return segs.select("job_id", "seg_idx", F.col("pos").cast("long").alias("pos"), "w.*")


def to_transcripts(jobs: DataFrame, names: DataFrame, segs: DataFrame, words: DataFrame, part_segments: int = 5_000) -> DataFrame:
    """One row per meeting, or several parts of bounded length for a long one."""
    w = F.struct("word_idx", F.struct("text", "start_ms", "end_ms", "confidence", "speaker_id").alias("w"))
    per_seg = words.groupBy("job_id", "seg_idx").agg(F.transform(F.array_sort(F.collect_list(w)), lambda x: x["w"]).alias("words"))
    s = F.struct("seg_idx", "speaker_id", "start_ms", "end_ms", "text", "words")
    whole = segs.join(per_seg, ["job_id", "seg_idx"]).groupBy("job_id", F.floor(F.col("seg_idx") / part_segments).alias("part")).agg(
        F.array_sort(F.collect_list(s), lambda a, b: F.when(a["seg_idx"] < b["seg_idx"], -1).when(a["seg_idx"] > b["seg_idx"], 1).otherwise(0)).alias("segments")
    )
    speakers = names.groupBy("job_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("speaker_id", "display")))).alias("speakers"))
    path = F.concat(F.lit("meetings/meeting_"), F.col("job_id").cast("string"), F.lit(".wav"))
    return whole.join(jobs, "job_id").join(speakers, "job_id").select(
        "job_id", path.alias("audio_path"), "duration_ms", "language", "speakers",
        F.create_map().cast("map<string,string>").alias("metadata"), "segments", "part", F.lit(1).alias("version"),
    )


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").json(path)


def write_artifacts(path: str, artifacts: dict[str, DataFrame]) -> dict[str, str]:
    """Write documents (job_id, part, content) of each format under artifact=<name>; a rerun replaces them.

    A format that fails is logged with its trace and reported (name, reason); the others are still written, so what stands
    below path is the whole only if nothing is reported.
    """
    failed = {}
    for name, docs in artifacts.items():
        try:
            docs.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/artifact={name}")
        except Exception as e:  # noqa: BLE001
            log.warning("artifact %s failed: %s", name, e, exc_info=True)
            failed[name] = str(e)
    return failed


def write_profiles(profiles: DataFrame, vectors: DataFrame, folder: str, version: int) -> None:
    """Write a new version of the profile store; readers see it once both tables are complete."""
    vectors.write.mode("overwrite").parquet(f"{folder}/version={version}/vectors")
    profiles.write.mode("overwrite").parquet(f"{folder}/version={version}/profiles")


def read_profiles(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame]:
    base = f"{folder}/version={version}"
    return spark.read.parquet(f"{base}/profiles"), spark.read.parquet(f"{base}/vectors")


def without_profile(profiles: DataFrame, vectors: DataFrame, profile_id: str) -> tuple[DataFrame, DataFrame, bool]:
    """Profiles and vectors without one profile, and whether it was there."""
    there = not profiles.filter(F.col("profile_id") == profile_id).isEmpty()
    return profiles.filter(F.col("profile_id") != profile_id), vectors.filter(F.col("profile_id") != profile_id), there
