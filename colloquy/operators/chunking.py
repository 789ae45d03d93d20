"""Plans of overlapping windows, word ingestion from recogniser output, stitching of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.ordered import dense_axis, following, scan

SECOND = 1_000


def _up_to(n: Column) -> Column:
    """0, 1, ... n-1 (at least 0)."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)).cast("long")))


def plan_asr_chunks(jobs: DataFrame, chunk_ms: int = 60_000, overlap_ms: int = 500) -> DataFrame:
    """Windows for speech recognition: equal nominal slices, read with overlap on both sides."""
    d = F.col("duration_ms")
    n = F.when(d <= chunk_ms, 1).otherwise(F.floor(d / chunk_ms) + F.when(d % chunk_ms > 100, 1).otherwise(0))
    rows = jobs.select("job_id", "duration_ms", _up_to(n).alias("chunk_idx"))
    start = F.col("chunk_idx") * chunk_ms
    single = d <= chunk_ms
    return rows.select(
        "job_id", "chunk_idx", start.alias("nominal_start_ms"), F.least(start + chunk_ms, d).alias("nominal_end_ms"),
        F.when(single, 0).otherwise(F.greatest(start - overlap_ms, F.lit(0))).cast("long").alias("read_start_ms"),
        F.least(F.when(single, d).otherwise(start + chunk_ms + overlap_ms), d).alias("read_end_ms"),
    )


def plan_diar_chunks(jobs: DataFrame, n: int, overlap_ms: int = 30_000) -> DataFrame:
    """Windows for diarization: equal slices, each running on into the next one."""
    d = F.col("duration_ms")
    single = (d <= 2 * overlap_ms) | F.lit(n <= 1)
    rows = jobs.select("job_id", "duration_ms", single.alias("single"), _up_to(F.when(single, 1).otherwise(n)).alias("chunk_idx"))
    i = F.col("chunk_idx")
    cut = F.floor((i + 1) * d / n) + overlap_ms
    return rows.select(
        "job_id", "chunk_idx", F.when(F.col("single"), 0).otherwise(F.floor(i * d / n)).cast("long").alias("chunk_start_ms"),
        F.when(F.col("single"), d).otherwise(F.least(cut, d)).alias("chunk_end_ms"),
        F.when(i > 0, overlap_ms).otherwise(0).cast("long").alias("overlap_ms"),
    )


def spread_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Words of `text` sharing [start_ms, end_ms) equally, without confidence."""
    tokens = rows.withColumn("_t", F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1)))
    each = (F.col("end_ms") - F.col("start_ms")) / F.size("_t")
    out = tokens.select(*keys, "start_ms", each.alias("_each"), F.posexplode("_t").alias("pos", "text"))

    def at(i):
        return F.bround(F.col("start_ms") + i * F.col("_each")).cast("long")

    return out.select(
        *keys, F.col("pos").cast("long").alias("pos"), "text", at(F.col("pos")).alias("start_ms"),
        at(F.col("pos") + 1).alias("end_ms"), F.lit(None).cast("double").alias("confidence"),
    )


ASR_SCHEMA = (
    "struct<segments:array<struct<start:double,end:double,text:string,"
    "words:array<struct<word:string,start:double,end:double,score:double,probability:double>>>>>"
)
_OUT = "array<struct<text:string,start:double,end:double,confidence:double>>"


def _word_step(seg: Column):
    """Add one recognised word to (last, words)."""

    def add(acc: Column, w: Column) -> Column:
        text = F.trim(w["word"])
        start = F.coalesce(w["start"], seg["start"], acc["last"])
        end = F.coalesce(w["end"], seg["end"], start + 0.1)
        end = F.when(end <= start, start + 0.05).otherwise(end)
        confidence = F.coalesce(F.nullif(w["score"], F.lit(0.0)), w["probability"])
        made = F.struct(
            text.alias("text"), F.bround(start, 3).alias("start"), F.bround(end, 3).alias("end"), confidence.alias("confidence")
        )
        return F.when(F.coalesce(text, F.lit("")) == "", acc).otherwise(
            F.struct(end.alias("last"), F.array_append(acc["words"], made).alias("words"))
        )

    return add


def _segment_step(acc: Column, seg: Column) -> Column:
    text = F.trim(seg["text"])
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    start = F.coalesce(seg["start"], acc["last"])
    end = F.coalesce(seg["end"], start + 0.1)
    end = F.when(end <= start, start + 0.05).otherwise(end)
    each = (end - start) / F.size(tokens)

    def even(token: Column, i: Column) -> Column:
        begin = F.bround(start + i * each, 3)
        return F.struct(
            token.alias("text"), begin.alias("start"), F.bround(begin + each, 3).alias("end"), F.lit(None).cast("double").alias("confidence")
        )

    untimed = F.coalesce(F.size(seg["words"]), F.lit(0)) <= 0
    blank = F.coalesce(F.size(tokens), F.lit(0)) <= 0
    spread = F.struct(end.alias("last"), F.concat(acc["words"], F.transform(tokens, even)).alias("words"))
    timed = F.aggregate(F.coalesce(seg["words"], F.array()), acc, _word_step(seg))
    return F.when(untimed & blank, acc).when(untimed, spread).otherwise(timed)


def extract_words(outputs: DataFrame, keys: list[str], column: str = "segments_json") -> DataFrame:
    """Words of nested recogniser output, one output document per row.

    Missing times fall back to the segment and then to the end of the word before, which only a
    walk through the document can know; the walk stays inside the document's own cell.
    """
    parsed = outputs.withColumn("_d", F.from_json(column, ASR_SCHEMA))
    first = F.struct(F.lit(0.0).alias("last"), F.array().cast(_OUT).alias("words"))
    words = F.aggregate(F.col("_d.segments"), first, _segment_step)["words"]
    return parsed.select(*keys, F.posexplode(words).alias("pos", "w")).select(
        *keys, F.col("pos").cast("long").alias("pos"), "w.text", F.bround(F.col("w.start") * SECOND).cast("long").alias("start_ms"),
        F.bround(F.col("w.end") * SECOND).cast("long").alias("end_ms"), "w.confidence",
    )


def normalise_hypotheses(hyps: DataFrame, keys: list[str], frame_s: float = 0.08) -> DataFrame:
    """Words from recogniser hypotheses: word times, else frame offsets, else even spread.

    Columns: word_times array<struct<word,start,end>>, frames array<struct<word,first,last>>,
    text, duration_s.
    """

    def word(text, start, end):
        return F.struct(
            text.alias("text"), F.bround(start * SECOND).cast("long").alias("start_ms"),
            F.bround(F.greatest(end, start + 0.01) * SECOND).cast("long").alias("end_ms"),
        )

    timed = F.filter(
        F.transform("word_times", lambda w: word(F.trim(w["word"]), F.coalesce(w["start"], F.lit(0.0)), F.coalesce(w["end"], F.coalesce(w["start"], F.lit(0.0)) + 0.1))),
        lambda w: w["text"] != "",
    )
    framed = F.filter(
        F.transform(
            F.filter("frames", lambda f: f["first"].isNotNull()),
            lambda f: word(F.trim(f["word"]), f["first"] * frame_s, F.coalesce(f["last"] * frame_s, f["first"] * frame_s + frame_s)),
        ),
        lambda w: w["text"] != "",
    )
    tokens = F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))
    each = F.col("duration_s") / F.size(tokens)
    spread = F.transform(
        tokens,
        lambda t, i: F.struct(
            t.alias("text"), F.bround(i * each * SECOND).cast("long").alias("start_ms"),
            F.bround((i + 1) * each * SECOND).cast("long").alias("end_ms"),
        ),
    )
    chosen = F.when(F.size(timed) > 0, timed).when(F.size(framed) > 0, framed).otherwise(spread)
    return hyps.select(*keys, F.posexplode(chosen).alias("pos", "w")).select(*keys, F.col("pos").cast("long").alias("pos"), "w.*")


def owners(plan: DataFrame) -> DataFrame:
    """The plan with the times that each window owns: from its nominal start (`_from`) to that of the next one (`_until`)."""
    return scan(plan.withColumn("_from", F.col("nominal_start_ms")), dense_axis("job_id", "chunk_idx"), _until=following(F.col("_from")))


def owned(start: Column) -> Column:
    """Whether a word that starts here belongs to its window."""
    return (start >= F.col("_from")) & (F.col("_until").isNull() | (start < F.col("_until")))


def stitch_words(chunk_words: DataFrame, plan: DataFrame) -> DataFrame:
    """Words of overlapping windows on the meeting's time line, each from the one window that owns it."""
    windows = owners(plan.select("job_id", "chunk_idx", "read_start_ms", "nominal_start_ms"))
    placed = chunk_words.join(windows, ["job_id", "chunk_idx"])
    start = F.col("rel_start_ms") + F.col("read_start_ms")
    return placed.withColumn("start_ms", start).filter(owned(F.col("start_ms"))).select(
        "job_id", "chunk_idx", "text", "start_ms", (F.col("rel_end_ms") + F.col("read_start_ms")).alias("end_ms"), "confidence"
    )


def fill_failed_chunks(chunk_turns: DataFrame, plan: DataFrame, failed: DataFrame) -> DataFrame:
    """Turns of all chunks; a failed chunk becomes one turn of SPEAKER_00."""
    good = chunk_turns.join(failed, ["job_id", "chunk_idx"], "left_anti").select("job_id", "chunk_idx", "speaker_id", "start_ms", "end_ms")
    whole = plan.join(failed, ["job_id", "chunk_idx"], "left_semi").select(
        "job_id", "chunk_idx", F.lit("SPEAKER_00").alias("speaker_id"), F.col("chunk_start_ms").alias("start_ms"), F.col("chunk_end_ms").alias("end_ms")
    )
    return good.union(whole)
