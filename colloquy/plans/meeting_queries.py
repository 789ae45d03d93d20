"""Attribution, segments, sentences and statistics of meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import attribution as at
from colloquy.plans.registry import query
from colloquy.sources.corpus import Corpus


@query("E3 C7 M8", """
    SELECT s.job_id, s.speaker_id, n.display, round(sum(end_ms - start_ms) / 1000.0, 2) AS speaking_s,
           count(*) AS n_segments
    FROM segments s JOIN names n USING (job_id, speaker_id) GROUP BY ALL""")
def speaking_time(c: Corpus) -> DataFrame:
    per = c.segments().groupBy("job_id", "speaker_id").agg(
        F.round(F.sum(F.col("end_ms") - F.col("start_ms")) / 1000.0, 2).alias("speaking_s"),
        F.count("*").alias("n_segments"),
    )
    return at.with_display_names(per, c.names())


@query("A2", """
    SELECT job_id, seg_idx, word_idx, text, start_ms, end_ms, confidence, speaker_id FROM words""")
def transcript_words(c: Corpus) -> DataFrame:
    return c.words().select(
        "job_id", "seg_idx", "word_idx", "text", "start_ms", "end_ms", "confidence", "speaker_id"
    )


@query("C1 C2", """SELECT job_id, word_idx, speaker_id FROM spoken""")
def attributed_words(c: Corpus) -> DataFrame:
    return at.assign_speakers(c.timed_words(), c.turns()).select("job_id", "word_idx", "speaker_id")


@query("C1", """SELECT job_id, word_idx, turn_idx, overlap_ms FROM pairs""")
def word_turn_overlaps(c: Corpus) -> DataFrame:
    return at.overlap_pairs(c.timed_words(), c.turns()).select("job_id", "word_idx", "turn_idx", "overlap_ms")


@query("D1", """SELECT job_id, seg_idx, seg_id, speaker_id, start_ms, end_ms, n_words, text FROM segments""")
def speaker_segments(c: Corpus) -> DataFrame:
    return at.segments(c.spoken_stretches()).select(
        "job_id", "seg_idx", "seg_id", "speaker_id", "start_ms", "end_ms", "n_words", "text"
    )


@query("D2", """SELECT job_id, speaker_id, first_seg, display FROM names""")
def display_numbers(c: Corpus) -> DataFrame:
    return at.speaker_names(c.segments())


@query("D6", """SELECT job_id, seg_idx, sent_no, start_ms, end_ms, n_words, text FROM sentences""")
def sentence_split(c: Corpus) -> DataFrame:
    return at.sentences(c.spoken_pieces()).select("job_id", "seg_idx", "sent_no", "start_ms", "end_ms", "n_words", "text")
