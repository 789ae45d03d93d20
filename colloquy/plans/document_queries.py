"""Documents and transcript files of all meetings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators import entities as en
from colloquy.operators import metrics as me
from colloquy.operators import ops
from colloquy.operators import render as rn
from colloquy.operators import review as rv
from colloquy.operators import topics as tp
from colloquy.plans.registry import query
from colloquy.session import shared_folder
from colloquy.sources import transcripts as ts
from colloquy.sources.corpus import Corpus

_CUE = "printf('%02d:%02d:%02d{m}%03d', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


def _cue(t: str, mark: str) -> str:
    return _CUE.format(t=t, m=mark)


@query("J1 N2", """
    SELECT job_id, 0::BIGINT AS part, string_agg(display || ': ' || text || chr(10), chr(10) ORDER BY seg_idx) || chr(10) AS content
    FROM segments JOIN names USING (job_id, speaker_id) GROUP BY job_id""")
def txt_documents(c: Corpus) -> DataFrame:
    return rn.documents(rn.txt(c.segments(), c.names()))


@query("J2 M2", f"""
    SELECT job_id, 0::BIGINT AS part, string_agg((seg_idx + 1) || chr(10) || {_cue('start_ms', ',')} || ' --> ' || {_cue('end_ms', ',')} || chr(10) ||
           '[' || display || '] ' || text || chr(10), chr(10) ORDER BY seg_idx) || chr(10) AS content
    FROM segments JOIN names USING (job_id, speaker_id) GROUP BY job_id""")
def srt_documents(c: Corpus) -> DataFrame:
    return rn.documents(rn.srt(c.segments(), c.names()))


@query("J3 M2", f"""
    SELECT job_id, 0::BIGINT AS part, 'WEBVTT' || chr(10) || chr(10) || string_agg('cue-' || (seg_idx + 1) || chr(10) || {_cue('start_ms', '.')} || ' --> ' || {_cue('end_ms', '.')} || chr(10) ||
           '<v ' || display || '>' || text || chr(10), chr(10) ORDER BY seg_idx) || chr(10) AS content
    FROM segments JOIN names USING (job_id, speaker_id) GROUP BY job_id""")
def vtt_documents(c: Corpus) -> DataFrame:
    return rn.documents(rn.vtt(c.segments(), c.names()))


def _files(c: Corpus) -> DataFrame:
    return c.jobs().select("job_id", F.concat(F.lit("in/weekly_call-"), F.col("job_id").cast("string"), F.lit(".wav")).alias("audio_path"))


@query("J4 M5")
def markdown_lines(c: Corpus) -> DataFrame:
    return rn.markdown(c.words(), c.segments(), c.names(), _files(c), stamps="minute", mark_low=True)


@query("J5")
def quality_documents(c: Corpus) -> DataFrame:
    w, s = c.words(), c.segments()
    lines = rn.quality_report(
        c.jobs(), me.transcript_stats(w, s, c.corrections()), me.low_segments_by_count(w, s), c.corrections(),
        me.frequent_names(w, c.names()), me.unknown_acronyms(w, c.corrections()), me.repeated_uncertain(w),
    )
    return rn.documents(rn.dense(lines.union(rn.correction_report(c.jobs(), c.corrections()).withColumn("line_no", F.col("line_no") + (1 << 50)))))


@query("J6", """
    SELECT job_id, 4 + CASE WHEN count(a.sent_no) > 0 THEN 2 + count(a.sent_no) ELSE 1 END AS n_lines
    FROM jobs LEFT JOIN actions a USING (job_id) GROUP BY job_id""")
def action_report_lines(c: Corpus) -> DataFrame:
    # Title and heading, each with a gap; then a table head of two lines and the rows, or one sentence.
    return rn.action_report(c.jobs(), c.actions()).groupBy("job_id").agg(F.count("*").alias("n_lines"))


@query("J6")
def fact_documents(c: Corpus) -> DataFrame:
    bullets = tp.summary(c.jobs(), c.names(), c.spoken_pieces(), c.decisions(), c.actions())
    reports = {
        "summary": rn.summary_report(c.jobs(), bullets), "actions": rn.action_report(c.jobs(), c.actions()),
        "decisions": rn.decision_report(c.jobs(), c.decisions()), "questions": rn.question_report(c.jobs(), c.questions()),
        "timeline": rn.timeline_report(c.jobs(), c.timeline()),
    }
    out = None
    for name, lines in reports.items():
        docs = rn.documents(rn.dense(lines)).select("job_id", F.lit(name).alias("artifact"), "part", "content")
        out = docs if out is None else out.union(docs)
    return out


@query("J6", """SELECT job_id, kind, value, '{"kind":"' || kind || '","value":' || to_json(value) || '}' AS line FROM entities""")
def entity_json_lines(c: Corpus) -> DataFrame:
    return rn.entities_json(c.entities())


@query("H2")
def review_documents(c: Corpus) -> DataFrame:
    w, s, n = c.words(), c.segments(), c.names()
    timed = c.corrections().join(s.select("job_id", "seg_idx", F.col("start_ms").alias("at_ms")), ["job_id", "seg_idx"], "left")
    lines = rn.review_report(
        c.jobs(), rv.uncertain_words(w, c.sentences(), n), me.low_segments_by_average(w, s), timed, me.doubtful_names(w, s, n),
        en.first_mentions(s, n), en.bare_numbers(s, n), rv.short_segments(s), rv.rapid_switches(s), rv.alternating_pairs(s), n,
    )
    return rn.documents(rn.dense(lines))


@query("J7")
def run_documents(c: Corpus) -> DataFrame:
    events = c.job_events()
    stages = ops.stage_report(events.withColumnRenamed("kind", "stage"))
    samples = events.select("job_id", (F.col("value") % 100).alias("cpu_pct"), (F.col("value") / 100).alias("ram_gb"), (F.col("value") / 1000).alias("swap_gb"))
    jobs = events.select("job_id").distinct()
    artifacts = ops.artifact_totals(jobs, c.artifact_listing())
    return rn.documents(rn.dense(rn.run_report(jobs, stages, ops.resource_summary(samples), artifacts)))


@query("A1 A2 A6", """
    SELECT job_id, seg_idx, word_idx - first_word AS pos, w.text, w.start_ms, w.end_ms, confidence, w.speaker_id
    FROM words w JOIN (SELECT job_id, seg_idx, first_word FROM segments) USING (job_id, seg_idx)""")
def transcript_round_trip(c: Corpus) -> DataFrame:
    """Write transcripts as JSON, read them back and flatten them."""
    path = f"{shared_folder(c.spark)}/transcripts-{uuid.uuid4().hex}"
    ts.write_transcripts(ts.to_transcripts(c.jobs(), c.names(), c.segments(), c.words()), path)
    return ts.transcript_words(ts.read_transcripts(c.spark, path))


@query("A7", """
    SELECT artifact, job_id, 0::BIGINT AS part FROM (SELECT DISTINCT job_id FROM segments), (SELECT unnest(['txt', 'srt', 'vtt']) AS artifact)""")
def written_artifacts(c: Corpus) -> DataFrame:
    path = f"{shared_folder(c.spark)}/artifacts-{uuid.uuid4().hex}"
    formats = {name: rn.documents(rn.RENDERERS[name][1](c.segments(), c.names())) for name in ("txt", "srt", "vtt")}
    if failed := ts.write_artifacts(path, formats):
        # The rows of the other formats alone would look like the whole result.
        raise RuntimeError("artifacts not written: " + "; ".join(f"{name}: {why}" for name, why in failed.items()))
    return c.spark.read.parquet(path).select("artifact", "job_id", "part")
