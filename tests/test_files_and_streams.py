"""Files, documents, streams, and the registered queries against DuckDB on the smallest data."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colloquy.operators import render as rn
from colloquy.plans import QUERIES
from colloquy.sources import transcripts as ts
from colloquy.streaming import progress as pg
from tests.cross_check import compare, duck

SF = "/root/testdata/sf0.001"


def test_bad_transcripts_are_set_aside(spark, tmp_path):
    good = {"job_id": 1, "segments": [{"seg_idx": 0, "speaker_id": "A", "text": "hi you", "words": [{"text": "hi"}, {"text": "you"}]}]}
    (tmp_path / "in").mkdir()
    odd = good | {"job_id": 2, "duration_ms": "abc"}
    (tmp_path / "in" / "a.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps(odd) + "\n" + json.dumps({"language": "en"}) + "\n")
    (tmp_path / "in" / "pretty.json").write_text(json.dumps(good | {"job_id": 7}, indent=2))
    (tmp_path / "in" / "cut.json").write_text(json.dumps(good, indent=2)[:-9])
    got = ts.read_transcripts(spark, str(tmp_path / "in"), str(tmp_path / "bad"))
    assert sorted((r.job_id, r.seg_idx, r.pos, r.text) for r in ts.transcript_words(got).collect()) == [(1, 0, 0, "hi"), (1, 0, 1, "you"), (7, 0, 0, "hi"), (7, 0, 1, "you")]
    assert got.count() == 2 and sorted(r.job_id for r in got.select("job_id").collect()) == [1, 7]
    bad = sorted((r.file.rsplit("/")[-1], r.value[:7]) for r in spark.read.json(str(tmp_path / "bad")).collect())
    assert bad == [("a.jsonl", '{"job_i'), ("a.jsonl", '{"langu'), ("a.jsonl", "{broken"), ("cut.json", '{\n  "jo')]


def test_failing_format_does_not_stop_the_others(spark, tmp_path):
    docs = spark.createDataFrame([(1, 0, "x")], "job_id long, part long, content string")
    broken = docs.withColumn("content", F.raise_error(F.lit("no")).cast("string"))
    failed = ts.write_artifacts(str(tmp_path), {"bad": broken, "txt": docs})
    assert list(failed) == ["bad"]
    assert [r.artifact for r in spark.read.parquet(str(tmp_path)).collect()] == ["txt"]


def test_profile_store_round_trip(spark, tmp_path):
    profiles = spark.createDataFrame([("P1", "Ann"), ("P2", "Bob")], "profile_id string, display_name string")
    vectors = spark.createDataFrame([("P1", [1.0]), ("P2", [2.0])], "profile_id string, embedding array<double>")
    ts.write_profiles(profiles, vectors, str(tmp_path), 1)
    p, v = ts.read_profiles(spark, str(tmp_path), 1)
    p, v, there = ts.without_profile(p, v, "P1")
    assert there and [r.profile_id for r in p.collect()] == ["P2"] and v.count() == 1
    assert not ts.without_profile(p, v, "P1")[2]


@pytest.fixture(scope="module")
def meeting(spark):
    rows = [(1, 0, "A", 0, 1_000, "Hello there", 2), (1, 1, "B", 61_500, 62_000, "Hi", 1)]
    segs = spark.createDataFrame(rows, "job_id long, seg_idx long, speaker_id string, start_ms long, end_ms long, text string, n_words long")
    names = spark.createDataFrame([(1, "A", "Speaker 1"), (1, "B", "Speaker 2")], "job_id long, speaker_id string, display string")
    words = spark.createDataFrame(
        [(1, 0, 0, "Hello", 0, 400, 0.9), (1, 0, 1, "there,", 3_000, 3_400, 0.2), (1, 1, 2, "Hi", 130_000, 130_500, None)],
        "job_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, confidence double",
    )
    return segs, names, words


def content(lines, **kw):
    return "".join(r.content for r in rn.documents(lines, **kw).orderBy("part").collect())


def test_subtitles(meeting):
    segs, names, _ = meeting
    assert content(rn.srt(segs, names)) == (
        "1\n00:00:00,000 --> 00:00:01,000\n[Speaker 1] Hello there\n\n2\n00:01:01,500 --> 00:01:02,000\n[Speaker 2] Hi\n\n"
    )
    assert content(rn.vtt(segs, names)).startswith("WEBVTT\n\ncue-1\n00:00:00.000 --> 00:00:01.000\n<v Speaker 1>Hello there\n\ncue-2")
    # The same document in parts of two lines.
    assert content(rn.txt(segs, names), part_lines=2) == content(rn.txt(segs, names)) == "Speaker 1: Hello there\n\nSpeaker 2: Hi\n\n"


def test_markdown(spark, meeting):
    segs, names, words = meeting
    files = spark.createDataFrame([(1, "a/team_sync-call.wav")], "job_id long, audio_path string")
    lines = rn.markdown(words, segs, names, files, stamps="minute", mark_low=True).orderBy("line_no").collect()
    assert [r.line for r in lines] == [
        "# Team Sync Call", "", "## Speaker 1", "", "Hello", "", "**[there?]**,", "", "## Speaker 2", "",
        "*[[01:00]]*", "", "*[[02:00]]*", "", "Hi", "",
    ]


def test_stage_labels(spark):
    df = spark.createDataFrame([("Done",), ("load the diarizer model",), ("diariz load",), ("hm",), (None,)], "m string")
    assert [r[0] for r in df.select(pg.stage_label(F.col("m"))).collect()] == [
        "Generating Files", "Loading Model", "Loading Diarization", "Processing", "Processing",
    ]


def run_stream(spark, build, out, folder, mode="append"):
    lines = spark.readStream.schema("event_id long, job_id long, ts_ms long, payload string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    events = pg.decode(lines).withColumn("ts", F.timestamp_millis("ts_ms"))
    q = build(events).writeStream.format("memory").queryName(out).outputMode(mode).option("checkpointLocation", f"{folder}/{out}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(out)


def test_streams_equal_batch(spark, tmp_path):
    hour = 3_600_000
    rows = []
    for job in range(3):
        for n in range(12):
            gap = 50 * 60_000 if n > 7 and job == 1 else 0
            ts = n * 600_000 + gap
            kind = "completed" if n == 11 and job == 0 else "resource" if n % 3 == 1 else "stage"
            rows.append((job * 100 + n, job, ts, json.dumps({"type": kind, "stage": f"s{n // 4}", "fraction": ((n * 7) % 10) / 10, "cpu_pct": float(n), "ram_gb": 1.0})))
    # Events far ahead move the watermarks past every session and window.
    for i, kind in enumerate(("stage", "resource", "stage", "resource")):
        body = {"type": kind, "stage": "z", "fraction": 0.1, "cpu_pct": 1.0, "ram_gb": 1.0}
        rows.append((900 + i, 9, (100 if i < 2 else 200) * hour, json.dumps(body)))
    schema = "event_id long, job_id long, ts_ms long, payload string"
    for i, part in enumerate((rows[:20], rows[20:36], rows[36:38], rows[38:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = pg.decode(spark.createDataFrame(rows, schema)).withColumn("ts", F.timestamp_millis("ts_ms"))

    live = run_stream(spark, pg.live_progress, "live", tmp_path, "complete")
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in pg.live_progress(batch).collect()}
    top = pg.monotone_progress(batch).groupBy("job_id").agg(F.max("progress"))
    assert {tuple(r) for r in live.collect()} == {tuple(r) for r in top.collect()}

    stages = run_stream(spark, pg.current_stages, "stages", tmp_path, "complete")
    assert {tuple(r) for r in stages.collect()} == {(r.job_id, r.stage) for r in pg.live_view(batch).collect()}

    stalled = run_stream(spark, pg.stalls_stream, "stalled", tmp_path)
    want = {(r.job_id, r.ts_ms) for r in pg.stalls(batch).collect() if r.ts_ms < 190 * hour}
    assert {(r.job_id, r.ts_ms) for r in stalled.collect()} == want and (1, 3_600_000) in want

    loads = run_stream(spark, lambda e: pg.resource_windows(e, streaming=True), "loads", tmp_path)
    assert {tuple(r) for r in loads.collect()} == {tuple(r) for r in pg.resource_windows(batch).collect() if r.start_ms < 190 * hour}

    ended = run_stream(spark, pg.terminal_stream, "ended", tmp_path)
    assert [(r.job_id, r.type) for r in ended.collect()] == [(0, "completed")]


PICKED = (
    "attributed_words", "speaker_segments", "sentence_split", "speaking_time", "action_items", "decisions", "questions", "entities",
    "topics", "timeline", "tidied_texts", "realigned_words", "context_corrections", "phrase_search", "rapid_switches", "stitched_words",
    "extracted_words", "identified_speakers", "srt_documents", "monotone_progress", "stalled_jobs", "artifact_completeness",
)


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    verdict, _, _ = compare(spark, duck(SF), name, QUERIES[name], SF)
    assert verdict.startswith("ok"), verdict


def test_reconciled_turns_keep_their_speakers(spark):
    """The labels swapped inside the chunks come back: every turn lies in turns of one original speaker."""
    from colloquy.sources.corpus import corpus

    c = corpus(spark, SF)
    got = QUERIES["reconciled_turns"](spark, SF)
    mixed = got.alias("g").join(c.turns().alias("t"), "job_id").filter(
        (F.col("g.start_ms") < F.col("t.end_ms")) & (F.col("g.end_ms") > F.col("t.start_ms")) & (F.col("g.speaker_id") == F.col("t.speaker_id"))
    )
    assert mixed.select("job_id").distinct().count() == got.select("job_id").distinct().count()


def test_inventory_is_covered():
    sizes = {"A": 10, "B": 12, "C": 14, "D": 10, "E": 24, "F": 14, "G": 12, "H": 6, "I": 3, "J": 7, "K": 9, "L": 4, "M": 11, "N": 4}
    wanted = {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert wanted - {i for q in QUERIES.values() for i in q.covers} == set()


def test_kept_tables_and_artifacts_are_packed_by_zstd(spark, tmp_path):
    from pathlib import Path

    from colloquy.sources import transcripts as ts
    from colloquy.sources.corpus import Corpus

    rows = spark.createDataFrame([(1, 0, "text")], "job_id long, part long, content string")
    assert ts.write_artifacts(str(tmp_path / "a"), {"txt": rows}) == {} and list((tmp_path / "a").rglob("*.zstd.parquet"))
    kept = Corpus(spark, str(tmp_path)).keep("rows", lambda: rows)
    assert kept.count() == 1 and all(Path(f).name.endswith(".zstd.parquet") for f in kept.inputFiles())


def test_artifacts_that_lack_a_format_are_no_result(spark, meeting, monkeypatch):
    """The other formats are still written, but their rows alone are not returned."""
    from types import SimpleNamespace

    from colloquy.plans import document_queries as dq

    segs, names, _ = meeting
    c, written, write = SimpleNamespace(spark=spark, segments=lambda: segs, names=lambda: names), [], ts.write_artifacts
    monkeypatch.setattr(dq.ts, "write_artifacts", lambda path, formats: written.append(path) or write(path, formats))
    whole = QUERIES["written_artifacts"].build(c)
    assert sorted((r.artifact, r.job_id, r.part) for r in whole.collect()) == [("srt", 1, 0), ("txt", 1, 0), ("vtt", 1, 0)]
    broken = lambda *a: rn.srt(*a).withColumn("line", F.raise_error(F.lit("no room")).cast("string"))
    monkeypatch.setitem(rn.RENDERERS, "srt", (".srt", broken))
    with pytest.raises(RuntimeError, match="(?s)artifacts not written: srt: .*no room"):
        QUERIES["written_artifacts"].build(c)
    assert sorted(r.artifact for r in spark.read.parquet(written[-1]).collect()) == ["txt", "vtt"]
