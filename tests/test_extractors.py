from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colloquy.operators import entities as en
from colloquy.operators import extractors as ex
from colloquy.operators import facts as fa


def test_registered_extractor_is_used(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "job_id long, remark string")
    ex.register_extractor("remark", lambda tables: rows)
    try:
        with pytest.raises(ValueError):
            ex.register_extractor("remark", lambda tables: rows)
        found = ex.bundle(ex.extract(None, ["remark", "unheard"])).collect()
        assert sorted(map(tuple, found)) == [(1, "remark", '{"remark":"x"}'), (2, "remark", '{"remark":null}')]
    finally:
        del ex.EXTRACTORS["remark"]


def test_capitalised_prose_is_cut_but_entities_are_not(spark):
    texts = [f"Sentence number {i} ends here." for i in range(50)] + ["We paid $5", "million to Acme Big", "Bank and met Dr.", "Smith."]
    segs = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "job_id long, seg_idx long, text string")
    assert en.stretches(segs).agg(F.max(F.length("text"))).head()[0] < 80
    names = spark.createDataFrame([], "job_id long, display string")
    got = {(r.kind, r.value) for r in en.entities(segs, names).collect()}
    assert got == {("dollars", "$5 million"), ("organization", "Acme Big Bank"), ("person", "Dr. Smith")}


def test_long_and_short_tasks_are_kept(spark):
    long = "write " + "the report and " * 14 + "send it"
    sents = spark.createDataFrame([(1, 0, 0, "A", 0, f"I will {long}."), (1, 1, 0, "A", 1, "Please go.")], "job_id long, sent_no long, seg_idx long, speaker_id string, start_ms long, text string")
    names = spark.createDataFrame([(1, "A", "Ann")], "job_id long, speaker_id string, display string")
    got = {r.sent_no: (r.task, r.owner) for r in fa.action_items(sents, names).collect()}
    assert got == {0: (long, "Ann"), 1: ("go", None)} and len(long) > 200


def test_registered_processor_and_renderer_are_used(spark):
    from dataclasses import replace

    from colloquy.operators import processors as pr
    from colloquy.operators import render as rn
    from colloquy.sources.profiles import Profile

    segs = spark.createDataFrame([(1, 0, "S", "a b", 0, 900)], "job_id long, seg_idx long, speaker_id string, text string, start_ms long, end_ms long")
    words = spark.createDataFrame([(1, 0, i, t, 0, 1, 0.5, "S") for i, t in enumerate("a b".split())], "job_id long, seg_idx long, word_idx long, text string, start_ms long, end_ms long, confidence double, speaker_id string")
    pr.register_processor("shout", lambda t, profile: replace(t, texts=t.texts.withColumn("text", F.upper("text"))))
    rn.register_renderer("plain", ".p", lambda segs: segs.select("job_id", F.col("seg_idx").alias("line_no"), F.col("text").alias("line")))
    try:
        with pytest.raises(ValueError):
            pr.register_processor("shout", None)
        with pytest.raises(ValueError):
            rn.register_renderer("plain", ".p", None)
        done = pr.run_processors(pr.transcripts(words, segs), Profile("p", ("shout", "unheard")))
        assert [r.text for r in done.texts.collect()] == ["A B"]
        suffix, renderer = rn.RENDERERS["plain"]
        assert suffix == ".p" and [r.content for r in rn.documents(renderer(segs)).collect()] == ["a b\n"]
    finally:
        del pr.PROCESSORS["shout"], rn.RENDERERS["plain"]


def test_long_file_names_stay_apart(spark):
    from colloquy.functions.text import safe_file_name

    rows = spark.createDataFrame([("x" * 300 + "a",), ("x" * 300 + "b",), ("a b/ü.wav",), ("",)], "n string")
    got = [r[0] for r in rows.select(safe_file_name(F.col("n"), 200)).collect()]
    assert len(set(got[:2])) == 2 and all(len(x) == 200 for x in got[:2]) and got[2:] == ["a_b_ü.wav", "audio"]
    assert [len(r[0]) for r in rows.select(safe_file_name(F.col("n"))).collect()][:2] == [301, 301]
