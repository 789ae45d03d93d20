"""What a reviewer should look at: paragraphs, uncertain words, speaker changes that look wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.attribution import with_display_names
from colloquy.operators.jumps import rank_below, visited
from colloquy.operators.metrics import LOW
from colloquy.operators.ordered import concat_in_order, dense_axis, previous, running_sum, scan, with_halo
from colloquy.session import written

PARAGRAPH_MS = 2_500
SHORT_MS = 1_500
SWITCH_WINDOW_MS = 30_000
SWITCHES = 4


def number_paragraphs(words: DataFrame) -> DataFrame:
    """Add para_no: a new paragraph at each segment and after a pause of 2.5 s inside one."""
    axis = dense_axis("job_id", "word_idx")
    seen = scan(words, axis, _prev=previous(F.struct("seg_idx", "end_ms")))
    same = F.col("_prev.seg_idx") == F.col("seg_idx")
    runs_on = same & (F.col("start_ms") - F.col("_prev.end_ms") < PARAGRAPH_MS)
    flagged = written(seen.withColumn("_new", F.when(runs_on, 0).otherwise(1)).drop("_prev"), "paragraph_flags")
    return scan(flagged, axis, para_no=running_sum(F.col("_new"))).withColumn("para_no", F.col("para_no") - 1).drop("_new")


def paragraphs(words: DataFrame) -> DataFrame:
    numbered = number_paragraphs(words.select("job_id", "seg_idx", "word_idx", "text", "start_ms", "end_ms"))
    spans = numbered.groupBy("job_id", "seg_idx", "para_no").agg(
        F.min_by("start_ms", "word_idx").alias("start_ms"), F.max_by("end_ms", "word_idx").alias("end_ms"),
        F.count("*").alias("n_words"),
    )
    return spans.join(concat_in_order(numbered, ["job_id", "para_no"], "word_idx", "text"), ["job_id", "para_no"])


def uncertain_words(words: DataFrame, sents: DataFrame, names: DataFrame, whole_sentence: bool = False) -> DataFrame:
    """Uncertain words with the rest of their sentence, or all of it on request."""
    low = words.filter(F.col("confidence") < LOW).select(
        "job_id", "sent_no", "seg_idx", "word_idx", "speaker_id", "start_ms", "confidence", F.col("text").alias("word")
    )
    first = words.groupBy("job_id", "sent_no").agg(F.min("word_idx").alias("first_word"))
    texts = sents.select("job_id", "sent_no", "text").join(first, ["job_id", "sent_no"])
    joined = low.join(texts, ["job_id", "sent_no"])
    tokens = F.split("text", " ")
    at = (F.col("word_idx") - F.col("first_word") + 1).cast("int")
    rest = F.array_join(F.slice(tokens, at, F.size(tokens)), " ")
    context = F.col("text") if whole_sentence else rest
    return with_display_names(joined.withColumn("context", context), names).select(
        "job_id", "word_idx", "seg_idx", "start_ms", "display", "word", "confidence", "context"
    )


def short_segments(segs: DataFrame) -> DataFrame:
    return segs.filter((F.col("end_ms") - F.col("start_ms") < SHORT_MS) & (F.col("n_words") > 0)).select(
        "job_id", "seg_idx", "speaker_id", "start_ms", "end_ms", "text"
    )


def rapid_switches(segs: DataFrame) -> DataFrame:
    """30 s windows with four or more speaker changes, each starting at the first change after the last one.

    A pause of 30 s between changes separates walks; inside one, the next stop of every change is
    known from its rank on the time line.
    """
    axis = dense_axis("job_id", "seg_idx")
    seen = scan(segs.select("job_id", "seg_idx", "speaker_id", "start_ms"), axis, _prev=previous(F.struct("speaker_id")))
    changed = F.col("_prev").isNotNull() & (F.col("_prev.speaker_id") != F.col("speaker_id"))
    flagged = written(seen.withColumn("_chg", F.when(changed, 1).otherwise(0)), "switch_flags")
    numbered = scan(flagged, axis, idx=running_sum(F.col("_chg"))).filter("_chg = 1").select(
        "job_id", (F.col("idx") - 1).alias("idx"), "start_ms"
    )
    changes = written(numbered, "switches")
    by_change = dense_axis("job_id", "idx")
    gaps = scan(changes, by_change, _prev=previous(F.col("start_ms"))).withColumn(
        "_cut", F.when(F.col("start_ms") - F.col("_prev") < SWITCH_WINDOW_MS, 0).otherwise(1)
    )
    islands = written(scan(written(gaps.drop("_prev"), "switch_gaps"), by_change, island=running_sum(F.col("_cut"))), "switch_islands")
    until = rank_below(changes, islands.withColumn("_until", F.col("start_ms") + SWITCH_WINDOW_MS), "start_ms", "_until")
    since = rank_below(changes, islands, "start_ms", "start_ms").withColumnRenamed("below", "first")
    counted = written(
        islands.join(until, ["job_id", "idx"]).join(since, ["job_id", "idx"]).withColumn("n_changes", F.col("below") - F.col("first")),
        "switch_counts",
    )
    crowded = F.col("n_changes") >= SWITCHES
    steps = counted.select(
        "job_id", "island", "idx", F.when(crowded, F.col("below")).otherwise(F.col("idx") + 1).alias("next_idx")
    )
    stops = visited(steps).select("job_id", "idx")
    return counted.filter(crowded).join(stops, ["job_id", "idx"]).select(
        "job_id", "start_ms", (F.col("start_ms") + SWITCH_WINDOW_MS).alias("end_ms"), "n_changes"
    )


def alternating_pairs(segs: DataFrame) -> DataFrame:
    """First place in each meeting where two speakers alternate over six segments."""
    near = with_halo(segs.select("job_id", "seg_idx", "speaker_id", "start_ms", "end_ms"), "seg_idx", 0, 5)
    order = Window.partitionBy("job_id", "_block").orderBy("seg_idx")
    s = [F.col("speaker_id")] + [F.col(f"_s{i}") for i in range(1, 6)]
    for i in range(1, 6):
        near = near.withColumn(f"_s{i}", F.lead("speaker_id", i).over(order))
    near = near.withColumn("_end", F.lead("end_ms", 5).over(order)).filter("_own = _block")
    alternates = (s[0] != s[1]) & (s[0] == s[2]) & (s[0] == s[4]) & (s[1] == s[3]) & (s[1] == s[5])
    first = near.filter(alternates).groupBy("job_id").agg(
        F.min_by(F.struct("seg_idx", "start_ms", F.col("_end").alias("end_ms"), "speaker_id", F.col("_s1").alias("other")), "seg_idx").alias("f")
    )
    return first.select("job_id", "f.*")
