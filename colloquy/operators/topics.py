"""Topic chunks, keywords, timeline and summary of meetings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import lexicon as lx
from colloquy.functions.text import clipped
from colloquy.operators.attribution import with_display_names
from colloquy.operators.jumps import rank_below, visited
from colloquy.operators.ordered import dense_axis, previous, running_max, running_sum, scan
from colloquy.session import written

PAUSE_MS = 8_000
LONGEST_MS = 300_000


def topic_chunks(segs: DataFrame) -> DataFrame:
    """Number the topic chunk of each segment: (job_id, seg_idx, chunk, start_ms, end_ms).

    A pause of 8 s always cuts, so pauses make independent islands. Inside one, the segment whose
    end lies 300 s after the chunk start opens the next chunk; with the running maximum of the
    ends that segment is found by rank, for every possible start at once.
    """
    axis = dense_axis("job_id", "seg_idx")
    slim = segs.select("job_id", "seg_idx", "start_ms", "end_ms")
    gaps = scan(slim, axis, _prev_end=previous(F.col("end_ms")), latest=running_max(F.col("end_ms")))
    cut = F.col("_prev_end").isNull() | (F.col("start_ms") - F.col("_prev_end") >= PAUSE_MS)
    islands = written(
        scan(
            written(gaps.withColumn("_cut", F.when(cut, 1).otherwise(0)), "pauses"),
            axis, island=running_sum(F.col("_cut")),
        ).drop("_prev_end", "_cut"),
        "islands",
    )
    # Short islands have no inner cut; only the others need a walk.
    span = islands.groupBy("job_id", "island").agg(
        (F.max("end_ms") - F.min("start_ms")).alias("span"), F.min("seg_idx").alias("first")
    )
    heads = span.select("job_id", F.col("first").alias("seg_idx"))
    long_ones = written(
        islands.join(span.filter(F.col("span") >= LONGEST_MS).select("job_id", "island"), ["job_id", "island"]),
        "long_islands",
    )
    if not long_ones.isEmpty():
        probes = long_ones.select("job_id", F.col("seg_idx").alias("idx"), (F.col("start_ms") + LONGEST_MS).alias("due_ms"))
        reach = rank_below(islands, probes, "latest", "due_ms")
        # seg_idx is dense from 0, so the rank is the index of the first segment to reach the time.
        steps = long_ones.select("job_id", "island", F.col("seg_idx").alias("idx")).join(reach, ["job_id", "idx"]).select(
            "job_id", "island", "idx", F.greatest(F.col("below"), F.col("idx") + 1).alias("next_idx")
        )
        heads = heads.union(visited(steps).select("job_id", F.col("idx").alias("seg_idx"))).distinct()
    marked = islands.drop("island", "latest").join(heads.withColumn("_head", F.lit(1)), ["job_id", "seg_idx"], "left")
    marked = marked.withColumn("_head", F.coalesce("_head", F.lit(0)))
    numbered = scan(written(marked, "topic_heads"), axis, chunk=running_sum(F.col("_head")))
    return numbered.withColumn("chunk", F.col("chunk") - 1).drop("_head")


def top_terms(texts: DataFrame, keys: list[str], pattern: str, n: int) -> DataFrame:
    """The n most frequent terms per key, ties to the one seen first: adds term, n_seen, place.

    A term lies inside a word, so texts of several words, each with the index of its first one, are searched whole. Counts are combined before the shuffle and only n rows per key and task reach the ranking.
    """
    terms = texts.select(*keys, "word_idx", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(0))).alias("at", "term"))
    counted = (
        terms.filter(~F.col("term").isin(lx.STOP_WORDS))
        .groupBy(*keys, "term")
        .agg(F.count("*").alias("n_seen"), F.min(F.struct("word_idx", "at")).alias("first"))
    )
    order = Window.partitionBy(*keys).orderBy(F.desc("n_seen"), "first")
    return counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).drop("first")


TOPIC_TERM = "[a-z]{3,}"
SUMMARY_TERM = r"(?U)\b[a-z]{4,}\b"


def chunk_terms(segs: DataFrame, chunks: DataFrame) -> DataFrame:
    placed = segs.select("job_id", "seg_idx", F.col("first_word").alias("word_idx"), "text").join(chunks.select("job_id", "seg_idx", "chunk"), ["job_id", "seg_idx"])
    return top_terms(placed, ["job_id", "chunk"], TOPIC_TERM, 3)


def topics(segs: DataFrame, chunks: DataFrame) -> DataFrame:
    spans = chunks.groupBy("job_id", "chunk").agg(
        F.min_by("start_ms", "seg_idx").alias("start_ms"), F.max_by("end_ms", "seg_idx").alias("end_ms")
    )
    terms = chunk_terms(segs, chunks).groupBy("job_id", "chunk").agg(
        F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t")
    ).select("job_id", "chunk", F.transform("t", lambda x: x["term"]).alias("k"))
    k = F.coalesce("k", F.array().cast("array<string>"))
    label = (
        F.when(F.size(k) == 0, "General discussion")
        .when(F.size(k) == 1, F.concat(F.lit("Discussion about "), k[0]))
        .otherwise(F.concat(F.lit("Discussion about "), k[0], F.lit(", "), F.get(k, F.lit(1))))
    )
    return spans.join(terms, ["job_id", "chunk"], "left").select(
        "job_id", "chunk", "start_ms", "end_ms", label.alias("label"), F.array_join(k, ",").alias("keywords")
    )


DULL_LABELS = ("unknown", "other", "general", "")


def timeline(segs: DataFrame, names: DataFrame, topic_rows: DataFrame, decided: DataFrame, todo: DataFrame) -> DataFrame:
    """Events of each meeting, sorted by (at_ms, kind_no, item_no); one row per (time, event). `label` is the event cut for display."""
    ends = segs.groupBy("job_id").agg(
        F.min_by("start_ms", "seg_idx").alias("b"), F.max_by("end_ms", "seg_idx").alias("e")
    )
    nobody = F.lit(None).cast("string")

    def rows(df, kind_no, at, item_no, event, speaker=nobody, label=None):
        return df.select(
            "job_id", at.alias("at_ms"), F.lit(kind_no).alias("kind_no"), item_no.cast("long").alias("item_no"),
            event.alias("event"), (event if label is None else label).alias("label"), speaker.alias("speaker_id"),
        )

    seen = segs.groupBy("job_id", "speaker_id").agg(F.min(F.struct("seg_idx", "start_ms")).alias("f"))
    seen = with_display_names(seen, names)
    several = names.groupBy("job_id").agg(F.count("*").alias("n")).filter("n > 1")
    heard = seen.join(several, "job_id", "left_semi")
    shown = topic_rows.filter(~F.lower("label").isin(*DULL_LABELS))
    zero = F.lit(0)
    everything = (
        rows(ends, 0, F.col("b"), zero, F.lit("Meeting begins"))
        .union(rows(heard, 1, F.col("f.start_ms"), F.col("f.seg_idx"), F.concat("display", F.lit(" speaks")), F.col("speaker_id")))
        .union(rows(shown, 2, F.col("start_ms"), F.col("chunk"), F.concat(F.lit("Topic: "), "label"), label=F.concat(F.lit("Topic: "), clipped(F.col("label"), 60))))
        .union(rows(decided, 3, F.col("at_ms"), F.col("sent_no"), F.concat(F.lit("Decision: "), "decision"), F.col("speaker_id"), F.concat(F.lit("Decision: "), clipped(F.col("decision"), 60))))
        .union(rows(todo, 4, F.col("at_ms"), F.col("sent_no"), F.concat(F.lit("Action item: "), "task"), F.col("speaker_id"), F.concat(F.lit("Action item: "), clipped(F.col("task"), 60))))
        .union(rows(ends, 5, F.col("e"), zero, F.lit("Meeting ends")))
    )
    once = everything.groupBy("job_id", "at_ms", "event").agg(
        F.min(F.struct("kind_no", "item_no", "label", "speaker_id")).alias("f")
    )
    return once.select("job_id", "at_ms", "f.kind_no", "f.item_no", "event", "f.label", "f.speaker_id")


def summary_terms(texts: DataFrame) -> DataFrame:
    """From words, or from pieces of several words with the index of the first."""
    return top_terms(texts, ["job_id"], SUMMARY_TERM, 5)


def summary(jobs: DataFrame, names: DataFrame, words: DataFrame, decided: DataFrame, todo: DataFrame) -> DataFrame:
    """At most ten bullets per meeting: (job_id, bullet_no, bullet)."""
    s = F.floor(F.col("duration_ms") / 1000).cast("long")
    minutes = F.floor(s / 60).cast("long")
    length = F.when(minutes > 0, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%ds", s % 60))
    people = names.groupBy("job_id").agg(
        F.count("*").alias("n"), F.min_by("display", "speaker_id").alias("one"), F.max_by("display", "speaker_id").alias("two")
    )
    header = (
        F.when(F.col("n") == 2, F.concat("one", F.lit(" and "), "two", F.lit(" met for "), length, F.lit(".")))
        .when(F.col("n") > 2, F.concat(F.lit("Meeting with "), F.col("n").cast("string"), F.lit(" participants, "), length, F.lit(" long.")))
        .otherwise(F.concat(F.lit("Single-speaker recording, "), length, F.lit(" long.")))
    )
    terms = summary_terms(words).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    about = F.concat(F.lit("Topics discussed: "), F.array_join(F.transform("t", lambda x: x["term"]), ", "), F.lit("."))

    def first_few(df, n):
        place = Window.partitionBy("job_id").orderBy("sent_no")
        return df.withColumn("r", F.row_number().over(place)).filter(F.col("r") <= n)

    decision = F.concat(F.lit("**Decision:** "), F.rtrim(F.col("decision"), F.lit(".")), F.lit("."))
    due = F.coalesce(F.concat(F.lit(" by "), "due_date"), F.lit(""))
    task = F.concat(
        F.lit("**Action — "), F.coalesce("owner", F.lit("Team")), F.lit(":** "), F.rtrim(F.col("task"), F.lit(".")), due, F.lit(".")
    )
    lines = (
        jobs.join(people, "job_id", "left").select("job_id", F.lit(0).alias("part"), F.lit(0).alias("r"), header.alias("bullet"))
        .union(terms.select("job_id", F.lit(1), F.lit(0), about))
        .union(first_few(decided, 3).select("job_id", F.lit(2), "r", decision))
        .union(first_few(todo, 5).select("job_id", F.lit(3), "r", task))
    )
    # At most 1 + 1 + 3 + 5 lines per meeting, so the cap of ten always holds.
    place = Window.partitionBy("job_id").orderBy("part", "r")
    return lines.select("job_id", F.row_number().over(place).alias("bullet_no"), "bullet")
